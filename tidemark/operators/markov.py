"""States to transition networks: counts, probabilities, state statistics and ranks, runs and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .discretize import discretize
from .scaling import transform_series

EPSILON = 1e-10


def transition_counts(states: DataFrame, level: str = "series", k: int | None = None) -> DataFrame:
    """(series_id, from_state, to_state, n) with zero cells, of (series_id, t, state).

    Null states are left out first, so gaps are bridged.  ``series`` counts within each
    series; ``user`` adds these up over series; ``global`` runs on from series to series
    in order of id.  The grid holds states 1..k, or the states seen.
    """
    known = states.where("state IS NOT NULL").select("series_id", "t", "state")
    if level not in ("series", "user", "global"):
        raise ValueError(f"unknown level {level}")
    by = Window.partitionBy("series_id").orderBy("t")
    pairs = known.withColumn("to_state", F.lead("state").over(by))
    if level == "global":
        # The only steps that cross series are from each one's last state to the next one's first.
        ends = known.groupBy("series_id").agg(F.max_by("state", "t").alias("from_state"), F.min_by("state", "t").alias("first"))
        across = ends.withColumn("to_state", F.lead("first").over(Window.orderBy("series_id"))).select("from_state", "to_state")
        pairs = pairs.select(F.col("state").alias("from_state"), "to_state").unionByName(across).withColumn("series_id", F.lit("all"))
    else:
        pairs = pairs.select(F.lit("all").alias("series_id") if level == "user" else "series_id", F.col("state").alias("from_state"), "to_state")
    counts = pairs.where("to_state IS NOT NULL").groupBy("series_id", "from_state", "to_state").agg(F.count("*").alias("n"))
    if k is None:
        names = known.select("state").distinct()
    else:
        names = states.sparkSession.range(1, k + 1).select(F.col("id").cast(known.schema["state"].dataType).alias("state"))
    # States are few by construction: the grid has their number squared for each series.
    grid = counts.select("series_id").distinct().crossJoin(F.broadcast(names.withColumnRenamed("state", "from_state"))).crossJoin(F.broadcast(names.withColumnRenamed("state", "to_state")))
    full = grid.join(counts, ["series_id", "from_state", "to_state"], "left")
    return full.select("series_id", "from_state", "to_state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def transition_probabilities(counts: DataFrame, exact: bool = False) -> DataFrame:
    """Adds ``prob``: n over the row's sum (plus a tiny constant, or exactly with empty rows 0)."""
    total = F.sum("n").over(Window.partitionBy("series_id", "from_state"))
    prob = F.when(total > 0, F.col("n") / total).otherwise(0.0) if exact else F.col("n") / (total + EPSILON)
    return counts.withColumn("prob", prob)


def network_edges(probabilities: DataFrame, least: float = 0.0) -> DataFrame:
    """Cells above zero and not below ``least``, as weighted edges."""
    return probabilities.where((F.col("prob") > 0) & (F.col("prob") >= least)).select("series_id", "from_state", "to_state", F.col("prob").alias("weight"))


def state_statistics(states: DataFrame, by: list[str] | None = None, members: bool = False) -> DataFrame:
    """One row a state: n, share, mean, median, sd, extremes, quartiles, skewness and kurtosis.

    Skewness and kurtosis divide by (n - 1) times the sample deviation's power; null
    below 3 and 4 values, 0 without spread.  ``members`` adds the list of t (bounded by
    the state's size, so off by default).
    """
    by = by or []
    known = states.where("state IS NOT NULL")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = known.groupBy(*by, "state").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), q.alias("q"),
        *([F.sort_array(F.collect_list("t")).alias("members")] if members else []),
    )
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    stats = stats.withColumn("frequency", F.col("n") / F.sum("n").over(whole))
    d = known.join(stats.select(*by, "state", F.col("mean").alias("_m"), F.col("sd").alias("_s"), F.col("n").alias("_n")), [*by, "state"])
    part = lambda p: F.sum(F.pow(F.col("value") - F.col("_m"), p) / ((F.col("_n") - 1) * F.pow("_s", F.lit(float(p)))))
    shape = d.where("_n > 1 AND _s > 0").groupBy(*by, "state").agg(part(3).alias("_sk"), part(4).alias("_ku"))
    out = stats.join(shape, [*by, "state"], "left")
    kind = lambda c, least: F.when(F.col("n") >= least, F.coalesce(c, F.lit(0.0)))
    return out.select(
        *by, "state", "n", "frequency", "mean", F.col("q")[1].alias("median"), "sd", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"),
        kind("_sk", 3).alias("skewness"), kind("_ku", 4).alias("kurtosis"), *(["members"] if members else []),
    )


def rank_states(states: DataFrame) -> DataFrame:
    """``states`` with ranked_state: the rank of the state's mean, ties by state."""
    means = states.where("state IS NOT NULL").groupBy("state").agg(F.avg("value").alias("_m"))
    ranks = means.withColumn("ranked_state", F.row_number().over(Window.orderBy("_m", "state"))).drop("_m")
    return states.join(F.broadcast(ranks), "state", "left")  # a row a state


def state_summary(states: DataFrame) -> DataFrame:
    """Count, mean, median, sd and descending ranks (ties averaged) by mean and median, a row a state."""
    s = states.where("state IS NOT NULL").groupBy("state").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.stddev_samp("value").alias("sd"))
    for c in ("mean", "median"):
        rank = F.rank().over(Window.orderBy(F.desc(c)))
        ties = F.count("*").over(Window.partitionBy(c))
        s = s.withColumn(f"rank_by_{c}", rank + (ties - 1) / 2)
    return s


def run_lengths(states: DataFrame) -> DataFrame:
    """Runs of equal states: (series_id, run, state, start, end, duration); a null run is a run too."""
    by = Window.partitionBy("series_id").orderBy("t")
    new = ~F.col("state").eqNullSafe(F.lag("state").over(by)) | (F.row_number().over(by) == 1)
    numbered = states.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("series_id", "run").agg(F.first("state").alias("state"), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("duration"))


def state_bands(states: DataFrame) -> DataFrame:
    """Rectangles that fill a chart behind runs: from and to lie midway between neighbouring runs."""
    runs = run_lengths(states)
    by = Window.partitionBy("series_id").orderBy("run")
    left = F.coalesce((F.col("start") + F.lag("end").over(by)) / 2, F.col("start").cast("double"))
    right = F.coalesce((F.col("end") + F.lead("start").over(by)) / 2, F.col("end").cast("double"))
    return runs.withColumn("from_t", left).withColumn("to_t", right).select("series_id", "run", "state", "from_t", "to_t")


def change_points(states: DataFrame) -> DataFrame:
    """The rows at which a series' state differs from the one before."""
    by = Window.partitionBy("series_id").orderBy("t")
    return states.withColumn("_p", F.lag("state").over(by)).where("_p IS NOT NULL AND state <> _p").drop("_p")


REPULSION, ATTRACTION, MOVE, SPRING_ROUNDS = 0.1, 0.01, 0.1, 50
"""Fixed values of the spring layout: forces, the share of a force a state moves by, rounds over all states."""


def _spring(places: DataFrame, states: DataFrame) -> DataFrame:
    """(state, x, y) from a start on the unit circle; each round moves the states in turn.

    All states push a state away with a force of REPULSION over the distance; those it
    goes over to pull it with ATTRACTION times the distance.  Coordinates are two arrays
    of one row (a value a state), which an aggregate moves step by step.
    """
    following = F.lead("state").over(Window.partitionBy("series_id").orderBy("t"))
    index = lambda c: places.select(F.col("state").alias(c), F.col("_i").alias(f"{c}_i"))
    moves = states.select("state", following.alias("next")).where("state <> next").distinct()
    moves = moves.join(index("state"), "state").join(index("next"), "next").select(F.lit(None).cast(places.schema["state"].dataType).alias("state"), F.lit(None).cast("int").alias("_i"), F.struct("state_i", "next_i").alias("move"))
    rows = moves.unionByName(places.select("state", F.col("_i").cast("int").alias("_i"), F.lit(None).cast(moves.schema["move"].dataType).alias("move")))
    one = rows.agg(F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "state"))))["state"].alias("states"), F.collect_set("move").alias("moves"))
    n = F.size("states")
    every = F.sequence(F.lit(0), n - 1)
    angle = lambda i: 2 * 3.141592653589793 * i / n
    flat = F.flatten(F.transform(every, lambda i: F.transform(every, lambda j: F.when(F.exists("moves", lambda m: (m["state_i"] == i) & (m["next_i"] == j)), ATTRACTION).otherwise(0.0))))
    one = one.where(n > 0).withColumns({"pull": flat, "start": F.struct(F.transform(every, lambda i: F.cos(angle(i))).alias("x"), F.transform(every, lambda i: F.sin(angle(i))).alias("y"))})

    def moved(at: Column, step: Column) -> Column:
        i = (step % n).cast("int")
        far = lambda c, j: F.get(at[c], i) - F.get(at[c], j)
        square = lambda j: far("x", j) * far("x", j) + far("y", j) * far("y", j)
        force = lambda c: F.aggregate(every, F.lit(0.0), lambda so_far, j: so_far + F.when(square(j) > 0, far(c, j) * (REPULSION / square(j) - F.get("pull", i * n + j))).otherwise(0.0))
        new = lambda c: F.transform(at[c], lambda v, j: F.when(j == i, v + MOVE * force(c)).otherwise(v))
        return F.struct(new("x").alias("x"), new("y").alias("y"))

    end = one.select("states", F.aggregate(F.sequence(F.lit(0), SPRING_ROUNDS * n - 1), F.col("start"), moved).alias("end"))
    return end.select(F.explode(F.arrays_zip("states", F.col("end.x").alias("x"), F.col("end.y").alias("y"))).alias("z")).select(F.col("z.states").alias("state"), "z.x", "z.y")


def node_layout(states: DataFrame, kind: str = "circle") -> DataFrame:
    """A row a state with x and y, share of points and mean run length.

    Kinds: a unit circle, a square grid, the levels of a tree, or a spring layout of the
    states' transitions.  States are few: they meet in one row or window.
    """
    runs = run_lengths(states).where("state IS NOT NULL").groupBy("state").agg(F.sum("duration").alias("n"), F.avg("duration").alias("mean_run"))
    i = F.row_number().over(Window.orderBy("state")) - 1  # a row a state
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    out = runs.withColumns({"_i": i, "_k": n, "frequency": F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))})
    if kind == "spring":
        return out.join(_spring(out, states), "state").select("state", "x", "y", "frequency", "mean_run")
    angle = 2 * 3.141592653589793 * F.col("_i") / F.col("_k")
    wide = F.ceil(F.sqrt("_k"))
    row = F.ceil(F.col("_k") / F.ceil(F.log2((F.col("_k") + 1).cast("double"))))
    grid = lambda w: (F.col("_i") % w + 1.0, F.floor(F.col("_i") / w) + 1.0)
    kinds = {"circle": lambda: (F.cos(angle), F.sin(angle)), "grid": lambda: grid(wide), "tree": lambda: grid(row)}
    if kind not in kinds:
        raise ValueError(f"unknown layout {kind}")
    x, y = kinds[kind]()
    return out.select("state", x.cast("double").alias("x"), y.cast("double").alias("y"), "frequency", "mean_run")


def state_network(series: DataFrame, k: int = 5, method: str = "quantile", level: str = "series", transform: str = "none", rank: bool = True, **options) -> dict[str, DataFrame]:
    """Transform, discretise, count: states, statistics, counts, probabilities and edges."""
    moved, _ = transform_series(series, transform)
    states = discretize(moved, method, k, **options)
    if rank:
        states = rank_states(states)
    counts = transition_counts(states, level, k)
    probabilities = transition_probabilities(counts)
    return {"states": states, "statistics": state_statistics(states), "counts": counts, "probabilities": probabilities, "edges": network_edges(probabilities)}
