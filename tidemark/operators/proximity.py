"""Proximity networks: windows or segments, pairwise distances, similarities, graphs.

Distances are rows (series_id, src, dst, distance) with src < dst for symmetric
metrics; a missing pair has no link.  Pairs are formed only within a series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import metric, ranks
from ..sources.ranges import quantile_rows
from ..sources.tables import written

SIMILARITIES = ("normalized_inverse", "inverse", "negative_exp", "max_minus", "gaussian", "reciprocal")
NETWORKS = ("full", "epsilon", "knn", "threshold", "percentile", "gaussian")
HEAVY_SHARE = 1_000  # at most so many groups are broadcast
OUT_ROWS = 131_072  # of an Arrow batch of distances


def windows(series: DataFrame, size: int, step: int | None = None, tail: bool = False) -> DataFrame:
    """(series_id, window_id, start_t, end_t, x): full windows of ``size`` rows, ``step`` (default ``size``) apart.

    Each row goes to the at most size/step windows that hold it, so a long series is
    not gathered in one place.  With ``tail`` a last window ends at the last row, where
    the others leave rows over.
    """
    step = step or size
    if size < 1 or step < 1:
        raise ValueError("size and step are positive")
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - size) / step))
    last = F.floor((F.col("t") - 1) / step)
    placed = series.where(F.lit(True)).withColumn("w", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    grouped = placed.groupBy("series_id", "w").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("t", "value"))).alias("rows"))
    full = grouped.where(F.col("n") == size)
    out = full.select("series_id", (F.col("w") + 1).alias("window_id"), (F.col("w") * step + 1).alias("start_t"), (F.col("w") * step + size).alias("end_t"), F.col("rows.value").alias("x"))
    if not tail:
        return out
    ends = series.groupBy("series_id").agg(F.max("t").alias("end_t")).where((F.col("end_t") > size) & ((F.col("end_t") - size) % step != 0))
    last = series.join(ends, "series_id").where(F.col("t") > F.col("end_t") - size).groupBy("series_id", "end_t").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("rows"))
    number = F.floor((F.col("end_t") - size) / step) + 2
    over = last.where(F.size("rows") == size).select("series_id", number.alias("window_id"), (F.col("end_t") - size + 1).alias("start_t"), "end_t", F.col("rows.value").alias("x"))
    return out.unionByName(over)


def segments(series: DataFrame) -> DataFrame:
    """Every series as one window of a common group: (series_id, window_id, x), numbered by id."""
    rows = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("r"))
    numbered = rows.withColumn("window_id", F.row_number().over(Window.orderBy("series_id")).cast("long"))
    return numbered.select(F.lit("all").alias("series_id"), "window_id", F.col("series_id").alias("label"), F.col("r.value").alias("x"))


def pairwise(vectors: DataFrame, name: str = "euclidean", consecutive: bool = False, **options) -> DataFrame:
    """(series_id, src, dst, distance) over all pairs src < dst, or each window and the next.

    Vectors of different length fail, but for warping.
    """
    if name.lower() == "spearman":  # ranks once a vector, not once a pair
        vectors, name = vectors.withColumn("x", ranks(F.col("x"))), "pearson"
    d = metric(name, **options)
    if consecutive:
        by = Window.partitionBy("series_id").orderBy("window_id")
        out = vectors.withColumns({"dst": F.lead("window_id").over(by), "y": F.lead("x").over(by)}).where("dst IS NOT NULL").withColumnRenamed("window_id", "src")
    else:
        a = vectors.select("series_id", F.col("window_id").alias("src"), "x")
        b = vectors.select("series_id", F.col("window_id").alias("dst"), F.col("x").alias("y"))
        out = a.join(b, "series_id").where("src < dst")
    if not name.lower().endswith(("dtw", "dtw_symmetric2")):
        out = out.where(F.when(F.size("x") != F.size("y"), F.raise_error(F.lit("vectors differ in length")).cast("boolean")).otherwise(True))
    return out.select("series_id", "src", "dst", d(F.col("x"), F.col("y")).alias("distance"))


def pairwise_by_blocks(vectors: DataFrame, block: int = 1024, named: bool = True) -> DataFrame:
    """The rows of ``pairwise`` by Euclidean distance, for groups of any size; unless ``named``, without series_id.

    The vectors of a group of more than ``block`` (and than a HEAVY_SHARE-th of all) are dealt by hash to
    blocks of some ``block``; a smaller group is one block. A block is one row. Blocks are dealt to
    partitions, and a task meets two of these: it reads them again rather than having its own copy
    of every block shuffled, so that what lies on disk grows with the vectors, not with their pairs.
    """
    known = vectors.where("series_id IS NOT NULL AND window_id IS NOT NULL").select("series_id", "window_id", "x")
    sizes = known.groupBy("series_id").agg(F.count("*").alias("n"))
    heavy = sizes.where(F.col("n") > max(block, known.count() // HEAVY_SHARE)).select("series_id", F.ceil(F.col("n") / block).alias("blocks"))
    pieces = heavy.agg(F.sum("blocks")).first()[0] or 0
    dealt = known.join(F.broadcast(heavy), "series_id", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("window_id"), "blocks"), F.lit(-1)))
    gathered = F.array_sort(F.collect_list(F.struct("window_id", "x")))  # sorted, so that a task run again deals the same rows
    blocks = dealt.groupBy("series_id", "own").agg(gathered.alias("a"))
    met = blocks.where("own < 0").select("series_id", "a", F.lit(None).cast(blocks.schema["a"].dataType).alias("b"))
    if pieces:
        spread = blocks.where("own >= 0").repartition(max(-(-pieces // 32), min(pieces, 12)))
        other = spread.select("series_id", F.col("own").alias("next"), F.col("a").alias("b")).hint("shuffle_replicate_nl")
        both = spread.join(other, "series_id").where("own <= next")
        met = met.unionByName(both.select("series_id", "a", F.when(F.col("own") < F.col("next"), F.col("b")).alias("b")))
    id_type = dict(vectors.dtypes)["window_id"]
    if not named:
        met = met.select("a", "b")
    return met.mapInArrow(_block_distances, "series_id string, " * named + f"src {id_type}, dst {id_type}, distance double")


def _block_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of the pairs between two blocks (series_id if wanted, a, b), or within one where ``b`` is null."""
    parts, held = [], 0
    for batch in batches:
        for *sid, a, b in zip(*batch.columns, strict=True):
            for part in _between(_block(a), _block(b) if b.is_valid else None):
                parts.append((sid, *part))
                held += len(part[0])
                if held >= OUT_ROWS:
                    yield _edges(parts)
                    parts, held = [], 0
    if parts:
        yield _edges(parts)


def _block(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, set[int]]:
    """Ids, vectors as columns (zeros for nulls), which vectors are null or hold a null, and the lengths met."""
    ids, x = (rows.values.field(name) for name in ("window_id", "x"))
    lengths = set(pc.unique(pc.list_value_length(x).drop_null()).to_pylist())
    _of_one_length(lengths)
    known = np.asarray(pc.is_valid(x))
    flat, shape = x.flatten(), (known.sum(), max(lengths, default=0))
    columns = np.zeros((shape[1], len(x)))
    columns[:, known] = np.asarray(flat.fill_null(0), float).reshape(shape).T
    null = ~known
    null[known] |= np.asarray(pc.is_null(flat)).reshape(shape).any(axis=1)
    return np.asarray(ids), columns, null, lengths


def _of_one_length(lengths: set[int]) -> None:
    if len(lengths) > 1:
        raise ValueError("vectors differ in length")


def _between(one: tuple, two: tuple | None) -> Iterator[tuple]:
    """(src, dst, distance, is null) of the pairs between two blocks, or within one, a vector of the first at a time."""
    (ids, x, null, lengths), (names, there, none, others) = one, two or one
    _of_one_length(lengths | others)
    if len(x) != len(there):  # a block of nulls only
        x, there = np.zeros((1, len(ids))), np.zeros((1, len(names)))
    room = np.empty_like(there)
    for i, own in enumerate(ids):
        at = i + 1 if two is None else 0  # ids ascend
        gap = room[:, at:]
        np.subtract(there[:, at:], x[:, i : i + 1], out=gap)
        np.multiply(gap, gap, out=gap)
        keep = names[at:] != own
        to = names[at:][keep]
        yield np.minimum(own, to), np.maximum(own, to), np.sqrt(np.add.reduce(gap, axis=0))[keep], (none[at:] | null[i])[keep]


def _edges(parts: list[tuple]) -> pa.RecordBatch:
    """Rows (series_id if given, src, dst, distance) of what ``_between`` gives, each with its series."""
    sids, *columns = zip(*parts)
    src, dst, far, none = (np.concatenate(c) for c in columns)
    out = {"src": pa.array(src), "dst": pa.array(dst), "distance": pa.array(far, mask=none)}
    if sids[0]:
        place = np.repeat(np.arange(len(sids)), [len(p[1]) for p in parts])
        out = {"series_id": pa.array([s.as_py() for s, in sids], pa.string()).take(pa.array(place))} | out
    return pa.RecordBatch.from_pydict(out)


def ts_distance(series: DataFrame, method: str = "euclidean", window: int | None = None, step: int | None = None, consecutive: bool = False, symmetric: bool = True, **options) -> DataFrame:
    """Distances of all windows of each series, or without ``window`` of all series, one vector each.

    Symmetric distances have src < dst; otherwise both directions are rows.
    """
    vectors = segments(series) if window is None else windows(series, window, step)
    edges = pairwise(vectors, method, consecutive, **options)
    return edges if symmetric else mirrored(edges)


def distance_pair(a: DataFrame, b: DataFrame, method: str = "euclidean", **options) -> DataFrame:
    """(series_id, distance) of the series of equal id in ``a`` and ``b``."""
    vector = lambda s, name: s.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "value")))["value"].alias(name))
    both = vector(a, "x").join(vector(b, "y"), "series_id")
    return both.select("series_id", metric(method, **options)(F.col("x"), F.col("y")).alias("distance"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def symmetrised(edges: DataFrame) -> DataFrame:
    """The mean of both directions, as src < dst."""
    return edges.groupBy("series_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.avg("distance").alias("distance"))


def point_map(series: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each point's windows: (series_id, t, n_windows, window_ids) by a range join on t."""
    span = vectors.select("series_id", "window_id", F.explode(F.sequence("start_t", "end_t")).alias("t"))
    found = series.select("series_id", "t").join(span, ["series_id", "t"], "left")
    grouped = found.groupBy("series_id", "t").agg(F.count("window_id").alias("n_windows"), F.array_sort(F.collect_list("window_id")).alias("w"))
    return grouped.select("series_id", "t", "n_windows", F.array_join(F.transform("w", lambda x: x.cast("string")), ",").alias("window_ids"))


def distance_summary(edges: DataFrame, long: bool = False) -> DataFrame:
    """One row a series: count, spread and quartiles of distances, a scale class and the method it suggests.

    With ``long``, here and below, quantiles are rows at their places among all pairs of a
    series in order, and no task holds a series' distances.
    """
    out = edges.groupBy("series_id").agg(
        F.count("*").alias("n"), F.min("distance").alias("min"), F.max("distance").alias("max"), F.avg("distance").alias("mean"), F.stddev_samp("distance").alias("sd"),
        F.sum((F.col("distance") == 0).cast("long")).alias("zeros"),
    )
    out = out.join(quantile_rows(edges, "distance", [0.25, 0.5, 0.75], long), "series_id", "left")
    scale = F.when(F.col("max") > 1000, "very large").when(F.col("max") > 100, "large").when(F.col("max") > 10, "medium").otherwise("small")
    advice = F.when(F.col("max") > 1000, "knn").when(F.col("max") > 100, "percentile").otherwise("threshold")
    return out.select("series_id", "n", "min", "max", "mean", "sd", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "zeros", (F.col("max") - F.col("min")).alias("range"), scale.alias("scale"), advice.alias("recommended"))


def _finite(c: str = "distance") -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _usable(edges: DataFrame) -> DataFrame:
    """The pairs of finite positive distance."""
    return edges.where(_finite() & (F.col("distance") > 0))


def _with_quantile(edges: DataFrame, name: str, prob: float, long: bool) -> DataFrame:
    """``edges`` with a quantile of the series' usable distances."""
    q = quantile_rows(_usable(edges), "distance", [prob], long)
    return edges.join(q.select("series_id", F.col("q")[0].alias(name)), "series_id", "left")


def similarity(edges: DataFrame, method: str = "normalized_inverse", sigma: float | None = None, long: bool = False) -> DataFrame:
    """``edges`` with ``similarity``; what is not finite becomes 0, sigma defaults to the median positive distance."""
    if method not in SIMILARITIES:
        raise ValueError(f"unknown method {method}")
    edges = written(edges, "pairs")  # pairs are read twice, never formed twice
    out = edges.join(_usable(edges).groupBy("series_id").agg(F.max("distance").alias("_max")), "series_id", "left")
    if method in ("gaussian", "negative_exp") and sigma is None:
        out = _with_quantile(out, "_sigma", 0.5, long)
    d, s = F.col("distance"), (F.lit(float(sigma)) if sigma is not None else F.col("_sigma"))
    value = {
        "normalized_inverse": lambda: 1 - d / F.col("_max"),
        "inverse": lambda: 1 / (1 + d),
        "negative_exp": lambda: F.exp(-d / s),
        "max_minus": lambda: (F.col("_max") - d) / F.col("_max"),
        "gaussian": lambda: F.exp(-d * d / (2 * s * s)),
        "reciprocal": lambda: F.when(d > 0, 1 / d).otherwise(0.0),
    }[method]()
    plain = F.when(F.col("_max").isNull(), d).otherwise(value)
    return out.withColumn("similarity", F.when(_finite() & ~F.isnan(plain), plain).otherwise(0.0)).select(*edges.columns, "similarity")


def normalize(edges: DataFrame, column: str = "similarity", method: str = "minmax", target: tuple[float, float] | None = (0.0, 1.0), long: bool = False) -> DataFrame:
    """``edges`` with ``normalized``: parameters come from non-zero values, zeros stay zero.

    minmax, max and quantile are then stretched to ``target`` by the extremes that
    include zeros and the (zero) diagonal.
    """
    x, some = F.col(column), edges.where(F.col(column) != 0)
    p = some.groupBy("series_id").agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    out = edges.join(p, "series_id", "left")
    if method in ("robust", "quantile"):
        q = quantile_rows(some, column, [0.05, 0.5, 0.95], long).withColumnRenamed("q", "_q")
        out = out.join(q, "series_id", "left")
    if method == "robust":
        away = some.join(q, "series_id").withColumn("_away", F.abs(x - F.col("_q")[1]))
        out = out.join(quantile_rows(away, "_away", [0.5], long).select("series_id", (1.4826 * F.col("q")[0]).alias("_mad")), "series_id", "left")
    over = lambda a, b: F.when(b == 0, a).otherwise(a / b)
    kinds = {
        "minmax": lambda: F.when(F.col("_hi") == F.col("_lo"), x).otherwise((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))),
        "max": lambda: over(x, F.col("_hi")),
        "zscore": lambda: over(x - F.col("_m"), F.col("_s")),
        "robust": lambda: over(x - F.col("_q")[1], F.col("_mad")),
        "quantile": lambda: F.when(F.col("_q")[2] == F.col("_q")[0], x).otherwise((x - F.col("_q")[0]) / (F.col("_q")[2] - F.col("_q")[0])),
    }
    if method not in kinds:
        raise ValueError(f"unknown method {method}")
    out = out.withColumn("normalized", F.when(x == 0, 0.0).otherwise(kinds[method]()))
    if target is not None and method not in ("zscore", "robust"):
        ends = out.groupBy("series_id").agg(F.least(F.lit(0.0), F.min("normalized")).alias("_a"), F.greatest(F.lit(0.0), F.max("normalized")).alias("_b"))
        out = out.join(ends, "series_id", "left")
        stretched = (F.col("normalized") - F.col("_a")) / (F.col("_b") - F.col("_a")) * (target[1] - target[0]) + target[0]
        out = out.withColumn("normalized", F.when(F.col("_b") > F.col("_a"), stretched).otherwise(F.col("normalized")))
    return out.select(*edges.columns, "normalized")


def prepare_plot(edges: DataFrame, conversion: str = "normalized_inverse", normalization: str = "minmax", threshold: str = "percentile", cut: float = 0.0, long: bool = False) -> DataFrame:
    """Similarities, normalised; those below a percentile (of positive ones) or an absolute cut become 0."""
    out = normalize(similarity(edges, conversion, long=long), "similarity", normalization, long=long)
    if threshold == "percentile":
        least = quantile_rows(out.where("normalized > 0"), "normalized", [cut], long).select("series_id", F.col("q")[0].alias("_cut"))
        out = out.join(least, "series_id", "left")
    else:
        out = out.withColumn("_cut", F.lit(float(cut)))
    return out.withColumn("weight", F.when(F.col("normalized") >= F.col("_cut"), F.col("normalized")).otherwise(0.0)).drop("_cut")


def build_network(edges: DataFrame, method: str = "full", k: int = 5, epsilon: float | None = None, threshold: float | None = None, percentile: float = 0.2, sigma: float | None = None, normalized: bool = False, long: bool = False) -> DataFrame:
    """Weighted undirected edges (series_id, src, dst, weight) of a proximity network.

    ``full`` keeps similarities 1 - d/max above 0, ``gaussian`` the kernel; the others
    keep some edges at 1/(1 + d): distances within epsilon, a threshold (default the
    first quartile) or a percentile, or the union of every node's k nearest.  Infinite
    distances count as ten times the largest finite one.
    """
    if method not in NETWORKS:
        raise ValueError(f"unknown method {method}")
    if method == "full":
        return similarity(edges).where("similarity > 0").select("series_id", "src", "dst", F.col("similarity").alias("weight"))
    edges = written(edges, "pairs")  # pairs are read twice, never formed twice
    endless = F.max((F.col("distance") == float("inf")).cast("int"))
    found = edges.groupBy("series_id").agg(F.max(F.when(_finite() & (F.col("distance") > 0), F.col("distance"))).alias("_max"), endless.alias("_endless"))
    big = edges.join(found, "series_id", "left").withColumn("distance", F.when(F.col("distance") == float("inf"), 10 * F.col("_max")).otherwise(F.col("distance")))
    if normalized:
        big = big.withColumn("distance", F.col("distance") / F.when(F.col("_endless") == 1, 10 * F.col("_max")).otherwise(F.col("_max")))
    out = big.drop("_max", "_endless")
    if method == "percentile" or method == "threshold" and threshold is None:
        out = _with_quantile(out, "_q", 0.25 if method == "threshold" else percentile, long)
    elif method == "gaussian" and sigma is None:
        out = _with_quantile(out, "_med", 0.5, long)
    d, positive = F.col("distance"), F.col("distance") > 0
    if method == "gaussian":
        s = F.lit(float(sigma)) if sigma is not None else F.col("_med")
        return out.select("series_id", "src", "dst", F.exp(-d * d / (2 * s * s)).alias("weight"))
    if method == "knn":
        return _nearest_union(mirrored(out.where(positive).select("series_id", "src", "dst", "distance")), k)
    if method == "epsilon":
        if epsilon is None:
            raise ValueError("epsilon is needed")
        limit = F.lit(float(epsilon))
    else:
        limit = F.lit(float(threshold)) if method == "threshold" and threshold is not None else F.col("_q")
    return out.where(positive & (d <= limit)).select("series_id", "src", "dst", (1 / (1 + d)).alias("weight"))


def _nearest_union(both: DataFrame, k: int) -> DataFrame:
    """The union of every node's ``k`` nearest (ties to smaller ids) from edges in both directions, weighted 1/(1 + d)."""
    near = both.withColumn("r", F.row_number().over(Window.partitionBy("series_id", "src").orderBy("distance", "dst"))).where(F.col("r") <= k)
    kept = near.groupBy("series_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("distance").alias("distance"))
    return kept.select("series_id", "src", "dst", (1 / (1 + F.col("distance"))).alias("weight"))


PIECES = 4


def indexed(vectors: DataFrame) -> DataFrame:
    """(series_id, window_id, x, u) of vectors without nulls: u has the means of PIECES even pieces, each times the root of its length.

    Two vectors are never nearer (by Euclidean distance) than their ``u`` are.
    """
    n = F.size("x")
    ends = [F.floor(n * i / PIECES).cast("int") for i in range(PIECES + 1)]
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = [F.when(b > a, total(F.slice("x", a + 1, F.greatest(b - a, F.lit(1)))) / F.sqrt((b - a).cast("double"))).otherwise(0.0) for a, b in zip(ends, ends[1:])]
    whole = (n > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    return vectors.where(whole).select("series_id", "window_id", "x", F.array(*mean).alias("u"))


def near_pairs(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """(series_id, src, dst, distance) of all ``points`` within ``radius`` of each of the ``queries`` (both ``indexed``), themselves left out.

    The first two means make a grid of cells as wide as the radius.  A query looks in
    nine cells; pairs whose means are too far apart go before their distance is taken.
    """
    cell = lambda i: F.floor(F.col("u")[i] / radius)
    around = F.explode(F.array(*[F.struct((cell(0) + i).alias("c0"), (cell(1) + j).alias("c1")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = queries.select("series_id", F.col("window_id").alias("src"), "x", F.col("u").alias("ux"), around.alias("c")).select("series_id", "src", "x", "ux", "c.c0", "c.c1")
    b = points.select("series_id", F.col("window_id").alias("dst"), F.col("x").alias("y"), F.col("u").alias("uy"), cell(0).alias("c0"), cell(1).alias("c1"))
    least = F.aggregate(F.zip_with("ux", "uy", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    met = a.join(b, ["series_id", "c0", "c1"]).where((F.col("src") != F.col("dst")) & (least <= radius * radius * (1 + 1e-9)))
    met = met.where(F.when(F.size("x") != F.size("y"), F.raise_error(F.lit("vectors differ in length")).cast("boolean")).otherwise(True))
    return met.select("series_id", "src", "dst", metric("euclidean")(F.col("x"), F.col("y")).alias("distance")).where(F.col("distance") <= radius)


def indexed_network(vectors: DataFrame, method: str = "knn", k: int = 5, epsilon: float | None = None) -> DataFrame:
    """The ``epsilon`` or ``knn`` network of ``build_network`` over Euclidean distances, without comparing all pairs.

    Nearest neighbours are sought within a radius that starts at a small share of the
    vectors' spread and doubles for those that have not met ``k`` yet.
    """
    points = written(indexed(vectors), "indexed")
    if method == "epsilon":
        if epsilon is None or epsilon <= 0:
            raise ValueError("a positive epsilon is needed")
        near = near_pairs(points, points, float(epsilon)).where((F.col("src") < F.col("dst")) & (F.col("distance") > 0))
        return near.select("series_id", "src", "dst", (1 / (1 + F.col("distance"))).alias("weight"))
    if method != "knn":
        raise ValueError("the index serves epsilon and knn networks")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    n, widest, spread = points.agg(F.count("*"), F.max(norm), F.stddev_pop(F.col("u")[0])).first()
    parts, open_queries = [], points
    radius = max(spread or 0.0, 1e-6 * (widest or 0.0)) / max(1.0, (n or 1) ** 0.5) * 4
    while radius and not open_queries.isEmpty():
        near = near_pairs(points, open_queries, radius).where("distance > 0")
        best = near.withColumn("r", F.row_number().over(Window.partitionBy("series_id", "src").orderBy("distance", "dst"))).where(F.col("r") <= k)
        met = written(best.drop("r"), "near")
        enough = met.groupBy("series_id", F.col("src").alias("window_id")).agg(F.count("*").alias("n")).where(F.col("n") >= k)
        last = radius > 2 * widest  # then everything has been met
        parts.append(met if last else met.join(enough.select("series_id", F.col("window_id").alias("src")), ["series_id", "src"], "left_semi"))
        if last:
            break
        open_queries = written(open_queries.join(enough, ["series_id", "window_id"], "left_anti"), "open")
        radius *= 2
    if not parts:
        return build_network(pairwise(points.limit(0)), "knn", k)
    return _nearest_union(reduce(DataFrame.unionByName, parts), k)


def recommend(edges: DataFrame, long: bool = False) -> DataFrame:
    """(series_id, method, alternative, value) by the largest distance: k, percentile or quartile threshold."""
    some = _usable(edges)
    s = some.groupBy("series_id").agg(F.max("distance").alias("m")).join(quantile_rows(some, "distance", [0.25], long).select("series_id", F.col("q")[0].alias("q")), "series_id")
    m = F.col("m")
    return s.select("series_id", F.lit("full").alias("method"), F.when(m > 1000, "knn").when(m > 100, "percentile").otherwise("threshold").alias("alternative"), F.when(m > 1000, 5.0).when(m > 100, 0.2).otherwise(F.col("q")).alias("value"))


def auto_network(edges: DataFrame, select: bool = True) -> DataFrame:
    """The network that ``recommend`` suggests for each series; without ``select`` the full one."""
    if not select:
        return build_network(edges, "full")
    advice = recommend(edges).select("series_id", F.col("alternative").alias("_method"))
    chosen = edges.join(advice, "series_id")
    own = lambda m: chosen.where(F.col("_method") == m).drop("_method")
    return build_network(own("knn"), "knn", k=5).unionByName(build_network(own("percentile"), "percentile", percentile=0.2)).unionByName(build_network(own("threshold"), "threshold"))


def network_stats(nodes: DataFrame, network: DataFrame) -> DataFrame:
    """One row a series: nodes, edges, density, components and whether there is only one."""
    counts = nodes.groupBy("series_id").agg(F.count("*").alias("n_nodes")).join(network.groupBy("series_id").agg(F.count("*").alias("n_edges")), "series_id", "left")
    groups = components(nodes, network).groupBy("series_id").agg(F.count_distinct("component").alias("n_components"))
    n, e = F.col("n_nodes"), F.coalesce("n_edges", F.lit(0))
    return counts.join(groups, "series_id").select("series_id", n, e.cast("long").alias("n_edges"), F.when(n > 1, 2 * e / (n * (n - 1))).alias("density"), "n_components", (F.col("n_components") == 1).alias("connected"))


def components(nodes: DataFrame, network: DataFrame) -> DataFrame:
    """(series_id, window_id, component): the smallest node reachable, by spreading least labels.

    Each round ends in a written table; rounds go on until no label changes.
    """
    links = written(mirrored(network.select("series_id", "src", "dst")), "links")
    labels = written(nodes.select("series_id", "window_id", F.col("window_id").alias("component")), "labels")
    while True:
        heard = links.join(labels.withColumnRenamed("window_id", "src"), ["series_id", "src"]).groupBy("series_id", F.col("dst").alias("window_id")).agg(F.min("component").alias("c"))
        spread = labels.join(heard, ["series_id", "window_id"], "left").withColumn("component", F.least("component", F.coalesce("c", "component"))).drop("c")
        # Then each label takes its own node's label: paths halve.
        roots = spread.select("series_id", F.col("window_id").alias("component"), F.col("component").alias("root"))
        jumped = written(spread.join(roots, ["series_id", "component"], "left").select("series_id", "window_id", F.coalesce("root", "component").alias("component")), "labels")
        if jumped.withColumnRenamed("component", "new").join(labels, ["series_id", "window_id"]).where("new <> component").isEmpty():
            return jumped
        labels = jumped


def cross_correlation(a: DataFrame, b: DataFrame, max_lag: int | None = None, pick: str = "max_abs") -> DataFrame:
    """(series_id, lag, ccf): the chosen (first of ties), or with ``pick`` "all" every, cross-correlation of two series.

    Lags run to floor(10 log10 n); a positive lag pairs a at t + lag with b at t.
    """
    joined = a.select("series_id", "t", F.col("value").alias("x")).join(b.select("series_id", "t", F.col("value").alias("y")), ["series_id", "t"])
    stats = joined.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    most = F.floor(10 * F.log10("n")).cast("int") if max_lag is None else F.lit(max_lag)
    lags = stats.withColumn("lag", F.explode(F.sequence(-most, most)))
    left = joined.select("series_id", "t", "x").join(lags, "series_id").withColumn("u", F.col("t") - F.col("lag"))
    right = joined.select("series_id", F.col("t").alias("u"), "y")
    product = (F.col("x") - F.col("mx")) * (F.col("y") - F.col("my")) / (F.col("n") * F.col("sx") * F.col("sy"))
    out = left.join(right, ["series_id", "u"]).groupBy("series_id", "lag").agg(F.sum(product).alias("ccf"))
    if pick == "all":
        return out
    size = {"max_abs": F.abs("ccf"), "max_positive": F.col("ccf"), "min_negative": -F.col("ccf")}[pick]
    order = Window.partitionBy("series_id").orderBy(F.desc(F.round(size, 12)), "lag")
    return out.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def mutual_information(pairs: DataFrame) -> DataFrame:
    """(series_id, nmi, voi) of two discrete columns (series_id, a, b): I / max(Ha, Hb), and 1 - I / Hab."""
    joint = pairs.where("a IS NOT NULL AND b IS NOT NULL").groupBy("series_id", "a", "b").agg(F.count("*").alias("n"))
    by = lambda *c: Window.partitionBy("series_id", *c)
    p = joint.withColumns({"p": F.col("n") / F.sum("n").over(by()), "pa": F.sum("n").over(by("a")) / F.sum("n").over(by()), "pb": F.sum("n").over(by("b")) / F.sum("n").over(by())})
    sums = p.groupBy("series_id").agg(
        F.sum(F.col("p") * F.log(F.col("p") / (F.col("pa") * F.col("pb")))).alias("i"), (-F.sum(F.col("p") * F.log("p"))).alias("hab"),
        (-F.sum(F.col("p") * F.log("pa"))).alias("ha"), (-F.sum(F.col("p") * F.log("pb"))).alias("hb"),
    )
    top = F.greatest("ha", "hb")
    return sums.select("series_id", F.when(top > 0, F.col("i") / top).otherwise(1.0).alias("nmi"), F.when(F.col("hab") > 0, 1 - F.col("i") / F.col("hab")).otherwise(0.0).alias("voi"))


def event_synchronisation(a: DataFrame, b: DataFrame, tau: float) -> DataFrame:
    """(series_id, es): the mean, over both directions, of the share of events (series_id, at) with a partner within ``tau``.

    Time is cut into blocks, each of which also gets the events just outside it: within
    one, the nearest partners are running maxima in order of time, and no two tables are joined.
    """
    return _synchronous(_sided(a, b), tau, ["series_id"])


BLOCK_OF_TAUS = 256


def _sided(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("of_a", F.lit(True)).unionByName(b.withColumn("of_a", F.lit(False)))


def _synchronous(events: DataFrame, tau: float, keys: list[str]) -> DataFrame:
    """(keys, es) of events (keys, at, of_a) where both sides have some."""
    size, reach = BLOCK_OF_TAUS * tau, 2 * tau
    spread = F.sequence(F.floor((F.col("at") - reach) / size), F.floor((F.col("at") + reach) / size))
    dealt = events.select(*keys, "at", "of_a", F.explode_outer(spread).alias("block"))
    by = Window.partitionBy(*keys, "block")
    # Events of the same moment see each other in both orders.
    up, down = by.orderBy("at").rangeBetween(Window.unboundedPreceding, 0), by.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    side = lambda which: F.when(F.col("of_a") == which, F.col("at"))
    met = dealt.withColumns({"a0": F.max(side(True)).over(up), "b0": F.max(side(False)).over(up)}).withColumns({"a1": F.min(side(True)).over(down), "b1": F.min(side(False)).over(down)})
    near = lambda c: F.coalesce(F.abs(F.col("at") - F.col(c)) <= tau, F.lit(False))
    hit = F.when(F.col("of_a"), near("b0") | near("b1")).otherwise(near("a0") | near("a1"))
    own = met.where(F.col("block").eqNullSafe(F.floor(F.col("at") / size)))
    count = lambda which, c: F.sum(F.when(which, c).otherwise(0))
    of_a, ones = F.col("of_a"), F.lit(1)
    sums = own.groupBy(*keys).agg(*[count(w, c).alias(n) for n, w, c in (("na", of_a, ones), ("nb", ~of_a, ones), ("ha", of_a, hit.cast("int")), ("hb", ~of_a, hit.cast("int")))])
    return sums.where("na > 0 AND nb > 0").select(*keys, ((F.col("ha") / F.col("na") + F.col("hb") / F.col("nb")) / 2).alias("es"))


def jittered(events: DataFrame, reach: float, surrogates: int, length: float | None = None) -> DataFrame:
    """``events`` (series_id, at) moved by up to ``reach`` either way, once for each of ``surrogates``; clamped to 0..length if given.

    Moves come from a sequence that fills the square of events and surrogates evenly, so
    they are the same at every run.
    """
    numbered = events.withColumn("_k", F.row_number().over(Window.partitionBy("series_id").orderBy("at")))
    many = numbered.withColumn("surrogate", F.explode(F.sequence(F.lit(1), F.lit(surrogates))))
    at = F.col("_k") * 0.7548776662466927 + F.col("surrogate") * 0.5698402909980532
    moved = F.col("at") + ((at - F.floor(at)) * 2 - 1) * reach
    moved = moved if length is None else F.greatest(F.lit(0.0), F.least(F.lit(float(length)), moved))
    return many.select("series_id", "surrogate", moved.alias("at"))


def _with_copies(a: DataFrame, b: DataFrame, reach: float, surrogates: int) -> DataFrame:
    """Events (series_id, surrogate, at, of_a): both trains as surrogate 0, and each jittered copy of ``a`` with ``b``."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(surrogates)))  # a row a surrogate: a documented number
    own = a.select("series_id", F.lit(0).alias("surrogate"), "at")
    return _sided(own.unionByName(jittered(a, reach, surrogates)), b.select("series_id", numbers.alias("surrogate"), "at"))


def _share_of_copies(found: DataFrame, value: str, digits: int, extreme: Callable[[Column, Column], Column]) -> DataFrame:
    """(series_id, ``value``, p_value): the value of surrogate 0 and the share of the others that are as extreme."""
    seen = found.groupBy("series_id").agg(F.max(F.when(F.col("surrogate") == 0, F.col(value))).alias(value), F.collect_list(F.when(F.col("surrogate") > 0, F.round(value, digits))).alias("_copies"))
    as_extreme = F.size(F.filter("_copies", lambda c: extreme(c, F.round(value, digits))))
    return seen.where(F.col(value).isNotNull() & (F.size("_copies") > 0)).select("series_id", value, (as_extreme / F.size("_copies")).alias("p_value"))


def synchronisation_significance(a: DataFrame, b: DataFrame, tau: float, surrogates: int = 100, reach: float | None = None) -> DataFrame:
    """(series_id, es, p_value): the share of jittered copies of ``a`` that are at least as synchronous with ``b``."""
    events = _with_copies(a, b, 5 * tau if reach is None else reach, surrogates)
    found = _synchronous(events, tau, ["series_id", "surrogate"])
    return _share_of_copies(found, "es", 12, lambda copy, own: copy >= own)


def maximal_information(a: DataFrame, b: DataFrame, power: float = 0.6) -> DataFrame:
    """(series_id, mic): the largest normalised mutual information over grids of at most n ** ``power`` cells.

    An approximation: both axes are cut at equal frequencies (equal values share a cell).
    Null below four common values.
    """
    both = a.select("series_id", "t", F.col("value").alias("x")).join(b.select("series_id", "t", F.col("value").alias("y")), ["series_id", "t"]).where("x IS NOT NULL AND y IS NOT NULL")
    whole = Window.partitionBy("series_id")
    ranked = both.select("series_id", (F.rank().over(whole.orderBy("x")) - 1).alias("rx"), (F.rank().over(whole.orderBy("y")) - 1).alias("ry"), F.count("*").over(whole).alias("n"))
    cells = F.greatest(F.lit(4), F.floor(F.pow(F.col("n").cast("double"), F.lit(power))).cast("int"))
    sized = ranked.where("n >= 4").withColumn("p", F.explode(F.sequence(F.lit(2), F.floor(cells / 2).cast("int"))))
    sized = sized.withColumn("q", F.explode(F.sequence(F.lit(2), F.floor(cells / F.col("p")).cast("int"))))
    placed = sized.select("series_id", "n", "p", "q", F.floor(F.col("rx") * F.col("p") / F.col("n")).alias("u"), F.floor(F.col("ry") * F.col("q") / F.col("n")).alias("v"))
    joint = placed.groupBy("series_id", "n", "p", "q", "u", "v").agg(F.count("*").alias("c"))
    part = joint.withColumns({"cu": F.sum("c").over(Window.partitionBy("series_id", "p", "q", "u")), "cv": F.sum("c").over(Window.partitionBy("series_id", "p", "q", "v"))})
    term = F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cu") * F.col("cv")))
    of_grid = part.groupBy("series_id", "p", "q").agg((F.sum(term) / F.log(F.least("p", "q").cast("double"))).alias("i"))
    return of_grid.groupBy("series_id").agg(F.max("i").alias("mic"))


def van_rossum(a: DataFrame, b: DataFrame, tau: float) -> DataFrame:
    """(series_id, distance) of two spike trains (series_id, at), filtered by exp(-t/tau) on a grid of tau/10 to 5 tau past the last.

    Time is cut into blocks of 20 tau: within one a running sum of growing exponentials
    gives the filter, and of earlier ones the three before still count (exp(-60) is
    nothing in a double).  Between two events the filter only decays, so its squares on the
    grid points there are a geometric series: no grid point is a row, and the work is in
    proportion to events.
    """
    both = _sided(a, b)
    return _filtered_distance(both, _span(both, tau), tau, ["series_id"])


def _span(events: DataFrame, tau: float) -> DataFrame:
    return events.groupBy("series_id").agg(F.min("at").alias("lo"), (F.max("at") + 5 * tau).alias("hi"))


def _filtered_distance(both: DataFrame, ends: DataFrame, tau: float, keys: list[str]) -> DataFrame:
    """(keys, distance) of events (keys, at, of_a) on their series' grid from lo to hi; events before lo have their tails there."""
    dt, wide = tau / 10, 20
    rows = both.join(ends, "series_id").withColumn("block", F.floor((F.col("at") - F.col("lo")) / (wide * tau)))
    rows = rows.select(*keys, "lo", "hi", "block", "at", F.when(F.col("of_a"), 1.0).otherwise(-1.0).alias("s"), ((F.col("at") - F.col("lo")) / tau - F.col("block") * wide).alias("rel"))
    totals = rows.groupBy(*keys, "lo", "hi", "block").agg(F.sum(F.col("s") * F.exp("rel")).alias("total"))
    later = totals.withColumn("d", F.explode(F.array(*[F.lit(d) for d in (1, 2, 3)]))).withColumn("block", F.col("block") + F.col("d"))
    carried = later.groupBy(*keys, "lo", "hi", "block").agg(F.sum(F.col("total") * F.exp(-wide * F.col("d").cast("double"))).alias("s"))
    # What earlier blocks leave is an event at the block's start.
    start = lambda block: F.col("lo") + block * (wide * tau)
    rows = rows.unionByName(carried.withColumns({"at": start(F.col("block")), "rel": F.lit(0.0)}))
    last = F.floor((F.col("hi") - F.col("lo")) / dt)

    def first_point(at: Column) -> Column:
        """The first grid point that is not before ``at``; one past the last, if all are."""
        near = F.ceil((at - F.col("lo")) / dt)
        point = lambda g: F.col("lo") + g * dt
        exact = F.when(point(near - 1) >= at, near - 1).when(point(near) < at, near + 1).otherwise(near)
        return F.greatest(F.lit(0), F.least(last + 1, exact))

    order = Window.partitionBy(*keys, "block").orderBy("at")
    seen = rows.withColumns({
        "own": F.sum(F.col("s") * F.exp("rel")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "from": first_point(F.col("at")), "to": first_point(F.coalesce(F.lead("at").over(order), start(F.col("block") + 1))),
    })
    f = F.col("own") * F.exp(F.col("block") * wide - F.col("from") * dt / tau)
    points, fall = F.col("to") - F.col("from"), -2 * dt / tau
    squares = F.when(points > 0, f * f * F.expm1(points * fall) / F.expm1(F.lit(fall))).otherwise(0.0)
    return seen.groupBy(*keys).agg(F.sqrt(F.sum(squares) * dt / tau).alias("distance"))


def van_rossum_significance(a: DataFrame, b: DataFrame, tau: float, surrogates: int = 100, reach: float | None = None) -> DataFrame:
    """(series_id, distance, p_value): the share of jittered copies of ``a`` that are at most as far from ``b``.

    Copies are moved by up to ``reach`` (default 5 tau) and filtered on the grid of the
    two trains themselves.
    """
    events = _with_copies(a, b, 5 * tau if reach is None else reach, surrogates)
    found = _filtered_distance(events, _span(_sided(a, b), tau), tau, ["series_id", "surrogate"])
    return _share_of_copies(found, "distance", 9, lambda copy, own: copy <= own)
