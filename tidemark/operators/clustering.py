"""Discretisers by clustering: Gaussian mixture, complete linkage, linkage and medoids of windows."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import warped
from ..functions.stats import quantiles
from ..sources.ranges import numbered
from ..sources.tables import written
from .discretize import by_optimal_means, register
from .proximity import components, mirrored, pairwise, windows

SMALL = 50_000
"""Distinct values of a series up to which one task fits its mixture; longer series are fitted by Spark, step by step."""
SHORT, CELLS = 1_000, 10_000
"""Distinct values of a series up to which many series are fitted at once, and how many values that may be together."""
MAX_WINDOWS = 2_000
"""Windows of one series up to which one task links them (it needs their square); longer series are linked by Spark, round by round."""
FEW_WINDOWS, WINDOW_CELLS = 64, 60_000
"""Windows of one series up to which several series are clustered at once, and how many distances that may be together."""
SHORT_ROWS = 512
"""Rows of such a series at most: a worker gets some thousands of them at a time."""
CLOSE = 1e-8
"""A mixture has settled when its mean log likelihood grows by less than this a step; it has an upper bound, so every mixture does."""


def mixture_step(values: np.ndarray, n: np.ndarray, m: np.ndarray, v: np.ndarray, w: np.ndarray, floor: np.ndarray | float, equal: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New means, variances (one for all, if ``equal``) and weights after one step of expectation maximisation, and the old ones' mean log likelihood.

    For one series or, with one more dimension in front, for several.
    """
    of = lambda c: c[..., None, :]
    x = values[..., None]
    logs = of(np.log(w + 1e-300) - np.log(v) / 2) - (x - of(m)) ** 2 / of(2 * v)
    top = logs.max(axis=-1, keepdims=True)
    r = np.exp(logs - top)
    total = r.sum(axis=-1, keepdims=True)
    all_n = n.sum(axis=-1)
    likelihood = (n * (np.log(total[..., 0]) + top[..., 0])).sum(axis=-1) / all_n
    r = r / total * n[..., None]
    s = r.sum(axis=-2)
    some = s > 0
    safe = np.where(some, s, 1)
    mean = np.where(some, (r * x).sum(axis=-2) / safe, m)
    around = np.where(some, (r * (x - of(m)) ** 2).sum(axis=-2) / safe - (mean - m) ** 2, 0)
    if equal:
        around = np.broadcast_to(((s * around).sum(axis=-1) / all_n)[..., None], m.shape)
    return mean, np.maximum(around, np.asarray(floor)[..., None]), s / all_n[..., None], likelihood


def mixture_fits(values: np.ndarray, n: np.ndarray, m: np.ndarray, v: np.ndarray, w: np.ndarray, floor: np.ndarray, equal: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The settled mixtures of several series at once, one a row; rows are filled up with values of count zero, and a settled one leaves."""
    out = tuple(np.empty_like(c) for c in (m, v, w))
    at, before = np.arange(len(m)), np.full(len(m), -np.inf)
    while True:
        *new, likelihood = mixture_step(values, n, m, v, w, floor, equal)
        go = likelihood - before >= CLOSE
        for o, c in zip(out, (m, v, w)):
            o[at[~go]] = c[~go]
        if not go.any():
            return out
        m, v, w, before = *new, likelihood
        if not go.all():
            at, values, n, m, v, w, floor, before = (c[go] for c in (at, values, n, m, v, w, floor, before))


def _settled(points: DataFrame, first: DataFrame, k: int, equal: bool) -> DataFrame:
    """(series_id, m, v, w) of the settled mixtures of (series_id, value, n) that begin as ``first`` says."""

    def fitted(names: list[str], values: list[np.ndarray], counts: list[np.ndarray], start: list[np.ndarray], floor: np.ndarray) -> pd.DataFrame:
        wide = max(map(len, values))
        x = np.array([np.pad(p, (0, wide - len(p)), "edge") for p in values])
        n = np.array([np.pad(p, (0, wide - len(p))) for p in counts])
        m, v, w = mixture_fits(x, n, *start, floor, equal)
        return pd.DataFrame({"series_id": names, "m": m.tolist(), "v": v.tolist(), "w": w.tolist()})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[:1]
        pdf = pdf.sort_values("value")
        return fitted(one["series_id"].tolist(), [pdf["value"].to_numpy(float)], [pdf["n"].to_numpy(float)], [np.array(one[c].tolist(), float) for c in "mvw"], one["floor"].to_numpy(float))

    def fit_many(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values("u")
            lo = 0
            while lo < len(pdf):  # neighbours in length together, some CELLS values at a time
                part = pdf.iloc[lo : lo + max(1, CELLS // int(pdf["u"].iloc[lo]))]
                lo += len(part)
                rows = [np.array([(p["value"], p["n"]) for p in rows], float) for rows in part["points"]]
                yield fitted(part["series_id"].tolist(), [r[:, 0] for r in rows], [r[:, 1] for r in rows], [np.array(part[c].tolist(), float) for c in "mvw"], part["floor"].to_numpy(float))

    shape = "series_id string, m array<double>, v array<double>, w array<double>"
    short = points.join(first.where(F.col("u") <= SHORT).select("series_id"), "series_id", "left_semi").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("points"))
    done = [short.join(first, "series_id").mapInPandas(fit_many, shape)]
    done.append(points.join(first.where((F.col("u") > SHORT) & (F.col("u") <= SMALL)), "series_id").groupBy("series_id").applyInPandas(fit, shape))
    moving = first.where(F.col("u") > SMALL).select("series_id", "floor", "m", "v", "w", F.lit(float("-inf")).alias("before"))
    while not moving.isEmpty():
        rows = _weighed(points.join(moving, "series_id"), k)
        share = lambda j: F.get("_r", F.lit(j)) * F.col("n")
        sums = rows.groupBy("series_id").agg(
            *[F.first(c).alias(c) for c in ("floor", "m", "v", "w", "before")], F.sum("n").alias("all"), F.sum(F.col("n") * (F.log("_s") + F.array_max("_l"))).alias("l"),
            *[F.sum(share(j)).alias(f"s{j}") for j in range(k)], *[F.sum(share(j) * F.col("value")).alias(f"a{j}") for j in range(k)],
            *[F.sum(share(j) * F.pow(F.col("value") - F.get("m", F.lit(j)), 2)).alias(f"b{j}") for j in range(k)],
        )
        mean = [F.coalesce(F.try_divide(F.col(f"a{j}"), F.col(f"s{j}")), F.get("m", F.lit(j))) for j in range(k)]
        around = [F.coalesce(F.try_divide(F.col(f"b{j}"), F.col(f"s{j}")) - F.pow(mean[j] - F.get("m", F.lit(j)), 2), F.lit(0.0)) for j in range(k)]
        if equal:
            around = [reduce(Column.__add__, [F.col(f"s{j}") * a for j, a in enumerate(around)]) / F.col("all")] * k
        gain = F.col("l") / F.col("all") - F.col("before")
        step = written(sums.select(
            "series_id", "floor", "m", "v", "w", ((gain < CLOSE) | F.isnan(gain)).alias("_still"), (F.col("l") / F.col("all")).alias("_l"), F.array(*mean).alias("_m"),
            F.array(*[F.greatest(a, F.col("floor")) for a in around]).alias("_v"), F.array(*[F.col(f"s{j}") / F.col("all") for j in range(k)]).alias("_w"),
        ), "mixture")
        done.append(step.where("_still").select("series_id", "m", "v", "w"))
        moving = step.where("NOT _still").select("series_id", "floor", F.col("_m").alias("m"), F.col("_v").alias("v"), F.col("_w").alias("w"), F.col("_l").alias("before"))
    return written(reduce(DataFrame.unionByName, done), "settled")


def _likeliest() -> Column:
    """The rank by mean of the likeliest component of each weighed value."""
    best = F.get("m", (F.array_position("_r", F.array_max("_r")) - 1).cast("int"))
    return F.when(F.col("m").isNotNull() & F.col("value").isNotNull(), F.size(F.filter("m", lambda m: m < best)) + 1).cast("int")


@register("mixture")
def by_mixture(series: DataFrame, k: int) -> DataFrame:
    """A Gaussian mixture fitted by expectation maximisation until it settles; states ascend with the means.

    Components have variances of their own.  Series in which some component is nowhere
    the likeliest are fitted anew with one variance for all; those in which that leaves
    fewer than ``k`` states too get the clusters of ``kmeans_optimal``.  A series of fewer than
    ``k`` distinct values has null states; so have null and NaN values.

    A series of few distinct values is fitted in one task from its values' counts.  For
    longer ones every step is one grouped aggregation that ends in a written table, which
    settled series leave.
    """
    known = series.where(F.col("value").isNotNull() & ~F.isnan("value"))
    start = known.groupBy("series_id").agg(
        quantiles("value", [(i + 0.5) / k for i in range(k)]).alias("m"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("all_v"), F.count_distinct("value").alias("u")
    )
    spread = F.greatest(F.col("all_v") / (k * k), F.lit(1e-12))
    first = start.where(F.col("u") >= k).select("series_id", "u", (F.col("all_v") * 1e-4 + 1e-12).alias("floor"), "m", F.transform("m", lambda _: spread).alias("v"), F.transform("m", lambda _: F.lit(1.0 / k)).alias("w"))
    left = written(first, "mixture")
    points = written(known.groupBy("series_id", "value").agg(F.count("*").alias("n")), "points")
    done = []
    for equal in (False, True):
        fitted = _settled(points, left, k, equal)
        met = _weighed(points.join(fitted, "series_id"), k)
        full = written(met.groupBy("series_id").agg(F.count_distinct(_likeliest()).alias("states")).where(F.col("states") == k).select("series_id"), "full")
        done.append(fitted.join(full, "series_id", "left_semi"))
        left = written(left.join(full, "series_id", "left_anti"), "mixture")
        if left.isEmpty():
            break
    placed = _weighed(series.join(reduce(DataFrame.unionByName, done), "series_id", "left"), k)
    out = placed.withColumn("state", F.when(~F.isnan("value"), _likeliest())).select(*series.columns, "state")
    if left.isEmpty():
        return out
    others = by_optimal_means(series.join(left.select("series_id"), "series_id", "left_semi"), k)
    return out.join(left.select("series_id"), "series_id", "left_anti").select(*out.columns).unionByName(others.select(*out.columns))


def _weighed(df: DataFrame, k: int) -> DataFrame:
    """Adds the log terms ``_l``, their exponentials' sum ``_s`` and the components' shares ``_r`` of each value."""
    logs = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.log(F.get("w", j) + 1e-300) - F.log(F.get("v", j)) / 2 - F.pow(F.col("value") - F.get("m", j), 2) / (2 * F.get("v", j)))
    df = df.withColumn("_l", logs).withColumn("_e", F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))))
    return df.withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)).withColumn("_r", F.transform("_e", lambda x: x / F.col("_s")))


def neighbour_merges(lo: np.ndarray, hi: np.ndarray, before: float | None = None, after: float | None = None) -> tuple[list[tuple[float, float, float]], list[tuple[float, float]]]:
    """Complete linkage of neighbouring spans: merges (cost, lowest value, highest of the left part), and the spans left.

    In one dimension complete linkage always joins neighbours: a heap of the spans of
    neighbouring clusters is enough (ties to the left).  ``before`` and ``after`` are the
    far ends of the spans outside.  Those can only grow, so a merge dearer than theirs
    would be now has to wait, and with it what is dearer and next to it.
    """
    n = len(lo)
    left, right, alive, waits = np.arange(n) - 1, np.arange(n) + 1, np.ones(n, bool), np.zeros(n, bool)
    lo, hi, version = lo.copy(), hi.copy(), np.zeros(n, int)
    heap = [(hi[i + 1] - lo[i], i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    merges = []
    while heap:
        cost, i, vi, vj = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if not alive[i] or j >= n or version[i] != vi or version[j] != vj:
            continue
        first = waits[left[i]] if left[i] >= 0 else before is not None and cost >= hi[i] - before
        last = waits[j] if right[j] < n else after is not None and cost > after - lo[j]
        if first or last:
            waits[i] = True
            continue
        merges.append((float(cost), float(lo[i]), float(hi[i])))
        hi[i], alive[j], right[i] = hi[j], False, right[j]
        version[i] += 1
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, (hi[right[i]] - lo[i], i, version[i], version[right[i]]))
        if left[i] >= 0:
            heapq.heappush(heap, (hi[i] - lo[left[i]], left[i], version[left[i]], version[i]))
    return merges, [(float(a), float(b)) for a, b in zip(lo[alive], hi[alive])]


@register("hierarchical")
def by_linkage(series: DataFrame, k: int, block: int = 65_536) -> DataFrame:
    """Complete linkage of a series' distinct values, cut at ``k``; states ascend.

    Values are dealt to tasks by blocks of neighbours.  A block merges what no span outside
    can forestall; the spans left are numbered and dealt anew, half a block further in every
    other round, until a series is one span.  The cheapest merge of all never waits, and
    merges never get cheaper, so the clusters are those of one heap, cut by leaving out the
    k - 1 dearest merges; a block hands on no more of them than that.  A series of fewer
    than ``k`` distinct values has null states; so have null and NaN values.
    """
    if block < 4:
        raise ValueError("a block has four spans or more")
    shape = "series_id string, lo double, hi double, cost double"

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo")
        outside = [None if pd.isna(v) else float(v) for v in (pdf["before"].iloc[0], pdf["after"].iloc[-1])]
        merges, spans = neighbour_merges(pdf["lo"].to_numpy(float), pdf["hi"].to_numpy(float), *outside)
        dearest = sorted(merges, key=lambda m: m[:2])[max(0, len(merges) - k + 1) :]
        rows = [(a, b, None) for a, b in spans] + [(a, b, cost) for cost, a, b in dearest]
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], **{c: pd.Series([r[n] for r in rows], dtype=float) for n, c in enumerate(("lo", "hi", "cost"))}})

    known = F.col("value").isNotNull() & ~F.isnan("value")
    distinct = series.where(known).select("series_id", F.col("value").alias("lo")).distinct()
    spans, steps, shift = distinct.withColumn("hi", F.col("lo")), [], 0
    enough = None
    while True:
        placed = numbered(spans, ["series_id"], ["lo"], "_i").withColumn("_block", F.floor((F.col("_i") - 1 + shift) / block))
        if enough is None:
            enough = written(placed.groupBy("series_id").agg(F.max("_i").alias("n")).where(F.col("n") >= k).select("series_id"), "sizes")
        # The span next to a block's end is the neighbouring block's last or first one.
        ends = placed.groupBy("series_id", "_block").agg(F.max_by("lo", "_i").alias("before"), F.min_by("hi", "_i").alias("after"))
        onward = lambda c, by: ends.select("series_id", (F.col("_block") + by).alias("_block"), c)
        dealt = placed.join(onward("before", 1), ["series_id", "_block"], "left").join(onward("after", -1), ["series_id", "_block"], "left")
        step = written(dealt.groupBy("series_id", "_block").applyInPandas(merged, shape), "linkage")
        steps.append(step.where("cost IS NOT NULL"))
        left = step.where("cost IS NULL").select("series_id", "lo", "hi")
        several = left.groupBy("series_id").agg(F.count("*").alias("n")).where("n > 1")
        if several.isEmpty():
            break
        spans, shift = left.join(several.select("series_id"), "series_id", "left_semi"), block // 2 - shift
    dear = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("cost"), F.desc("lo")))
    cut = reduce(DataFrame.unionByName, steps).withColumn("_r", dear).where(F.col("_r") < k)
    cuts = enough.join(cut.groupBy("series_id").agg(F.sort_array(F.collect_list("hi")).alias("cuts")), "series_id", "left")
    cuts = cuts.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    df = series.join(cuts, "series_id", "left")
    state = F.size(F.filter("cuts", lambda c: F.col("value") > c)) + 1
    return df.withColumn("state", F.when(known & F.col("cuts").isNotNull(), state).cast("int")).select(*series.columns, "state")


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers (from 1, by first appearance) of rows by Ward's criterion on Euclidean distances."""
    n = len(x)
    d = np.sqrt(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(axis=2))) if n <= 500 else np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T))
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - k):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        other = alive.copy()
        other[[i, j]] = False
        o = np.flatnonzero(other)
        total = size[i] + size[j] + size[o]
        new = np.sqrt(np.maximum(0, ((size[i] + size[o]) * d[i, o] ** 2 + (size[j] + size[o]) * d[j, o] ** 2 - size[o] * d[i, j] ** 2) / total))
        d[i, o] = d[o, i] = new
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse] + 1


def ward_labels_of_many(x: np.ndarray, k: int) -> np.ndarray:
    """``ward_labels`` of several series of equally many rows, one merge of each at a time."""
    d = np.sqrt(((x[:, :, None] - x[:, None]) ** 2).sum(axis=3))
    m, n = d.shape[:2]
    s, size, label, alive = np.arange(m), np.ones((m, n)), np.tile(np.arange(n), (m, 1)), np.ones((m, n), bool)
    d[:, np.arange(n), np.arange(n)] = np.inf
    for _ in range(n - k):
        one, two = np.divmod(d.reshape(m, -1).argmin(axis=1), n)
        i, j = np.minimum(one, two), np.maximum(one, two)
        alive[s, i] = alive[s, j] = False
        a, b, gap = size[s, i][:, None], size[s, j][:, None], d[s, i, j][:, None]
        far = [np.where(alive, d[s, c], 0.0) for c in (i, j)]
        new = np.sqrt(np.maximum(0, ((a + size) * far[0] ** 2 + (b + size) * far[1] ** 2 - size * gap**2) / (a + b + size)))
        new[~alive] = np.inf
        d[s, i] = d[s, :, i] = new
        d[s, j] = d[s, :, j] = np.inf
        size[s, i] += size[s, j]
        alive[s, i] = True
        label = np.where(label == j[:, None], i[:, None], label)
    # A cluster's label is its first row.
    return np.take_along_axis(np.cumsum(label == np.arange(n), axis=1), label, axis=1)


def ward_rounds(vectors: DataFrame, k: int) -> DataFrame:
    """(series_id, window_id, label) by Ward's criterion for series of any length, by rounds of Spark joins.

    A round merges all pairs of clusters that are each other's nearest (ties to smaller
    ids); Ward's merges are the same in any such order, and never cheaper than those
    below them, so cutting the tree at ``k`` drops the k - 1 dearest merges.  Clusters are
    rows (size, mean) in written tables; a round compares the clusters of a series in
    pairs, each cluster a row.
    """
    spark = vectors.sparkSession
    clusters = written(vectors.select("series_id", F.col("window_id").alias("c"), F.lit(1).cast("long").alias("n"), F.col("x").alias("mean")), "clusters")
    merges, steps = spark.createDataFrame([], "series_id string, a long, b long, cost double"), []
    while True:
        one = clusters.select("series_id", F.col("c").alias("a"), F.col("n").alias("na"), F.col("mean").alias("ma"))
        two = clusters.select("series_id", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("mean").alias("mb"))
        gap = F.aggregate(F.zip_with("ma", "mb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
        cost = gap * (F.col("na") * F.col("nb")) / (F.col("na") + F.col("nb"))  # the same from both sides
        nearest = one.join(two, "series_id").where("a <> b").groupBy("series_id", "a").agg(F.min(F.struct(cost.alias("cost"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))).alias("x"))
        pairs = nearest.groupBy("series_id", "x").agg(F.count("*").alias("both")).where("both = 2").select("series_id", F.col("x.lo").alias("a"), F.col("x.hi").alias("b"), F.col("x.cost").alias("cost"))
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            break
        steps.append(pairs)
        into = pairs.select("series_id", F.col("b").alias("c"), F.col("a").alias("to"))
        moved = clusters.join(into, ["series_id", "c"], "left").withColumn("c", F.coalesce("to", "c"))
        merged = moved.groupBy("series_id", "c").agg(F.sum("n").alias("n_"), F.collect_list(F.struct("n", "mean")).alias("means")).withColumnRenamed("n_", "n")  # one or two rows each
        mean = F.when(F.size("means") == 1, F.col("means")[0]["mean"]).otherwise(
            F.zip_with(F.col("means")[0]["mean"], F.col("means")[1]["mean"], lambda p, q: (p * F.col("means")[0]["n"] + q * F.col("means")[1]["n"]) / F.col("n"))
        )
        clusters = written(merged.select("series_id", "c", "n", mean.alias("mean")), "clusters")
    merges = reduce(DataFrame.unionByName, steps, merges)
    cheap = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("cost"), "a", "b")) >= k
    links = merges.withColumn("keep", cheap).where("keep").select("series_id", F.col("a").alias("src"), F.col("b").alias("dst"))
    found = components(vectors.select("series_id", "window_id"), links)
    first = found.groupBy("series_id", "component").agg(F.min("window_id").alias("first"), F.count("*").alias("size"))
    label = F.row_number().over(Window.partitionBy("series_id").orderBy("first"))
    return found.join(first.withColumn("label", label).drop("first", "size"), ["series_id", "component"]).select("series_id", "window_id", F.col("label").cast("int").alias("label"))


def _most_frequent(series: DataFrame, found: DataFrame) -> DataFrame:
    """``series`` with the most frequent label of the windows that hold each row (ties: the smallest)."""
    votes = found.where("label IS NOT NULL").select("series_id", F.explode(F.sequence("start_t", "end_t")).alias("t"), "label").groupBy("series_id", "t", "label").agg(F.count("*").alias("n"))
    first = Window.partitionBy("series_id", "t").orderBy(F.desc("n"), "label")
    chosen = votes.withColumn("r", F.row_number().over(first)).where("r = 1").select("series_id", "t", F.col("label").alias("state"))
    return series.join(chosen, ["series_id", "t"], "left").select(*series.columns, "state")


def medoid_labels_of_many(x: np.ndarray, k: int) -> np.ndarray:
    """Labels (by the medoids' places) of the windows of several series of equally many, around medoids that have settled."""
    m, n = x.shape[:2]
    one, two = np.triu_indices(n, 1)
    d = np.zeros((m, n, n))
    d[:, one, two] = d[:, two, one] = warped(x[:, one].reshape(-1, x.shape[2]), x[:, two].reshape(-1, x.shape[2])).reshape(m, -1)
    medoid = np.zeros((m, n), bool)
    medoid[:, [int(np.floor((n - 1) * ((j + 0.5) / k))) for j in range(k)]] = True
    at, before, out = np.arange(m), medoid, np.empty((m, n), int)
    while len(at):
        near = np.where(medoid[:, None, :], d, np.inf).argmin(axis=2)
        same = near[:, :, None] == near[:, None, :]
        total = np.round(np.where(same, d, 0.0).sum(axis=2), 9)
        new = np.zeros_like(medoid)
        np.put_along_axis(new, np.where(same, total[:, None, :], np.inf).argmin(axis=2), True, axis=1)
        still = (new == medoid).all(axis=1) | (new == before).all(axis=1)
        out[at[still]] = np.take_along_axis(np.cumsum(medoid, axis=1), near, axis=1)[still]
        at, d, before, medoid = at[~still], d[~still], medoid[~still], new[~still]
    return out


def _most_frequent_of_short(series: DataFrame, k: int, window: int, step: int, labels: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """``series``, all short, with the most frequent label of each row's windows: what ``windows``, ``labels`` and ``_most_frequent`` give.

    A series is a row of arrays, so that neither windows nor votes are rows; a worker
    labels series with equally many windows together.
    """

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("rows")
            n = np.asarray(pc.list_value_length(rows), int)
            t, value = (rows.flatten().field(c) for c in ("t", "value"))
            t, null = np.asarray(t), np.asarray(pc.is_null(value))
            value = np.asarray(pc.fill_null(value.cast(pa.float64()), 0.0))
            own, stop = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n), n)
            # Full windows by their first row: on the grid, or the last one where that leaves rows over.
            first = np.flatnonzero(np.arange(len(t)) + window <= stop)
            end = t[first + window - 1]
            last = (first + window == stop[first]) & (end > window) & ((end - window) % step != 0)
            nulls = np.concatenate([[0], np.cumsum(null)])
            full = (end - t[first] == window - 1) & (nulls[first + window] == nulls[first])
            first = first[full & (last | (t[first] >= 1) & ((t[first] - 1) % step == 0))]
            many = np.bincount(own[first], minlength=len(n))
            begin, label = np.cumsum(many) - many, np.zeros(len(first), int)
            for m in np.unique(many[many >= k]):
                alike, chunk = np.flatnonzero(many == m), max(1, WINDOW_CELLS // int(m) ** 2)
                for lo in range(0, len(alike), chunk):
                    which = begin[alike[lo : lo + chunk], None] + np.arange(m)
                    label[which] = labels(value[first[which][:, :, None] + np.arange(window)], k)
            votes = np.zeros((len(t), k), np.int32)
            first, label = first[label > 0], label[label > 0]
            for i in range(window):
                votes[first + i, label - 1] += 1
            found = pa.array(votes.argmax(axis=1) + 1, pa.int32(), mask=votes.max(axis=1) == 0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, found)], [*batch.schema.names, "states"])

    others = [c for c in series.columns if c not in ("series_id", "t", "value")]
    each = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "value", *others))).alias("rows"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in each.schema) + ", states array<int>"
    one = each.mapInArrow(states, shape).select("series_id", F.explode(F.arrays_zip("rows", "states")).alias("_x"))
    return one.select(*[F.col(c if c == "series_id" else f"_x.rows.{c}").alias(c) for c in series.columns], F.col("_x.states").alias("state"))


def _by_length(series: DataFrame, k: int, window: int, step: int, labels: Callable[[np.ndarray, int], np.ndarray], long: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``series`` with states by ``labels`` of many short series at once, and by ``long`` where a series is not short or has an endless value."""
    if window < 1 or step < 1:
        raise ValueError("size and step are positive")
    most = min(SHORT_ROWS, (FEW_WINDOWS - 2) * step + window)
    odd = F.max(F.isnan("value") | (F.abs("value") == float("inf")))
    rest = written(series.groupBy("series_id").agg(F.count("*").alias("n"), F.coalesce(odd, F.lit(False)).alias("odd")).where((F.col("n") > most) | F.col("odd")).select("series_id"), "rest")
    if rest.isEmpty():
        return _most_frequent_of_short(series, k, window, step, labels)
    short = _most_frequent_of_short(series.join(rest, "series_id", "left_anti").select(*series.columns), k, window, step, labels)
    return short.unionByName(long(series.join(rest, "series_id", "left_semi").select(*series.columns)))


@register("proxy_windowed")
def by_windows(series: DataFrame, k: int, window: int = 10, step: int = 1) -> DataFrame:
    """Windows clustered by Ward linkage; a point takes the most frequent label of its windows (ties: the smallest)."""
    return _by_length(series, k, window, step, ward_labels_of_many, lambda s: _by_windows_of_long(s, k, window, step))


def _by_windows_of_long(series: DataFrame, k: int, window: int, step: int) -> DataFrame:
    """``by_windows`` with windows and their labels as rows."""

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("window_id")
        labels = ward_labels(np.array(pdf["x"].tolist(), float), k) if len(pdf) >= k else [None] * len(pdf)
        return pd.DataFrame({"series_id": pdf["series_id"], "window_id": pdf["window_id"], "label": pd.array(labels, "Int32")})

    full = written(windows(series, window, step, tail=True).where(~F.exists("x", lambda v: v.isNull()) & (F.size("x") == window)), "windows")
    sizes = written(full.groupBy("series_id").agg(F.count("*").alias("n")), "sizes")
    one = full.select("series_id", "window_id", "x")
    small = one.join(sizes.where(F.col("n") <= MAX_WINDOWS), "series_id", "left_semi").groupBy("series_id").applyInPandas(cluster, "series_id string, window_id long, label int")
    large = one.join(sizes.where((F.col("n") > MAX_WINDOWS) & (F.col("n") >= k)), "series_id", "left_semi")
    found = small if large.isEmpty() else small.unionByName(ward_rounds(large, k))
    return _most_frequent(series, full.drop("x").join(found, ["series_id", "window_id"]))


@register("dtw")
def by_warping(series: DataFrame, k: int, window: int = 10, step: int | None = None) -> DataFrame:
    """Windows clustered around medoids by warping distance; a point takes the most frequent label of its windows.

    Medoids start evenly spaced in time; windows go to the nearest (ties to the earlier),
    and the member with the least sum of distances becomes the medoid, until none
    changes.  Labels ascend with the medoids' places.  Every pair of a series' windows is
    compared: choose a step that keeps them few.
    """
    step = step or window
    return _by_length(series, k, window, step, medoid_labels_of_many, lambda s: _by_warping_of_long(s, k, window, step))


def _by_warping_of_long(series: DataFrame, k: int, window: int, step: int) -> DataFrame:
    """``by_warping`` with windows, their distances and their medoids as rows."""
    full = written(windows(series, window, step, tail=True).where(~F.exists("x", lambda v: v.isNull())), "windows")
    numbered = full.select("series_id", "window_id", F.row_number().over(Window.partitionBy("series_id").orderBy("window_id")).alias("i"), F.count("*").over(Window.partitionBy("series_id")).alias("n")).where(F.col("n") >= k)
    gaps = written(pairwise(full.select("series_id", "window_id", "x"), "dtw"), "gaps")
    own = full.select("series_id", F.col("window_id").alias("src"), F.col("window_id").alias("dst"), F.lit(0.0).alias("distance"))
    gaps = mirrored(gaps).unionByName(own)
    places = F.array(*[F.floor((F.col("n") - 1) * F.lit((j + 0.5) / k)) + 1 for j in range(k)])
    medoids = written(numbered.where(F.array_contains(places, F.col("i").cast("long"))).select("series_id", F.col("window_id").alias("medoid")), "medoids")
    seen = [medoids]
    while True:
        near = Window.partitionBy("series_id", "src").orderBy("distance", "dst")
        placed = gaps.join(medoids.withColumnRenamed("medoid", "dst"), ["series_id", "dst"]).withColumn("r", F.row_number().over(near)).where("r = 1").select("series_id", "src", F.col("dst").alias("medoid"))
        placed = written(placed, "placed")
        others = placed.select("series_id", F.col("src").alias("dst"), F.col("medoid").alias("m2"))
        within = gaps.join(placed, ["series_id", "src"]).join(others, ["series_id", "dst"]).where("medoid = m2").groupBy("series_id", "medoid", "src").agg(F.sum("distance").alias("total"))
        # Sums are rounded, so that their order of addition decides nothing; costs only fall, so no set of medoids returns.
        new = within.groupBy("series_id", "medoid").agg(F.min(F.struct(F.round("total", 9).alias("total"), "src")).alias("x")).select("series_id", F.col("x.src").alias("medoid"))
        new = written(new, "medoids")
        if any(new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty() for old in seen[-2:]):
            break
        medoids = new
        seen.append(new)
    order = F.dense_rank().over(Window.partitionBy("series_id").orderBy("medoid"))
    names = medoids.distinct().withColumn("label", order.cast("int"))
    found = placed.join(names, ["series_id", "medoid"]).select("series_id", F.col("src").alias("window_id"), "label")
    return _most_frequent(series, full.drop("x").join(found, ["series_id", "window_id"]))
