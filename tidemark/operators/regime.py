"""Regime detection: change detectors, ensembles, regime numbers, stability and trend patterns.

Every detector is a set of window expressions over one partitioning (series_id) and
order (t); a query with all of them sorts each series once.  With ``block`` a long series
is cut into ranges (see ``sources.ranges``) and no task holds it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ranges import Whole, scope
from ..sources.series import filled
from ..sources.tables import written
from .earlier import last_near

METHODS = ("cumulative_peaks", "changepoint", "threshold", "variance_shift", "gradient", "entropy")


@dataclass(frozen=True)
class Parameters:
    """Detector settings for a sensitivity of low, medium or high."""

    window: int
    p: float
    variance_ratio: float
    gradient: float
    votes: float

    @classmethod
    def of(cls, sensitivity: str = "medium", window: int = 10) -> Parameters:
        # Fixed values: (window, p, variance ratio over 1, gradient) factors and the ensemble's share of votes.
        factors = {"high": (0.7, 0.6, 0.6, 0.7, 0.15), "medium": (1, 1, 1, 1, 0.3), "low": (1.3, 1.4, 1.4, 1.3, 0.5)}
        if sensitivity not in factors:
            raise ValueError(f"unknown sensitivity {sensitivity}")
        w, p, ratio, gradient, votes = factors[sensitivity]
        size = max(5 if sensitivity == "low" else 3, math.floor(max(3, math.floor(window)) * w + 1e-9))
        return cls(size + (size % 2 == 0), 0.05 * p, 1 + ratio, 0.1 * gradient, votes)


def _by() -> Window:
    return Window.partitionBy("series_id").orderBy("t")


def _gap_filtered(within: Whole, df: DataFrame, flags: dict[str, str], least: str) -> DataFrame:
    """Adds each flag's kept ones: a candidate stays unless the candidate before it, kept or not, is nearer than ``least`` rows."""
    df = within.before(df, {f"_at_{kept}": F.when(F.col(flag), F.col("_i")) for kept, flag in flags.items()})
    far = lambda kept: F.coalesce(F.col("_i") - F.col(f"_at_{kept}") >= F.col(least), F.lit(True))
    return df.withColumns({kept: F.col(flag) & far(kept) for kept, flag in flags.items()}).drop(*[f"_at_{kept}" for kept in flags])


def _with_regime_ids(within: Whole, df: DataFrame, flag: str, name: str) -> DataFrame:
    """Adds one more than the changes so far; the first row never counts."""
    counted = F.when(F.col(flag) & (F.col("_i") > 1), 1).otherwise(0)
    df = within.before(df, {"_so_far": counted}, "sum")
    return df.withColumn(name, (1 + F.coalesce("_so_far", F.lit(0)) + counted).cast("long")).drop("_so_far")


def _prepared(within: Whole, rows: DataFrame, p: Parameters, min_size: int | None, used: tuple[str, ...]) -> DataFrame:
    """Numbered rows with what the detectors in use compare; quantiles only for those that need them."""
    by, h = within.by(), p.window // 2
    left, right = by.rowsBetween(-p.window, -1), by.rowsBetween(1, p.window)
    x = F.col("value")
    label = lambda v: F.when(v >= F.col("_q")[1], 3).when(v <= F.col("_q")[0], 1).otherwise(2)
    out = within.totals(rows.select(*within.part, "t", "_i", "value"), {"_n": F.count("*")})
    if "threshold" in used:
        out = within.quantiles(out, "_q", "value", [0.25, 0.75])
    out = within.framed(out, p.window + 1, p.window + 1).withColumns({
        "_lag": F.lag("value").over(by), "_lead": F.lead("value").over(by),
        "_m0": F.avg(x).over(left), "_m1": F.avg(x).over(right),
        "_s0": F.var_samp(x).over(left), "_s1": F.var_samp(x).over(right),
        "_rv": F.var_samp(x).over(by.rowsBetween(-h, h)),
    })
    out = within.own(out.withColumn("_rd", F.abs(F.col("_rv") - F.lag("_rv").over(by))), keep="entropy" in used)
    if "entropy" in used:
        out = within.quantiles(out, "_rq", "_rd", [0.9]).withColumn("_rq", F.col("_rq")[0])
    if "threshold" in used:
        out = out.withColumns({"_label": label(x), "_label0": F.when(F.col("_i") > 1, label(F.col("_lag")))})
    least = F.lit(min_size) if min_size is not None else F.greatest(F.lit(10), F.floor(F.col("_n") * 0.1))
    return out.withColumn("_least", least)


def _raw(p: Parameters) -> dict[str, Column]:
    x, i, n, w = F.col("value"), F.col("_i"), F.col("_n"), p.window
    inside = (n >= 2 * w) & (i > w) & (i <= n - w)
    spread = F.sqrt((F.col("_s0") + F.col("_s1")) / 2)
    # A two-sided normal test at level p.
    z = F.try_divide(F.abs(F.col("_m0") - F.col("_m1")), spread * math.sqrt(2 / w))
    ratio = F.try_divide(F.greatest("_s0", "_s1"), F.least("_s0", "_s1"))
    bend = F.abs(F.col("_lead") - 2 * x + F.col("_lag"))
    return {
        "cumulative_peaks": (n >= w) & (x > F.col("_lag")) & (x > F.col("_lead")),
        "changepoint": inside & (spread > 1e-9) & (z > NormalDist().inv_cdf(1 - p.p / 2)),
        "threshold": F.col("_label") != F.col("_label0"),
        "variance_shift": inside & (F.col("_s0") > 1e-9) & (F.col("_s1") > 1e-9) & (ratio > p.variance_ratio),
        "gradient": (n >= 2 * w) & (bend > p.gradient),
        "entropy": (n >= w) & (F.col("_rd") > F.col("_rq")),
    }


def _magnitudes() -> dict[str, Column]:
    """Magnitude of each detector: at its final changes, or at all raw ones (marked _r)."""
    x = F.col("value")
    step = F.abs(x - F.coalesce("_lag", F.lit(0.0)))
    first_rv = F.when(F.col("_i") == 1, F.abs("_rv")).otherwise(F.col("_rd"))
    at = lambda m, c: F.when(F.col(m), c).otherwise(0.0)
    ratio = F.try_divide(F.greatest("_s0", "_s1"), F.least("_s0", "_s1"))
    fine = (F.col("_n") >= 2 * F.col("_w")) & (F.col("_i") > F.col("_w")) & (F.col("_i") <= F.col("_n") - F.col("_w")) & (F.col("_s0") > 1e-9) & (F.col("_s1") > 1e-9)
    return {
        "cumulative_peaks": at("_c_cumulative_peaks", step),
        "changepoint": at("_r_changepoint", F.abs(F.col("_m0") - F.col("_m1"))),
        "threshold": at("_c_threshold", step),
        "variance_shift": F.when(fine, ratio - 1).otherwise(0.0),
        "gradient": at("_r_gradient", F.abs(F.col("_lead") - 2 * x + F.col("_lag"))),
        "entropy": at("_c_entropy", first_rv),
    }


# Change type and confidence at a change, and elsewhere.
_NAMES = {
    "cumulative_peaks": ("peak_detected", 0.5, 0.5),
    "changepoint": ("changepoint", 0.7, 0.0),
    "threshold": ("threshold_change", 0.7, 0.7),
    "variance_shift": ("variance_shift", 0.6, 0.0),
    "gradient": ("gradient_change", 0.6, 0.0),
    "entropy": ("entropy_change", 0.5, 0.0),
}


# Change type of every row of a series below the detector's least length, in windows.
_SHORT = {
    "cumulative_peaks": ("peaks_insufficient_data", 1),
    "changepoint": ("cp_insufficient_data", 2),
    "variance_shift": ("var_insufficient_data", 2),
    "gradient": ("grad_insufficient_data", 2),
    "entropy": ("ent_insufficient_data", 1),
}


def detect_changes(series: DataFrame, method: str = "smart", sensitivity: str = "medium", window: int = 10, min_size: int | None = None, block: int | None = None) -> DataFrame:
    """(series_id, t, complexity, regime_change, regime_id, change_type, change_magnitude, confidence, min_size).

    ``method`` is one of METHODS, ``smart`` (gradient, peaks or changepoint) or ``all``
    (votes of the six).  ``min_size`` defaults to a tenth of the series, 10 at least.
    Nulls should be filled before.  ``block`` cuts series into ranges of so many rows.
    """
    within = scope(block)
    out = _detected(within, within.rows(series), method, sensitivity, window, min_size)
    return out.select("series_id", "t", "complexity", "regime_change", "regime_id", "change_type", "change_magnitude", "confidence", "min_size")


def _detected(within: Whole, rows: DataFrame, method: str, sensitivity: str, window: int, min_size: int | None) -> DataFrame:
    """The columns of ``detect_changes`` for numbered rows, and those that the scope's blocks are known by."""
    p = Parameters.of(sensitivity, window)
    if method not in (*METHODS, "smart", "all"):
        raise ValueError(f"unknown method {method}")
    used = {"smart": ("gradient", "cumulative_peaks", "changepoint"), "all": METHODS}.get(method, (method,))
    raw, out = _raw(p), _prepared(within, rows, p, min_size, used).withColumn("_w", F.lit(p.window))
    out = out.withColumns({f"_r_{m}": F.coalesce(raw[m], F.lit(False)) for m in used})
    out = _gap_filtered(within, out, {f"_c_{m}": f"_r_{m}" for m in used}, "_least")
    magnitude = _magnitudes()
    if method in METHODS:
        name, at, elsewhere = _NAMES[method]
        change = F.col(f"_c_{method}")
        kind, size, sure = F.when(change, name).otherwise("none"), magnitude[method], F.when(change, at).otherwise(elsewhere)
        if method in _SHORT:
            label, least = _SHORT[method]
            short = F.col("_n") < least * p.window
            kind, size, sure = F.when(short, label).otherwise(kind), F.when(short, 0.0).otherwise(size), F.when(short, 0.0).otherwise(sure)
        out = out.withColumn("_change", change)
    else:
        flags = [F.col(f"_c_{m}").cast("int") for m in used]
        votes = sum(flags[1:], flags[0])
        need = 1 if method == "smart" else max(1, math.floor(p.votes * len(used)))
        out = out.withColumn("_votes", votes).withColumn("_any", F.col("_votes") >= need)
        change = F.col("_change")
        if method == "smart":
            short = {"gradient": "gradient", "cumulative_peaks": "peaks", "changepoint": "changepoint"}
            fired = F.array_join(F.array(*[F.when(F.col(f"_c_{m}"), short[m]) for m in used]), "+")
            mean = lambda of: sum((F.when(F.col(f"_c_{m}"), of(m)).otherwise(0.0) for m in used), F.lit(0.0)) / F.when(F.col("_any"), F.col("_votes"))
            at_change = {"_kind": F.concat(F.lit("smart_"), fired), "_size": mean(lambda m: magnitude[m]), "_sure": mean(lambda m: F.lit(_NAMES[m][1]))}
            size, sure = (F.when(change, F.col(c)).otherwise(0.0) for c in ("_size", "_sure"))
        else:
            share = F.col("_votes") / len(used)
            at_change = {"_kind": F.concat(F.lit("ensemble_vote_"), F.bround(share * 100).cast("int"), F.lit("%")), "_share": share}
            size = sure = F.col("_share")
        kind = F.when(change, F.col("_kind")).otherwise("none")
        # What frames left is of no use any more, and need not be written with the rows.
        out = out.select(*within.part, "t", "_i", "value", "_least", "_any", *[c.alias(k) for k, c in at_change.items()])
        out = _gap_filtered(within, out, {"_change": "_any"}, "_least")
    return _with_regime_ids(within, out, "_change", "_id").select(
        *within.part, "t", "_i", F.col("value").alias("complexity"), F.col("_change").alias("regime_change"), F.col("_id").alias("regime_id"),
        kind.alias("change_type"), F.coalesce(size, F.lit(0.0)).alias("change_magnitude"), sure.cast("double").alias("confidence"), F.col("_least").cast("long").alias("min_size"),
    )


def consolidate(found: DataFrame, similarity: float = 0.6, within: Whole | None = None) -> DataFrame:
    """Regimes whose means are within ``similarity`` of an earlier one take its number (the last such one's).

    Numbers are dense in order of appearance, changes and numbers are found anew.  No two
    regimes are paired (see ``last_near``); a series' regimes, not its rows, meet in one sort.
    """
    within = within or Whole()
    keys = ["series_id", "regime_id"]
    means = written(found.groupBy(*keys).agg(F.avg("complexity").alias("m"), F.min("t").alias("t0")), "regimes")
    to = last_near(means.select("series_id", F.col("regime_id").alias("i"), "m"), similarity)
    mapped = means.join(to.withColumnRenamed("i", "regime_id"), keys, "left").withColumn("to", F.coalesce("to", "regime_id"))
    mapped = written(mapped.select(*keys, "to", "t0"), "mapped")
    firsts = mapped.groupBy("series_id", "to").agg(F.min("t0").alias("t0"))
    dense = firsts.withColumn("new_id", F.row_number().over(Window.partitionBy("series_id").orderBy("t0")).cast("long"))
    names = mapped.select(*keys, "to").join(dense.select("series_id", "to", "new_id"), ["series_id", "to"])
    out = found if "_i" in found.columns else within.rows(found)
    out = within.brought(out, names.select(*keys, "new_id"), keys)
    out = within.before(out, {"_was": F.col("new_id")}, "last").withColumn("_raw", F.coalesce(F.col("new_id") != F.col("_was"), F.lit(False)))
    out = _gap_filtered(within, out, {"regime_change": "_raw"}, "min_size")
    return _with_regime_ids(within, out, "regime_change", "regime_id").select(*found.columns)


def with_stability(found: DataFrame, within: Whole | None = None) -> DataFrame:
    """Adds stability_score (length over twice the least size, at most 1) and its class."""
    within = within or Whole()
    out = within.totals(within.totals(found, {"_n": F.count("*")}), {"_length": F.count("*")}, ["series_id", "regime_id"])
    return _scored(out, F.col("min_size")).drop("_n", "_length")


def _scored(df: DataFrame, least: Column) -> DataFrame:
    """Adds the stability by a series' length ``_n`` and a regime's ``_length``."""
    n, length = F.col("_n"), F.col("_length")
    score = F.when(n == 1, 0.5).otherwise(F.least(F.lit(1.0), length / (least * 2)))
    kind = F.when((F.col("stability_score") > 0.7) | (n == 1), "Stable").when(F.col("stability_score") > 0.3, "Transitional").otherwise("Unstable")
    return df.withColumn("stability_score", score).withColumn("regime_stability", kind)


def regime_patterns(found: DataFrame, within: Whole | None = None) -> DataFrame:
    """One row a regime: its length, mean, slope and trend pattern."""
    return _patterns(found, within or Whole())


def _patterns(found: DataFrame, within: Whole, **more: Column) -> DataFrame:
    """``regime_patterns``, and more aggregates of the regimes' rows."""
    numbered = found if "_i" in found.columns else within.rows(found)
    keys = ["series_id", "regime_id"]
    placed = within.totals(numbered, {"_i0": F.min("_i")}, keys).withColumn("_p", (F.col("_i") - F.col("_i0") + 1).cast("double"))
    stats = placed.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("end"), F.avg("complexity").alias("mean"),
        F.var_samp("complexity").alias("variance"), F.expr("regr_slope(complexity, _p)").alias("slope"),
        *[c.alias(k) for k, c in more.items()],
    )
    wild = (F.col("mean") > 1e-9) & (F.col("variance") / F.col("mean") > 0.1)
    pattern = (
        F.when((F.col("n") <= 2) | F.col("slope").isNull(), "Stable")
        .when(F.col("slope") > 0.01, "Increasing").when(F.col("slope") < -0.01, "Decreasing").when(wild, "Fluctuating").otherwise("Stable")
    )
    return stats.withColumn("complexity_pattern", pattern)


def regime_name(regime_id: Column, total: Column) -> Column:
    """Pattern A to Z for up to 26 regimes; else a letter, or two beyond 260, and a number from 1 to 10."""
    k = regime_id - 1
    letter = lambda c: F.char(65 + c % 26)
    number = (k % 10 + 1).cast("string")
    one = F.concat(F.lit("Pattern"), letter(F.floor(k / 10)), number)
    two = F.concat(F.lit("Pattern"), letter(F.floor(k / 260)), letter(F.floor(k / 10)), number)
    return F.when(total <= 26, F.concat(F.lit("Pattern "), letter(k))).when(total <= 260, one).otherwise(two)


def detect_regime(series: DataFrame, method: str = "smart", sensitivity: str = "medium", window: int = 10, min_size: int | None = None, consolidate_similar: bool = False, similarity: float = 0.6, block: int | None = None) -> DataFrame:
    """Changes, regime numbers and names, stability and patterns of every row of (series_id, t, value).

    Nulls are filled first (see ``fill_gaps``); a series of one row is one stable regime.
    ``block`` cuts series into ranges of so many rows.
    """
    within = scope(block)
    found = _detected(within, filled(within, within.rows(series)), method, sensitivity, window, min_size)
    if consolidate_similar:
        found = consolidate(found, similarity, within)
    # All but the changes belongs to regimes, of which there are fewer than rows.
    each = _patterns(found, within, _least=F.max("min_size")).select("series_id", "regime_id", F.col("n").alias("_length"), "_least", "complexity_pattern")
    each = _scored(within.among(each, {"_n": F.sum("_length"), "_total": F.max("regime_id")}), F.col("_least"))
    named = each.withColumn("regime_name", regime_name(F.col("regime_id"), F.col("_total")))
    keys = ["series_id", "regime_id"]
    out = within.brought(found, named.select(*keys, "stability_score", "regime_stability", "complexity_pattern", "regime_name"), keys)
    return out.drop("_i", *within.part[1:])
