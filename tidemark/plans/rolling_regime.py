"""Queries of rolling measures and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regime, rolling
from ..sources import ranges
from ..sources import series as src
from .registry import ORACLE_SQL, on_series, q6, query, r6

W = 7

# Rolling measures: x is the list of a full frame, lo and hi the series' range.
ROLL_BASE = f"""WITH s AS ({{s}}), f AS (
    SELECT series_id, t, value, list(value) OVER w AS x, row_number() OVER (PARTITION BY series_id ORDER BY t) AS i,
        min(value) OVER (PARTITION BY series_id) AS lo, max(value) OVER (PARTITION BY series_id) AS hi, var_samp(value) OVER w AS v
    FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)),
g AS (SELECT *, list_sort(x) AS y, len(x) AS m, list_avg(x) AS mean FROM f WHERE i >= {W})"""
FLUCT = "least(1, greatest(0, sqrt(list_avg(list_transform(range(1, m), lambda k: (x[k + 1] - x[k]) * (x[k + 1] - x[k])))) / (hi - lo)))"
DISTR = "least(1, greatest(0, 1 - list_avg(list_transform(range(1, m), lambda k: greatest((hi - lo) / (m - 1) - (y[k + 1] - y[k]), 0) / ((hi - lo) / (m - 1))))))"
ACF1 = """CASE WHEN len(list_distinct(x)) >= 2 THEN list_sum(list_transform(range(1, m), lambda k: (x[k] - mean) * (x[k + 1] - mean)))
    / list_sum(list_transform(x, lambda a: (a - mean) * (a - mean))) END"""
EXPRESSIONS = {
    "max": "y[m]", "min": "y[1]", "variance": "v", "fluctuation": FLUCT, "distribution": DISTR,
    "complexity": f"({FLUCT}) * ({DISTR})", "autocorrelation": ACF1,
}
NAMES = {"max": "roll_max", "min": "roll_min", "variance": "roll_var", "fluctuation": "roll_fluct", "distribution": "roll_distr", "complexity": "roll_complexity", "autocorrelation": "roll_acf1"}

for _measure, _name in NAMES.items():
    on_series(
        _name,
        "s1",
        lambda s, m=_measure: rolling.rolling_measures(s, measures=(m,), width=W).where(F.col(f"value_{m}").isNotNull()).select("series_id", "t", r6(f"value_{m}", "measure", 5)),
        f"{ROLL_BASE} SELECT series_id, t, {q6(EXPRESSIONS[_measure], 'measure', 5)} FROM g WHERE ({EXPRESSIONS[_measure]}) IS NOT NULL",
    )

on_series(
    "roll_all",
    "s1",
    lambda s: rolling.rolling_measures(s, width=W).select("series_id", "t", *[r6(f"value_{m}", m, 5) for m in rolling.MEASURES]),
    f"{ROLL_BASE} SELECT s.series_id, s.t, " + ", ".join(f"e.{m}" for m in rolling.MEASURES) + f""" FROM s LEFT JOIN (SELECT series_id, t, {", ".join(q6(EXPRESSIONS[m], m, 5) for m in rolling.MEASURES)} FROM g) e USING (series_id, t)""",
)

on_series(
    "roll_rescale",
    "s1",
    lambda s: rolling.rolling_measures(s, measures=("complexity",), width=W, rescale=True).where("value_complexity IS NOT NULL").select("series_id", "t", r6("value_complexity", "measure", 5)),
    f"""{ROLL_BASE}, h AS (SELECT series_id, t, lo, hi, {EXPRESSIONS["complexity"]} AS c FROM g),
    k AS (SELECT *, min(c) OVER p AS a, max(c) OVER p AS b FROM h WINDOW p AS (PARTITION BY series_id))
    SELECT series_id, t, {q6("CASE WHEN b - a < 1.5e-8 THEN (lo + hi) / 2 ELSE (c - a) / (b - a) * (hi - lo) + lo END", "measure", 5)} FROM k""",
)

REGION_SQL = """SELECT day, t, max(CASE WHEN r = 'ASIA' THEN v END) AS asia, max(CASE WHEN r = 'EUROPE' THEN v END) AS europe, max(CASE WHEN r = 'AFRICA' THEN v END) AS africa
    FROM (SELECT day, dense_rank() OVER (ORDER BY day) AS t, r, v FROM (
        SELECT cast(o_orderdate AS DATE) AS day, r_name AS r, round(sum(o_totalprice) / 100000, 8) AS v FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2))
    GROUP BY day, t"""


def region_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three regions' daily totals side by side; nulls where a region has no order that day."""
    orders, customer, nation, region = (src.read(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region"))
    named = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)  # 25 rows by definition
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(named), F.col("c_nationkey") == F.col("n_nationkey"))
    daily = joined.groupBy(F.to_date("o_orderdate").alias("day")).pivot("r_name", ["ASIA", "EUROPE", "AFRICA", "AMERICA", "MIDDLE EAST"]).agg(F.round(F.sum("o_totalprice") / 100000, 8))
    numbered = daily.withColumn("series_id", F.lit("regions"))
    return src.add_time(numbered, "series_id", ["day"]).select("series_id", "t", F.col("ASIA").alias("asia"), F.col("EUROPE").alias("europe"), F.col("AFRICA").alias("africa"))


@query(
    "roll_multi_mean_median",
    f"""WITH r AS ({REGION_SQL}), b AS (SELECT min(least(asia, europe, africa)) AS lo, max(greatest(asia, europe, africa)) AS hi FROM r),
    l AS (SELECT 'asia' AS c, t, asia AS value FROM r UNION ALL SELECT 'europe', t, europe FROM r UNION ALL SELECT 'africa', t, africa FROM r),
    f AS (SELECT c, t, list(value) FILTER (value IS NOT NULL) OVER w AS x FROM l WINDOW w AS (PARTITION BY c ORDER BY t ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)),
    g AS (SELECT c, t, CASE WHEN t >= {W} AND len(x) >= 2 THEN sqrt(list_avg(list_transform(range(1, len(x)), lambda k: (x[k + 1] - x[k]) * (x[k + 1] - x[k])))) / (hi - lo) END AS m FROM f, b)
    SELECT t, {q6("avg(m)", "mean_fluctuation")}, {q6("quantile_cont(m, 0.5)", "median_fluctuation")} FROM g GROUP BY t""",
)
def roll_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median over columns of a rolling measure."""
    out = rolling.rolling_measures(region_daily(spark, sf_dir), ["asia", "europe", "africa"], ("fluctuation",), W)
    return out.select("t", r6("mean_fluctuation"), r6("median_fluctuation"))


# Regimes.
# Window, variance ratio, gradient, normal quantile of a two-sided level (0.07, 0.05, 0.03) and votes, by sensitivity.
SETTINGS = {"low": (13, 2.4, 0.13, "1.811910672952597", 3), "medium": (11, 2.0, 0.1, "1.959963984540054", 1), "high": (7, 1.6, 0.07, "2.1700903775845606", 1)}


def regime_base(sensitivity: str) -> str:
    """Common table expressions with every detector's raw candidates."""
    window, ratio, bend, z, _ = SETTINGS[sensitivity]
    return f"""WITH s AS ({{s}}), p0 AS (
    SELECT *, row_number() OVER o AS i, count(*) OVER a AS n, lag(value) OVER o AS lg, lead(value) OVER o AS ld,
        avg(value) OVER l AS m0, avg(value) OVER r AS m1, var_samp(value) OVER l AS s0, var_samp(value) OVER r AS s1, var_samp(value) OVER c AS rv,
        quantile_cont(value, 0.25) OVER a AS q1, quantile_cont(value, 0.75) OVER a AS q3
    FROM s WINDOW o AS (PARTITION BY series_id ORDER BY t), a AS (PARTITION BY series_id),
        l AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING),
        r AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {window} FOLLOWING),
        c AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {window // 2} PRECEDING AND {window // 2} FOLLOWING)),
p1 AS (SELECT *, abs(rv - lag(rv) OVER (PARTITION BY series_id ORDER BY t)) AS rd, greatest(10, CAST(floor(n * 0.1) AS BIGINT)) AS least_n,
    CASE WHEN value >= q3 THEN 3 WHEN value <= q1 THEN 1 ELSE 2 END AS label FROM p0),
p2 AS (SELECT *, quantile_cont(rd, 0.9) OVER (PARTITION BY series_id) AS rq, lag(label) OVER (PARTITION BY series_id ORDER BY t) AS label0,
    n >= {2 * window} AND i > {window} AND i <= n - {window} AS inside FROM p1),
p3 AS (SELECT *, coalesce(n >= {window} AND value > lg AND value > ld, false) AS r_cumulative_peaks,
    coalesce(inside AND sqrt((s0 + s1) / 2) > 1e-9 AND abs(m0 - m1) / (sqrt((s0 + s1) / 2) * sqrt(2.0 / {window})) > {z}, false) AS r_changepoint,
    coalesce(label <> label0, false) AS r_threshold,
    coalesce(inside AND s0 > 1e-9 AND s1 > 1e-9 AND greatest(s0, s1) / least(s0, s1) > {ratio}, false) AS r_variance_shift,
    coalesce(n >= {2 * window} AND abs(ld - 2 * value + lg) > {bend}, false) AS r_gradient,
    coalesce(n >= {window} AND rd > rq, false) AS r_entropy FROM p2)"""


METHODS = regime.METHODS


def _accept(flag: str, out: str, source: str, target: str) -> str:
    """A step that keeps a candidate if the one before it is far enough."""
    return f""", {target} AS (SELECT *, {flag} AND coalesce(i - max(CASE WHEN {flag} THEN i END) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= least_n, true) AS {out} FROM {source})"""


MAGNITUDE = {
    "cumulative_peaks": "CASE WHEN c_cumulative_peaks THEN abs(value - coalesce(lg, 0)) ELSE 0 END",
    "changepoint": "CASE WHEN r_changepoint THEN abs(m0 - m1) ELSE 0 END",
    "threshold": "CASE WHEN c_threshold THEN abs(value - coalesce(lg, 0)) ELSE 0 END",
    "variance_shift": "CASE WHEN inside AND s0 > 1e-9 AND s1 > 1e-9 THEN greatest(s0, s1) / least(s0, s1) - 1 ELSE 0 END",
    "gradient": "CASE WHEN r_gradient THEN abs(ld - 2 * value + lg) ELSE 0 END",
    "entropy": "CASE WHEN c_entropy THEN rd ELSE 0 END",
}
TYPES = {"cumulative_peaks": ("peak_detected", 0.5, 0.5), "changepoint": ("changepoint", 0.7, 0), "threshold": ("threshold_change", 0.7, 0.7), "variance_shift": ("variance_shift", 0.6, 0), "gradient": ("gradient_change", 0.6, 0), "entropy": ("entropy_change", 0.5, 0)}
SHORT_TYPES = {"cumulative_peaks": ("peaks_insufficient_data", 1), "changepoint": ("cp_insufficient_data", 2), "variance_shift": ("var_insufficient_data", 2), "gradient": ("grad_insufficient_data", 2), "entropy": ("ent_insufficient_data", 1)}
IDS = "1 + sum(CASE WHEN chg AND i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t)"
ALL_ACCEPTED = "".join(_accept(f"r_{m}", f"c_{m}", "p3" if k == 0 else f"a{k - 1}", f"a{k}") for k, m in enumerate(METHODS))


def changes_sql(method: str, sensitivity: str = "medium") -> str:
    """Common table expressions that end in ``found``."""
    window, need = SETTINGS[sensitivity][0], SETTINGS[sensitivity][4]
    last = f"a{len(METHODS) - 1}"
    if method in METHODS:
        name, at, other = TYPES[method]
        kind, size, sure = f"CASE WHEN c_{method} THEN '{name}' ELSE 'none' END", MAGNITUDE[method], f"CASE WHEN c_{method} THEN {at} ELSE {other} END"
        if method in SHORT_TYPES:
            label, least = SHORT_TYPES[method]
            kind, size, sure = (f"CASE WHEN n < {least * window} THEN {v} ELSE {e} END" for v, e in ((f"'{label}'", kind), (0, size), (0, sure)))
        tail = f", z AS (SELECT *, c_{method} AS chg FROM {last})"
    elif method == "smart":
        used = {"gradient": "gradient", "cumulative_peaks": "peaks", "changepoint": "changepoint"}
        votes = " + ".join(f"CAST(c_{m} AS INT)" for m in used)
        kind = "CASE WHEN chg THEN 'smart_' || concat_ws('+', " + ", ".join(f"CASE WHEN c_{m} THEN '{n}' END" for m, n in used.items()) + ") ELSE 'none' END"
        size = "CASE WHEN chg THEN (" + " + ".join(f"CASE WHEN c_{m} THEN {MAGNITUDE[m]} ELSE 0 END" for m in used) + ") / votes ELSE 0 END"
        sure = "CASE WHEN chg THEN (" + " + ".join(f"CASE WHEN c_{m} THEN {TYPES[m][1]} ELSE 0 END" for m in used) + ") / votes ELSE 0 END"
        tail = f", y AS (SELECT *, {votes} AS votes, ({votes}) >= 1 AS fired FROM {last})" + _accept("fired", "chg", "y", "z")
    else:
        votes = " + ".join(f"CAST(c_{m} AS INT)" for m in METHODS)
        kind = "CASE WHEN chg THEN 'ensemble_vote_' || CAST(round(votes * 100.0 / 6) AS INT) || '%' ELSE 'none' END"
        size = sure = "votes / 6.0"
        tail = f", y AS (SELECT *, {votes} AS votes, ({votes}) >= {need} AS fired FROM {last})" + _accept("fired", "chg", "y", "z")
    return f"""{regime_base(sensitivity)}{ALL_ACCEPTED}{tail}, found AS (SELECT series_id, t, value AS complexity, chg AS regime_change, CAST({IDS} AS BIGINT) AS regime_id,
        {kind} AS change_type, coalesce({size}, 0) AS change_magnitude, CAST({sure} AS DOUBLE) AS confidence, least_n AS min_size, i FROM z)"""




def shown(found: DataFrame) -> DataFrame:
    """The compared columns of detected changes."""
    return found.select("series_id", "t", "regime_change", "regime_id", "change_type", r6("change_magnitude"), r6("confidence"))


FOUND_SQL = f"SELECT series_id, t, regime_change, regime_id, change_type, {q6('change_magnitude', 'change_magnitude')}, {q6('confidence', 'confidence')} FROM found"
SHORT = {"cumulative_peaks": "peaks", "variance_shift": "variance"}
for _m in (*METHODS, "smart", "all"):
    on_series(f"regime_{SHORT.get(_m, _m)}", "s1", lambda s, m=_m: shown(regime.detect_changes(s, m)), f"{changes_sql(_m)} {FOUND_SQL}")
    if _m in SHORT_TYPES:
        on_series(f"regime_short_{SHORT.get(_m, _m)}", "s5", lambda s, m=_m: shown(regime.detect_changes(s, m)), f"{changes_sql(_m)} {FOUND_SQL}")
for _sensitivity in ("low", "high"):
    for _m in ("changepoint", "variance_shift", "gradient", "entropy", "smart", "all"):
        on_series(
            f"regime_{SHORT.get(_m, _m)}_{_sensitivity}", "s1", lambda s, m=_m, level=_sensitivity: shown(regime.detect_changes(s, m, level)), f"{changes_sql(_m, _sensitivity)} {FOUND_SQL}",
        )
on_series("regime_smart_orders", "s2", lambda s: shown(regime.detect_changes(s, "smart")), f"{changes_sql('smart')} {FOUND_SQL}")

STABILITY = """, st AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY series_id) = 1 THEN 0.5 ELSE least(1, count(*) OVER (PARTITION BY series_id, regime_id) / (min_size * 2.0)) END AS score FROM found)"""
on_series(
    "regime_stability",
    "s1",
    lambda s: regime.with_stability(regime.detect_changes(s, "smart")).select("series_id", "t", r6("stability_score"), "regime_stability"),
    f"""{changes_sql("smart")}{STABILITY} SELECT series_id, t, {q6("score", "stability_score")}, CASE WHEN score > 0.7 THEN 'Stable' WHEN score > 0.3 THEN 'Transitional' ELSE 'Unstable' END AS regime_stability FROM st""",
)

PATTERN = """, pt AS (SELECT series_id, regime_id, count(*) AS n, min(t) AS "start", max(t) AS "end", avg(complexity) AS mean, var_samp(complexity) AS variance,
    CASE WHEN count(*) > 1 THEN regr_slope(complexity, k) END AS slope
    FROM (SELECT *, row_number() OVER (PARTITION BY series_id, regime_id ORDER BY t) AS k FROM found) GROUP BY 1, 2),
    pn AS (SELECT *, CASE WHEN n <= 2 OR slope IS NULL THEN 'Stable' WHEN slope > 0.01 THEN 'Increasing' WHEN slope < -0.01 THEN 'Decreasing'
        WHEN mean > 1e-9 AND variance / mean > 0.1 THEN 'Fluctuating' ELSE 'Stable' END AS complexity_pattern FROM pt)"""
on_series(
    "regime_pattern",
    "s1",
    lambda s: regime.regime_patterns(regime.detect_changes(s, "smart")).select("series_id", "regime_id", "n", "start", "end", r6("mean"), r6("slope"), "complexity_pattern"),
    f"""{changes_sql("smart")}{PATTERN} SELECT series_id, regime_id, n, "start", "end", {q6("mean", "mean")}, {q6("slope", "slope")}, complexity_pattern FROM pn""",
)

CONSOLIDATED = """, cm AS (SELECT series_id, regime_id, avg(complexity) AS m, min(t) AS t0 FROM found GROUP BY 1, 2),
    cn AS (SELECT a.series_id, b.regime_id AS j, max(a.regime_id) AS i FROM cm a JOIN cm b ON a.series_id = b.series_id AND a.regime_id < b.regime_id
        WHERE (a.m + b.m) / 2 > 1e-9 AND abs(a.m - b.m) / ((a.m + b.m) / 2) < 0.6 GROUP BY 1, 2),
    cg AS (SELECT cm.series_id, cm.regime_id, cm.t0, coalesce(cn.i, cm.regime_id) AS g FROM cm LEFT JOIN cn ON cm.series_id = cn.series_id AND cm.regime_id = cn.j),
    cd AS (SELECT series_id, g, row_number() OVER (PARTITION BY series_id ORDER BY min(t0)) AS new_id FROM cg GROUP BY 1, 2),
    c0 AS (SELECT f.series_id, f.t, f.i, f.min_size AS least_n, new_id, coalesce(new_id <> lag(new_id) OVER (PARTITION BY f.series_id ORDER BY f.t), false) AS raw
        FROM found f JOIN cg ON f.series_id = cg.series_id AND f.regime_id = cg.regime_id JOIN cd ON cd.series_id = cg.series_id AND cd.g = cg.g)"""
on_series(
    "regime_consolidated",
    "s1",
    lambda s: regime.consolidate(regime.detect_changes(s, "threshold", min_size=3)).select("series_id", "t", "regime_change", "regime_id"),
    f"""{changes_sql("threshold").replace("greatest(10, CAST(floor(n * 0.1) AS BIGINT)) AS least_n", "3 AS least_n")}{CONSOLIDATED}{_accept("raw", "chg", "c0", "c1")}
    SELECT series_id, t, chg AS regime_change, CAST({IDS} AS BIGINT) AS regime_id FROM c1""",
)


# Flagship: rolling complexity of each user's events, then regimes of that complexity.


def complexity_series(s: DataFrame) -> DataFrame:
    """Rolling complexity as a series of its own, rounded so that both engines see the same digits."""
    out = rolling.rolling_measures(s, measures=("complexity",), width=W).where("value_complexity IS NOT NULL")
    return out.select("series_id", "t", F.round("value_complexity", 9).alias("value"))


on_series(
    "flagship_regimes",
    "s1",
    lambda s: regime.detect_changes(complexity_series(s), "smart").groupBy("series_id").agg(F.max("regime_id").alias("n_regimes"), r6(F.avg("complexity"), "mean_complexity"), F.count("*").alias("n")),
    f"""{ROLL_BASE}, cx AS (SELECT series_id, t, round({EXPRESSIONS["complexity"]}, 9) AS value FROM g)
    {changes_sql("smart").replace("WITH s AS ({s}), p0", ", p0").replace("FROM s WINDOW o", "FROM cx WINDOW o")}
    SELECT series_id, max(regime_id) AS n_regimes, {q6("avg(complexity)", "mean_complexity")}, count(*) AS n FROM found GROUP BY 1""",
)
on_series(
    "regime_full",
    "s1",
    lambda s: regime.detect_regime(s).select("series_id", "t", "regime_id", "regime_stability", "complexity_pattern", "regime_name"),
    f"""{changes_sql("smart")}{STABILITY}{PATTERN}, tot AS (SELECT series_id, max(regime_id) AS k FROM found GROUP BY 1)
    SELECT st.series_id, st.t, st.regime_id, CASE WHEN score > 0.7 THEN 'Stable' WHEN score > 0.3 THEN 'Transitional' ELSE 'Unstable' END AS regime_stability, complexity_pattern,
    CASE WHEN k <= 26 THEN 'Pattern ' || chr(CAST(64 + st.regime_id AS INT)) ELSE 'Pattern' || chr(CAST(65 + (st.regime_id - 1) // 10 AS INT)) || ((st.regime_id - 1) % 10 + 1) END AS regime_name
    FROM st JOIN pn ON st.series_id = pn.series_id AND st.regime_id = pn.regime_id JOIN tot ON tot.series_id = st.series_id""",
)


# One long series, cut into ranges of ROWS rows: all events in time order.
ROWS = 1_000
on_series(
    "long_rolling",
    "s6",
    lambda s: rolling.rolling_measures(s, width=W, block=ROWS).select("series_id", "t", *[r6(f"value_{m}", m, 5) for m in rolling.MEASURES]),
    src.on(ORACLE_SQL["roll_all"], "s1", "s6"),
)
on_series(
    "long_rolling_rescaled",
    "s6",
    lambda s: rolling.rolling_measures(s, measures=("complexity",), width=W, rescale=True, block=ROWS).where("value_complexity IS NOT NULL").select("series_id", "t", r6("value_complexity", "measure", 5)),
    src.on(ORACLE_SQL["roll_rescale"], "s1", "s6"),
)
for _m in ("smart", "all"):
    on_series(f"long_regimes_{_m}", "s6", lambda s, m=_m: shown(regime.detect_changes(s, m, block=ROWS)), f"{changes_sql(_m)} {FOUND_SQL}")
on_series(
    "long_regimes_full",
    "s6",
    lambda s: regime.detect_regime(s, block=ROWS).select("series_id", "t", "regime_id", "regime_stability", "complexity_pattern", "regime_name"),
    src.on(ORACLE_SQL["regime_full"], "s1", "s6"),
)



def punctured(s: DataFrame) -> DataFrame:
    """The series with rows and values missing."""
    return s.where("t % 3 <> 1 OR t > 1200").withColumn("value", F.when(F.col("t") % 5 != 0, F.col("value")))


on_series(
    "long_filled",
    "s6",
    lambda s: src.fill_gaps(punctured(s), ROWS).select("series_id", "t", r6("value")),
    f"""WITH s AS (SELECT series_id, t, CASE WHEN t % 5 <> 0 THEN value END AS value FROM ({{s}}) WHERE t % 3 <> 1 OR t > 1200),
    f AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0,
        first_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1
    FROM s WINDOW b AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT series_id, t, {q6("coalesce(value, CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, v0, v1)", "value")} FROM f""",
)

PROBS = [0.05, 0.25, 0.5, 0.75, 0.9]


@query(
    "group_quantiles",
    f"""SELECT event_type AS series_id, {", ".join(q6(f"quantile_cont(value, {p})", f"q{round(100 * p)}") for p in PROBS)} FROM events GROUP BY event_type
    UNION ALL SELECT 'all', {", ".join(q6(f"quantile_cont(value, {p})", f"q{round(100 * p)}") for p in PROBS)} FROM events""",
)
def grouped_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of every event type and of all events, by rank places; one group holds every row."""
    events = src.read(spark, sf_dir, "events").select(F.explode(F.array(F.col("event_type"), F.lit("all"))).alias("series_id"), "value")
    found = ranges.group_quantiles(events, "value", PROBS)
    return found.select("series_id", *[r6(F.col("q")[i], f"q{round(100 * p)}") for i, p in enumerate(PROBS)])
