"""Queries of entry points, generators, summaries and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import hurst, information, markov, proximity, warning
from ..sources import validate
from .hurst_warnings import CATEGORY, DFA, EWS, GLOBAL, WINDOWED, rolled, stated
from .proximity_networks import EDGES, METRIC_SQL, SPIKES, edges, lagged, spikes
from .registry import on_series, q6, query, r6
from .scaling_states import RUNS, banded

on_series(
    "validate_series", "s4", lambda s: validate.series_report(s),
    """WITH s AS ({s}) SELECT series_id, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS n_missing, CAST(0 AS BIGINT) AS n_infinite, coalesce(min(value) = max(value), true) AS constant,
    count(value) >= 2 AND NOT coalesce(min(value) = max(value), true) AS usable FROM s GROUP BY 1""",
)
SEGMENTS = "WITH s AS ({s}), n AS (SELECT series_id, row_number() OVER (ORDER BY series_id) AS k FROM (SELECT DISTINCT series_id FROM s)), v AS (SELECT k, t, coalesce(value, 0) AS value FROM s JOIN n USING (series_id))"
on_series(
    "dist_segments", "s4", lambda s: proximity.ts_distance(s.fillna(0.0, ["value"]), "euclidean").select("src", "dst", r6("distance", digits=7)),
    f"{SEGMENTS} SELECT a.k AS src, b.k AS dst, {q6('sqrt(sum((a.value - b.value) * (a.value - b.value)))', 'distance', 7)} FROM v a JOIN v b ON a.t = b.t AND a.k < b.k GROUP BY 1, 2",
)
on_series(
    "dist_both_ways", "s2", lambda s: proximity.ts_distance(s, "manhattan", 60, 40, symmetric=False).select("series_id", "src", "dst", r6("distance", digits=7)),
    EDGES.split(", e AS")[0] + f", d AS (SELECT series_id, src, dst, {METRIC_SQL['manhattan']} AS distance FROM p), b AS (SELECT * FROM d UNION ALL SELECT series_id, dst, src, distance FROM d) SELECT series_id, src, dst, {q6('distance', 'distance', 7)} FROM b",
)


def _pair(s: DataFrame) -> DataFrame:
    a, b = lagged(s)
    b = b.withColumn("t", F.col("t") - 3).withColumn("value", F.lag("value", 3, 0.0).over(Window.partitionBy("series_id").orderBy("t")))
    return proximity.distance_pair(a, b, "euclidean").select("series_id", r6("distance", digits=7))


on_series("dist_pair", "s3", _pair, f"WITH s AS ({{s}}), l AS (SELECT series_id, value - lag(value, 3, 0.0) OVER (PARTITION BY series_id ORDER BY t) AS d FROM s) SELECT series_id, {q6('sqrt(sum(d * d))', 'distance', 7)} FROM l GROUP BY 1")
on_series(
    "net_auto", "s2", lambda s: proximity.auto_network(edges(s)).select("src", "dst", r6("weight", digits=8)),
    EDGES + f""", b AS (SELECT src, dst, distance FROM e UNION ALL SELECT dst, src, distance FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS r FROM b WHERE distance > 0),
    u AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(distance) AS distance FROM r, m WHERE mx > 1000 AND r <= 5 GROUP BY 1, 2
        UNION ALL SELECT src, dst, distance FROM e, m WHERE mx > 100 AND mx <= 1000 AND distance > 0 AND distance <= q20 UNION ALL SELECT src, dst, distance FROM e, m WHERE mx <= 100 AND distance > 0 AND distance <= q25)
    SELECT src, dst, {q6("1 / (1 + distance)", "weight", 8)} FROM u""",
)
SIGNIFICANCE = SPIKES + """, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY tm) * 0.7548776662466927 AS z FROM a),
    j AS (SELECT series_id, g, tm + ((z + g * 0.5698402909980532 - floor(z + g * 0.5698402909980532)) * 2 - 1) * 5 AS tm FROM k, range(1, 21) r(g)),
    ua AS (SELECT series_id, 0 AS g, tm FROM a UNION ALL SELECT series_id, g, tm FROM j), ub AS (SELECT series_id, g, tm FROM b, range(0, 21) r(g)),
    pa AS (SELECT series_id, g, avg(CASE WHEN EXISTS (SELECT 1 FROM ub WHERE ub.series_id = ua.series_id AND ub.g = ua.g AND abs(ua.tm - ub.tm) <= 1) THEN 1.0 ELSE 0 END) AS p FROM ua GROUP BY 1, 2),
    pb AS (SELECT series_id, g, avg(CASE WHEN EXISTS (SELECT 1 FROM ua WHERE ub.series_id = ua.series_id AND ub.g = ua.g AND abs(ua.tm - ub.tm) <= 1) THEN 1.0 ELSE 0 END) AS q FROM ub GROUP BY 1, 2),
    es AS (SELECT series_id, g, round((p + q) / 2, 12) AS es FROM pa JOIN pb USING (series_id, g)), o AS (SELECT series_id, es AS o FROM es WHERE g = 0)"""
on_series(
    "event_significance", "s1", lambda s: proximity.synchronisation_significance(*spikes(s), 1.0, surrogates=20).select("series_id", r6("es"), r6("p_value")),
    f"{SIGNIFICANCE} SELECT series_id, {q6('max(o)', 'es')}, {q6('avg(CASE WHEN es >= o THEN 1.0 ELSE 0 END)', 'p_value')} FROM es JOIN o USING (series_id) WHERE g > 0 GROUP BY 1",
)
on_series(
    "mic", "s3", lambda s: proximity.maximal_information(*lagged(s)).select("series_id", r6("mic")),
    f"""WITH s AS ({{s}}), j AS (SELECT a.series_id, a.value AS x, b.value AS y FROM s a JOIN s b ON a.series_id = b.series_id AND a.t = b.t + 3),
    k AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY x) - 1 AS rx, rank() OVER (PARTITION BY series_id ORDER BY y) - 1 AS ry, count(*) OVER (PARTITION BY series_id) AS n FROM j),
    g AS (SELECT k.*, p, q, greatest(4, CAST(floor(pow(n, 0.6)) AS INT)) AS cells FROM k, range(2, 200) a(p), range(2, 200) b(q) WHERE p * q <= greatest(4, CAST(floor(pow(n, 0.6)) AS INT))),
    c AS (SELECT series_id, n, p, q, rx * p // n AS u, ry * q // n AS v, count(*) AS c FROM g GROUP BY ALL),
    t AS (SELECT *, sum(c) OVER (PARTITION BY series_id, p, q, u) AS cu, sum(c) OVER (PARTITION BY series_id, p, q, v) AS cv FROM c),
    i AS (SELECT series_id, p, q, sum(c / n * ln(c * n / (cu * cv))) / ln(least(p, q)) AS i FROM t GROUP BY 1, 2, 3) SELECT series_id, {q6("max(i)", "mic")} FROM i GROUP BY 1""",
)
on_series(
    "van_rossum_significance", "s1", lambda s: proximity.van_rossum_significance(*spikes(s), 2.0, surrogates=20).select("series_id", r6("distance", digits=7), r6("p_value")),
    SPIKES + f""", k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY tm) * 0.7548776662466927 AS z FROM a),
    j AS (SELECT series_id, g, tm + ((z + g * 0.5698402909980532 - floor(z + g * 0.5698402909980532)) * 2 - 1) * 10 AS tm FROM k, range(1, 21) r(g)),
    n AS (SELECT series_id, min(tm) AS lo, max(tm) + 10 AS hi FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1), x AS (SELECT series_id, lo + i * 0.2 AS x, i FROM n JOIN range(0, 20000) r(i) ON i <= floor((hi - lo) / 0.2)),
    u AS (SELECT series_id, 0 AS g, tm, 1.0 AS w FROM a UNION ALL SELECT series_id, g, tm, 1.0 FROM j UNION ALL SELECT series_id, g, tm, -1.0 FROM b, range(0, 21) r(g)),
    f AS (SELECT x.series_id, g, i, sum(w * exp(-(x - tm) / 2.0)) AS f FROM x JOIN u ON x.series_id = u.series_id AND x >= tm GROUP BY 1, 2, 3),
    d AS (SELECT series_id, g, round(sqrt(sum(f * f) * 0.2 / 2.0), 9) AS d FROM f GROUP BY 1, 2), o AS (SELECT series_id, d AS o FROM d WHERE g = 0)
    SELECT series_id, {q6("max(o)", "distance", 7)}, {q6("avg(CASE WHEN d <= o THEN 1.0 ELSE 0 END)", "p_value")} FROM d JOIN o USING (series_id) WHERE g > 0 GROUP BY 1""",
)
on_series("mic_optimal", "s3", lambda s: information.optimal_information(*lagged(s)).select("series_id", r6("mic")))
for _kind, _x, _y in (("grid", "i % ceil(sqrt(k)) + 1", "floor(i / ceil(sqrt(k))) + 1"), ("tree", "i % ceil(k / ceil(log2(k + 1))) + 1", "floor(i / ceil(k / ceil(log2(k + 1)))) + 1")):
    on_series(
        f"node_layout_{_kind}", "s1", lambda s, kind=_kind: markov.node_layout(banded(s), kind).select("state", r6("x"), r6("y")),
        RUNS + f""", n AS (SELECT state, row_number() OVER (ORDER BY state) - 1 AS i, count(*) OVER () AS k FROM r GROUP BY 1) SELECT state, {q6(_x, "x")}, {q6(_y, "y")} FROM n""",
    )
TEXT = {
    "strong_antipersistent": "Strong anti-persistence (mean-reverting)", "antipersistent": "Anti-persistent (mean-reverting)", "random_walk": "Random walk (no memory)",
    "persistent": "Persistent (trending)", "strong_persistent": "Strong persistence (trending)",
}
SCALED_GRID = """, sc AS (SELECT DISTINCT series_id, CAST(round_even(exp(ln(6.0) + (ln(100.0) - ln(6.0)) * k / 7.0), 0) AS BIGINT) AS s FROM (SELECT DISTINCT series_id, n FROM r), range(8) g(k))"""
on_series(
    "hurst_scaled", "s3",
    lambda s: hurst.calculate_hurst(s, "dfa", "standardize", min_scale=6, max_scale=100, n_scales=8).select("series_id", r6("hurst", digits=8), r6("r2", digits=8), "state", "interpretation"),
    GLOBAL.replace("({s})", "(SELECT series_id, t, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM ({s}) WINDOW w AS (PARTITION BY series_id))") + SCALED_GRID + DFA
    + f" SELECT series_id, {q6('hurst', 'hurst', 8)}, {q6('r2', 'r2', 8)}, {CATEGORY} AS state, CASE {CATEGORY} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in TEXT.items())} END AS interpretation FROM h",
)
on_series(
    "hurst_points", "s3", lambda s: hurst.scaling_points(s).select("series_id", "s", r6("log_s", digits=8), r6("log_f", digits=8)),
    GLOBAL + """, sc AS (SELECT DISTINCT series_id, CAST(round_even(exp(ln(4.0) + (ln(CAST(n // 4 AS DOUBLE)) - ln(4.0)) * k / 9.0), 0) AS BIGINT) AS s FROM (SELECT DISTINCT series_id, n FROM r), range(10) g(k))"""
    + DFA + f" SELECT series_id, s, {q6('ln(s)', 'log_s', 8)}, {q6('ln(f)', 'log_f', 8)} FROM f WHERE f > 0",
)


def _windowed(s: DataFrame) -> DataFrame:
    """Exponents of every window as rows (t is the window) with their categories."""
    return rolled(s).select("series_id", F.col("win").alias("t"), F.round("hurst", 9).alias("hurst")).withColumn("state", hurst.category(F.col("hurst")))


STATED_H = WINDOWED + DFA + f""", w AS (SELECT series_id, win AS t, round(hurst, 9) AS hurst FROM h), x AS (SELECT *, {CATEGORY} AS state FROM w),
    y AS (SELECT *, lag(state) OVER (PARTITION BY series_id ORDER BY t) AS old, lead(state) OVER (PARTITION BY series_id ORDER BY t) AS nxt FROM x),
    zz AS (SELECT *, sum(CASE WHEN old IS NULL OR old <> state THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t) AS run FROM y), rr AS (SELECT series_id, run, any_value(state) AS state, count(*) AS duration FROM zz GROUP BY 1, 2)"""
on_series(
    "hurst_summary", "s3",
    lambda s: hurst.hurst_summary(_windowed(s)).select("series_id", *[r6(c, digits=7) for c in ("mean", "sd", "min", "max", "median", "mean_duration")], "max_duration", "min_duration", "n_transitions"),
    STATED_H + f""", a AS (SELECT series_id, avg(hurst) AS mean, stddev_samp(hurst) AS sd, min(hurst) AS lo, max(hurst) AS hi, quantile_cont(hurst, 0.5) AS med FROM x GROUP BY 1),
    d AS (SELECT series_id, avg(duration) AS md, max(duration) AS max_duration, min(duration) AS min_duration, count(*) - 1 AS n_transitions FROM rr GROUP BY 1)
    SELECT series_id, {q6("mean", "mean", 7)}, {q6("sd", "sd", 7)}, {q6("lo", "min", 7)}, {q6("hi", "max", 7)}, {q6("med", "median", 7)}, {q6("md", "mean_duration", 7)}, max_duration, min_duration, n_transitions FROM a JOIN d USING (series_id)""",
)
on_series(
    "hurst_durations", "s3", lambda s: hurst.state_durations(_windowed(s)).select("series_id", "state", "n", r6("share"), r6("mean_duration")),
    STATED_H + f", n AS (SELECT series_id, state, CAST(sum(duration) AS BIGINT) AS n, avg(duration) AS m FROM rr GROUP BY 1, 2) SELECT series_id, state, n, {q6('n / sum(n) OVER (PARTITION BY series_id)', 'share')}, {q6('m', 'mean_duration')} FROM n",
)
on_series(
    "hurst_transitions", "s3", lambda s: hurst.state_transitions(_windowed(s)).select("series_id", "from_state", "to_state", "n", r6("probability")),
    STATED_H + f", n AS (SELECT series_id, state AS from_state, nxt AS to_state, count(*) AS n FROM zz WHERE nxt IS NOT NULL GROUP BY 1, 2, 3) SELECT series_id, from_state, to_state, n, {q6('n / sum(n) OVER (PARTITION BY series_id, from_state)', 'probability')} FROM n",
)
on_series(
    "ews_islands", "s2", lambda s: warning.level_islands(warning.detect_warnings(stated(s))).select("series_id", "run", "level", "start", "end", "duration"),
    EWS + """, y AS (SELECT *, lag(level) OVER (PARTITION BY series_id ORDER BY t) AS before FROM lv), z AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR before <> level THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t) AS BIGINT) AS run FROM y)
    SELECT series_id, run, any_value(level) AS level, min(t) AS "start", max(t) AS "end", count(*) AS duration FROM z GROUP BY 1, 2""",
)
