"""Queries of scaling, transforms, discretisers and transition networks."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import clustering, discretize, markov, scaling
from ..sources import series as src
from .registry import on_series, q6, r6

S = "WITH s AS ({s})"
STATS = f"""{S}, st AS (SELECT series_id, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5) AS med,
    quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.05) AS ql, quantile_cont(value, 0.95) AS qh FROM s GROUP BY 1),
md AS (SELECT series_id, 1.4826 * quantile_cont(abs(value - med), 0.5) AS mad FROM s JOIN st USING (series_id) GROUP BY 1)"""
SCALED = {
    "center": "value - mean",
    "standardize": "(value - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END",
    "minmax": "(value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END",
    "iqr": "(value - med) / CASE WHEN q75 = q25 THEN 1 ELSE q75 - q25 END",
    "robust": "(value - med) / CASE WHEN mad > 0 THEN mad WHEN q75 = q25 THEN 1 ELSE q75 - q25 END",
    "quantile": "(value - ql) / CASE WHEN qh = ql THEN 1 ELSE qh - ql END",
}
for _m, _e in SCALED.items():
    on_series(
        f"scale_{_m}", "s1", lambda s, m=_m: scaling.apply_scaling(s, m).select("series_id", "t", r6("scaled")),
        f"{STATS} SELECT series_id, t, {q6(_e, 'scaled')} FROM s JOIN st USING (series_id) JOIN md USING (series_id)",
    )


def _round_trip(s):
    p = scaling.scaling_parameters(s, "robust")
    return scaling.reverse_scaling(scaling.apply_scaling(s, "robust", p).drop("value"), p).select("series_id", "t", r6("value"))


on_series("scale_roundtrip", "s1", _round_trip, f"{S} SELECT series_id, t, {q6('value', 'value')} FROM s")
on_series(
    "scale_auto", "s1", lambda s: scaling.detect_scaling(s).select("series_id", r6("outlier_share"), r6("skew_index"), "method"),
    f"""{STATS}, o AS (SELECT series_id, avg(CASE WHEN value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25) THEN 1.0 ELSE 0 END) AS p FROM s JOIN st USING (series_id) GROUP BY 1)
    SELECT series_id, {q6("p", "outlier_share")}, {q6("abs(mean - med) / sd", "skew_index")},
    CASE WHEN sd = 0 THEN 'none' WHEN p > 0.1 THEN CASE WHEN abs(mean - med) / sd > 0.5 THEN 'quantile' ELSE 'iqr' END WHEN p > 0.05 THEN 'robust' WHEN hi - lo > 1000 OR lo >= 0 THEN 'minmax' ELSE 'standardize' END AS method
    FROM st JOIN o USING (series_id)""",
)
on_series(
    "scale_summary", "s3", lambda s: scaling.scaling_parameters(s, "standardize").select("series_id", *[r6(c) for c in ("center", "scale", "median", "min", "max", "iqr", "q25", "q75")]),
    f"{STATS} SELECT series_id, {q6('mean', 'center')}, {q6('sd', 'scale')}, {q6('med', 'median')}, {q6('lo', 'min')}, {q6('hi', 'max')}, {q6('q75 - q25', 'iqr')}, {q6('q25', 'q25')}, {q6('q75', 'q75')} FROM st",
)
on_series(
    "ts_check", "s4", lambda s: scaling.check_series(s).select("series_id", "length", "na_count", "long_enough", *[r6(c) for c in ("mean", "sd", "min", "max", "range")]),
    f"""{S} SELECT series_id, count(*) AS length, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS na_count, count(*) >= 10 AS long_enough,
    {q6("avg(value)", "mean")}, {q6("stddev_samp(value)", "sd")}, {q6("min(value)", "min")}, {q6("max(value)", "max")}, {q6("max(value) - min(value)", "range")} FROM s GROUP BY 1""",
)
on_series(
    "ts_window_size", "s1", scaling.window_size,
    f"""{S}, w AS (SELECT series_id, count(*) AS n, CAST(least(greatest(count(*) // 20, 5), count(*) // 3) AS BIGINT) AS window_size FROM s GROUP BY 1)
    SELECT series_id, n, window_size, (n - window_size) // window_size + 1 AS resulting_windows FROM w""",
)
TRANSFORMED = {"log": "ln(value + CASE WHEN lo <= 0 THEN abs(lo) + 1 ELSE 0 END)", "sqrt": "sqrt(value + CASE WHEN lo < 0 THEN abs(lo) ELSE 0 END)", "scale": "(value - mean) / sd"}
for _m, _e in TRANSFORMED.items():
    on_series(
        f"transform_{_m}", "s1", lambda s, m=_m: scaling.transform_series(s.withColumn("value", F.col("value") - 5), m)[0].select("series_id", "t", r6("value")),
        f"WITH s AS (SELECT series_id, t, value - 5 AS value FROM ({{s}})), {STATS.split(', ', 1)[1]} SELECT series_id, t, {q6(_e, 'value')} FROM s JOIN st USING (series_id)",
    )


def _transform_round_trip(s):
    out, p = scaling.transform_series(s, "log")
    return scaling.reverse_transform(out, p, "log").select("series_id", "t", r6("value"))


on_series("transform_roundtrip", "s1", _transform_round_trip, f"{S} SELECT series_id, t, {q6('value', 'value')} FROM s")
on_series(
    "fill_linear", "s4", lambda s: src.fill_gaps(s.where("t % 3 <> 1 OR t > 12").withColumn("value", F.when(F.col("t") % 5 != 0, F.col("value")))).select("series_id", "t", r6("value")),
    f"""WITH s AS (SELECT series_id, t, CASE WHEN t % 5 <> 0 THEN value END AS value FROM ({{s}}) WHERE t % 3 <> 1 OR t > 12),
    f AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0,
        first_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1
    FROM s WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT series_id, t, {q6("coalesce(value, CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, v0, v1)", "value")} FROM f""",
)
on_series("drop_missing", "s4", lambda s: src.drop_missing(s, ["value"], "omit").select("series_id", "t", r6("value")), f"{S} SELECT series_id, t, {q6('value', 'value')} FROM s WHERE value IS NOT NULL")
on_series(
    "segments", "s3", lambda s: src.segments(s.where("t > 3 OR series_id = 'R'")),
    """WITH s AS (SELECT * FROM ({s}) WHERE t > 3 OR series_id = 'R') SELECT series_id, min(t) AS first_t, max(t) AS last_t, count(*) AS n,
    row_number() OVER (ORDER BY min(t), series_id) AS position FROM s GROUP BY 1""",
)
on_series(
    "top_series", "s1", lambda s: src.top_series(s, 5).select("series_id", "t", r6("value")),
    f"{S} SELECT series_id, t, {q6('value', 'value')} FROM s WHERE series_id IN (SELECT DISTINCT series_id FROM s ORDER BY 1 LIMIT 5)",
)

# Discretisers: bin x among breaks b (a list of k + 1), right-closed.
K = 5
BIN = "CASE WHEN x >= b[1] AND x <= b[len(b)] THEN 1 + len(list_filter(b[2:len(b) - 1], lambda c: x > c)) END"


def quantile_list(value: str, k: int = K) -> str:
    return "[" + ", ".join(f"round(quantile_cont({value}, {i / k}), 10)" for i in range(k + 1)) + "]"


OUT = "series_id, t, CAST(state AS INT) AS state"
BY_BREAKS = f"SELECT series_id, t, CAST(CASE WHEN ok THEN {BIN} END AS INT) AS state FROM d"
DISC = {
    "quantile": ("s1", f"{S}, q AS (SELECT series_id, {quantile_list('value')} AS b, count(DISTINCT value) AS u FROM s GROUP BY 1), d AS (SELECT series_id, t, value AS x, b, u >= {K} AND len(list_distinct(b)) = len(b) AS ok FROM s JOIN q USING (series_id)) {BY_BREAKS}"),
    "equal_width": ("s1", f"{S}, q AS (SELECT series_id, [{', '.join(f'round(min(value) + (max(value) - min(value)) * {i / K}, 10)' for i in range(K + 1))}] AS b, count(DISTINCT value) AS u FROM s GROUP BY 1), d AS (SELECT series_id, t, value AS x, b, u >= {K} AS ok FROM s JOIN q USING (series_id)) {BY_BREAKS}"),
    "symbolic": ("s1", f"{S}, q AS (SELECT series_id, avg(value) AS m, stddev_samp(value) AS sd FROM s GROUP BY 1) SELECT series_id, t, CAST(CASE WHEN sd > 0 THEN 1 + {' + '.join(f'CAST((value - m) / sd > {NormalDist().inv_cdf(i / K)!r} AS INT)' for i in range(1, K))} END AS INT) AS state FROM s JOIN q USING (series_id)"),
    "magnitude": ("s1", f"{S}, q AS (SELECT series_id, max(value) - min(value) AS r FROM s GROUP BY 1) SELECT series_id, t, CAST(CASE WHEN r > 0 THEN 1 + {' + '.join(f'CAST(abs(value) > round(r / {K} * pow({float(K)}, {i / (K - 1)}), 10) AS INT)' for i in range(K))} END AS INT) AS state FROM s JOIN q USING (series_id)"),
    "percentile_magnitude": ("s2", f"{S}, q AS (SELECT series_id, {quantile_list('abs(value)')} AS b FROM s GROUP BY 1), d AS (SELECT series_id, t, abs(value) AS x, b, len(list_distinct(b)) = len(b) AS ok FROM s JOIN q USING (series_id)) {BY_BREAKS}"),
    "adaptive_magnitude": ("s1", f"""{S}, z AS (SELECT series_id, t, CASE WHEN row_number() OVER o >= 10 THEN round((value - avg(value) OVER f) / nullif(stddev_samp(value) OVER f, 0), 9) END AS x
        FROM s WINDOW o AS (PARTITION BY series_id ORDER BY t), f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
        q AS (SELECT series_id, {quantile_list('x')} AS b FROM z GROUP BY 1), d AS (SELECT series_id, t, x, b, len(list_distinct(b)) = len(b) AS ok FROM z JOIN q USING (series_id)) {BY_BREAKS}"""),
    "change_points": ("s1", f"""{S}, d0 AS (SELECT *, round(abs(lead(value) OVER o - value), 10) AS d, count(*) OVER (PARTITION BY series_id) AS n FROM s WINDOW o AS (PARTITION BY series_id ORDER BY t)),
        d1 AS (SELECT *, d IS NOT NULL AND row_number() OVER (PARTITION BY series_id ORDER BY d DESC NULLS LAST, t) <= {K - 1} AS cut FROM d0)
        SELECT series_id, t, CAST(CASE WHEN n >= {2 * K} THEN 1 + coalesce(sum(CAST(cut AS INT)) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS INT) AS state FROM d1"""),
    "entropy": ("s3", f"""{S}, q AS (SELECT series_id, min(value) AS lo, max(value) AS hi, max(value) - min(value) AS r, count(DISTINCT value) AS u FROM s GROUP BY 1),
        c AS (SELECT series_id, t, value, lo, hi, r, u, c, r / {2 * K} + (r / {K} - r / {2 * K}) * c / 19 AS w, lo - 0.001 * r AS a, hi + 0.001 * r AS z FROM s JOIN q USING (series_id), range(20) g(c)),
        b AS (SELECT *, greatest(1, floor(round((z - a) / w, 9))) AS bins FROM c),
        n AS (SELECT series_id, c, bins, greatest(1, least(bins, ceil(round((value - a) / w, 9)))) AS bin, count(*) AS n FROM b GROUP BY 1, 2, 3, 4),
        e AS (SELECT series_id, c, bins, round(-sum(n / tot * ln(n / tot)), 9) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY series_id, c) AS tot FROM n) GROUP BY 1, 2, 3),
        best AS (SELECT series_id, c, bins FROM e QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY e DESC, c) = 1),
        d AS (SELECT b.series_id, t, value AS x, u >= {K} AS ok, b.bins, a, w, [{', '.join(f'round(lo + r * {i / K}, 10)' for i in range(K + 1))}] AS b FROM b JOIN best USING (series_id, c))
        SELECT series_id, t, CAST(CASE WHEN ok THEN CASE WHEN bins = {K} THEN greatest(1, least({K}, ceil(round((x - a) / w, 9)))) ELSE {BIN} END END AS INT) AS state FROM d"""),
}
for _m, (_which, _sql) in DISC.items():
    on_series({"percentile_magnitude": "disc_pct_magnitude", "adaptive_magnitude": "disc_adaptive"}.get(_m, f"disc_{_m}"), _which, lambda s, m=_m: discretize.discretize(s, m, K).where("state IS NOT NULL").select("series_id", "t", "state"), f"SELECT * FROM ({_sql}) WHERE state IS NOT NULL")
on_series("disc_kmeans", "s1", lambda s: discretize.discretize(s, "kmeans", 3).select("series_id", "t", "state"))
on_series(
    "disc_kmeans_optimal", "s1", lambda s: discretize.discretize(s, "kmeans_optimal", 3).where("state IS NOT NULL").select("series_id", "t", "state"),
    """WITH s AS ({s}), g AS (SELECT series_id, value AS x, count(*) AS n FROM s WHERE value IS NOT NULL GROUP BY 1, 2), m AS (SELECT series_id, avg(value) AS mean FROM s GROUP BY 1),
    r AS (SELECT series_id, x, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS u, CAST(sum(n) OVER w AS DOUBLE) AS c, sum(n * (x - mean)) OVER w AS s1, sum(n * (x - mean) * (x - mean)) OVER w AS s2
        FROM g JOIN m USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY x)),
    e AS (SELECT series_id, c, s1, s2 FROM r WHERE i = u), p AS (SELECT a.series_id, a.x AS xa, b.x AS xb, a.i AS ia, b.i AS ib, a.s2 - a.s1 * a.s1 / a.c
        + b.s2 - a.s2 - (b.s1 - a.s1) * (b.s1 - a.s1) / (b.c - a.c) + e.s2 - b.s2 - (e.s1 - b.s1) * (e.s1 - b.s1) / (e.c - b.c) AS cost
        FROM r a JOIN r b ON b.series_id = a.series_id AND a.i < b.i JOIN e ON e.series_id = a.series_id WHERE b.i < b.u),
    o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(cost, 7), ib, ia) = 1)
    SELECT series_id, t, CAST(1 + CAST(value > xa AS INT) + CAST(value > xb AS INT) AS INT) AS state FROM s JOIN o USING (series_id) WHERE value IS NOT NULL""",
)
on_series("disc_mixture", "s1", lambda s: discretize.discretize(s, "mixture", 3).select("series_id", "t", "state"))
on_series(
    "disc_hierarchical", "s1", lambda s: clustering.by_linkage(s, 3).select("series_id", "t", "state"),
    """WITH RECURSIVE s AS ({s}), r AS (SELECT series_id, list_sort(list(DISTINCT value)) AS lo, list_sort(list(DISTINCT value)) AS hi FROM s WHERE value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT value) >= 3
        UNION ALL SELECT series_id, lo[:p] || lo[p + 2:], hi[:p - 1] || hi[p + 1:] FROM (SELECT *, list_position(g, list_min(g)) AS p FROM (SELECT *, list_transform(range(1, len(lo)), lambda i: hi[i + 1] - lo[i]) AS g FROM r WHERE len(lo) > 3)))
    SELECT s.series_id, t, CAST(CASE WHEN value IS NOT NULL THEN 1 + CAST(value > hi[1] AS INT) + CAST(value > hi[2] AS INT) END AS INT) AS state FROM s LEFT JOIN (SELECT * FROM r WHERE len(lo) = 3) c ON c.series_id = s.series_id""",
)
on_series("disc_dtw", "s1", lambda s: discretize.discretize(s, "dtw", 3, window=8).select("series_id", "t", "state"))
on_series("disc_proxy_windowed", "s1", lambda s: discretize.discretize(s, "proxy_windowed", 3, window=8, step=2).select("series_id", "t", "state"))
on_series(
    "qstates", "s1", lambda s: discretize.quantile_states(s, 4).select("series_id", "t", "state"),
    f"""{S}, q AS (SELECT series_id, {quantile_list("value", 4)} AS b FROM s GROUP BY 1)
    SELECT series_id, t, CASE WHEN len(list_distinct(b)) = len(b) THEN 'Q' || (1 + len(list_filter(b[2:4], lambda c: value >= c))) END AS state FROM s JOIN q USING (series_id)""",
)
on_series(
    "map_to_state", "s1", lambda s: discretize.map_to_state(s, {"tiny": "<5", "low": "5-25", "mid": "25-75", "odd": "=100", "high": ">75"}).select("series_id", "t", "state"),
    f"{S} SELECT series_id, t, CASE WHEN value < 5 THEN 'tiny' WHEN value BETWEEN 5 AND 25 THEN 'low' WHEN value BETWEEN 25 AND 75 THEN 'mid' WHEN value = 100 THEN 'odd' WHEN value > 75 THEN 'high' END AS state FROM s",
)

# Transition networks: states are overall value bands, so that every series shares them.
BANDS = "CASE WHEN value <= 10 THEN 1 WHEN value <= 40 THEN 2 WHEN value <= 90 THEN 3 ELSE 4 END"
BANDED = "WITH x AS (SELECT *, " + BANDS + " AS state FROM ({s}))"


def banded(s):
    """The series with four fixed bands as states."""
    return s.withColumn("state", F.expr(BANDS))


GRID = """, g AS (SELECT a.id AS from_state, b.id AS to_state FROM range(1, 5) a(id), range(1, 5) b(id)), c AS ({counts}),
    f AS (SELECT k.series_id, CAST(g.from_state AS INT) AS from_state, CAST(g.to_state AS INT) AS to_state, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT series_id FROM c) k CROSS JOIN g
    LEFT JOIN c ON c.series_id = k.series_id AND c.from_state = g.from_state AND c.to_state = g.to_state)"""
PAIRS = "SELECT {sid} AS series_id, state AS from_state, to_state, count(*) AS n FROM (SELECT *, lead(state) OVER ({over}) AS to_state FROM x) WHERE to_state IS NOT NULL GROUP BY 1, 2, 3"
LEVELS = {
    "series": PAIRS.format(sid="series_id", over="PARTITION BY series_id ORDER BY t"),
    "user": PAIRS.format(sid="'all'", over="PARTITION BY series_id ORDER BY t"),
    "global": PAIRS.format(sid="'all'", over="ORDER BY series_id, t"),
}
for _level in LEVELS:
    on_series(f"trans_{_level}", "s1", lambda s, v=_level: markov.transition_counts(banded(s), v, 4), BANDED + GRID.replace("{counts}", LEVELS[_level]) + " SELECT * FROM f")
on_series(
    "trans_norm", "s1", lambda s: markov.transition_probabilities(markov.transition_counts(banded(s), "series", 4)).select("series_id", "from_state", "to_state", r6("prob")),
    BANDED + GRID.replace("{counts}", LEVELS["series"]) + f" SELECT series_id, from_state, to_state, {q6('n / (sum(n) OVER (PARTITION BY series_id, from_state) + 1e-10)', 'prob')} FROM f",
)
on_series(
    "trans_edges", "s1", lambda s: markov.network_edges(markov.transition_probabilities(markov.transition_counts(banded(s), "user", 4), exact=True), 0.2).select("series_id", "from_state", "to_state", r6("weight")),
    BANDED + GRID.replace("{counts}", LEVELS["user"]) + f", p AS (SELECT *, n / sum(n) OVER (PARTITION BY from_state) AS prob FROM f) SELECT series_id, from_state, to_state, {q6('prob', 'weight')} FROM p WHERE prob > 0 AND prob >= 0.2",
)
on_series(
    "state_stats", "s1", lambda s: markov.state_statistics(banded(s), ["series_id"]).select("series_id", "state", "n", *[r6(c) for c in ("frequency", "mean", "median", "sd", "min", "max", "q25", "q75", "skewness", "kurtosis")]),
    BANDED + f""", a AS (SELECT series_id, state, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM x GROUP BY 1, 2),
    h AS (SELECT series_id, state, sum(pow(value - m, 3) / ((n - 1) * pow(sd, 3))) AS sk, sum(pow(value - m, 4) / ((n - 1) * pow(sd, 4))) AS ku FROM x JOIN a USING (series_id, state) WHERE n > 1 AND sd > 0 GROUP BY 1, 2)
    SELECT a.series_id, a.state, n, {q6("n / sum(n) OVER (PARTITION BY a.series_id)", "frequency")}, {q6("m", "mean")}, {q6("q2", "median")}, {q6("sd", "sd")}, {q6("lo", "min")}, {q6("hi", "max")}, {q6("q1", "q25")}, {q6("q3", "q75")},
    {q6("CASE WHEN n >= 3 THEN coalesce(sk, 0) END", "skewness")}, {q6("CASE WHEN n >= 4 THEN coalesce(ku, 0) END", "kurtosis")} FROM a LEFT JOIN h USING (series_id, state)""",
)
on_series(
    "rank_states", "s1", lambda s: markov.rank_states(banded(s).withColumn("state", 5 - F.col("state"))).select("series_id", "t", "state", "ranked_state"),
    BANDED + ", y AS (SELECT *, 5 - state AS z FROM x), r AS (SELECT z, CAST(row_number() OVER (ORDER BY avg(value), z) AS INT) AS ranked_state FROM y GROUP BY z) SELECT series_id, t, CAST(z AS INT) AS state, ranked_state FROM y JOIN r USING (z)",
)
on_series(
    "state_summary", "s1", lambda s: markov.state_summary(banded(s)).select("state", "n", r6("mean"), r6("median"), r6("sd"), r6("rank_by_mean"), r6("rank_by_median")),
    BANDED + f""", a AS (SELECT state, count(*) AS n, avg(value) AS m, quantile_cont(value, 0.5) AS md, stddev_samp(value) AS sd FROM x GROUP BY 1)
    SELECT state, n, {q6("m", "mean")}, {q6("md", "median")}, {q6("sd", "sd")}, {q6("rank() OVER (ORDER BY m DESC) + (count(*) OVER (PARTITION BY m) - 1) / 2.0", "rank_by_mean")},
    {q6("rank() OVER (ORDER BY md DESC) + (count(*) OVER (PARTITION BY md) - 1) / 2.0", "rank_by_median")} FROM a""",
)
RUNS = BANDED + """, r AS (SELECT series_id, run, min(state) AS state, min(t) AS "start", max(t) AS "end", count(*) AS duration FROM (
    SELECT *, sum(CASE WHEN p IS NULL OR p <> state THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t) AS run FROM (SELECT *, lag(state) OVER (PARTITION BY series_id ORDER BY t) AS p FROM x)) GROUP BY 1, 2)"""
on_series("run_lengths", "s1", lambda s: markov.run_lengths(banded(s)), RUNS + ' SELECT series_id, CAST(run AS BIGINT) AS run, state, "start", "end", duration FROM r')
on_series(
    "state_bands", "s1", lambda s: markov.state_bands(banded(s)),
    RUNS + """ SELECT series_id, CAST(run AS BIGINT) AS run, state, coalesce(("start" + lag("end") OVER w) / 2, CAST("start" AS DOUBLE)) AS from_t, coalesce(("end" + lead("start") OVER w) / 2, CAST("end" AS DOUBLE)) AS to_t
    FROM r WINDOW w AS (PARTITION BY series_id ORDER BY run)""",
)
on_series(
    "change_points", "s1", lambda s: markov.change_points(banded(s)).select("series_id", "t", "state"),
    BANDED + " SELECT series_id, t, state FROM (SELECT *, lag(state) OVER (PARTITION BY series_id ORDER BY t) AS p FROM x) WHERE state <> p",
)
on_series(
    "node_layout", "s1", lambda s: markov.node_layout(banded(s)).select("state", r6("x"), r6("y"), r6("frequency"), r6("mean_run")),
    RUNS + f""", n AS (SELECT state, sum(duration) AS n, avg(duration) AS mean_run, row_number() OVER (ORDER BY state) - 1 AS i, count(*) OVER () AS k FROM r GROUP BY 1)
    SELECT state, {q6("cos(2 * pi() * i / k)", "x")}, {q6("sin(2 * pi() * i / k)", "y")}, {q6("n / sum(n) OVER ()", "frequency")}, {q6("mean_run", "mean_run")} FROM n""",
)
on_series(
    "node_layout_spring", "s1", lambda s: markov.node_layout(banded(s), "spring").select("state", r6("x"), r6("y"), r6("frequency")),
    BANDED.replace("WITH x", "WITH RECURSIVE x") + f""", n AS (SELECT state, count(*) AS c, row_number() OVER (ORDER BY state) - 1 AS i, count(*) OVER () AS k FROM x GROUP BY 1),
    m AS (SELECT DISTINCT state, b FROM (SELECT state, lead(state) OVER (PARTITION BY series_id ORDER BY t) AS b FROM x) WHERE state <> b),
    w AS (SELECT a.i, b.i AS j, CASE WHEN m.b IS NULL THEN 0 ELSE 0.01 END AS pull FROM n a JOIN n b ON a.i <> b.i LEFT JOIN m ON m.state = a.state AND m.b = b.state),
    p AS (SELECT 0 AS step, i, k, cos(2 * pi() * i / k) AS x, sin(2 * pi() * i / k) AS y FROM n
        UNION ALL SELECT a.step + 1, a.i, a.k, any_value(a.x) + 0.1 * coalesce(sum((a.x - b.x) * (0.1 / (pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) - pull)), 0), any_value(a.y) + 0.1 * coalesce(sum((a.y - b.y) * (0.1 / (pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) - pull)), 0)
        FROM p a LEFT JOIN w ON w.i = a.i AND a.step % a.k = a.i LEFT JOIN p b ON b.i = w.j WHERE a.step < 50 * a.k GROUP BY a.step, a.i, a.k)
    SELECT state, {q6("x", "x")}, {q6("y", "y")}, {q6("c / sum(c) OVER ()", "frequency")} FROM p JOIN n USING (i) WHERE step = 50 * p.k""",
)
on_series(
    "stna_edges", "s1", lambda s: markov.state_network(s, 4, "quantile", "user")["edges"].select("series_id", "from_state", "to_state", r6("weight")),
    f"""WITH s AS ({{s}}), q AS (SELECT series_id, {quantile_list("value", 4)} AS b FROM s GROUP BY 1), x AS (SELECT series_id, t, CASE WHEN len(list_distinct(b)) = len(b) THEN 1 + len(list_filter(b[2:4], lambda c: value > c)) END AS state FROM s JOIN q USING (series_id))"""
    + GRID.replace("{counts}", LEVELS["user"].replace("FROM x)", "FROM x WHERE state IS NOT NULL)")) + f", p AS (SELECT *, n / (sum(n) OVER (PARTITION BY from_state) + 1e-10) AS prob FROM f) SELECT series_id, from_state, to_state, {q6('prob', 'weight')} FROM p WHERE prob > 0",
)
