"""Queries of Hurst exponents and early warnings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hurst, warning
from .registry import on_series, q6, r6

GLOBAL = """WITH s AS ({s}), r AS (SELECT series_id, CAST(0 AS BIGINT) AS win, row_number() OVER (PARTITION BY series_id ORDER BY t) AS i, count(*) OVER (PARTITION BY series_id) AS n, value AS x FROM s)"""
GRID = """, sc AS (SELECT DISTINCT series_id, CAST(round_even(exp(ln(4.0) + (ln(CAST(n // 4 AS DOUBLE)) - ln(4.0)) * k / 9.0), 0) AS BIGINT) AS s FROM (SELECT DISTINCT series_id, n FROM r), range(10) g(k))"""
ROLL_STEP, ROLL = 1, 50
WINDOWED = f"""WITH s AS ({{s}}), z AS (SELECT series_id, max(t) AS top FROM s GROUP BY 1), r AS (SELECT s.series_id, w.win, t - win + {ROLL // 2} + 1 AS i, CAST({ROLL} AS BIGINT) AS n, value AS x
    FROM z JOIN (SELECT {ROLL // 2 + 1} + k * {ROLL_STEP} AS win FROM range(4000) g(k)) w ON w.win <= z.top - {ROLL // 2} JOIN s ON s.series_id = z.series_id AND t BETWEEN win - {ROLL // 2} AND win + {ROLL // 2} - 1),
    sc AS (SELECT series_id, s FROM z, (SELECT unnest([4, 5, 7, 9, 12]) AS s))"""
RESIDUALS = """, p AS (SELECT *, sum(d) OVER (PARTITION BY series_id, win ORDER BY i) AS p FROM (SELECT *, x - avg(x) OVER (PARTITION BY series_id, win) AS d FROM r)),
    b AS (SELECT p.series_id, win, i, p, n, s, 0 AS back, (i - 1) // s AS seg FROM p JOIN sc USING (series_id) UNION ALL SELECT p.series_id, win, i, p, n, s, 1, (n - i) // s FROM p JOIN sc USING (series_id)),
    f2 AS (SELECT series_id, win, s, back, seg, greatest(0, (regr_syy(p, i) - regr_sxy(p, i) * regr_sxy(p, i) / regr_sxx(p, i)) / s) AS f2 FROM b WHERE n // s >= 2 AND seg < n // s GROUP BY 1, 2, 3, 4, 5)"""
DFA = RESIDUALS + """, f AS (SELECT series_id, win, s, sqrt(avg(f2)) AS f FROM f2 GROUP BY 1, 2, 3),
    h AS (SELECT series_id, win, regr_slope(ln(f), ln(s)) AS hurst, regr_r2(ln(f), ln(s)) AS r2, count(*) AS n_scales FROM f WHERE f > 0 GROUP BY 1, 2 HAVING count(*) >= 3)"""
RS = """, b AS (SELECT r.series_id, win, i, x, n, s, (i - 1) // s AS seg FROM r JOIN sc USING (series_id) WHERE (i - 1) // s < n // s),
    c AS (SELECT *, sum(a) OVER (PARTITION BY series_id, win, s, seg ORDER BY i) AS c FROM (SELECT *, x - avg(x) OVER (PARTITION BY series_id, win, s, seg) AS a FROM b)),
    k AS (SELECT series_id, win, s, seg, max(c) - min(c) AS r, stddev_pop(x) AS sd FROM c GROUP BY 1, 2, 3, 4), f AS (SELECT series_id, win, s, avg(r / sd) AS f FROM k WHERE sd > 0 AND r > 0 GROUP BY 1, 2, 3),
    h AS (SELECT series_id, win, least(1, greatest(0, regr_slope(ln(f), ln(s)))) AS hurst, regr_r2(ln(f), ln(s)) AS r2, count(*) AS n_scales FROM f WHERE f > 0 GROUP BY 1, 2 HAVING count(*) >= 3)"""
SHOWN = f"SELECT series_id, win, {q6('hurst', 'hurst', 8)}, {q6('r2', 'r2', 8)}, n_scales FROM h"


def shown(h: DataFrame) -> DataFrame:
    """The compared columns of fitted exponents."""
    return h.select("series_id", "win", r6("hurst", digits=8), r6("r2", digits=8), "n_scales")


for _which, _name in (("s3", "hurst_dfa"), ("s2", "hurst_dfa_orders")):
    on_series(_name, _which, lambda s: shown(hurst.dfa(hurst.whole_series(s))), GLOBAL + GRID + DFA + " " + SHOWN)
on_series("hurst_rs", "s3", lambda s: shown(hurst.rescaled_range(hurst.whole_series(s))), GLOBAL + GRID + RS + " " + SHOWN)
ROLL_GRID = [4, 5, 7, 9, 12]


def rolled(s: DataFrame, method: str = "dfa") -> DataFrame:
    """Exponents of every 50-row window."""
    return hurst.rolling_exponents(s, method, ROLL, ROLL_STEP, ROLL_GRID)


on_series("hurst_roll_dfa", "s3", lambda s: shown(rolled(s)), WINDOWED + DFA + " " + SHOWN)
on_series("hurst_roll_rs", "s3", lambda s: shown(rolled(s, "rs")), WINDOWED + RS + " " + SHOWN)
CATEGORY = "CASE WHEN hurst < 0.4 THEN 'strong_antipersistent' WHEN hurst < 0.5 THEN 'antipersistent' WHEN hurst < 0.6 THEN 'random_walk' WHEN hurst < 0.7 THEN 'persistent' ELSE 'strong_persistent' END"
on_series(
    "hurst_category", "s3",
    lambda s: rolled(s).withColumn("state", hurst.category(F.round("hurst", 9))).groupBy("series_id", "state").agg(F.count("*").alias("n")),
    WINDOWED + DFA + f" SELECT series_id, {CATEGORY.replace('hurst', 'round(hurst, 9)')} AS state, count(*) AS n FROM h GROUP BY 1, 2",
)
MF = RESIDUALS + """, f AS (SELECT series_id, win, s, q, CASE WHEN q > 0 THEN pow(avg(pow(f2, q / 2)), 1 / q) ELSE exp(avg(ln(f2)) / 2) END AS f FROM f2, (SELECT unnest([-3.0, -1.0, 1.0, 2.0, 3.0])::DOUBLE AS q) WHERE f2 > 0 GROUP BY 1, 2, 3, 4),
    h AS (SELECT series_id, win, q, regr_slope(ln(f), ln(s)) AS h, regr_r2(ln(f), ln(s)) AS r2 FROM f WHERE f > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 3),
    a AS (SELECT *, q * h - 1 AS tau FROM h), d AS (SELECT *, (lead(tau) OVER o - lag(tau) OVER o) / (lead(q) OVER o - lag(q) OVER o) AS alpha FROM a WINDOW o AS (PARTITION BY series_id, win ORDER BY q))"""
Q_VALUES = [-3.0, -1.0, 0.0, 1.0, 2.0, 3.0]
on_series(
    "hurst_mfdfa", "s3", lambda s: hurst.mfdfa(hurst.whole_series(s), Q_VALUES).select("series_id", "q", *[r6(c, digits=7) for c in ("h", "r2", "tau", "alpha", "d")]),
    GLOBAL + GRID + MF + f" SELECT series_id, q, {q6('h', 'h', 7)}, {q6('r2', 'r2', 7)}, {q6('tau', 'tau', 7)}, {q6('alpha', 'alpha', 7)}, {q6('q * alpha - tau', 'd', 7)} FROM d",
)
on_series(
    "hurst_mf_width", "s3", lambda s: hurst.mfdfa_summary(hurst.mfdfa(hurst.whole_series(s), Q_VALUES)).select("series_id", r6("hurst", digits=7), r6("mf_width", digits=7), "mf_category"),
    GLOBAL + GRID + MF + f""" SELECT series_id, {q6("arg_min(h, abs(q - 2))", "hurst", 7)}, {q6("max(alpha) - min(alpha)", "mf_width", 7)},
    CASE WHEN max(alpha) - min(alpha) < 0.1 THEN 'monofractal' WHEN max(alpha) - min(alpha) < 0.3 THEN 'weak_multifractal' WHEN max(alpha) - min(alpha) < 0.5 THEN 'moderate_multifractal' ELSE 'strong_multifractal' END AS mf_category FROM d GROUP BY 1""",
)
# Windows with scales and q of their own: four scales from 5 to 12.
SCALED = WINDOWED.replace(str(ROLL_GRID), "[5, 7, 9, 12]")
FILLED = """, g AS (SELECT s.series_id, t, hurst AS v FROM s LEFT JOIN h ON h.series_id = s.series_id AND h.win = t),
    fl AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1
        FROM g WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
FILLED_VALUE = "coalesce(v, CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, v0, v1)"
for _m, _e in (("dfa", DFA), ("rs", RS)):
    on_series(
        f"hurst_windowed_{_m}", "s2", lambda s, m=_m: hurst.calculate_hurst(s, m, window=ROLL, step=10, min_scale=5, max_scale=40, n_scales=4).select("series_id", "t", r6("hurst", digits=8)),
        SCALED.replace(f"k * {ROLL_STEP}", "k * 10") + _e + FILLED + f" SELECT series_id, t, {q6(FILLED_VALUE, 'hurst', 8)} FROM fl",
    )
on_series(
    "hurst_roll_mfdfa", "s3", lambda s: hurst.rolling_exponents(s, "mfdfa", ROLL, 10, ROLL_GRID, Q_VALUES).select("series_id", "win", r6("hurst", digits=7), r6("mf_width", digits=7)),
    WINDOWED.replace(f"k * {ROLL_STEP}", "k * 10") + MF + f" SELECT series_id, win, {q6('arg_min(h, abs(q - 2))', 'hurst', 7)}, {q6('max(alpha) - min(alpha)', 'mf_width', 7)} FROM d GROUP BY 1, 2",
)
on_series(
    "hurst_compared", "s3", lambda s: hurst.compare_methods(s, ("dfa", "rs"), ROLL, 10).select("series_id", "t", r6("hurst_dfa", digits=8), r6("hurst_rs", digits=8)),
    "WITH a AS ({a}), b AS ({b}) SELECT series_id, t, hurst_dfa, hurst_rs FROM a JOIN b USING (series_id, t)".format(**{
        n: WINDOWED.replace(f"k * {ROLL_STEP}", "k * 10") + e + FILLED + f" SELECT series_id, t, {q6(FILLED_VALUE, f'hurst_{m}', 8)} FROM fl" for n, m, e in (("a", "dfa", DFA), ("b", "rs", RS))
    }),
)
RANKS = "list_position(list_sort(list_distinct(list(code) OVER (PARTITION BY series_id))), code)"
on_series(
    "hurst_rolling_filled", "s2", lambda s: hurst.rolling_hurst(s, "dfa", 50, 10).select("series_id", "t", r6("hurst", digits=8), "state", F.coalesce("transition", F.lit(0)).alias("transition")),
    WINDOWED.replace(f"k * {ROLL_STEP}", "k * 10") + DFA + f""", g AS (SELECT s.series_id, t, hurst AS v FROM s LEFT JOIN h ON h.series_id = s.series_id AND h.win = t),
    fl AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1
        FROM g WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    n AS (SELECT series_id, t, coalesce(v, CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, v0, v1) AS hurst FROM fl),
    c AS (SELECT *, {CATEGORY} AS state, CASE WHEN hurst < 0.4 THEN 0 WHEN hurst < 0.5 THEN 1 WHEN hurst < 0.6 THEN 2 WHEN hurst < 0.7 THEN 3 ELSE 4 END AS code FROM n),
    r2 AS (SELECT *, {RANKS} AS rank FROM c)
    SELECT series_id, t, {q6("hurst", "hurst", 8)}, state, CAST(coalesce(rank - lag(rank) OVER (PARTITION BY series_id ORDER BY t), 0) AS INT) AS transition FROM r2""",
)

# Early warnings on the daily orders themselves, with value bands as states.
STATE = "CASE WHEN value < 300 THEN 'a' WHEN value < 330 THEN 'b' WHEN value < 360 THEN 'c' ELSE 'd' END"


def stated(s: DataFrame) -> DataFrame:
    """The series with value bands as states."""
    return s.withColumn("value", F.round("value", 6)).withColumn("state", F.expr(STATE))


EWS = f"""WITH s AS (SELECT series_id, t, round(value, 6) AS value, CAST(t AS DOUBLE) AS x FROM ({{s}})), a AS (SELECT *, {STATE} AS state FROM s),
    b AS (SELECT *, row_number() OVER o AS i, quantile_cont(value, 0.05) OVER w AS q0, quantile_cont(value, 0.95) OVER w AS q1, avg(value) OVER w AS mean, lag(state) OVER o AS old
        FROM a WINDOW o AS (PARTITION BY series_id ORDER BY t), w AS (PARTITION BY series_id)),
    c AS (SELECT *, quantile_cont(abs(value - mean), 0.9) OVER (PARTITION BY series_id) AS away, covar_samp(value, x) OVER f / var_samp(x) OVER f AS slope, var_samp(value) OVER f * 29 AS yy, var_samp(x) OVER f * 29 AS xx,
        CASE WHEN i >= 30 THEN stddev_pop(value) OVER f END AS vol, CASE WHEN old IS NOT NULL AND state <> old THEN 1 ELSE 0 END AS moved, len(list_distinct(list(state) OVER k)) AS kinds
        FROM b WINDOW f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), k AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    d AS (SELECT *, quantile_cont(vol, 0.9) OVER (PARTITION BY series_id) AS volq, sum(moved) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS moves, sqrt(greatest(0, yy - slope * slope * xx) / 28 / xx) AS se FROM c),
    e AS (SELECT *, CAST(value < q0 AS INT) AS extreme_low, CAST(value > q1 AS INT) AS extreme_high,
        CAST(coalesce(i >= 30 AND abs(slope) > 2 * se AND se > 0 AND slope > away / 30, false) AS INT) AS trend_up, CAST(coalesce(i >= 30 AND abs(slope) > 2 * se AND se > 0 AND slope < -away / 30, false) AS INT) AS trend_down,
        CAST(vol > volq AS INT) AS high_volatility, CAST(i >= 20 AND (moves > 4 OR kinds >= 3) AS INT) AS flickering FROM d),
    g AS (SELECT *, 2 * extreme_low + 2 * extreme_high + 1.5 * trend_up + 1.5 * trend_down + 1.5 * high_volatility + 2 * flickering AS score FROM e),
    l AS (SELECT *, quantile_cont(CASE WHEN score > 0 THEN CAST(score AS DOUBLE) END, [0.4, 0.6, 0.8]) OVER (PARTITION BY series_id) AS q, max(score) OVER (PARTITION BY series_id) AS top FROM g),
    lv AS (SELECT *, CASE WHEN score IS NULL OR score <= 0 THEN 0 WHEN score <= q[1] + 1e-12 THEN 1 WHEN score <= q[2] + 1e-12 THEN 2 WHEN score <= q[3] + 1e-12 THEN 3 ELSE 4 END AS level FROM l)"""
FLAGS = ["extreme_low", "extreme_high", "trend_up", "trend_down", "flickering"]
on_series(
    "ews_basic", "s2", lambda s: warning.detect_warnings(stated(s)).select("series_id", "t", *FLAGS, r6("score"), "level", r6("confidence")),
    EWS + f" SELECT series_id, t, {', '.join(FLAGS)}, {q6('score', 'score')}, level, {q6('100 * score / top', 'confidence')} FROM lv",
)
on_series(
    "ews_summary", "s2", lambda s: warning.warning_summary(warning.detect_warnings(stated(s))).select("series_id", "level", "n", r6("share")),
    EWS + f", n AS (SELECT series_id, level, count(*) AS n FROM lv GROUP BY 1, 2) SELECT series_id, level, n, {q6('n / sum(n) OVER (PARTITION BY series_id)', 'share')} FROM n",
)
on_series(
    "ews_trend", "s2", lambda s: warning.recent_trend(warning.detect_warnings(stated(s))).select("series_id", "current", r6("recent"), r6("previous"), "trend"),
    EWS + f""", n AS (SELECT series_id, level, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS b FROM lv), m AS (SELECT series_id, max(CASE WHEN b = 1 THEN level END) AS current, avg(CASE WHEN b <= 20 THEN level END) AS recent, avg(CASE WHEN b > 20 AND b <= 40 THEN level END) AS previous FROM n GROUP BY 1)
    SELECT series_id, current, {q6("recent", "recent")}, {q6("previous", "previous")}, CASE WHEN recent > previous THEN 'increasing' WHEN recent < previous THEN 'decreasing' ELSE 'stable' END AS trend FROM m""",
)
TEN = [*warning.WEIGHTS]
# The four further indicators and the boost.  A list holds the last 100 values; mid-points are 49.5.
_TAPER = "[" + ", ".join(repr(0.5 * (1 - math.cos(math.pi * (2 * e + 1) / 20)) if e < 10 else 1.0) for e in (min(i, 99 - i) for i in range(100))) + "]"
_WAVE = {f: [[round(g(2 * math.pi * k * i / 100), 15) + 0.0 for i in range(100)] for k in range(1, 51)] for f, g in (("cos", math.cos), ("sin", math.sin))}
_SQUARES = sum((i - 49.5) ** 2 for i in range(100))


def _memory(d: str) -> str:
    """The mean autocorrelation at lags 1 to 5 of a list of 50 deviations."""
    return f"({' + '.join(f'list_inner_product({d}[1:{50 - k}], {d}[{k + 1}:50])' for k in range(1, 6))}) / list_inner_product({d}, {d}) / 5"


EWS_FULL = EWS.split(",\n    g AS (SELECT *, 2 * extreme_low")[0] + f""",
    f1 AS (SELECT *, value - lag(value, 1) OVER o AS d1, value - lag(value, 2) OVER o AS d2, value - lag(value, 4) OVER o AS d4, list(value) OVER h AS last, moved + CASE WHEN old IS NULL THEN 1 ELSE 0 END AS fresh
        FROM e WINDOW o AS (PARTITION BY series_id ORDER BY t), h AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
    f2 AS (SELECT *, var_samp(d1) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 58 PRECEDING AND CURRENT ROW) AS v1, var_samp(d2) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 57 PRECEDING AND CURRENT ROW) / 2 AS v2,
        var_samp(d4) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 55 PRECEDING AND CURRENT ROW) / 4 AS v4, sum(fresh) OVER (PARTITION BY series_id ORDER BY t) AS run FROM f1),
    f3 AS (SELECT *, count(*) OVER (PARTITION BY series_id, run) AS len FROM f2), rl AS (SELECT series_id, quantile_cont(len, 0.9) AS lenq FROM (SELECT DISTINCT series_id, run, len FROM f3) GROUP BY 1),
    f4 AS (SELECT series_id, t, last AS x, list_avg(last) AS pm, list_inner_product(last, ft) / {_SQUARES} AS ps, list_avg(last[51:100]) AS m1, list_avg(last[1:50]) AS m0, ft, tp
        FROM f3, (SELECT {[i - 49.5 for i in range(100)]}::DOUBLE[] AS ft, {_TAPER}::DOUBLE[] AS tp) WHERE len(last) = 100),
    f5 AS (SELECT series_id, t, list_transform(x[51:100], lambda v: v - m1) AS e1, list_transform(x[1:50], lambda v: v - m0) AS e0, list_transform(range(1, 101), lambda i: (x[i] - pm - ps * ft[i]) * tp[i]) AS y FROM f4),
    f6 AS (SELECT series_id, t, y, {_memory("e1")} AS a1, {_memory("e0")} AS a0 FROM f5),
    wv AS (SELECT unnest(range(1, 51)) AS k, unnest({_WAVE["cos"]}::DOUBLE[][]) AS c, unnest({_WAVE["sin"]}::DOUBLE[][]) AS s),
    f7 AS (SELECT series_id, t, k, pow(list_inner_product(y, c), 2) + pow(list_inner_product(y, s), 2) AS power FROM f6, wv),
    f8 AS (SELECT series_id, t, arg_max(k, power) AS peak FROM f7 GROUP BY 1, 2),
    f9 AS (SELECT f3.*, CAST(coalesce(i >= 60 AND v1 > 0 AND (abs(v2 / nullif(v1, 0) - 1) > 0.5 OR abs(v4 / nullif(v1, 0) - 1) > 0.5), false) AS INT) AS variance_ratio, CAST(coalesce(100.0 / peak > 20, false) AS INT) AS spectral_shift,
        CAST(coalesce(a1 > a0 + 0.2, false) AS INT) AS autocorr_increase, CAST(len > lenq AS INT) AS state_persistence
        FROM f3 JOIN rl USING (series_id) LEFT JOIN f6 ON f6.series_id = f3.series_id AND f6.t = f3.t LEFT JOIN f8 ON f8.series_id = f3.series_id AND f8.t = f3.t),
    g0 AS (SELECT *, 2 * extreme_low + 2 * extreme_high + 1.5 * trend_up + 1.5 * trend_down + 1.5 * high_volatility + 2 * flickering + variance_ratio + spectral_shift + 1.5 * autocorr_increase + state_persistence AS raw, count(*) OVER (PARTITION BY series_id) AS rows FROM f9),
    g1 AS (SELECT *, avg(CASE WHEN raw > 0 THEN 1.0 WHEN raw <= 0 THEN 0.0 END) OVER b AS share, count(raw) OVER b AS known FROM g0 WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
    g AS (SELECT *, CASE WHEN i > 10 AND i <= rows - 10 THEN CASE WHEN known = 21 THEN raw * (1 + share) END ELSE raw END AS score FROM g1),
    l AS""" + EWS.split("\n    l AS", 1)[1]
on_series(
    "ews_full", "s2", lambda s: warning.detect_warnings(stated(s), full=True).select("series_id", "t", *[F.coalesce(c, F.lit(0)).alias(c) for c in TEN], r6("score"), "level"),
    EWS_FULL + f" SELECT series_id, t, {', '.join(f'coalesce({c}, 0) AS {c}' for c in TEN)}, {q6('score', 'score')}, level FROM lv",
)
