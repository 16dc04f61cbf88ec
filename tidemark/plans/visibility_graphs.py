"""Queries of visibility graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, visibility
from .registry import on_series, q6, r6
from .scaling_states import BANDS

PAIRS = """WITH s AS ({s}), p AS (SELECT a.series_id, a.t AS src, b.t AS dst, a.value AS x, b.value AS y, (b.value - a.value) / (b.t - a.t) AS slope
    FROM s a JOIN s b ON a.series_id = b.series_id AND a.t < b.t)"""
BETWEEN = "OVER (PARTITION BY series_id, src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
NVG = f"{PAIRS}, v AS (SELECT *, max(slope) {BETWEEN} AS m FROM p), e AS (SELECT series_id, src, dst, 1.0 AS weight FROM v WHERE m IS NULL OR m < slope)"
HVG = f"{PAIRS}, v AS (SELECT *, max(y) {BETWEEN} AS m FROM p), e AS (SELECT series_id, src, dst, 1.0 AS weight FROM v WHERE m IS NULL OR m < least(x, y))"
EDGES = "SELECT series_id, src, dst, CAST(weight AS DOUBLE) AS weight FROM e"
on_series("vg_nvg", "s1", lambda s: visibility.visibility_edges(s), f"{NVG} {EDGES}")
on_series("vg_hvg", "s1", lambda s: visibility.visibility_edges(s, "hvg"), f"{HVG} {EDGES}")
on_series(
    "vg_lpvg", "s1", lambda s: visibility.visibility_edges(s, penetrable=1),
    f"{PAIRS}, v AS (SELECT *, len(list_filter(coalesce(list(slope) {BETWEEN}, []), lambda h: h >= slope)) AS m FROM p), e AS (SELECT series_id, src, dst, 1.0 AS weight FROM v WHERE m <= 1) {EDGES}",
)
on_series(
    "vg_lphvg", "s1", lambda s: visibility.visibility_edges(s, "hvg", penetrable=2),
    f"{PAIRS}, v AS (SELECT *, len(list_filter(coalesce(list(y) {BETWEEN}, []), lambda h: h >= least(x, y))) AS m FROM p), e AS (SELECT series_id, src, dst, 1.0 AS weight FROM v WHERE m <= 2) {EDGES}",
)
on_series(
    "vg_decay", "s1", lambda s: visibility.visibility_edges(s, decay=0.1).select("series_id", "src", "dst", r6("weight")),
    f"{NVG} SELECT series_id, src, dst, {q6('exp(-0.1 * (dst - src))', 'weight')} FROM e",
)
on_series("vg_limit_directed", "s1", lambda s: visibility.visibility_edges(s, limit=5), f"{NVG} {EDGES} WHERE dst - src <= 5")
STATED = f", x AS (SELECT series_id, t, {BANDS} AS state FROM s), j AS (SELECT e.series_id, a.state AS f, b.state AS g, exp(-0.1 * (dst - src)) AS w FROM e JOIN x a ON a.series_id = e.series_id AND a.t = src JOIN x b ON b.series_id = e.series_id AND b.t = dst)"
for _how, _sql in {"sum": "sum(w)", "mean": "avg(w)", "max": "max(w)", "count": "count(*)"}.items():
    on_series(
        f"vg_state_{_how}", "s1",
        lambda s, h=_how: visibility.by_state(visibility.visibility_edges(s, decay=0.1), s.withColumn("state", F.expr(BANDS)), h).select("series_id", "from_state", "to_state", r6("weight")),
        f"{NVG}{STATED} SELECT series_id, f AS from_state, g AS to_state, {q6(_sql, 'weight')} FROM j GROUP BY 1, 2, 3",
    )
on_series(
    "vg_state_undirected", "s1",
    lambda s: visibility.by_state(visibility.visibility_edges(s, decay=0.1), s.withColumn("state", F.expr(BANDS)), "sum", directed=False).select("series_id", "from_state", "to_state", r6("weight")),
    f"{NVG}{STATED}, u AS (SELECT * FROM j UNION ALL SELECT series_id, g, f, w FROM j) SELECT series_id, f AS from_state, g AS to_state, {q6('2 * sum(w)', 'weight')} FROM u GROUP BY 1, 2, 3",
)
on_series(
    "vg_value", "s3", lambda s: visibility.by_value(visibility.visibility_edges(s, "hvg"), s, "count").select("series_id", F.col("from_state").cast("double").alias("from_value"), F.col("to_state").cast("double").alias("to_value"), "weight"),
    HVG + """ SELECT e.series_id, a.value AS from_value, b.value AS to_value, CAST(count(*) AS DOUBLE) AS weight FROM e
    JOIN s a ON a.series_id = e.series_id AND a.t = src JOIN s b ON b.series_id = e.series_id AND b.t = dst GROUP BY 1, 2, 3""",
)
on_series(
    "vg_degree", "s1", lambda s: visibility.degrees(visibility.visibility_edges(s, decay=0.1)).select("series_id", "t", "degree", r6("strength")),
    f"""{NVG}, b AS (SELECT series_id, src AS t, exp(-0.1 * (dst - src)) AS w FROM e UNION ALL SELECT series_id, dst, exp(-0.1 * (dst - src)) FROM e)
    SELECT series_id, t, count(*) AS degree, {q6("sum(w)", "strength")} FROM b GROUP BY 1, 2""",
)
# A long series with times before and after zero: blocks that show each other outlines.
LONG = "SELECT series_id, 3 * t - 1000 AS t, value FROM (%s)"
for _name, _kind, _edges in (("vg_long", "nvg", NVG), ("vg_long_hvg", "hvg", HVG)):
    on_series(
        _name, "s2", lambda s, k=_kind: visibility.visibility_edges(s.withColumn("t", 3 * F.col("t") - 1000), k, long=True),
        _edges.replace("({s})", "(" + LONG % "{s}" + ")") + f" {EDGES}",
    )
LINKS = ", l AS (SELECT series_id, src AS u, dst AS v FROM e UNION ALL SELECT series_id, dst, src FROM e)"
on_series("vg_communities", "s1", lambda s: graphs.communities(visibility.visibility_edges(s)))
on_series(
    "vg_paths", "s1", lambda s: graphs.path_centralities(visibility.visibility_edges(s)).select("series_id", "node", "reached", *[r6(c, digits=8) for c in ("closeness", "harmonic", "betweenness")]),
    "WITH RECURSIVE " + NVG.removeprefix("WITH ") + LINKS + f""", b(series_id, s, v, d, paths) USING KEY (series_id, s, v) AS (SELECT DISTINCT series_id, u, u, CAST(0 AS BIGINT), CAST(1 AS DOUBLE) FROM l
        UNION SELECT b.series_id, b.s, l.v, any_value(b.d) + 1, sum(b.paths) FROM b JOIN l ON l.series_id = b.series_id AND l.u = b.v LEFT JOIN recurring.b o ON o.series_id = b.series_id AND o.s = b.s AND o.v = l.v WHERE o.v IS NULL GROUP BY 1, 2, 3),
    t AS (SELECT x.series_id, x.v AS node, sum(x.paths * y.paths / z.paths) / 2 AS through FROM b x JOIN b y ON y.series_id = x.series_id AND y.s = x.v AND x.s <> x.v AND y.v <> x.v
        JOIN b z ON z.series_id = x.series_id AND z.s = x.s AND z.v = y.v AND z.d = x.d + y.d GROUP BY 1, 2)
    SELECT b.series_id, s AS node, count(*) AS reached, {q6("count(*) / sum(d)", "closeness", 8)}, {q6("sum(1 / d)", "harmonic", 8)}, {q6("coalesce(any_value(through), 0)", "betweenness", 8)}
    FROM b LEFT JOIN t ON t.series_id = b.series_id AND t.node = b.s WHERE d > 0 GROUP BY 1, 2""",
)
on_series(
    "vg_clustering", "s2", lambda s: graphs.clustering(visibility.visibility_edges(s, long=True)).select("series_id", "node", "degree", "triangles", r6("clustering")),
    NVG + LINKS + f""", g AS (SELECT series_id, u, count(*) AS n FROM l GROUP BY 1, 2),
    t AS (SELECT a.series_id, a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON b.series_id = a.series_id AND b.src = a.dst JOIN e c ON c.series_id = a.series_id AND c.src = a.src AND c.dst = b.dst),
    k AS (SELECT series_id, unnest([x, y, z]) AS u FROM t), n AS (SELECT series_id, u, count(*) AS t FROM k GROUP BY 1, 2)
    SELECT g.series_id, g.u AS node, n AS degree, coalesce(t, 0) AS triangles, {q6("CASE WHEN n > 1 THEN 2 * coalesce(t, 0) / (n * (n - 1)) END", "clustering")} FROM g LEFT JOIN n ON n.series_id = g.series_id AND n.u = g.u""",
)
