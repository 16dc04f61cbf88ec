"""Queries of windows, distances, similarities and proximity networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import correlation
from ..operators import discretize, proximity
from .registry import on_series, q6, query, r6, r6_of_many, src

SIZE, STEP = 60, 40
WIN = f"""WITH s AS ({{s}}), w AS (SELECT series_id, i + 1 AS window_id, i * {STEP} + 1 AS start_t, i * {STEP} + {SIZE} AS end_t, list(value ORDER BY t) AS x
    FROM s JOIN range(0, 1000) g(i) ON t BETWEEN i * {STEP} + 1 AND i * {STEP} + {SIZE} GROUP BY series_id, i HAVING count(*) = {SIZE})"""
PAIRS = f"{WIN}, p AS (SELECT a.series_id, a.window_id AS src, b.window_id AS dst, a.x AS x, b.x AS y FROM w a JOIN w b ON a.series_id = b.series_id AND a.window_id < b.window_id)"
IDX = f"range(1, {SIZE + 1})"
RANKED = "list_transform({v}, lambda p: len(list_filter({v}, lambda q: q < p)) + (len(list_filter({v}, lambda q: q = p)) + 1) / 2.0)"


def corr_sql(x: str, y: str) -> str:
    """One minus the absolute correlation of two lists."""
    a, b = f"({x})[i] - list_avg({x})", f"({y})[i] - list_avg({y})"
    s = lambda e: f"list_sum(list_transform({IDX}, lambda i: {e}))"
    return f"1 - abs({s(f'({a}) * ({b})')} / sqrt({s(f'({a}) * ({a})')} * {s(f'({b}) * ({b})')}))"


METRIC_SQL = {
    "euclidean": f"sqrt(list_sum(list_transform({IDX}, lambda i: (x[i] - y[i]) * (x[i] - y[i]))))",
    "manhattan": f"list_sum(list_transform({IDX}, lambda i: abs(x[i] - y[i])))",
    "cosine": f"1 - list_sum(list_transform({IDX}, lambda i: x[i] * y[i])) / (sqrt(list_sum(list_transform(x, lambda a: a * a))) * sqrt(list_sum(list_transform(y, lambda a: a * a))))",
    "minkowski3": f"pow(list_sum(list_transform({IDX}, lambda i: pow(abs(x[i] - y[i]), 3))), 1 / 3.0)",
    "chebyshev": f"list_max(list_transform({IDX}, lambda i: abs(x[i] - y[i])))",
    "canberra": f"list_sum(list_transform({IDX}, lambda i: CASE WHEN abs(x[i]) + abs(y[i]) > 0 THEN abs(x[i] - y[i]) / (abs(x[i]) + abs(y[i])) ELSE 0 END))",
    "pearson": corr_sql("x", "y"),
}


def win(s: DataFrame) -> DataFrame:
    """The windows that the queries compare."""
    return proximity.windows(s, SIZE, STEP)


for _m, _e in METRIC_SQL.items():
    _name, _options = ("minkowski", {"p": 3.0}) if _m == "minkowski3" else (_m, {})
    on_series(
        f"dist_{_m}", "s2", lambda s, n=_name, o=_options: proximity.pairwise(win(s), n, **o).select("series_id", "src", "dst", r6("distance", digits=7)),
        f"{PAIRS} SELECT series_id, src, dst, {q6(_e, 'distance', 7)} FROM p",
    )
on_series(
    "dist_spearman", "s2", lambda s: proximity.pairwise(win(s), "spearman").select("series_id", "src", "dst", r6("distance", digits=7)),
    PAIRS.replace("), p AS (SELECT a.series_id", f"), k AS (SELECT *, {RANKED.format(v='x')} AS r FROM w), p AS (SELECT a.series_id, a.r AS rx, b.r AS ry").replace("FROM w a JOIN w b", "FROM k a JOIN k b")
    + f" SELECT series_id, src, dst, {q6(corr_sql('rx', 'ry'), 'distance', 7)} FROM p",
)


def tau_sql(size: int) -> str:
    """One minus the absolute tau-b of two lists of one size."""
    places = f"range(1, {size}), lambda i: list_sum(list_transform(range(i + 1, {size + 1}), lambda j: {{e}}))"
    total = lambda e: f"list_sum(list_transform({places.format(e=e)}))"
    dx, dy = "sign(x[i] - x[j])", "sign(y[i] - y[j])"
    return f"1 - abs({total(f'{dx} * {dy}')} / sqrt({total(f'{dx} * {dx}')} * {total(f'{dy} * {dy}')}))"


on_series(
    "dist_kendall", "s2", lambda s: proximity.pairwise(win(s), "kendall").select("series_id", "src", "dst", r6("distance", digits=7)),
    f"{PAIRS} SELECT series_id, src, dst, {q6(tau_sql(SIZE), 'distance', 7)} FROM p",
)


def tested(vectors: DataFrame, method: str, kind: str) -> DataFrame:
    """Correlation and p of all pairs of windows."""
    a = vectors.select("series_id", F.col("window_id").alias("src"), "x")
    b = vectors.select("series_id", F.col("window_id").alias("dst"), F.col("x").alias("y"))
    met = a.join(b, "series_id").where("src < dst").withColumn("c", correlation.correlation_test(F.col("x"), F.col("y"), method, kind))
    return met.select("series_id", "src", "dst", r6("c.correlation", "correlation", 7), r6("c.p_value", "p_value", 7))


# Student's distribution with an even number of degrees of freedom is a finite sum over (1 - r r).
STUDENT = f"1 - abs(r) * (1 + list_sum(list_transform(range(1, {SIZE // 2 - 1}), lambda k: list_product(list_transform(range(1, k + 1), lambda j: (2 * j - 1) / (2.0 * j) * (1 - r * r))))))"


def raw_sql(x: str, y: str) -> str:
    """The correlation of two lists."""
    return corr_sql(x, y).removeprefix("1 - abs(").removesuffix(")")


for _m, _kind, _shown in (("pearson", "raw", "r"), ("pearson", "absolute", "abs(r)"), ("spearman", "negative", "least(0, r)"), ("spearman", "positive", "greatest(0, r)")):
    _ranked = PAIRS.replace("), p AS (SELECT a.series_id", f"), k AS (SELECT *, {RANKED.format(v='x')} AS r FROM w), p AS (SELECT a.series_id, a.r AS rx, b.r AS ry").replace("FROM w a JOIN w b", "FROM k a JOIN k b")
    _r = raw_sql("x", "y") if _m == "pearson" else raw_sql("rx", "ry")
    on_series(
        f"cor_test_{_m}_{_kind}", "s2", lambda s, m=_m, k=_kind: tested(win(s), m, k),
        (PAIRS if _m == "pearson" else _ranked) + f", c AS (SELECT series_id, src, dst, {_r} AS r FROM p) SELECT series_id, src, dst, {q6(_shown, 'correlation', 7)}, {q6(STUDENT, 'p_value', 7)} FROM c",
    )
on_series("cor_test_kendall", "s2", lambda s: tested(win(s), "kendall", "raw"))
SHORT = 20


def warp_sql(diagonal: int) -> str:
    """Warping of windows of SHORT rows: a step of the recursion is a diagonal of the cost table, held by its rows."""
    infinite = f"list_transform(range({SHORT}), lambda i: CAST('inf' AS DOUBLE))"
    cost, at = "abs(x[i] - y[k + 1 - i])", lambda v, i: f"coalesce({v}[{i}], CAST('inf' AS DOUBLE))"
    cell = f"least({at('p1', 'i - 1')} + {cost}, {at('p1', 'i')} + {cost}, {at('p2', 'i - 1')} + {diagonal} * {cost})"
    return f"""WITH RECURSIVE s AS ({{s}}), w AS (SELECT series_id, (t - 1) // {SHORT} + 1 AS window_id, list(value ORDER BY t) AS x FROM s GROUP BY 1, 2 HAVING count(*) = {SHORT}),
        d(series_id, src, dst, x, y, k, p1, p2) AS (SELECT a.series_id, a.window_id, b.window_id, a.x, b.x, 2, list_transform(range(1, {SHORT + 1}), lambda i: CASE WHEN i = 1 THEN abs(a.x[1] - b.x[1]) ELSE CAST('inf' AS DOUBLE) END), {infinite}
            FROM w a JOIN w b ON a.series_id = b.series_id AND a.window_id < b.window_id
            UNION ALL SELECT series_id, src, dst, x, y, k + 1, list_transform(range(1, {SHORT + 1}), lambda i: CASE WHEN k + 1 - i BETWEEN 1 AND {SHORT} THEN {cell} ELSE CAST('inf' AS DOUBLE) END), p1 FROM d WHERE k < {2 * SHORT})
        SELECT series_id, src, dst, {q6(f"p1[{SHORT}]", "distance", 7)} FROM d WHERE k = {2 * SHORT}"""


for _m, _diagonal in (("dtw", 1), ("dtw_symmetric2", 2)):
    on_series(f"dist_{_m}", "s2", lambda s, m=_m: proximity.pairwise(proximity.windows(s, SHORT), m).select("series_id", "src", "dst", r6("distance", digits=7)), warp_sql(_diagonal))
on_series(
    "dist_consecutive", "s3", lambda s: proximity.pairwise(win(s), "euclidean", consecutive=True).select("series_id", "src", "dst", r6("distance", digits=7)),
    f"{PAIRS} SELECT series_id, src, dst, {q6(METRIC_SQL['euclidean'], 'distance', 7)} FROM p WHERE dst = src + 1",
)
on_series(
    "windows", "s3", lambda s: win(s).select("series_id", "window_id", "start_t", "end_t", r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), "total")),
    f"{WIN} SELECT series_id, window_id, start_t, end_t, {q6('list_sum(x)', 'total')} FROM w",
)
on_series(
    "point_map", "s2", lambda s: proximity.point_map(s, win(s)),
    f"""{WIN} SELECT s.series_id, t, count(window_id) AS n_windows, coalesce(string_agg(CAST(window_id AS VARCHAR), ',' ORDER BY window_id), '') AS window_ids
    FROM s LEFT JOIN w ON s.series_id = w.series_id AND t BETWEEN start_t AND end_t GROUP BY 1, 2""",
)


@query(
    "dist_embeddings",
    f"""WITH e AS (SELECT vec_id, label, embedding AS x FROM embeddings) SELECT a.vec_id AS src, b.vec_id AS dst,
    {q6("sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.x[i] AS DOUBLE) - b.x[i]) * (CAST(a.x[i] AS DOUBLE) - b.x[i]))))", "distance", 7)} FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id""",
)
def dist_embeddings(spark, sf_dir):
    """Pairs of the embeddings of each label: a label is the group that pairs form in."""
    e = src.read(spark, sf_dir, "embeddings")
    v = e.select(F.col("label").cast("string").alias("series_id"), F.col("vec_id").alias("window_id"), F.col("embedding").alias("x"))
    return proximity.pairwise_by_blocks(v, named=False).select("src", "dst", r6_of_many("distance", 7))


EDGES = f"{PAIRS}, e AS (SELECT series_id, src, dst, {METRIC_SQL['euclidean']} AS distance FROM p), m AS (SELECT max(distance) AS mx, quantile_cont(distance, 0.5) AS sg, quantile_cont(distance, 0.25) AS q25, quantile_cont(distance, 0.2) AS q20 FROM e WHERE distance > 0)"


def edges(s: DataFrame) -> DataFrame:
    """Euclidean distances of all pairs of windows."""
    return proximity.pairwise(win(s), "euclidean")


on_series(
    "dist_summary", "s2", lambda s: proximity.distance_summary(edges(s)).select("series_id", "n", "zeros", "scale", "recommended", *[r6(c, digits=7) for c in ("min", "max", "mean", "sd", "q25", "median", "q75", "range")]),
    f"""{EDGES} SELECT series_id, count(*) AS n, CAST(sum(CASE WHEN distance = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros,
    CASE WHEN max(distance) > 1000 THEN 'very large' WHEN max(distance) > 100 THEN 'large' WHEN max(distance) > 10 THEN 'medium' ELSE 'small' END AS scale,
    CASE WHEN max(distance) > 1000 THEN 'knn' WHEN max(distance) > 100 THEN 'percentile' ELSE 'threshold' END AS recommended,
    {q6("min(distance)", "min", 7)}, {q6("max(distance)", "max", 7)}, {q6("avg(distance)", "mean", 7)}, {q6("stddev_samp(distance)", "sd", 7)}, {q6("quantile_cont(distance, 0.25)", "q25", 7)},
    {q6("quantile_cont(distance, 0.5)", "median", 7)}, {q6("quantile_cont(distance, 0.75)", "q75", 7)}, {q6("max(distance) - min(distance)", "range", 7)} FROM e GROUP BY 1""",
)
SIM_SQL = {
    "normalized_inverse": "1 - distance / mx", "inverse": "1 / (1 + distance)", "negative_exp": "exp(-distance / sg)", "max_minus": "(mx - distance) / mx",
    "gaussian": "exp(-distance * distance / (2 * sg * sg))", "reciprocal": "CASE WHEN distance > 0 THEN 1 / distance ELSE 0 END",
}
for _m, _e in SIM_SQL.items():
    on_series(f"sim_{_m}", "s2", lambda s, m=_m: proximity.similarity(edges(s), m).select("src", "dst", r6("similarity", digits=8)), f"{EDGES} SELECT src, dst, {q6(_e, 'similarity', 8)} FROM e, m")
NORM = f"{EDGES}, v AS (SELECT src, dst, 1 / (1 + distance) AS x FROM e), c AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mean, stddev_samp(x) AS sd, quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.95) AS q95 FROM v), d AS (SELECT 1.4826 * quantile_cont(abs(x - med), 0.5) AS mad FROM v, c), n AS (SELECT src, dst, {{e}} AS y FROM v, c, d)"
STRETCH = "(y - least(0, min(y) OVER ())) / (greatest(0, max(y) OVER ()) - least(0, min(y) OVER ()))"
for _m, (_e, _s) in {
    "minmax": ("(x - lo) / (hi - lo)", STRETCH), "max": ("x / hi", STRETCH), "zscore": ("(x - mean) / sd", "y"), "robust": ("(x - med) / mad", "y"), "quantile": ("(x - q05) / (q95 - q05)", STRETCH),
}.items():
    on_series(
        f"norm_{_m}", "s2", lambda s, m=_m: proximity.normalize(proximity.similarity(edges(s), "inverse"), method=m).select("src", "dst", r6("normalized", digits=8)),
        NORM.replace("{e}", _e) + f" SELECT src, dst, {q6(_s, 'normalized', 8)} FROM n",
    )
on_series(
    "plot_weights", "s2", lambda s: proximity.prepare_plot(edges(s), cut=0.3).select("src", "dst", r6("weight", digits=8)),
    f"""{EDGES}, v AS (SELECT src, dst, 1 - distance / mx AS x FROM e, m), c AS (SELECT min(x) AS lo, max(x) AS hi FROM v WHERE x <> 0),
    n AS (SELECT src, dst, CASE WHEN x = 0 THEN 0 ELSE (x - lo) / (hi - lo) END AS y FROM v, c), z AS (SELECT src, dst, {STRETCH} AS y FROM n), k AS (SELECT quantile_cont(y, 0.3) AS cut FROM z WHERE y > 0)
    SELECT src, dst, {q6("CASE WHEN y >= cut THEN y ELSE 0 END", "weight", 8)} FROM z, k""",
)
NET_SQL = {
    "full": f"SELECT src, dst, {q6('1 - distance / mx', 'weight', 8)} FROM e, m WHERE 1 - distance / mx > 0",
    "epsilon": f"SELECT src, dst, {q6('1 / (1 + distance)', 'weight', 8)} FROM e WHERE distance > 0 AND distance <= 300",
    "threshold": f"SELECT src, dst, {q6('1 / (1 + distance)', 'weight', 8)} FROM e, m WHERE distance > 0 AND distance <= q25",
    "percentile": f"SELECT src, dst, {q6('1 / (1 + distance)', 'weight', 8)} FROM e, m WHERE distance > 0 AND distance <= q20",
    "gaussian": f"SELECT src, dst, {q6('exp(-distance * distance / (2 * sg * sg))', 'weight', 8)} FROM e, m",
    "knn": f""", b AS (SELECT src, dst, distance FROM e UNION ALL SELECT dst, src, distance FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS r FROM b WHERE distance > 0)
        SELECT least(src, dst) AS src, greatest(src, dst) AS dst, {q6("max(1 / (1 + distance))", "weight", 8)} FROM r WHERE r <= 3 GROUP BY 1, 2""",
}
for _m, _e in NET_SQL.items():
    on_series(f"net_{_m}", "s2", lambda s, m=_m: proximity.build_network(edges(s), m, k=3, epsilon=300.0).select("src", "dst", r6("weight", digits=8)), EDGES + " " + _e)
for _m in ("epsilon", "knn"):
    on_series(f"net_{_m}_indexed", "s2", lambda s, m=_m: proximity.indexed_network(win(s), m, k=3, epsilon=300.0).select("src", "dst", r6("weight", digits=8)), EDGES + " " + NET_SQL[_m])
on_series(
    "net_gaussian_normalized", "s2", lambda s: proximity.build_network(edges(s), "gaussian", normalized=True).select("src", "dst", r6("weight", digits=8)),
    EDGES + f""", d AS (SELECT src, dst, distance / (SELECT mx FROM m) AS v FROM e), g AS (SELECT quantile_cont(v, 0.5) AS sn FROM d WHERE v > 0) SELECT src, dst, {q6("exp(-v * v / (2 * sn * sn))", "weight", 8)} FROM d, g""",
)
on_series("net_recommend", "s2", lambda s: proximity.recommend(edges(s)).select("series_id", "method", "alternative", r6("value", digits=7)), f"""{EDGES} SELECT DISTINCT e.series_id, 'full' AS method,
    CASE WHEN mx > 1000 THEN 'knn' WHEN mx > 100 THEN 'percentile' ELSE 'threshold' END AS alternative, {q6("CASE WHEN mx > 1000 THEN 5.0 WHEN mx > 100 THEN 0.2 ELSE q25 END", "value", 7)} FROM e, m""")
COMP = f"""{EDGES.replace("WITH s", "WITH RECURSIVE s")}, k AS (SELECT src, dst FROM e, m WHERE distance > 0 AND distance <= q20), l AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k),
    reach(a, b) AS (SELECT window_id, window_id FROM w UNION SELECT reach.a, l.dst FROM reach JOIN l ON reach.b = l.src), comp AS (SELECT a AS window_id, min(b) AS component FROM reach GROUP BY 1)"""
on_series(
    "net_components", "s2", lambda s: proximity.components(win(s), proximity.build_network(edges(s), "percentile")).select("window_id", "component"),
    f"{COMP} SELECT window_id, component FROM comp",
)
on_series(
    "net_stats", "s2", lambda s: proximity.network_stats(win(s), proximity.build_network(edges(s), "percentile")).select("series_id", "n_nodes", "n_edges", r6("density"), "n_components", "connected"),
    f"""{COMP} SELECT 'orders' AS series_id, (SELECT count(*) FROM w) AS n_nodes, (SELECT count(*) FROM k) AS n_edges,
    round(2.0 * (SELECT count(*) FROM k) / ((SELECT count(*) FROM w) * ((SELECT count(*) FROM w) - 1)), 9) + 0.0 AS density, count(DISTINCT component) AS n_components, count(DISTINCT component) = 1 AS connected FROM comp""",
)


def lagged(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A series and itself three rows later."""
    return s, s.withColumn("t", F.col("t") + 3)


CCF = """WITH s AS ({s}), j AS (SELECT a.series_id, a.t, a.value AS x, b.value AS y FROM s a JOIN (SELECT series_id, t + 3 AS t, value FROM s) b ON a.series_id = b.series_id AND a.t = b.t),
    st AS (SELECT series_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM j GROUP BY 1),
    c AS (SELECT a.series_id, k AS lag, sum((a.x - mx) * (b.y - my) / (n * sx * sy)) AS ccf FROM st JOIN range(-10, 11) g(k) ON true JOIN j a ON a.series_id = st.series_id JOIN j b ON b.series_id = a.series_id AND b.t = a.t - k GROUP BY 1, 2)"""
on_series(
    "ccf_all", "s3", lambda s: proximity.cross_correlation(*lagged(s), max_lag=10, pick="all").select("series_id", F.col("lag").cast("long").alias("lag"), r6("ccf")),
    f"{CCF} SELECT series_id, lag, {q6('ccf', 'ccf')} FROM c",
)
on_series(
    "ccf_max", "s3", lambda s: proximity.cross_correlation(*lagged(s), max_lag=10).select("series_id", F.col("lag").cast("long").alias("lag"), r6("ccf")),
    f"{CCF} SELECT series_id, lag, {q6('ccf', 'ccf')} FROM c QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(abs(ccf), 12) DESC, lag) = 1",
)


def _information(s: DataFrame) -> DataFrame:
    pair = discretize.discretize_pair(*lagged(s), 4, "equal_width")
    return proximity.mutual_information(pair).select("series_id", r6("nmi"), r6("voi"))


on_series(
    "nmi_voi", "s3", _information,
    f"""WITH s AS ({{s}}), q AS (SELECT series_id, [{", ".join(f"round(min(value) + (max(value) - min(value)) * {i / 4}, 10)" for i in range(5))}] AS b FROM s GROUP BY 1),
    z AS (SELECT series_id, t, 1 + len(list_filter(b[2:4], lambda c: value > c)) AS st FROM s JOIN q USING (series_id)),
    j AS (SELECT x.series_id, x.st AS a, y.st AS b, count(*) AS n FROM z x JOIN z y ON x.series_id = y.series_id AND x.t = y.t + 3 GROUP BY 1, 2, 3),
    p AS (SELECT series_id, n / sum(n) OVER (PARTITION BY series_id) AS p, sum(n) OVER (PARTITION BY series_id, a) / sum(n) OVER (PARTITION BY series_id) AS pa, sum(n) OVER (PARTITION BY series_id, b) / sum(n) OVER (PARTITION BY series_id) AS pb FROM j),
    h AS (SELECT series_id, sum(p * ln(p / (pa * pb))) AS i, -sum(p * ln(p)) AS hab, -sum(p * ln(pa)) AS ha, -sum(p * ln(pb)) AS hb FROM p GROUP BY 1)
    SELECT series_id, {q6("i / greatest(ha, hb)", "nmi")}, {q6("1 - i / hab", "voi")} FROM h""",
)
SPIKES = "WITH s AS ({s}), a AS (SELECT series_id, CAST(t AS DOUBLE) AS tm FROM s WHERE value > 60), b AS (SELECT series_id, CAST(t AS DOUBLE) + 0.3 AS tm FROM s WHERE value < 12)"


def spikes(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """High and low values' places as two event trains."""
    at = F.col("t").cast("double")
    return s.where("value > 60").select("series_id", at.alias("at")), s.where("value < 12").select("series_id", (at + 0.3).alias("at"))


on_series(
    "event_sync", "s1", lambda s: proximity.event_synchronisation(*spikes(s), 1.0).select("series_id", r6("es")),
    f"""{SPIKES}, x AS (SELECT series_id, avg(CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.series_id = a.series_id AND abs(a.tm - b.tm) <= 1) THEN 1.0 ELSE 0 END) AS p FROM a GROUP BY 1),
    y AS (SELECT series_id, avg(CASE WHEN EXISTS (SELECT 1 FROM a WHERE b.series_id = a.series_id AND abs(a.tm - b.tm) <= 1) THEN 1.0 ELSE 0 END) AS q FROM b GROUP BY 1)
    SELECT series_id, {q6("(p + q) / 2", "es")} FROM x JOIN y USING (series_id)""",
)
on_series(
    "van_rossum", "s1", lambda s: proximity.van_rossum(*spikes(s), 2.0).select("series_id", r6("distance", digits=7)),
    f"""{SPIKES}, u AS (SELECT *, 1.0 AS w FROM a UNION ALL SELECT *, -1.0 FROM b), n AS (SELECT series_id, min(tm) AS lo, max(tm) + 10 AS hi FROM u GROUP BY 1),
    g AS (SELECT series_id, lo + i * 0.2 AS g, i FROM n JOIN range(0, 20000) r(i) ON i <= floor((hi - lo) / 0.2)),
    f AS (SELECT g.series_id, i, sum(w * exp(-(g - tm) / 2.0)) AS f FROM g JOIN u ON g.series_id = u.series_id AND g >= tm GROUP BY 1, 2)
    SELECT series_id, {q6("sqrt(sum(f * f) * 0.2 / 2.0)", "distance", 7)} FROM f GROUP BY 1""",
)
