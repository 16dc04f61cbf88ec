"""Fixtures with known values, properties and edge cases of the library's own operators."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import distances
from tidemark.operators import clustering, discretize, hurst, markov, proximity, regime, rolling, scaling, visibility, warning
from tidemark.plans.queries import ORACLE_SQL, QUERIES
from tidemark.sources import series as src

F7 = [5, 15, 25, 75, 45, 10, 30, 20, 60, 35, 40, 80, 55, 25, 70, 45, 35, 65, 50, 30]
SCHEMA = "series_id string, t long, value double"


def frame(spark, values, sid="a"):
    return spark.createDataFrame([(sid, i + 1, None if v is None else float(v)) for i, v in enumerate(values)], SCHEMA)


@pytest.fixture(scope="module")
def f7(spark):
    return frame(spark, F7).cache()


@pytest.mark.parametrize("kind, counts", [("nvg", (38, 69, 95)), ("hvg", (30, 57, 79))])
def test_visibility_counts(f7, kind, counts):
    assert tuple(visibility.visibility_edges(f7, kind, penetrable=p).count() for p in range(3)) == counts


def test_visibility_properties(spark, f7):
    nvg = {(r.src, r.dst) for r in visibility.visibility_edges(f7).collect()}
    hvg = {(r.src, r.dst) for r in visibility.visibility_edges(f7, "hvg").collect()}
    assert hvg <= nvg and {(i, i + 1) for i in range(1, 20)} <= hvg
    for limit in (1, 3, 7):
        near = {(r.src, r.dst) for r in visibility.visibility_edges(f7, limit=limit).collect()}
        assert near == {(a, b) for a, b in nvg if b - a <= limit}
    gaps = frame(spark, [None, 3, None, 1, 2, None])
    assert {(r.src, r.dst) for r in visibility.visibility_edges(gaps).collect()} == {(2, 4), (4, 5), (2, 5)}
    assert visibility.visibility_edges(frame(spark, [None, None])).count() == 0


def test_state_view(f7):
    states = f7.withColumn("state", F.when(F.col("t") <= 10, "A").otherwise("B"))
    edges = visibility.visibility_edges(f7)
    one = {(r.from_state, r.to_state): r.weight for r in visibility.by_state(edges, states, "count").collect()}
    assert one == {("A", "A"): 17, ("A", "B"): 6, ("B", "B"): 15}
    both = {(r.from_state, r.to_state): r.weight for r in visibility.by_state(edges, states, "count", directed=False).collect()}
    assert both == {("A", "A"): 68, ("A", "B"): 12, ("B", "A"): 12, ("B", "B"): 60}


def test_rolling_values(f7):
    r = rolling.rolling_measures(f7, scale=(5, 80)).where("t = 7").first()
    assert r.value_fluctuation == pytest.approx(0.393465, abs=1e-6)
    assert r.value_distribution == pytest.approx(0.666667, abs=1e-6)
    assert r.value_complexity == pytest.approx(0.262310, abs=1e-6)
    assert r.value_autocorrelation == pytest.approx(0.174297, abs=1e-6)
    assert r.value_variance == pytest.approx(586.904762, abs=1e-6)


def test_rolling_edges(spark):
    out = rolling.rolling_measures(frame(spark, [1, 2, 3]), width=7).collect()
    assert all(r.value_max is None and r.value_complexity is None for r in out)
    flat = rolling.rolling_measures(frame(spark, [4] * 9), width=3).where("t = 5").first()
    assert flat.value_complexity is None and flat.value_autocorrelation is None and flat.value_variance == 0
    holes = rolling.rolling_measures(frame(spark, [1, None, 3, 5, None, 2]), width=3).where("t = 3").first()
    assert (holes.value_min, holes.value_max) == (1, 3) and holes.value_fluctuation == pytest.approx(0.5)
    with pytest.raises(ValueError):
        rolling.rolling_measures(frame(spark, [1]), width=1)


def test_scaling_values(spark):
    s = frame(spark, [1, 5, 10, 15, 20, 100])
    p = scaling.scaling_parameters(s, "robust").first()
    assert (p["mean"], p["sd"], p["median"], p["iqr"]) == pytest.approx((25.166667, 37.284939, 12.5, 12.5), abs=1e-6)
    assert p["scale"] == pytest.approx(11.1195) and (p["q_low"], p["q25"], p["q75"], p["q_high"]) == pytest.approx((2, 6.25, 18.75, 80))
    assert scaling.detect_scaling(s).first().method == "iqr"


@pytest.mark.parametrize("method", scaling.METHODS)
def test_scaling_round_trip(spark, method):
    s = frame(spark, [3, 1, None, 4, 1, 5, 9, 2, 6]).unionByName(frame(spark, [7, 7, 7], "flat"))
    p = scaling.scaling_parameters(s, method)
    back = scaling.reverse_scaling(scaling.apply_scaling(s, method, p), p, into="back").collect()
    for r in back:
        if r.series_id == "a":
            assert (r.back is None) == (r.value is None) and (r.value is None or math.isclose(r.back, r.value, abs_tol=1e-9))
    frame2 = spark.createDataFrame([(float(i), float(i * i)) for i in range(1, 11)], "x double, y double")
    out, q = scaling.scale_columns(frame2, ["x", "y"], method)
    assert [tuple(round(v, 9) for v in r) for r in scaling.reverse_columns(out, q, ["x", "y"]).collect()] == [tuple(r) for r in frame2.collect()]


@pytest.mark.parametrize("method", ["log", "sqrt", "scale", "center", "none"])
def test_transform_round_trip(spark, method):
    s = frame(spark, [-3, 0, 4.5, 2])
    out, p = scaling.transform_series(s, method)
    assert [round(r.value, 9) for r in scaling.reverse_transform(out, p, method).orderBy("t").collect()] == [-3, 0, 4.5, 2]


def test_fill(spark):
    got = [r.value for r in src.fill_gaps(frame(spark, [None, 2, None, None, 5, None])).orderBy("t").collect()]
    assert got == [2, 2, 3, 4, 5, 5]


def test_similarities(spark):
    e = spark.createDataFrame([("a", 1, 2, 10.0), ("a", 1, 3, 20.0), ("a", 2, 3, 15.0)], "series_id string, src long, dst long, distance double")
    want = {"normalized_inverse": (0.5, 0, 0.25), "inverse": (0.090909, 0.047619, 0.0625), "negative_exp": (0.513417, 0.263597, 0.367879), "gaussian": (0.800737, 0.411112, 0.606531)}
    for m, v in want.items():
        got = [r.similarity for r in proximity.similarity(e, m).orderBy("src", "dst").collect()]
        assert got == pytest.approx(v, abs=1e-6)
    inf = e.unionByName(spark.createDataFrame([("a", 1, 4, float("inf"))], e.schema))
    assert proximity.similarity(inf).where("dst = 4").first().similarity == 0


def test_transitions(spark):
    s = frame(spark, [1, 1, 2, 3, 2, 1, 3, 3]).withColumn("state", F.col("value").cast("int"))
    n = {(r.from_state, r.to_state): r.n for r in markov.transition_counts(s, k=3).collect()}
    assert [[n[i, j] for j in (1, 2, 3)] for i in (1, 2, 3)] == [[1, 1, 1], [1, 0, 1], [0, 1, 1]]
    p = markov.transition_probabilities(markov.transition_counts(s, k=4)).groupBy("from_state").agg(F.sum("prob").alias("p")).collect()
    assert all(r.p == pytest.approx(0 if r.from_state == 4 else 1, abs=1e-9) for r in p)
    runs = markov.run_lengths(s).orderBy("run").collect()
    assert [(r.state, r.duration) for r in runs] == [(1, 2), (2, 1), (3, 1), (2, 1), (1, 1), (3, 2)]
    two = s.unionByName(s.withColumn("series_id", F.lit("b")))
    assert markov.transition_counts(two, "global", 3).agg(F.sum("n")).first()[0] == 15
    assert markov.transition_counts(two, "user", 3).agg(F.sum("n")).first()[0] == 14


@pytest.mark.parametrize("method", discretize.methods())
def test_discretisers(spark, method):
    rng = np.random.default_rng(0)
    s = frame(spark, list(rng.normal(size=60)) + [None]).unionByName(frame(spark, [2.0] * 12, "flat"))
    out = discretize.discretize(s, method, 3).collect()
    known = {r.state for r in out if r.series_id == "a" and r.state is not None}
    assert len(out) == 73 and known <= {1, 2, 3, 4} and len(known) >= 2
    if method not in ("change_points", "magnitude", "proxy_windowed"):
        assert all(r.state is None for r in out if r.series_id == "flat")


def test_kmeans_separates(spark):
    s = frame(spark, [1, 1.1, 0.9, 5, 5.1, 4.9, 9, 9.2, 8.8])
    assert [r.state for r in discretize.discretize(s, "kmeans", 3).orderBy("t").collect()] == [1] * 3 + [2] * 3 + [3] * 3


@pytest.mark.parametrize("method", ["mixture", "hierarchical"])
def test_clusters_separate(spark, method):
    s = frame(spark, [1, 1.1, 0.9, 5, 5.1, 4.9, 9, 9.2, 8.8])
    assert [r.state for r in discretize.discretize(s, method, 3).orderBy("t").collect()] == [1] * 3 + [2] * 3 + [3] * 3


def test_ward_separates():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 0.1, (6, 3)), rng.normal(5, 0.1, (4, 3)), rng.normal(9, 0.1, (5, 3))])
    assert clustering.ward_labels(x, 3).tolist() == [1] * 6 + [2] * 4 + [3] * 5


def test_quantile_states_and_maps(spark):
    s = frame(spark, [1, 2, 3, 4, None])
    assert [r.state for r in discretize.quantile_states(s, 2, na_label="NA").orderBy("t").collect()] == ["Q1", "Q1", "Q2", "Q2", "NA"]
    got = [r.state for r in discretize.map_to_state(s, {"low": "1-2", "three": "=3", "big": ">3"}).orderBy("t").collect()]
    assert got == ["low", "low", "three", "big", None]
    assert [r.state for r in discretize.map_to_state(frame(spark, [7, 7]), bins=3).collect()] == ["Bin_1", "Bin_1"]


def test_regimes(spark):
    level = [0.3] * 50 + [0.8] * 50 + [0.5] * 50 + [0.9] * 50
    s = frame(spark, [v + 0.05 * math.sin(i) for i, v in enumerate(level)])
    for method in (*regime.METHODS, "smart", "all"):
        ids = [r.regime_id for r in regime.detect_changes(s, method).orderBy("t").collect()]
        assert ids[0] == 1 and all(0 <= b - a <= 1 for a, b in zip(ids, ids[1:]))
    assert max(r.regime_id for r in regime.detect_changes(s, "gradient", min_size=1).collect()) >= 4
    full = regime.detect_regime(s, "smart", consolidate_similar=True)
    assert full.count() == 200 and full.where("regime_name IS NULL").count() == 0
    one = regime.detect_regime(frame(spark, [1.0])).first()
    assert (one.regime_id, one.regime_stability, one.stability_score) == (1, "Stable", 0.5)


def test_distances(spark):
    rng = np.random.default_rng(3)
    rows = [([float(v) for v in rng.normal(size=8)], [float(v) for v in rng.normal(size=8)]) for _ in range(5)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")

    def warp(x, y, diagonal):
        d = np.full((9, 9), np.inf)
        d[0, 0] = 0
        for i in range(1, 9):
            for j in range(1, 9):
                c = abs(x[i - 1] - y[j - 1])
                first = i == j == 1
                d[i, j] = c if first else min(d[i - 1, j] + c, d[i, j - 1] + c, d[i - 1, j - 1] + diagonal * c)
        return d[8, 8]

    def tau(x, y):
        return 1 - abs(sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(8) for j in range(i)) / 28)

    rank = lambda v: np.argsort(np.argsort(v))
    want = {
        "euclidean": lambda x, y: np.linalg.norm(x - y), "manhattan": lambda x, y: abs(x - y).sum(), "chebyshev": lambda x, y: abs(x - y).max(),
        "pearson": lambda x, y: 1 - abs(np.corrcoef(x, y)[0, 1]), "spearman": lambda x, y: 1 - abs(np.corrcoef(rank(x), rank(y))[0, 1]),
        "kendall": tau, "dtw": lambda x, y: warp(x, y, 1), "dtw_symmetric2": lambda x, y: warp(x, y, 2),
    }
    got = df.select(*[distances.metric(m)(F.col("a"), F.col("b")).alias(m) for m in want]).collect()
    zero = df.select(*[distances.metric(m)(F.col("a"), F.col("a")).alias(m) for m in want]).first()
    for r, (a, b) in zip(got, rows):
        for m, f in want.items():
            assert r[m] == pytest.approx(f(np.array(a), np.array(b)), abs=1e-9), m
    assert all(abs(zero[m]) < 1e-9 for m in want)
    with pytest.raises(ValueError):
        distances.metric("nothing")


def test_windows_and_components(spark):
    w = proximity.windows(frame(spark, range(1, 12)), 5, 3).orderBy("window_id").collect()
    assert [(r.start_t, r.end_t, r.x) for r in w] == [(1, 5, [1, 2, 3, 4, 5]), (4, 8, [4, 5, 6, 7, 8]), (7, 11, [7, 8, 9, 10, 11])]
    nodes = spark.createDataFrame([("a", i) for i in range(1, 31)], "series_id string, window_id long")
    chain = spark.createDataFrame([("a", i, i + 1, 1.0) for i in range(1, 30) if i not in (10, 20)], "series_id string, src long, dst long, weight double")
    got = {r.window_id: r.component for r in proximity.components(nodes, chain).collect()}
    assert got == {i: 1 if i <= 10 else 11 if i <= 20 else 21 for i in range(1, 31)}


def test_hurst_of_noise_and_walk(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=600)
    s = frame(spark, noise, "noise").unionByName(frame(spark, np.cumsum(noise), "walk"))
    h = {r.series_id: r.hurst for r in hurst.dfa(hurst.whole_series(s)).collect()}
    assert abs(h["noise"] - 0.5) < 0.15 and abs(h["walk"] - 1.5) < 0.2
    r = {r.series_id: r.hurst for r in hurst.rescaled_range(hurst.whole_series(s)).collect()}
    assert 0 <= min(r.values()) and max(r.values()) <= 1 and r["walk"] > r["noise"]
    spectrum = hurst.mfdfa(hurst.whole_series(s.where("series_id = 'noise'"))).collect()
    assert len(spectrum) == 20 and len({round(x.h, 9) for x in spectrum if x.q < 0}) == 1
    assert hurst.dfa(hurst.whole_series(frame(spark, [1, 2, 3]))).count() == 0
    out = hurst.rolling_hurst(frame(spark, noise[:120]), window=50, step=10)
    assert out.count() == 120 and out.where("hurst IS NULL").count() == 0


def test_dfa_matches_numpy(spark):
    x = np.random.default_rng(5).normal(size=80)
    scales = sorted({round(math.exp(v)) for v in np.linspace(math.log(4), math.log(20), 10)})
    p = np.cumsum(x - x.mean())
    f = []
    for s in scales:
        segs = [p[j * s : (j + 1) * s] for j in range(80 // s)] + [p[80 - (j + 1) * s : 80 - j * s] for j in range(80 // s)]
        f.append(math.sqrt(np.mean([np.mean((g - np.polyval(np.polyfit(np.arange(s), g, 1), np.arange(s))) ** 2) for g in segs])))
    want = np.polyfit(np.log(scales), np.log(f), 1)[0]
    assert hurst.dfa(hurst.whole_series(frame(spark, x))).first().hurst == pytest.approx(want, abs=1e-9)


def test_warnings(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0.5, 0.02, 150), rng.normal(0.5, 0.15, 60), rng.normal(0.5, 0.02, 150)])
    s = hurst.with_transition(frame(spark, x).withColumn("state", hurst.category(F.col("value"))))
    out = warning.detect_warnings(s).orderBy("t").collect()
    assert all(r.score is None and r.level == 0 for r in out[:29])
    calm, wild = np.mean([r.level for r in out[40:140]]), np.mean([r.level for r in out[160:210]])
    assert wild > calm and {r.level for r in out} <= {0, 1, 2, 3, 4}
    assert sum(r.share for r in warning.warning_summary(warning.detect_warnings(s)).collect()) == pytest.approx(1)


def test_names_match_and_import_needs_no_session():
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 120


@pytest.mark.parametrize("name", ["roll_complexity", "regime_smart", "trans_global", "vg_nvg", "net_knn", "hurst_dfa"])
def test_some_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, folder)
    rel = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(got.columns)
    clean = lambda rows: sorted(tuple("" if v is None else round(v, 5) if isinstance(v, float) else v for v in r) for r in rows)
    assert clean(map(tuple, got.select(*columns).collect())) == clean(rel.fetchall())
