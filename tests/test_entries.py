"""Entry points, checks and generators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import catalogue, distances
from tidemark.operators import hurst, markov, proximity
from tidemark.sources import generators, tables, validate

S = "series_id string, t long, value double"


def test_frames_and_arguments_are_checked(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], S)
    validate.check_frame(df, ["series_id"], ["value"])
    validate.check_states(df, "series_id", "value", 3)
    validate.check_windows(10, 3)
    validate.check_choice("a", ["a"])
    for bad in (
        lambda: validate.check_frame(df, ["none"]), lambda: validate.check_frame(df, [], ["series_id"]), lambda: validate.check_states(df, "series_id", "value", 1),
        lambda: validate.check_windows(3, 5), lambda: validate.check_windows(9, 1), lambda: validate.check_choice("b", ["a"]),
    ):
        with pytest.raises(ValueError):
            bad()


def test_report_counts_what_is_no_number(spark):
    rows = [("a", 1, 1.0), ("a", 2, None), ("a", 3, float("nan")), ("a", 4, float("inf")), ("a", 5, 2.0), ("b", 1, 3.0), ("b", 2, 3.0), ("c", 1, None)]
    got = {r.series_id: tuple(r)[1:] for r in validate.series_report(spark.createDataFrame(rows, S)).collect()}
    assert got == {"a": (5, 2, 1, False, True), "b": (2, 0, 0, True, False), "c": (1, 1, 0, True, False)}


def test_generators_do_not_depend_on_partitions(spark):
    one = sorted(map(tuple, generators.random_walk(spark, 50, (10, 20)).collect()))
    steps = [((t * 7919 % 1009) / 1009 - 0.5) * (2 if 10 < t <= 20 else 1) for t in range(1, 51)]
    assert np.allclose([v for *_, v in one], np.cumsum(steps))
    assert generators.panel(spark, 3, 7).count() == 21 and generators.daily_steps(spark).count() == 861


def test_distances_of_one_pair_and_of_all_series(spark):
    rows = [(k, t, float(v)) for k, x in {"a": [1, 2, 4], "b": [2, 2, 2], "c": [9, 9, 9]}.items() for t, v in enumerate(x)]
    s = spark.createDataFrame(rows, S)
    got = {(r.src, r.dst): r.distance for r in proximity.ts_distance(s, "manhattan").collect()}
    assert got == {(1, 2): 3.0, (1, 3): 20.0, (2, 3): 21.0}
    assert proximity.ts_distance(s, "manhattan", symmetric=False).count() == 6
    assert [r.distance for r in proximity.distance_pair(s.where("series_id = 'a'"), s.where("series_id = 'b'").withColumn("series_id", F.lit("a")), "euclidean").collect()] == [pytest.approx(5**0.5)]
    assert {"euclidean", "dtw", "dist_cor"} <= set(distances.methods())


def test_jitter_stays_within_reach(spark):
    events = spark.createDataFrame([("a", float(i)) for i in range(40)], "series_id string, at double")
    got = [r["at"] for r in proximity.jittered(events, 0.4, 3).collect()]
    assert len(got) == 120 and all(abs(x - round(x)) <= 0.4 for x in got) and len({round(x % 1, 9) for x in got}) > 100
    assert all(0 <= r["at"] <= 5 for r in proximity.jittered(events, 9, 2, 5).collect())


def test_information_of_a_function_and_of_nothing(spark):
    x = np.random.default_rng(0).permutation(400)
    rows = lambda f: spark.createDataFrame([("a", i, float(f(i, v))) for i, v in enumerate(x)], S)
    of = lambda b: proximity.maximal_information(rows(lambda i, v: v), b).first().mic
    assert of(rows(lambda i, v: v * v)) == pytest.approx(1) and of(rows(lambda i, v: (i * 7919) % 401)) < 0.4


def test_hurst_entry(spark):
    s = generators.random_walk(spark, 400)
    plain = {m: hurst.calculate_hurst(s, m).first() for m in hurst.METHODS}
    assert all(0 < r.hurst for r in plain.values()) and plain["dfa"].interpretation == "Strong persistence (trending)"
    assert hurst.calculate_hurst(s, "dfa", "minmax").first().hurst == pytest.approx(plain["dfa"].hurst)
    assert hurst.calculate_hurst(s, "dfa", window=60, step=10).count() == 400
    for bad in ({"method": "x"}, {"scaling": "x"}):
        with pytest.raises(ValueError):
            hurst.calculate_hurst(s, **bad)


def test_layouts(spark):
    states = spark.createDataFrame([("a", i, str(i % 5)) for i in range(20)], "series_id string, t long, state string")
    for kind in ("circle", "grid", "tree"):
        assert len({(round(r.x, 6), round(r.y, 6)) for r in markov.node_layout(states, kind).collect()}) == 5
    with pytest.raises(ValueError):
        markov.node_layout(states, "spiral")


def test_components_of_a_long_chain(spark):
    n = 70
    nodes = spark.createDataFrame([("a", i) for i in range(n)], "series_id string, window_id long")
    links = spark.createDataFrame([("a", i, i + 1) for i in range(n - 2)], "series_id string, src long, dst long")
    got = {r.window_id: r.component for r in proximity.components(nodes, links).collect()}
    assert all(got[i] == 0 for i in range(n - 1)) and got[n - 1] == n - 1


def test_catalogue_describes_everything(spark):
    rows = catalogue.entries()
    assert len(rows) > 100 and all(d for *_, d in rows[:5]) and catalogue.catalogue(spark).count() == len(rows)


def test_written_tables_need_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.written(Frame(), "x")


@pytest.mark.parametrize("method", ["dfa", "rs"])
def test_rolling_exponents_match_grouped_regressions(spark, method):
    x = np.cumsum(np.random.default_rng(3).normal(size=130))
    rows = [("a", i + 1, float(v)) for i, v in enumerate(x)] + [("b", i + 1, None if i == 30 else float(v)) for i, v in enumerate(x[:70])] + [("c", 1, 1.0)] + [("d", i + 1, 5.0) for i in range(60)]
    s = spark.createDataFrame(rows, S)
    grid = F.array(*[F.lit(v).cast("long") for v in (4, 6, 8, 10)])
    want = {(r.series_id, r.win): r for r in {"dfa": hurst.dfa, "rs": hurst.rescaled_range}[method](hurst.rolling_windows(s, 40, 3), grid).collect()}
    got = {(r.series_id, r.win): r for r in hurst.rolling_exponents(s, method, 40, 3, [4, 6, 8, 10]).collect()}
    assert set(got) == set(want) and len(got) == 30
    for k, r in want.items():
        assert (got[k].hurst, got[k].r2, got[k].n_scales) == (pytest.approx(r.hurst, abs=1e-9), pytest.approx(r.r2, abs=1e-9), r.n_scales), k
