"""Complete linkage by blocks of neighbours, against merging the nearest clusters of a whole series."""

import numpy as np
import pytest

from tidemark.operators import clustering

S = "series_id string, t long, value double"


def brute(values, k):
    groups = [[v] for v in sorted(set(values))]
    if len(groups) < k:
        return None
    while len(groups) > k:
        i = min(range(len(groups) - 1), key=lambda i: groups[i + 1][-1] - groups[i][0])
        groups[i : i + 2] = [groups[i] + groups[i + 1]]
    return {v: n + 1 for n, g in enumerate(groups) for v in g}


def in_blocks(values, k, block):
    """The rounds of ``by_linkage`` in one process."""
    spans, merges, shift = [(v, v) for v in sorted(set(values))], [], 0
    rounds = 0
    while len(spans) > 1:
        left = []
        cuts = list(range((block - shift) % block, len(spans), block))
        bounds = sorted({0, *cuts, len(spans)})
        for a, b in zip(bounds, bounds[1:]):
            lo, hi = (np.array([s[c] for s in spans[a:b]], float) for c in (0, 1))
            made, kept = clustering.neighbour_merges(lo, hi, spans[a - 1][0] if a else None, spans[b][1] if b < len(spans) else None)
            merges += made
            left += kept
        spans, shift = left, block // 2 - shift
        rounds += 1
        assert rounds < 1000
    dearest = sorted(merges)[len(merges) - k + 1 :]
    return sorted(m[2] for m in dearest)


@pytest.mark.parametrize("block", [4, 7, 64])
def test_blocks_in_one_process(block):
    rng = np.random.default_rng(3)
    shapes = [rng.normal(size=120), rng.integers(0, 300, 150), np.arange(100) ** 2, 2.0 ** np.arange(60), np.arange(90), 1000 - np.arange(60) ** 2, np.cumsum(rng.choice([1, 2, 3], 150))]
    for x in shapes:
        for k in (2, 3, 6):
            values = [float(v) for v in x]
            want = brute(values, k)
            ends = [max(v for v, s in want.items() if s == n) for n in range(1, k)]
            assert in_blocks(values, k, block) == ends


def test_on_spark(spark):
    rng = np.random.default_rng(8)
    series = {"a": rng.integers(0, 60, 70).tolist() + [None], "b": rng.normal(size=50).tolist(), "same": [2.0] * 5, "few": [1.0, 2.0, 2.0], "squares": [float(i * i) for i in range(40)], "none": [None]}
    rows = [(name, t, None if v is None else float(v)) for name, x in series.items() for t, v in enumerate(x)] + [("b", 99, float("nan"))]
    for block in (16, 65_536):
        got = {(r.series_id, r.t): r.state for r in clustering.by_linkage(spark.createDataFrame(rows, S), 3, block).collect()}
        assert len(got) == len(rows)
        for name, x in series.items():
            want = brute([v for v in x if v is not None], 3)
            for t, v in enumerate(x):
                assert got[name, t] == (None if want is None or v is None else want[float(v)]), (block, name, t)
        assert got["b", 99] is None


def test_empty_and_wrong_block(spark):
    none = spark.createDataFrame([], S)
    assert clustering.by_linkage(none, 3).count() == 0
    with pytest.raises(ValueError):
        clustering.by_linkage(none, 3, 3)
