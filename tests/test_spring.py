"""The spring layout against a plain loop."""

import math
import random

import pytest

from tidemark.operators import markov

S = "series_id string, t long, value double, state int"


def loop(rows, rounds=50):
    nodes = sorted({s for *_, s in rows if s is not None})
    moves = set()
    for key in {r[0] for r in rows}:
        x = [s for *_, s in sorted((r for r in rows if r[0] == key), key=lambda r: r[1])]
        moves |= {(a, b) for a, b in zip(x, x[1:]) if a is not None and b is not None and a != b}
    at = {s: [math.cos(2 * math.pi * i / len(nodes)), math.sin(2 * math.pi * i / len(nodes))] for i, s in enumerate(nodes)}
    for _ in range(rounds):
        for a in nodes:
            fx = fy = 0.0
            for b in nodes:
                dx, dy = at[a][0] - at[b][0], at[a][1] - at[b][1]
                square = dx * dx + dy * dy
                if square > 0:
                    pull = 0.01 if (a, b) in moves else 0
                    fx += dx * (0.1 / square - pull)
                    fy += dy * (0.1 / square - pull)
            at[a][0] += 0.1 * fx
            at[a][1] += 0.1 * fy
    return at


@pytest.mark.parametrize("k", [1, 2, 6])
def test_against_a_loop(spark, k):
    r = random.Random(k)
    rows = [(s, t, 0.0, None if t == 7 else r.choice([1 + min(k - 1, t % 3), 1 + r.randrange(k)])) for s in "ab" for t in range(30)]
    got = {x.state: (x.x, x.y) for x in markov.node_layout(spark.createDataFrame(rows, S), "spring").collect()}
    want = loop(rows)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-9)


def test_no_states(spark):
    for rows in ([], [("a", 1, 1.0, None)]):
        assert markov.node_layout(spark.createDataFrame(rows, S), "spring").count() == 0
