import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import common, components, simhash

ROWS = "doc_id long, text string, fp string, a long"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    fp = [(d, brute_fingerprint(t)) for d, t in rows]
    root = {d: d for d, _ in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fp):
        for b, y in fp[:i]:
            if (x ^ y).bit_count() <= 4:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((d, f"{x:016x}", find(d)) for d, x in fp)


def test_golay_keys_meet_within_two_errors():
    """Linear code: it is enough to try every syndrome's word against all patterns of two bits."""
    _, _, patterns, _ = simhash.golay_patterns()
    words = patterns[:, 0]
    flips = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
    k, n = simhash.golay_keys(words)
    mine = [set(a[:m].tolist()) for a, m in zip(k, n)]
    for e in flips:
        other, m = simhash.golay_keys(words ^ e)
        assert all(a & set(b[:c].tolist()) for a, b, c in zip(mine, other, m))


def test_fingerprints_within_four_bits_share_a_key():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
    for bits in range(5):
        flip = np.array([sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in fp], np.uint64)
        a, b = simhash.fingerprint_keys(fp), simhash.fingerprint_keys(fp ^ flip)
        left, right = set(zip(*map(np.ndarray.tolist, a))), set(zip(*map(np.ndarray.tolist, b)))
        assert {r for _, r in left & right} == set(range(400))


@pytest.mark.parametrize("n", [3, 40, 300])
def test_forest_connects_what_pairs_connect(n, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_RUN", 100)
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 62, 5, dtype=np.uint64)
    fp = np.unique(base[rng.integers(0, 5, n)] ^ np.array([sum(1 << int(b) for b in rng.choice(64, 3)) for _ in range(n)], np.uint64))
    links = simhash.links_in_runs(np.zeros(len(fp), np.int64), fp, 4)
    pairs = {(int(a), int(b)) for x, y in links for a, b in zip(x, y)}
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)

    def roots(edges):
        root = {int(f): int(f) for f in fp}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
        return {f: find(f) for f in root}

    every = [(int(a), int(b)) for a in fp for b in fp if a < b and (int(a) ^ int(b)).bit_count() <= 4]
    assert roots(pairs) == roots(every)


def test_groups_match_brute_force(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    rng = np.random.default_rng(1)
    long = [" ".join(rng.choice(words, 400)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(long)] + [(10 + i, t + " tail end") for i, t in enumerate(long)]
    rows += [(20, None), (21, ""), (22, " \n\t"), (23, "One"), (24, "one"), (25, "one two three"), (26, "été É À"), (27, "Z" * 5000), (28, long[0].upper())]
    rows += [(40 + i, long[1]) for i in range(50)] + [(40, long[1])]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], ROWS)
    got = simhash.simhash_groups(df).collect()
    assert sorted((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got) == brute_groups(rows)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_groups(rows)})


def test_rows_without_id_stay(spark):
    df = spark.createDataFrame([(None, "a b c d", "x", 1), (None, None, "x", 1), (3, "a b c d", "x", 1), (4, "a b c d", "x", 1)], ROWS)
    assert sorted(str(r.doc_id) for r in simhash.deduplicate(df).collect()) == ["3", "None", "None"]
    assert simhash.simhash_groups(df).count() == 4


def test_empty_table(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], ROWS)).collect() == []
    assert simhash.deduplicate(spark.createDataFrame([], ROWS)).collect() == []


def test_rows_of_one_id_and_different_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x", 1), (2, "a b c d e", "x", 1), (2, "p q r s t u v", "x", 1), (2, "p q r s t u v", "x", 1)], ROWS)
    assert sorted((r.doc_id, r.text) for r in simhash.deduplicate(df).collect()) == [(1, "a b c d e"), (2, "p q r s t u v")]


def test_heavy_keys_change_nothing(spark, monkeypatch):
    """Copies, stars and chains with every key of more than two rows joined by broadcast."""
    monkeypatch.setattr(common, "HEAVY_ROWS", 2)
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 40, 300)) for _ in range(4)]
    rows = [(i, texts[i % 4] + (" end" if i % 7 == 0 else "") if i % 5 else None) for i in range(120)]
    got = simhash.simhash_groups(spark.createDataFrame([(a, b, "x", 1) for a, b in rows], ROWS)).collect()
    assert sorted((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got) == brute_groups(rows)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(80)] + [(300, 300), (None, 5)]
    roots = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(roots) == {*range(60), *range(100, 181)}
    assert len({roots[i] for i in range(60)}) == 1 and len({roots[i] for i in range(100, 181)}) == 1 and roots[0] != roots[100]
