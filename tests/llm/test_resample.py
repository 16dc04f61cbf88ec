"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import resample, textbytes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "The quick, brown fox: JUMPS over 12 lazy dogs!", "", None, "  ...  ", "é É ß Ünïcode 漢字 and_under-score", "a", "a b", "a b a b a b", "x" * 500 + " " + "y" * 49 + " z",
    "one\x00two\x7fthree|four five\xa0six", "tail words\n", "A1b2" * 30,
]


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target):
    crc = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, x in docs:
        for f in features(x)[1]:
            s[crc(f)] += 1
    for x in target:
        for f in features(x)[1]:
            t[crc(f)] += 1
    big_s, big_t = float(s.sum()), float(t.sum())
    gain = [math.floor(1000 * math.log((float(b) + 1) * (big_s + 10_000) / ((float(a) + 1) * (big_t + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for d, x in docs:
        words, found = features(x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[crc(f)] for f in found)
        rows.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: len(fit) * 5 // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("limit", [16, 100, 1 << 19])
def test_buckets_of_any_text_at_any_block_size(monkeypatch, limit):
    monkeypatch.setattr(textbytes, "BLOCK_BYTES", limit)
    got, words = [[] for _ in TEXTS], [0] * len(TEXTS)
    for row, bucket, doc, n in resample.feature_buckets(pa.array(TEXTS)):
        for b, d in zip(bucket.tolist(), doc.tolist()):
            got[row + d].append(b)
        for i, x in enumerate(n.tolist()):
            words[row + i] += x
    for text, b, n in zip(TEXTS, got, words):
        w, f = features(text)
        assert sorted(b) == sorted(zlib.crc32(x.encode()) % 10_000 for x in f) and n == len(w)


def test_same_as_plain(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60)))) for i in range(400)]
    docs += [(1000 + i, x) for i, x in enumerate(TEXTS)] + [(5, docs[5][1]), (None, "the same words again " * 8)]
    target = [" ".join(rng.choice(vocabulary[:20], 40)) for _ in range(10)] + [None, ""]
    df = spark.createDataFrame([(d, x, "r", 1) for d, x in docs], "doc_id long, text string, rank string, SCORE int").repartition(5)
    out = resample.resample(df, spark.createDataFrame([(x,) for x in target], "text string"))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(docs, target)
    assert out.where("rank is not null").count() > 10


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10), (2, None)], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    got = resample.resample(some, none.select("text")).orderBy("doc_id").collect()
    assert [r.n_features for r in got] == [87, 0] and [r.rank for r in got] == [None, None]


def test_ranks_with_heavy_ties(spark):
    df = spark.range(1000).selectExpr("id", "id % 2 as v")
    got = resample.ranked(df, [df["v"].desc(), df["id"]]).collect()
    assert sorted((-r.v, r.id, r.rank) for r in got) == [(-v, i, k + 1) for k, (v, i) in enumerate([(1, i) for i in range(1, 1000, 2)] + [(0, i) for i in range(0, 1000, 2)])]
