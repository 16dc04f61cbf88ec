"""Repeated passages against plain Python."""

import re

import numpy as np
import pytest

from tidemark.llm import suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=20):
    """Rows (doc_id, n_words, n_removed, kept); the rows of one doc_id share their places."""
    words = [(d is None, d or 0, WORD.findall(x or "")) for d, x in docs]
    first = {}
    for lost, d, w in words:
        for i in range(len(w) - window + 1):
            key, place = tuple(w[i : i + window]), (lost, d, i)
            first[key] = min(first.get(key, place), place)
    out = []
    for lost, d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (lost, d, i):
                gone.update(range(i, i + window))
        out.append((None if lost else d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def corpus(seed, n=150):
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{i}" for i in rng.integers(0, 2000, k)]
    passages = [word(int(rng.integers(20, 70))) for _ in range(6)]
    docs = []
    for i in range(n):
        w = word(int(rng.integers(0, 90)))
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(0, 6)]
            a = int(rng.integers(0, len(p)))
            w[len(w) // 2 : len(w) // 2] = p[a : a + int(rng.integers(5, 60))]
        docs.append((i, " ".join(w)))
    docs += [(500, docs[3][1]), (501, docs[3][1].replace(" ", "\n\t ")), (502, "a " * 300), (503, "a " * 19), (504, "a " * 25 + "b"), (505, "A " * 40)]
    docs += [(506, None), (507, ""), (508, " \n"), (509, "é x 漢字 " * 30), (510, ("x y z " * 20 + "  ") * 3), (7, docs[7][1]), (7, docs[8][1]), (None, docs[9][1]), (None, None)]
    return docs


@pytest.mark.parametrize("heavy", [False, True])
def test_same_as_plain(spark, monkeypatch, heavy):
    if heavy:  # every prefix that occurs often goes the other way
        monkeypatch.setattr(suffixes, "HEAVY_ROWS", 3)
    docs = corpus(1)
    df = spark.createDataFrame([(d, x, 0, "t") for d, x in docs], "doc_id long, text string, start int, TAG string").repartition(6)
    tagged = suffixes._tagged(df)
    assert bool(len(suffixes.heavy_prefixes(tagged))) == heavy
    out = suffixes.remove_repeats(df)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept"]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in out.collect()), key=str)
    assert got == brute(docs) and sum(r[2] for r in got) > 1000


def test_other_windows_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 10)
    docs = corpus(2, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for window in (6, 30):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in suffixes.remove_repeats(df, window).collect()), key=str)
        assert got == brute(docs, window)
    with pytest.raises(ValueError):
        suffixes.repeated_windows(df, 3)


def test_long_text_over_block_size(spark):
    rng = np.random.default_rng(5)
    body = " ".join(f"w{i}" for i in rng.integers(0, 50_000, 120_000))  # over half a megabyte, in one document
    docs = [(1, body), (2, "start " + " ".join(body.split()[-50:])), (3, body + " " + body[:4000])]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: (n, r) for d, n, r, _ in brute(docs)}


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sampling_covers_every_window():
    values = np.random.default_rng(0).integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 7, 15):
        got = suffixes.first_least(values, width)
        assert got.tolist() == [i + int(values[i : i + width].argmin()) for i in range(200 - width + 1)]
