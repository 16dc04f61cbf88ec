"""Whole operators against plain Python: languages and scores, weights and selection, fingerprints of very long texts."""

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import langid, quality, simhash, textbytes


def symbols(text):
    """Symbols of a text between blanks, runs of blanks as one."""
    table, s = langid.letter_symbols(), [0]
    for ch in text:
        k = int(table[ord(ch)])
        if k or s[-1]:
            s.append(k)
    return s + [0] if s[-1] else s


def bundle(text):
    """A text's profile and its number of trigrams."""
    a, b, c = (v.astype(int) for v in langid.letter_vectors())
    s = np.array(symbols(text))
    return (a[s[:-2]] * b[s[1:-1]] * c[s[2:]]).sum(axis=0).astype(float), max(0, len(s) - 2)


def brute_languages(rows):
    sums = {}
    for d, text, lang in rows:
        if text is not None and lang is not None and (d is None or zlib.crc32(str(d).encode()) % 4 != 2):
            h, n = bundle(text)
            if n:
                sums[lang] = sums.get(lang, 0) + h / n
    names = sorted(k for k, v in sums.items() if np.any(v))
    out = []
    for d, text, _ in rows:
        h, n = bundle(text or "")
        cosines = [float(h @ sums[k] / np.linalg.norm(sums[k]) / max(np.linalg.norm(h), 1e-9)) for k in names]
        best = int(np.argmax(cosines))
        out.append((d, names[best] if n and any(symbols(text)) else "und", min(1.0, max(0.0, cosines[best])) if n and any(symbols(text)) else 0.0))
    return out


@pytest.mark.parametrize("block", [64, 1 << 19])
def test_languages_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(textbytes, "BLOCK_BYTES", block)
    rng = np.random.default_rng(9)
    letters = {"aa": "abcdefgé", "bb": "defghijk", "cc": "ghijklмно"}  # overlapping, so that some predictions are wrong
    word = lambda x: "".join(rng.choice(list(letters[x]), rng.integers(1, 9)))
    rows = [(i, " ".join(word(k) for _ in range(rng.integers(1, 40))), k if i % 5 else None) for i, k in enumerate(rng.choice([*letters], 90).tolist())]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "12 -- 3", "cc"), (203, "Ab, Éa! 9", "aa"), (204, "hij " * 3000, "bb"), (204, "hij " * 3000, "bb"), (None, "abc abd", "aa"), (205, "x" * 9000, None), (206, "é", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    key = lambda r: (str(r[0]), r[1])
    want = sorted(brute_languages(rows), key=key)
    have = sorted(((r.doc_id, r.lang_pred, r.score) for r in got), key=key)
    assert [r[:2] for r in have] == [r[:2] for r in want]
    assert [r[2] for r in have] == pytest.approx([r[2] for r in want], abs=1e-5)


def slots_of(text):
    """The slots of a text's n-grams, one by one."""
    return [int(s) for _, slot, _, _ in quality.ngram_slots(pa.array([text]), quality.SLOTS) for s in slot]


def test_weights_and_selection(spark):
    """Weights by the formulas over the same slots; selected are the largest sums of weight and noise."""
    rng = np.random.default_rng(5)
    names = ["ab", "Cd", "é", "x1", "--", "zz", "qq", "rr", "st"]
    rows = [(i, " ".join(rng.choice(names[: 5 + i % 5], rng.integers(1, 90)))) for i in range(120)] + [(200, None), (201, " ")]
    labels = spark.createDataFrame([(i, int(i % 5 > 1)) for i in range(60)], "doc_id long, quality int")
    model, least, out = quality.importance_resample(spark.createDataFrame(rows, "doc_id long, text string"), labels, k=30, seed=11)
    kept = {r["key"] for r in model.labelled.collect() if r["value"] == 1 and not r["held"]}
    bound, slots = quality.EVIDENCE, quality.SLOTS
    raw, target = np.ones(slots), np.zeros(slots)
    grams = {d: slots_of(t or "") for d, t in rows}
    for d, g in grams.items():
        for s in g:
            raw[s] += bound / max(len(g), bound)
            target[s] += bound / max(len(g), bound) * (d in kept)
    e = raw / raw.sum()
    ratio = np.log((target + quality.PRIOR * slots * e) / (target.sum() + quality.PRIOR * slots)) - np.log(e)
    got = {r.doc_id: r for r in out.collect()}
    keys = {}
    for d, g in grams.items():
        if not g:
            assert got[d].log_weight is None and not got[d].selected
            continue
        weight = float(ratio[g].sum()) * min(1, bound / len(g))
        assert got[d].log_weight == pytest.approx(weight, abs=1e-5)
        noise = (xxhash.xxh64_intdigest(struct.pack("<i", 11), xxhash.xxh64_intdigest(struct.pack("<q", d), 42)) >> 11) + 0.5
        keys[d] = weight - math.log(-math.log(noise / (1 << 53)))
    assert {d for d, r in got.items() if r.selected} == set(sorted(keys, key=keys.get)[-30:])


def test_fingerprint_of_a_very_long_text(spark):
    """More shingles than one slice of the fingerprint's counts holds."""
    rng = np.random.default_rng(2)
    words = rng.integers(0, 500, 300_000)
    text = " ".join(f"W{w}" for w in words)
    low = text.lower().split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(low[i : i + 4]), 42) for i in range(len(low) - 3)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    df = spark.createDataFrame([(1, text), (2, text.upper()), (3, "W1 w2")], "doc_id long, text string")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_groups(df).collect()}
    assert got[1] == (want, 1) and got[2] == (want, 1) and got[3][1] == 3
