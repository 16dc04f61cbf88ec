import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, rans, textbytes, tokens
from tidemark.llm.tokens import TextEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, ENCODER = Tokenizer.from_file(PATH), TextEncoder(PATH)


def encoded(texts):
    out = [[] for _ in texts]
    for row, ids, lengths in ENCODER.encode(pa.array(texts, pa.string())):
        at = 0
        for k, n in enumerate(lengths):
            out[row + k] += ids[at : at + n].tolist()
            at += n
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text(st.characters(max_codepoint=255)), st.text("abÉéßÀ×÷'st 1²!%\n\t"))))
def test_encoder_equals_the_library(texts):
    assert encoded(texts) == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 7, 2048, 5000, 300_000])
def test_segment_round_trip(n, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_IDS", 1 << 16)
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.001, n), 49_000).astype(np.int32)
    data = rans.encode_segment(np.arange(3), np.array([n, 0, 0]), ids)
    seg = rans.Segment(data)
    assert (seg.ids() == ids).all() and seg.lengths.tolist() == [n, 0, 0]
    if n > 1 << 17:
        assert (seg.block(1) == ids[1 << 16 : 2 << 16]).all()  # any block by itself
        assert len(data) < 1.7 * n  # 11.4 bits an id, and lane states of small blocks
        with pytest.raises(ValueError):
            rans.Segment(data[:-2] + b"zz").block(len(seg.points) - 1)


def test_one_symbol_only():
    assert rans.Segment(rans.encode_segment(np.arange(1), np.array([9]), np.full(9, 5, np.int32))).ids().tolist() == [5] * 9


@pytest.mark.parametrize("small", [False, True])
def test_files_round_trip(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(rans, "SEGMENT_IDS", 50)
    texts = [(None, "no id"), (None, None), (-5, "below"), (3, "Hello world"), (1, None), (2, ""), (7, "x" * 3000 + " é 日本"), (7, "again"), (5, "it's 2²")] + [(10 + i, f"word {i}" * (i % 50)) for i in range(200)]
    df = spark.createDataFrame([(a, b, 0, "s") for a, b in texts], "doc_id long, text string, start int, segment string")
    rans.write_tokens(df, f"{tmp_path}/t", PATH, 1)
    got = sorted(map(tuple, rans.read_tokens(spark, f"{tmp_path}/t").collect()), key=lambda r: r[1])
    want, at = [], 0
    for d, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_empty_table(spark, tmp_path):
    rans.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e", PATH, 1)
    assert rans.read_tokens(spark, f"{tmp_path}/e").collect() == []


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("block", [64, 1 << 19])
def test_words_of_equal_hash_keep_their_ids(monkeypatch, block):
    """Polynomial hashes meet at complementary Thue-Morse words; positions may meet 4096 letters apart."""
    monkeypatch.setattr(textbytes, "BLOCK_BYTES", block)
    texts = []
    for n in (64, 1024, 2048, 4096):
        one = thue_morse(n)
        two = one.translate(str.maketrans("ab", "ba"))
        texts += [f"{one} {two}", two, one]
    texts += ["z" + "q" * 4095 + "y" + "q" * 4000, "y" + "q" * 4095 + "z" + "q" * 4000, "A b\u0301 c " * 40 + "é" * 90]
    assert encoded(texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "hash_runs", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    enc = TextEncoder(PATH)
    assert enc.plain
    text = "one hash for every word, and 1 more é"
    (_, ids, _), = enc.encode(pa.array([text]))
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_long_texts_are_encoded_whole():
    text = "Word été 12 it's " * 60_000
    assert encoded([text, "x", text[:-5].replace("'", "")]) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in (text, "x", text[:-5].replace("'", ""))]


def test_packed_ids_match_the_library(spark):
    rng = np.random.default_rng(5)
    texts = {1: None, 2: "", 3: "é 1 it's", 4: thue_morse(2048) + " " + thue_morse(2048)[::-1], 5: "many words here " * 9000, None: "no id"}
    texts |= {10 + i: " ".join(str(x) for x in rng.integers(0, 9999, int(rng.integers(1, 3000)))) for i in range(60)}
    df = spark.createDataFrame([(d, t, 5, 6) for d, t in texts.items()], "doc_id long, text string, start int, sequence_id int")
    rows = packing.pack(df, PATH, 2).collect()
    used = {}
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        used.setdefault(r.doc_id, []).append((r.start, r.length))
    for d, spans in used.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(spans[-1]) == len(LIBRARY.encode(texts[d] or "", add_special_tokens=False).ids) + 1
    assert set(used) == set(texts)
    assert {len({(r.sequence_id, r.offset) for r in rows})} == {len(rows)}
