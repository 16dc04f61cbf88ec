import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, features, langid, mixing, packing, quality, textbytes
from tidemark.llm.common import top_k_threshold
from tidemark.llm.queries import VOCABULARY

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, posterior string, copies int, domain string, log_weight int"


def words(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def docs(spark):
    """Two invented languages, junk, copies, and odd rows; extra columns clash with what operators add."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        lang = "aa" if i % 3 else "bb"
        text = words(rng, "abcdeé" if lang == "aa" else "uvwxyz", int(rng.integers(20, 120)))
        if i % 10 == 9:
            text = "!!! ### $$$ ".join(text.split())
        rows.append((i, text, lang if i % 7 else None))
    rows += [(300, None, "aa"), (301, "", None), (302, " \n", "bb"), (303, "123 $$", "aa"), (304, rows[0][1], "bb"), (304, rows[0][1], "bb"), (305, "ab " * 60_000, "aa")]
    return spark.createDataFrame([(a, b, c, "src0", 1, 0.5, "p", 3, "d", 9) for a, b, c in rows], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 0 if i % 10 == 9 else 1, 0) for i in range(0, 240, 1) if i % 4 != 1] + [(None, 1, 0), (5, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_language_matches_and_undetermined(docs):
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text", "lang")).collect()}
    for i in range(240):
        assert got[i].lang_pred == ("aa" if i % 3 else "bb")
        assert 0 < got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (300, 301, 302, 303))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4


def test_profiles_equal_direct_bundling():
    texts = ["Ab é a", "", "zz top 1", "x" * 50]
    a, b, c = langid.letter_vectors(64)
    sym = langid.letter_symbols()
    import pyarrow as pa

    got = np.concatenate([h for _, h, _ in langid.profiles(pa.array(texts), 64)])
    for t, h in zip(texts, got):
        s = [0]
        for ch in t:
            k = int(sym[ord(ch)])
            if k or s[-1]:
                s.append(k)
        if s[-1]:
            s.append(0)
        want = sum((a[x].astype(int) * b[y] * c[z] for x, y, z in zip(s, s[1:], s[2:])), np.zeros(64, int))
        assert (h == want).all()


def test_no_labels_at_all(spark, docs):
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.log_weight in (0.0, None) for r in quality.importance_resample(docs, none)[2].collect())


def test_quality_rejects_junk_and_keeps_the_rest(docs, labels):
    docs = docs.where("doc_id <> 305")  # it alone has more words than all others
    _, _, out = quality.importance_resample(docs, labels)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].selected == (i % 10 != 9) for i in range(240))
    assert all(not got[i].selected and got[i].log_weight is None for i in (300, 301, 302))
    kept = quality.select_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id < 240) == [i for i in range(240) if i % 10 != 9]


def test_quality_k_rows(docs, labels):
    _, _, out = quality.importance_resample(docs.where("doc_id < 240"), labels, k=50)
    assert out.where("selected").count() == 50


def test_threshold_is_exact(spark):
    v = np.random.default_rng(0).normal(size=5000).round(2)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    for k in (1, 77, 5000):
        assert top_k_threshold(df, "v", k, bins=16, few=100) == sorted(v, reverse=True)[k - 1]
    assert top_k_threshold(df, "v", 5001) is None


def test_rates_reach_the_targets(docs):
    named = docs.selectExpr("doc_id", "lang AS domain")
    model, out = mixing.mix(docs, named, {"aa": 1.0, "bb": 1.0})
    rows = out.collect()
    p, t, r = np.array([x.posterior for x in rows]), np.array([x.n_tokens for x in rows]), np.array([x.rate for x in rows])
    assert (r >= 0).all() and np.allclose((t * r) @ p / t.sum(), [0.5, 0.5], atol=0.02)
    assert all(abs(x.copies - x.rate) < 1 for x in rows)
    mixed = mixing.mixed_documents(docs, named, {"aa": 1.0, "bb": 1.0})
    assert mixed.columns == docs.columns and mixed.count() == sum(x.copies for x in rows)


def dense_rates(p, t, target, steps=40_000, ridge=1e-6):
    """Projected gradient with the rates as one vector; the slight ridge makes those nearest to one the only solution."""
    w, r = t / t.sum(), np.ones(len(p))
    for _ in range(steps):
        r = np.maximum(0, r - (p @ ((w * r) @ p - target) + ridge * (r - 1)) / (1 + ridge))
    return r


def test_rates_match_dense_projected_gradient(docs):
    """The rates that ``mix`` returns, with rates at zero among them."""
    out = mixing.mix(docs, docs.selectExpr("doc_id", "lang AS domain"), {"aa": 1.0, "bb": 20.0})[1].collect()
    p, t = np.array([x.posterior for x in out]), np.array([x.n_tokens for x in out])
    assert {(x.domain_target, x.domain) for x in out} <= {(1 / 21, "aa"), (20 / 21, "bb")}
    assert all(abs(x.domain_reached / x.domain_target - 1) <= 1e-4 for x in out)
    assert np.allclose([x.rate for x in out], dense_rates(p, t, np.array([1, 20]) / 21), rtol=1e-3, atol=1e-3)


def test_soft_rates_match_dense_projected_gradient(docs):
    rng = np.random.default_rng(2)
    p, t = rng.dirichlet([0.3, 0.3, 0.3], 300), rng.integers(1, 100, 300)
    rows = docs.sparkSession.createDataFrame([(int(n), q.tolist()) for n, q in zip(t, p)], "n_tokens long, posterior array<double>")
    m = mixing.fit_rates(rows, mixing.Mixture(["a", "b", "c"], np.zeros((3, 4))), {"a": 0.7, "b": 0.2, "c": 0.1}, 0.7)
    assert not m.unmet() and (m.rates(p) == 0).any()
    assert np.allclose(m.rates(p), dense_rates(p, t, np.array([0.7, 0.2, 0.1])), atol=5e-3)


def test_packing_places_every_id_once(docs):
    rows = packing.pack(docs, VOCABULARY, 2).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {r.doc_id for r in docs.select("doc_id").collect()}
    for d, pieces in by_doc.items():
        copies = 2 if d == 304 else 1
        assert sum(p.length for p in pieces) == copies * pieces[0].doc_tokens
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 4096


def test_patterns_beat_first_fit_and_cover_demand():
    sizes = {150: 40, 210: 33, 300: 20, 90: 60, 512: 5, 33: 11}
    plan = packing.plan_sequences(sizes, 512)
    for s, n in sizes.items():
        assert sum(c.get(s, 0) * k for c, k in plan) >= n
    assert all(sum(s * k for s, k in c.items()) <= 512 for c, _ in plan)
    used, ideal = sum(k for _, k in plan), sum(s * n for s, n in sizes.items()) / 512
    assert used <= 1.05 * ideal + 6
    assert packing.plan_sequences({}, 512) == []


def test_empty_tables(spark, labels):
    empty = spark.createDataFrame([], DOC)
    assert quality.importance_resample(empty, labels)[2].collect() == []
    assert langid.identify(empty.select("doc_id", "text", "lang")).collect() == []
    assert mixing.mix(empty, empty.selectExpr("doc_id", "lang AS domain"))[1].collect() == []
    assert packing.pack(empty, VOCABULARY, 2).collect() == []


def test_pipeline_stages_keep_columns(spark, docs, labels, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == plain.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 0 < out.select("doc_id").distinct().count() < plain.count()


def test_no_long_text_leads_the_quality_models(docs, labels):
    """Document 305 has more words than all others together."""
    got = {r.doc_id: r for r in quality.importance_resample(docs, labels)[2].collect()}
    assert all(got[i].selected == (i % 10 != 9) for i in range(240))


def brute_weights(rows, labelled):
    """Log weights from formulas alone: per-document n-gram lists, dictionaries, floats."""
    grams = {}
    for d, text in rows:
        kinds = [[*m.groups()] for m in re.finditer(r"([0-9A-Za-z\u0080-\U0010ffff]+)|([^\s0-9A-Za-z\u0080-\U0010ffff]+)", text or "")]
        tokens = [a or b for a, b in kinds]
        grams[d] = tokens + [("pair", a, b) if a != b else "repeat" for a, b in zip(tokens, tokens[1:])]
    kept = [d for d, v, held in labelled if v == 1 and not held]
    bound, slots = quality.EVIDENCE, quality.SLOTS
    raw, target = {}, {}
    for d, g in grams.items():
        for x in g:
            raw[x] = raw.get(x, 0) + bound / max(len(g), bound)
            if d in kept:
                target[x] = target.get(x, 0) + bound / max(len(g), bound)
    total, mine = sum(raw.values()) + slots, sum(target.values())
    out = {}
    for d, g in grams.items():
        e = {x: (raw[x] + 1) / total for x in g}
        s = sum(math.log((target.get(x, 0) + quality.PRIOR * slots * e[x]) / (mine + quality.PRIOR * slots) / e[x]) for x in g)
        out[d] = s * min(1, bound / len(g)) if g else None
    return out


def test_weights_match_brute_force(spark):
    """Few enough n-grams that hardly any two share a slot (those that do are left out)."""
    rng = np.random.default_rng(6)
    names = ["ab", "Cd", "é", "x1", "--", "zz", "qq"]
    rows = [(i, " ".join(rng.choice(names, rng.integers(1, 90)))) for i in range(40)] + [(90, None), (91, " ")]
    df = spark.createDataFrame([(d, t, 7.0) for d, t in rows], "doc_id long, text string, log_weight double")
    model, _, out = quality.importance_resample(df, spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int"))
    want = brute_weights(rows, model.labelled.select("key", "value", "held").collect())
    got = {r.doc_id: r.log_weight for r in out.collect()}
    assert got[90] is None and got[91] is None
    assert all(got[d] == pytest.approx(want[d], abs=0.35) for d, _ in rows[:40])
    assert np.corrcoef([got[d] for d in range(40)], [want[d] for d in range(40)])[0, 1] > 0.995


def test_cut_tells_labelled_weights_apart():
    good, bad = np.array([-3.0, 0.0, 1.0, 2.0]), np.array([-40.0, -35.0, -20.0])
    cut = quality.cut_between(np.concatenate((good, bad)), np.array([True] * 4 + [False] * 3))
    assert -17 < cut < -5
    assert quality.cut_between(good, np.ones(4, bool)) == float("-inf")


@pytest.mark.parametrize("block", [64, 700])
def test_blocks_do_not_change_results(spark, docs, labels, monkeypatch, block):
    """Texts cut at any size give what whole texts give (executors see the patched module: local mode)."""
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    column = pa.array([t for t in texts if t is None or len(t) < 3000], pa.string())

    def grams(slots):
        out = {}
        for row, slot, doc, _ in features.ngram_slots(column, slots):
            for s, d in zip(slot.tolist(), doc.tolist()):
                out.setdefault(row + d, []).append(s)
        return {d: sorted(s) for d, s in out.items()}

    def bounded():
        out = np.zeros((len(column), 500))
        for row, slot, doc, weight in features.bounded_counts(column, 500, 50, 1 << 26):
            np.add.at(out, (row + doc, slot), weight)
        return out

    def letters():
        out = {}
        for row, h, k in langid.profiles(column, 64):
            for i in range(len(k)):
                out[row + i] = (h[i].tolist(), int(k[i]))
        return out

    whole = grams(1 << 40), bounded(), letters()
    monkeypatch.setattr(textbytes, "BLOCK_BYTES", block)
    cut = grams(1 << 40), bounded(), letters()
    assert whole[0] == cut[0] and (whole[1] == cut[1]).all() and whole[2] == cut[2]


@pytest.mark.parametrize("block", [64, 300])
def test_language_profiles_do_not_depend_on_blocks(docs, monkeypatch, block):
    rows = [r for r in docs.where("doc_id < 80 OR doc_id = 305").orderBy("doc_id").collect() if r.lang and r.text]
    batches = [pa.RecordBatch.from_arrays([pa.array([r.text[:40_000] for r in part]), pa.array([r.lang for r in part])], names=["text", "lang"]) for part in (rows[:30], rows[30:])]
    whole = langid.bundled(batches, 64)
    monkeypatch.setattr(textbytes, "BLOCK_BYTES", block)
    cut = langid.bundled(batches, 64)
    assert whole.keys() == cut.keys() == {"aa", "bb"} and all(np.allclose(whole[k], cut[k], atol=1e-9) for k in whole)
    # Every text weighs one: the profiles are sums of the texts' own ones over their trigrams.
    texts = {"aa": 0, "bb": 0}
    for r in rows:
        (_, h, _), *_ = [x for x in langid.profiles(pa.array([r.text[:40_000]]), 64)][-1:]
        texts[r.lang] = texts[r.lang] + h[0] / sum(len(c) for _, _, c, _, _ in langid.text_blocks(pa.array([r.text[:40_000]])))
    assert all(np.allclose(whole[k], texts[k], rtol=1e-4, atol=1e-3) for k in whole)


CLASH = ["Score", "held_out", "LANG_PRED", "log_weight", "gumbel_key", "selected", "_copy", "copy", "copies", "rate", "domain", "posterior", "n_tokens", "_0", "_1", "c0", "c1", "c2", "fp", "mark", "least", "root", "n"]


def test_stages_keep_values_of_clashing_columns(spark, docs, labels, tmp_path):
    """All stages but the last return rows as they came, whatever their columns are called."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in CLASH])
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = common.written(stage(spark, d, str(tmp_path)), "stage")
        assert d.columns == rows.columns, name
        assert d.distinct().exceptAll(rows.distinct()).isEmpty(), name
    assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() > 0


def test_pipeline_of_nothing_and_of_repeated_ids(spark, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    rng = np.random.default_rng(3)
    a, b = words(rng, "abcde", 60), words(rng, "uvwxyz", 60)
    rows = [(1, a, "aa", "s", 1), (2, a, "aa", "s", 1), (2, b, "bb", "s", 1), (3, b, None, "s", 1), (None, b, "bb", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/twice/documents.parquet")
    labels.write.parquet(f"{tmp_path}/twice/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/twice/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        d = common.written(stage(spark, d, f"{tmp_path}/twice"), "stage")
    assert {(r.doc_id, r.text) for r in d.collect()} == {(1, a), (2, b), (None, b)}  # row 3 repeats row 2's text
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/twice").collect()} <= {1, 2, None}
