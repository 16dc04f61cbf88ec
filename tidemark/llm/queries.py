"""The numbered queries of this subpackage, bound to the driver's tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, covertree, langid, licenses, mixing, packing, quality, rans, resample, simhash, suffixes, threshold, urls
from .common import shared_dir, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, end_id=2)


# The rules of the URL query.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every embedding whose id is divisible by 20."""
    return threshold.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("licenses")


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and groups of all embeddings."""
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents that bring the languages' tokens to tempered weights."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, docs.select("doc_id", F.col("lang").alias("domain")))[1].drop("posterior")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by SimHash and Golay keys."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights and the Gumbel top-k selection of all documents."""
    return quality.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[2]


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rans.write_tokens(table(spark, sf_dir, "documents"), path, VOCABULARY, end_id=1)
    return rans.read_tokens(spark, path)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, ["doc_id"])


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings and the digest of the codebooks."""
    books, codes = codebooks.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return codes.withColumn("codebooks_sha256", F.lit(codebooks.digest(books)))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents towards the benchmark texts, and the drawn twentieth."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words that earlier equal windows of 20 words cover."""
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"), 20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_urls": op2_urls,
    "op3_top_k": op3_top_k,
    "op4_licenses": op4_licenses,
    "op5_near_vectors": op5_near_vectors,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_token_files": op9_token_files,
    "op10_language": op10_language,
    "op11_codes": op11_codes,
    "op12_resample": op12_resample,
    "op13_repeats": op13_repeats,
}

_FINE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_DOT = "list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))"

ORACLE_SQL: dict[str, str] = {
    "op3_top_k": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {_FINE}),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST({_DOT} AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
    "op5_near_vectors": f"""WITH RECURSIVE u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE {_FINE}),
        v AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS n FROM u),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.n > 0 AND b.n > 0 AND {_DOT} / (a.n * b.n) >= 0.95),
        reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
        c AS (SELECT a, least(a, min(b)) AS m FROM reach GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT e.vec_id, coalesce(k.n, 0) AS n_links, coalesce(c.m, e.vec_id) AS component_id, coalesce(c.m, e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id""",
}


def _codes_sql(rounds: int = 6) -> str:
    """Plain Lloyd rounds, one after another; a part's key puts the distance before the index."""
    near = """(SELECT p.vec_id, p.part, p.x, min(CAST(list_sum(list_transform(range(1, 9), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) AS BIGINT) * 16 + b.entry) AS best
        FROM p JOIN {book} b USING (part) GROUP BY ALL)"""
    mean = """SELECT part, entry, list(m ORDER BY i) AS x FROM (SELECT part, best % 16 AS entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m
        FROM {near}, range(1, 9) t(i) GROUP BY ALL) GROUP BY ALL"""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {_FINE})""",
        "p AS MATERIALIZED (SELECT vec_id, part, x[8 * part + 1 : 8 * part + 8] AS x FROM v, range(0, 8) t(part))",
        """b0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 16) USING (vec_id))""",
    ]
    for r in range(rounds):
        new = mean.format(near=near.format(book=f"b{r}"))
        steps.append(f"m{r} AS MATERIALIZED ({new})")
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (part, entry))")
    return f"""WITH {", ".join(steps)},
        n AS MATERIALIZED {near.format(book=f"b{rounds}")},
        c AS (SELECT vec_id, string_agg(printf('%02x', best % 16), '' ORDER BY part) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM n GROUP BY vec_id),
        d AS (SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM b{rounds}, range(1, 9) t(i))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), d"""


ORACLE_SQL["op11_codes"] = _codes_sql()

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The CRC-32 of every distinct feature, byte by byte over its table k, is computed in SQL too.
ORACLE_SQL["op12_resample"] = f"""WITH w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
          FROM (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)),
        f AS MATERIALIZED (SELECT kind, id, array_to_string(w[i : i + n - 1], ' ') AS f, count(*) AS c FROM w, range(1, 4) s(n), unnest(range(1, len(w) + 2 - n)) u(i) GROUP BY ALL),
        k AS MATERIALIZED (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY b) AS k FROM range(0, 256) t(b)),
        h AS MATERIALIZED (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))),
            lambda c, b: xor(k[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), k),
        g AS MATERIALIZED (SELECT * FROM f JOIN h USING (f)),
        n AS (SELECT bucket, coalesce(sum(c) FILTER (kind = 0), 0) AS s, coalesce(sum(c) FILTER (kind = 1), 0) AS t FROM g GROUP BY bucket),
        a AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
        gain AS (SELECT bucket, floor(1000 * ln((CAST(n.t AS DOUBLE) + 1) * (CAST(a.s AS DOUBLE) + 10000) / ((CAST(n.s AS DOUBLE) + 1) * (CAST(a.t AS DOUBLE) + 10000)))) AS gain FROM n, a),
        d AS (SELECT id, CAST(sum(c) AS BIGINT) AS n_features, CAST(sum(c * gain) AS BIGINT) AS weight FROM g JOIN gain USING (bucket) WHERE kind = 0 GROUP BY id),
        e AS (SELECT w.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN d USING (id) WHERE kind = 0),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 5 // 100 FROM r) THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)"""

ORACLE_SQL["op13_repeats"] = """WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, i, list_aggregate(w[i : i + 19], 'string_agg', ' ') AS x FROM w, unnest(range(1, len(w) - 18)) t(i)),
        r AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
        c AS MATERIALIZED (SELECT DISTINCT doc_id, i + j AS i FROM r, range(0, 20) t(j)),
        u AS (SELECT w.doc_id, i, w[i] AS x, c.i IS NOT NULL AS gone FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) w LEFT JOIN c USING (doc_id, i)),
        t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM u GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)"""
