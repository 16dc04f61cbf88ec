"""Importance resampling towards a target text collection, over a byte automaton.

Arrow's UTF-8 buffers are read as bytes.  A 256-entry table classifies (and lower-cases)
every byte; words begin and end where neighbouring classes differ.  The CRC-32 of every
run of one to three words is found by a table-driven automaton whose states, one a
starting word, all advance by one byte at a time: a word's state goes on over a blank and
the next word to give the state of the pair, and again for the triple.

Bucket counts of both collections are Spark aggregations of at most ``buckets`` rows; the
gains of the buckets, as many, are all that the driver and each task hold.  Ranks come
from one range partitioning of small rows, without any task that sees them all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, written
from .textbytes import blocks, emit, runs

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_GAP = ~_WORD
# A CRC table entry is the state after one byte from state zero.
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
_TOGETHER = 48
"""Words of more bytes advance alone, from where the others have ended."""


def advance(state: np.ndarray, buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states after the bytes ``buf[at:end]`` of each row, all rows a byte at a time."""
    length = end - at
    order = np.argsort(-length, kind="stable")  # those that still run stand in front
    state, where, length = state[order], at[order], length[order]
    going = np.searchsorted(-length, -np.arange(min(int(length.max(initial=0)), _TOGETHER)), side="left")
    for step, n in enumerate(going.tolist()):
        now = state[:n]
        state[:n] = _CRC[(now ^ buf[where[:n] + step]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    for i in range(int(np.searchsorted(-length, -_TOGETHER, side="left"))):
        rest = buf[where[i] + _TOGETHER : where[i] + length[i]]
        state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def feature_buckets(column: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bucket of every feature, row within the block of each, words of each row) by blocks.

    A text over a block's size comes in several blocks, cut between words; features that
    reach over a cut come with the block they end in.
    """
    tail_row, tail = -1, b""  # the last words of a block of one text, which may go on
    for row, offsets, raw in blocks(column, gap=_GAP):
        n = len(offsets) - 1
        low = _LOWER[raw]
        carried = 0
        if n == 1 and row == tail_row and tail:
            low = np.concatenate((np.frombuffer(tail, np.uint8), low))
            offsets, carried = np.array([0, len(low)]), tail.count(b" ")
        at, end = runs(_WORD[low], offsets)
        bound = np.searchsorted(at, offsets)
        words = np.diff(bound)
        doc = np.repeat(np.arange(n), words)
        if n == 1:
            tail_row = row
            tail = b"".join(low[s:e].tobytes() + b" " for s, e in zip(at[1 - longest :], end[1 - longest :])) if longest > 1 else b""
        start, state = np.arange(len(at)), advance(np.full(len(at), 0xFFFFFFFF, np.uint32), low, at, end)
        found, of = [], []
        for size in range(longest):
            new = start + size >= carried
            found.append(state[new] ^ np.uint32(0xFFFFFFFF))
            of.append(doc[start[new]])
            more = start + size + 1 < bound[1:][doc[start]]
            start, state = start[more], state[more]
            state = _CRC[(state ^ np.uint32(32)) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
            state = advance(state, low, at[start + size + 1], end[start + size + 1])
        if carried:
            words = words - carried
        yield row, (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(of), words


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _, _ in feature_buckets(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of the smoothed ratio of target to raw shares, rounded down."""
    m, s, t = len(raw), float(raw.sum()), float(target.sum())
    ratios = (math.log((float(b) + 1) * (s + m) / ((float(a) + 1) * (t + m))) for a, b in zip(raw.tolist(), target.tolist()))
    return np.array([math.floor(1000 * x) for x in ratios], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_words, n_features and weight, the sum of the features' gains."""
    new = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    schema = T.StructType([*(docs.schema[c] for c in keep), *new])
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.astype(float)  # whole numbers: their sums are exact
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for row, bucket, doc, words in feature_buckets(batch.column(text), len(gain)):
                n = len(words)
                out[0, row : row + n] += words
                out[1, row : row + n] += np.bincount(doc, minlength=n)
                out[2, row : row + n] += np.bincount(doc, gain[bucket], n).astype(np.int64)
            yield from emit(batch, keep, {f.name: pa.array(x) for f, x in zip(new, out)})

    return docs.mapInArrow(run, schema)


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with rank (1, 2, ...) in the given order, by range partitions that each count their own rows."""
    parts = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = written(parts.withColumn("place", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before, start = {}, 1
    for p, n in sorted(placed.groupBy(part.alias("part")).count().collect()):
        before[p] = start
        start += n
    if not before:
        return placed.select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    first = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), part)
    return placed.select(*rows.columns, (first.cast("long") + within).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; the drawn ones have a rank.

    A score is the weight plus Gumbel noise that depends on doc_id and ``seed`` alone, so
    that the highest ``percent`` of the documents with ``least_words`` are a sample drawn by
    importance.  A null or empty text has no features, weight 0 and is not drawn; texts
    of any length count whole; repeated rows count, and are drawn, each; ties of score and
    doc_id come in the order of weight and features; a null doc_id is hashed as an empty
    one and comes last among ties.  Without any target text the gains come from the smoothing alone.
    Other columns are not read; an empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weigh(docs, gains, ["doc_id"]).withColumn("score", F.col("weight") + noise), "scored")
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    out = ranked(scored.where(fit), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = out.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
