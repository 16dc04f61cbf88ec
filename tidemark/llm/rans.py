"""Token files in a static range asymmetric numeral system.

Documents are dealt in ascending id order to segments.  A segment is one byte string,
stored as one row of a Parquet file (so Spark commits, splits and recovers it), with

    magic "TMR2", sizes, frequency table, document table, block table, blocks

* the frequency table counts the segment's own ids, scaled to 2**SCALE_BITS, and is
  shared by all of its blocks;
* a block holds up to BLOCK_IDS ids in LANES interleaved coder states: id i goes to
  lane i mod LANES, and all lanes advance together, as one vector operation;
* the block table has, per block, a checkpoint (first id, number of ids, byte offset)
  and a CRC-32 of its bytes, so that any block can be decoded alone and in parallel.

Documents without id come first; a bit of the document table marks them.

All integers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions
from .tokens import encoder, whole_rows

MAGIC = b"TMR2"
SCALE_BITS, LANES, BLOCK_IDS = 20, 2048, 1 << 18
SEGMENT_IDS = 1 << 21
NO_ID = -(1 << 63)
"""Stands in the document table, and for a task's first document, where there is no id."""
_LOW = np.uint64(1) << np.uint64(32)  # states stay in [2**32, 2**64)
_WORD = np.uint64(32)


def scaled_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and positive frequencies that add up to 2**SCALE_BITS, near to their counts."""
    symbols, counts = np.unique(ids, return_counts=True)
    total = 1 << SCALE_BITS
    if not len(symbols):
        return symbols.astype(np.int64), counts.astype(np.int64)
    if len(symbols) > total:
        raise ValueError(f"over {total} distinct ids in one segment")
    free = total - len(symbols)
    exact = counts / counts.sum() * free
    freq = np.floor(exact).astype(np.int64)
    rest = np.argsort(-(exact - freq), kind="stable")[: free - int(freq.sum())]
    freq[rest] += 1
    return symbols.astype(np.int64), freq + 1


def encode_block(at: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    """A block of positions in the symbol table: lane states, then the 32-bit words in reading order."""
    n = len(at)
    rows = -(-n // LANES)
    state = np.full(LANES, _LOW, np.uint64)
    f, c, words = freq.astype(np.uint64), start.astype(np.uint64), []
    limit = f << np.uint64(64 - SCALE_BITS)
    for r in range(rows - 1, -1, -1):
        s = at[r * LANES : min(n, (r + 1) * LANES)]
        x, fs = state[: len(s)], f[s]
        # A frequency of the whole scale makes the limit wrap to 0: such a state never overflows.
        over = (x >= limit[s]) & (limit[s] != 0)
        words.append((x[over] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
        x = np.where(over, x >> _WORD, x)
        q = x // fs
        state[: len(s)] = (q << np.uint64(SCALE_BITS)) + (x - q * fs) + c[s]
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, "<u4")
    return state.astype("<u8").tobytes() + stream.tobytes()


def decode_block(data: bytes, n: int, lookup: np.ndarray, freq: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The positions in the symbol table that ``encode_block`` wrote."""
    state = np.frombuffer(data, "<u8", LANES).astype(np.uint64)
    stream = np.frombuffer(data, "<u4", offset=8 * LANES).astype(np.uint64)
    f, c, mask = freq.astype(np.uint64), start.astype(np.uint64), np.uint64((1 << SCALE_BITS) - 1)
    out, p = np.empty(n, np.int64), 0
    for r in range(-(-n // LANES)):
        lo, hi = r * LANES, min(n, (r + 1) * LANES)
        x = state[: hi - lo]
        slot = x & mask
        s = lookup[slot.astype(np.int64)]
        out[lo:hi] = s
        x = f[s] * (x >> np.uint64(SCALE_BITS)) + slot - c[s]
        under = np.flatnonzero(x < _LOW)
        x[under] = x[under] << _WORD | stream[p : p + len(under)]
        p += len(under)
        state[: hi - lo] = x
    if p != len(stream):
        raise ValueError("a block does not end where its ids end")
    return out


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, null: np.ndarray | None = None) -> bytes:
    """One segment: documents (ids, lengths in ids, and which have no id) and all their token ids."""
    null = np.zeros(len(doc_ids), bool) if null is None else null
    symbols, freq = scaled_counts(ids)
    start = np.cumsum(freq) - freq
    at = np.searchsorted(symbols, ids)
    blocks = [encode_block(at[k : k + BLOCK_IDS], freq, start) for k in range(0, len(ids), BLOCK_IDS)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype(np.int64)
    points = np.zeros(len(blocks), "<i8,<i8,<i8,<u4")
    for k, b in enumerate(blocks):
        points[k] = (k * BLOCK_IDS, min(BLOCK_IDS, len(ids) - k * BLOCK_IDS), offsets[k], zlib.crc32(b))
    pack = lambda a, kind: zlib.compress(np.ascontiguousarray(a, kind).tobytes(), 6)
    parts = [pack(np.diff(symbols, prepend=0), "<u4"), pack(freq, "<u4"), pack(doc_ids, "<i8"), pack(lengths, "<i8"), pack(np.packbits(null), "u1"), points.tobytes()]
    head = struct.pack("<4sIQQ6Q", MAGIC, len(doc_ids), len(ids), len(symbols), *map(len, parts))
    return head + struct.pack("<I", zlib.crc32(head + b"".join(parts))) + b"".join(parts) + b"".join(blocks)


class Segment:
    """A reader of one segment; ``block(k)`` decodes any block by itself."""

    def __init__(self, data: bytes):
        shape = "<4sIQQ6Q"
        size = struct.calcsize(shape)
        magic, docs, self.n_ids, n_symbols, *sizes = struct.unpack_from(shape, data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        (check,) = struct.unpack_from("<I", data, size)
        ends = size + 4 + np.cumsum([0, *sizes])
        if zlib.crc32(data[:size] + data[size + 4 : ends[-1]]) != check:
            raise ValueError("a segment's tables are damaged")
        parts = [data[a:b] for a, b in zip(ends, ends[1:])]
        self.symbols = np.cumsum(np.frombuffer(zlib.decompress(parts[0]), "<u4").astype(np.int64))
        self.freq = np.frombuffer(zlib.decompress(parts[1]), "<u4").astype(np.int64)
        self.start = np.cumsum(self.freq) - self.freq
        self.lookup = np.repeat(np.arange(n_symbols), self.freq).astype(np.int32)
        self.doc_ids = np.frombuffer(zlib.decompress(parts[2]), "<i8")
        self.lengths = np.frombuffer(zlib.decompress(parts[3]), "<i8")
        self.null = np.unpackbits(np.frombuffer(zlib.decompress(parts[4]), np.uint8), count=docs).astype(bool)
        self.points = np.frombuffer(parts[5], "<i8,<i8,<i8,<u4")
        self.data, self.body = data, int(ends[-1])

    def block(self, k: int) -> np.ndarray:
        """Block ``k``'s token ids; raises if its checksum differs."""
        _, n, offset, check = self.points[k].tolist()
        stop = self.points[k + 1][2] if k + 1 < len(self.points) else len(self.data) - self.body
        raw = self.data[self.body + offset : self.body + int(stop)]
        if zlib.crc32(raw) != check:
            raise ValueError(f"block {k} is damaged")
        return self.symbols[decode_block(raw, n, self.lookup, self.freq, self.start)]

    def ids(self) -> np.ndarray:
        """All token ids."""
        return np.concatenate([self.block(k) for k in range(len(self.points))] or [np.zeros(0, np.int64)])


_SEGMENT_ROW = pa.schema([("task_doc", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("segment", pa.binary())])


def _segments(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Segments of one task; each row names the task by its first document and counts the task's ids before it."""
    enc = encoder(vocabulary)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    task_doc, before, n_held = None, 0, 0

    def flush() -> pa.RecordBatch:
        docs, lengths, ids, null = (np.concatenate(x) for x in zip(*held))
        row = [[task_doc], [before], [len(ids)], [encode_segment(docs, lengths, ids, null)]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _SEGMENT_ROW)], schema=_SEGMENT_ROW)

    for batch in batches:
        docs, null = np.asarray(batch.column("doc_id").fill_null(NO_ID)), np.asarray(batch.column("doc_id").is_null())
        for row, ids, lengths in whole_rows(enc.encode(batch.column("text"))):
            with_end = np.insert(ids, np.cumsum(lengths), end_id)
            mine = slice(row, row + len(lengths))
            held.append((docs[mine], lengths + 1, with_end, null[mine]))
            task_doc = int(docs[row]) if task_doc is None else task_doc
            n_held += len(with_end)
            if n_held >= SEGMENT_IDS:
                yield flush()
                before, n_held, held = before + n_held, 0, []
    if held:
        yield flush()


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Writes the token ids of every text, ``end_id`` after each, in ascending doc_id order to ``path``.

    A null text is empty and gives ``end_id`` alone; texts of any length are encoded whole;
    rows of one doc_id (repeated ones too) follow each other in text order; rows without
    doc_id come before all others; an empty table gives files without segments.  Other
    columns are not read.  A hot doc_id is not split: its rows are written by one task,
    segment by segment.
    """
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = named.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _segments(batches, vocabulary, end_id)

    out = placed.mapInArrow(run, "task_doc long, before long, n_ids long, segment binary")
    out.write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document of token files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; rows come from decoding
    every block of every segment, each checked against its checksum.
    """
    files = spark.read.parquet(path)
    # One row a writing task, whose number the session's shuffle partitions bound.
    tasks = files.groupBy("task_doc").agg(F.sum("n_ids").alias("n"))
    base = tasks.select("task_doc", (F.sum("n").over(Window.orderBy("task_doc")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, first in zip(batch.column("segment"), batch.column("first").to_pylist()):
                seg = Segment(data.as_py())
                raw = seg.ids().astype("<u4")
                ends = np.cumsum(seg.lengths)
                crc = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends.tolist(), seg.lengths.tolist())]
                cols = [pa.array(seg.doc_ids, pa.int64(), mask=seg.null)]
                cols += [pa.array(c, pa.int64()) for c in (first + ends - seg.lengths, seg.lengths, np.array(crc, np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    keyed = files.join(F.broadcast(base), "task_doc").select((F.col("base") + F.col("before")).alias("first"), "segment")
    return keyed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
