"""SimHash near-duplicates found through Golay-code keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The perfect
(23, 12) Golay code has a codeword within 3 bits of every 23-bit word; a word's keys
are the indices of the codewords within 3 bits or, for words 3 bits from their
codeword, within 4 (six of them).  Two words that differ in at most 2 bits always
share a key.  By the pigeonhole principle fingerprints that differ in at most 4 bits
then agree in one of

* a key of the first and a key of the second segment (at most 2 errors in both),
* the second segment as it is, or one of its keys and the third segment
  (3 or more errors in the first, so at most one elsewhere),
* the same with the first segment (3 or more errors in the second).

Fingerprints that share such a key are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_uneven, masked, partitions, unmasked, written
from .components import connected_components
from .textbytes import blocks, emit, lower_ascii, runs

MAX_BITS = 4
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
# Generator polynomial of the (23, 12) binary Golay code.
_GOLAY = 0xAE3


def word_shingle_hashes(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every ``size``-word shingle of each text, and shingles per text.

    A text of fewer words has one shingle of all its words, a text without words none.
    """
    low = lower_ascii(buf)
    at, end = runs(~_BLANK[low], offsets)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    # All words one after another with a blank after each.
    length = end - at + 1
    new = np.concatenate(([0], np.cumsum(length)))
    spaced = low[np.minimum(np.repeat(at - new[:-1], length) + np.arange(new[-1]), len(low) - 1)]
    spaced[new[1:] - 1] = 32
    word = np.searchsorted(at, offsets)
    words = np.diff(word)
    shingles = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    before = np.concatenate(([0], np.cumsum(shingles)))
    first = np.repeat(word[:-1] - before[:-1], shingles) + np.arange(before[-1])
    last = np.minimum(first + size, np.repeat(word[1:], shingles))
    raw, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    pairs = zip(new[first].tolist(), (new[last] - 1).tolist())
    return np.fromiter((digest(raw[s:e], 42) for s, e in pairs), np.uint64, len(first)), shingles


def fingerprints_of(column: pa.Array, size: int) -> np.ndarray:
    """The SimHash fingerprint of every text: a bit is 1 if set in over half of the hashes."""
    out = np.zeros(len(column), np.uint64)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for row, offsets, buf in blocks(column, limit=1 << 20, cut=False):
        h, n = word_shingle_hashes(buf, offsets, size)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        counts, step = np.zeros((len(full), 64), np.int64), 1 << 18
        starts = np.concatenate(([0], np.cumsum(n[full])))
        for lo in range(0, len(h), step):  # slices bound what one long text needs
            hi = min(len(h), lo + step)
            a = int(np.searchsorted(starts, lo, side="right")) - 1
            b = int(np.searchsorted(starts, hi, side="left"))
            bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[a:b] += np.add.reduceat(bits, np.maximum(starts[a:b], lo) - lo, axis=0, dtype=np.int32)
        out[row + full] = ((2 * counts > n[full][:, None]) * weight).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", size: int = 4, name: str = "fp") -> DataFrame:
    """The columns ``keep`` of ``docs`` and a BIGINT fingerprint (the unsigned value's bits)."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(text), size).view(np.int64)
            yield from emit(batch, keep, {name: pa.array(fp)})

    return docs.mapInArrow(run, schema)


@lru_cache(maxsize=1)
def golay_patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high 12 and low 11 bits, error patterns (2048, 6) by syndrome, and how many count."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= _GOLAY << (bit - 11)
        return word

    high = np.array([syndrome(i << 11) for i in range(1 << 12)], np.int64)
    low = np.arange(1 << 11, dtype=np.int64)
    single = [int(high[1 << (b - 11)]) if b >= 11 else 1 << b for b in range(23)]
    found: dict[int, list[int]] = {0: [0]}
    for weight in (1, 2, 3, 4):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            known = found.setdefault(s, [])
            if weight < 4 and not known or weight == 4 and known[0].bit_count() == 3:
                known.append(sum(1 << b for b in bits))
    patterns = np.array([(found[s] + found[s][:1] * 6)[:6] for s in range(1 << 11)], np.int64)
    return high, low, patterns, np.array([len(found[s]) for s in range(1 << 11)], np.int64)


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit codeword indices (n, 6) of 23-bit words, and how many of the six differ."""
    high, low, patterns, count = golay_patterns()
    s = high[words >> 11] ^ low[words & 0x7FF]
    return (words[:, None] ^ patterns[s]) >> 11, count[s]


def fingerprint_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, position of the fingerprint) pairs of an array of unsigned fingerprints."""
    one = (fp >> np.uint64(41)).astype(np.int64)
    two = (fp >> np.uint64(18) & np.uint64(0x7FFFFF)).astype(np.int64)
    three = (fp & np.uint64(0x3FFFF)).astype(np.int64)
    (k1, n1), (k2, n2) = golay_keys(one), golay_keys(two)
    every, six = np.arange(len(fp)), np.arange(6)
    use1, use2 = six < n1[:, None], six < n2[:, None]
    keys, rows = [], []

    def add(kind: int, key: np.ndarray, use: np.ndarray) -> None:
        keys.append(key[use] | np.int64(kind) << 40)
        rows.append(np.broadcast_to(every.reshape(-1, *[1] * (key.ndim - 1)), key.shape)[use])

    add(0, k1[:, :, None] << 12 | k2[:, None, :], use1[:, :, None] & use2[:, None, :])
    add(1, k2 << 18 | three[:, None], use2)
    add(2, k1 << 18 | three[:, None], use1)
    add(3, two, np.ones(len(fp), bool))
    add(4, one, np.ones(len(fp), bool))
    return np.concatenate(keys), np.concatenate(rows)


SMALL_RUN, LARGE_RUN = 12, 4096


def _forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (positions) that connect what the links of at most ``bits`` differing bits connect."""
    if len(fp) > LARGE_RUN:
        # Linked fingerprints agree in one of bits + 1 slices: look for links within these only.
        out: list[tuple[int, int]] = []
        edges = np.linspace(0, 64, bits + 2).astype(int)
        for lo, hi in zip(edges, edges[1:]):
            piece = fp >> np.uint64(lo) & np.uint64((1 << int(hi - lo)) - 1)
            order = np.argsort(piece, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
                if len(group) > 1:
                    out += [(int(group[a]), int(group[b])) for a, b in _search(fp[group], bits)]
        return out
    return _search(fp, bits)


def _search(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest by breadth-first search, comparing with what is not yet reached."""
    left, out = np.arange(len(fp)), []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= bits
            if near.any():
                reached = left[near].tolist()
                out += [(at, r) for r in reached]
                frontier += reached
                left = left[~near]
    return out


def links_in_runs(keys: np.ndarray, fp: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among fingerprints of equal key in arrays sorted by key, enough to connect them."""
    out = []
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(begin, len(keys)))
    small = np.repeat(size <= SMALL_RUN, size)
    for d in range(1, min(SMALL_RUN, int(size.max(initial=0)))):
        same = np.flatnonzero((keys[d:] == keys[:-d]) & small[:-d])
        same = same[np.bitwise_count(fp[same] ^ fp[same + d]) <= bits]
        out.append((fp[same], fp[same + d]))
    for k in np.flatnonzero(size > SMALL_RUN):
        run = fp[begin[k] : begin[k] + size[k]]
        if pairs := _forest(run, bits):
            a, b = np.array(pairs).T
            out.append((run[a], run[b]))
    return out


def near_fingerprints(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``prints`` (fp).

    They connect exactly what all pairs of at most ``bits`` (up to 4) differing bits
    connect; a large bucket yields a spanning forest instead of its pairs.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the Golay keys find up to {MAX_BITS} differing bits")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            key, row = fingerprint_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], names=["key", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_k, keep_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in _then_none(batches):
            if batch is not None:
                keep_k = np.concatenate((keep_k, np.asarray(batch.column("key"))))
                keep_f = np.concatenate((keep_f, np.asarray(batch.column("fp")).view(np.uint64)))
                full = int(np.searchsorted(keep_k, keep_k[-1])) if len(keep_k) else 0  # the last run may go on
            else:
                full = len(keep_k)
            if full:
                found = links_in_runs(keep_k[:full], keep_f[:full], bits)
                keep_k, keep_f = keep_k[full:], keep_f[full:]
                for a, b in found:
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    keys = prints.select("fp").mapInArrow(explode, "key long, fp long")
    n = partitions(prints.sparkSession)
    return keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(link, "a long, b long")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def _with_roots(prints: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Every distinct fingerprint with its number of rows and its component's root; (root, fingerprints of it).

    ``prints`` has fp and a column ``least``, of which each fingerprint's minimum is kept.
    """
    distinct = written(prints.groupBy("fp").agg(F.min("least").alias("least"), F.count("*").alias("n")), "distinct")
    roots = connected_components(near_fingerprints(distinct, bits))
    nodes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    nodes = written(nodes, "nodes")
    return nodes, written(nodes.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("size")), "components")


def simhash_groups(docs: DataFrame, bits: int = MAX_BITS, size: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``: near-duplicate groups.

    component_id is the smallest doc_id reachable over links of at most ``bits``
    differing bits.  Texts without words (null, empty, blank) have fingerprint zero and
    link like any other; texts of any length count whole; rows of one fingerprint are one
    node, so repeated rows and large groups of copies cost one row each; other columns of
    ``docs`` are not read; an empty table gives an empty one.
    """
    prints = written(fingerprints(docs.select(doc_id, text), [doc_id], text, size).select(F.col(doc_id).alias("doc_id"), "fp"), "prints")
    nodes, components = _with_roots(prints.withColumn("least", F.col("doc_id")), bits)
    named = join_uneven(nodes.drop("least"), components.withColumnRenamed("least", "component_id"), "root", "size", nodes.count())
    named = written(named.select("fp", "n", "component_id"), "named")
    return join_uneven(prints, named, "fp", "n", prints.count()).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, bits: int = MAX_BITS, size: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns and values as they are.

    The row of the smallest doc_id stays; of several with that id one that a hash of all
    columns chooses, so the same at every run.  Groups are of rows: rows of one doc_id
    and different texts may be in different groups and then both stay.  Texts without
    words (null, empty, blank) are copies of each other.  Rows without doc_id all stay.
    An empty table stays empty.
    """
    inner, names = masked(docs)
    doc_id, text = names["doc_id"], names["text"]
    plain = [c for c, kind in inner.dtypes if "map<" not in kind and kind not in ("void", "variant")]
    marked = inner.where(F.col(doc_id).isNotNull()).withColumn("mark", F.xxhash64(*plain))
    prints = written(fingerprints(marked.select(doc_id, "mark", text), [doc_id, "mark"], text, size), "prints")
    _, components = _with_roots(prints.withColumn("least", F.struct(doc_id, "mark")), bits)
    kept = marked.join(components.select(F.col("least")[doc_id].alias(doc_id), "least.mark"), [doc_id, "mark"], "left_semi").dropDuplicates([doc_id, "mark"])
    return unmasked(kept.select(*inner.columns).unionByName(inner.where(F.col(doc_id).isNull())), names)
