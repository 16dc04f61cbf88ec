"""Repeated passages by prefix-partitioned, sparse suffix trees over words.

Of every document those suffixes are kept that begin at a *sampled* place: the place of the
least hashed PREFIX-word string within some window of ``window`` words (of equal ones the
first).  Equal windows sample the same place in themselves, so every window hangs on one
sampled suffix, a few words to its left, and equal windows hang on suffixes with one prefix.

The suffixes are dealt out by prefix.  A group holds the subtree below its prefix: the
node of a window, ``window`` words deep, is named by a hash of its path, and a suffix
carries the names of the nodes that its windows lead to.  A suffix alone in its group is a
leaf and ends there; of the others, a node that several windows reach is an internal one,
deep enough to be a repeat, and all windows but its earliest are marked.  The marked
windows of a document, run together, are its maximal repeats.

The prefix has PREFIX words, or all ``window`` where a group would not fit: prefixes of
more than a HEAVY_SHARE-th of all suffixes (found by counting in every task) are
prolonged, so their windows are dealt out by node and pre-aggregated to its earliest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HEAVY_ROWS, HEAVY_SHARE, join_uneven, partitions, written
from .textbytes import blocks, column_bytes, hash_runs, mix64, runs

PREFIX, WINDOW = 6, 20
NAME_BYTES = 6
"""Of a node's name, besides the 64 bits of its prefix."""
CHUNK = 1 << 16

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def string_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each string of ``length`` consecutive words, from the words' hashes."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, n), dtype=np.uint64)))
    return mix64((sums[length:] - sums[:-length]) * _powers(_BACK, n - length + 1))


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """The first position of the least of each ``width`` consecutive values."""
    best, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        best, have = np.where(values[left] <= values[right], left, right), have + step
    return best


def sampled_suffixes(buf: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, prefix hash, first window, number of windows) of every sampled suffix, and the names of all windows in order."""
    at, end = runs(~_BLANK[buf], offsets)
    words = hash_runs(buf, at, end)
    bound = np.searchsorted(at, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bound))
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    prefix = string_hashes(words, PREFIX)
    place = first_least(prefix, window - PREFIX + 1)
    inside = np.flatnonzero(doc[: len(words) - window + 1] == doc[window - 1 :])
    place, name = place[inside], string_hashes(words, window)[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(new)
    text = doc[inside[first]]
    return text, prefix[place[first]], inside[first] - bound[text], np.diff(np.append(first, len(inside))), name


def _tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text and a tag that tells rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("tag"))


def _suffix_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple]:
    """(doc_id, tag) as Arrow arrays with their rows, and the rest of ``sampled_suffixes``, by blocks of text."""
    for batch in batches:
        for row, offsets, buf in blocks(batch.column("text"), cut=False):
            text, prefix, start, count, name = sampled_suffixes(buf, offsets, window)
            if len(text):
                yield batch.column("doc_id"), batch.column("tag"), row + text, prefix, start, count, name


def heavy_prefixes(docs: DataFrame, window: int = WINDOW) -> np.ndarray:
    """Prefixes of more than a HEAVY_SHARE-th of all sampled suffixes (fewer than HEAVY_SHARE), as good as tasks see them.

    A task reports what makes up half such a share of its own suffixes.  It is only
    decided here which way a group goes; both ways mark the same windows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        held: list[np.ndarray] = []

        def merge() -> None:
            nonlocal keys, counts
            every = np.concatenate([keys, *held])
            weight = np.concatenate([counts, np.ones(len(every) - len(keys), np.int64)])
            keys, inverse = np.unique(every, return_inverse=True)
            counts = np.bincount(inverse, weight, len(keys)).astype(np.int64)
            least = max(2, total // (8 * HEAVY_SHARE))  # what is rarer so far is forgotten
            keys, counts = keys[counts >= least], counts[counts >= least]
            held.clear()

        for _, _, _, prefix, _, _, _ in _suffix_batches(batches, window):
            held.append(prefix)
            total += len(prefix)
            if sum(map(len, held)) > 1 << 20:
                merge()
        merge()
        big = counts >= max(4, total // (2 * HEAVY_SHARE))
        rows = [pa.array(np.append(keys[big].view(np.int64), 0)), pa.array(np.append(counts[big], 0)), pa.array([0] * int(big.sum()) + [total], pa.int64())]
        yield pa.RecordBatch.from_arrays(rows, names=["prefix", "n", "total"])

    counted = written(docs.select("doc_id", "text", "tag").mapInArrow(count, "prefix long, n long, total long"), "heavy")
    total = counted.agg(F.sum("total")).first()[0] or 0
    sums = counted.groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > max(HEAVY_ROWS, total // HEAVY_SHARE))
    return np.sort(np.array([r["prefix"] for r in sums.collect()], np.int64).view(np.uint64))


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def later_windows(prefix: np.ndarray, lost: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes of any prefixes: the bits of each one's windows that start later than their node's first, and the windows that do not."""
    suffix = np.repeat(np.arange(len(prefix)), count)
    which = np.arange(len(name)) - np.repeat(np.cumsum(count) - count, count)
    where = start[suffix] + which
    order = np.lexsort((where, doc[suffix], lost[suffix], name, prefix[suffix]))
    s, place = suffix[order], where[order]
    node = np.ones(len(s), bool)  # the first leaf of a node
    node[1:] = (prefix[s[1:]] != prefix[s[:-1]]) | (name[order[1:]] != name[order[:-1]])
    head = np.maximum.accumulate(np.where(node, np.arange(len(s)), 0))
    later = (place != place[head]) | (doc[s] != doc[s[head]]) | (lost[s] != lost[s[head]])
    bits = np.zeros(len(prefix), np.int64)
    np.bitwise_or.at(bits, s[later], np.int64(1) << which[order[later]])
    return bits, order[~later]


def _light_groups(docs: DataFrame, heavy: np.ndarray, window: int) -> DataFrame:
    """(doc_id, tag, start, bits): for each suffix the windows from ``start`` on that occur earlier, of prefixes not in ``heavy``."""
    wide = np.dtype((np.void, NAME_BYTES))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, text, prefix, start, count, name in _suffix_batches(batches, window):
            raw = np.ascontiguousarray(name.view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES])
            ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32) * NAME_BYTES
            names = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            light = pa.array(~_is_in(prefix, heavy))
            rows = pa.RecordBatch.from_arrays(
                [pa.array(prefix.view(np.int64)), ids.take(pa.array(text)), tags.take(pa.array(text)), pa.array(start.astype(np.int32)), names],
                names=["prefix", "doc_id", "tag", "start", "names"],
            )
            yield rows.filter(light)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(table: pa.Table) -> pa.RecordBatch:
            prefix = table.column("prefix").to_numpy()
            same = prefix[1:] == prefix[:-1]
            branching = np.zeros(len(prefix), bool)
            branching[1:] |= same
            branching[:-1] |= same
            table = table.filter(pa.array(branching)).combine_chunks()  # leaves end here
            prefix = prefix[branching]
            ids = table.column("doc_id").combine_chunks()
            lost = np.asarray(ids.is_null())
            doc, start = ids.fill_null(0).to_numpy(zero_copy_only=False), table.column("start").to_numpy()
            raw, ends = column_bytes(table.column("names"))
            count = np.diff(ends) // NAME_BYTES
            name = np.zeros((len(raw) // NAME_BYTES, 8), np.uint8)
            name[:, :NAME_BYTES] = raw.reshape(-1, NAME_BYTES)
            name = name.view(np.uint64).ravel()
            bits, _ = later_windows(prefix, lost, doc, start, count, name)
            some = bits != 0
            kept = table.select(["doc_id", "tag", "start"]).filter(pa.array(some)).combine_chunks()
            columns = [c.combine_chunks() for c in kept.columns]
            return pa.RecordBatch.from_arrays([*columns, pa.array(bits[some])], names=["doc_id", "tag", "start", "bits"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            prefix = table.column("prefix").to_numpy()
            cut = int(np.searchsorted(prefix, prefix[-1]))  # the last group may go on
            if cut:
                yield marked(table.slice(0, cut))
                rest = table.slice(cut)
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield marked(pa.Table.from_batches(held))

    dealt = docs.mapInArrow(suffixes, "prefix long, doc_id long, tag int, start int, names binary")
    dealt = dealt.repartition(partitions(docs.sparkSession), "prefix").sortWithinPartitions("prefix")
    return dealt.mapInArrow(subtrees, "doc_id long, tag int, start int, bits long")


def _heavy_groups(docs: DataFrame, heavy: np.ndarray, window: int) -> DataFrame:
    """The same for the prefixes in ``heavy``, prolonged to whole windows.

    A task marks what starts later among its own texts; only a node's first window in each
    of them goes on, to be compared with the node's first of all.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(ids: pa.Array, tags: pa.Array, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            text, prefix, start, count, name = (np.concatenate(x) for x in zip(*held))
            lost = np.asarray(ids.is_null())[text]
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False)[text]
            bits, first = later_windows(prefix, lost, doc, start, count, name)
            some = np.flatnonzero(bits)
            suffix = np.repeat(np.arange(len(text)), count)[first]
            where = start[suffix] + first - (np.cumsum(count) - count)[suffix]
            at = pa.array(text[np.concatenate((some, suffix))])
            none = np.zeros(len(some), np.int64)
            columns = [
                ids.take(at), tags.take(at), pa.array(np.concatenate((start[some], where)).astype(np.int32)), pa.array(np.concatenate((bits[some], np.zeros(len(first), np.int64)))),
                pa.array(np.concatenate((none, prefix[suffix].view(np.int64)))), pa.array(np.concatenate((none, name[first].view(np.int64)))),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "start", "bits", "prefix", "name"])

        for batch in batches:
            ids, tags = batch.column("doc_id"), batch.column("tag")
            held, size = [], 0
            for _, _, text, prefix, start, count, name in _suffix_batches(iter([batch]), window):
                mine = _is_in(prefix, heavy)
                held.append((text[mine], prefix[mine], start[mine], count[mine], name[np.repeat(mine, count)]))
                size += len(held[-1][-1])
                if size > 8 * CHUNK:
                    yield marked(ids, tags, held)
                    held, size = [], 0
            if size:
                yield marked(ids, tags, held)

    found = written(docs.mapInArrow(windows, "doc_id long, tag int, start int, bits long, prefix long, name long"), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "start").alias("place")
    rows = found.where("bits = 0").select("doc_id", "tag", "start", F.struct("prefix", "name").alias("node"), place)
    nodes = written(rows.groupBy("node").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1"), "nodes")
    joined = join_uneven(rows, nodes, "node", "n", rows.count())
    marks = joined.where(F.col("place") > F.col("first")).select("doc_id", "tag", "start", F.lit(1).cast("long").alias("bits"))
    return found.where("bits <> 0").select("doc_id", "tag", "start", "bits").unionByName(marks)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, tag, start, bits): bit i says that the window at word start + i of that document starts earlier elsewhere.

    Null texts have no words; documents with a null doc_id come after all others.
    """
    if not PREFIX <= window <= PREFIX + 62:
        raise ValueError(f"a window has {PREFIX} to {PREFIX + 62} words")
    tagged = _tagged(docs)
    heavy = heavy_prefixes(tagged, window)
    light = _light_groups(tagged, heavy, window)
    return light.unionByName(_heavy_groups(tagged, heavy, window)) if len(heavy) else light


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of ``docs``: the words that no later copy of a window covers.

    ``kept`` has them joined by one space.  Windows are judged on the input: of equal ones
    the earliest (smallest doc_id, then smallest start) stays.  A null or empty text has
    no words; fewer words than ``window`` stay as they are; texts of any length count
    whole.  Rows of one doc_id are one document to each other: windows at the same place
    do not repeat one another.  A null doc_id comes after all others.  Other columns
    are not read; an empty table gives an empty one.
    """
    tagged = _tagged(docs)
    marks = repeated_windows(docs, window).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "bits")).alias("marks"))
    marks = marks.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "marks")
    both = tagged.join(marks, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("tag").eqNullSafe(F.col("t")), "left").select("doc_id", "text", "marks")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.arange(63)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                buf, offsets = column_bytes(piece.column("text"))
                raw, marks = buf.tobytes(), piece.column("marks")
                total, removed, kept = [], [], []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    words = raw[a:b].split()  # at these six bytes exactly
                    total.append(len(words))
                    if marks[i].is_valid:
                        pairs = marks[i].values
                        start, bits = pairs.field("start").to_numpy(), pairs.field("bits").to_numpy()
                        suffix, which = np.nonzero(bits[:, None] >> step & 1)
                        change = np.zeros(len(words) + window + 1, np.int64)
                        np.add.at(change, start[suffix] + which, 1)
                        np.add.at(change, start[suffix] + which + window, -1)
                        stay = np.cumsum(change)[: len(words)] == 0
                        words = list(compress(words, stay.tolist()))
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=schema.names)

    return both.mapInArrow(remove, schema)


