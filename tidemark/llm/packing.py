"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document's ids are cut into whole sequences and a remainder.  Remainder lengths are
counted in units of ``UNIT`` ids; only that histogram reaches the driver, where it is
cut into at most ``CLASSES`` length classes (a member counts as its class's longest,
so classes are narrower where documents are many).  A linear program over patterns
(how many remainders of each class share a sequence) is solved by column generation:
the simplex method's duals price classes, a knapsack dynamic program finds the best
new pattern, until none can gain ``TOLERANCE``.  Patterns are used a whole number of
times (rounded down), the few documents left over are placed first-fit decreasing, and
documents, ranked within their class by Spark, take the slots of the patterns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written
from .tokens import encoder, whole_rows

SEQUENCE, UNIT, CLASSES, TOLERANCE = 4096, 8, 160, 0.001
GROUPS_A_PARTITION = 4
"""Groups of documents to be ranked, of one class each, for every shuffle partition."""

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable whole-number pattern that fits ``capacity``, by dynamic programming."""
    best, used = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for c in range(int(sizes[0]), capacity + 1):
        fits = int(np.searchsorted(sizes, c, side="right"))
        gain = best[c - sizes[:fits]] + values[:fits]
        i = int(np.argmax(gain))
        if gain[i] > best[c - 1] + 1e-12:
            best[c], used[c] = gain[i], i
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if used[c] < 0:
            c -= 1
        else:
            pattern[used[c]] += 1
            c -= int(sizes[used[c]])
    return float(best[capacity]), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = TOLERANCE) -> list[tuple[np.ndarray, float]]:
    """Patterns and (fractional) uses that cover ``demand`` with nearly the fewest sequences.

    Revised simplex on min sum(x), patterns x >= demand; ``sizes`` ascend.
    """
    m = len(sizes)
    columns = [np.eye(m, dtype=np.int64)[i] * max(1, capacity // int(s)) for i, s in enumerate(sizes)]
    costs = [1.0] * m
    inverse = np.diag([1.0 / columns[i][i] for i in range(m)])
    x = inverse @ demand
    for turn in range(60 * m):
        dual = np.asarray(costs) @ inverse
        worst = int(np.argmin(dual))
        if dual[worst] < -1e-9:  # over-covering this class pays: a surplus column enters
            entering, cost = -np.eye(m, dtype=np.int64)[worst], 0.0
        else:
            value, entering = best_pattern(np.maximum(dual, 0), sizes, capacity)
            cost = 1.0
            if value <= 1 + tolerance:  # the optimum is at least the present sum / value
                break
        u = inverse @ entering
        able = np.flatnonzero(u > 1e-9)
        ratio = x[able] / u[able]
        out = able[int(np.argmin(ratio))]
        step = max(0.0, float(ratio.min()))
        x = x - step * u
        x[out] = step
        row = inverse[out] / u[out]
        inverse = inverse - np.outer(u, row)
        inverse[out] = row
        columns[out], costs[out] = entering, cost
        if turn % 100 == 99:
            inverse = np.linalg.inv(np.array(columns, float).T)
            x = np.maximum(inverse @ demand, 0)
    return [(p, float(n)) for p, n, c in zip(columns, x, costs) if c and n > 1e-9]


def length_classes(histogram: dict[int, int], most: int = CLASSES) -> dict[int, int]:
    """The class (its largest size) of every size, at most ``most`` classes.

    Rounding up costs a class's count times its width: least in all if widths go with
    one over the square root of the counts.
    """
    sizes = sorted(s for s, n in histogram.items() if n)
    counts = np.sqrt([histogram[s] for s in sizes])
    if not sizes:
        return {}
    group = np.minimum((np.cumsum(counts) - counts / 2) / counts.sum() * most, most - 1).astype(int)
    largest = {int(g): s for g, s in zip(group, sizes)}
    return {s: largest[int(g)] for g, s in zip(group, sizes)}


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(class -> documents in a sequence, number of such sequences), covering the whole histogram."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n), np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    left, plan = demand.copy(), []
    for pattern, uses in solve_patterns(sizes, demand, capacity):
        n = int(uses + 1e-6)
        if n:
            plan.append(({int(s): int(k) for s, k in zip(sizes, pattern) if k}, n))
            left -= n * pattern
    bins: list[tuple[int, dict[int, int]]] = []
    for s, n in sorted(zip(sizes.tolist(), left.tolist()), reverse=True):
        for _ in range(max(0, n)):
            at = next((i for i, (room, _) in enumerate(bins) if room >= s), None)
            if at is None:
                bins.append((capacity, {}))
                at = len(bins) - 1
            room, content = bins[at]
            content[s] = content.get(s, 0) + 1
            bins[at] = (room - s, content)
    same: dict[tuple, int] = {}
    for _, content in bins:
        key = tuple(sorted(content.items()))
        same[key] = same.get(key, 0) + 1
    return plan + [(dict(k), n) for k, n in same.items()]


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents: whole sequences, then a remainder; ``end_id`` closes each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids_of = np.asarray(batch.column("doc_id").fill_null(0))
            null = np.asarray(batch.column("doc_id").is_null())
            for row, ids, lengths in whole_rows(enc.encode(batch.column("text"))):
                n = lengths + 1
                raw = np.insert(ids, np.cumsum(lengths), end_id).astype("<u4")
                pieces = -(-n // sequence)
                doc = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * sequence
                length = np.minimum(sequence, n[doc] - start)
                at = (np.cumsum(n) - n)[doc] + start
                crc = [zlib.crc32(raw[a : a + k]) for a, k in zip(at.tolist(), length.tolist())]
                cols = [pa.array(ids_of[row + doc], pa.int64(), mask=null[row + doc])]
                cols += [pa.array(c, pa.int64()) for c in (start, length, crc, n[doc])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECE)


def pack(docs: DataFrame, vocabulary: str, end_id: int, sequence: int = SEQUENCE, unit: int = UNIT) -> DataFrame:
    """One row per piece of a document with its place in a sequence of at most ``sequence`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A null
    text is empty (one piece, the end id alone); texts of any length are encoded whole;
    repeated rows are packed each; a null doc_id stays null; other columns of ``docs``
    are not read; no rows give no rows.
    """
    spark, capacity = docs.sparkSession, sequence // unit
    pieces = cut_documents(docs, vocabulary, end_id, sequence).withColumn("uid", F.monotonically_increasing_id())
    pieces = written(pieces.withColumn("size", F.ceil(F.col("length") / unit).cast("int")), "pieces")
    sizes = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}
    class_of, histogram = length_classes(sizes), {}
    for s, n in sizes.items():
        histogram[class_of[s]] = histogram.get(class_of[s], 0) + n
    plan = plan_sequences(histogram, capacity)

    # Slots of a class, in the order of the plan: a range of ranks for each pattern that uses it.
    # A class's ranges fill it from rank 0 on, so the range of a rank is the last that starts at or before it.
    ranges: dict[int, list[tuple[int, int, int]]] = {size: [] for size in histogram}
    base, taken = 0, dict.fromkeys(histogram, 0)
    for content, uses in plan:
        for size, each in content.items():
            ranges[size].append((taken[size], each, base))
            taken[size] += each * uses
        base += uses
    slots = spark.createDataFrame([*ranges.items()], "class int, ranges array<struct<lo: long, each: int, base: long>>")
    # Rank within a class: its groups, as many as go with its share of all documents, are counted,
    # then ranked each by itself.  Classes, ranges and groups' counts are small tables, whatever
    # the number of documents.
    share = GROUPS_A_PARTITION * partitions(spark) / max(sum(histogram.values()), 1)
    classes = spark.createDataFrame([(s, c, 1 + int(histogram[c] * share)) for s, c in class_of.items()], "size int, class int, groups int")
    keyed = pieces.join(F.broadcast(classes), "size").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("groups"))).drop("groups")
    counts = keyed.groupBy("class", "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("class").orderBy("part")
    before = counts.select("class", "part", (F.sum("n").over(order) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("class", "part").orderBy("uid")) - 1
    ranked = keyed.withColumn("within", within).join(before, ["class", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within"))
    # One row a class, at most CLASSES with as many ranges as there are patterns.
    found = F.element_at(F.filter("ranges", lambda r: r["lo"] <= F.col("rank")), -1)
    placed = ranked.join(F.broadcast(slots), "class").withColumn("slot", found).drop("ranges")
    placed = placed.withColumn("sequence_id", F.col("slot.base") + F.floor((F.col("rank") - F.col("slot.lo")) / F.col("slot.each")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "uid")
    offset = F.sum("length").over(inside) - F.col("length")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
