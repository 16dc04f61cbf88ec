"""Product codes of vectors by Lloyd's algorithm with filtering on kd-trees.

Vectors become integers, are cut into equal parts, and each part position has its own
codebook.  Every partition builds kd-trees over its parts once, block by block: a node
knows its bounding box, the sum and the number of its points.  A round walks all trees of
a block level by level.  At a node the entry nearest to the box's middle is its favourite;
an entry that the favourite beats on the whole box (it does so at the box's corner that
leans most towards that entry) is struck out for the subtree.  A node with one entry left
goes to it whole, by its cached sum and count; points are looked at only in leaves where
several entries are left.  All distances are exact integers, ties go to the lower index.

A round is one Spark aggregation of at most parts x entries sums; the trees are a written
table, so lost executors read them again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_uneven, written
from .vectors import is_finite_vector, matrix

BLOCK, LEAF = 16_384, 16
LARGEST = 1 << 26
"""Integer components lie below this in size, so that squared distances fit 64 bits."""


def _bounds(n: int) -> list[np.ndarray]:
    """Start offsets (with the end) of the nodes of each level of a balanced tree over n points."""
    levels = [np.array([0, n])]
    while n >> len(levels) - 1 > LEAF:
        at = levels[-1]
        both = np.empty(2 * len(at) - 1, at.dtype)
        both[::2], both[1::2] = at, (at[:-1] + at[1:]) // 2
        levels.append(both)
    return levels


def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the points, lower corners, upper corners, sums) of a kd-tree; nodes level by level from the root."""
    levels = _bounds(len(points))
    order = np.arange(len(points))
    lo, hi, sums = [], [], []
    for k, at in enumerate(levels):
        x = points[order]
        lo.append(np.minimum.reduceat(x, at[:-1]))
        hi.append(np.maximum.reduceat(x, at[:-1]))
        sums.append(np.add.reduceat(x, at[:-1]))
        if k + 1 < len(levels):  # halve every node along its widest side
            node = np.repeat(np.arange(len(at) - 1), np.diff(at))
            side = (hi[-1] - lo[-1]).argmax(axis=1)
            order = order[np.lexsort((x[np.arange(len(x)), side[node]], node))]
    return order, np.concatenate(lo), np.concatenate(hi), np.concatenate(sums)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.square(a - b).sum(axis=-1)


def filter_tree(points: np.ndarray, tree: tuple[np.ndarray, ...], book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums by entry, counts by entry, entry of every point), each point at its nearest entry."""
    order, lo, hi, total = tree
    k, d = book.shape
    sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
    code = np.zeros(len(points), np.int64)
    levels = _bounds(len(points))
    open_nodes, left, base = np.zeros(1, np.int64), np.ones((1, k), bool), 0

    def settle(nodes: np.ndarray, at: np.ndarray, entry: np.ndarray) -> None:
        np.add.at(sums, entry, total[base + nodes])
        np.add.at(counts, entry, at[nodes + 1] - at[nodes])
        size = at[nodes + 1] - at[nodes]
        inside = np.repeat(at[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
        code[order[inside]] = np.repeat(entry, size)

    for level, at in enumerate(levels):
        low, high = lo[base + open_nodes], hi[base + open_nodes]
        far = np.iinfo(np.int64).max
        middle = np.where(left, _squares((low + high)[:, None, :], 2 * book), far).argmin(axis=1)
        best = book[middle][:, None, :]
        corner = np.where(book > best, high[:, None, :], low[:, None, :])
        behind = _squares(corner, book) - _squares(corner, best)
        beaten = (behind > 0) | (behind == 0) & (np.arange(k) > middle[:, None])
        left = left & ~beaten
        one = left.sum(axis=1) == 1
        settle(open_nodes[one], at, left[one].argmax(axis=1))
        open_nodes, left = open_nodes[~one], left[~one]
        if not len(open_nodes):
            break
        if level + 1 < len(levels):
            base += len(at) - 1
            open_nodes, left = np.repeat(2 * open_nodes, 2) + np.tile([0, 1], len(open_nodes)), np.repeat(left, 2, axis=0)
            continue
        size = at[open_nodes + 1] - at[open_nodes]
        rows = order[np.repeat(at[open_nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        x = points[rows]
        entry = np.where(np.repeat(left, size, axis=0), _squares(x[:, None, :], book), far).argmin(axis=1)
        np.add.at(sums, entry, x)
        np.add.at(counts, entry, 1)
        code[rows] = entry
    return sums, counts, code


def _raw(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values, np.int64).tobytes()], pa.binary())


def _unraw(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), np.int64)


def _blocks_with_trees(rows: DataFrame, parts: int, dim: int) -> DataFrame:
    """One row a block: its rows' numbers, the points and the trees of all parts."""
    width = dim // parts
    id_type, label_type = rows.schema["id"].dataType, rows.schema["label"].dataType
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type))]
        + [T.StructField(c, T.BinaryType()) for c in ("points", "order", "lo", "hi", "sums")]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            n = table.num_rows
            points = matrix(table.column("x"), dim, np.int64).reshape(n, parts, width).transpose(1, 0, 2)
            trees = [build_tree(p) for p in points]
            whole = [pa.LargeListArray.from_arrays(pa.array([0, n], pa.int64()), table.column(c).combine_chunks()) for c in ("id", "label")]
            whole = [w.cast(pa.list_(w.type.value_type)) for w in whole]
            packed = [_raw(points), *(_raw(np.concatenate([t[i] for t in trees])) for i in range(4))]
            return pa.RecordBatch.from_arrays([*whole, *packed], names=schema.names)

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                if size + piece.num_rows > BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held, size = [], 0
                held, size = [*held, piece], size + piece.num_rows
        if size:
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(build, schema)


def _opened(batch: pa.RecordBatch, i: int, parts: int, width: int) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    """(part, its points, its tree) of one block."""
    points = _unraw(batch, "points", i).reshape(parts, -1, width)
    order = _unraw(batch, "order", i).reshape(parts, -1)
    lo, hi, sums = (_unraw(batch, c, i).reshape(parts, -1, width) for c in ("lo", "hi", "sums"))
    for p in range(parts):
        yield p, points[p], (order[p], lo[p], hi[p], sums[p])


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
) -> tuple[np.ndarray, DataFrame]:
    """The codebooks (parts, entries, components) and a row a kept vector: id, code, error and label_error.

    Components are floor(scale * x).  Each codebook starts as that part of the vectors of
    the ``entries`` smallest ids (ties by components, null ids last; with fewer vectors the
    codebook is shorter).  ``code`` has two hex digits a part; ``error`` is the vector's
    squared distance to its entries, ``label_error`` its sum over equal labels, nulls
    together.  Left out are vectors that are null, empty, or hold a null or non-finite
    component, and those whose length differs from that of the smallest kept id.  Repeated
    rows count and come out each; other columns are not read; an empty table gives no
    codebooks and an empty table.  A length that ``parts`` does not divide, or a
    component of 2^26 and more after scaling, is an error.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col("v"), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(is_finite_vector("v") & (F.size("v") > 0))
    rows = rows.select("id", "label", whole.alias("x"))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType())])
    if not first:
        return np.zeros((parts, 0, 0), np.int64), spark.createDataFrame([], schema)
    dim = len(first[0]["x"])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    first = [r["x"] for r in first if len(r["x"]) == dim]
    if len(first) < entries:  # some lengths differ: look for more of the right one
        first = [r["x"] for r in rows.where(F.size("x") == dim).orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    width = dim // parts
    fits = F.forall("x", lambda x: (x > F.lit(-LARGEST)) & (x < F.lit(LARGEST)))
    checked = F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit("a component is too large to be scaled")))
    trees = written(_blocks_with_trees(rows.where(F.size("x") == dim).select("id", "label", checked.alias("x")), parts, dim), "trees")
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)

    for _ in range(rounds):

        def gather(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    for p, points, tree in _opened(batch, i, parts, width):
                        s, c, _ = filter_tree(points, tree, books[p])
                        sums[p] += s
                        counts[p] += c
            out = np.concatenate((sums, counts[:, :, None]), axis=2).reshape(-1)
            some = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["at", "x"])

        got = np.zeros(parts * len(first) * (width + 1), np.int64)
        for r in trees.mapInArrow(gather, "at long, x long").groupBy("at").agg(F.sum("x").alias("x")).collect():
            got[r["at"]] = r["x"]
        got = got.reshape(parts, len(first), width + 1)
        sums, counts = got[:, :, :-1], got[:, :, -1:]
        books = np.where(counts > 0, sums // np.maximum(counts, 1), books)

    out_schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("label", rows.schema["label"].dataType), *schema.fields[1:3]])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, points, tree in _opened(batch, i, parts, width):
                    code = filter_tree(points, tree, books[p])[2]
                    codes[:, p] = code
                    error += _squares(points, books[p][code])
                text = codes.tobytes().hex()
                names = [text[j : j + 2 * parts] for j in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(names, pa.string()), pa.array(error)], names=out_schema.names)

    coded = written(trees.mapInArrow(assign, out_schema), "codes")
    keyed = coded.withColumn("k", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-")))
    by_label = written(keyed.groupBy("k").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    out = join_uneven(keyed, by_label, "k", "n", coded.count())
    return books, out.select(F.col("id").alias(id_col), "code", "error", "label_error")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
