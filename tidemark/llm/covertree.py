"""Embedding near-duplicates by dual traversal of cover trees.

Equal vectors are one vector with a number of copies.  Vectors are dealt to cells, those
nearest to one of a bounded number of pivots, and a large cell to parts of bounded size.
A vector visits another cell only if it lies within the threshold distance of the
half-space that is nearer to that cell's pivot than to its own: only then can it have
links there, so cells far apart exchange nothing.  Each part, and each batch of visitors,
gets a cover tree of its unit vectors: levels of centres with halving radii, every
vector at its nearest centre, each node with its true covering radius.  Two trees are
traversed together: children's centres are compared, and a pair of nodes whose centres
lie further apart than the threshold distance and both covering radii is pruned with
everything below.  Pairs of leaves are compared vector by vector, in double precision.
Links are counted where they are found; only a spanning forest of them leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_uneven, partitions, written
from .components import connected_components
from .vectors import is_finite_vector, matrix

BLOCK, BATCHES, _WIDE = 4096, 8, 1 << 17
MAX_PIVOTS = 1024
"""A bound on the cells, and so on the pivots that every task gets."""
_SLACK = 1e-4  # more than single precision loses; the final comparison is in double


def cover(x: np.ndarray, radius: float, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Centres (positions) over ``radius`` apart, and for every vector the centre that covers it."""
    least = np.float32(1 - radius * radius / 2)
    centres: list[int] = []
    owner = np.full(len(x), -1, np.int64)
    for lo in range(0, len(x), batch):
        rest = np.arange(lo, min(len(x), lo + batch))
        if centres:
            dots = x[rest] @ x[centres].T
            best = dots.argmax(axis=1)
            near = dots[np.arange(len(rest)), best] >= least
            owner[rest[near]] = np.array(centres)[best[near]]
            rest = rest[~near]
        dots = x[rest] @ x[rest].T
        free = np.ones(len(rest), bool)
        for i in range(len(rest)):
            if free[i]:
                centres.append(int(rest[i]))
                mine = free & (dots[i] >= least)
                mine[i] = True
                owner[rest[mine]] = rest[i]
                free &= ~mine
    return np.array(centres, np.int64), owner


class CoverTree:
    """Nodes as arrays: a node's children are numbered one after another, the root is 0.

    A node has a centre (a vector's position), its covering radius, and either children
    or, as a leaf, a range of ``members``.
    """

    def __init__(self, unit: np.ndarray, leaf: float):
        self.centre, self.radius = [0], []
        self.first, self.count, self.begin, self.end = [], [], [], []
        held, self.members, order = [(np.arange(len(unit)), 4.0)], [], 0
        while order < len(held):
            (members, level), centre = held[order], self.centre[order]
            radius = float(np.sqrt(max(0.0, 2 - 2 * float((unit[members] @ unit[centre]).min())))) if len(members) > 1 else 0.0
            self.radius.append(radius)
            self.first.append(len(held))
            self.begin.append(len(self.members))
            if radius > leaf:
                centres = np.zeros(0)
                while len(centres) < 2:
                    level /= 2
                    centres, owner = cover(unit[members], level)
                by_owner = np.argsort(owner, kind="stable")
                for g in np.split(by_owner, np.flatnonzero(np.diff(owner[by_owner])) + 1):
                    held.append((members[g], level))
                    self.centre.append(int(members[owner[g[0]]]))
            else:
                self.members += members.tolist()
            self.count.append(len(held) - self.first[-1])
            self.end.append(len(self.members))
            held[order] = None
            order += 1
        for name, kind in (("centre", np.int32), ("radius", np.float32), ("first", np.int32), ("count", np.int32), ("begin", np.int32), ("end", np.int32), ("members", np.int32)):
            setattr(self, name, np.array(getattr(self, name), kind))

    def below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children; a leaf stands for itself."""
        inner = self.count[nodes] > 0
        return np.where(inner, self.first[nodes], nodes), np.where(inner, self.count[nodes], 1)


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    """Rows over their norms, in single precision."""
    return (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)


def build_tree(raw: np.ndarray, threshold: float) -> CoverTree:
    """The cover tree of non-zero vectors; leaves cover at most half of the threshold distance."""
    return CoverTree(unit_vectors(raw), np.sqrt(2 - 2 * threshold) / 2)


def leaf_pairs(a: CoverTree, ca: np.ndarray, b: CoverTree, cb: np.ndarray, reach: float):
    """Pairs of leaves (arrays) that may hold vectors within ``reach``, by dual traversal level by level.

    ``ca`` and ``cb`` are the nodes' unit centres.  A tree with itself gives each pair once.
    """
    u = v = np.zeros(1, np.int64)
    bound = np.float32(reach + _SLACK)
    while len(u):
        leaf = (a.count[u] == 0) & (b.count[v] == 0)
        yield u[leaf], v[leaf]
        u, v = u[~leaf], v[~leaf]
        (fu, nu), (fv, nv) = a.below(u), b.below(v)
        size = nu.astype(np.int64) * nv
        found = []
        for k in np.flatnonzero(size > _WIDE):  # two wide nodes: their children's centres as a matrix product
            cv, rv = cb[fv[k] : fv[k] + nv[k]], b.radius[fv[k] : fv[k] + nv[k]]
            for lo in range(0, nu[k], 512):
                hi = min(lo + 512, nu[k])
                dots, far = ca[fu[k] + lo : fu[k] + hi] @ cv.T, bound + a.radius[fu[k] + lo : fu[k] + hi]
                # First by one bound a row, for the widest node opposite; what is left by both radii.
                i, j = np.divmod(np.flatnonzero(dots >= (1 - (far + rv.max()) ** 2 / 2)[:, None]), nv[k])
                near = dots[i, j] >= 1 - (far[i] + rv[j]) ** 2 / 2
                found.append((fu[k] + lo + i[near], fv[k] + j[near], np.full(int(near.sum()), k)))
        small = np.flatnonzero(size <= _WIDE)
        part = np.cumsum(size[small]) // _WIDE
        for group in np.split(small, np.flatnonzero(np.diff(part)) + 1) if len(small) else ():
            pair = np.repeat(group, size[group])
            within = np.arange(len(pair)) - np.repeat(np.cumsum(size[group]) - size[group], size[group])
            x, y = fu[pair] + within // nv[pair], fv[pair] + within % nv[pair]
            near = np.einsum("ij,ij->i", ca[x], cb[y]) >= 1 - (bound + a.radius[x] + b.radius[y]) ** 2 / 2
            found.append((x[near], y[near], pair[near]))
        if not found:
            return
        x, y, pair = (np.concatenate(z).astype(np.int64) for z in zip(*found))
        once = (u[pair] != v[pair]) | (x <= y) if a is b else slice(None)
        u, v = x[once], y[once]


def links_of_trees(a: tuple[np.ndarray, CoverTree, np.ndarray], b: tuple[np.ndarray, CoverTree, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked copies of each vector of ``a`` and ``b`` (the same object: within one block), and a forest of links.

    Both are (vectors, tree, copies of each vector).  The forest's positions in ``b`` come
    after those in ``a``, but for a block with itself.
    """
    (xa, ta, wa), (xb, tb, wb) = a, b
    same = ta is tb
    na, nb = np.linalg.norm(xa, axis=1), np.linalg.norm(xb, axis=1)
    count_a, count_b = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
    root = list(range(len(xa) + (0 if same else len(xb))))
    shift, forest = 0 if same else len(xa), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ua = unit_vectors(xa)[ta.centre]
    ub = ua if same else unit_vectors(xb)[tb.centre]
    pairs = ((u, v) for us, vs in leaf_pairs(ta, ua, tb, ub, float(np.sqrt(2 - 2 * threshold))) for u, v in zip(us.tolist(), vs.tolist()))
    for u, v in pairs:
        every_u, every_v = ta.members[ta.begin[u] : ta.end[u]], tb.members[tb.begin[v] : tb.end[v]]
        for lo in range(0, len(every_u), 1024):
            mu = every_u[lo : lo + 1024]
            for lo2 in range(0, len(every_v), 1024):
                mv = every_v[lo2 : lo2 + 1024]
                link = (xa[mu] @ xb[mv].T) / (na[mu][:, None] * nb[mv][None, :]) >= threshold
                if same and u == v:
                    link &= mu[:, None] != mv[None, :]
                if not link.any():
                    continue
                count_a[mu] += (link @ wb[mv].astype(np.float64)).astype(np.int64)
                if not (same and u == v):
                    (count_a if same else count_b)[mv] += (wa[mu].astype(np.float64) @ link).astype(np.int64)
                for i, j in _spanning(link):
                    p, q = find(int(mu[i])), find(int(mv[j]) + shift)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        forest.append((int(mu[i]), int(mv[j]) + shift))
    return count_a, count_b, np.array(forest, np.int64).reshape(-1, 2)


def _spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect what the matrix connects, found by breadth-first search."""
    out, rows, cols = [], link.any(axis=1), link.any(axis=0)
    while rows.any():
        frontier = [int(np.argmax(rows))]
        rows[frontier[0]] = False
        while frontier:
            nxt = []
            for i in frontier:
                for j in np.flatnonzero(link[i] & cols).tolist():
                    cols[j] = False
                    out.append((i, j))
                    more = np.flatnonzero(link[:, j] & rows)
                    rows[more] = False
                    out += [(int(r), j) for r in more]
                    nxt += more.tolist()
            frontier = nxt
    return out


class Part:
    """Vectors of one part of a cell, or of a batch of visitors, with their tree."""

    def __init__(self, batches: list[pa.RecordBatch], threshold: float):
        t = pa.Table.from_batches(batches)
        self.uid, copies = t.column("uid").to_numpy(), t.column("n").to_numpy()
        raw = matrix(t.column("v"), t.column("dim")[0].as_py(), np.float64)
        self.parts = raw, build_tree(raw, threshold), copies

    def links(self, other: Part, threshold: float) -> pa.RecordBatch:
        """(a, b, n): linked copies n of a vector a, or (n = 0) a link of the forest."""
        ca, cb, forest = links_of_trees(self.parts, other.parts, threshold)
        uid, links = (self.uid, ca) if other is self else (np.concatenate((self.uid, other.uid)), np.concatenate((ca, cb)))
        some, e = np.flatnonzero(links), uid[forest]
        cols = [np.concatenate((uid[some], e[:, 0])), np.concatenate((np.zeros(len(some), np.int64), e[:, 1])), np.concatenate((links[some], np.zeros(len(forest), np.int64)))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])


def _meet(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of a task's parts; rows come by (dim, cell, part, turn), a part's own vectors before its visitors.

    A part's links among its own vectors are found in its first turn only.
    """
    group, home, held, n_held, visiting = None, None, [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal home, held, n_held
        if held:
            found = Part(held, threshold)
            if not visiting:
                home = found
            if visiting or group[3] == 0:
                yield home.links(found, threshold)
        held, n_held = [], 0

    for batch in batches:
        keys = np.column_stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("dim", "cell", "part", "turn", "visitor")])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            if hi == lo:
                continue
            *now, is_visitor = keys[lo].tolist()
            if now != group or is_visitor != visiting:
                yield from flush()
                home = home if now == group else None
                group, visiting = now, is_visitor
            while lo < hi:
                step = min(hi - lo, BLOCK - n_held) if visiting else hi - lo
                held.append(batch.slice(lo, step))
                n_held, lo = n_held + step, lo + step
                if visiting and n_held == BLOCK:
                    yield from flush()
    yield from flush()


def _cells(distinct: DataFrame, n: int, threshold: float) -> DataFrame:
    """``distinct`` with its cell and the cells that each vector visits.

    Of two cells whose vectors may link either the vectors of one or those of the other
    travel, by turns, so that no cell is host to all.
    """
    spark, wanted = distinct.sparkSession, min(MAX_PIVOTS, -(-n // BLOCK))
    chosen = distinct.select("dim", "v").orderBy(F.xxhash64("v"), "v").limit(wanted).collect() if wanted > 1 else []
    pivots: dict[int, list] = {}
    for r in chosen:
        pivots.setdefault(r["dim"], []).append(r["v"])
    shared = spark.sparkContext.broadcast({d: unit_vectors(np.array(v, np.float64)) for d, v in pivots.items()})
    reach = float(np.sqrt(2 - 2 * threshold)) + _SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == d))
                p = shared.value.get(d)
                if p is None or len(p) < 2:
                    cell, visits = np.zeros(rows.num_rows, np.int32), np.zeros((rows.num_rows, 1), bool)
                else:
                    dots = unit_vectors(matrix(rows.column("v"), d, np.float64)) @ p.T
                    cell = dots.argmax(axis=1).astype(np.int32)
                    apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 1e-6))[cell]
                    visits = dots.max(axis=1, keepdims=True) - dots <= reach * apart + _SLACK
                    other = np.arange(len(p))
                    visits &= (other != cell[:, None]) & (((cell[:, None] + other) % 2 == 0) == (other < cell[:, None]))
                offsets = pa.array(np.concatenate(([0], np.cumsum(visits.sum(axis=1)))).astype(np.int32))
                visited = pa.ListArray.from_arrays(offsets, pa.array(np.nonzero(visits)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell), visited], names=[*rows.schema.names, "cell", "visits"])

    schema = T.StructType([*distinct.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("visits", T.ArrayType(T.IntegerType()))])
    return distinct.mapInArrow(run, schema)


def near_vectors(rows: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are cosines of ``threshold`` or more.

    n_links counts other rows linked directly (a repeated row is another row, and rows of
    equal vectors are linked); component_id is the smallest id reachable, the row's own
    included.  Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different length; a row without id links with
    nothing and has no component.  No other column of ``rows`` is read; an empty table
    gives an empty one.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold is a cosine over 0, at most 1")
    whole = F.coalesce(is_finite_vector(vector) & F.exists(F.col(vector), lambda x: x != 0), F.lit(False))
    vectors = written(rows.where(whole & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")), "vectors")
    distinct = vectors.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = written(distinct.withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "distinct")
    celled = written(_cells(distinct.select("uid", "n", "dim", "v"), distinct.count(), threshold), "cells")

    # One row a cell (at most MAX_PIVOTS a length of vectors): its parts, and the turns in which its visitors come.
    homes = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    guests = celled.select("dim", F.explode("visits").alias("cell")).groupBy("dim", "cell").agg(F.ceil(F.count("*") / (BATCHES * BLOCK)).alias("turns"))
    plan = written(homes.join(guests, ["dim", "cell"], "left").withColumn("turns", F.coalesce("turns", F.lit(1))), "plan")
    spread = lambda first, end: F.explode(F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>")))
    deal = lambda seed, n: F.pmod(F.xxhash64("uid", F.lit(seed)), n)
    zero, columns = F.lit(0).cast("long"), ["dim", "cell", "part", "turn", "visitor", "uid", "n", "v"]
    own = celled.join(F.broadcast(plan), ["dim", "cell"]).withColumn("own", deal(1, F.col("parts")))
    home = own.withColumn("part", F.col("own")).withColumn("turn", spread(zero, F.col("turns"))).withColumn("visitor", F.lit(0))
    later = own.withColumn("part", spread(zero, F.col("own"))).withColumn("turn", deal(2, F.col("turns"))).withColumn("visitor", F.lit(1))
    away = celled.drop("cell").withColumn("cell", F.explode("visits")).join(F.broadcast(plan), ["dim", "cell"])
    away = away.withColumn("part", spread(zero, F.col("parts"))).withColumn("turn", deal(2, F.col("turns"))).withColumn("visitor", F.lit(1))
    met = home.select(columns).unionByName(later.select(columns)).unionByName(away.select(columns))
    key = ["dim", "cell", "part", "turn"]
    groups = plan.agg(F.sum(F.col("parts") * F.col("turns"))).first()[0] or 1
    met = met.repartition(max(partitions(rows.sparkSession), min(groups, 20_000)), *key).sortWithinPartitions(*key, "visitor")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _meet(batches, threshold)

    met = written(met.mapInArrow(meet, "a long, b long, n long"), "met")
    counts = met.where("n > 0").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("links"))
    roots = connected_components(met.where("n = 0").select("a", "b")).select(F.col("node").alias("uid"), "root")
    known = distinct.select("uid", "v", "least", "n").join(counts, "uid", "left").join(roots, "uid", "left")
    known = written(known.withColumn("root", F.coalesce("root", "uid")), "known")
    components = written(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "components")
    named = join_uneven(known, components, "root", "size", distinct.count())
    named = written(named.select("v", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "named")
    linked = join_uneven(vectors, named, "v", "n", vectors.count()).select("vec_id", "n_links", "component_id")
    others = rows.where(~whole | F.col(vec_id).isNull()).select(F.col(vec_id).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).alias("component_id"))
    return linked.unionByName(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
