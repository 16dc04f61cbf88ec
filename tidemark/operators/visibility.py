"""Visibility graphs: natural and horizontal, with penetration limits, decay weights, state and value views.

j is visible from i if the slope to it exceeds all slopes (or all but ``penetrable``) to
the points between, or in the horizontal case if the points between all lie below both
ends.  A touching point blocks.  Rows are numbered and cut into blocks of bounded size.

* Within a block its points look at each other.  What a block shows to others is its
  *outline*: the upper hull of its points (horizontal: its highest value).
* Past a block's points come the outlines of all later blocks, in order.  A point can have an edge
  into a block only if the outline rises above the highest slope (value) that the point has met so
  far; else the whole block is ruled out for it.
* Only where it rises the point visits the block, with that bound, and looks at its rows.

So work goes with the edges and the outlines.  With ``penetrable`` above zero an outline
does not tell enough: then all later rows pass the blocks, as in the last step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ranges import numbered
from ..sources.tables import written

KINDS = ("nvg", "hvg")
BLOCK, CHUNK = 1024, 128
"""Points that look together, and rows that pass them at a time."""


class Watch:
    """Points and the ``penetrable`` + 1 highest slopes (or values) each has met so far."""

    def __init__(self, t: np.ndarray, x: np.ndarray, kind: str, limit: int | None, penetrable: int, top: np.ndarray | None = None):
        self.t, self.x, self.kind, self.limit = t, x, kind, limit
        self.top = np.full((penetrable + 1, len(t)), -np.inf) if top is None else top[None, :]

    def heights(self, t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gap in t, slope or value of each row as each point meets it, what it must exceed so far to be seen)."""
        gap = t[:, None] - self.t
        later = gap > 0
        if self.kind == "nvg":
            h = np.where(later, (y[:, None] - self.x) / np.where(later, gap, 1), -np.inf)
            return gap, h, h
        return gap, np.where(later, y[:, None], -np.inf), np.minimum(self.x, y[:, None])

    def pass_by(self, t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges (src, dst) to rows that come after all rows before."""
        gap, h, level = self.heights(t, y)
        if len(self.top) == 1:
            highest = np.maximum.accumulate(np.vstack((self.top, h)), axis=0)
            self.top, before = highest[-1:], highest[:-1]
        else:
            before = np.empty_like(h)
            for k in range(len(h)):
                before[k] = self.top[0]
                self.top[0] = np.maximum(self.top[0], h[k])  # the least of the highest goes if the new one is higher
                self.top.sort(axis=0)
        seen = (gap > 0) & (before < level)
        if self.limit is not None:
            seen &= gap <= self.limit
        j, i = np.nonzero(seen)
        return self.t[i], t[j]

    def pass_outline(self, t: np.ndarray, y: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """(points that the block behind this outline may hold an edge of, their bounds so far); the block begins at ``start``."""
        _, h, _ = self.heights(t, y)
        before, highest = self.top[0], h.max(axis=0)
        visit = highest > before
        if self.kind == "hvg":
            visit &= before < self.x
        if self.limit is not None:
            visit &= start - self.t <= self.limit
        self.top = np.maximum(before, highest)[None, :]
        at = np.flatnonzero(visit)
        return at, before[at]


def outline(t: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    """Positions of the points of the upper hull (horizontal: of the highest point)."""
    if kind == "hvg":
        return np.array([int(x.argmax())])
    left = np.arange(len(t))
    while len(left) > 2:  # points clearly below the line of their neighbours (or level with both) go, every other one at a time
        a, b, c = left[:-2], left[1:-1], left[2:]
        up, down = (x[b] - x[a]) * (t[c] - t[b]), (x[c] - x[b]) * (t[b] - t[a])
        low = (down - up > 1e-9 * (np.abs(up) + np.abs(down))) | (x[a] == x[b]) & (x[b] == x[c])
        if not low.any():
            break
        runs = np.flatnonzero(low)
        first = np.cumsum(np.append(True, np.diff(runs) > 1))
        odd = (runs - runs[np.searchsorted(first, first)]) % 2 == 0
        left = np.delete(left, runs[odd] + 1)
    return left


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[np.ndarray]]]:
    """(series_id, block, part, [columns]) of runs of rows, where a run may come in several pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("series_id").dictionary_encode()
        code = np.asarray(names.indices)
        block, part, *rest = (np.asarray(batch.column(c)) for c in batch.schema.names[1:])
        new = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            yield names.dictionary[int(code[lo])].as_py(), int(block[lo]), int(part[lo]), [c[lo:hi] for c in rest]


def _joined(groups: Iterator[tuple[str, int, int, list[np.ndarray]]]) -> Iterator[tuple[str, int, int, list[np.ndarray]]]:
    """The same with every run in one piece."""
    now, held = None, []
    for name, block, part, columns in groups:
        if (name, block, part) != now:
            if held:
                yield *now, [np.concatenate(c) for c in zip(*held)]
            now, held = (name, block, part), []
        held.append(columns)
    if held:
        yield *now, [np.concatenate(c) for c in zip(*held)]


def _rows(name: str, schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([name]).take(pa.array(np.zeros(len(columns[0]), np.int64))), *map(pa.array, columns)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])


EDGE = "series_id string, src long, dst long"
SHOWN = "series_id string, part int, block long, t long, other long, x double, top double"
"""part 0: an edge from t to other; 1: a point and the bound it has met; 2: a point of the outline (other: where its block begins); 3: a visitor of the block."""


def _shown(part: int, name: str, block: int, t: np.ndarray, other: np.ndarray | None, x: np.ndarray | None, top: np.ndarray | None) -> pa.RecordBatch:
    n = len(t)
    whole, real = np.zeros(n, np.int64), np.zeros(n)
    return _rows(name, SHOWN, np.full(n, part, np.int32), whole + block, t, whole if other is None else other, real if x is None else x, real if top is None else top)


def _within_blocks(dealt: DataFrame, kind: str, limit: int | None) -> DataFrame:
    """What every block of (series_id, block, part, t, value) finds in itself and shows to others."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, _, (t, x) in _joined(_groups(batches)):
            watch = Watch(t, x, kind, limit, 0)
            for at in range(0, len(t), CHUNK):
                src, dst = watch.pass_by(t[at : at + CHUNK], x[at : at + CHUNK])
                yield _shown(0, name, block, src, dst, None, None)
            top = watch.top[0]
            still = np.flatnonzero(top < x) if kind == "hvg" else np.arange(len(t))
            yield _shown(1, name, block, t[still], None, x[still], top[still])
            hull = outline(t, x, kind)
            yield _shown(2, name, block, t[hull], np.full(len(hull), t[0]), x[hull], None)

    return dealt.mapInArrow(look, SHOWN)


def _visitors(shown: DataFrame, kind: str, limit: int | None) -> DataFrame:
    """Points that may have edges into later blocks, as rows of those blocks."""
    points = shown.where("part = 1").select("series_id", "block", F.lit(-1).cast("long").alias("part"), "t", "other", "x", "top")
    hulls = shown.where("part = 2").withColumn("part", F.col("block")).where("block > 0")
    reach = F.sequence(F.lit(0).cast("long"), F.col("block") - 1)
    passing = hulls.select("series_id", F.explode(reach).alias("block"), F.col("part").cast("long"), "t", "other", "x", "top")
    dealt = points.unionByName(passing).repartition("series_id", "block").sortWithinPartitions("series_id", "block", "part", "t")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, watch = None, None
        for name, block, part, (t, start, x, top) in _joined(_groups(batches)):
            if (name, block) != group:
                group, watch = (name, block), None
            if part < 0:
                watch = Watch(t, x, kind, limit, 0, top)
            elif watch is not None:  # of a horizontal graph's block no point may be left
                at, bound = watch.pass_outline(t, x, int(start[0]))
                if len(at):
                    yield _shown(3, name, part, watch.t[at], None, watch.x[at], bound)

    return dealt.mapInArrow(look, SHOWN)


def _passing_rows(dealt: DataFrame, kind: str, limit: int | None, penetrable: int) -> DataFrame:
    """Edges of rows (series_id, block, part, t, value, top) with part 0 for points and 1 for the rows that pass them."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, watch, points = None, None, []
        for name, block, part, columns in _groups(batches):
            if (name, block) != group:
                group, watch, points = (name, block), None, []
            if part == 0:
                points.append(columns)
                continue
            if watch is None and points:
                t, x, top = (np.concatenate(c) for c in zip(*points))
                watch = Watch(t, x, kind, limit, penetrable, top if penetrable == 0 else None)
            if watch is None:  # nobody visits
                continue
            t, x, _ = columns
            for at in range(0, len(t), CHUNK):
                src, dst = watch.pass_by(t[at : at + CHUNK], x[at : at + CHUNK])
                if len(src):
                    yield _rows(name, EDGE, src, dst)

    dealt = dealt.repartition("series_id", "block").sortWithinPartitions("series_id", "block", "part", "t")
    return dealt.mapInArrow(look, EDGE)


def visibility_edges(series: DataFrame, kind: str = "nvg", limit: int | None = None, penetrable: int = 0, decay: float = 0.0, long: bool = False) -> DataFrame:
    """(series_id, src, dst, weight) with src < dst; weight is exp(-decay (dst - src)).

    Nulls are no nodes and block nothing; neighbours in t always see each other.  ``t`` is
    any whole number: blocks are cut by row numbers, which range partitions count
    where series are ``long``.  With a limit edges are at most so long in t.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    if penetrable < 0:
        raise ValueError("penetrable is 0 or more")
    known = series.where("value IS NOT NULL").select(F.col("series_id").cast("string").alias("series_id"), F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value"))
    placed = numbered(known, ["series_id"], ["t"], "_i") if long else known.withColumn("_i", F.row_number().over(Window.partitionBy("series_id").orderBy("t")))
    own = placed.select("series_id", F.floor((F.col("_i") - 1) / BLOCK).alias("block"), "t", "value")
    row = lambda df, part: df.select("series_id", "block", F.lit(part).alias("part"), "t", "value")
    if penetrable:
        later = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))))
        edges = _passing_rows(row(own, 0).unionByName(row(later, 1)).withColumn("top", F.lit(0.0)), kind, limit, penetrable)
    else:
        dealt = row(own, 0).repartition("series_id", "block").sortWithinPartitions("series_id", "block", "t")
        shown = written(_within_blocks(dealt, kind, limit), "shown")
        edges = shown.where("part = 0").select("series_id", F.col("t").alias("src"), F.col("other").alias("dst"))
        if not shown.where("part = 2 AND block > 0").isEmpty():
            guests = _visitors(shown, kind, limit).select("series_id", "block", F.lit(0).alias("part"), "t", F.col("x").alias("value"), "top")
            edges = edges.unionByName(_passing_rows(guests.unionByName(row(own.where("block > 0"), 1).withColumn("top", F.lit(0.0))), kind, limit, 0))
    gap = (F.col("dst") - F.col("src")).cast("double")
    weight = F.lit(1.0) if decay == 0 else F.exp(-F.lit(float(decay)) * gap)
    return edges.select("series_id", "src", "dst", weight.alias("weight"))


def by_state(edges: DataFrame, states: DataFrame, how: str = "sum", directed: bool = True) -> DataFrame:
    """(series_id, from_state, to_state, weight): edges aggregated by the states of their ends (series_id, t, state).

    Undirected, every edge counts from both ends and every count is mirrored: twice for
    two states, four times within one.  Null states are left out.
    """
    if how not in ("sum", "mean", "max", "count"):
        raise ValueError(f"unknown aggregation {how}")
    known = states.where("state IS NOT NULL")
    a = known.select("series_id", F.col("t").alias("src"), F.col("state").alias("from_state"))
    b = known.select("series_id", F.col("t").alias("dst"), F.col("state").alias("to_state"))
    joined = edges.join(a, ["series_id", "src"]).join(b, ["series_id", "dst"])
    if not directed:
        turned = joined.withColumns({"from_state": F.col("to_state"), "to_state": F.col("from_state")})
        joined = joined.unionByName(turned)
    # From both ends an edge within one state is already counted twice.
    times = 2 if not directed and how in ("sum", "count") else 1
    agg = {"sum": F.sum("weight"), "mean": F.avg("weight"), "max": F.max("weight"), "count": F.count("*").cast("double")}[how]
    out = joined.groupBy("series_id", "from_state", "to_state").agg(agg.alias("w"))
    return out.select("series_id", "from_state", "to_state", (F.col("w") * times).alias("weight"))


def by_value(edges: DataFrame, series: DataFrame, how: str = "sum", directed: bool = True) -> DataFrame:
    """The state view keyed by the printed value."""
    return by_state(edges, series.where("value IS NOT NULL").withColumn("state", F.col("value").cast("string")), how, directed)


def degrees(edges: DataFrame) -> DataFrame:
    """(series_id, t, degree, strength) of every linked point."""
    both = edges.select("series_id", F.col("src").alias("t"), "weight").unionByName(edges.select("series_id", F.col("dst").alias("t"), "weight"))
    return both.groupBy("series_id", "t").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def visibility_graph(series: DataFrame, kind: str = "nvg", states: DataFrame | None = None, how: str = "sum", directed: bool = False, **options) -> dict[str, DataFrame]:
    """Edges by time, by state (if states are given) and by value."""
    edges = visibility_edges(series, kind, **options)
    out = {"time": edges, "value": by_value(edges, series, how, directed)}
    return out if states is None else out | {"state": by_state(edges, states, how, directed)}

