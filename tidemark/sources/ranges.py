"""Long series over many tasks.

Operators state what they need of a series through a *scope*.  In ``Whole`` a series is one
window partition: one sort serves all frames, which suits many series of moderate length.
In ``Ranges`` a series is cut into blocks of ``rows`` rows, and no task holds more of it:

* rows are numbered by range partitions in order of (series_id, t), each of which counts its own;
* frames see their block and a halo of rows before and after it;
* what runs over all rows so far is carried from block to block as one value a block;
* totals are aggregates with partial sums, brought back by one row a block;
* quantiles are the rows at the wanted places of range partitions in order of value.

Both give the same results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .tables import written

SERIES = ["series_id"]


class Placed:
    """Rows written in order of ``keys`` and ``order``, and where each series begins in each range partition."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str | Column]):
        spark = df.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
        self.keys = keys
        self.rows = written(dealt.withColumn("_p", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_p", 33)), "placed")
        found = self.rows.groupBy(*keys, "_part").agg(F.min("_p").alias("_first"), F.count("*").alias("_size"))
        ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        self.starts = written(found.withColumn("_ahead", F.coalesce(F.sum("_size").over(ahead), F.lit(0))), "starts")

    def numbered(self, name: str) -> DataFrame:
        """The rows with their number, from 1, within the keys."""
        starts = self.starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.col("_part").alias("_s"), "_first", "_ahead")
        same = F.col("_part") == F.col("_s")
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        number = (F.col("_ahead") + F.col("_p") - F.col("_first") + 1).cast("long")
        out = self.rows.join(starts, same).withColumn(name, number)
        return out.drop("_p", "_part", "_s", "_first", "_ahead", *[f"_k{i}" for i in range(len(self.keys))])

    def at(self, wanted: DataFrame, place: str) -> DataFrame:
        """``wanted`` (keys and a place, from 0) with the columns of the row that stands there."""
        found = wanted.join(self.starts, self.keys).where((F.col(place) >= F.col("_ahead")) & (F.col(place) < F.col("_ahead") + F.col("_size")))
        found = found.withColumn("_p", F.col("_first") + F.col(place) - F.col("_ahead")).drop("_part", "_first", "_size", "_ahead")
        return found.join(self.rows.drop("_part", *self.keys), "_p").drop("_p")


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``df`` with row numbers in ``order`` within ``keys``, without a task that sees all rows of one key."""
    return Placed(df, keys, order).numbered(name)


def group_quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str] = SERIES) -> DataFrame:
    """(keys, q): the same quantiles as ``percentile`` gives, an array in the order of ``probs``; groups of any size.

    Nulls take no part; a group without values has no row.
    """
    placed = Placed(df.select(*keys, value).where(F.col(value).isNotNull()), keys, [value])
    sizes = placed.starts.groupBy(*keys).agg(F.sum("_size").alias("_n"))
    spot = F.col("_prob") * (F.col("_n") - 1)
    each = sizes.select(*keys, "_n", F.posexplode(F.array(*map(F.lit, probs))).alias("_which", "_prob")).withColumn("_spot", spot)
    ends = each.select("*", F.explode(F.array(F.floor("_spot"), F.ceil("_spot"))).alias("_place")).distinct()
    met = placed.at(ends, "_place")
    v = F.col(value).cast("double")
    low, high = F.max(F.when(F.col("_place") == F.floor("_spot"), v)), F.max(F.when(F.col("_place") == F.ceil("_spot"), v))
    share = F.max(F.col("_spot") - F.floor("_spot"))
    one = met.groupBy(*keys, "_which").agg(low.alias("_l"), high.alias("_h"), share.alias("_s"))
    q = F.when(F.col("_l") == F.col("_h"), F.col("_l")).otherwise((1 - F.col("_s")) * F.col("_l") + F.col("_s") * F.col("_h"))
    return one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_which", q.alias("q"))))["q"].alias("q"))


def quantile_rows(df: DataFrame, value: str, probs: list[float], long: bool = False, keys: list[str] = SERIES) -> DataFrame:
    """(keys, q) as ``group_quantiles`` gives; unless ``long``, a group's distinct values meet in one task."""
    if long:
        return group_quantiles(df, value, probs, keys)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias("q"))


class Whole:
    """A series is one window partition."""

    part = SERIES

    def rows(self, series: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
        """``series`` with its row number ``_i``, and all that frames of so many rows need."""
        return series.withColumn("_i", F.row_number().over(self.by()))

    def framed(self, rows: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
        """Numbered rows with all that frames of so many rows need."""
        return rows

    def by(self, *extra: str) -> WindowSpec:
        """What frames are made of."""
        return Window.partitionBy(*self.part, *extra).orderBy("t")

    def own(self, df: DataFrame, keep: bool = True) -> DataFrame:
        """The rows without those that only frames needed; to ``keep`` them is for what is read more than once."""
        return df

    def among(self, df: DataFrame, aggs: dict[str, Column], keys: list[str] = SERIES) -> DataFrame:
        """``totals`` of a table that has no blocks, as one of regimes."""
        return Whole.totals(self, df, aggs, keys)

    def totals(self, df: DataFrame, aggs: dict[str, Column], keys: list[str] = SERIES) -> DataFrame:
        """``df`` with aggregates over all rows of equal keys."""
        return df.withColumns({k: a.over(Window.partitionBy(*keys)) for k, a in aggs.items()})

    def brought(self, df: DataFrame, sums: DataFrame, keys: list[str] = SERIES) -> DataFrame:
        """``df`` with the columns of ``sums``, which has at most one row for the keys."""
        return df.join(sums, keys, "left")

    def quantiles(self, df: DataFrame, name: str, value: str, probs: list[float]) -> DataFrame:
        """``df`` with an array of the series' quantiles."""
        return self.totals(df, {name: F.percentile(value, F.array(*map(F.lit, probs)))})

    def before(self, df: DataFrame, values: dict[str, Column], how: str = "max", backwards: bool = False) -> DataFrame:
        """``df`` with the max, sum or last known of values over all rows before its own (behind it, if backwards)."""
        order = Window.partitionBy(*SERIES).orderBy(F.desc("t") if backwards else "t").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({k: _AGGREGATES[how](v).over(order) for k, v in values.items()})


class Ranges(Whole):
    """A series is cut into blocks of ``size`` rows."""

    part = ["series_id", "_block"]

    def __init__(self, size: int):
        if size < 1:
            raise ValueError("a block has one row or more")
        self.size = size

    def rows(self, series: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
        return self.framed(numbered(series, SERIES, ["t"], "_i"), before, after)

    def framed(self, rows: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
        at = F.col("_i") - 1
        own = F.floor(at / self.size)
        if not before and not after:
            return rows.withColumn("_block", own)
        first, last = F.greatest(F.lit(0), F.floor((at - after) / self.size)), F.floor((at + before) / self.size)
        return rows.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(first, last)))

    def own(self, df: DataFrame, keep: bool = True) -> DataFrame:
        out = df.where("_block = _own").drop("_own") if "_own" in df.columns else df
        return written(out, "blocks") if keep else out

    def among(self, df: DataFrame, aggs: dict[str, Column], keys: list[str] = SERIES) -> DataFrame:
        df = written(df, "table")
        return df.join(df.groupBy(*keys).agg(*[a.alias(k) for k, a in aggs.items()]), keys)

    def totals(self, df: DataFrame, aggs: dict[str, Column], keys: list[str] = SERIES) -> DataFrame:
        sums = df.groupBy(*keys).agg(*[a.alias(k) for k, a in aggs.items()])
        return self.brought(df, sums, keys)

    def brought(self, df: DataFrame, sums: DataFrame, keys: list[str] = SERIES) -> DataFrame:
        # First to each block that has such rows, then within it: no task meets all rows of a key.
        # Written, so that its size is known and a small one is sent to the rows, not the rows to it.
        every = list(dict.fromkeys([*self.part, *keys]))
        blocks = written(df.select(*every).distinct().join(sums, keys, "left"), "brought")
        return df.join(blocks, every)

    def quantiles(self, df: DataFrame, name: str, value: str, probs: list[float]) -> DataFrame:
        return self.brought(df, group_quantiles(df, value, probs).withColumnRenamed("q", name))

    def before(self, df: DataFrame, values: dict[str, Column], how: str = "max", backwards: bool = False) -> DataFrame:
        turn = F.desc if backwards else F.asc
        inside = Window.partitionBy(*self.part).orderBy(turn("t")).rowsBetween(Window.unboundedPreceding, -1)
        earlier = Window.partitionBy(*SERIES).orderBy(turn("_block")).rowsBetween(Window.unboundedPreceding, -1)
        # Rows are written with what is known inside their block; all that follows is a scan and one small table.
        made = written(df.withColumns({f"_n_{k}": _AGGREGATES[how](v).over(inside) for k, v in values.items()}), "inside")
        if how == "last":  # of a block: the known value of the last row
            known = {k: F.max(F.when(v.isNotNull(), F.struct((-F.col("_i") if backwards else F.col("_i")).alias("i"), v.alias("v"))))["v"] for k, v in values.items()}
        else:
            known = {k: _AGGREGATES[how](v) for k, v in values.items()}
        blocks = made.groupBy(*self.part).agg(*[a.alias(f"_b_{k}") for k, a in known.items()])
        carried = blocks.select(*self.part, *[_AGGREGATES[how](F.col(f"_b_{k}")).over(earlier).alias(f"_b_{k}") for k in values])
        joined = made.join(written(carried, "carried"), self.part)
        both = {
            "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(a, b),
            "sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
        }[how]
        out = joined.withColumns({k: both(F.col(f"_n_{k}"), F.col(f"_b_{k}")) for k in values})
        return out.drop(*[f"{p}{k}" for k in values for p in ("_b_", "_n_")])


_AGGREGATES = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}


def scope(block: int | None) -> Whole:
    """``Whole`` without a block size."""
    return Whole() if block is None else Ranges(block)
