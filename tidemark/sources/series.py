"""Canonical series: (series_id STRING, t BIGINT from 1, value DOUBLE), and how tables become one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .ranges import Ranges, Whole, numbered, scope


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_series(df: DataFrame, value: str | Column, order: list[str | Column], series_id: str | Column | None = None, long: bool = False) -> DataFrame:
    """Numbers the rows of each series in order; NaN becomes null; without an id there is one series.

    One series is one window partition, unless series are ``long``: then range
    partitions number their own rows.
    """
    sid = F.lit("all") if series_id is None else (F.col(series_id) if isinstance(series_id, str) else series_id)
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    named = df.select(sid.cast("string").alias("series_id"), F.when(~F.isnan(v), v).alias("value"), *[
        (F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)
    ])
    keys = [f"_o{i}" for i in range(len(order))]
    if long:
        return numbered(named, ["series_id"], keys, "t").select("series_id", "t", "value")
    t = F.row_number().over(Window.partitionBy("series_id").orderBy(*keys)).cast("long")
    return named.select("series_id", t.alias("t"), "value")


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    """The numeric columns of a frame, from its schema alone."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in without]


def complexity_column(df: DataFrame) -> str:
    """The column that regime detection takes by itself: a known name, one ending in _complexity, else the first numeric."""
    known = ("complexity_score", "complexity", "complexity_score_value", "value", "score")
    numeric = numeric_columns(df)
    for name in known:
        if name in numeric:
            return name
    ending = [n for n in numeric if n.endswith("_complexity")]
    if not ending and not numeric:
        raise ValueError("there is no numeric column")
    return (ending or numeric)[0]


def add_time(df: DataFrame, series_id: str, order: list[str], name: str = "t") -> DataFrame:
    """Adds a row number by id, unless the column is there."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.row_number().over(Window.partitionBy(series_id).orderBy(*order)).cast("long"))


def drop_missing(df: DataFrame, columns: list[str], action: str = "pass") -> DataFrame:
    """``pass`` keeps all rows, ``omit`` drops rows with a null or NaN, ``fail`` raises on one when rows are read."""
    if action == "pass":
        return df
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    if action == "omit":
        return df.where(~bad)
    if action == "fail":
        return df.where(F.when(bad, F.raise_error(F.lit("missing values are not allowed")).cast("boolean")).otherwise(True))
    raise ValueError(f"unknown action {action}")


def fill_gaps(series: DataFrame, block: int | None = None) -> DataFrame:
    """Linear interpolation on t, then the last value forward, the first backward, then the mean.

    ``block`` cuts series into ranges of so many rows, so that no task holds a series.
    """
    within = scope(block)
    return filled(within, within.rows(series)).select(*series.columns)


def filled(within: Whole, rows: DataFrame) -> DataFrame:
    """``fill_gaps`` of numbered rows, which stay numbered; ranges without a null are left alone."""
    if isinstance(within, Ranges) and rows.where("value IS NULL").isEmpty():
        return rows
    known = {"_t{}": F.when(F.col("value").isNotNull(), F.col("t")), "_v{}": F.col("value")}
    out = within.before(rows, {k.format(0): v for k, v in known.items()}, "last")
    out = within.before(out, {k.format(1): v for k, v in known.items()}, "last", backwards=True)
    share = (F.col("t") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    between = F.when(F.col("_t1") > F.col("_t0"), F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share)
    return out.withColumn("value", F.coalesce("value", between, "_v0", "_v1")).select(*rows.columns)


def top_series(series: DataFrame, most: int, chosen: list[str] | None = None) -> DataFrame:
    """Rows of at most ``most`` series: the chosen ones, or the first ids."""
    ids = series.select("series_id").distinct()
    if chosen is not None:
        ids = ids.where(F.col("series_id").isin(*chosen))
    return series.join(F.broadcast(ids.orderBy("series_id").limit(most)), "series_id", "left_semi")


def segments(series: DataFrame) -> DataFrame:
    """Each series' first and last t and length, numbered in order of first appearance (ties by id)."""
    found = series.groupBy("series_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))
    order = Window.orderBy("first_t", "series_id")
    return found.withColumn("position", F.row_number().over(order).cast("long"))


# The driver's tables as series.


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series a user: event values in time order."""
    return to_series(read(spark, sf_dir, "events"), "value", ["ts", "event_id"], "user_id")


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: total order price a day, in 100,000."""
    daily = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    return to_series(daily, F.round(F.col("v") / 100000, 8), ["day"], F.lit("orders"))


def ships_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series a return flag: quantity shipped a day."""
    daily = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("v"))
    return to_series(daily, "v", ["day"], "l_returnflag")


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series an event type: mean value an hour on the full grid of hours, null where an hour has no event."""
    events = read(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", "ts").alias("hour"), "value")
    mean = events.groupBy("event_type", "hour").agg(F.round(F.avg("value"), 6).alias("value"))
    ends = events.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    hours = ends.select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour"))
    grid = events.select("event_type").distinct().crossJoin(F.broadcast(hours))
    return to_series(grid.join(mean, ["event_type", "hour"], "left"), "value", ["hour"], "event_type")


def events_by_user_and_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A (short) series a user and event type: event values in time order."""
    return to_series(read(spark, sf_dir, "events"), "value", ["ts", "event_id"], F.concat_ws("/", "user_id", "event_type"))


def events_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series: all event values in time order."""
    return to_series(read(spark, sf_dir, "events"), "value", ["ts", "event_id"], F.lit("events"), long=True)


# The same series for DuckDB, as bodies of common table expressions.
SQL = {
    "s6": "SELECT 'events' AS series_id, row_number() OVER (ORDER BY ts, event_id) AS t, value FROM events",
    "s5": "SELECT concat_ws('/', user_id, event_type) AS series_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS t, value FROM events",
    "s1": "SELECT cast(user_id AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value FROM events",
    "s2": """SELECT 'orders' AS series_id, row_number() OVER (ORDER BY day) AS t, round(v / 100000, 8) AS value
        FROM (SELECT cast(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY 1)""",
    "s3": """SELECT l_returnflag AS series_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY day) AS t, v AS value
        FROM (SELECT l_returnflag, cast(l_shipdate AS DATE) AS day, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)""",
    "s4": """SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS t, value
        FROM (SELECT DISTINCT event_type FROM events)
        CROSS JOIN (SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS hour FROM events)
        LEFT JOIN (SELECT event_type, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS value FROM events GROUP BY 1, 2) USING (event_type, hour)""",
}


def on(sql: str, one: str, other: str) -> str:
    """SQL over one series as the same SQL over another."""
    return sql.replace(SQL[one], SQL[other])
