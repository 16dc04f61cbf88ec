"""The maximal information coefficient with one axis cut at its best places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 16


def characteristic(a: DataFrame, b: DataFrame, power: float = 0.6, clumps: int | None = 15) -> DataFrame:
    """(series_id, cut_columns, even_rows, turned, information): normalised mutual information of every grid size of at most n ** ``power`` cells.

    One axis has rows of equal frequency (equal values share one), the other the columns
    that give the most information; ``turned`` says that b's axis was the one cut at its
    best places.  Columns end only between clumps, runs of points in one row; more than
    ``clumps`` times the columns' number of these are first joined to as many of even
    size (null: never, which is exact).  Series of less than four common values, nulls
    and not-a-numbers left out, are in no result.

    The grids of a series go to ``PARTS`` tasks for either axis; a task holds the series'
    values and a table of columns by clumps.
    """
    both = a.select("series_id", "t", F.col("value").cast("double").alias("x")).join(b.select("series_id", "t", F.col("value").cast("double").alias("y")), ["series_id", "t"])
    lists = both.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p")).where(F.size("p") >= 4)
    turned = F.explode(F.array(F.lit(False), F.lit(True)))
    each = lists.select("series_id", "p.x", "p.y", turned.alias("turned")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    id_type = a.schema["series_id"].dataType.simpleString()

    def analysed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for row in frame.itertuples():
                x, y = (row.y, row.x) if row.turned else (row.x, row.y)
                cells = max(4, int(np.floor(len(x) ** power)))
                for rows in range(2 + row.part, cells // 2 + 1, PARTS):
                    best = best_columns(np.asarray(x), even_rows(np.asarray(y), rows), cells // rows, clumps)
                    found += [(row.series_id, p, rows, row.turned, i / np.log(min(p, rows))) for p, i in enumerate(best, 2)]
            yield pd.DataFrame(found, columns=["series_id", "cut_columns", "even_rows", "turned", "information"])

    return each.repartition("series_id", "turned", "part").mapInPandas(analysed, f"series_id {id_type}, cut_columns int, even_rows int, turned boolean, information double")


def optimal_information(a: DataFrame, b: DataFrame, power: float = 0.6, clumps: int | None = 15) -> DataFrame:
    """(series_id, mic): the largest entry of ``characteristic``."""
    return characteristic(a, b, power, clumps).groupBy("series_id").agg(F.max("information").alias("mic"))


def even_rows(y: np.ndarray, rows: int) -> np.ndarray:
    """The row (from 0, without gaps) of every value; equal values share that of their smallest rank."""
    rank = np.searchsorted(np.sort(y), y)
    return np.unique(rank * rows // len(y), return_inverse=True)[1]


def best_columns(x: np.ndarray, row: np.ndarray, most: int, clumps: int | None) -> list[float]:
    """Mutual information of rows with the best 2, 3, .. ``most`` columns."""
    order = np.argsort(x, kind="stable")
    x, row = x[order], row[order]
    value = np.unique(x, return_inverse=True)[1]
    table = np.zeros((value[-1] + 1, row.max() + 1))
    np.add.at(table, (value, row), 1)
    # Neighbouring values that lie in one and the same row are never parted.
    pure = (table > 0).sum(axis=1) == 1
    home = table.argmax(axis=1)
    new = np.concatenate([[True], ~(pure[1:] & pure[:-1] & (home[1:] == home[:-1]))])
    table = np.add.reduceat(table, np.flatnonzero(new), axis=0)
    if clumps is not None and len(table) > clumps * most:
        middle = table.sum(axis=1).cumsum() - table.sum(axis=1) / 2
        group = (middle * clumps * most / len(x)).astype(int)
        table = np.add.reduceat(table, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), axis=0)
    n, ends = len(x), np.concatenate([np.zeros((1, table.shape[1])), table.cumsum(axis=0)])
    share = ends[-1] / n
    entropy = -float((share * np.log(share)).sum())
    # fit[l, t]: the first t clumps in l columns, each column counting the sum of m ln(m / size) over its rows.
    fit = np.full((most + 1, len(table) + 1), -np.inf)
    fit[0, 0] = 0.0
    for t in range(1, len(table) + 1):
        m = ends[t] - ends[:t]
        size = m.sum(axis=1)
        column = (m * np.log(np.where(m > 0, m, 1.0))).sum(axis=1) - size * np.log(size)
        fit[1:, t] = (fit[:-1, :t] + column).max(axis=1)
    reach = np.maximum.accumulate(fit[1:, -1])  # fewer clumps than columns: as many as there are
    return [max(0.0, entropy + float(v) / n) for v in reach[1:]]
