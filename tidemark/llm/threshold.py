"""Exact top-k inner products with Fagin's threshold algorithm.

Queries are dealt in teams and candidates in spans, both of bounded size; one task
walks a span for a team.  It takes the span's candidates block by block and keeps every
dimension's candidates of the block sorted.  A query goes down all lists together, from
the end that its sign favours; a candidate first seen in any list is scored in full; the
values at the present depth bound the score of every unseen one.  It leaves a block once
its k-th score, which it carries from block to block, beats that bound: a block whose
first bound is too low is not entered at all.  The spans' results are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written
from .vectors import is_finite_vector, matrix

CANDIDATE_BLOCK, QUERY_TEAM, SPAN_BLOCKS, FIRST_DEPTH = 4096, 2048, 16, 8


class SortedLists:
    """A block of candidates with its sorted list for each dimension."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.order = ids[by_id], by_id
        self.v = vectors[by_id]
        self.rising = np.argsort(self.v, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.v, self.rising, axis=0)

    def walk(self, query: np.ndarray, k: int, skip: int = -1, least: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and scores of up to ``k`` best (ties to smaller ids), and how many candidates were scored.

        With ``least``, a k-th score known before, only scores of at least that matter.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        unseen = np.ones(n, bool)
        if 0 <= skip < n:
            unseen[skip] = False
        at, score, depth, scored = np.zeros(0, np.int64), np.zeros(0, self.v.dtype), 0, 0
        flat = not len(up) and not len(down)  # a zero query: every score is zero, and no list has an order
        while depth < n:
            if depth or not flat:
                bound = query[up] @ self.values[n - 1 - depth, up] + query[down] @ self.values[depth, down]
                known = score.min() if len(at) == k else least
                if known is not None and known > bound:
                    break
            before, depth = depth, n if flat else min(n, max(FIRST_DEPTH, 2 * depth))
            if flat:
                new = np.flatnonzero(unseen)
            else:
                met = np.zeros(n, bool)
                met[self.rising[n - depth : n - before, up].ravel()] = True
                met[self.rising[before:depth, down].ravel()] = True
                new = np.flatnonzero(met & unseen)
            unseen[new] = False
            scored += len(new)
            got = self.v[new] @ query
            if least is not None:
                new, got = new[got >= least], got[got >= least]
            at, score = np.concatenate((at, new)), np.concatenate((score, got))
            if len(at) > k:  # positions ascend with ids, so they break ties
                best = np.lexsort((at, -score))[:k]
                at, score = at[best], score[best]
            if not unseen.any():
                break
        best = np.lexsort((at, -score))
        return at[best], score[best], scored


class Team:
    """Queries with their best candidates so far."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.uids, self.ids, self.v, self.k = uids, ids, vectors, k
        none = np.zeros(0, np.int64)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(none, none)] * len(uids)

    def meet(self, uids: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> int:
        """Walks a block of candidates for every query; returns how many scores were computed."""
        most = int(np.abs(self.v).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(vectors.shape[1], 1)
        kind = np.float64 if most < 1 << 53 else np.int64  # in doubles while these are exact, and fast
        lists, scored = SortedLists(vectors.astype(kind), ids), 0
        own = {int(u): i for i, u in enumerate(uids[lists.order].tolist())}
        for row, query in enumerate(self.v.astype(kind)):
            had, scores = self.best[row]
            least = scores[-1] if len(had) == self.k else None
            at, new, n = lists.walk(query, self.k, own.get(int(self.uids[row]), -1), least)
            scored += n
            if len(at):
                had, scores = np.concatenate((had, lists.ids[at])), np.concatenate((scores, new.astype(np.int64)))
                best = np.lexsort((had, -scores))[: self.k]
                self.best[row] = had[best], scores[best]
        return scored

    def results(self) -> pa.RecordBatch:
        """(quid, query_id, vec_id, score) of all queries."""
        n = [len(ids) for ids, _ in self.best]
        cols = [np.repeat(self.uids, n), np.repeat(self.ids, n), *(np.concatenate(x) for x in zip(*self.best))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["quid", "query_id", "vec_id", "score"])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Results of a task's teams; rows come by (dim, team, span), queries before candidates."""
    group, team, queries, held, n_held = None, None, [], [], 0

    def joined(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(parts)
        return t.column("uid").to_numpy(), t.column("vec_id").to_numpy(), matrix(t.column("v"), group[0], np.int64)

    def flush() -> None:
        nonlocal team, queries, held, n_held
        if team is None and queries:
            team, queries = Team(*joined(queries), k), []
        if team is not None and held:
            team.meet(*joined(held))
        held, n_held = [], 0

    for batch in batches:
        keys = np.column_stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("dim", "team", "span", "candidate")])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            if hi == lo:
                continue
            *now, is_candidate = keys[lo].tolist()
            if now != group:
                flush()
                if team is not None:
                    yield team.results()
                group, team, queries = now, None, []
            if not is_candidate:
                queries.append(batch.slice(lo, hi - lo))
                continue
            while lo < hi:
                step = min(hi - lo, CANDIDATE_BLOCK - n_held)
                held.append(batch.slice(lo, step))
                n_held, lo = n_held + step, lo + step
                if n_held == CANDIDATE_BLOCK:
                    flush()
    flush()
    if team is not None:
        yield team.results()


def top_k(rows: DataFrame, is_query: F.Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest integer inner products.

    Components become floor(scale * x).  Queries are the rows where ``is_query`` holds,
    candidates all rows but the query's own.  Fewer than ``k`` candidates give as many
    rows; ties go to the smaller id.  Rows without id, vectors that are null or hold
    null or non-finite components take no part; vectors of different length do not
    meet; empty vectors all score zero.  A repeated row is a candidate, and a query, by
    itself.  An empty table gives an empty one.  Scores must fit a long; other columns
    of ``rows`` are read only by ``is_query``.
    """
    spark = rows.sparkSession
    floored = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    fit = rows.where(is_finite_vector(vector) & F.col(vec_id).isNotNull())
    base = fit.select(F.col(vec_id).cast("long").alias("vec_id"), floored.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    base = written(base.withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "candidates")
    n, n_queries = base.agg(F.count("*"), F.count_if("q")).first()
    teams = -(-n_queries // QUERY_TEAM) or 1
    # Spans are as long as they may be, unless that leaves too few tasks.
    spans = max(-(-n // (CANDIDATE_BLOCK * SPAN_BLOCKS)), min(-(-n // CANDIDATE_BLOCK), -(-partitions(spark) // teams)), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda seed, n: F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(n)).cast("int")
    left = base.where("q").select("dim", deal(1, teams).alias("team"), every(spans).alias("span"), F.lit(0).alias("candidate"), "uid", "vec_id", "v")
    right = base.select("dim", every(teams).alias("team"), deal(2, spans).alias("span"), F.lit(1).alias("candidate"), "uid", "vec_id", "v")
    key = ["dim", "team", "span"]
    dealt = left.unionByName(right).repartition(max(partitions(spark), min(teams * spans, 20_000)), *key).sortWithinPartitions(*key, "candidate")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _search(batches, k)

    found = dealt.mapInArrow(search, "quid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
