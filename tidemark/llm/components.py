"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_uneven, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); nodes of one component share a root.

    Each round hooks every node to the neighbour (or itself) of least hashed priority,
    then replaces the links' ends by what they hooked to.  Random priorities shrink
    the graph by a constant factor a round, whatever its shape.  Rounds end in written
    tables, so neither lineage nor driver grows; the root is an arbitrary member.
    Nodes of very many links meet these by broadcast, not in one task.
    Null ends and self-links are ignored; no links give an empty table.
    """
    priority = lambda c: F.struct(F.xxhash64(c).alias("p"), F.col(c).alias("id"))
    links = edges.select("a", "b").where(F.col("a") != F.col("b"))
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    hooks: list[DataFrame] = []
    while not links.isEmpty():
        both = links.select(F.col("a").alias("u"), F.explode(F.array(priority("a"), priority("b"))).alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.explode(F.array(priority("a"), priority("b"))).alias("v"))
        )
        hook = written(both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n")).select("u", F.col("v.id").alias("m"), "n"), "hooks")
        hooks.append(hook.drop("n"))
        total = 2 * links.count()
        ends = join_uneven(links, hook.select(F.col("u").alias("a"), F.col("m").alias("ma"), "n"), "a", "n", total)
        ends = join_uneven(ends, hook.select(F.col("u").alias("b"), F.col("m").alias("mb"), "n"), "b", "n", total).where(F.col("ma") != F.col("mb"))
        links = written(ends.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), "links")
    if not hooks:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # From the last round back, so that a step joins the few nodes that were left, not all:
    # what a node hooked to is in its turn replaced by that node's root.
    out = hooks[-1].select(F.col("u").alias("node"), F.col("m").alias("root"))
    for hook in reversed(hooks[:-1]):
        sizes = hook.groupBy("m").agg(F.count("*").alias("n"))
        known = written(out.withColumnRenamed("node", "m").join(sizes, "m", "right").select("m", F.coalesce("root", "m").alias("root"), "n"), "roots")
        out = join_uneven(hook, known, "m", "n", hook.count()).select(F.col("u").alias("node"), "root")
    return out
