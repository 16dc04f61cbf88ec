"""Communities and centralities of weighted undirected graphs, many graphs at once.

Edges are rows (series_id, src, dst, weight), as the networks and visibility graphs
give them.  Edges without a series, both ends or a positive weight and links of a node
to itself are left out; repeated and opposite edges add up.  A node without edges is in no result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

GAIN_DIGITS = 12
SMALL_NODES = 512
"""Nodes of a graph up to which one task searches it (it needs their square); larger graphs are searched by Spark, level by level."""


def _links(edges: DataFrame) -> DataFrame:
    """(series_id, u, v, w) in both directions, one row for each two linked nodes."""
    kept = edges.where((F.col("src") != F.col("dst")) & (F.col("weight") > 0) & F.col("series_id").isNotNull())
    both = kept.select("series_id", F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))).alias("e"), "weight")
    return both.groupBy("series_id", F.col("e.u").alias("u"), F.col("e.v").alias("v")).agg(F.sum("weight").cast("double").alias("w"))


def _by_size(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Links of the graphs that one task may hold, and of all larger ones, if there are any."""
    sizes = written(links.select("series_id", "u").distinct().groupBy("series_id").agg(F.count("*").alias("n")), "sizes")
    part = lambda which: links.join(sizes.where(which), "series_id", "left_semi")
    large = F.col("n") > SMALL_NODES
    return part(~large), None if sizes.where(large).isEmpty() else part(large)


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(series_id, node, community) by local moves that raise modularity, level by level; a community is its smallest node.

    In a round every node looks for the neighbouring community that raises modularity
    most.  Of the moves that leave or enter a community only the best is made, so the
    moves of a round touch different communities and their gains add up exactly:
    modularity rises with every round, which therefore end.  Then communities become the
    nodes of the next level, until a level makes no move.

    A graph of up to ``SMALL_NODES`` nodes (whole numbers) makes its rounds in one task;
    those of larger ones are joins that end in written tables, with the same moves.
    """
    links = written(_links(edges), "links")
    types = dict(links.dtypes)
    if types["u"] != "bigint" or types["v"] != "bigint":
        return _by_rounds(links, resolution)
    small, large = _by_size(links)

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(pdf["u"].to_numpy(), return_inverse=True)
        weights = np.zeros((len(nodes), len(nodes)))
        weights[at, np.searchsorted(nodes, pdf["v"].to_numpy())] = pdf["w"]
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "node": nodes, "community": nodes[_grouped(nodes, weights, resolution)]})

    out = small.groupBy("series_id").applyInPandas(found, f"series_id {types['series_id']}, node long, community long")
    return out if large is None else out.unionByName(_by_rounds(large, resolution))


def _grouped(nodes: np.ndarray, weights: np.ndarray, resolution: float) -> np.ndarray:
    """The place of its community's smallest node for each node of one graph, by the moves of ``_by_rounds``."""
    k = weights.sum(axis=1)
    m2, now = k.sum(), np.arange(len(nodes))
    while True:
        np.fill_diagonal(weights, 0)
        c, n = np.arange(len(nodes)), np.arange(len(nodes))
        turn = 0
        while True:
            own = np.zeros_like(weights)
            own[n, c] = 1.0
            inside, total = weights @ own, np.bincount(c, k, len(n))
            rest = total[c] - k
            pull = 2 * inside / m2 - 2 * resolution * k[:, None] * np.where(own > 0, rest[:, None], total) / (m2 * m2)
            stay = np.where(inside[n, c] > 0, pull[n, c], -2 * resolution * k * rest / (m2 * m2))
            away = np.where((inside > 0) & (own == 0), _rounded(pull), -np.inf)
            to = len(n) - 1 - away[:, ::-1].argmax(axis=1)  # of equal pulls the largest name's
            gain = _rounded(away[n, to] - stay)
            wish = np.flatnonzero(gain > 10.0 ** (2 - GAIN_DIGITS))
            if not len(wish):
                break
            wish = wish[np.lexsort((wish, _lots(nodes[wish], turn), gain[wish]))]
            top, rank = np.full(len(n), -1), np.arange(len(wish))
            np.maximum.at(top, c[wish], rank)
            np.maximum.at(top, to[wish], rank)
            made = wish[(top[c[wish]] == rank) & (top[to[wish]] == rank)]
            c[made] = to[made]
            turn += 1
        if not turn:
            return now
        kept, first, group = np.unique(c, return_index=True, return_inverse=True)
        order = np.argsort(first)  # communities in the order of their smallest nodes, which name them
        group = np.argsort(order)[group]
        own = np.zeros((len(n), len(kept)))
        own[n, group] = 1.0
        heads = first[order]
        weights, k = own.T @ weights @ own, np.bincount(group, k)
        at = np.searchsorted(np.unique(now), now)
        now = np.unique(now)[heads][group[at]]
        nodes = nodes[heads]


def _rounded(x: np.ndarray) -> np.ndarray:
    """As Spark rounds to ``GAIN_DIGITS``: halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**GAIN_DIGITS + 0.5) / 10.0**GAIN_DIGITS, x)


def _lots(u: np.ndarray, turn: int) -> np.ndarray:
    """``xxhash64(u, turn)`` of a long column and an int, as Spark gives it."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda h, by: h << np.uint64(by) | h >> np.uint64(64 - by)

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return h ^ h >> np.uint64(32)

    h = np.full(len(u), 50, np.uint64) + p5  # the seed and eight bytes
    h = mixed(turned(h ^ turned(u.astype(np.int64).view(np.uint64) * p2, 31) * p1, 27) * p1 + p4)
    h = h + p5 + np.uint64(4)
    return mixed(turned(h ^ np.full(len(u), turn, np.uint64) * p1, 23) * p2 + p3).view(np.int64)


def _by_rounds(links: DataFrame, resolution: float) -> DataFrame:
    """The communities of graphs of any size."""
    members = written(links.groupBy("series_id", F.col("u").alias("node")).agg(F.sum("w").alias("k")), "members")
    totals = members.groupBy("series_id").agg(F.sum("k").alias("m2"))
    nodes = members.join(totals, "series_id").select("series_id", F.col("node").alias("u"), "k", "m2")
    members = members.select("series_id", "node", F.col("node").alias("community"))
    while True:
        settled, any_move = _settled(links, nodes, resolution)
        if not any_move:
            return members
        name = settled.groupBy("series_id", "c").agg(F.min("u").alias("name"))
        renamed = written(settled.join(name, ["series_id", "c"]).select("series_id", "u", F.col("name").alias("c"), "k", "m2"), "nodes")
        to = renamed.select("series_id", F.col("u").alias("community"), F.col("c").alias("to"))
        members = written(members.join(to, ["series_id", "community"]).select("series_id", "node", F.col("to").alias("community")), "members")
        end = lambda of: renamed.select("series_id", F.col("u").alias(of), F.col("c").alias(f"c{of}"))
        links = written(links.join(end("u"), ["series_id", "u"]).join(end("v"), ["series_id", "v"]).groupBy("series_id", F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "links")
        nodes = renamed.groupBy("series_id", F.col("c").alias("u"), "m2").agg(F.sum("k").alias("k")).select("series_id", "u", "k", "m2")


def _settled(links: DataFrame, nodes: DataFrame, resolution: float) -> tuple[DataFrame, bool]:
    """``nodes`` with the community c that each is in when no single move raises modularity, and whether any moved."""
    state = written(nodes.withColumn("c", F.col("u")), "nodes")
    between, turn = links.where("u <> v"), 0
    while True:
        of = state.groupBy("series_id", "c").agg(F.sum("k").alias("total"))
        heard = between.join(state.select("series_id", F.col("u").alias("v"), "c"), ["series_id", "v"]).groupBy("series_id", "u", "c").agg(F.sum("w").alias("inside"))
        own = state.join(of, ["series_id", "c"]).select("series_id", "u", "k", "m2", F.col("c").alias("from"), (F.col("total") - F.col("k")).alias("rest"))
        met = heard.join(of, ["series_id", "c"]).join(own, ["series_id", "u"])
        # The pull of a community: links into it, less those that chance would give; a node's own is without itself.
        others = F.when(F.col("c") == F.col("from"), F.col("rest")).otherwise(F.col("total"))
        pull = 2 * F.col("inside") / F.col("m2") - 2 * resolution * F.col("k") * others / (F.col("m2") * F.col("m2"))
        alone = -2 * resolution * F.col("k") * F.col("rest") / (F.col("m2") * F.col("m2"))  # staying, where no link goes there
        best = met.groupBy("series_id", "u", "from").agg(
            F.max(F.when(F.col("c") != F.col("from"), F.struct(F.round(pull, GAIN_DIGITS).alias("pull"), F.col("c").alias("to")))).alias("best"),
            F.coalesce(F.max(F.when(F.col("c") == F.col("from"), pull)), F.first(alone)).alias("stay"),
        )
        gain = F.round(F.col("best.pull") - F.col("stay"), GAIN_DIGITS)
        wish = F.struct(gain.alias("gain"), F.xxhash64("u", F.lit(turn)).alias("lot"), "u", F.col("best.to").alias("to"))
        moves = best.where(F.col("best").isNotNull() & (gain > 10.0 ** (2 - GAIN_DIGITS))).select("series_id", wish.alias("wish"), F.explode(F.array("from", "best.to")).alias("c"))
        tops = moves.groupBy("series_id", "c").agg(F.max("wish").alias("wish"))
        made = tops.groupBy("series_id", "wish").count().where("count = 2").select("series_id", "wish.u", "wish.to")
        state = written(state.join(made, ["series_id", "u"], "left").select("series_id", "u", "k", "m2", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")), "nodes")
        if state.where("moved").isEmpty():
            return state.drop("moved"), turn > 0
        state, turn = state.drop("moved"), turn + 1


def modularity(edges: DataFrame, found: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(series_id, n_communities, modularity) of the communities (series_id, node, community) of a graph."""
    links = _links(edges)
    end = lambda of: found.select("series_id", F.col("node").alias(of), F.col("community").alias(f"c{of}"))
    placed = links.join(end("u"), ["series_id", "u"]).join(end("v"), ["series_id", "v"])
    sums = placed.groupBy("series_id", "cu").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    whole = sums.groupBy("series_id").agg(F.sum("k").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.count("*").alias("n_communities"))
    return whole.select("series_id", "n_communities", (F.col("inside") / F.col("m2") - resolution * F.col("squares") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def path_centralities(edges: DataFrame, passes: int = 1) -> DataFrame:
    """(series_id, node, reached, closeness, harmonic, betweenness) by numbers of links, weights aside.

    ``reached`` counts the other nodes of a node's component, ``closeness`` is their
    number over the sum of their distances, ``harmonic`` the sum of inverse distances,
    ``betweenness`` the sum over pairs of others of the share of their shortest paths
    that lead through the node.

    Breadth first from every node.  A graph of up to ``SMALL_NODES`` nodes is searched in
    one task.  For larger ones a level is one join and one grouping, and only the
    last two levels can hold a node already met.  Shares flow back level by level.  A
    row for each two nodes of a component is written; ``passes`` starts from so many
    parts of the nodes one after the other, which divides what lies on disk at a time.
    """
    if passes < 1:
        raise ValueError("at least one pass")
    links = written(_links(edges).select("series_id", "u", "v"), "links")
    small, large = _by_size(links)
    types = dict(links.dtypes)
    shape = f"series_id {types['series_id']}, node {types['u']}, reached long, closeness double, harmonic double, betweenness double"
    found = small.groupBy("series_id").applyInPandas(_searched, shape)
    return found if large is None else found.unionByName(_level_by_level(large, passes))


def _searched(pdf: pd.DataFrame) -> pd.DataFrame:
    """The centralities of one graph's nodes from its links (series_id, u, v); a matrix row is a source."""
    nodes, at = np.unique(pdf["u"].to_numpy(), return_inverse=True)
    linked = np.zeros((len(nodes), len(nodes)))
    linked[at, np.searchsorted(nodes, pdf["v"].to_numpy())] = 1.0
    paths, depth = np.eye(len(nodes)), np.where(np.eye(len(nodes), dtype=bool), 0, -1)
    level, last = paths, 0
    while True:
        level = np.where(depth < 0, level @ linked, 0.0)
        if not level.any():
            break
        last += 1
        depth[level > 0] = last
        paths = paths + level
    through, back = np.zeros(len(nodes)), np.zeros_like(paths)
    for d in range(last, 0, -1):
        there = depth == d
        share = np.where(there, paths * back, 0.0)
        through += share.sum(axis=0)
        back = np.where(there, (1 + share) / np.where(there, paths, 1.0), 0.0) @ linked
    met = depth > 0
    reached, far = met.sum(axis=1), np.where(met, depth, 0).sum(axis=1)
    harmonic = np.where(met, 1 / np.where(met, depth, 1), 0.0).sum(axis=1)
    return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "node": nodes, "reached": reached, "closeness": reached / far, "harmonic": harmonic, "betweenness": through / 2})


def _level_by_level(links: DataFrame, passes: int) -> DataFrame:
    """The centralities of graphs of any size."""
    nodes = links.select("series_id", "u").distinct()
    parts = [_from_sources(links, nodes.where(F.pmod(F.xxhash64("series_id", "u"), F.lit(passes)) == i)) for i in range(passes)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("series_id", "node").agg(*[F.sum(c).alias(c) for c in ("reached", "far", "harmonic", "through")])
    return sums.select("series_id", "node", "reached", (F.col("reached") / F.col("far")).alias("closeness"), "harmonic", (F.col("through") / 2).alias("betweenness"))


def _from_sources(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Sums a node: nodes reached, distances and inverse ones from it as a source; shares of paths through it of all sources."""
    keys = ["series_id", "s", "v"]
    levels = [written(sources.select("series_id", F.col("u").alias("s"), F.col("u").alias("v"), F.lit(1.0).alias("paths")), "level")]
    while True:
        step = levels[-1].withColumnRenamed("v", "u").join(links, ["series_id", "u"]).groupBy(*keys).agg(F.sum("paths").alias("paths"))
        for before in levels[-2:]:
            step = step.join(before.select(*keys), keys, "left_anti")
        level = written(step, "level")
        if level.isEmpty():
            break
        levels.append(level)
    out, shares = [], None
    for d in range(len(levels) - 1, 0, -1):
        level = levels[d]
        if shares is None:
            level = level.withColumn("share", F.lit(0.0))
        else:
            level = written(level.join(shares, keys, "left").select(*keys, "paths", (F.col("paths") * F.coalesce("back", F.lit(0.0))).alias("share")), "shares")
        of = lambda node, reached, through, d=d, level=level: level.groupBy("series_id", F.col(node).alias("node")).agg(
            reached.alias("reached"), (reached * d).alias("far"), (reached / d).alias("harmonic"), through.alias("through"))
        out += [of("s", F.count("*"), F.lit(0.0)), of("v", F.lit(0).cast("long"), F.sum("share"))]
        # What a node passes back goes to its neighbours one level nearer, in proportion to their paths.
        each = level.select("series_id", "s", F.col("v").alias("u"), ((1 + F.col("share")) / F.col("paths")).alias("each"))
        shares = each.join(links, ["series_id", "u"]).groupBy(*keys).agg(F.sum("each").alias("back"))
    if not out:
        return levels[0].select("series_id", F.col("v").alias("node"), F.lit(0).cast("long").alias("reached"), F.lit(0).cast("long").alias("far"), F.lit(0.0).alias("harmonic"), F.lit(0.0).alias("through"))
    return reduce(DataFrame.unionByName, out)


def clustering(edges: DataFrame) -> DataFrame:
    """(series_id, node, degree, triangles, clustering): the share of a node's pairs of neighbours that are linked; null below two.

    Links point to the end of more links, so that a node of very many has few going out
    and pairs of them stay near the number of links to the power of 1.5.
    """
    links = written(_links(edges).select("series_id", "u", "v"), "links")
    degree = links.groupBy("series_id", "u").agg(F.count("*").alias("n"))
    sized = links.join(degree, ["series_id", "u"]).join(degree.select("series_id", F.col("u").alias("v"), F.col("n").alias("m")), ["series_id", "v"])
    up = written(sized.where(F.struct("n", "u") < F.struct(F.col("m").alias("n"), F.col("v").alias("u"))).select("series_id", "u", "v"), "up")
    wedges = up.join(up.select("series_id", "u", F.col("v").alias("x")), ["series_id", "u"]).where("v < x")
    closed = wedges.join(links.select("series_id", F.col("u").alias("v"), F.col("v").alias("x")), ["series_id", "v", "x"])
    corners = closed.select("series_id", F.explode(F.array("u", "v", "x")).alias("u")).groupBy("series_id", "u").agg(F.count("*").alias("t"))
    found = degree.join(corners, ["series_id", "u"], "left").withColumn("triangles", F.coalesce("t", F.lit(0)).cast("long"))
    return found.select("series_id", F.col("u").alias("node"), F.col("n").alias("degree"), "triangles", F.when(F.col("n") > 1, 2 * F.col("triangles") / (F.col("n") * (F.col("n") - 1))).alias("clustering"))
