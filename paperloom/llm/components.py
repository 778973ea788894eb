"""Connected components of a link table, without bringing links to the driver.

Large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): each
round is two aggregations and joins over the links, its result is stored in the shared folder and the round before
it deleted, and rounds end when every node hangs directly on its component's smallest node. Rounds grow with the
logarithm of the longest path, so they need no limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import drop, settled, stored

#: A component of more nodes than this is hot, and more of them if over MOST_HOT could be.
HOT_NODES, MOST_HOT = 10_000, 50_000


def _smallest(links: DataFrame) -> DataFrame:
    """Each node u with the smallest of itself and its neighbours v; a sum by key, so one hot node is no burden."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _star(links: DataFrame, large: bool) -> DataFrame:
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # written first, so that both sides of the join are exchanges and a node with very many links can be split
    least = stored(_smallest(both))
    moved = both.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where(F.col("v") > F.col("u") if large else F.lit(True)).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _mark(links: DataFrame) -> tuple:
    """Tells apart two sets of links: their number, and two hashes combined without carry, so at any number."""
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.bit_xor(F.xxhash64("v", "u", F.lit(1))).alias("g")).first()
    return row["n"], row["h"], row["g"]


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` of any order and with repeats -> ``(node, root)`` for each node with a link to another.

    ``root`` is the smallest node of the component. No links give an empty table. Nulls must be removed before.
    """
    stars = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(stars)
    while mark[0]:
        after = settled(lambda now=stars: _star(_star(now, True), False))
        drop(stars)
        stars, last, mark = after, mark, _mark(after)
        if last == mark:
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def with_least(nodes: DataFrame, value: str, name: str) -> DataFrame:
    """``nodes(root, value, ...)``, stored, with the least ``value`` of all nodes of a root as ``name``.

    A root may hold most nodes: roots of more than ``hot`` nodes, of which there can be MOST_HOT at most, meet their
    nodes by broadcast, so no task gets all nodes of one root.
    """
    hot = max(HOT_NODES, nodes.count() // MOST_HOT)
    least = stored(nodes.groupBy("root").agg(F.min(value).alias(name), F.count(F.lit(1)).alias("n_nodes")))
    big = least.where(F.col("n_nodes") > hot).select("root", name)
    small = least.where(F.col("n_nodes") <= hot).select("root", name)
    near = nodes.join(F.broadcast(big), "root")
    rest = nodes.join(F.broadcast(big.select("root")), "root", "left_anti")
    return near.unionByName(rest.join(small, "root"))
