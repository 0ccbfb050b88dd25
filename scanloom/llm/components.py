"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins. Minima are combined before the shuffle, and a node with very many
links is split by Spark's skew join, so no task holds all of one node's links. The links of a round replace those
of the last in the shared folder; the rounds end when all links lead straight to roots, after about the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import checkpointed
from scanloom.sources.tables import LoopTables


def _settled(links: DataFrame) -> bool:
    """Whether each u has one link and no v is a u: then every v is the root of its component."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x")).select("x.*")
    ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return ends.filter((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("least") == 0))).isEmpty()


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """links: two columns of nodes of one ordered type. Gives (node, root), root the least node of the component, for
    each node that has a link to another; links of a node to itself, repeated and null links count for nothing.
    After `rounds` rounds, if given, the search ends: root is then some lesser node of the component, or the node itself."""
    a, b = links.columns
    links = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    with LoopTables(links.sparkSession) as kept:
        links = kept.put("links", links)
        while rounds != 0 and not _settled(links):
            rounds = rounds and rounds - 1
            both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
            links = kept.put("links", small.filter("u != v").distinct())
        nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")))
        return checkpointed(nodes.groupBy("node").agg(F.min("root").alias("root")))
