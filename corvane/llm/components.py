"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a partial aggregation (the least neighbour of each node) and a join back, both tables read from the shared
folder, so Spark can split the partitions of a node with very many links. Rounds grow with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v). Large: of u's neighbours, those above u go to the least of u and them. Small: those below."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    met = both.join(least, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    done = staged(out.where("u <> v").distinct(), "links")
    unstage(least)
    return done


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: (u long, v long), each pair once or more, either way round. Gives (node, label): the least node of its component;
    nodes without a link to another are left out. Nulls are not nodes."""
    now = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before, state = None, _state(now)
    while state != before and state[0]:
        for large in (True, False):
            new = _star(now, large)
            unstage(now)
            now = new
        before, state = state, _state(now)
    label = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return label.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
