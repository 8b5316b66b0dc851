"""Connected components of a graph held as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. e has u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    out = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())


def components(spark: SparkSession, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links(u, v); component is the smallest node it is connected to.

    Alternating large and small stars: the rows stay at most as many as the links, no group is gathered (a node's
    neighbours only enter a minimum), and nothing but counts comes to the driver. Links to itself and null ends are left
    out, repeated ones count once. Each round is written to the shared folder, so a lost executor costs no earlier round,
    and takes the place of the one before.
    """
    e = links.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(spark, e, "links")
    before = _state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        old, e = e, materialise(spark, _small_star(_large_star(e)), "stars")
        discard(old)  # the new table is whole, so nothing goes back to the one before
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
