"""Connected components of a graph of links, by rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``edges``; root is its component's smallest node.

    Each round ties every node's larger neighbours, then its smaller ones, to its
    smallest neighbour, until nothing changes: a number of rounds that grows with
    the logarithm of a component's size. The edges of each round are written to
    the shared folder; only their count and a checksum reach the driver.
    """
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, seen = stored(both, "links"), None
    for _ in range(MAX_ROUNDS):
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if sign == seen:
            break
        seen = sign
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        tied = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tied = tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        now = stored(tied.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    rooted = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    tops = rooted.select(F.col("root").alias("node"), "root").distinct()
    return stored(rooted.unionByName(tops), "components")
