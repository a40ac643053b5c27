"""Connected components of links by large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.runtime import release, stored


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named after its smallest node.

    Links with a null or the same node at both ends say nothing.  Every step
    groups and joins on a node and keeps at most as many links as there were;
    the number of steps grows with the logarithm of the number of nodes.  Only
    a count and a checksum come to the driver.  Each step writes its links, so
    nothing depends on what an earlier executor held.
    """
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    now = stored(links.filter("a != b").select(low, high).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("low", "high"))).first()
        if mark == seen:
            break
        seen = mark
        before, now = now, stored(_small_star(_large_star(now)))
        release(before)
    roots = now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots)


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest neighbour, or to itself if that is smaller."""
    both = links.select(F.col("low").alias("node"), F.col("high").alias("other")).unionByName(
        links.select(F.col("high").alias("node"), F.col("low").alias("other"))
    )
    least = both.groupBy("node").agg(F.min("other").alias("other"))
    least = least.select(F.col("node").alias("low"), F.least("node", "other").alias("least"))
    return links.join(least, "low").select(F.col("least").alias("low"), "high").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of these."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").filter("low != least")
    moved = moved.select(F.col("least").alias("low"), F.col("low").alias("high"))
    kept = least.select(F.col("least").alias("low"), "high")
    return kept.unionByName(moved).distinct()
