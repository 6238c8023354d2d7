"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of ``edges`` (a long, b long).

    Alternates the large-star and small-star steps until all edges point to roots; each round is
    written to the shared folder. Minima are aggregated before the shuffle and joined back, so a
    node with very many edges is not gathered in one task.
    """
    down = F.when(F.col("a") > F.col("b"), F.struct(F.col("a").alias("u"), F.col("b").alias("v"))).otherwise(F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    current = stored(edges.where("a != b").select(down.alias("e")).select("e.*").distinct(), "edges")
    before = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        following = stored(small.where("u != v").distinct(), "small-star")
        release(large)
        state = following.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        release(current)
        current = following
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    found._docloom_path = current._docloom_path  # so that release(found) drops the last round's table
    return found
