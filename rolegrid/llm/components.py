"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join; each round is written to the shared folder, which cuts lineage, and
the round before is dropped. A centre with very many links is aggregated on the map side for its minimum, and the
join that follows is one that Spark may split where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.shared import drop, new_path, stash


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it sees, itself included."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them. links hold a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of integer ids, in any order and with repeats. Returns (node, component): one row for each id
    that a link names, with the smallest id reachable. Nulls and self-links name nothing."""
    spark = links.sparkSession
    path = new_path(spark, "links")
    now = stash(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", path)
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    seen = now.select(mark.alias("m")).first().m
    while seen[0]:
        after_path = new_path(spark, "links")
        after = stash(_small_star(_large_star(now)), "links", after_path)
        found = after.select(mark.alias("m")).first().m
        drop(spark, path)
        now, path = after, after_path
        if found == seen:
            break
        seen = found
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)
