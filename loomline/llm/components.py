"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, scratch: storage.Scratch | None = None) -> DataFrame:
    """(id, component) for every vertex of edges (a long, b long); component is the smallest id reachable.

    Each step keeps an edge table no larger than the last in the shared folder; minima are combined
    before the shuffle, so a vertex with many edges costs one row a task. Self-loops are ignored.
    What is returned reads the last of these tables, which stands in the folder of `scratch` if given.
    """
    spark = edges.sparkSession
    path, step = storage.new_path(spark, "edges"), 0
    if scratch is not None:
        scratch.made += 1
        path = f"{scratch.path}/{scratch.made}-edges"
    # a > b from here on
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = storage.write(oriented, f"{path}/{step}")
    before = None
    while (state := _state(now))[0] and state != before:
        before, step = state, step + 1
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = storage.write(large.where("a <> b").distinct(), f"{path}/{step}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = storage.write(small.where("a <> b").distinct(), f"{path}/{step}")
        storage.drop(spark, f"{path}/{step}-large")
        storage.drop(spark, f"{path}/{step - 1}")
        now = after
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def extend_components(parts: DataFrame, links: DataFrame, scratch: storage.Scratch | None = None) -> DataFrame:
    """parts (id, component) with the links (a, b) added; only what they join is worked on again."""
    for end in "ab":
        links = links.join(parts.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}")), end, "left")
    joined = connected_components(links.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")), scratch)
    further = joined.select(F.col("id").alias("component"), F.col("component").alias("further"))
    moved = parts.join(further, "component", "left").select("id", F.coalesce("further", "component").alias("component"))
    return moved.unionByName(joined.join(parts.select("id"), "id", "left_anti"))
