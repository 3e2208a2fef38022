"""Connected components by alternating large-star and small-star passes over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _pass(edges: DataFrame, large: bool) -> DataFrame:
    """One star pass; the smallest neighbour of a node is a map-side combined minimum, so no hub is gathered."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")) if large else both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of orderable ids -> (node, root): every node with an edge and the smallest id of its component."""
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        new = materialize(_pass(_pass(now, True), False), "stars")
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(now)
        now = new
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
