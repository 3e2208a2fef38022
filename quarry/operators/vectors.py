"""Exact nearest neighbours as expressions, hybrid search and rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LARGEST = 3.4028234663852886e38


def _dot(v: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(v, w, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(v: Column, vector: list[float], metric: str) -> Column:
    """cosine, dot_product, or l2_norm as the inverse of the distance."""
    w = F.array(*(F.lit(float(x)) for x in vector))
    if metric == "dot_product":
        return _dot(v, w)
    if metric == "cosine":
        size = sum(x * x for x in vector) ** 0.5
        return F.try_divide(_dot(v, w), F.sqrt(_dot(v, v)) * size)
    d = F.sqrt(F.aggregate(F.zip_with(v, w, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    return F.when(d == 0, LARGEST).otherwise(F.try_divide(F.lit(1.0), d))


def knn(df: DataFrame, field: str, vector: list[float], k: int, metric: str = "cosine", boost: float = 1.0, where: Column | None = None, id_col: str = "_id") -> DataFrame:
    """(id, score) of the k most similar rows among those that a filter keeps; partial top-k before any exchange."""
    if not 0 < k <= 10_000:
        raise ValueError("k must be between 1 and 10000")
    d = df if where is None else df.where(where)
    s = similarity(F.col(field), vector, metric) * boost
    return d.where(F.size(field) == len(vector)).select(F.col(id_col).alias("id"), s.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def multi_knn(lists: list[DataFrame], operator: str = "or") -> DataFrame:
    """Summed scores over several lists; `and` keeps ids that are in every one."""
    both = reduce(DataFrame.unionByName, lists)
    out = both.groupBy("id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return (out.where(F.col("n") == len(lists)) if operator == "and" else out).drop("n")


def hybrid(text: DataFrame, near: DataFrame) -> DataFrame:
    """Text and vector scores added; either list alone suffices."""
    n = near.withColumnRenamed("score", "near")
    return text.join(n, "id", "full_outer").select("id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("near", F.lit(0.0))).alias("score"))


def _top(df: DataFrame, window: int) -> DataFrame:
    """The window's head first (a distributed top-k), then ranks over that bounded head."""
    head = df.orderBy(F.desc("score"), "id").limit(window)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = 60, window: int = 100) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over the lists' heads."""
    weights = weights or [1.0] * len(lists)
    parts = [_top(d.where("score > 0"), window).select("id", (F.lit(float(w)) / (k + F.col("rank"))).alias("s")) for d, w in zip(lists, weights)]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("s").alias("score"))


def rsf(lists: list[DataFrame], weights: list[float] | None = None, window: int = 100, flat: float = 1.0) -> DataFrame:
    """Relative score fusion: each list's head scaled to [0, 1] (flat where all are equal), weighted and added."""
    weights = weights or [1.0] * len(lists)
    parts = []
    for d, w in zip(lists, weights):
        head = _top(d, window)
        lo, hi = F.min("score").over(Window.partitionBy()), F.max("score").over(Window.partitionBy())
        parts.append(head.select("id", (F.when(hi > lo, F.try_divide(F.col("score") - lo, hi - lo)).otherwise(flat) * float(w)).alias("s")))
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("s").alias("score"))
