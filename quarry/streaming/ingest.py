"""Streams: upserts into an index directory, percolation of arriving documents and windowed aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, id_col: str = "_id") -> StreamingQuery:
    """Appends micro-batches as versions; `latest` reads the last version of each id, so replayed batches change nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(df: DataFrame, id_col: str = "_id") -> DataFrame:
    cols = [c for c in df.columns if c not in ("epoch", "_epoch")]
    return df.groupBy(id_col).agg(F.max_by(F.struct(*cols), "_epoch").alias("r")).select("r.*")


def percolate_stream(engine, group: str, stream: DataFrame, mapping: dict | None = None, id_col: str = "_id") -> DataFrame:
    """The stored queries as a streaming filter."""
    return engine.percolate(group, stream, mapping, id_col)


def windowed_counts(stream: DataFrame, time_col: str, key: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Event-time counts by key with a watermark."""
    w = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    return stream.withWatermark(time_col, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"))
