from __future__ import annotations

from quarry.sources.engine import Engine
from quarry.streaming import ingest


def test_upserts_and_percolation(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("1", "old"), ("2", "fox")], "_id string, title string").write.parquet(src)
    stream = lambda: spark.readStream.schema("_id string, title string").parquet(src)
    ingest.upsert_stream(stream(), out, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("1", "new")], "_id string, title string").write.mode("append").parquet(src)
    ingest.upsert_stream(stream(), out, str(tmp_path / "cp")).awaitTermination()
    rows = ingest.latest(spark.read.parquet(out)).collect()
    assert sorted((r._id, r.title) for r in rows) == [("1", "new"), ("2", "fox")]
    e = Engine(spark)
    e.register_query("g", "f", {"match": {"title": "fox"}})
    q = ingest.percolate_stream(e, "g", stream(), {"title": {"type": "text", "analyzer": "simple"}}).writeStream.format("memory").queryName("hits").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert [(r.id, r.query_id) for r in spark.table("hits").collect()] == [("2", "f")]


def test_windows(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("SELECT timestamp'2020-01-01 00:00:01' AS ts, 'a' AS k UNION ALL SELECT timestamp'2020-01-01 00:07:00', 'a'").write.parquet(src)
    s = spark.readStream.schema("ts timestamp, k string").parquet(src)
    ingest.windowed_counts(s, "ts", "k", "5 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert sorted(r.n for r in spark.table("win").collect()) == [1, 1]
