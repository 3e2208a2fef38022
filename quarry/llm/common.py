"""Helpers shared by the corpus operators: table loading and durable intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One ASCII white-space byte, as the contracts define words by its absence.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch: whole texts may be long, and both the executor and its Python workers hold a batch or two.
BATCH_ROWS = 1_000


def bounded(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's rows per Arrow batch to rows, unless it asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, set here only where it is unset and everything runs on one machine (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def posix(path: str) -> str:
    """The mount path of a shared folder given as a path or file: URI; memory-mapped files need one."""
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a shared POSIX mount, not {path!r}")
    return u.path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut and lost executors cost nothing."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], names: list[str], types: list[pa.DataType]) -> DataFrame:
    """A table of rows that the driver has, passed on through Arrow: plain rows would start Python workers of another kind, which executors then keep."""
    columns = zip(*rows) if rows else ([] for _ in names)
    return spark.createDataFrame(pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=names))


def drop_table(df: DataFrame) -> None:
    """Deletes a materialised table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)


def shielded(df: DataFrame, needed: tuple[str, ...], of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `of` makes of df, with the columns that it doesn't need under names that can't clash with its own meanwhile."""
    bounded(df.sparkSession)
    inner = [c if c in needed else f"_in_{i}" for i, c in enumerate(df.columns)]
    out = of(df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, inner))))
    return out.select(*(F.col(n).alias(c) for c, n in zip(df.columns, inner)))


def numbered(df: DataFrame) -> DataFrame:
    """df with _f and _r, which name each row by its file and place there, however a later scan is split.

    A DataFrame that isn't a plain file scan is stored first.
    """
    try:
        return df.select("*", F.xxhash64("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    except AnalysisException:
        return numbered(materialize(df, "rows"))


def side_table(df: DataFrame, tag: str, block: int = 0) -> str:
    """Writes df (with _f and _r) by file and in row order, so that a scan of the rows can look up what belongs to them.

    One task writes what belongs to a file, or to so many of its rows.
    """
    path = shared_path(df.sparkSession, tag)
    by = ["_f", "_b"] if block else ["_f"]
    if block:
        df = df.withColumn("_b", F.expr(f"_r div {block}"))
    df.repartition(*by).sortWithinPartitions(*by, "_r").write.partitionBy(*by).option("parquet.block.size", 4 << 20).parquet(path)
    return path


def side_rows(path: str, file: int, first: int, last: int, block: int = 0) -> pa.Table | None:
    """The rows of a side table that belong to rows first to last of a file; read where they are needed, a batch at a time."""
    fs, root = (pafs.LocalFileSystem(), posix(path)) if "://" not in path or path.startswith("file:") else pafs.FileSystem.from_uri(path)
    folders = [f"{root}/_f={file}/_b={b}" for b in range(first // block, last // block + 1)] if block else [f"{root}/_f={file}"]
    folders = [x.path for x in fs.get_file_info(folders) if x.type != pafs.FileType.NotFound]
    if not folders:
        return None
    where = (pads.field("_r") >= first) & (pads.field("_r") <= last)
    return pa.concat_tables(pads.dataset(x, filesystem=fs, format="parquet").to_table(filter=where).sort_by("_r") for x in folders)


def keep_rows(rows: DataFrame, kept: DataFrame, columns: list[str], *more: str, made: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str] | None = None) -> DataFrame:
    """The rows (numbered) that kept (_f, _r) names, with columns and what kept has more of each.

    Only names and those values move: the rows stay in their scan, whatever their size. made: what is made of them,
    and its schema, in the same Python worker; a second mapInArrow would take, and an executor keep, one more a core.
    """
    path = side_table(kept.select("_f", "_r", *more), "kept")
    schema = rows.select(*columns).schema
    for c in more:
        schema = schema.add(kept.schema[c])
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            f, r = whole.column(n).to_numpy(), whole.column(n + 1).to_numpy()
            ends = np.flatnonzero(np.r_[f[1:] != f[:-1], True]) + 1 if len(f) else []
            for a, b in zip([0, *ends[:-1]], ends):  # a file at a time
                found = side_rows(path, int(f[a]), int(r[a:b].min()), int(r[a:b].max()))
                if found is None or not found.num_rows:
                    continue
                own = found.column("_r").to_numpy()
                at = np.minimum(np.searchsorted(own, r[a:b]), len(own) - 1)
                mask = own[at] == r[a:b]
                if mask.any():
                    out = whole.slice(a, b - a).filter(pa.array(mask))
                    extra = [found.column(c).combine_chunks().take(pa.array(at[mask])) for c in more]
                    yield pa.RecordBatch.from_arrays([*out.columns[:n], *(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in extra)], names=schema.names)
            tidy()

    of, schema_of = made or (iter, schema)
    return rows.select(*columns, "_f", "_r").mapInArrow(lambda batches: of(run(batches)), schema_of)


def tidy() -> None:
    """Gives freed memory back to the system, so that a worker's peak isn't kept for its life."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that what Python holds of them at once stays small."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)
        del batch
        tidy()


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the value as text, modulo m; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
