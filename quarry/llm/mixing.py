"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key -ln(U)/w, w its quality weight and U a hash of its content. A source
whose target is e whole epochs and a fraction gives every document e times; the fraction goes to the
documents with the smallest keys, in order, until the prefix sum of words meets the budget exactly: the
document at the boundary is taken in part.

Nothing sorts a whole source in one task: keys map monotonically to 63-bit codes, sums by code prefix find
the prefix in which the budget ends, and only that prefix is sorted. Copies of one row have codes of their
own (a hash of the row number fills the low bits), so a group of copies that holds a third of all rows splits.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, ordered last;
sources of size 0 have target 0; repeated rows each take their share; an empty table gives an empty result;
extra columns are ignored by the query and kept by `mix_rows`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import check_columns, load, materialize, numbered, shielded, small_table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 7_301
#: Rows of one code prefix that a single task may sort.
SORTED_ROWS = 50_000
CODE_BITS = 63
STEP_BITS = 12


def quality_weight(text: Column) -> Column:
    """In (0, 1]: the share of characters that aren't symbols of markup or tables, squared."""
    text = F.coalesce(text, F.lit(""))
    share = F.regexp_count(text, F.lit(r"[#*$%&|<>!]")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), F.pow(F.lit(1.0) - share, F.lit(2.0)))


def source_key(source: Column) -> Column:
    """Not null, and in the order of sources by code point with null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def ranked(df: DataFrame, key: str) -> DataFrame:
    """df with _rank from 0 in the order of key, without gathering it in one task."""
    thin = materialize(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("_m", 33)
    first, starts = 0, []
    for p, n in sorted((r[0], r[1]) for r in thin.groupBy(part.alias("p")).count().collect()):
        starts.append((p, first))
        first += n
    table = F.broadcast(small_table(df.sparkSession, starts or [(0, 0)], ["_p", "_start"], [pa.int64(), pa.int64()]))  # one row a shuffle partition
    return thin.withColumn("_p", part).join(table, "_p").withColumn("_rank", F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_m", "_start")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """(_source, source_size) with target: shares by weight, none above cap times its size, the excess reshared."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    s = materialize(ranked(sources, "_source").withColumn("_w", weight), "targets")
    level = 0.0
    while True:  # the water level only rises; each pass is one sum over the source table
        full = F.col("_w") * F.lit(level) >= F.col("source_size") * cap
        row = s.agg(F.sum("source_size").cast("double").alias("total"), F.sum(F.when(full, F.col("source_size") * cap)).cast("double").alias("held"), F.sum(F.when(~full, F.col("_w"))).alias("open")).first()
        if not row.total or not row.open:
            break
        up = (row.total - (row.held or 0.0)) / row.open
        if up <= level * (1 + 1e-15):
            break
        level = up
    return s.withColumn("target", F.least(F.col("_w") * F.lit(level), (F.col("source_size") * cap).cast("double"))).select("_source", "source_size", "target")


def coded(keys: DataFrame) -> DataFrame:
    """keys (_source, size, _w quality weight, _h content hash) with _rid and the 63-bit code _c, which orders rows as their keys do."""
    u = (F.shiftrightunsigned("_h", 11).cast("double") + 0.5) / float(1 << 53)
    key = -F.log(u) / F.col("_w")
    # 1 - exp(-key) rises with the key and spreads it over [0, 1); 32 bits of it, 16 of the content, 15 of the row
    spread = F.least(F.floor((1 - F.exp(-key)) * float(1 << 32)), F.lit((1 << 32) - 1)).cast("long")
    row = F.xxhash64("_f", "_r") if "_f" in keys.columns else F.monotonically_increasing_id()
    code = F.shiftleft(spread, 31).bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.xxhash64("_h"), 48), 15)).bitwiseOR(F.shiftrightunsigned(F.xxhash64(row), 49))
    return keys.withColumn("_rid", row).withColumn("_c", code).drop("_w", "_h")


def mix_plan(thin: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """Per source: source_size, target, _epochs, and the code prefix (after a shift) in which the remaining budget _left ends."""
    goal = materialize(targets(thin.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, cap), "goals")
    size = F.col("source_size")
    whole = F.least(F.floor(F.round("target").cast("long") / size), F.lit(cap))
    at = (
        goal.withColumn("_epochs", F.coalesce(F.when(size > 0, whole), F.lit(0)).cast("long"))
        .withColumn("_left", F.greatest(F.lit(0), F.round(F.col("target")).cast("long") - F.col("_epochs") * size))
        .withColumn("_prefix", F.lit(0).cast("long"))
    )
    shift = CODE_BITS
    while shift > 0:  # narrows the prefix in which each source's budget ends until one task can sort what shares it
        wide = shift
        shift = max(0, shift - STEP_BITS)
        inside = thin.join(at.where("_left > 0").select("_source", "_prefix"), "_source").where(_bits(F.col("_c"), wide) == F.col("_prefix"))
        by = inside.groupBy("_source", _bits(F.col("_c"), shift).alias("_next")).agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        order = Window.partitionBy("_source").orderBy("_next")  # at most 4096 prefixes a source
        ends = by.withColumn("_before", F.sum("_sum").over(order) - F.col("_sum"))
        hit = ends.join(at.select("_source", "_left"), "_source").where((F.col("_before") <= F.col("_left")) & (F.col("_before") + F.col("_sum") > F.col("_left"))).select("_source", "_next", "_before", "_n")
        at = materialize(
            at.join(hit, "_source", "left")
            .withColumn("_prefix", F.coalesce("_next", F.shiftleft(F.col("_prefix"), wide - shift).cast("long")))
            .withColumn("_left", F.col("_left") - F.coalesce("_before", F.lit(0)))
            .withColumn("_n", F.coalesce("_n", F.lit(0)))
            .drop("_next", "_before"),
            "prefix",
        )
        most = at.agg(F.max("_n")).first()[0] or 0
        at = at.drop("_n")
        if most <= SORTED_ROWS:
            break
    return at, shift


def boundary(thin: DataFrame, at: DataFrame, shift: int) -> DataFrame:
    """The rows of the prefixes in which budgets end, with _part, the words that the fraction takes of each."""
    both = thin.join(at, "_source").where((_bits(F.col("_c"), shift) == F.col("_prefix")) & (F.col("_left") > 0))
    part = Window.partitionBy("_source").orderBy("_c", "_rid").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_before", F.coalesce(F.sum("size").over(part), F.lit(0))).withColumn("_part", F.greatest(F.lit(0), F.least("size", F.col("_left") - F.col("_before")))).drop("_before")


def mix_rows(keys: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """keys with source_size, target, taken."""
    thin = materialize(coded(keys), "mix")
    at, shift = mix_plan(thin, weights, cap)
    here = _bits(F.col("_c"), shift)
    rest = thin.join(at, "_source").where(~((here == F.col("_prefix")) & (F.col("_left") > 0))).withColumn("_part", F.when(here < F.col("_prefix"), F.col("size")).otherwise(0))
    both = boundary(thin, at, shift).unionByName(rest)
    return both.withColumn("taken", (F.col("_epochs") * F.col("size") + F.col("_part")).cast("long")).drop("_c", "_rid", "_left", "_prefix", "_epochs", "_part")


def _bits(code: Column, shift: int) -> Column:
    return F.shiftrightunsigned(code, shift) if shift < CODE_BITS else F.lit(0).cast("long")


def mix_keys(docs: DataFrame) -> DataFrame:
    check_columns(docs, "doc_id", "text", "source")
    text = F.col("text")
    return docs.withColumns({"_source": source_key(F.col("source")), "size": word_count(text), "_w": quality_weight(text), "_h": F.xxhash64(F.lit(SEED), "doc_id", "text")})


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = mix_keys(load(spark, sf_dir, "documents")).select("doc_id", "_source", "size", "_w", "_h")
    return mix_rows(keys).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it; the one at a budget's end comes whole or not, whichever is nearer.

    Rows are named by file and place, so that the two scans of a stored table agree. Texts aren't shuffled unless
    the boundary rows outgrow a broadcast.
    """
    check_columns(docs, "doc_id", "text", "source")
    return shielded(docs, ("doc_id", "text", "source"), _mixed)


def _mixed(docs: DataFrame) -> DataFrame:
    cols = docs.columns
    rows = coded(mix_keys(numbered(docs)))
    thin = materialize(rows.select("_source", "size", "_rid", "_c", "_f", "_r"), "mix")
    at, shift = mix_plan(thin)
    edge = materialize(boundary(thin, at, shift).select("_f", "_r", (2 * F.col("_part") >= F.col("size")).cast("long").alias("_edge")), "edge")
    here = _bits(F.col("_c"), shift)
    part = F.coalesce("_edge", F.when(here < F.col("_prefix"), F.lit(1)), F.lit(0))
    taken = rows.join(at, "_source").join(edge, ["_f", "_r"], "left").where("size > 0").withColumn("_times", (F.col("_epochs") + part).cast("int"))
    return taken.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*cols)
