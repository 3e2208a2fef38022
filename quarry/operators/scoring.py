"""Relevance: corpus statistics, scored searches over token columns, and a postings table with BM25 retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import query as q


def statistics(ctx: q.Context, df: DataFrame, query: q.Query) -> None:
    """Fills the context's document count, document frequencies and average lengths in one pass."""
    terms = sorted(query.scored_terms(ctx))
    fields = sorted({f for f, _ in terms})
    cols = [F.count(F.lit(1)).alias("n")]
    for i, (f, t) in enumerate(terms):
        hit = F.array_contains(ctx.toks(f), t) if ctx.kind(f) == "text" else ctx.col(f) == t
        cols.append(F.count(F.when(hit, 1)).alias(f"d{i}"))
    cols += [F.avg(F.size(ctx.toks(f)) if ctx.kind(f) == "text" else F.lit(1)).alias(f"a{i}") for i, f in enumerate(fields)]
    row = df.agg(*cols).first()
    ctx.n_docs = row.n
    ctx.df_of = {t: row[f"d{i}"] for i, t in enumerate(terms)}
    ctx.avg_len = {f: row[f"a{i}"] for i, f in enumerate(fields)}


def with_tokens(ctx: q.Context, df: DataFrame, query: q.Query) -> DataFrame:
    """df with one token column for each analysed field of the query, so that an analyzer runs once a row."""
    todo, fields, placed = [query], set(), set()
    while todo:
        x = todo.pop()
        todo += x.children()
        f = getattr(x, "field", None)
        if isinstance(x, q.Phrase):
            placed.add(ctx.name(f))
        if isinstance(f, str) and ctx.kind(f) == "text" and f != "_all" and not isinstance(x, (q.Nested, q.Geo)):
            fields.add(ctx.name(f))
    for f in sorted(fields):
        if f not in ctx.tokens and f in ctx.df.columns:
            if f in placed:
                df = df.withColumn(f"_pos_{f}", ctx.slots(f))
                ctx.positions[f] = f"_pos_{f}"
            df = df.withColumn(f"_tok_{f}", ctx.toks(f))
            ctx.tokens[f] = f"_tok_{f}"
    return df


def postings(df: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """(field, term, id, tf, dl, positions) of every term of every document."""
    out = None
    for name, toks in fields.items():
        rows = df.select(F.col(id_col).alias("id"), toks.alias("t")).select("id", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "term"))
        one = rows.groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")).select(F.lit(name).alias("field"), "term", "id", "tf", "dl", "positions")
        out = one if out is None else out.unionByName(one)
    return out


def dictionary(p: DataFrame, field: str, prefix: str = "", low: str | None = None, high: str | None = None) -> DataFrame:
    """Terms of a field with document counts, in order; optionally of a prefix or a range."""
    d = p.where((F.col("field") == field) & F.col("term").startswith(prefix))
    d = d if low is None else d.where(F.col("term") >= low)
    d = d if high is None else d.where(F.col("term") < high)
    return d.groupBy("term").agg(F.count(F.lit(1)).alias("count")).orderBy("term")


def bm25(p: DataFrame, n_docs: int, avg_len: float, field: str, terms: list[str]) -> DataFrame:
    """(id, score) by textbook BM25 from a postings table: only the query's terms are read and shuffled."""
    hits = p.where((F.col("field") == field) & F.col("term").isin(terms))
    d = F.count(F.lit(1)).over(Window.partitionBy("term"))
    idf = F.log(1 + (n_docs - F.col("d") + 0.5) / (F.col("d") + 0.5))
    k = q.K1 * (1 - q.B + q.B * F.col("dl") / avg_len)
    return hits.withColumn("d", d).select("id", (idf * F.col("tf") * (q.K1 + 1) / (F.col("tf") + k)).alias("s")).groupBy("id").agg(F.sum("s").alias("score"))
