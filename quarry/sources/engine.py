"""The engine: named indexes of documents over DataFrames, with search, document operations and aliases.

An index is a DataFrame with an id column; changes build new lineage (anti-join and union), `compact` writes
it out. A search compiles to one plan: token columns, existence joins, filter, score, top-k.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, script
from ..operators import aggs, highlight, scoring, vectors
from ..plans import dsl
from ..plans import query as q


@dataclass
class Index:
    df: DataFrame
    mapping: dict[str, dict] = field(default_factory=dict)
    id_col: str = "_id"
    scoring: str = "tfidf"
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    open: bool = True
    settings: dict = field(default_factory=dict)
    snapshots: list[DataFrame] = field(default_factory=list)


class VersionConflict(RuntimeError):
    """A document isn't at the version that a write expects."""


class Engine:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.indexes: dict[str, Index] = {}
        self.aliases: dict[str, set[str]] = {}
        self.percolators: dict[str, dict[str, Any]] = {}

    # indexes

    def create_index(self, name: str, df: DataFrame, mapping: dict | None = None, id_col: str = "_id", scoring_model: str = "tfidf", synonyms: dict | None = None) -> Index:
        if name in self.indexes:
            raise ValueError(f"index {name!r} exists")
        mapping = {k: v for k, v in (mapping or {}).items()}
        for target in {t for v in mapping.values() for t in _list(v.get("copy_to"))}:
            df = df.withColumn(target, F.concat_ws(" ", *(F.col(k).cast("string") for k, v in mapping.items() if target in _list(v.get("copy_to")))))
        self.indexes[name] = Index(df, mapping, id_col, scoring_model, synonyms or {})
        return self.indexes[name]

    def open_index(self, name: str, path: str, fmt: str = "parquet", **options: Any) -> Index:
        """An index over stored files of any format that the session reads."""
        reader = self.spark.read.format(fmt)
        return self.create_index(name, reader.load(path), **options)

    def drop_index(self, name: str) -> None:
        del self.indexes[name]
        for members in self.aliases.values():
            members.discard(name)

    def mapping(self, name: str) -> dict:
        i = self.indexes[name]
        ctx = q.Context(i.df, i.mapping)
        return {c: {"type": ctx.kind(c)} | i.mapping.get(c, {}) for c in i.df.columns}

    def put_mapping(self, name: str, changes: dict) -> None:
        """Adds fields; a field's type never changes."""
        i = self.indexes[name]
        for f, spec in changes.items():
            if f in i.mapping and i.mapping[f].get("type") != spec.get("type"):
                raise ValueError(f"type of {f!r} can't change")
            i.mapping[f] = spec

    def compact(self, name: str, path: str) -> None:
        """Writes the index out and reads it back: lineage ends, files merge."""
        i = self.indexes[name]
        i.df.write.mode("errorifexists").parquet(path)
        i.df = self.spark.read.parquet(path)

    def snapshot(self, name: str) -> int:
        self.indexes[name].snapshots.append(self.indexes[name].df)
        return len(self.indexes[name].snapshots) - 1

    def rollback(self, name: str, snapshot: int) -> None:
        self.indexes[name].df = self.indexes[name].snapshots[snapshot]

    def alias(self, alias: str, *names: str) -> None:
        self.aliases.setdefault(alias, set()).update(names)

    def unalias(self, alias: str, *names: str) -> None:
        self.aliases[alias] -= set(names)
        if not self.aliases[alias]:
            del self.aliases[alias]

    def swap_alias(self, alias: str, out: set[str], into: set[str]) -> None:
        self.aliases[alias] = (self.aliases.get(alias, set()) - out) | into

    def resolve(self, name: str) -> Index:
        """The index of a name, or the union of those of an alias, a list or _all; missing columns are null."""
        if name in self.indexes:
            if not self.indexes[name].open:
                raise ValueError(f"index {name!r} is closed")
            return self.indexes[name]
        names = sorted(self.indexes) if name == "_all" else sorted(self.aliases.get(name, set())) or name.split(",")
        parts = [self.indexes[n] for n in names]
        df = None
        for n, i in zip(names, parts):
            d = i.df.withColumn("_index", F.lit(n)).withColumn("_id", F.col(i.id_col).cast("string"))
            df = d if df is None else df.unionByName(d, allowMissingColumns=True)
        merged: dict = {}
        for i in parts:
            merged |= i.mapping
        return Index(df, merged, "_id", parts[0].scoring, parts[0].synonyms)

    def set_open(self, name: str, is_open: bool) -> None:
        self.indexes[name].open = is_open

    def cat_indices(self) -> DataFrame:
        return self.spark.createDataFrame([(n, i.open, len(i.df.columns)) for n, i in self.indexes.items()], "index string, open boolean, fields int")

    def health(self) -> dict:
        return {"status": "green", "indices": len(self.indexes), "aliases": len(self.aliases)}

    # search

    def context(self, index: Index) -> q.Context:
        return q.Context(index.df, index.mapping, index.synonyms, {k: v.df for k, v in self.indexes.items()}, index.id_col, index.scoring)

    def matches(self, name: str, query: Any) -> DataFrame:
        """The documents that match: a plain filtered DataFrame."""
        return self._matches(self.resolve(name), dsl.parse(query))[0]

    def _matches(self, index: Index, query: q.Query, keep_tokens: bool = False) -> tuple[DataFrame, q.Context]:
        ctx = self.context(index)
        query.prepare(ctx)
        df = scoring.with_tokens(ctx, index.df, query)
        for ids, key, marker in ctx.joins:
            df = df.join(ids.withColumnRenamed("_key", f"{marker}_key"), F.col(key) == F.col(f"{marker}_key"), "left").drop(f"{marker}_key")
        df = df.where(query.pred(ctx))
        return (df if keep_tokens else df.select(*index.df.columns)), ctx

    def scored(self, name: str, query: Any) -> DataFrame:
        """The documents that match, with _score."""
        index, tree = self.resolve(name), dsl.parse(query)
        df, ctx = self._matches(index, tree, keep_tokens=True)
        if tree.scored_terms(ctx):
            scoring.statistics(ctx, index.df.select("*", *(q.Context.toks(q.Context(index.df, index.mapping), f).alias(t) for f, t in ctx.tokens.items())), tree)
        return df.withColumn("_score", tree.score(ctx, None).cast("double")).select(*index.df.columns, "_score")

    def count(self, name: str, query: Any = None) -> int:
        return self.matches(name, query).count()

    def order_columns(self, index: Index, sort: list) -> list[tuple[str, Column, bool, bool]]:
        """(name, key, descending, nulls first) of each sort, ending with the id."""
        out = []
        for s in [*(_list(sort) or ["-_score"]), None]:
            if s is None:
                out.append((index.id_col, F.col(index.id_col), False, False))
                continue
            desc, first, mode, key = False, False, "first", None
            if isinstance(s, str):
                desc, name = s[0] == "-" or (s == "_score"), s.lstrip("+-")
            elif "by" in s:
                name, desc, first, mode = s.get("field", s["by"] if s["by"] in ("_score", "id") else ""), s.get("desc", False), s.get("missing") == "first", s.get("mode", "first")
                name = {"id": index.id_col, "score": "_score"}.get(name or s["by"], name or s["by"])
            else:
                ((name, spec),) = s.items()
                spec = {"order": spec} if isinstance(spec, str) else spec
                desc = spec.get("order", "desc" if name == "_score" else "asc") == "desc"
                first, mode = spec.get("missing") == "_first", spec.get("mode", "first")
                if name == "_script":
                    key = script.expression(spec["script"], F.col("_score"))
                    key = key.cast("double") if spec.get("type") == "number" else key.cast("string")
                if name == "_geo_distance":
                    f, at = next((k, v) for k, v in spec.items() if k not in ("order", "unit", "mode", "missing", "distance_type"))
                    key = geo.haversine(F.col(f)["lon"], F.col(f)["lat"], *geo.point(at)) / geo.UNITS[spec.get("unit", "km")]
            name = index.id_col if name == "_id" else name
            if key is None:
                key = F.col(name)
                if name in index.df.columns and isinstance(index.df.schema[name].dataType, T.ArrayType):
                    key = {"first": F.get(key, F.lit(0)), "min": F.array_min(key), "max": F.array_max(key)}[mode]
            out.append((name, key, desc, first))
        return out

    def page(self, index: Index, df: DataFrame, sort: list, size: int, start: int = 0, after: list | None = None, before: list | None = None) -> DataFrame:
        """One page in order; keyset pages by the sort values after or before which they stand."""
        keys = self.order_columns(index, sort)
        if after is not None or before is not None:
            df = df.where(self._keyset(keys, after if after is not None else before, before is not None))
        flip = before is not None
        how = [k.desc_nulls_first() if (d != flip) and (f != flip) else k.desc_nulls_last() if d != flip else k.asc_nulls_first() if f != flip else k.asc_nulls_last() for _, k, d, f in keys]
        out = df.orderBy(*how).offset(start).limit(size) if start else df.orderBy(*how).limit(size)
        return self.page(index, out, sort, size) if flip else out

    @staticmethod
    def _keyset(keys: list, values: list, before: bool) -> Column:
        later, same = F.lit(False), F.lit(True)
        for (_, k, desc, first), v in zip(keys, values):
            if v is None:
                beyond = k.isNotNull() if first != before else F.lit(False)
            else:
                beyond = (k < v) if desc != before else (k > v)
                beyond = F.coalesce(beyond, F.lit(first == before))
            later = later | (same & beyond)
            same = same & k.eqNullSafe(F.lit(v))
        return later

    def search(self, name: str, body: dict | None = None) -> dict:
        """A request of the JSON language, answered as a dictionary; only the page and the buckets reach the driver."""
        body, began = body or {}, time.time()
        index = self.resolve(name)
        knn = _list(body.get("knn"))
        found = self.scored(name, body.get("query")) if "query" in body or not knn else None
        if knn:
            found = self._with_vectors(index, found, knn, body)
        columns = index.df.columns
        out: dict[str, Any] = {}
        specs = body.get("aggs", body.get("aggregations", {}))
        if specs:
            out["aggregations"] = aggs.run(self.context(index), found, specs, dsl.parse)
        if "facets" in body:
            out["facets"] = {n: aggs.facet(self.context(index), found, f["field"], int(f.get("size", 10)), dsl.parse) for n, f in body["facets"].items()}
        top = found.agg(F.count(F.lit(1)).alias("n"), F.max("_score").alias("m")).first()
        hits = found
        if body.get("post_filter"):
            tree = dsl.parse(body["post_filter"])
            ctx = self.context(index)
            tree.prepare(ctx)
            hits = hits.where(tree.pred(ctx))
            top = hits.agg(F.count(F.lit(1)).alias("n"), F.max("_score").alias("m")).first()
        if "min_score" in body:
            hits = hits.where(F.col("_score") >= float(body["min_score"]))
        size = int(body.get("size", 10))
        page = self.page(index, hits, body.get("sort", []), size, int(body.get("from", 0)), body.get("search_after"), body.get("search_before"))
        for f, spec in (body.get("script_fields") or {}).items():
            page = page.withColumn(f"_field_{f}", script.expression(spec["script"], F.col("_score")))
        if "highlight" in body:
            page = self._highlighted(index, page, body)
        rows = page.collect() if size else []
        out |= {"took": int((time.time() - began) * 1000), "hits": {"total": top.n, "max_score": top.m, "hits": [self._hit(index, r, columns, body) for r in rows]}}
        return out

    def _with_vectors(self, index: Index, text: DataFrame | None, specs: list, body: dict) -> DataFrame:
        lists = []
        for s in specs:
            where = None
            if "filter" in s:
                tree = dsl.parse(s["filter"])
                ctx = self.context(index)
                tree.prepare(ctx)
                where = tree.pred(ctx)
            lists.append(vectors.knn(index.df, s["field"], s["vector"] if "vector" in s else s["query_vector"], int(s.get("k", 10)), s.get("similarity", "cosine"), float(s.get("boost", 1)), where, index.id_col))
        near = vectors.multi_knn(lists, body.get("knn_operator", "or"))
        if text is None:
            joined = near
        else:
            words = text.select(F.col(index.id_col).alias("id"), F.col("_score").alias("score"))
            how = body.get("score_fusion")
            window = int(body.get("rank_window", 100))
            joined = vectors.rrf([words, near], k=int(body.get("rank_constant", 60)), window=window) if how == "rrf" else vectors.rsf([words, near], window=window) if how == "rsf" else vectors.hybrid(words, near)
        return index.df.join(joined.select(F.col("id").alias(index.id_col), F.col("score").alias("_score")), index.id_col)

    def _highlighted(self, index: Index, page: DataFrame, body: dict) -> DataFrame:
        spec, tree, ctx = body["highlight"], dsl.parse(body.get("query")), self.context(index)
        tree.prepare(ctx)
        terms = sorted(tree.scored_terms(ctx))
        for f in spec["fields"]:
            page = page.withColumn(f"_high_{f}", highlight.highlight(F.col(f), [t for g, t in terms if g in (f, "_all")], spec.get("style", "html"), int(spec.get("fragment_size", 200)), int(spec.get("number_of_fragments", 1))))
        return page

    @staticmethod
    def _hit(index: Index, row: Row, columns: list[str], body: dict) -> dict:
        d = row.asDict(recursive=True)
        source, want = {c: d[c] for c in columns}, body.get("_source", True)
        if want is False:
            source = {}
        elif want is not True:
            inc = _list(want.get("includes", want.get("include"))) if isinstance(want, dict) else _list(want)
            exc = _list(want.get("excludes", want.get("exclude"))) if isinstance(want, dict) else []
            source = {c: v for c, v in source.items() if (not inc or c in inc) and c not in exc}
        hit = {"_id": d[index.id_col], "_score": d["_score"], "_source": source}
        fields = {k[7:]: v for k, v in d.items() if k.startswith("_field_")}
        high = {k[6:]: v for k, v in d.items() if k.startswith("_high_")}
        return hit | ({"fields": fields} if fields else {}) | ({"highlight": high} if high else {})

    def msearch(self, requests: list[tuple[str, dict]]) -> list[dict]:
        return [self.search(n, b) for n, b in requests]

    def scroll(self, name: str, body: dict, size: int = 1000) -> Iterator[list[dict]]:
        """Pages of all hits in the order of a sort (the id by default), by keyset."""
        index = self.resolve(name)
        found, sort, after = self.scored(name, body.get("query")), body.get("sort") or [{index.id_col: "asc"}], None
        names = [n for n, *_ in self.order_columns(index, sort)]
        while rows := self.page(index, found, sort, size, after=after).collect():
            yield [self._hit(index, r, index.df.columns, body) for r in rows]
            after = [rows[-1][n] for n in names]

    def explain(self, name: str, query: Any, doc_id: Any) -> dict:
        """The score of one document by the leaves that make it."""
        index, tree = self.resolve(name), dsl.parse(query)
        df, ctx = self._matches(index, tree, keep_tokens=True)
        scoring.statistics(ctx, index.df.select("*", *(q.Context.toks(q.Context(index.df, index.mapping), f).alias(t) for f, t in ctx.tokens.items())), tree)
        norm = q._norm(tree, ctx)
        leaves: list[q.Query] = []
        todo = [tree]
        while todo:
            x = todo.pop()
            leaves += [] if x.children() else [x]
            todo += x.children()
        one = df.where(F.col(index.id_col) == doc_id).select(tree.score(ctx, None).alias("v"), *(x.gated(ctx, norm).alias(f"l{i}") for i, x in enumerate(leaves))).first()
        if one is None:
            return {"matched": False}
        return {"matched": True, "value": one.v, "details": [{"description": repr(x), "value": one[f"l{i}"]} for i, x in enumerate(leaves)]}

    # documents

    def _versioned(self, index: Index) -> DataFrame:
        df = index.df
        return df if "_version" in df.columns else df.withColumn("_version", F.lit(1).cast("long"))

    def upsert(self, name: str, rows: DataFrame, expect_version: int | None = None) -> None:
        """Replaces rows by id; of several rows for an id, one with the greatest _seq (if any) stays."""
        index = self.indexes[name]
        old = self._versioned(index)
        if expect_version is not None:
            bad = old.join(rows.select(index.id_col), index.id_col).where(F.col("_version") != expect_version).limit(1).count()
            if bad:
                raise VersionConflict(name)
        if "_seq" in rows.columns:
            rows = rows.groupBy(index.id_col).agg(F.max_by(F.struct(*rows.columns), "_seq").alias("r")).select("r.*").drop("_seq")
        versions = old.select(index.id_col, F.col("_version").alias("_old"))
        new = rows.drop("_version").join(versions, index.id_col, "left").withColumn("_version", F.coalesce(F.col("_old") + 1, F.lit(1))).drop("_old")
        index.df = old.join(rows.select(index.id_col), index.id_col, "left_anti").unionByName(new, allowMissingColumns=True)

    def delete(self, name: str, ids: list) -> None:
        index = self.indexes[name]
        index.df = index.df.where(~q._safe(F.col(index.id_col).isin(ids)))

    def delete_by_query(self, name: str, query: Any) -> int:
        index = self.indexes[name]
        gone = self.matches(name, query)
        n = gone.count()
        index.df = index.df.join(gone.select(index.id_col), index.id_col, "left_anti").select(*index.df.columns)
        return n

    def update(self, name: str, doc_id: Any, doc: dict | None = None, script_spec: Any = None, upsert: dict | None = None) -> None:
        """Merges fields into one document, or runs a script that assigns ctx._source fields."""
        index = self.indexes[name]
        me = F.col(index.id_col) == doc_id
        if not index.df.where(me).limit(1).count():
            if upsert is None:
                raise KeyError(doc_id)
            kind = T.StructType([f for f in index.df.schema.fields if f.name in upsert or f.name == index.id_col])
            self.upsert(name, self.spark.createDataFrame([{**upsert, index.id_col: doc_id}], kind))
            return
        changes = {k: F.lit(v) for k, v in (doc or {}).items()}
        if script_spec:
            s = script.Script(*script.source_of(script_spec))
            s.compile()
            changes |= s.writes
        df = self._versioned(index)
        changes["_version"] = F.col("_version") + 1
        index.df = df.withColumns({k: F.when(me, v).otherwise(F.col(k)) if k in df.columns else F.when(me, v) for k, v in changes.items()})

    def get(self, name: str, doc_id: Any) -> dict | None:
        index = self.resolve(name)
        row = index.df.where(F.col(index.id_col) == doc_id).first()
        return row.asDict(recursive=True) if row else None

    def mget(self, name: str, ids: list) -> DataFrame:
        index = self.resolve(name)
        return index.df.where(F.col(index.id_col).isin(ids))

    def bulk(self, lines: str, default: str | None = None) -> int:
        """NDJSON operations; the last operation on an id wins."""
        ops: dict[tuple[str, str], tuple[str, dict | None]] = {}
        it = iter(x for x in lines.splitlines() if x.strip())
        for line in it:
            ((op, meta),) = json.loads(line).items()
            ops[meta.get("_index", default), meta["_id"]] = (op, None if op == "delete" else json.loads(next(it)))
        for name in {n for n, _ in ops}:
            index = self.indexes[name]
            own = {i: x for (n, i), x in ops.items() if n == name}
            self.delete(name, [i for i, (op, _) in own.items() if op == "delete"])
            for i, (op, doc) in own.items():
                if op == "update":
                    self.update(name, i, (doc or {}).get("doc"), (doc or {}).get("script"), (doc or {}).get("upsert", (doc or {}).get("doc") if (doc or {}).get("doc_as_upsert") else None))
            rows = [{**doc, index.id_col: i} for i, (op, doc) in own.items() if op in ("index", "create") and doc is not None]
            if rows:
                fields = [f for f in index.df.schema.fields if any(f.name in r for r in rows)]
                self.upsert(name, self.spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], T.StructType(fields)))
        return len(ops)

    # percolation

    def register_query(self, group: str, query_id: str, query: Any) -> None:
        self.percolators.setdefault(group, {})[query_id] = query

    def percolate(self, group: str, docs: DataFrame, mapping: dict | None = None, id_col: str = "_id") -> DataFrame:
        """(id, query_id): the stored queries that each document matches, in one scan of the documents."""
        index = Index(docs, mapping or {}, id_col)
        ctx, df, parts = self.context(index), docs, []
        trees = {k: dsl.parse(v) for k, v in self.percolators.get(group, {}).items()}
        for tree in trees.values():
            tree.prepare(ctx)
            df = scoring.with_tokens(ctx, df, tree)
        for k, tree in trees.items():
            parts.append(F.when(tree.pred(ctx), F.lit(k)))
        hits = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
        return df.select(F.col(id_col).alias("id"), F.explode(hits).alias("query_id"))


def _list(v: Any) -> list:
    return list(v) if isinstance(v, (list, tuple)) else [] if v is None else [v]
