"""Aggregation trees planned as grouped DataFrames.

Each bucket level adds grouping columns; metrics of all leaves under one level are computed in a single
aggregation, so a tree costs one shuffle a level and not one search a bucket. Buckets are few (a level's
size), which is what reaches the driver.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import dates, script
from ..plans import query as q

METRICS = ("avg", "sum", "min", "max", "value_count", "cardinality", "stats", "extended_stats", "percentiles")
SINGLE = ("filter", "nested", "missing", "global")
PIPELINES = ("bucket_script", "scripted_metric")


def _value(ctx: q.Context, spec: dict) -> tuple[Column, bool]:
    """The metric's values as a column, and whether it is an array."""
    if "script" in spec:
        return script.expression(spec["script"]).cast("double"), False
    d = ctx.dtype(spec["field"])
    return ctx.col(spec["field"]), isinstance(d, T.ArrayType)


def metric_columns(ctx: q.Context, name: str, kind: str, spec: dict) -> dict[str, Column]:
    """Aggregate columns of a metric, by output part."""
    c, array = _value(ctx, spec)
    if "missing" in spec and not array:
        c = F.coalesce(c, F.lit(spec["missing"]))
    if kind == "cardinality":
        if spec.get("approximate"):
            return {"value": F.approx_count_distinct(c)}
        return {"value": F.size(F.array_distinct(F.flatten(F.collect_set(c)))) if array else F.countDistinct(c)}
    if kind == "value_count":
        return {"value": F.sum(F.size(c)) if array else F.count(c)}
    if array:
        c = F.transform(c, lambda x: x.try_cast("double"))
        add = lambda f: F.aggregate(c, F.lit(0.0), f)
        n, s, ss = F.sum(F.size(c)), F.sum(add(lambda a, x: a + x)), F.sum(add(lambda a, x: a + x * x))
        low, high = F.min(F.array_min(c)), F.max(F.array_max(c))
    else:
        c = c.try_cast("double")
        n, s, ss, low, high = F.count(c), F.sum(c), F.sum(c * c), F.min(c), F.max(c)
    if kind == "percentiles":
        shares = [p / 100 for p in spec.get("percents", [1, 5, 25, 50, 75, 95, 99])]
        return {"values": F.percentile_approx(c, shares, 10_000)}
    if kind in ("stats", "extended_stats"):
        mean = F.try_divide(s, n)
        var = F.greatest(F.lit(0.0), F.try_divide(ss, n) - mean * mean)
        return {"count": n, "min": low, "max": high, "avg": mean, "sum": s, "sum_of_squares": ss, "variance": var, "std_deviation": F.sqrt(var), "upper": mean + 2 * F.sqrt(var), "lower": mean - 2 * F.sqrt(var)}
    return {"value": {"avg": F.try_divide(s, n), "sum": s, "min": low, "max": high}[kind]}


def split(aggs: dict) -> tuple[dict, dict, dict]:
    """(metrics, buckets, pipelines) of one level."""
    out: tuple[dict, dict, dict] = ({}, {}, {})
    for name, spec in (aggs or {}).items():
        kind = next(k for k in spec if k not in ("aggs", "aggregations", "meta"))
        out[0 if kind in METRICS else 2 if kind in PIPELINES else 1][name] = (kind, spec[kind], spec.get("aggs", spec.get("aggregations", {})))
    return out


def keyed(ctx: q.Context, df: DataFrame, kind: str, spec: dict, parse) -> DataFrame:
    """df with _key (and _order) for a bucket aggregation: one row a document and bucket that it falls in."""
    if kind == "terms":
        f = ctx.name(spec["field"])
        if ctx.kind(f) == "text":
            return df.withColumn("_key", F.explode(F.array_distinct(ctx.toks(f))))
        c = ctx.col(f)
        d = df.withColumn("_key", F.explode(F.array_distinct(c))) if isinstance(ctx.dtype(f), T.ArrayType) else df.withColumn("_key", F.coalesce(c, F.lit(spec["missing"])) if "missing" in spec else c)
        return d.where(F.col("_key").isNotNull() & (F.col("_key").cast("string") != ""))
    if kind in ("range", "date_range"):
        c = ctx.col(spec["field"])
        parts = []
        for r in spec["ranges"]:
            lo, hi = r.get("from"), r.get("to")
            name = r.get("key") or (f"{_show(lo)}-{_show(hi)}" if lo is not None and hi is not None else f"{_show(lo)}+" if lo is not None else f"*-{_show(hi)}")
            lit = (lambda v: dates.parse_literal(v, spec.get("format"))) if kind == "date_range" else F.lit
            test = F.lit(True) & c.isNotNull()
            test = test & (c >= lit(lo)) if lo is not None else test
            test = test & (c < lit(hi)) if hi is not None else test
            parts.append(F.when(test, F.lit(name)))
        return df.withColumn("_key", F.explode(F.array_compact(F.array(*parts))))
    if kind in ("filter", "filters"):
        named = {"_": spec} if kind == "filter" else spec["filters"]
        parts = []
        for name, body in named.items():
            x = parse(body)
            x.prepare(ctx)
            parts.append(F.when(x.pred(ctx), F.lit(name)))
        return df.withColumn("_key", F.explode(F.array_compact(F.array(*parts))))
    if kind == "nested":
        return df.withColumn("_e", F.explode(spec["path"])).withColumn("_key", F.lit("_"))
    if kind == "missing":
        return df.where(ctx.col(spec["field"]).isNull()).withColumn("_key", F.lit("_"))
    if kind == "global":
        return df.withColumn("_key", F.lit("_"))
    if kind == "histogram":
        w, off = float(spec["interval"]), float(spec.get("offset", 0))
        return df.withColumn("_key", F.floor((ctx.col(spec["field"]) - off) / w) * w + off).where("_key IS NOT NULL")
    if kind == "date_histogram":
        unit = spec.get("calendar_interval", spec.get("interval", "day"))
        return df.withColumn("_key", F.date_trunc({"1d": "day", "1M": "month", "1y": "year", "1h": "hour", "1w": "week"}.get(unit, unit), ctx.col(spec["field"]))).where("_key IS NOT NULL")
    raise ValueError(f"unsupported aggregation {kind!r}")


def _show(v: Any) -> str:
    return f"{v:.0f}" if isinstance(v, (int, float)) else str(v)


def bucket_frame(ctx: q.Context, df: DataFrame, kind: str, spec: dict, subs: dict, parse, parents: list[str] | None = None) -> DataFrame:
    """One row a bucket: parent keys, key, doc_count and one column a metric part, cut to the level's size."""
    parents = parents or []
    if kind == "composite":
        return composite_frame(ctx, df, spec, subs, parents)
    rows = keyed(ctx, df, kind, spec, parse)
    out = measured(ctx, rows, [*(F.col(p) for p in parents), F.col("_key").alias("key")], subs)
    if kind == "terms":
        ((by, way),) = (spec.get("order") or {"_count": "desc"}).items()
        c = F.col({"_count": "doc_count", "_key": "key"}.get(by, f"`{by}`"))
        order = [c.desc() if str(way).lower() == "desc" else c.asc(), F.col("key").asc()]
        size = int(spec.get("size", 10))
        if parents:
            out = out.withColumn("_rank", F.row_number().over(Window.partitionBy(*parents).orderBy(*order))).where(F.col("_rank") <= size).drop("_rank")
        else:
            out = out.orderBy(*order).limit(size)
    if "min_doc_count" in spec:
        out = out.where(F.col("doc_count") >= int(spec["min_doc_count"]))
    return out


def measured(ctx: q.Context, rows: DataFrame, keys: list[Column], subs: dict) -> DataFrame:
    """One row a bucket: keys, doc_count, a column a metric part, and bucket scripts."""
    metrics, _, pipelines = split(subs)
    columns = {f"{n}.{part}" if part != "value" else n: c for n, (k, s, _) in metrics.items() for part, c in metric_columns(ctx, n, k, s).items()}
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("doc_count"), *(c.alias(n) for n, c in columns.items()))
    for n, (k, s, _) in pipelines.items():
        if k == "bucket_script":
            out = out.withColumn(n, bucket_script(s))
    return out


def bucket_script(spec: dict) -> Column:
    """A script over sibling metrics; gaps are skipped (null) or read as zero."""
    columns = {}
    for var, path in spec["buckets_path"].items():
        c = F.col({"_count": "doc_count"}.get(path, f"`{path}`"))
        columns[var] = F.coalesce(c, F.lit(0.0)) if spec.get("gap_policy") == "insert_zeros" else c
    source, params = script.source_of(spec["script"])
    return script.Script(source, params | columns, None, columns).compile()


def composite_sources(spec: dict) -> list[tuple[str, dict]]:
    return [(n, s["terms"]) for x in spec["sources"] for n, s in x.items()]


def composite_rows(ctx: q.Context, df: DataFrame, spec: dict) -> DataFrame:
    """df with a column _k_... a source."""
    for n, s in composite_sources(spec):
        df = df.withColumn(f"_k_{n}", ctx.col(s["field"]))
        if not s.get("missing_bucket"):
            df = df.where(F.col(f"_k_{n}").isNotNull())
    return df


def composite_frame(ctx: q.Context, df: DataFrame, spec: dict, subs: dict, parents: list[str] | None = None) -> DataFrame:
    """Keys of all sources in the order of their string forms, nulls first, after the given key; a page for each of the parents."""
    sources, parents = composite_sources(spec), parents or []
    out = measured(ctx, composite_rows(ctx, df, spec), [*(F.col(p) for p in parents), *(F.col(f"_k_{n}").alias(n) for n, _ in sources)], subs)
    if "after" in spec:
        later, same = F.lit(False), F.lit(True)
        for n, _ in sources:
            c, a = F.col(n).cast("string"), spec["after"].get(n)
            a = None if a is None else q._text(a)
            later = later | (same & (c.isNotNull() if a is None else F.coalesce(c > a, F.lit(False))))
            same = same & c.eqNullSafe(F.lit(a))
        out = out.where(later)
    order, size = [F.col(n).cast("string").asc_nulls_first() for n, _ in sources], int(spec.get("size", 1000))
    if parents:
        return out.withColumn("_rank", F.row_number().over(Window.partitionBy(*parents).orderBy(*order))).where(F.col("_rank") <= size).drop("_rank")
    return out.orderBy(*order).limit(size)


def top_hits(ctx: q.Context, df: DataFrame, keys: list[str], spec: dict, order: list[Column]) -> DataFrame:
    """The first hits of each bucket."""
    n, a = int(spec.get("size", 3)), int(spec.get("from", 0))
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank").between(a + 1, a + n))


def scripted_metric(df: DataFrame, spec: dict) -> Any:
    """map_script gives a value a document; combine (sum by default, or min, max, count, avg) is partial-aggregated; reduce_script sees it as `state`."""
    value = script.expression(spec["map_script"]).cast("double")
    how = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "avg": F.avg}[spec.get("combine", "sum")]
    state = df.agg(how(value).alias("state"))
    if "reduce_script" in spec:
        state = state.select(script.expression(spec["reduce_script"], columns={"state": F.col("state")}).alias("state"))
    return state.first().state


def run(ctx: q.Context, df: DataFrame, aggs: dict, parse) -> dict:
    """The aggregations part of a response."""
    out: dict[str, Any] = {}
    metrics, buckets, pipelines = split(aggs)
    columns = {(n, part): c for n, (k, s, _) in metrics.items() for part, c in metric_columns(ctx, n, k, s).items()}
    if columns:
        row = df.agg(*(c.alias(f"m{i}") for i, c in enumerate(columns.values()))).first()
        for i, (n, part) in enumerate(columns):
            out.setdefault(n, {})[part] = row[i]
        for n, (k, s, _) in metrics.items():
            if k in ("stats", "extended_stats"):
                out[n]["std_deviation_bounds"] = {p: out[n].pop(p) for p in ("upper", "lower")}
    for n, (kind, spec, subs) in buckets.items():
        out[n] = _bucket_tree(ctx, df, kind, spec, subs, parse).get(()) or _empty(kind)
    for n, (kind, spec, _) in pipelines.items():
        if kind == "scripted_metric":
            out[n] = {"value": scripted_metric(df, spec)}
    return out


def _empty(kind: str) -> dict:
    """A bucket aggregation under a parent without rows in it."""
    if kind in SINGLE:
        return {"doc_count": 0}
    return {"buckets": []} | ({"sum_other_doc_count": 0} if kind == "terms" else {})


def _plain(key: Any) -> Any:
    return tuple(key) if isinstance(key, Row) else key


def _hit_order(ctx: q.Context, spec: dict) -> list[Column]:
    pairs = [(x, "asc") if isinstance(x, str) else next(iter(x.items())) for x in spec.get("sort", [])]
    ways = [(f, w if isinstance(w, str) else w.get("order", "asc")) for f, w in pairs]
    return [F.col(f).desc() if w == "desc" else F.col(f).asc() for f, w in ways] + [F.col(ctx.id_col).asc()]


def _bucket_tree(ctx: q.Context, df: DataFrame, kind: str, spec: dict, subs: dict, parse, parents: tuple[str, ...] = ()) -> dict[tuple, dict]:
    """The response of a bucket aggregation by the keys of its parents (columns of df): one grouping for all of them, and so on below."""
    metrics, nested, pipelines = split(subs)
    names = [n for n, _ in composite_sources(spec)] if kind == "composite" else ["key"]
    frame = bucket_frame(ctx, df, kind, spec, subs, parse, list(parents))
    rows = frame.collect()
    path = lambda r: tuple(_plain(r[p]) for p in parents)
    shown: dict[tuple, list[dict]] = {}
    places: list[tuple[tuple, dict]] = []
    for r in rows:
        d = r.asDict()
        b: dict[str, Any] = {"key": {n: d[n] for n in names} if kind == "composite" else d["key"], "doc_count": d["doc_count"]}
        for n in metrics:
            parts = {c.split(".", 1)[1]: v for c, v in d.items() if c.startswith(f"{n}.")}
            b[n] = parts or {"value": d.get(n)}
        for n in pipelines:
            b[n] = {"value": d.get(n)}
        shown.setdefault(path(r), []).append(b)
        places.append(((*path(r), tuple(d[n] for n in names) if kind == "composite" else d["key"]), b))
    if nested and rows:
        own, below = f"_p{len(parents)}", (*parents, f"_p{len(parents)}")
        if kind == "composite":
            inside = composite_rows(ctx, df, spec).withColumn(own, F.struct(*(F.col(f"_k_{n}").alias(n) for n in names))).drop(*(f"_k_{n}" for n in names))
        else:
            inside = keyed(ctx, df, kind, spec, parse).withColumnRenamed("_key", own)
        kept = frame.select(*parents, (F.struct(*names) if kind == "composite" else F.col("key")).alias(own)).schema
        keys = [tuple(r[p] for p in parents) + (tuple(r[n] for n in names) if kind == "composite" else r["key"],) for r in rows]
        buckets = df.sparkSession.createDataFrame(keys, T.StructType([T.StructField(f"_s{f.name}", f.dataType) for f in kept]))
        same = F.lit(True)
        for p in below:
            same = same & F.col(p).eqNullSafe(F.col(f"_s{p}"))
        inside = inside.join(F.broadcast(buckets), same, "left_semi")
        for n, (k, s, sub) in nested.items():
            if k == "top_hits":
                hits: dict[tuple, list[dict]] = {}
                for h in top_hits(ctx, inside, list(below), s, _hit_order(ctx, s)).orderBy(*below, "_rank").collect():
                    hits.setdefault(tuple(_plain(h[p]) for p in below), []).append({c: v for c, v in h.asDict().items() if not c.startswith("_p") and c != "_rank"})
                for at, b in places:
                    b[n] = {"hits": hits.get(at, [])}
                continue
            children = _bucket_tree(ctx, inside, k, s, sub, parse, below)
            for at, b in places:
                b[n] = children.get(at) or _empty(k)
    if kind in SINGLE:
        return {at: {x: v for x, v in b.items() if x != "key"} for at, (b,) in shown.items()}
    out: dict[tuple, dict] = {at: {"buckets": bs} for at, bs in shown.items()}
    if kind == "composite":
        for at, bs in shown.items():
            out[at]["after_key"] = bs[-1]["key"]
    if kind == "terms":
        for r in keyed(ctx, df, kind, spec, parse).groupBy(*parents).agg(F.count(F.lit(1)).alias("n")).collect():
            o = out.setdefault(path(r), {"buckets": []})
            o["sum_other_doc_count"] = r["n"] - sum(b["doc_count"] for b in o["buckets"])
    return out


def facet(ctx: q.Context, df: DataFrame, field: str, size: int, parse) -> dict:
    """A terms facet with its total, missing and other counts."""
    rows = keyed(ctx, df, "terms", {"field": field}, parse)
    top = bucket_frame(ctx, df, "terms", {"field": field, "size": size}, {}, parse).collect()
    total, missing = rows.count(), df.where(~q.Exists(field).pred(ctx)).count()
    return {"field": field, "total": total, "missing": missing, "other": total - sum(r.doc_count for r in top), "terms": [{"term": r.key, "count": r.doc_count} for r in top]}
