from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import analysis, dates, geo, script, stemmers
from quarry.operators import highlight
from quarry.plans import dsl
from quarry.plans import query as q
from quarry.plans.query_string import parse as qs
from quarry.sources.engine import Engine, VersionConflict

DOCS = [
    ("1", "The quick brown fox", ["a", "b"], 10.0, True, "x/y"),
    ("2", "A lazy dog sleeps", ["b"], 20.0, False, None),
    ("3", "Quick dogs run; the fox naps", [], None, None, "x"),
    ("4", None, None, 5.0, True, ""),
]
MAP = {"title": {"type": "text", "analyzer": "simple"}, "tags": {"type": "keyword"}, "path": {"type": "keyword"}}


@pytest.fixture()
def e(spark):
    made = Engine(spark)
    made.create_index("docs", spark.createDataFrame(DOCS, "_id string, title string, tags array<string>, price double, ok boolean, path string"), MAP)
    return made


def ids(e, body, index="docs"):
    return sorted(r["_id"] for r in e.matches(index, body).select("_id").collect())


@pytest.mark.parametrize(
    "body, want",
    [
        ({"match": {"title": "fox"}}, ["1", "3"]),
        ({"match": {"title": {"query": "quick fox", "operator": "and"}}}, ["1", "3"]),
        ({"match_phrase": {"title": "brown fox"}}, ["1"]),
        ({"match": {"title": "..."}}, []),
        ({"term": {"ok": "true"}}, ["1", "4"]),
        ({"term": {"tags": "b"}}, ["1", "2"]),
        ({"terms": {"tags": ["a", "zzz"]}}, ["1"]),
        ({"exists": {"field": "tags"}}, ["1", "2"]),
        ({"exists": {"field": "price"}}, ["1", "2", "4"]),
        ({"range": {"price": {"gt": 5, "lte": 20}}}, ["1", "2"]),
        ({"bool": {"must_not": [{"range": {"price": {"gte": 10}}}]}}, ["3", "4"]),
        ({"bool": {"should": [{"term": {"tags": "a"}}, {"term": {"ok": False}}], "minimum_should_match": 1}}, ["1", "2"]),
        ({"fuzzy": {"title": {"value": "foz", "fuzziness": 1}}}, ["1", "3"]),
        ({"wildcard": {"title": "D*G"}}, ["2"]),
        ({"ids": {"values": ["2", "9"]}}, ["2"]),
        ({"query_string": {"query": '+title:fox -title:"brown fox"'}}, ["3"]),
        ({"query_string": {"query": "price:>=10"}}, ["1", "2"]),
        ({"match_none": {}}, []),
        ({"prefix": {"path.keyword": "x"}}, ["1", "3"]),
    ],
)
def test_matches(e, body, want):
    assert ids(e, body) == want


def test_strict_phrase_prefix(e):
    dsl.STRICT["strict_es"] = True
    try:
        assert ids(e, {"match_phrase_prefix": {"title": "lazy do"}}) == ["2"]
    finally:
        dsl.STRICT["strict_es"] = False
    assert ids(e, {"match_phrase_prefix": {"title": "lazy do"}}) == []


def test_errors(e):
    with pytest.raises(dsl.DslError):
        dsl.parse({"nonsense": {}})
    with pytest.raises(dsl.DslError):
        dsl.parse({"term": {"a": 1}, "match": {"b": 2}})
    with pytest.raises(ValueError):
        geo.km("5 parsecs")


def test_search_envelope(e):
    r = e.search("docs", {"query": {"match": {"title": "quick fox"}}, "sort": [{"_id": "desc"}], "size": 1, "aggs": {"t": {"terms": {"field": "tags"}, "aggs": {"p": {"avg": {"field": "price"}}}}, "s": {"stats": {"field": "price"}}}, "highlight": {"fields": {"title": {}}}, "_source": ["title"], "script_fields": {"twice": {"script": "doc['price'].value * 2"}}})
    assert r["hits"]["total"] == 2 and [h["_id"] for h in r["hits"]["hits"]] == ["3"]
    assert r["hits"]["hits"][0]["_source"] == {"title": "Quick dogs run; the fox naps"}
    assert "<mark>fox</mark>" in r["hits"]["hits"][0]["highlight"]["title"][0]
    assert r["aggregations"]["t"]["buckets"] == [{"key": "a", "doc_count": 1, "p": {"value": 10.0}}, {"key": "b", "doc_count": 1, "p": {"value": 10.0}}]
    assert r["aggregations"]["s"]["count"] == 1 and r["aggregations"]["s"]["std_deviation"] == 0


def test_sub_buckets_and_top_hits(e):
    r = e.search("docs", {"size": 0, "aggs": {"ok": {"terms": {"field": "ok"}, "aggs": {"tag": {"terms": {"field": "tags"}}, "top": {"top_hits": {"size": 1, "sort": [{"price": "desc"}]}}}}}})
    first = r["aggregations"]["ok"]["buckets"][0]
    assert first["key"] is True and first["doc_count"] == 2
    assert [b["key"] for b in first["tag"]["buckets"]] == ["a", "b"]
    assert first["top"]["hits"][0]["_id"] == "1"


def test_composite_pages_cover_all(e, spark):
    spec = {"size": 1, "sources": [{"ok": {"terms": {"field": "ok", "missing_bucket": True}}}]}
    seen = []
    while True:
        a = e.search("docs", {"size": 0, "aggs": {"c": {"composite": spec}}})["aggregations"]["c"]
        if not a["buckets"]:
            break
        seen += [(b["key"]["ok"], b["doc_count"]) for b in a["buckets"]]
        spec = spec | {"after": a["after_key"]}
    assert seen == [(None, 1), (False, 1), (True, 2)]


def test_post_filter_and_min_score(e):
    r = e.search("docs", {"query": {"match_all": {}}, "post_filter": {"term": {"ok": True}}, "aggs": {"n": {"value_count": {"field": "_id"}}}})
    assert r["hits"]["total"] == 2 and r["aggregations"]["n"]["value"] == 4
    assert e.search("docs", {"query": {"match": {"title": "fox"}}, "min_score": 99})["hits"]["hits"] == []


def test_pages_concatenate(e):
    pages = list(e.scroll("docs", {"query": {"match_all": {}}, "sort": [{"price": "asc"}]}, 1))
    assert [h["_id"] for p in pages for h in p] == ["4", "1", "2", "3"]


def test_documents(e):
    e.update("docs", "1", {"price": 11.0})
    assert e.get("docs", "1")["price"] == 11.0 and e.get("docs", "1")["_version"] == 2
    e.update("docs", "1", script_spec="ctx._source.price += 4")
    assert e.get("docs", "1")["price"] == 15.0
    with pytest.raises(KeyError):
        e.update("docs", "none", {"price": 1.0})
    e.bulk("\n".join(map(json.dumps, [{"index": {"_id": "7"}}, {"title": "new"}, {"delete": {"_id": "2"}}, {"index": {"_id": "7"}}, {"title": "newer"}])), "docs")
    assert e.get("docs", "7")["title"] == "newer" and e.get("docs", "2") is None
    assert e.delete_by_query("docs", {"match": {"title": "fox"}}) == 2
    assert e.count("docs") == 2
    with pytest.raises(VersionConflict):
        e.upsert("docs", e.resolve("docs").df.select("_id").where("_id = '7'"), expect_version=5)


def test_alias_and_snapshot(e, spark):
    e.create_index("more", spark.createDataFrame([("9", "fox again")], "_id string, title string"), MAP)
    e.alias("all", "docs", "more")
    assert ids(e, {"match": {"title": "fox"}}, "all") == ["1", "3", "9"]
    s = e.snapshot("more")
    e.delete("more", ["9"])
    assert e.count("more") == 0
    e.rollback("more", s)
    assert e.count("more") == 1


def test_percolate(e, spark):
    e.register_query("g", "f", {"match": {"title": "fox"}})
    e.register_query("g", "d", {"match": {"title": "dog"}})
    got = e.percolate("g", e.resolve("docs").df, MAP).collect()
    assert sorted((r.id, r.query_id) for r in got) == [("1", "f"), ("2", "d"), ("3", "f")]


def test_explain_adds_up(e):
    x = e.explain("docs", {"match": {"title": "quick fox"}}, "1")
    assert x["matched"] and abs(x["value"] - sum(d["value"] for d in x["details"])) < 1e-9


def test_scripts(spark):
    d = spark.range(1).selectExpr("5.0D AS a", "'Hello World' AS s", "array(3, 1) AS l")
    ev = lambda src, **p: d.select(script.expression({"source": src, "params": p})).first()[0]
    assert ev("doc['a'].value * 2 + params.b", b=1) == 11
    assert ev("def x = doc.a.value; if (x > 4) { x = x + 1 } return x") == 6
    assert ev("doc.s.value.substring(0, 5).toUpperCase()") == "HELLO"
    assert ev("doc.a.value > 3 && !(doc.a.value == 5) ? 'y' : 'n'") == "n"
    assert ev("Math.max(1, Math.pow(2, 3)) % 3") == 2
    assert ev("doc.l.get(0) + doc.l.size()") == 5
    with pytest.raises(ValueError):
        script.expression("doc.a.value ** 2")


def test_analysis(spark):
    t = lambda f, text: spark.range(1).select(f(F.lit(text)).alias("t")).first().t
    assert t(analysis.standard, "The Quick-Brown fox's 3.14") == ["quick", "brown", "fox's", "3.14"]
    assert t(analysis.english, "Ponies' relational hopping") == ["poni", "relat", "hop"]
    assert t(lambda c: analysis.camel_case(analysis.single(c)), "parseHTTPRequest2x") == ["parse", "HTTP", "Request", "2", "x"]
    assert t(lambda c: analysis.edge_ngram(analysis.letter(c), 2, 3, back=True), "abcd") == ["cd", "bcd"]
    assert t(lambda c: analysis.shingle(analysis.whitespace(c), 2, 3, True), "a b c") == ["a", "b", "c", "a b", "b c", "a b c"]
    assert t(analysis.web, "mail me@x.org see https://a.b/c #Tag") == ["mail", "me@x.org", "see", "https://a.b/c", "#tag"]
    assert t(analysis.cjk, "日本語 abc") == ["日本", "本語", "abc"]
    assert t(lambda c: analysis.elision(analysis.whitespace(c), analysis.ARTICLES["fr"]), "l'avion qu'il") == ["avion", "il"]
    assert t(analysis.custom("whitespace", ["html", "asciifolding"], ["to_lower", {"type": "length", "least": 3}]), "<b>Été</b> no ÇA ira") == ["ete", "ira"]
    assert t(lambda c: analysis.dict_compound(analysis.whitespace(c), ["fuss", "ball"], 4), "fussball") == ["fussball", "fuss", "ball"]
    assert t(analysis.simple, None) is None or t(analysis.simple, "") == []
    assert [stemmers.porter(w) for w in "caresses ponies cats feed agreed plastered motoring sky happy relational conditional rational hopefulness electrical adjustment probate rate controll".split()] == "caress poni cat feed agre plaster motor sky happi relat condit ration hope electr adjust probat rate control".split()


def test_dates(spark):
    assert dates.percent_style("%Y-%m-%d") == "yyyy-MM-dd" and dates.layout_style("02/Jan/2006 15:04") == "dd/MMM/yyyy HH:mm"
    row = spark.range(1).select(dates.parse(F.lit("2020-01-02")).alias("a"), dates.parse(F.lit("1577923200"), "unix_sec").alias("b"), dates.parse(F.lit("nonsense")).alias("c")).first()
    assert str(row.a) == "2020-01-02 00:00:00" and row.b == row.a and row.c is None


def test_geo():
    assert geo.geohash_encode(-5.6, 42.6, 5) == "ezs42"
    lon, lat = geo.geohash_decode("ezs42")
    assert abs(lon + 5.6) < 0.05 and abs(lat - 42.6) < 0.05
    square = {"type": "polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]}
    inner = {"type": "envelope", "coordinates": [[1, 2], [2, 1]]}
    assert geo.relate(inner, square, "within") and geo.relate(square, inner, "contains") and not geo.relate(square, inner, "within")
    assert geo.relate({"type": "linestring", "coordinates": [[-1, 2], [5, 2]]}, square, "intersects")
    assert not geo.relate({"type": "point", "coordinates": [9, 9]}, square, "intersects")
    assert geo.point("1,2") == (2.0, 1.0)


def test_highlight():
    assert highlight.fragments("one fox & two", ["fox"]) == ["one <mark>fox</mark> &amp; two"]
    assert highlight.fragments("nothing", ["fox"]) == []


def test_query_string_shapes():
    assert isinstance(qs("a"), q.Match) and isinstance(qs("f:/a.*/"), q.Pattern) and isinstance(qs('f:"a b"'), q.Phrase)
    b = qs("+a -b c^2 d~1")
    assert (len(b.must), len(b.must_not), len(b.should)) == (1, 1, 2) and b.should[0].boost == 2
    assert qs("f:>3").gt == 3.0
    with pytest.raises(ValueError):
        qs("f:>x")


def test_ip(spark):
    e = Engine(spark)
    e.create_index("ips", spark.createDataFrame([("1", "10.0.0.5"), ("2", "10.0.1.5"), ("3", "2001:db8::1"), ("4", None), ("5", "junk")], "_id string, ip string"), {"ip": {"type": "ip"}})
    assert ids(e, {"ip_range": {"ip": "10.0.0.0/24"}}, "ips") == ["1"]
    assert ids(e, {"ip_range": {"ip": "2001:db8::/32"}}, "ips") == ["3"]


def test_three_bucket_levels(spark):
    rows = [(str(i), "ab"[i % 2], "xyz"[i * 7 % 3], i * 5 % 4, float(i)) for i in range(40)] + [("n", None, "x", 1, 1.0)]
    df = spark.createDataFrame(rows, "_id string, a string, b string, c int, v double")
    made = Engine(spark)
    made.create_index("deep", df, {f: {"type": "keyword"} for f in "ab"})
    want = {tuple(r)[:3]: (r.n, r.s) for r in df.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).collect()}
    third = {"terms": {"field": "c"}, "aggs": {"s": {"sum": {"field": "v"}}, "st": {"stats": {"field": "v"}}, "top": {"top_hits": {"size": 1}}}}
    body = {"z": {"terms": {"field": "a"}, "aggs": {"y": {"terms": {"field": "b"}, "aggs": {"x": third}}}}, "m": {"composite": {"sources": [{"a": {"terms": {"field": "a", "missing_bucket": True}}}, {"b": {"terms": {"field": "b"}}}]}, "aggs": {"x": third, "st": {"stats": {"field": "v"}}}}}
    r = made.search("deep", {"size": 0, "aggs": body})["aggregations"]
    leaf = lambda x: (x["doc_count"], x["s"]["value"])
    got = {(a["key"], b["key"], c["key"]): leaf(c) for a in r["z"]["buckets"] for b in a["y"]["buckets"] for c in b["x"]["buckets"]}
    assert got == {k: v for k, v in want.items() if k[0] is not None}
    assert all(b["x"]["sum_other_doc_count"] == 0 for a in r["z"]["buckets"] for b in a["y"]["buckets"])
    flat = [(m, c) for m in r["m"]["buckets"] for c in m["x"]["buckets"]]
    assert {(m["key"]["a"], m["key"]["b"], c["key"]): leaf(c) for m, c in flat} == want
    assert all(c["st"]["sum"] == c["s"]["value"] and len(c["top"]["hits"]) == 1 and c["top"]["hits"][0]["c"] == c["key"] for _, c in flat)
    assert all(m["st"]["count"] == m["doc_count"] for m in r["m"]["buckets"])


FILTERS = "q_term_keyword q_terms q_term_number q_range_number q_range_date q_prefix q_bool q_ids".split()


@pytest.mark.parametrize("name", FILTERS)
def test_filters_reach_the_scan(spark, name):
    from quarry.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan


def hits_of(e, index, query):
    return sorted(r["_id"] for r in e.matches(index, query).collect())


def test_phrases_respect_stop_words_and_elements(spark):
    e = Engine(spark)
    rows = [("1", "the quick fox", ["big dog", "cat nap"]), ("2", "quick the fox", ["dog cat"]), ("3", "quick a fox", None)]
    for analyzer in ("standard", "en"):
        kind = {"type": "text", "analyzer": analyzer}
        e.create_index(analyzer, spark.createDataFrame(rows, "_id string, title string, tags array<string>"), {"title": kind, "tags": kind})
        assert hits_of(e, analyzer, {"match_phrase": {"title": "quick fox"}}) == ["1"]
        assert hits_of(e, analyzer, {"match_phrase": {"title": "quick the fox"}}) == ["2", "3"]
        assert hits_of(e, analyzer, {"match_phrase": {"tags": "dog cat"}}) == ["2"]
        assert hits_of(e, analyzer, {"match": {"tags": "cats" if analyzer == "en" else "cat"}}) == ["1", "2"]
        assert hits_of(e, analyzer, {"bool": {"must_not": [{"match": {"tags": "cat"}}]}}) == ["3"]


def test_stemmed_nested_fields(spark):
    e = Engine(spark)
    rows = [("1", [("running dogs", 1), ("cats", 2)]), ("2", [("dog", 2)]), ("3", [])]
    e.create_index("n", spark.createDataFrame(rows, "_id string, parts array<struct<body:string,n:int>>"), {"parts.body": {"type": "text", "analyzer": "en"}})
    both = {"bool": {"must": [{"match": {"parts.body": "dog"}}, {"term": {"parts.n": 2}}]}}
    assert hits_of(e, "n", {"nested": {"path": "parts", "query": both}}) == ["2"]
    assert hits_of(e, "n", {"nested": {"path": "parts", "query": {"match": {"parts.body": "runs"}}}}) == ["1"]


def test_large_numbers_are_exact(spark):
    e = Engine(spark)
    e.create_index("b", spark.createDataFrame([("1", (1 << 53) + 1), ("2", 1 << 53), ("3", None)], "_id string, k long"))
    assert hits_of(e, "b", {"term": {"k": (1 << 53) + 1}}) == ["1"]
    assert hits_of(e, "b", {"term": {"k": "9007199254740992"}}) == ["2"]
    assert hits_of(e, "b", {"term": {"k": 1.5}}) == hits_of(e, "b", {"term": {"k": "x"}}) == hits_of(e, "b", {"term": {"k": 1 << 70}}) == []
    assert hits_of(e, "b", {"bool": {"must_not": [{"term": {"k": 1 << 53}}]}}) == ["1", "3"]


def test_addresses_beyond_255_match_nothing(spark):
    e = Engine(spark)
    e.create_index("ip", spark.createDataFrame([("1", "10.0.0.300"), ("2", "10.0.1.44"), ("3", None)], "_id string, ip string"), {"ip": {"type": "ip"}})
    assert hits_of(e, "ip", {"ip_range": {"ip": "10.0.1.0/24"}}) == ["2"]
