"""The JSON query language, parsed to a query tree."""

from __future__ import annotations

import base64
import json
from typing import Any

from ..functions import geo
from . import query as q
from .query_string import parse as parse_query_string

STRICT = {"strict_es": False}


class DslError(ValueError):
    """A query that can't be parsed."""


def _one(body: dict, kind: str) -> tuple[str, Any]:
    named = {k: v for k, v in body.items() if k not in ("boost", "_name")}
    if len(named) != 1:
        raise DslError(f"{kind} takes one field")
    return next(iter(named.items()))


def _list(v: Any) -> list:
    return v if isinstance(v, list) else [] if v is None else [v]


def _boost(body: Any) -> float:
    return float(body.get("boost", 1.0)) if isinstance(body, dict) else 1.0


def _term(b):
    f, v = _one(b, "term")
    return q.Term(f, v.get("value") if isinstance(v, dict) else v, _boost(v))


def _terms(b):
    f, v = _one(b, "terms")
    return q.Terms(f, _list(v), _boost(b))


def _range(b):
    f, v = _one(b, "range")
    v = dict(v)
    if "from" in v and v["from"] is not None:
        v["gte" if v.get("include_lower", True) else "gt"] = v["from"]
    if "to" in v and v["to"] is not None:
        v["lte" if v.get("include_upper", True) else "lt"] = v["to"]
    return q.Range(f, v.get("gt"), v.get("gte"), v.get("lt"), v.get("lte"), _boost(v), v.get("format"))


def _match(b, operator="or", prefix=False):
    f, v = _one(b, "match")
    if not isinstance(v, dict):
        v = {"query": v}
    return q.Match(f, str(v.get("query", "")), v.get("operator", operator).lower(), v.get("fuzziness", 0), _boost(v), prefix)


def _phrase(b, prefix=False):
    f, v = _one(b, "match_phrase")
    v = v if isinstance(v, dict) else {"query": v}
    return q.Phrase(f, [], _boost(v), str(v["query"]), prefix)


def _multi_match(b):
    fields = [f.split("^") for f in _list(b.get("fields")) or ["_all"]]
    return q.Disj([q.Match(f[0], str(b.get("query", "")), b.get("operator", "or").lower(), b.get("fuzziness", 0), float(f[1]) if len(f) > 1 else 1.0) for f in fields], boost=_boost(b), mode="max" if b.get("type") == "best_fields" and STRICT["strict_es"] else "sum")


def _query_string(b):
    text = b if isinstance(b, str) else b["query"]
    field = b.get("default_field") if isinstance(b, dict) else None
    return parse_query_string(f"{field}:{text}" if field else text)


def _pattern(kind):
    def run(b):
        f, v = _one(b, kind)
        v = v if isinstance(v, dict) else {"value": v}
        text = str(v.get("value", v.get(kind, "")))
        if kind == "wildcard" and v.get("case_insensitive", True):
            text = text.lower()
        return q.Pattern(f, kind, text, _boost(v), v.get("fuzziness", 2), int(v.get("prefix_length", 0)))

    return run


def _bool(b):
    clause = lambda k: [parse(x) for x in _list(b.get(k))]
    return q.Bool(clause("must"), clause("should"), clause("must_not"), clause("filter"), b.get("minimum_should_match"), _boost(b))


def _dis_max(b):
    return q.Disj([parse(x) for x in _list(b.get("queries"))], boost=_boost(b), mode="max" if STRICT["strict_es"] or "tie_breaker" in b else "sum", tie=float(b.get("tie_breaker", 0.0)))


def _joined(relation):
    def run(b):
        return q.Joined(relation, b.get("type", b.get("parent_type")), parse(b.get("query", {"match_all": {}})), _boost(b))

    return run


def _box(b):
    f, v = _one({k: x for k, x in b.items() if k not in ("type", "validation_method")}, "geo_bounding_box")
    if "top_left" in v:
        (left, top), (right, bottom) = geo.point(v["top_left"]), geo.point(v["bottom_right"])
    else:
        left, top, right, bottom = (float(v[k]) for k in ("left", "top", "right", "bottom"))
    return q.Geo(f, "box", (left, top, right, bottom), _boost(b))


def _distance(b):
    f, v = _one({k: x for k, x in b.items() if k not in ("distance", "distance_type", "validation_method")}, "geo_distance")
    return q.Geo(f, "distance", (*geo.point(v), geo.km(b["distance"])), _boost(b))


def _polygon(b):
    f, v = _one(b, "geo_polygon")
    points = [geo.point(p) for p in v["points"]]
    if len(points) < 3:
        raise DslError("a polygon has three points at least")
    return q.Geo(f, "polygon", (points,), _boost(b))


def _shape(b):
    f, v = _one(b, "geo_shape")
    return q.Geo(f, "shape", (v["shape"], v.get("relation", "intersects")), _boost(b))


def _function_score(b):
    inner = parse(b.get("query", {"match_all": {}}))
    kinds = ("field_value_factor", "script_score", "random_score", "linear", "exp", "gauss", "weight")
    functions = [dict(f) for f in _list(b.get("functions"))] or [{k: b[k] for k in kinds if k in b}]
    for f in functions:
        if "filter" in f:
            f["filter"] = parse(f["filter"])
    return q.FunctionScore(inner, [f for f in functions if f], b.get("score_mode", "multiply"), b.get("boost_mode", "multiply"), b.get("max_boost"), b.get("min_score"), _boost(b))


def _more_like_this(b):
    like = _list(b.get("like"))
    seed = like[0].get("_source") if like and isinstance(like[0], dict) else like[0] if like else None
    fields = _list(b.get("fields")) or ["_all"]
    return q.Disj([q.Match(f, seed) for f in fields]) if isinstance(seed, str) else q.MatchAll()


def _span_near(b):
    clauses = b["clauses"]
    if STRICT["strict_es"] and b.get("in_order", True) and not b.get("slop") and all("span_term" in c for c in clauses):
        parts = [_one(c["span_term"], "span_term") for c in clauses]
        return q.Phrase(parts[0][0], [[v.get("value") if isinstance(v, dict) else v] for _, v in parts])
    return q.Conj([parse(c) for c in clauses])


PARSERS = {
    "match_all": lambda b: q.MatchAll(_boost(b)),
    "match_none": lambda b: q.MatchNone(),
    "term": _term,
    "terms": _terms,
    "range": _range,
    "match": _match,
    "match_bool_prefix": lambda b: _match(b, prefix=STRICT["strict_es"]),
    "common": _match,
    "match_phrase": _phrase,
    "match_phrase_prefix": lambda b: _phrase(b, STRICT["strict_es"]),
    "multi_match": _multi_match,
    "query_string": _query_string,
    "simple_query_string": _query_string,
    "prefix": _pattern("prefix"),
    "wildcard": _pattern("wildcard"),
    "regexp": _pattern("regexp"),
    "fuzzy": _pattern("fuzzy"),
    "exists": lambda b: q.Exists(b["field"], _boost(b)),
    "ids": lambda b: q.Ids(_list(b.get("values"))) if _list(b.get("values")) else q.MatchNone(),
    "ip_range": lambda b: q.IpRange(*_one(b, "ip_range")),
    "bool": _bool,
    "dis_max": _dis_max,
    "constant_score": lambda b: q.Constant(parse(b["filter"]), _boost(b)),
    "boosting": lambda b: q.Boosting(parse(b["positive"]), parse(b["negative"]), float(b.get("negative_boost", 0.5))),
    "pinned": lambda b: q.Disj([q.Ids(_list(b.get("ids"))), parse(b.get("organic", {"match_all": {}}))]),
    "wrapper": lambda b: parse(json.loads(_b64(b["query"] if isinstance(b, dict) else b))),
    "nested": lambda b: q.Nested(b["path"], parse(b["query"]), b.get("mode", "element"), _boost(b)),
    "has_child": _joined("child"),
    "has_parent": _joined("parent"),
    "geo_bounding_box": _box,
    "geo_distance": _distance,
    "geo_polygon": _polygon,
    "geo_shape": _shape,
    "script": lambda b: q.ScriptFilter(b.get("script", b)),
    "script_score": lambda b: q.ScriptScore(parse(b.get("query", {"match_all": {}})), b["script"], _boost(b), b.get("min_score")),
    "function_score": _function_score,
    "more_like_this": _more_like_this,
    "span_term": _term,
    "span_near": _span_near,
    "span_or": lambda b: q.Disj([parse(c) for c in b["clauses"]]),
    "span_not": lambda b: q.Bool(must=[parse(b["include"])], must_not=[parse(b["exclude"])]),
    "span_first": lambda b: parse(b["match"]),
    "span_multi": lambda b: parse(b["match"]),
    "span_containing": lambda b: q.Conj([parse(b["big"]), parse(b["little"])]),
    "span_within": lambda b: q.Conj([parse(b["big"]), parse(b["little"])]),
}


def _b64(text: str) -> bytes:
    try:
        return base64.b64decode(text, validate=True)
    except ValueError:
        return base64.urlsafe_b64decode(text)


def parse(body: Any) -> q.Query:
    """A JSON query, or a query string, as a tree."""
    if isinstance(body, q.Query):
        return body
    if isinstance(body, str):
        return parse_query_string(body)
    if not body:
        return q.MatchAll()
    if len(body) != 1:
        raise DslError(f"one query type expected, found {sorted(body)}")
    ((kind, spec),) = body.items()
    if kind not in PARSERS:
        raise DslError(f"unknown query type {kind!r}")
    return PARSERS[kind](spec)
