"""Mappings as table definitions and simple JSON queries as WHERE clauses with parameters."""

from __future__ import annotations

from typing import Any

TYPES = {"text": "STRING", "keyword": "STRING", "long": "BIGINT", "integer": "INT", "short": "SMALLINT", "byte": "TINYINT", "double": "DOUBLE", "float": "FLOAT", "number": "DOUBLE", "boolean": "BOOLEAN", "date": "TIMESTAMP", "ip": "STRING", "geo_point": "STRUCT<lon: DOUBLE, lat: DOUBLE>", "geo_shape": "STRING", "vector": "ARRAY<FLOAT>", "join": "STRING", "percolator": "STRING"}


def _type(spec: dict) -> str:
    if spec.get("type") == "nested":
        return f"ARRAY<{_struct(spec.get('properties', {}))}>"
    if "properties" in spec:
        return _struct(spec["properties"])
    return TYPES[spec["type"]]


def _struct(properties: dict) -> str:
    return "STRUCT<" + ", ".join(f"`{k}`: {_type(v)}" for k, v in properties.items()) + ">"


def table_ddl(name: str, properties: dict, using: str = "parquet") -> str:
    """CREATE TABLE for a mapping's properties, the id first."""
    columns = ", ".join(["`_id` STRING", *(f"`{k}` {_type(v)}" for k, v in properties.items())])
    return f"CREATE TABLE `{name}` ({columns}) USING {using}"


def where_clause(body: dict) -> tuple[str, list[Any]]:
    """A query as SQL with ? for its values: term, terms, match, range, exists, prefix, ids and bool of them."""
    ((kind, spec),) = body.items()
    if kind == "match_all":
        return "TRUE", []
    if kind == "bool":
        parts: list[str] = []
        values: list[Any] = []
        for clause, glue in (("must", " AND "), ("filter", " AND "), ("should", " OR "), ("must_not", " OR ")):
            found = [where_clause(x) for x in (spec.get(clause) if isinstance(spec.get(clause), list) else [spec[clause]] if clause in spec else [])]
            if not found or (clause == "should" and ("must" in spec or "filter" in spec)):
                continue
            text = glue.join(t for t, _ in found)
            parts.append(f"NOT ({text})" if clause == "must_not" else f"({text})")
            values += [v for _, vs in found for v in vs]
        return " AND ".join(parts) or "TRUE", values
    if kind == "exists":
        return f"`{spec['field']}` IS NOT NULL", []
    if kind == "ids":
        return f"`_id` IN ({', '.join('?' * len(spec['values']))})", list(spec["values"])
    ((field, v),) = spec.items()
    if kind == "terms":
        return f"`{field}` IN ({', '.join('?' * len(v))})", list(v)
    if kind == "range":
        ops = [(o, v[k]) for k, o in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")) if k in v]
        return " AND ".join(f"`{field}` {o} ?" for o, _ in ops) or "TRUE", [x for _, x in ops]
    value = v.get("value", v.get("query")) if isinstance(v, dict) else v
    if kind == "term":
        return f"`{field}` = ?", [value]
    if kind == "match":
        return f"`{field}` LIKE ?", [f"%{value}%"]
    if kind == "prefix":
        return f"`{field}` LIKE ?", [f"{value}%"]
    raise ValueError(f"no SQL form for {kind!r}")
