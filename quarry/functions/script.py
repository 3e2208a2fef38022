"""Scripts of the small Java-like language compiled to columns: expressions, ternaries, conditionals and returns."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.\d*|\.\d+|\d+)[LlfFdD]?|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([A-Za-z_]\w*)|(&&|\|\||==|!=|>=|<=|\+=|-=|\*=|/=|[-+*/%<>!?:;.,=(){}\[\]]))")
_MATH1 = {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": lambda c: F.floor(c + 0.5), "sqrt": F.sqrt, "log": F.log, "log10": F.log10, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan}
_MATH2 = {"min": F.least, "max": F.greatest, "pow": F.pow}


def _lit(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


class Script:
    """A recursive-descent compiler; `_score`, doc values, params and local variables are in scope."""

    def __init__(self, source: str, params: dict | None = None, score: Column | None = None, columns: dict[str, Column] | None = None) -> None:
        self.toks: list[tuple[str, str]] = []
        at = 0
        source = re.sub(r"//[^\n]*|/\*.*?\*/", " ", source, flags=re.S).rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise ValueError(f"script: {source[at : at + 20]!r}")
            at = m.end()
            kind = next(k for k in range(1, 6) if m[k] is not None)
            self.toks.append(("nssiO"[kind - 1], m[kind]))
        self.i, self.params, self.score, self.columns = 0, params or {}, score, columns or {}
        self.vars: dict[str, Column] = {}
        self.writes: dict[str, Column] = {}

    def peek(self, v: str | None = None) -> Any:
        t = self.toks[self.i] if self.i < len(self.toks) else ("", "")
        return t if v is None else t == ("O", v) or t == ("i", v)

    def take(self, v: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if v is not None and not self.peek(v):
            raise ValueError(f"script: {v!r} expected at {t[1]!r}")
        self.i += 1
        return t

    def compile(self) -> Column:
        """The value of the first return reached, else of the last expression."""
        out = self._block(lambda: self.i >= len(self.toks))
        if self.i < len(self.toks):
            raise ValueError(f"script: unexpected {self.peek()[1]!r}")
        return _lit(out)

    def _block(self, end) -> Any:
        out: Any = None
        while not end():
            v = self._statement()
            if v is not None:
                out = v
        return out

    def _statement(self) -> Any:
        if self.peek(";"):
            self.take()
            return None
        if self.peek("return"):
            self.take()
            v = self._ternary()
            if self.peek(";"):
                self.take()
            return v
        if self.peek("if"):
            return self._if()
        if self.peek()[0] == "i" and self.peek()[1] in ("def", "int", "long", "double", "float", "String", "boolean") and self.toks[self.i + 1][0] == "i":
            self.take()
        start = self.i
        if self.peek()[0] == "i":
            path = [self.take()[1]]
            while self.peek("."):
                self.take()
                path.append(self.take()[1])
            if self.peek()[1] in ("=", "+=", "-=", "*=", "/=") and self.peek()[0] == "O":
                op = self.take()[1]
                v = self._ternary()
                name = path[0] if len(path) == 1 else ".".join(path[2:] if path[:2] == ["ctx", "_source"] else path)
                store = self.vars if len(path) == 1 else self.writes
                if op != "=":
                    old = store.get(name, self.columns.get(name, F.col(name)))
                    v = self._arith(op[0], old, v)
                store[name] = _lit(v)
                if self.peek(";"):
                    self.take()
                return None
            self.i = start
        v = self._ternary()
        if self.peek(";"):
            self.take()
        return v

    def _body(self) -> Any:
        if self.peek("{"):
            self.take()
            v = self._block(lambda: self.peek("}"))
            self.take("}")
            return v
        return self._statement()

    def _if(self) -> Any:
        self.take("if")
        self.take("(")
        test = _lit(self._ternary())
        self.take(")")
        keep_v, keep_w = dict(self.vars), dict(self.writes)
        yes = self._body()
        yv, yw = self.vars, self.writes
        self.vars, self.writes = dict(keep_v), dict(keep_w)
        no = None
        if self.peek("else"):
            self.take()
            no = self._body()
        for now, then, old in ((self.vars, yv, keep_v), (self.writes, yw, keep_w)):
            for k in set(now) | set(then):
                base = old.get(k, self.columns.get(k, F.lit(None)))
                now[k] = F.when(test, then.get(k, base)).otherwise(now.get(k, base))
        if yes is None and no is None:
            return None
        if no is None:  # a later statement gives the other value
            rest = self._block(lambda: self.i >= len(self.toks) or self.peek("}"))
            return F.when(test, _lit(yes)).otherwise(_lit(rest))
        return F.when(test, _lit(yes)).otherwise(_lit(no))

    def _ternary(self) -> Any:
        c = self._or()
        if not self.peek("?"):
            return c
        self.take()
        a = self._ternary()
        self.take(":")
        return F.when(_lit(c), _lit(a)).otherwise(_lit(self._ternary()))

    def _left(self, sub, ops: dict) -> Any:
        a = sub()
        while self.peek()[0] == "O" and self.peek()[1] in ops:
            op = self.take()[1]
            a = ops[op](a, sub())
        return a

    def _or(self):
        return self._left(self._and, {"||": lambda a, b: _lit(a) | _lit(b)})

    def _and(self):
        return self._left(self._compare, {"&&": lambda a, b: _lit(a) & _lit(b)})

    def _compare(self):
        return self._left(self._sum, {"==": lambda a, b: _lit(a).eqNullSafe(_lit(b)), "!=": lambda a, b: ~_lit(a).eqNullSafe(_lit(b)), ">=": lambda a, b: _lit(a) >= _lit(b), "<=": lambda a, b: _lit(a) <= _lit(b), ">": lambda a, b: _lit(a) > _lit(b), "<": lambda a, b: _lit(a) < _lit(b)})

    def _arith(self, op: str, a: Any, b: Any) -> Any:
        if op == "+" and (isinstance(a, str) or isinstance(b, str)):
            return F.concat(_lit(a).cast("string"), _lit(b).cast("string"))
        a, b = _lit(a), _lit(b)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: a % F.nullif(b, F.lit(0))}[op]()

    def _sum(self):
        return self._left(self._product, {o: lambda a, b, o=o: self._arith(o, a, b) for o in "+-"})

    def _product(self):
        return self._left(self._unary, {o: lambda a, b, o=o: self._arith(o, a, b) for o in "*/%"})

    def _unary(self) -> Any:
        if self.peek("!"):
            self.take()
            return ~_lit(self._unary())
        if self.peek("-"):
            self.take()
            return -_lit(self._unary())
        return self._postfix(self._primary())

    def _primary(self) -> Any:
        kind, v = self.take()
        if kind == "n":
            return float(v) if "." in v else int(v)
        if kind == "s":
            return re.sub(r"\\(.)", r"\1", v)
        if (kind, v) == ("O", "("):
            out = self._ternary()
            self.take(")")
            return out
        if (kind, v) == ("O", "["):
            items = self._arguments("]")
            return F.array(*map(_lit, items))
        if kind != "i":
            raise ValueError(f"script: unexpected {v!r}")
        if v in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[v]
        if v == "_score":
            return self.score if self.score is not None else F.lit(1.0)
        if v in ("doc", "params", "ctx", "Math", "Date", "System"):
            return ("scope", v)
        return self.vars.get(v, self.columns.get(v, F.col(v)))

    def _arguments(self, close: str = ")") -> list:
        out = []
        while not self.peek(close):
            out.append(self._ternary())
            if self.peek(","):
                self.take()
        self.take(close)
        return out

    def _member(self, base: Any, name: Any) -> Any:
        scope = base[1] if isinstance(base, tuple) else None
        if scope == "params":
            return self.params.get(name)
        if scope in ("doc", "ctx._source"):
            return self.writes.get(name, self.columns.get(name, F.col(name)))
        if scope == "ctx" and name == "_source":
            return ("scope", "ctx._source")
        if name in ("value", "values"):
            return base
        if name == "length":
            return F.length(_lit(base))
        if isinstance(base, dict):
            return base.get(name)
        return _lit(base)[name]

    def _postfix(self, base: Any) -> Any:
        while True:
            if self.peek("["):
                self.take()
                key = self._ternary()
                self.take("]")
                base = self._member(base, key) if isinstance(base, (tuple, dict)) else F.get(_lit(base), _lit(key))
            elif self.peek("."):
                self.take()
                name = self.take()[1]
                if self.peek("("):
                    self.take()
                    base = self._call(base, name, self._arguments())
                else:
                    base = self._member(base, name)
            else:
                return base

    def _call(self, base: Any, name: str, args: list) -> Any:
        if isinstance(base, tuple):
            if base[1] == "Math":
                if name == "random":
                    return F.rand()
                return _MATH1[name](_lit(args[0])) if name in _MATH1 else _MATH2[name](*map(_lit, args))
            if name in ("now", "currentTimeMillis"):
                return F.unix_millis(F.current_timestamp())
            raise ValueError(f"script: {base[1]}.{name}")
        c = _lit(base)
        a = [_lit(x) for x in args]
        table = {
            "length": lambda: F.length(c), "contains": lambda: c.contains(a[0]), "startsWith": lambda: c.startswith(a[0]), "endsWith": lambda: c.endswith(a[0]),
            "toLowerCase": lambda: F.lower(c), "toUpperCase": lambda: F.upper(c), "trim": lambda: F.trim(c), "indexOf": lambda: F.locate(args[0], c) - 1,
            "substring": lambda: F.substring(c, a[0] + 1, (a[1] - a[0]) if len(a) > 1 else F.length(c)), "replace": lambda: F.replace(c, a[0], a[1]), "replaceAll": lambda: F.regexp_replace(c, a[0], a[1]),
            "split": lambda: F.split(c, args[0]), "matches": lambda: F.regexp_like(c, F.concat(F.lit("^(?:"), a[0], F.lit(")$"))), "equals": lambda: c.eqNullSafe(a[0]),
            "size": lambda: F.size(c), "isEmpty": lambda: F.size(c) == 0, "get": lambda: F.get(c, a[0]), "add": lambda: F.array_append(c, a[0]), "remove": lambda: F.array_remove(c, args[0]), "addAll": lambda: F.concat(c, a[0]), "removeAll": lambda: F.array_except(c, a[0]),
            "containsKey": lambda: F.map_contains_key(c, args[0]), "getTime": lambda: F.unix_millis(c), "getYear": lambda: F.year(c), "getMonthValue": lambda: F.month(c), "getDayOfMonth": lambda: F.dayofmonth(c), "toEpochMilli": lambda: F.unix_millis(c),
            "plusDays": lambda: c + F.make_dt_interval(a[0]), "minusDays": lambda: c - F.make_dt_interval(a[0]), "plusHours": lambda: c + F.make_dt_interval(F.lit(0), a[0]), "format": lambda: F.date_format(c, args[0]), "toString": lambda: c.cast("string"),
        }
        if name not in table:
            raise ValueError(f"script: no method {name}")
        return table[name]()


def source_of(spec: str | dict) -> tuple[str, dict]:
    return (spec, {}) if isinstance(spec, str) else (spec.get("source", spec.get("inline", "")), spec.get("params", {}))


def expression(spec: str | dict, score: Column | None = None, columns: dict[str, Column] | None = None) -> Column:
    source, params = source_of(spec)
    return Script(source, params, score, columns).compile()
