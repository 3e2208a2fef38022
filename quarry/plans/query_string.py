"""The compact query language: `+must -mustnot should field:term "phrase" term~2 /re/ wild* field:>5 term^2`."""

from __future__ import annotations

import re
from typing import Any

from . import query as q

_PART = re.compile(
    r"""\s*(?P<sign>[+-])?
        (?:(?P<field>(?:[^\s:"\\/^~<>=+-]|\\.)(?:[^\s:"\\^~<>=]|\\.)*):)?
        (?P<op>>=|<=|>|<)?
        (?: "(?P<phrase>(?:[^"\\]|\\.)*)" | /(?P<regex>(?:[^/\\]|\\.)*)/ | (?P<word>(?:[^\s"^~\\]|\\.)+) )
        (?:~(?P<fuzzy>\d*))?
        (?:\^(?P<boost>\d+(?:\.\d+)?))?""",
    re.X,
)


def _plain(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def _number(s: str) -> float | None:
    try:
        return float(s)
    except ValueError:
        return None


def _base(m: re.Match) -> q.Query:
    field, boost = _plain(m["field"]) if m["field"] else "_all", float(m["boost"] or 1)
    if m["op"]:
        raw = _plain(m["phrase"] if m["phrase"] is not None else m["word"])
        value: Any = _number(raw) if m["phrase"] is None else raw
        if value is None:
            raise ValueError(f"query string: a number is expected after {m['op']}")
        return q.Range(field, **{{">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[m["op"]]: value}, boost=boost)
    if m["phrase"] is not None:
        return q.Phrase(field, [], boost, _plain(m["phrase"]))
    if m["regex"] is not None:
        return q.Pattern(field, "regexp", m["regex"], boost)
    word = _plain(m["word"])
    if m["fuzzy"] is not None:
        return q.Match(field, word, fuzziness=int(m["fuzzy"] or 1), boost=boost)
    if re.search(r"(?<!\\)[*?]", m["word"]):
        return q.Pattern(field, "wildcard", word, boost)
    number = _number(word)
    if number is not None and field != "_all":
        return NumberOrMatch(field, word, boost=boost)
    return q.Match(field, word, boost=boost)


class NumberOrMatch(q.Match):
    """A number matches as text or as a value, whatever the field holds."""

    def prepare(self, ctx):
        if ctx.kind(self.field) == "number":
            self.inner = q.Term(self.field, float(self.text), self.boost)
        else:
            super().prepare(ctx)


def parse(text: str) -> q.Query:
    must, should, must_not, at = [], [], [], 0
    text = text.rstrip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"query string: can't read {text[at:]!r}")
        at = m.end()
        {"+": must, "-": must_not, None: should}[m["sign"]].append(_base(m))
    if not must and not must_not and len(should) == 1:
        return should[0]
    if not (must or should or must_not):
        return q.MatchNone()
    return q.Bool(must, should, must_not)
