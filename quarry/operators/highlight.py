"""Highlighted fragments, made for the hits of a page only."""

from __future__ import annotations

import html as htmllib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = {"html": ("<mark>", "</mark>"), "ansi": ("\x1b[43m", "\x1b[0m"), "plain": ("", ""), "simple": ("<mark>", "</mark>")}


def locations(text: str, terms: list[str]) -> list[tuple[int, int, str]]:
    """Where the terms stand, overlaps merged."""
    if not terms:
        return []
    found = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"(?i)(?<!\w)(?:" + "|".join(map(re.escape, sorted(terms, key=len, reverse=True))) + r")(?!\w)", text)]
    out: list[tuple[int, int, str]] = []
    for a, b, t in found:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, t))
    return out


def fragments(text: str, terms: list[str], style: str = "html", size: int = 200, number: int = 1) -> list[str]:
    """The best windows of about size characters by distinct terms, each centred on its first match."""
    found = locations(text, terms)
    if not found:
        return []
    scored = []
    for a, b, _ in found:
        lo = max(0, min(a - max(0, size - (b - a)) // 2, len(text) - size))
        inside = [x for x in found if x[0] >= lo and x[1] <= lo + size]
        scored.append((-len({x[2] for x in inside}), -len(inside), lo, inside))
    out, used = [], []
    open_, close = STYLES[style]
    esc = htmllib.escape if style in ("html", "simple") else str
    for _, _, lo, inside in sorted(scored, key=lambda s: s[:3]):
        if len(out) == number:
            break
        if any(abs(lo - u) < size for u in used):
            continue
        used.append(lo)
        hi, at, parts = min(len(text), lo + size), lo, []
        for a, b, _ in inside:
            parts += [esc(text[at:a]), open_, esc(text[a:b]), close]
            at = b
        out.append(("…" if lo else "") + "".join(parts) + esc(text[at:hi]) + ("…" if hi < len(text) else ""))
    return out


def highlight(c: Column, terms: list[str], style: str = "html", size: int = 200, number: int = 1) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: fragments(t, terms, style, size, number) if t else [])

    return run(c)
