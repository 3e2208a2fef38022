"""Text analysis as column expressions: char filters, tokenizers, token filters and analyzers in one registry.

A tokenizer or token filter maps a column to an array<string> column. Everything is built from Spark functions
except stemmers, Unicode normalisation, decompounding and dictionary-free folding of rare letters, which run as
Arrow-batched UDFs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from contextvars import ContextVar
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stemmers
from .stopwords import STOP

CHAR_FILTERS: dict[str, Callable[..., Column]] = {}
TOKENIZERS: dict[str, Callable[..., Column]] = {}
TOKEN_FILTERS: dict[str, Callable[..., Column]] = {}
ANALYZERS: dict[str, Callable[[Column], Column]] = {}
TOKEN_MAPS: dict[str, list[str]] = {}


#: Between the elements of an array: among tokens by position, and as a word of a text that joins the elements.
BREAK, MARK = "\x1e", "\ua7ff\ua7ff\ua7ff"
_gaps = ContextVar("gaps", default=False)


def register(kind: dict, name: str):
    """Decorator that enters a component in a registry."""

    def enter(f):
        kind[name] = f
        return f

    return enter


def _ascii(text: str) -> str:
    special = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "ı": "i"}
    flat = unicodedata.normalize("NFKD", "".join(special.get(c, c) for c in text))
    return "".join(c for c in flat if not unicodedata.combining(c))


def _ascii_udf(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _ascii(x))

    return run(c)


# char filters


@register(CHAR_FILTERS, "html")
def html(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", " ")


@register(CHAR_FILTERS, "asciifolding")
def asciifolding(c: Column) -> Column:
    """Latin-1 letters by translate; only texts with others visit Python."""
    latin = F.translate(c, "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÇçÑñÝýÿ", "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOOooooooUUUUuuuuCcNnYyy")
    return F.when(latin.rlike(r"[^\x00-\x7F]"), _ascii_udf(latin)).otherwise(latin)


@register(CHAR_FILTERS, "regexp")
def regexp_char(c: Column, pattern: str, replace: str = " ") -> Column:
    return F.regexp_replace(c, pattern, replace)


@register(CHAR_FILTERS, "zero_width_spaces")
def zero_width(c: Column) -> Column:
    return F.translate(c, "‌", " ")


# tokenizers


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


@register(TOKENIZERS, "unicode")
def unicode_tokens(c: Column) -> Column:
    """Word segments: letters, digits and connectors, with inner apostrophes and decimal points."""
    return _all(c, r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}]+(?![\p{L}\p{M}])|[.,]\p{N}+)*")


@register(TOKENIZERS, "whitespace")
def whitespace(c: Column) -> Column:
    return _all(c, r"\S+")


@register(TOKENIZERS, "letter")
def letter(c: Column) -> Column:
    return _all(c, r"\p{L}+")


@register(TOKENIZERS, "single")
def single(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.array(c))


@register(TOKENIZERS, "regexp")
def regexp_tokens(c: Column, pattern: str) -> Column:
    return F.filter(_all(c, pattern), lambda t: t != "")


@register(TOKENIZERS, "character")
def character(c: Column, letters: str) -> Column:
    """Runs of the characters of a class, given as the inside of a regular expression's brackets."""
    return _all(c, f"[{letters}]+")


@register(TOKENIZERS, "exception")
def exception(c: Column, exceptions: list[str], rest: str = r"[\p{L}\p{N}_]+") -> Column:
    return _all(c, "|".join([*(f"(?:{e})" for e in exceptions), rest]))


EMAIL, URL, HANDLE, HASHTAG = r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+", r"https?://[^\s<>\"']+", r"@\w{1,15}", r"#\w+"


@register(TOKENIZERS, "web")
def web_tokens(c: Column) -> Column:
    return exception(c, [EMAIL, URL, HANDLE, HASHTAG])


# token filters


@register(TOKEN_FILTERS, "to_lower")
def to_lower(t: Column) -> Column:
    return F.transform(t, F.lower)


@register(TOKEN_FILTERS, "stop_tokens")
def stop(t: Column, words: list[str]) -> Column:
    """Removes words; where positions count, an empty token stays in place of each."""
    listed = F.array(*map(F.lit, words))
    if _gaps.get():
        return F.transform(t, lambda x: F.when(F.array_contains(listed, x), "").otherwise(x))
    return F.filter(t, lambda x: ~F.array_contains(listed, x))


@register(TOKEN_FILTERS, "length")
def length(t: Column, least: int = 0, most: int = 1 << 30) -> Column:
    return F.filter(t, lambda x: F.length(x).between(least, most))


@register(TOKEN_FILTERS, "truncate_token")
def truncate(t: Column, n: int) -> Column:
    return F.transform(t, lambda x: F.substring(x, 1, n))


@register(TOKEN_FILTERS, "unique")
def unique(t: Column) -> Column:
    return F.array_distinct(t)


@register(TOKEN_FILTERS, "reverse")
def reverse(t: Column) -> Column:
    return F.transform(t, F.reverse)


@register(TOKEN_FILTERS, "ngram")
def ngram(t: Column, least: int = 1, most: int = 2) -> Column:
    sub = lambda x, n: F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n)))
    one = lambda x: F.flatten(F.array(*(F.when(F.length(x) >= n, sub(x, n)).otherwise(F.array().cast("array<string>")) for n in range(least, most + 1))))
    return F.flatten(F.transform(t, one))


@register(TOKEN_FILTERS, "edge_ngram")
def edge_ngram(t: Column, least: int = 1, most: int = 8, back: bool = False) -> Column:
    def one(x: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda n: n <= F.length(x))
        return F.transform(sizes, lambda n: F.right(x, n) if back else F.left(x, n))

    return F.flatten(F.transform(t, one))


@register(TOKEN_FILTERS, "shingle")
def shingle(t: Column, least: int = 2, most: int = 2, original: bool = False, separator: str = " ") -> Column:
    n_of = lambda n: F.when(
        F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), separator))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(*([t] if original else []), *(n_of(n) for n in range(least, most + 1)))


@register(TOKEN_FILTERS, "hierarchy")
def hierarchy(t: Column, delimiter: str = "/", levels: int = 10) -> Column:
    def one(x: Column) -> Column:
        parts = F.split(x, "\\Q" + delimiter + "\\E")
        return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(levels))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), delimiter))

    return F.flatten(F.transform(t, one))


@register(TOKEN_FILTERS, "camelCase")
def camel_case(t: Column) -> Column:
    edges = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}])|(?<=[^\p{L}\p{N}])(?=[\p{L}\p{N}])"
    return F.flatten(F.transform(t, lambda x: F.split(x, edges)))


@register(TOKEN_FILTERS, "apostrophe")
def apostrophe(t: Column) -> Column:
    return F.transform(t, lambda x: F.substring_index(F.translate(x, "’", "'"), "'", 1))


@register(TOKEN_FILTERS, "elision")
def elision(t: Column, articles: list[str]) -> Column:
    return F.transform(t, lambda x: F.regexp_replace(x, r"^(?i)(?:" + "|".join(articles) + r")['’]", ""))


@register(TOKEN_FILTERS, "possessive_en")
def possessive(t: Column) -> Column:
    return F.transform(t, lambda x: F.regexp_replace(x, r"['’＇][sS]$", ""))


#: Texts whose tokens a Python worker maps at a time.
MAPPED = 1_000


def by_token(t: Column, of: Callable[[str], list[str]]) -> Column:
    """Puts the tokens that `of` names in each token's place, by an Arrow UDF: each distinct token of a part is mapped once, and no other becomes a Python string."""

    def part(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        made = [of(w) for w in coded.dictionary.to_pylist()]
        of_each = np.array([len(x) for x in made], np.int64)
        firsts = np.cumsum(of_each) - of_each
        at = coded.indices.to_numpy()
        if (of_each == 1).all():
            sizes, places = None, at
        else:
            sizes = of_each[at]
            places = np.repeat(firsts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        ends = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]
        ends = ends if sizes is None else np.r_[0, np.cumsum(sizes)][ends]
        words = pa.array([w for x in made for w in x], coded.dictionary.type).take(pa.array(places))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words, mask=lists.is_null())

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        parts = [part(lists.slice(a, MAPPED)) for a in range(0, len(lists), MAPPED)]
        return pa.concat_arrays(parts) if parts else lists

    return run(t)


@register(TOKEN_FILTERS, "dict_compound")
def dict_compound(t: Column, words: list[str], min_word: int = 5, min_sub: int = 2, max_sub: int = 15, longest: bool = False) -> Column:
    known = set(words)

    def one(w: str) -> list[str]:
        out = [w]
        if len(w) < min_word:
            return out
        for i in range(len(w) - min_sub + 1):
            fits = [w[i : i + n] for n in range(min_sub, min(max_sub, len(w) - i) + 1) if w[i : i + n].lower() in known]
            out += fits[-1:] if longest else fits
        return out

    return by_token(t, one)


@register(TOKEN_FILTERS, "normalize_unicode")
def normalize_unicode(t: Column, form: str = "NFC") -> Column:
    return by_token(t, lambda w: [unicodedata.normalize(form, w)])


@register(TOKEN_FILTERS, "keyword_marker")
def keyword_marker(t: Column, words: list[str], then: Callable[[Column], Column] = lambda t: t) -> Column:
    """Applies a filter to tokens that aren't protected."""
    listed = F.array(*map(F.lit, words))
    changed = then(t)
    return F.zip_with(t, changed, lambda a, b: F.when(F.array_contains(listed, a), a).otherwise(b))


def stem(t: Column, language: str) -> Column:
    one = stemmers.STEMMERS[language]
    return by_token(t, lambda w: [one(w)])


for _name in stemmers.STEMMERS:
    TOKEN_FILTERS[f"stemmer_{_name}"] = lambda t, _l=_name: stem(t, _l)
TOKEN_FILTERS["stemmer_porter"] = lambda t: stem(t, "en")
TOKEN_FILTERS["stemmer_snowball"] = lambda t, language="en": stem(t, language)


# per-language normalisers, as translations of single letters

NORMALISERS = {
    "ar": ("آأإىةًٌٍَُِّْـ", "اااي" + "ه"),
    "fa": ("يىكۀہ", "ییکهه"),
    "ckb": ("يىكة", "ییکە"),
    "de": ("äöü", "aou"),
    "es": ("áéíóúàèìòùäëïöüâêîôû", "aeiouaeiouaeiouaeiou"),
    "hi": ("़‍‌", ""),
    "in": ("‍‌", ""),
}
for _l, (_from, _to) in NORMALISERS.items():
    TOKEN_FILTERS[f"normalize_{_l}"] = lambda t, a=_from, b=_to: F.transform(t, lambda x: F.translate(x, a, b))
ARTICLES = {
    "fr": ["l", "m", "t", "qu", "n", "s", "j", "d", "c", "jusqu", "quoiqu", "lorsqu", "puisqu"],
    "it": ["c", "l", "all", "dall", "dell", "nell", "sull", "coll", "pell", "gl", "agl", "dagl", "degl", "negl", "sugl", "un", "m", "t", "s", "v", "d"],
    "ca": ["d", "l", "m", "n", "s", "t"],
    "ga": ["d", "m", "b"],
}
for _l, _a in ARTICLES.items():
    TOKEN_FILTERS[f"elision_{_l}"] = lambda t, a=_a: elision(t, a)
for _l, _w in STOP.items():
    TOKEN_FILTERS[f"stop_{_l}"] = lambda t, w=_w: stop(t, w)


@register(TOKEN_FILTERS, "cjk_width")
def cjk_width(t: Column) -> Column:
    """Full-width ASCII to half-width."""
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.transform(t, lambda x: F.translate(x, full, "".join(chr(c) for c in range(0x21, 0x7F))))


@register(TOKEN_FILTERS, "cjk_bigram")
def cjk_bigram(t: Column) -> Column:
    """Pairs of neighbouring ideographs, kana or hangul within a token; other tokens stay."""
    cjk = r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+$"
    pairs = lambda x: F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))).otherwise(F.array(x))
    return F.flatten(F.transform(t, lambda x: F.when(x.rlike(cjk), pairs(x)).otherwise(F.array(x))))


# analyzers


@register(ANALYZERS, "standard")
def standard(c: Column) -> Column:
    return stop(unicode_tokens(F.lower(c)), STOP["en"])


@register(ANALYZERS, "simple")
def simple(c: Column) -> Column:
    return letter(F.lower(c))


ANALYZERS["keyword"] = single
ANALYZERS["whitespace"] = whitespace


@register(ANALYZERS, "web")
def web(c: Column) -> Column:
    return stop(web_tokens(F.lower(c)), STOP["en"])


@register(ANALYZERS, "en")
def english(c: Column) -> Column:
    return stem(stop(possessive(unicode_tokens(F.lower(c))), STOP["en"]), "en")


english.python = True


@register(ANALYZERS, "cjk")
def cjk(c: Column) -> Column:
    return stop(cjk_bigram(cjk_width(unicode_tokens(F.lower(c)))), STOP["en"])


def _language(lang: str) -> Callable[[Column], Column]:
    def run(c: Column) -> Column:
        t = unicode_tokens(F.lower(c))
        for name in (f"elision_{lang}", f"normalize_{lang}" if lang in ("ar", "fa", "ckb", "hi") else "", f"stop_{lang}", f"normalize_{lang}" if lang in ("de", "es") else "", f"stemmer_{lang}"):
            if name in TOKEN_FILTERS:
                t = TOKEN_FILTERS[name](t)
        return t

    run.python = f"stemmer_{lang}" in TOKEN_FILTERS
    return run


for _l in ("ar", "bg", "ca", "ckb", "cs", "da", "de", "el", "es", "eu", "fa", "fi", "fr", "ga", "gl", "hi", "hr", "hu", "hy", "id", "it", "nl", "no", "pl", "pt", "ro", "ru", "sv", "tr"):
    ANALYZERS[_l] = _language(_l)


def custom(tokenizer: str | dict, char_filters: list = (), token_filters: list = ()) -> Callable[[Column], Column]:
    """An analyzer composed by name; a component may be {"type": name, **options}."""

    def call(kind: dict, spec: str | dict, c: Column) -> Column:
        if isinstance(spec, str):
            return kind[spec](c)
        return kind[spec["type"]](c, **{k: v for k, v in spec.items() if k != "type"})

    def run(c: Column) -> Column:
        c = reduce(lambda x, s: call(CHAR_FILTERS, s, x), char_filters, c)
        return reduce(lambda x, s: call(TOKEN_FILTERS, s, x), token_filters, call(TOKENIZERS, tokenizer, c))

    named = [s if isinstance(s, str) else s["type"] for s in (*char_filters, *token_filters)]
    run.python = any(n.startswith(("stemmer", "asciifolding", "normalize_unicode", "dict_compound")) for n in named)
    return run


def positional(analyzer: Callable[[Column], Column], c: Column) -> Column:
    """The tokens of c with empty ones where stop words were."""
    token = _gaps.set(True)
    try:
        return analyzer(c)
    finally:
        _gaps.reset(token)


def in_python(analyzer: Callable[[Column], Column]) -> bool:
    """Whether an analyzer holds an Arrow UDF, which can't stand inside a lambda."""
    return getattr(analyzer, "python", False)


def by_element(analyzer: Callable[[Column], Column], texts: Column) -> Column:
    """The tokens of each text of an array, for analyzers that run in Python."""
    line = F.array_join(positional(analyzer, F.array_join(texts, f" {MARK} ")), "\x1f")
    return F.transform(F.split(line, f"\x1f?{MARK}\x1f?"), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, "\x1f")))


def analyze(c: Column, analyzer: str) -> Column:
    return ANALYZERS[analyzer](c)
