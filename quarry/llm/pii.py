"""Personal data by weak supervision.

Regular expressions find the base spans (email, ip, card, phone: these always stay) and looser candidates.
Four labelers look at every candidate: the kind's pattern, gazetteers of words near it (for and against), the shape of its
context, and validity of its value (checksums, ranges, entropy); each says yes, no or abstains. Votes are counted over all
documents, expectation-maximisation on the counts estimates how reliable each labeler is, and a logistic
classifier trained on the posteriors decides, by the votes and by the span's length, digits and cases, which candidates
become spans. Patterns per kind are few (VOTES times LOOKS at most), so the driver sees a table of bounded size whatever
the corpus.

Kinds, in output order: email, ip, card, phone, then secret (keys and passwords), mailto (obfuscated addresses), ipv6, iban,
ssn, tel and pan (telephone and card numbers that the base patterns miss). Offsets are code points, ends exclusive.

Defined cases: a null text counts as empty and has no spans; a match that fails its check is dropped without
a retry; added spans that overlap a base span or an earlier added one are dropped; very long runs of digits
or letters take linear time; repeated rows are all reported; an empty table gives an empty result; extra
columns are ignored (query) or kept (`redact`). n_spans counts the entries of spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, check_columns, load, materialize, slices

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "mailto", "ipv6", "iban", "ssn", "tel", "pan")
KINDS = BASE + ADDED

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT, _ALPHA = re.compile("[0-9]"), re.compile("[A-Za-z]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Added kinds: a trigger that a text must hold before the pattern is tried, and the pattern (group 1 is the span).
_MORE = {
    "secret": ((), re.compile(r"(?i)\b(?:token|secret|api[_-]?key|passw(?:or)?d|access[_-]?key|auth)\b\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/=-]{12,}+)|(?<![A-Za-z0-9+/_-])([A-Za-z+/_-]*+[0-9][A-Za-z0-9+/_-]*+={0,2})")),
    "mailto": (("at", "AT"), re.compile(r"(?i)(?<![A-Za-z0-9._%+-])([a-z0-9._%+-]{2,64}\s{0,2}[\[({]\s?at\s?[\])}]\s{0,2}[a-z0-9-]{2,64}(?:\s{0,2}(?:[\[({]\s?dot\s?[\])}]|\.)\s{0,2}[a-z0-9-]{2,64}){1,4})")),
    "ipv6": (("::", ":"), re.compile(r"(?<![0-9A-Za-z:])((?:[0-9A-Fa-f]{1,4}:){2,7}(?::|[0-9A-Fa-f]{1,4}|(?::[0-9A-Fa-f]{1,4}){1,6}))(?![0-9A-Za-z:])")),
    "iban": ((), re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    "ssn": (("-",), re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")),
    "tel": ((), re.compile(r"(?<![0-9(.-])((?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4})(?![0-9-])")),
    "pan": ((), re.compile(r"(?<![0-9])([0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4})(?![0-9])")),
}
_CUES = {
    "secret": "token secret key password passwd auth credential bearer",
    "mailto": "mail email e-mail contact write reach correo",
    "ipv6": "ip ipv6 address host server",
    "iban": "iban bank account konto compte cuenta",
    "ssn": "ssn social security number",
    "tel": "call phone tel telephone mobile fax contact appelez telefon",
    "pan": "card visa mastercard amex credit payment karte carte tarjeta",
}
_CUE_RE = {k: re.compile(r"(?i)\b(?:" + "|".join(map(re.escape, v.split())) + r")\b") for k, v in _CUES.items()}
#: Words before a run of letters and digits that say it is public.
_PUBLIC = re.compile(r"(?i)(?:https?:|www\.|\b(?:sha-?\d*|md5|commit|revision|version|uuid|isbn|doi|id|page|chapter)\b)[^\n]{0,12}$")
_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9-]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|[0-9a-f]{16,}|[0-9A-F]{16,}")
_ORDINARY = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9][0-9/_-]*[A-Za-z]{0,2}|[A-Za-z]+[0-9]{1,4}|(?:[A-Za-z]+[-_/])+[A-Za-z0-9]*")
LABELERS = 4
NEAR = 40
#: Shortest run without a cue that may be a secret.
LONG = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, found from each @ in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        last = max(last, at + 1)
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", last)
    return out


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in map(s.count, set(s)))


def _valid(kind: str, s: str) -> int:
    """The value's own check: 1 passes, -1 fails, 0 has nothing to say."""
    if kind == "secret":
        words = sum(len(w) > 2 and w.isalpha() and w.islower() for w in re.split("[-_/]", s[:200]))
        return -1 if _ORDINARY.fullmatch(s) or words > 1 or _entropy(s) < 3.0 else 1 if len(re.findall(r"[0-9]", s)) > 2 else 0
    if kind == "iban":
        s = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    if kind == "tel":
        d = _digits(s)
        return -1 if d[0] in "01" or len(set(d)) < 3 else 1
    if kind == "pan":
        return 1 if luhn(_digits(s)) and s[0] in "23456" else -1
    if kind == "ipv6":
        return 1 if s.count("::") <= 1 and (s.count(":") == 7 or "::" in s) and len(s) > 6 else -1
    return 0


def votes(kind: str, text: str, a: int, b: int) -> int:
    """The labelers' votes as a number in base 3, digits 0 no, 1 abstains, 2 yes."""
    s, left, right = text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR]
    cue = 1 if _CUE_RE[kind].search(left) else 0
    if kind == "secret":
        pattern = 1 if _KEY.fullmatch(s) else -1 if len(s) < LONG else 0
        cue = cue or -bool(_PUBLIC.search(left))
    else:
        pattern = 1 if len(s) >= {"ipv6": 9, "mailto": 8}.get(kind, 0) else 0
        cue = 1 if kind == "mailto" else cue
    quoted = bool(left) and left[-1] in "\"'=:([" and (not right or right[0] in "\"')],.; \n")
    shape = 1 if quoted else (-1 if right[:1].isalnum() or left[-1:].isalnum() or left[-1:] in "./@" and left else 0)
    code = 0
    for v in (pattern, cue, shape, _valid(kind, s)):
        code = code * 3 + v + 1
    return code


def looks(s: str) -> int:
    """What the classifier sees besides the votes: length, share of digits and mix of cases, as a number below LOOKS."""
    digits = sum(c.isdigit() for c in s[:64]) / min(len(s), 64)
    size = 0 if len(s) < 16 else 1 if len(s) < 32 else 2
    case = bool(re.search("[a-z]", s)) + 2 * bool(re.search("[A-Z]", s))
    return (size * 3 + (digits > 0.2) + (digits > 0.7)) * 4 + case


LOOKS, VOTES = 36, 3**LABELERS


class Taken:
    """Disjoint intervals in order; a new one is refused where it meets one of them."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        k = bisect_left(self.ends, a + 1)  # the first that ends beyond a
        if k < len(self.starts) and self.starts[k] < b:
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, looks * VOTES + votes) of looser matches that overlap neither base spans nor each other."""
    used = Taken([(a, b) for _, a, b in taken])
    out = []
    plain = not _DIGIT.search(text)
    for k, (kind, (triggers, pattern)) in enumerate(_MORE.items()):
        if plain and kind != "mailto" and not (kind in ("secret", "ipv6") and (":" in text or "=" in text)):
            continue  # the other patterns need a digit
        if triggers and not any(t in text for t in triggers):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1) if m.start(1) >= 0 else m.span(2)
            if kind == "secret" and m.start(1) < 0 and (b - a < LONG or not _ALPHA.search(text, a, b)):
                continue
            if used.add(a, b):
                out.append((len(BASE) + k, a, b, looks(text[a:b]) * VOTES + votes(kind, text, a, b)))
    return out


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, cands array<struct<k:int,a:int,b:int,v:int>>"
_CANDS = pa.list_(pa.struct([("k", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("v", pa.int32())]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def extract(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: base spans and candidates with their votes."""
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, shas, bases, cands = [], [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                spans = base_spans(text)
                counts.append([sum(k == kind for k, _, _ in spans) for kind in BASE])
                bases.append(line := joined(spans))
                shas.append(hashlib.sha256(line.encode()).hexdigest() if line else empty)
                cands.append([dict(zip("kabv", c)) for c in candidates(text, spans)])
            n = np.array(counts, dtype=np.int64).reshape(-1, len(BASE))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n[:, i]) for i in range(len(BASE))), pa.array(shas, pa.string()), pa.array(bases, pa.string()), pa.array(cands, _CANDS)], names=[key, *(f"n_{k}" for k in BASE), "base_sha256", "base", "cands"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def _digits3(v: int) -> list[int]:
    return [v // 3 ** (LABELERS - 1 - i) % 3 - 1 for i in range(LABELERS)]


def estimate(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Posteriors of vote patterns and the labelers' log reliabilities, by EM on counts with a prior for honest labelers."""
    pats = sorted(counts)
    n = np.array([counts[p] for p in pats], float)
    v = np.array([_digits3(p) for p in pats]).reshape(-1, LABELERS)
    q = 1 / (1 + np.exp(-2.0 * v.sum(axis=1)))
    table = np.zeros((2, LABELERS, 3))
    for _ in range(rounds):
        for y, w in ((1, n * q), (0, n * (1 - q))):
            for i in range(LABELERS):
                for s in (-1, 1):
                    table[y, i, s + 1] = w[v[:, i] == s].sum() + (4.0 if (s == 1) == (y == 1) else 1.0)
            table[y] /= table[y].sum(axis=1, keepdims=True)
            table[y, :, 1] = 1.0  # an abstention says nothing
        prior = ((n * q).sum() + 2) / (n.sum() + 4)
        logit = np.log(prior / (1 - prior)) + sum(np.log(table[1, i, v[:, i] + 1] / table[0, i, v[:, i] + 1]) for i in range(LABELERS))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(pats, q.tolist())), np.log(table[1] / table[0])


def train(counts: dict[int, int], posterior: dict[int, float], steps: int = 100) -> np.ndarray:
    """Weights of the span classifier: logistic regression of the posterior on votes and looks, weighted by counts."""
    pats = sorted(counts)
    x = np.array([_features(p) for p in pats])
    y, n = np.array([posterior[p % VOTES] for p in pats]), np.log1p([counts[p] for p in pats])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]) * 0.05
        w += 0.5 * np.linalg.solve(h, x.T @ (n * (y - p)) - 0.05 * w)
    return w


def _features(v: int) -> np.ndarray:
    look, v = divmod(v, VOTES)
    x = np.zeros(1 + 2 * LABELERS + 10)
    x[0] = 1
    for i, s in enumerate(_digits3(v)):
        x[1 + 2 * i], x[2 + 2 * i] = s == 1, s == -1
    for at, k in ((0, look // 12), (3, look // 4 % 3), (6, look % 4)):
        x[1 + 2 * LABELERS + at + k] = 1
    return x


def accepted(found: DataFrame, threshold: float = 0.5) -> list[int]:
    """Codes kind * LOOKS * VOTES + looks * VOTES + votes that the classifier accepts, of at most 7 * 36 * 81."""
    by: dict[int, dict[int, int]] = {}
    for k, v, n in found.select(F.explode("cands").alias("c")).groupBy("c.k", "c.v").count().collect():
        by.setdefault(k, {})[v] = n
    out = []
    for k, counts in by.items():
        votes_: dict[int, int] = {}
        for v, n in counts.items():
            votes_[v % VOTES] = votes_.get(v % VOTES, 0) + n
        posterior, _ = estimate(votes_)
        w = train(counts, posterior)
        out += [k * LOOKS * VOTES + v for v in counts if 1 / (1 + math.exp(-float(_features(v) @ w))) >= threshold]
    return sorted(out)


def all_spans(found: DataFrame, codes: list[int]) -> DataFrame:
    """found with spans: base and accepted ones, by kind, then start."""
    ok = F.array(*map(F.lit, codes)) if codes else F.array().cast("array<int>")
    kept = F.array_sort(F.filter("cands", lambda c: F.array_contains(ok, c.k * (LOOKS * VOTES) + c.v)))
    names = F.array(*map(F.lit, KINDS))
    more = F.array_join(F.transform(kept, lambda c: F.concat_ws(":", names[c.k], c.a.cast("string"), c.b.cast("string"))), ",")
    base = F.nullif("base", F.lit(""))
    n = F.coalesce(F.size(F.split(base, ",")), F.lit(0)) + F.size(kept)
    return found.withColumns({"spans": F.concat_ws(",", base, F.nullif(more, F.lit(""))), "n_spans": n.cast("long")})


def op8_weakly_supervised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    check_columns(docs, "doc_id", "text")
    found = materialize(extract(docs), "pii")
    return all_spans(found, accepted(found)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")


def mask(text: str, spans: str) -> str:
    """text with every span replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if b > at:
            out += [text[at : max(a, at)], f"<{kind.upper()}>" if a >= at else ""]
            at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text. Votes are counted in one scan, spans found again and masked in a second."""
    bounded(docs.sparkSession)
    codes = frozenset(accepted(materialize(extract(docs).where("size(cands) > 0").select("cands"), "votes")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for t in batch.column(at):
                text = t.as_py()
                if text:
                    spans = base_spans(text)
                    spans += [(KINDS[k], a, b) for k, a, b, v in candidates(text, spans) if k * LOOKS * VOTES + v in codes]
                    text = mask(text, joined(spans)) if spans else text
                texts.append(text)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
