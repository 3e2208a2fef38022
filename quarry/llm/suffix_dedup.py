"""Exact removal of repeated passages with suffix arrays by induced sorting.

Every WIN-byte window of the corpus belongs to one region: the run of windows that share their minimizer, the
smallest hash among the window's K-byte grams. Equal windows have equal minimizers, so the hash of a
minimizer (the anchor) routes all places where a window can repeat to one shard, and a window under an anchor
that is unique repeats nowhere. One pass over the regions by anchor and content tells them apart: regions of equal
content repeat as a whole, and different regions under one anchor are read again (only those bytes) and sorted: each
shard concatenates its regions, builds the suffix array by induced sorting and the permuted common prefixes, and
windows that share WIN bytes with a neighbour in the array repeat. An anchor with more than HOT different regions
isn't gathered: its windows are counted by a 128-bit hash instead, which spreads them over all tasks.

Removed intervals are written by source file and block of BLOCK rows, and a last scan looks up those of each batch,
removes them and hashes the rest. Texts are never shuffled.

Defined cases: a null text is empty and keeps nothing; texts shorter than WIN keep all their bytes; copies are
removed everywhere, the first included; repeated rows are each other's copies; very long texts pass in parts
of CHUNK windows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import check_columns, load, materialize, numbered, side_rows, side_table
from .suffixes import permuted_lcp, suffix_array

WIN = 200
K = 50
SPAN = WIN - K + 1
CHUNK = 1 << 19
#: Bytes of a block whose suffixes are sorted together, and the number of regions from which an anchor is hot.
SHARD = 2 << 20
HOT = 4_096
#: Rows of a source file whose places or intervals one task writes.
BLOCK = 1 << 16
#: Rows of regions that are told apart at a time.
GATHERED = 50_000
#: Bytes of texts whose regions are found together: what numpy passes over stays in the cache.
TOGETHER = 1 << 16
BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.ones(n, np.uint64)
        p[1:] = b
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_POW: tuple[np.ndarray, np.ndarray] | None = None


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every K-byte gram: equal grams have equal hashes."""
    global _POW
    if _POW is None:
        _POW = _powers(CHUNK + WIN)
    with np.errstate(over="ignore"):
        p = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POW[0][: len(b)], out=p[1:])
        h = (p[K:] - p[:-K]) * _POW[1][: len(b) - K + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def minimizers(h: np.ndarray) -> np.ndarray:
    """Of every run of SPAN hashes, the place of the smallest, the leftmost of equals."""
    bits = np.uint64(20)
    n = len(h)
    packed = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    rows = -(-n // SPAN)
    x = np.full(rows * SPAN, np.iinfo(np.uint64).max)
    x[:n] = packed
    x = x.reshape(rows, SPAN)
    fore = np.minimum.accumulate(x, axis=1).reshape(-1)
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - SPAN + 1
    return (np.minimum(back[:m], fore[SPAN - 1 : SPAN - 1 + m]) & np.uint64((1 << 20) - 1)).astype(np.int64)


def regions(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hashes, content hashes, text numbers, starts, lengths in bytes) of the regions of texts or their parts, each of WIN bytes at least."""
    whole = b"".join(texts)
    view = memoryview(whole)
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes) - sizes
    h = gram_hashes(np.frombuffer(whole, np.uint8))
    inside = np.repeat(np.tile([1, 0], len(texts)), np.stack([sizes - WIN + 1, np.full(len(texts), WIN - 1)], 1).reshape(-1))[: len(whole) - WIN + 1]
    place = np.flatnonzero(inside)  # where windows start that end in their text
    at = minimizers(h)[place]
    lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    starts, ends = place[lo], place[np.r_[lo[1:], len(at)] - 1] + WIN
    rh = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    k = np.searchsorted(first, starts, side="right") - 1
    return h[at[lo]], rh, k, starts - first[k], ends - starts


ROW = "_f long, _r long"


def region_table(docs: DataFrame) -> DataFrame:
    """(ah, rh, _f, _r, lo, len): the regions of all texts."""
    names = ["ah", "rh", "_f", "_r", "lo", "len"]

    def made(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        f, r, c = (np.array([x[k] for x in held], np.int64) for k in range(3))
        ah, rh, k, lo, size = regions([x[3] for x in held])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ah.view(np.int64), rh.view(np.int64), f[k], r[k], c[k] + lo, size)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, int, int, bytes]] = []  # file, row, first byte, part of its text
            size = 0
            for f, r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = (t.as_py() or "").encode("utf-8", "surrogatepass")
                for c in range(0, len(text) - WIN + 1, CHUNK):
                    part = text[c : c + CHUNK + WIN - 1]
                    if held and size + len(part) > TOGETHER:
                        yield made(held)
                        held, size = [], 0
                    held.append((f, r, c, part))
                    size += len(part)
            if held:
                yield made(held)

    return docs.select("_f", "_r", "text").mapInArrow(run, f"ah long, rh long, {ROW}, lo long, len long")


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """The columns of about so many rows at a time, and whether these are the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if sum(map(len, held)) >= rows:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns], False
            held = []
        if len(batch):
            held.append(batch)
    if held:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns], True


def told_apart(table: DataFrame, rows: int = GATHERED) -> DataFrame:
    """(ah, n, _f, _r, lo, len): with n = 0 every region whose content repeats; else one region of each content, with
    its number of places n, under the anchors that have several contents."""
    names = ["ah", "n", "_f", "_r", "lo", "len"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None  # the last row so far, whose successor isn't known
        before, other = 0, False  # earlier rows of its class; whether its anchor has a class before
        place: np.ndarray | None = None  # where its class was first met
        for cols, final in _gathered(batches, rows):
            if last is not None:
                cols = [np.r_[x, y] for x, y in zip(last, cols)]
            ah, rh, *at = cols
            m = len(ah)
            anchor = np.r_[True, ah[1:] != ah[:-1]]
            first = np.flatnonzero(anchor | np.r_[True, rh[1:] != rh[:-1]])
            n = np.diff(np.r_[first, m])
            repeats = np.repeat(np.r_[n[0] + before, n[1:]] > 1, n)
            n[0] += before
            inner = ~anchor[first]
            inner[0] = other
            places = np.stack([x[first] for x in at])
            if place is not None:
                places[:, 0] = place
            mixed = inner | np.r_[inner[1:], False]
            if not final:
                repeats[-1] = mixed[-1] = False
            again, kinds = np.flatnonzero(repeats), np.flatnonzero(mixed)
            out = [ah[np.r_[again, first[kinds]]], np.r_[np.zeros(len(again), np.int64), n[kinds]], *(np.r_[x[again], y[kinds]] for x, y in zip(at, places))]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)
            last, before, other, place = [x[-1:] for x in cols], int(n[-1]) - 1, bool(inner[-1]), places[:, -1].copy()

    return table.repartition("ah").sortWithinPartitions("ah", "rh").mapInArrow(run, f"ah long, n long, {ROW}, lo long, len long")


def read_regions(docs: DataFrame, places: str) -> DataFrame:
    """(ah, n, _f, _r, lo, text) of the regions that a side table names."""
    names = ["ah", "n", "_f", "_r", "lo", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, wanted in _looked_up(batches, places):
            row, text = None, b""
            out = []
            index = {k: i for i, k in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))}
            for f, w in wanted:
                for ah, n, r, lo, size in zip(*(w.column(c).to_pylist() for c in ("ah", "n", "_r", "lo", "len"))):
                    if (f, r) not in index:
                        continue
                    if row != (f, r):
                        row, text = (f, r), batch.column(2)[index[f, r]].as_py().encode("utf-8", "surrogatepass")
                    out.append((ah, n, f, r, lo, text[lo : lo + size]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(zip(*out))], names=names)

    return docs.select("_f", "_r", "text").mapInArrow(run, f"ah long, n long, {ROW}, lo long, text binary")


def _looked_up(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, pa.Table]]]]:
    """Each batch with the side table's rows for it, by file."""
    for batch in batches:
        f, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found = []
        for x in np.unique(f):
            own = r[f == x]
            if (w := side_rows(path, int(x), int(own.min()), int(own.max()), BLOCK)) is not None:
                found.append((int(x), w))
        yield batch, found


def repeated_windows(block: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """For each region (its number of places, its bytes), which of its windows occur twice or more among the regions."""
    sizes = [len(t) for _, t in block]
    ends = np.cumsum(np.array(sizes) + 1)
    starts = ends - np.array(sizes) - 1
    text = np.zeros(ends[-1], np.int16)  # a separator of 0 after each region, bytes from 1 on
    for a, (_, t) in zip(starts, block):
        text[a : a + len(t)] = np.frombuffer(t, np.uint8)
        text[a : a + len(t)] += 1
    owned = np.zeros(len(text), np.int64)
    for a, (n, t) in zip(starts, block):
        owned[a : a + len(t) - WIN + 1] = n
    sa = suffix_array(text)
    lcp = permuted_lcp(text, sa)[sa]
    group = np.cumsum(np.r_[0, lcp[1:] < WIN])
    places = np.bincount(group, owned[sa])
    twice = np.zeros(len(text), bool)
    twice[sa] = places[group] >= 2
    twice &= owned > 0
    return [twice[a : a + n - WIN + 1] for a, n in zip(starts, sizes)]


def intervals(twice: np.ndarray, lo: int) -> list[tuple[int, int]]:
    """Byte intervals covered by the marked windows of a region that starts at lo."""
    edge = np.flatnonzero(np.diff(np.r_[0, twice.astype(np.int8), 0]))
    return [(lo + int(a), lo + int(b) - 1 + WIN) for a, b in zip(edge[::2], edge[1::2])]


def sorted_shards(texts: DataFrame) -> DataFrame:
    """(_f, _r, a, b): intervals of repeated windows, found in suffix arrays over the regions of whole anchors."""

    def flush(held: list[tuple]) -> list[tuple]:
        marks = repeated_windows([(h[1], h[5]) for h in held])
        return [(h[2], h[3], a, b) for h, m in zip(held, marks) if h[1] == 1 for a, b in intervals(m, h[4])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, out = 0, []
        for batch in batches:
            for h in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SHARD and h[0] != held[-1][0]:
                    out += flush(held)
                    held, size = [], 0
                held.append(h)
                size += len(h[5])
            if out:
                yield _interval_batch(out)
                out = []
        if held and (out := flush(held)):
            yield _interval_batch(out)

    return texts.select("ah", "n", "_f", "_r", "lo", "text").repartition("ah").sortWithinPartitions("ah").mapInArrow(run, f"{ROW}, a long, b long")


def _interval_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["_f", "_r", "a", "b"])


def counted_windows(texts: DataFrame) -> DataFrame:
    """The same for hot anchors: windows are counted by hash, map-side first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts = batch.column(4).to_pylist()
            size = np.array([len(t) - WIN + 1 for t in texts], np.int64)
            if not len(size):
                continue
            w = np.frombuffer(b"".join([digest(v[k : k + WIN]) for v in map(memoryview, texts) for k in range(len(v) - WIN + 1)]), np.int64).reshape(-1, 2)
            n, f, r, lo = (np.repeat(batch.column(k).to_numpy(), size) for k in range(4))
            a = lo + np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
            for k in range(0, len(w), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 200_000]) for x in (w[:, 0].copy(), w[:, 1].copy(), n, f, r, a)], names=["w1", "w2", "n", "_f", "_r", "a"])

    w = texts.select("n", "_f", "_r", "lo", "text").mapInArrow(run, f"w1 long, w2 long, n long, {ROW}, a long")
    often = w.groupBy("w1", "w2").agg(F.sum("n").alias("places")).where("places > 1")
    return w.where("n = 1").join(often, ["w1", "w2"], "left_semi").select("_f", "_r", "a", (F.col("a") + WIN).alias("b"))


def repeated(docs: DataFrame) -> DataFrame:
    """(_f, _r, a, b): intervals that cover every repeated window of docs (with _f, _r, text)."""
    regions = materialize(told_apart(region_table(docs)), "regions")
    alike = regions.where("n = 0").select("_f", "_r", F.col("lo").alias("a"), (F.col("lo") + F.col("len")).alias("b"))
    classes = regions.where("n > 0")
    texts = materialize(read_regions(docs, side_table(classes, "places", BLOCK)), "texts")
    hot = materialize(classes.groupBy("ah").count().where(F.col("count") > HOT).select("ah"), "hot")
    cool = sorted_shards(texts.join(hot, "ah", "left_anti"))
    return alike.unionByName(cool).unionByName(counted_windows(texts.join(hot, "ah", "left_semi")))


def merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of intervals."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.r_[True, a[1:] > b[:-1]]
    return list(zip(a[new].tolist(), b[np.r_[new[1:], True]].tolist()))


def removed(docs: DataFrame, keep: list[str], output: str) -> DataFrame:
    """For each row of docs: the columns keep, then n_bytes, n_removed, n_spans and the remaining bytes or their hash."""
    path = side_table(repeated(docs), "intervals", BLOCK)
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add(output, "string")
    head = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _looked_up(batches, path):
            spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for f, w in found:
                r, a, b = (w.column(c).to_numpy() for c in ("_r", "a", "b"))
                cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True]) if len(r) else [0]
                for x, y in zip(cut[:-1], cut[1:]):
                    spans[f, int(r[x])] = merged(a[x:y], b[x:y])
            rows = []
            for f, r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = (t.as_py() or "").encode("utf-8", "surrogatepass")
                own = spans.get((f, r), [])
                edges = [0, *(e for s in own for e in s), len(text)]
                rest = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])) if own else text
                rows.append((len(text), len(text) - len(rest), len(own), hashlib.sha256(rest).hexdigest() if output == "kept_sha256" else rest.decode("utf-8", "replace")))
            cols = list(zip(*rows)) or [[], [], [], []]
            made = [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[3 : 3 + head], *made], names=schema.names)

    return docs.select("_f", "_r", "text", *(F.col(c).alias(f"_keep_{c}") for c in keep)).mapInArrow(run, schema)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    check_columns(docs, "doc_id", "text")
    return removed(numbered(docs.select("doc_id", "text")), ["doc_id"], "kept_sha256")


#: The same rows by counting every window; DuckDB.
OP10_SQL = """
WITH n AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, i, md5(t[i + 1:i + 200]) AS k FROM (SELECT rid, t, unnest(range(0, greatest(0, n - 199))) AS i FROM n)),
s AS (SELECT rid, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM s),
p AS (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS grp FROM g) GROUP BY rid, grp),
q AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS z FROM p),
r AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(CASE WHEN a > z THEN hex(t[z + 1:a]) ELSE '' END, '' ORDER BY a) AS head FROM q JOIN n USING (rid) GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head || CASE WHEN n > last THEN hex(t[last + 1:n]) ELSE '' END, hex(t)))) AS kept_sha256 FROM n LEFT JOIN r USING (rid)
"""
