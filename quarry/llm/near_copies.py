"""Near copies by the Jaccard similarity of their five-word shingles: SimHash and its byte index first, prefix lists for the exact rest.

The SimHash fingerprints of the sets go through the inverted index of positional bytes with count filtering (`simhash.links`);
what it links is verified by whole sets. Texts of a similarity of 4/5 differ in more bits than that index can promise to find
(most of them in 5 to 9), so the rest is found through prefix filtering: two sets of n and m >= n shingles with a similarity
of 4/5 or more share a shingle among the first n // 5 + 1 and
m // 5 + 1 of them, in any order that all texts follow. So only those prefixes are posted. The order puts shingles
that repeat in a sample of the documents last, the most frequent at the end, which keeps the lists of boilerplate
out of most prefixes; the sample decides speed alone, not the result. Members of a list whose sizes allow the
similarity are candidates. Neighbours in a list, by size, are verified together with what the fingerprints link; after that,
only pairs of a list that are in different components so far. So a group of k near copies costs about k pairs a list,
not k * k, and no group that a link would join stays apart. Of those pairs, ones whose parities (1,024 bits a set) differ in
more bits than sets so alike can differ in shingles are no links and never leave the task. Sets lie in arrays that the tasks which made them wrote to
the shared folder; a verifying task maps what its pairs name, so sets are never shuffled, however many pairs they are in.
Texts of equal sets are one class throughout. No list is cut.

Defined cases: words are split at ASCII white space and lowered in ASCII; fewer than five words make one shingle; texts
without words are copies of each other; groups are the components of the links; repeated rows are copies; an empty
table gives an empty result. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_columns, drop_table, keep_rows, materialize, numbered, posix, shared_path, shielded, slices, tidy
from .components import components
from .elias_fano import save_array
from .simhash import links

SHINGLE = 5
#: Documents whose shingles are counted for the order, from how many of them on one is late, and how many are told apart.
SAMPLE, LATE, MOST_LATE = 20_000, 3, 200_000
#: Values or pairs in an output batch.
ROWS = 200_000
#: Buckets of a parity, pieces that parities are saved in, list members whose parities a task holds, and pairs it compares at a time.
BITS, PIECES, MEMBERS, BLOCK = 1_024, 256, 100_000, 8_192
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 33)]


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    k = min(n, SHINGLE)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = (out * MIX[0]) ^ h[i : n - k + 1 + i]
        out = (out ^ (out >> MIX[2])) * MIX[1]
    return np.unique(out ^ (out >> MIX[2]))


def fingerprint(s: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles, unsigned; 0 of none."""
    ones = np.zeros(64, np.float32)
    for k in range(0, len(s), 65_536):  # a product sums bits much faster than a sum over the narrow axis does
        bits = np.unpackbits(s[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.ones(len(bits), np.float32) @ bits.astype(np.float32)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<u8")[0])


def prefix(s: np.ndarray, late: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first len(s) // 5 + 1 of a set, late ones last by their times."""
    n = len(s) // 5 + 1
    if not len(late) or not len(s):
        return s[:n]
    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
    hit = late[at] == s
    out = s[~hit][:n]
    if len(out) < n:
        rest, t = s[hit], times[at[hit]]
        out = np.r_[out, rest[np.lexsort((rest, t))][: n - len(out)]]
    return out


def _mapped(docs: DataFrame, keep: str, schema: str, of) -> DataFrame:
    """docs (keep, text) with what `of` makes of each text: (hash of the set, size, fingerprint, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, sigs, sizes, fps, values, held = 0, [], [], [], [], 0
            for i, t in enumerate(b.column(1)):
                s = shingles(t.as_py())
                v = of(s)
                sigs.append(xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0)
                sizes.append(len(s))
                fps.append(fingerprint(s))
                values.append(v)
                held += len(v)
                if held >= ROWS or i == b.num_rows - 1:
                    ends = np.r_[0, np.cumsum([len(x) for x in values])].astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, i + 1 - first), pa.array(np.array(sigs, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists], names=[keep, "sig", "n", "fp", "shingles"])
                    first, sigs, sizes, fps, values, held = i + 1, [], [], [], [], 0
            tidy()

    return docs.select(keep, "text").mapInArrow(run, f"`{keep}` {schema}, sig long, n int, fp long, shingles array<long>")


def late_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in a sample of the rows, ascending, and how often they do."""
    part = min(1.0, SAMPLE / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("_f", "_r"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).select("_r", "text")
    found = _mapped(some, "_r", "long", lambda s: s).select(F.explode("shingles").alias("h")).groupBy("h").count().where(F.col("count") >= LATE).orderBy(F.desc("count"), "h").limit(MOST_LATE).toArrow()
    h, c = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The pairs (a, b) with a < b, each once."""
    x, y = (np.concatenate(c) for c in zip(*found))
    x, y = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    return pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new])], names=["a", "b"])


def lists(marks: DataFrame) -> DataFrame:
    """(n, sig): the sets that share a shingle of their prefixes, ascending by size; a list ends where the next size is too large for a similarity of 4/5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, sig = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

        def out(upto: int) -> Iterator[pa.RecordBatch]:
            k, m, s = key[:upto], n[:upto], sig[:upto]
            first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (4 * m[1:].astype(np.int64) > 5 * m[:-1].astype(np.int64))])
            size = np.diff(np.r_[first, upto])
            kept = np.repeat(size > 1, size)
            size, m, s = size[size > 1], m[kept], s[kept]
            ends = np.r_[0, np.cumsum(size)]
            a = 0
            while a < len(size):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + ROWS, side="right")) - 1)
                at = pa.array((ends[a : b + 1] - ends[a]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(x[ends[a] : ends[b]])) for x in (m, s)], names=["n", "sig"])
                a = b

        for batch in batches:
            key, n, sig = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((key, n, sig)))
            if len(key) > ROWS:
                new = np.r_[True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])]
                key, n, sig = key[new], n[new], sig[new]
                cut = int(np.searchsorted(key, key[-1]))  # the last list may go on
                if cut:
                    yield from out(cut)
                    key, n, sig = key[cut:], n[cut:], sig[cut:]
        if len(key):
            new = np.r_[True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])]
            key, n, sig = key[new], n[new], sig[new]
            yield from out(len(key))
        tidy()

    postings = marks.select(F.explode("shingles").alias("key"), "n", "sig")
    return postings.repartition("key").sortWithinPartitions("key", "n", "sig").mapInArrow(run, "n array<int>, sig array<long>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The members of a batch of lists: number of the list, size, set."""
    size = np.diff(batch.column(0).offsets.to_numpy())
    return np.repeat(np.arange(len(size)), size), batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()


def neighbours(found: DataFrame) -> DataFrame:
    """(a, b): pairs of sets next to each other in a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, _, sig = _flat(batch)
            i = np.flatnonzero(k[1:] == k[:-1])
            if len(i):
                yield _pairs([(sig[i], sig[i + 1])])
        tidy()

    return found.mapInArrow(run, "a long, b long").distinct()


def fingerprinted(marks: DataFrame) -> DataFrame:
    """(a, b): pairs of sets whose fingerprints the byte index links, and sets of one fingerprint with the least of them."""
    heads = materialize(marks.groupBy("fp").agg(F.min("sig").alias("head"), F.max("sig").alias("last")), "heads")
    near = links(heads).distinct()
    head = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    across = near.join(head("a"), "a").join(head("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    same = marks.select("fp", "sig").join(heads.where("head != last"), "fp").where("sig != head").select(F.col("head").alias("a"), F.col("sig").alias("b"))
    return across.union(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def parity(s: np.ndarray) -> bytes:
    """Of each of BITS buckets of shingles, whether a set has an odd number; sets that differ in d shingles differ in d bits at most."""
    odd = np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _piece(sig: np.ndarray) -> np.ndarray:
    return sig & (PIECES - 1)


def saved_sides(places: DataFrame, roots: DataFrame) -> str:
    """Writes root and parity of each of places (sig, bits) in PIECES pieces, arrays ascending by sig, which tasks map."""
    path = posix(shared_path(places.sparkSession, "sides"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        made, held = [], []

        def flush() -> None:
            sig, root, bits = (pa.chunked_array([b.column(i) for b in held]) for i in range(3))
            sig = sig.to_numpy()
            k = int(_piece(sig[:1])[0])
            save_array(f"{path}/root-{k}.npy", root.to_numpy())
            save_array(f"{path}/bits-{k}.npy", np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(len(sig), -1))
            save_array(f"{path}/sig-{k}.npy", sig)
            made.append(k)
            held.clear()

        for batch in batches:
            k = _piece(batch.column(0).to_numpy())
            cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else []
            for x, y in zip(cuts, np.r_[cuts[1:], len(k)].astype(int)):
                if held and int(_piece(held[0].column(0).to_numpy()[:1])[0]) != k[x]:
                    flush()
                held.append(batch.slice(x, y - x))
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64())], names=["k"])
        tidy()

    piece = F.col("sig").bitwiseAND(F.lit(PIECES - 1))
    rooted = places.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), "bits")
    rooted.repartition(piece).sortWithinPartitions(piece, "sig").mapInArrow(run, "k long").collect()  # a row a piece
    return path


def side(sig: np.ndarray, path: str, what: str) -> np.ndarray:
    """The root or parity of sets that all have one saved."""
    out = np.zeros((len(sig), BITS // 64), np.uint64) if what == "bits" else np.zeros(len(sig), np.int64)
    if not len(sig):
        return out
    order = np.argsort(_piece(sig), kind="stable")
    part = _piece(sig[order])
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(part)]):
        at = np.searchsorted(_mapped_file(f"{path}/sig-{part[a]}.npy"), sig[order[a:b]])
        out[order[a:b]] = _mapped_file(f"{path}/{what}-{part[a]}.npy")[at]
    return out


def _across(k: np.ndarray, n: np.ndarray, sig: np.ndarray, path: str) -> Iterator[pa.RecordBatch]:
    """Pairs within lists (number k) whose sizes and parities allow a similarity of 4/5 and whose roots differ, a bounded number at a time."""
    root = side(sig, path, "root")
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    mixed = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
    kept = np.repeat(mixed, np.diff(np.r_[first, len(k)]))
    k, n, sig, root = k[kept], n[kept].astype(np.int64), sig[kept], root[kept]
    own, at = np.unique(sig, return_inverse=True)
    bits = side(own, path, "bits")
    found, held, live, d = [], 0, np.arange(len(k)), 0
    while len(live):
        d += 1
        live = live[live + d < len(k)]
        live = live[(k[live] == k[live + d]) & (5 * n[live] >= 4 * n[live + d])]
        i = live[root[live] != root[live + d]]
        far = [9 * np.bitwise_count(bits[at[x]] ^ bits[at[x + d]]).sum(axis=1, dtype=np.int64) > n[x] + n[x + d] for x in (i[j : j + BLOCK] for j in range(0, len(i), BLOCK))]
        i = i[~np.concatenate(far)] if far else i
        if len(i):
            found.append((sig[i], sig[i + d]))
            held += len(i)
            if held >= 5 * ROWS:
                yield _pairs(found)
                found, held = [], 0
    if held:
        yield _pairs(found)


def candidates(found: DataFrame, path: str) -> DataFrame:
    """(a, b): pairs of sets that meet in a list, are in different components so far, and may be similar by what is saved of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.r_[0, np.cumsum(np.diff(batch.column(0).offsets.to_numpy()))]
            a = 0
            while a < batch.num_rows:  # about MEMBERS members at a time, whole lists
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + MEMBERS, side="right")) - 1)
                yield from _across(*_flat(batch.slice(a, b - a)), path)
                a = b
        _mapped_file.cache_clear()
        tidy()

    return found.mapInArrow(run, "a long, b long").distinct()


@lru_cache(maxsize=1_024)
def _mapped_file(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


def stored_sets(rows: DataFrame, named: DataFrame, root: str) -> DataFrame:
    """(sig, file, at, n, bits): where the set of each of the named rows lies, and its parity; in files below root written by the task that met it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(root, exist_ok=True)
        for b in slices(batches, 2_000):
            sets = [shingles(t.as_py()) for t in b.column(0)]
            sizes = np.array([len(x) for x in sets], np.int64)
            name = uuid.uuid4().hex[:16]  # a repeated task writes files of its own
            save_array(f"{root}/{name}.npy", np.concatenate(sets))
            sigs = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array([name] * len(sets)), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([parity(x) for x in sets], pa.binary())], names=["sig", "file", "at", "n", "bits"])

    return keep_rows(rows, named, ["text"], made=(run, "sig long, file string, at long, n long, bits binary"))


def verified(pairs: DataFrame, places: DataFrame, root: str) -> DataFrame:
    """The pairs (a, b) whose sets, stored below root, have a similarity of 4/5 or more; those without a place have not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for a, fa, sa, na, fb, sb, nb in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7))):
                if last[0] != a:
                    last = (a, np.array(_mapped_file(f"{root}/{fa}.npy")[sa : sa + na]))
                both = np.sort(np.concatenate([last[1], _mapped_file(f"{root}/{fb}.npy")[sb : sb + nb]]), kind="stable")  # merges two sorted runs
                keep.append(9 * int((both[1:] == both[:-1]).sum()) >= 4 * (na + nb))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        _mapped_file.cache_clear()
        tidy()

    side = lambda p: places.select(F.col("sig").alias(p), *(F.col(c).alias(f"{c}_{p}") for c in ("file", "at", "n")))
    named = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "file_a", "at_a", "n_a", "file_b", "at_b", "n_b")
    return named.sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id. Rows are named by file and place, so the scans agree."""
    check_columns(docs, "doc_id", "text")
    return shielded(docs, ("doc_id", "text"), _deduplicated)


def _deduplicated(docs: DataFrame) -> DataFrame:
    cols = docs.columns
    rows = numbered(docs)
    late, times = late_shingles(rows)
    who = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_f", "_r").alias("_who")
    keyed = rows.select(who, "text")
    marks = materialize(_mapped(keyed, "_who", keyed.schema["_who"].dataType.simpleString(), lambda s: prefix(s, late, times)), "marks")
    lows = materialize(marks.groupBy("sig").agg(F.min("_who").alias("low"), F.first("fp").alias("fp")), "classes")  # equal sets have equal fingerprints
    met = materialize(lists(marks), "lists")
    drop_table(marks)
    inside = met.select(F.explode("sig").alias("sig")).distinct()
    root = posix(shared_path(docs.sparkSession, "shingles"))
    named = materialize(inside.join(lows, "sig").select("low._f", "low._r"), "met")
    places = materialize(stored_sets(rows, named, root), "sets")
    drop_table(named)
    near = materialize(verified(fingerprinted(lows).union(neighbours(met)).distinct(), places, root), "near")
    roots = materialize(components(near), "roots")
    more = materialize(verified(candidates(met, saved_sides(places, roots)), places, root), "more")
    if more.limit(1).count():
        roots = components(roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    roots = roots.select(F.col("node").alias("sig"), "root")
    kept = lows.join(roots, "sig", "left").groupBy(F.coalesce("root", "sig")).agg(F.min("low").alias("low")).select("low._f", "low._r")
    return keep_rows(rows, kept, cols)
