"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds the words of the training documents, named by the rank of their 64-bit hash, with counts and
back-off weights; level 2 holds every word pair, and level 3 every word triple. The children of a context follow those of the context
before it; monotone Elias-Fano pointers bound them, and their ids, offset by the last value before the
context's first child, form one Elias-Fano sequence, in which a successor search relative to the context finds
a child. Next to it stand the discounted probabilities, quantised in log space to QUANTA levels.

    p(w | u) = max(c(uw) - D, 0) / c(u) + D T(u) / c(u) p(w),  p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

    p(w | t u) = max(c(tuw) - D, 0) / c(tu) + D T(tu) / c(tu) p(w | u)

with T the number of distinct successors of a context and D the discount; an unknown context leaves the shorter one.
score is the sum of log10 p(w | u), score_3 that of log10 p(w | t u); before a text stands one end, so its first word
has a context of one. Levels are cut into shards of about SHARD_TOKENS training tokens by a position that rises with
(u, w), hot contexts included; the triples of a pair lie in its shard, under its place there. Pairs are counted as
the triples that they begin; these go to their shards in packed runs. Shards are put end to end in VOLUMES volumes at most, sets of memory-mapped
files in the shared folder, which scoring tasks map as they need them: a run of tokens is looked up in all shards of a volume at once, so what it costs doesn't
grow with the number of shards. Everything is counted over all training documents, map-side first; nothing is pruned.

Defined cases: a null text is empty and scores its end token; with no training document N = V = 0 and
every score is log10 of 1; unknown words share the mass of one; repeated rows count each time; an empty table
gives an empty result; extra columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, check_columns, crc_mod, load, materialize, posix, shared_path, tidy
from .elias_fano import EliasFano, Sequences, join_arrays, join_sequences, save_array

DISCOUNT = 0.75
QUANTA = 65_535
LOWEST = 12.0
SHARD_TOKENS = 1_000_000
SHARD_WORDS = 1_000_000
#: Sets of files that the shards of the model are put together in, by as many tasks.
VOLUMES = 32
#: Tokens that a task counts at a time, and those that it scores: every volume of the model is asked once for each run.
TOKENS = 200_000
SCORED = 800_000
#: Triples of a shard in a row of the shuffle (16 bytes each, so an Arrow batch holds 64 MB at most): a row a triple costs more to move and sort than all else about it.
PACKED = 4_000
END = b" "  # no word holds a space


def word_hash(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.array([h(w) for w in words], dtype=np.uint64)


def documents(batches: Iterator[pa.RecordBatch], column: int, most: int = TOKENS) -> Iterator[tuple[np.ndarray, list[bytes], list[int], list[int], pa.RecordBatch]]:
    """Runs of about so many tokens: numbers of the tokens, the distinct words that they name, the rows (batch-wise) and their numbers of tokens."""
    for batch in batches:
        texts = batch.column(column)
        bound = max(1, most // 32)  # rows that are split at a time, as long as their texts are short
        a = 0
        while a < len(batch):
            held, sizes, n = [], [], 0
            first = a
            while a < len(batch) and n < most:
                step = bound
                part = texts.slice(a, step)
                while step > 1 and part.nbytes > 8 * most:
                    step = max(1, step // 2)
                    part = texts.slice(a, step)
                words, size = split(part)
                ends = np.cumsum(size + 1) + n
                take = min(len(size), int(np.searchsorted(ends, most)) + 1)
                held.append(words.slice(0, int(size[:take].sum())))
                sizes.append(size[:take])
                n = int(ends[take - 1])
                a += take
            size = np.concatenate(sizes)
            coded = pa.chunked_array(held).combine_chunks().dictionary_encode()
            distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
            last = np.zeros(n, bool)
            last[np.cumsum(size + 1) - 1] = True
            codes = np.full(n, len(distinct))
            codes[~last] = coded.indices.to_numpy()
            yield codes, [*distinct, END], list(range(first, a)), (size + 1).tolist(), batch
        tidy()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, and their number in each; a null text has none."""
    whole = texts.take(pa.array(np.arange(len(texts))))  # ascii_lower misreads arrays whose bytes don't begin at 0
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(whole.cast(pa.large_string()), "")))
    words = lists.flatten()
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    until = np.r_[0, np.cumsum(filled)]
    return words.filter(pa.array(filled)), np.diff(until[np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]])


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c): word hashes as signed longs, and counts, over all of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            h, c = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            order = np.argsort(h)
            h, c = h[order], c[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.add.reduceat(c, first))], names=["h", "c"])

        for codes, distinct, *_ in documents(batches, 0):
            count = np.bincount(codes, minlength=len(distinct))
            waiting.append((word_hash(distinct), count))
            if sum(len(h) for h, _ in waiting) > 5 * TOKENS:
                yield out()
        if waiting:
            yield out()

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Words:
    """Level 1: pieces by the leading bits of the hash, each with sorted hashes, counts and back-off weights."""

    def __init__(self, root: str) -> None:
        with open(f"{root}/meta.json") as f:
            self.meta = json.load(f)
        self.root, self.bits, self.first = root, self.meta["bits"], np.array(self.meta["first"], np.int64)
        self.n, self.total = self.meta["V"], self.meta["N"]

    @lru_cache(maxsize=256)  # noqa: B019
    def piece(self, k: int, what: str) -> np.ndarray:
        return np.load(f"{self.root}/{what}-{k}.npy", mmap_mode="r")

    def _pieces(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word ids of hashes, -1 where unknown."""
        out = np.full(len(h), -1, np.int64)
        if not self.n:
            return out
        order = np.argsort(h)
        s = h[order]
        part = self._pieces(s)
        for k in np.unique(part):
            a, b = np.searchsorted(part, [k, k + 1])
            known = self.piece(int(k), "hash")
            if len(known):
                at = np.minimum(np.searchsorted(known, s[a:b]), len(known) - 1)
                out[order[a:b]] = np.where(known[at] == s[a:b], at + self.first[k], -1)
        return out

    def get(self, what: str, ids: np.ndarray) -> np.ndarray:
        """Values of a per-word array."""
        out = np.zeros(len(ids), np.float64 if what == "backoff" else np.int64)
        part = np.searchsorted(self.first, ids, side="right") - 1
        for k in np.unique(part):
            at = np.flatnonzero(part == k)
            out[at] = self.piece(int(k), what)[ids[at] - self.first[k]]
        return out


@lru_cache(maxsize=2)
def words_at(root: str) -> Words:
    return Words(root)


def write_words(counts: DataFrame, root: str) -> tuple[int, int]:
    """Writes level 1 below root; returns N and V."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(0, (v // SHARD_WORDS).bit_length())
    os.makedirs(root, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made = []

        def flush(t: pa.Table) -> None:
            k = t.column("k")[0].as_py()
            h = t.column("h").to_numpy().view(np.uint64)
            order = np.argsort(h)
            save_array(f"{root}/hash-{k}.npy", h[order])
            save_array(f"{root}/count-{k}.npy", t.column("c").to_numpy()[order])
            made.append((k, len(h), int(t.column("c").to_numpy().sum())))

        for batch in batches:  # sorted by k
            held.append(batch)
            t = pa.Table.from_batches(held)
            k = t.column("k").to_numpy()
            cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                flush(t.slice(a, b - a))
            held = t.slice(cuts[-1]).to_batches() if len(cuts) else []
        if held and sum(map(len, held)):
            flush(pa.Table.from_batches(held))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*made) if made else ([], [], []))], names=["k", "n", "c"])

    k = F.shiftrightunsigned("h", 64 - bits).cast("long") if bits else F.lit(0).cast("long")
    pieces = {r.k: r for r in counts.withColumn("k", k).repartition("k").sortWithinPartitions("k").mapInArrow(run, "k long, n long, c long").collect()}  # one row a piece
    first, tokens = [], []
    a = t = 0
    for k in range(1 << bits):
        first.append(a)
        tokens.append(t)
        if k in pieces:
            a, t = a + pieces[k].n, t + pieces[k].c
        else:
            save_array(f"{root}/hash-{k}.npy", np.zeros(0, np.uint64))
            save_array(f"{root}/count-{k}.npy", np.zeros(0, np.int64))
    with open(f"{root}/meta.json", "w") as f:
        json.dump({"bits": bits, "first": first, "tokens": tokens, "N": n, "V": v, "shards": max(1, -(-n // SHARD_TOKENS))}, f)
    return n, v


def shard_of(words: Words, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The shard of pairs (u, w): rises with the pair, and cuts contexts of many tokens at even steps of w."""
    shards = words.meta["shards"]
    out = np.zeros(len(u), np.int64)
    if shards == 1:
        return out
    part = np.searchsorted(words.first, u, side="right") - 1
    for k in np.unique(part):
        at = np.flatnonzero(part == k)
        count = words.piece(int(k), "count")
        before = _before(words.root, int(k))
        i = u[at] - words.first[k]
        place = before[i] + count[i] * (w[at] / words.n)
        out[at] = np.minimum(shards - 1, (place + words.meta["tokens"][k]) * shards // words.total)
    return out


@lru_cache(maxsize=64)
def _before(root: str, k: int) -> np.ndarray:
    c = words_at(root).piece(k, "count")
    return np.cumsum(c) - c


def contexts(ids: np.ndarray, end: int) -> np.ndarray:
    """The token before each token; a text begins after an end."""
    return np.r_[end, ids[:-1]]


def grouped(key: np.ndarray, w: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (key, w), ascending, and the sum of the c of each (or how often it is there). w is -1 or more; sorts are of single numbers, which are quick."""
    own, at = np.unique(key, return_inverse=True)
    x = at << 32 | w.astype(np.int64) + 1
    if c is None:
        x.sort()
    else:
        order = np.argsort(x)
        x, c = x[order], c[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    c = np.diff(np.r_[first, len(x)]) if c is None else np.add.reduceat(c, first, dtype=np.int64)
    x = x[first]
    return own[x >> 32], (x & 0xFFFFFFFF) - 1, c


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers, byte by byte of all numbers: mostly equal bytes stand together, which the shuffle compresses."""
    return np.stack([x.astype(np.int32) for x in columns]).view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1).tobytes()


def unpacked(run: bytes, n: int) -> np.ndarray:
    """The n columns of a packed run."""
    return np.ascontiguousarray(np.frombuffer(run, np.uint8).reshape(n, 4, -1).transpose(0, 2, 1)).view(np.int32)[:, :, 0]


def count_triples(docs: DataFrame, root: str) -> DataFrame:
    """(s, run): shard, and triples u, v, w with their count within a run of tokens, packed; w is -1 where v ends a text. A row holds PACKED of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_at(root)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            key, w = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            key, w, c = grouped(key, w)
            u, v = key >> 32, key & 0xFFFFFFFF
            s = shard_of(words, u, v).astype(np.int32)  # ascending
            cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            shards, runs, held = [], [], 0
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(s)]):
                for i in range(a, b, PACKED):
                    j = min(b, i + PACKED)
                    shards.append(s[i])
                    runs.append(packed(u[i:j], v[i:j], w[i:j], c[i:j]))
                    held += j - i
                    if held >= 200_000 or j == len(s):
                        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(runs, pa.binary())], names=["s", "run"])
                        shards, runs, held = [], [], 0

        for codes, distinct, *_ in documents(batches, 0):
            ids = words.ids(word_hash(distinct))[codes]
            end = int(ids[-1])
            after = np.r_[ids[1:], -1].astype(np.int32)
            after[ids == end] = -1
            waiting.append((contexts(ids, end) << 32 | ids, after))
            if sum(len(x) for x, _ in waiting) > 5 * TOKENS:
                yield from out()
        if waiting:
            yield from out()

    return docs.select("text").mapInArrow(run, "s int, run binary")


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * (QUANTA / LOWEST)), 0, QUANTA).astype(np.uint16)


def probability(level: np.ndarray) -> np.ndarray:
    return 10.0 ** (-level.astype(np.float64) * (LOWEST / QUANTA))


def sequence(size: np.ndarray, w: np.ndarray, path: str, s: int) -> None:
    """Writes the children w of contexts with so many of them each; a context starts where the one before ended."""
    ends = np.cumsum(size)
    have = np.flatnonzero(size)
    last = np.r_[0, np.cumsum(w[ends[have] - 1].astype(np.int64) + 1)]
    EliasFano.build(np.r_[0, ends]).save(f"{path}/pointers-{s}")
    EliasFano.build(np.repeat(last[:-1], size[have]) + w).save(f"{path}/children-{s}")


def write_levels(triples: DataFrame, root: str) -> None:
    """Writes levels 2 and 3 and the back-off weights of level 1."""
    os.makedirs(f"{root}/3", exist_ok=True)

    def build(s: int, runs: list[np.ndarray]) -> pa.RecordBatch:
        words = words_at(root)
        u, v, w, c = np.concatenate(runs, axis=1)
        key, w, c = grouped(u.astype(np.int64) << 32 | v, w, c)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        pair, total = key[first], np.add.reduceat(c, first)
        size = np.add.reduceat((w >= 0).astype(np.int64), first)
        inner = w >= 0
        sequence(size, w[inner], f"{root}/3", s)
        save_array(f"{root}/3/probabilities-{s}.npy", quantise((np.maximum(c - DISCOUNT, 1e-9) / np.repeat(total, np.diff(np.r_[first, len(key)])))[inner]))
        save_array(f"{root}/3/backoff-{s}.npy", quantise(np.where(size > 0, DISCOUNT * size / total, 1.0)))
        u, v = pair >> 32, pair & 0xFFFFFFFF
        head = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        have, size = u[head], np.diff(np.r_[head, len(u)])
        sizes = np.zeros(int(have[-1] - have[0]) + 1, np.int64)
        sizes[have - have[0]] = size
        sequence(sizes, v, root, s)
        save_array(f"{root}/probabilities-{s}.npy", quantise(np.maximum(total - DISCOUNT, 1e-9) / words.get("count", u)))
        n = len(have)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, s)), pa.array(np.full(n, pair[0])), pa.array(np.full(n, pair[-1])), pa.array(have), pa.array(size)], names=["s", "lo", "hi", "u", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if now is not None and s != now:
                    yield build(now, held)
                    held = []
                    tidy()
                now = s
                held.append(unpacked(x.as_buffer(), 4))
        if held:
            yield build(now, held)

    tasks = min(20_000, 2 * words_at(root).meta["shards"])  # about a shard each: what a task sorts stays small
    made = materialize(triples.repartition(tasks, "s").sortWithinPartitions("s").mapInArrow(run, "s long, lo long, hi long, u long, t long"), "contexts")
    spans = sorted(tuple(r) for r in made.select("s", "lo", "hi").distinct().collect())  # one row a shard
    join_volumes(triples.sparkSession, [s for s, *_ in spans], per := -(-len(spans) // VOLUMES), root)
    with open(f"{root}/shards.json", "w") as f:
        json.dump({"volume": per, "spans": spans}, f)
    first = words_at(root).first.tolist()
    piece = F.lit(0)
    for k in range(1, len(first)):
        piece = piece + (F.col("u") >= first[k]).cast("int")

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, now = words_at(root), {}
        for batch in batches:
            k, u, t = (batch.column(i).to_numpy() for i in range(3))
            for x in np.unique(k):
                if int(x) not in now:
                    for y, v in now.items():
                        save_array(f"{root}/backoff-{y}.npy", v)
                    now = {int(x): np.zeros(len(words.piece(int(x), "count")), np.float32)}
                at = u[k == x] - words.first[x]
                now[int(x)][at] = DISCOUNT * t[k == x] / words.piece(int(x), "count")[at]
        for y, v in now.items():
            save_array(f"{root}/backoff-{y}.npy", v)
        yield pa.RecordBatch.from_arrays([pa.array(list(now), pa.int64())], names=["k"])

    by = made.groupBy("u").agg(F.sum("t").alias("t")).select(piece.cast("long").alias("k"), "u", "t")
    by.repartition("k").sortWithinPartitions("k").mapInArrow(weights, "k long").count()


def join_volumes(spark: SparkSession, shards: list[int], per: int, root: str) -> None:
    """Puts so many shards at a time end to end, in both levels, and removes their own files."""

    def join(v: int) -> None:
        own = shards[v * per : v * per + per]
        done = f"{root}/volume-{v}.json"
        for folder in (root, f"{root}/3"):
            if not os.path.exists(done):  # else an earlier attempt has been removing them
                for k in ("pointers", "children"):
                    join_sequences([f"{folder}/{k}-{s}" for s in own], f"{folder}/{k}-of-{v}")
                for k in ("probabilities", *["backoff"] * folder.endswith("/3")):
                    join_arrays([f"{folder}/{k}-{s}.npy" for s in own], f"{folder}/{k}-of-{v}.npy")
        with open(done, "w") as f:
            json.dump(own, f)
        files = [f"{k}-{s}.{x}" for s in own for k in ("pointers", "children") for x in ("low.npy", "high.npy", "ones.npy", "zeros.npy", "json")]
        for folder, more in ((root, ["probabilities"]), (f"{root}/3", ["probabilities", "backoff"])):
            for x in [*files, *(f"{k}-{s}.npy" for k in more for s in own)]:
                if os.path.exists(f"{folder}/{x}"):
                    os.remove(f"{folder}/{x}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v in batch.column(0).to_pylist():
                join(v)
            yield batch

    n = -(-len(shards) // per)
    spark.range(0, n, 1, n).mapInArrow(run, "id long").count()


class Trie:
    """The memory-mapped model."""

    def __init__(self, root: str) -> None:
        self.root, self.words = root, words_at(root)
        with open(f"{root}/shards.json") as f:
            made = json.load(f)
        self.per = made["volume"]
        self.firsts = np.array([s[1] for s in made["spans"]], np.int64)

    @lru_cache(maxsize=2 * VOLUMES)  # noqa: B019
    def volume(self, v: int, level: int = 2) -> tuple[Sequences, Sequences, np.ndarray]:
        root = self.root if level == 2 else f"{self.root}/{level}"
        return Sequences.load(f"{root}/pointers-of-{v}"), Sequences.load(f"{root}/children-of-{v}"), np.asarray(np.load(f"{root}/probabilities-of-{v}.npy", mmap_mode="r"))

    @lru_cache(maxsize=VOLUMES)  # noqa: B019
    def weights(self, v: int) -> np.ndarray:
        return np.asarray(np.load(f"{self.root}/3/backoff-of-{v}.npy", mmap_mode="r"))

    def volumes(self, part: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The volumes of ascending shards, and from where to where each of them is asked; -1 is in none."""
        vol = part // self.per
        cuts = np.flatnonzero(np.r_[True, vol[1:] != vol[:-1]]) if len(vol) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(vol)]):
            if vol[a] >= 0:
                yield int(vol[a]), a, b

    @staticmethod
    def child(pointers: Sequences, children: Sequences, s: np.ndarray, ctx: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words w among the children of contexts ctx of shards s, and whether they are there; (s, ctx) ascends."""
        first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (ctx[1:] != ctx[:-1])]) if len(s) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(s)])
        of, c = s[first], ctx[first]
        a, b = pointers.access(c, of), pointers.access(c + 1, of)
        base = np.where(a > 0, children.access(np.maximum(a - 1, 0), of) + 1, 0)
        i, hit = children.find(np.repeat(base, times) + w, s)
        return i, hit & (i >= np.repeat(a, times)) & (i < np.repeat(b, times))

    def pair(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probabilities of sorted distinct pairs, 0 where unseen, and their nodes (shard << 32 | place), -1 where unseen."""
        out, node = np.zeros(len(key)), np.full(len(key), -1, np.int64)
        part = np.searchsorted(self.firsts, key, side="right") - 1
        for v, a, b in self.volumes(part):
            pointers, children, levels = self.volume(v)
            u = (key[a:b] >> 32) - (self.firsts[part[a:b]] >> 32)
            at = np.flatnonzero(u < pointers.sizes[part[a:b] - v * self.per] - 1)
            u, at = u[at], a + at
            s = part[at] - v * self.per
            i, hit = self.child(pointers, children, s, u, key[at] & 0xFFFFFFFF)
            at, s, i = at[hit], s[hit], i[hit]
            out[at] = probability(levels[children.starts[s] + i])
            node[at] = part[at] << 32 | i
        return out, node

    def triple(self, node: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probabilities of words (-1: none to look up) after pairs, given by their nodes, and the weights of the shorter context."""
        seen, weight = np.zeros(len(node)), np.ones(len(node))
        order = np.argsort(node)
        node = node[order]
        for v, a, b in self.volumes(node >> 32):
            pointers, children, levels = self.volume(v, 3)
            at, s, place = order[a:b], (node[a:b] >> 32) - v * self.per, node[a:b] & 0xFFFFFFFF
            weight[at] = probability(self.weights(v)[pointers.starts[s] - s + place])  # a shard has one pointer more than pairs
            known = w[at] >= 0
            at, s, place = at[known], s[known], place[known]
            i, hit = self.child(pointers, children, s, place, w[at])
            seen[at[hit]] = probability(levels[children.starts[s[hit]] + i[hit]])
        return seen, weight


@lru_cache(maxsize=2)
def trie_at(root: str) -> Trie:
    return Trie(root)


def train(docs: DataFrame) -> str:
    """Builds the model of docs (text) in the shared folder; returns its place."""
    bounded(docs.sparkSession)
    root = posix(shared_path(docs.sparkSession, "trie"))
    n, _ = write_words(materialize(count_words(docs), "words"), root)
    if n:
        write_levels(count_triples(docs, root), root)
    else:
        with open(f"{root}/shards.json", "w") as f:
            json.dump({"volume": 1, "spans": []}, f)
        save_array(f"{root}/backoff-0.npy", np.zeros(0, np.float32))
    return root


def scored(docs: DataFrame, root: str) -> DataFrame:
    """docs without text, with n_tokens, n_known, train_tokens, base_score, score, score_3."""
    keep = [c for c in docs.columns if c != "text"]
    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"), F.lit(0.0).alias("score_3")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_at(root)
        words = trie.words
        n, v = words.total, words.n
        end = int(words.ids(word_hash([END]))[0])
        for codes, named, rows, sizes, batch in documents(batches, len(keep), SCORED):
            own = words.ids(word_hash(named))
            distinct, back = np.unique(own, return_inverse=True)
            ids, back = own[codes], back[codes]
            known = distinct >= 0
            count = np.zeros(len(distinct))
            count[known] = words.get("count", distinct[known])
            one = ((count + 0.5) / (n + 0.5 * (v + 1)))[back]
            gamma = np.ones(len(distinct))
            gamma[known] = words.get("backoff", distinct[known])
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            u = contexts(ids, end)
            u[starts] = end
            at = np.r_[0, back[:-1]]  # the context is the token before, or an end
            at[starts] = np.minimum(np.searchsorted(distinct, end), len(distinct) - 1)
            weight = np.where(u >= 0, gamma[at], 1.0)
            both = np.flatnonzero((u >= 0) & (ids >= 0))
            key, where = np.unique(u[both] << 32 | ids[both], return_inverse=True)
            seen, node = np.zeros(len(ids)), np.full(len(ids), -1, np.int64)
            found, place = trie.pair(key)
            seen[both], node[both] = found[where], place[where]
            p = seen + weight * one
            before = np.r_[-1, node[:-1]]
            before[starts] = -1
            after = np.flatnonzero(before >= 0)
            p3 = p.copy()
            seen, weight = trie.triple(before[after], np.where(node[after] >= 0, ids[after], -1))  # a triple's end is a pair that was seen
            p3[after] = seen + weight * p[after]
            sums = lambda x: np.add.reduceat(x, starts)
            made = [np.array(sizes, np.int64), sums((ids >= 0).astype(np.int64)), np.full(len(rows), n, np.int64), sums(np.log10(one)), sums(np.log10(p)), sums(np.log10(p3))]
            own = batch.slice(rows[0], len(rows)).columns[: len(keep)]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, made)], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def op9_elias_fano_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    check_columns(docs, "doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    root = train(docs.where(~held_out).select("text"))
    return scored(docs.select("doc_id", held_out.alias("held_out"), "text"), root)
