"""SentencePiece encoding and decoding over a relational lattice.

Words (runs of word marks and what follows them; no piece of the model crosses their borders) are counted over
all texts. The lattice of the most frequent ones (those of a count that leaves DICTIONARY words at most) is built
relationally: substrings up to the length of the longest piece are exploded and equi-joined to the piece table, edges are
grouped by word, and a higher-order aggregate folds them: by Viterbi for unigram models; for BPE models, whose segmentation
no sum of scores gives, the fold merges, best rank first, and so returns what the model's own merges do. The piece table is
bounded by the model (broadcast), the dictionary by its size. All other words, and words longer than LATTICE_CHARS, are
folded by the same rules where they are met, those of a slice of rows side by side (`Pieces.fold_many`), so every text is
encoded whole; no text is shuffled. The relational fold costs about a hundred times as much a word, which is why it isn't
run for words that occur once.

Defined cases: null and empty texts have no pieces and decode to the empty text; characters without a piece
become byte pieces; a literal word mark decodes to a space, as it does for the model; repeated rows are
encoded alike; an empty table gives an empty result; extra columns are ignored (query) or kept (`encode`).
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, check_columns, drop_table, load, materialize, posix, shared_path, slices, small_table, tidy

MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
DICTIONARY = 200_000
LATTICE_CHARS = 32
UNKNOWN_PENALTY = 10.0
#: Words folded since that a worker keeps.
MORE_WORDS = 60_000


def _key(word: str) -> str:
    return word[1:] if word[0] == MARK and MARK not in word[1:] else "\n" + word


def _word(key: str) -> str:
    return key[1:] if key[:1] == "\n" else MARK + key


def _slot(key: np.ndarray, bits: int, turn: int) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)[turn % 2] + 2 * turn)) >> np.uint64(64 - bits)).astype(np.int64)


class Pieces:
    """A model's pieces: those that text can match with their scores, and the byte pieces."""

    def __init__(self, model_file: str | None = MODEL, model_proto: bytes | None = None) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto) if model_proto else sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sp.serialized_model_proto()
        self.unigram = _model_type(proto) == 1
        self.names = [sp.id_to_piece(i) for i in range(len(sp))]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(len(sp))]
        self.ids = {p: i for i, p in enumerate(self.names) if not special[i]}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.first_byte = sp.piece_to_id("<0x00>")
        self.unknown_id = sp.unk_id()
        self.longest = max(map(len, self.ids))
        self.floor = min(self.scores.values()) - UNKNOWN_PENALTY
        self.raw = [bytes([i - self.first_byte]) if sp.is_byte(i) else (b"" if special[i] else p.replace(MARK, " ").encode()) for i, p in enumerate(self.names)]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece of this model crosses word borders")
        alone = "".join(c for c in "\n\t" if not any(c in p and len(p) > 1 for p in self.ids))
        one = f"|[{alone}]" if alone else ""
        self.words = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+{one}")
        self.alone = alone

    def bytes_of(self, c: str) -> list[int]:
        if self.first_byte == self.unknown_id:
            return [self.unknown_id]
        return [self.first_byte + b for b in c.encode("utf-8", "replace")]

    def split(self, text: str | None) -> list[str]:
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def fold(self, word: str) -> list[int]:
        """The ids of a word, by the same rules as the relational folds."""
        return self._viterbi(word) if self.unigram else self._merge(word)

    def _viterbi(self, w: str) -> list[int]:
        n = len(w)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-float("inf"), 0)] * n
        for s in range(n):
            for e in range(s + 1, min(n, s + self.longest) + 1):
                score = self.scores.get(w[s:e], self.floor if e == s + 1 else None)
                if score is not None and best[s][0] + score > best[e][0]:
                    best[e] = (best[s][0] + score, s)
        out: list[list[int]] = []
        e = n
        while e:
            s = best[e][1]
            out.append([self.ids[w[s:e]]] if w[s:e] in self.ids else self.bytes_of(w[s:e]))
            e = s
        return list(chain.from_iterable(reversed(out)))

    def _merge(self, w: str) -> list[int]:
        n, scores = len(w), self.scores
        if w in scores and n == 1:
            return [self.ids[w]]
        parts: list[str] = list(w)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-scores[p], i, p) for i in range(n - 1) if (p := w[i : i + 2]) in scores]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := p + parts[k]) in scores:
                    heapq.heappush(heap, (-scores[q], i, q))
            if (k := before[i]) >= 0 and (q := parts[k] + p) in scores:
                heapq.heappush(heap, (-scores[q], k, q))
        return list(chain.from_iterable([self.ids[p]] if p in self.ids else self.bytes_of(p) for p in parts if p))

    def keys(self, text: str | None) -> list[str]:
        """The words of a text by name: bare after a single mark, else with a line break before."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        out: list[str] = []
        for i, line in enumerate(text.split("\n") if "\n" in self.alone else [text]):
            if i:
                out.append("\n\n")
            if "  " in line or ("\t" in self.alone and "\t" in line) or (not i and line[:1] == " "):
                out += map(_key, self.words.findall(MARK * (not i) + line.replace(" ", MARK)))
                continue
            parts = line.split(" ")
            if i:  # no mark before the first word of a line
                if parts[0]:
                    parts[0] = "\n" + parts[0]
                else:
                    del parts[0]
            out += parts
        return out

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, list[tuple[np.ndarray, int]], np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of characters, hash tables of the pairs of symbols that merge, and of each pair its key, rank and result."""
        symbols = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - symbols.keys()):
            symbols[c] = len(self.names) + len(symbols)  # characters that are no pieces but parts of some
        rank = {v: k for k, v in enumerate(sorted(set(self.scores.values())))}
        made = [(symbols[p[:k]] << 24 | symbols[p[k:]], rank[self.scores[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        key, order, result = (np.array(x, np.int64) for x in zip(*made))
        of = np.full(0x110000, -1, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                of[ord(c)] = i
        tables, left, bits = [], np.arange(len(key)), 22
        while len(left):  # what collides goes on to the next table
            table = np.full(1 << bits, -1, np.int32)
            h = _slot(key[left], bits, len(tables))
            table[h] = left
            left = left[table[h] != left]
            tables.append((table, bits))
            bits = 16
        return of, tables, key, order.astype(np.int32), result.astype(np.int32)

    def fold_many(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, as the bytes of 32-bit numbers: merges run over all words of like length at once."""
        long = words if self.unigram else [w for w in words if len(w) > 64]
        out = {w: np.array(self.fold(w), np.int32).tobytes() for w in long}
        if self.unigram:
            return out
        short = sorted((w for w in words if len(w) <= 64), key=len)
        a = 0
        while a < len(short):
            b = min(len(short), a + 20_000)
            while b - a > 1 and (b - a) * len(short[b - 1]) > 400_000:
                b = (a + b) // 2
            self._merge_many(short[a:b], out)
            a = b
        return out

    def _found(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of symbols that follow each other, the rank of their merge, -1 where they don't, and what it makes."""
        _, tables, keys, ranks, results = self._pairs
        key = a.astype(np.int64) << 24 | b
        at = tables[0][0][_slot(key, tables[0][1], 0)]
        miss = np.flatnonzero((at >= 0) & (keys[at] != key))
        at[miss] = -1
        for k, (table, bits) in enumerate(tables[1:], 1):
            found = table[_slot(key[miss], bits, k)]
            hit = (found >= 0) & (keys[found] == key[miss])
            at[miss[hit]] = found[hit]
        rank = ranks[at]
        rank[at < 0] = -1
        return rank, results[at]

    def _merge_many(self, words: list[str], out: dict[str, bytes]) -> None:
        size = np.fromiter(map(len, words), np.int64, len(words))
        n, width = len(words), int(size[-1]) + 1  # a column stands behind the words, where links end
        sym = self._pairs[0][np.frombuffer("".join([w.ljust(width) for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)]
        inside = np.arange(width) < size[:, None]
        sym[~inside] = -2
        rank = np.full((n, width), -1, np.int32)
        made = np.zeros((n, width), np.int32)
        r, m = self._found(sym[:, :-1].reshape(-1), sym[:, 1:].reshape(-1))
        rank[:, :-1], made[:, :-1] = r.reshape(n, -1), m.reshape(n, -1)
        sym, rank, made, head = (x.reshape(-1) for x in (sym, rank, made, inside))
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), n)
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), n)
        before[::width] = width - 1
        live = np.arange(n) * width
        while len(live):
            best = rank.reshape(n, width)[live // width].argmax(axis=1) if len(live) < n else rank.reshape(n, width).argmax(axis=1)
            at = live + best
            open_ = rank[at] >= 0
            live, at = live[open_], at[open_]
            gone = live + after[at]
            nxt, prev = after[gone], before[at]
            sym[at] = made[at]
            head[gone] = False
            rank[gone] = -1
            after[at] = nxt
            right, left = live + np.minimum(nxt, width - 1), live + prev
            before[right] = at - live
            rank[at], made[at] = self._found(sym[at], sym[right])
            rank[left], made[left] = self._found(sym[left], sym[at])
        head = head.reshape(n, width)
        part = sym.reshape(n, width)
        ends = (np.cumsum(head.sum(axis=1)) * 4).tolist()
        flat = part[head].tobytes()
        plain = (((part >= 0) & (part < len(self.names))) | ~head).all(axis=1)
        out.update(zip(words, map(flat.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        for i in np.flatnonzero(~plain).tolist():
            out[words[i]] = np.array(self.fold(words[i]), np.int32).tobytes()

    @cached_property
    def _raw(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        return np.frombuffer(b"".join(self.raw), np.uint8), np.cumsum(size) - size, size

    def decode_many(self, words: list[bytes]) -> list[bytes]:
        """The bytes that the pieces of each word (ids as 32-bit numbers) decode to."""
        raw, start, size = self._raw
        ids = np.frombuffer(b"".join(words), np.int32)
        own = size[ids]
        ends = np.cumsum(own)
        out = raw[np.repeat(start[ids] - ends + own, own) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // 4
        cut = np.r_[0, ends][last].tolist()
        return [out[x:y] for x, y in zip([0, *cut], cut)]

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _model_type(proto: bytes) -> int:
    """trainer_spec.model_type (field 2, in it field 3) of a serialised model; 1 is unigram, 2 is BPE."""

    def fields(b: bytes) -> Iterator[tuple[int, object]]:
        i = 0

        def varint() -> int:
            nonlocal i
            v = s = 0
            while True:
                c = b[i]
                i += 1
                v |= (c & 127) << s
                s += 7
                if c < 128:
                    return v

        while i < len(b):
            tag = varint()
            if tag & 7 == 0:
                yield tag >> 3, varint()
            elif tag & 7 == 2:
                n = varint()
                yield tag >> 3, b[i : i + n]
                i += n
            else:
                i += 8 if tag & 7 == 1 else 4

    for k, v in fields(proto):
        if k == 2 and isinstance(v, bytes):
            return next((x for f, x in fields(v) if f == 3), 1)
    return 1


@lru_cache(maxsize=4)
def pieces_at(model: str) -> Pieces:
    return Pieces(model)


def count_words(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, n) over all texts, counted map-side first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary_at.cache_clear()  # a worker may hold that of an earlier table
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(map(_word, seen)), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        for batch in slices(batches):
            for t in batch.column(0):
                seen.update(pieces.keys(t.as_py()))
                if len(seen) > 100_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, edges): of each distinct word, the substrings that are pieces as (s, e, score, id), end exclusive."""
    spark = words.sparkSession
    table = F.broadcast(small_table(spark, [(p, i, float(pieces.scores[p])) for p, i in pieces.ids.items()], ["piece", "id", "score"], [pa.string(), pa.int32(), pa.float64()]))  # bounded by the model
    spans = words.select("word", F.length("word").alias("l")).select("word", "l", F.explode(F.sequence(F.lit(0), F.col("l") - 1)).alias("s"))
    spans = spans.select("word", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("l"), F.col("s") + pieces.longest))).alias("e"))
    edges = spans.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s"))).join(table, "piece")
    return words.select("word").join(edges.groupBy("word").agg(F.collect_list(F.struct("s", "e", "score", "id")).alias("edges")), "word", "left").withColumn("edges", F.coalesce("edges", F.expr("cast(array() AS array<struct<s:int,e:int,score:double,id:int>>)")))


#: The fold of a unigram lattice: at each end the best (score, start), the longer last piece among equals.
_VITERBI = """
aggregate(sequence(1, length(word)), array(struct(0D AS v, 0 AS s)), (st, k) -> concat(st, array(element_at(transform(array(
  array_max(concat(
    transform(filter(edges, x -> x.e = k), x -> struct(element_at(st, x.s + 1).v + x.score AS v, -x.s AS s)),
    CASE WHEN exists(edges, x -> x.e = k AND x.s = k - 1) THEN cast(array() AS array<struct<v:double,s:int>>)
         ELSE array(struct(element_at(st, k).v + {floor} AS v, 1 - k AS s)) END))), t -> struct(t.v AS v, -t.s AS s)), 1))))
"""
_BACK = "aggregate(sequence(1, length(word)), array(length(word)), (b, k) -> CASE WHEN b[0] = 0 THEN b ELSE concat(array(_path[b[0]].s), b) END)"
#: The fold of a BPE lattice: among edges that join two neighbours, the best rank, leftmost, removes the border between.
_MERGE = """
aggregate(sequence(1, length(word)), sequence(0, length(word)), (b, k) -> element_at(transform(array(array_max(transform(
    filter(edges, x -> x.e - x.s > 1 AND array_contains(b, x.s) AND array_contains(b, x.e) AND size(filter(b, y -> y > x.s AND y < x.e)) = 1),
    x -> struct(x.score AS v, -x.s AS s, x.e AS e)))),
  t -> CASE WHEN t IS NULL THEN b ELSE filter(b, y -> y <= -t.s OR y >= t.e) END), 1))
"""
_IDS = """
flatten(transform(slice(_cuts, 1, size(_cuts) - 1), (a, i) -> element_at(transform(array(filter(edges, x -> x.s = a AND x.e = _cuts[i + 1])), f ->
  CASE WHEN size(f) > 0 THEN array(f[0].id)
       ELSE transform(sequence(1, octet_length(substring(word, a + 1, 1))), j -> cast(conv(substring(hex(encode(substring(word, a + 1, 1), 'UTF-8')), 2 * j - 1, 2), 16, 10) AS int) + {first}) END), 1)))
"""


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of distinct words, by folding their lattices."""
    df = lattice(words, pieces)
    if pieces.unigram:
        df = df.withColumn("_path", F.expr(_VITERBI.format(floor=f"{pieces.floor}D"))).withColumn("_cuts", F.expr(_BACK))
    else:
        df = df.withColumn("_cuts", F.expr(_MERGE))
    return df.select("word", F.expr(_IDS.format(first=pieces.first_byte)).alias("ids"))


def dictionary(docs: DataFrame, pieces: Pieces) -> str:
    """Encodes the most frequent words; returns the place of the (word, ids) table."""
    step = F.floor(F.log("n") * 32)
    counts = materialize(count_words(docs, pieces).where(F.length("word") <= LATTICE_CHARS).withColumn("step", step), "words")
    least, words = None, 0
    for s, n in sorted(counts.groupBy("step").count().collect(), reverse=True):  # some hundred steps of the logarithm
        words += n
        if words > DICTIONARY:
            break
        least = s
    top = counts.where(F.col("step") >= least) if least is not None else counts.where("false")
    path = shared_path(docs.sparkSession, "pieces")
    encode_words(top.select("word").repartition(docs.sparkSession.sparkContext.defaultParallelism, "word"), pieces).write.parquet(path)
    drop_table(counts)
    return path


@lru_cache(maxsize=1)
def dictionary_at(path: str) -> dict[str, bytes]:
    """The ids, as the bytes of 32-bit numbers, of the dictionary's words by name."""
    fs, root = (pafs.LocalFileSystem(), posix(path)) if "://" not in path or path.startswith("file:") else pafs.FileSystem.from_uri(path)
    t = pads.dataset(root, filesystem=fs, format="parquet").to_table()
    out = {}
    for b in t.to_batches():
        ids = b.column(1).flatten().to_numpy().astype(np.int32).tobytes()
        ends = (np.cumsum(b.column(1).value_lengths().to_numpy()) * 4).tolist()
        out |= {_key(w): ids[x:y] for w, x, y in zip(b.column(0).to_pylist(), [0, *ends], ends)}
    return out


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """docs without text, with ids (the whole text's pieces) and decoded_sha256 (of the bytes that they decode to)."""
    bounded(docs.sparkSession)
    path = dictionary(docs, pieces)
    keep = [c for c in docs.columns if c != "text"]
    schema = docs.select(*keep, F.array().cast("array<int>").alias("ids"), F.lit("").alias("decoded_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, base_raw = dictionary_at(path), None
        known: dict[str, bytes] = {}
        decoded: dict[str, bytes] = {}
        for batch in slices(batches):
            if base_raw is None:
                base_raw = dict(zip(base, pieces.decode_many(list(base.values()))))
            if not known or len(known) > len(base) + MORE_WORDS:
                known, decoded = dict(base), dict(base_raw)
            words = [pieces.keys(t.as_py()) for t in batch.column(len(keep))]
            new = list(set(chain.from_iterable(words)).difference(known))
            named = list(map(_word, new))
            ids_of = list(map(pieces.fold_many(named).__getitem__, named))
            known.update(zip(new, ids_of))
            decoded.update(zip(new, pieces.decode_many(ids_of)))
            sizes, shas, flat = [0], [], []
            for own in words:
                ids = b"".join(map(known.__getitem__, own))
                raw = b"".join(map(decoded.__getitem__, own))
                shas.append(hashlib.sha256(raw[1:] if raw.startswith(b" ") else raw).hexdigest())
                flat.append(ids)
                sizes.append(sizes[-1] + len(ids) // 4)
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists, pa.array(shas, pa.string())], names=schema.names)
        del base, base_raw, known, decoded
        tidy()

    return docs.select(*keep, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """encoded (ids) with text."""
    at = encoded.columns.index("ids")
    schema = encoded.withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if i is None else pieces.decode(i) for i in b.column(at).to_pylist()], pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def op6_sentencepiece_lattice(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    check_columns(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.sha2(F.replace(text, F.lit(MARK), F.lit(" ")), 256).alias("_sha"), "text")
    return encode(keyed, pieces_at(model)).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), (F.col("decoded_sha256") == F.col("_sha")).alias("round_trip"), "ids")
