"""SimHash near-duplicates through an inverted index of fingerprint bytes with count filtering.

Two 64-bit fingerprints that differ in at most two bits share at least six of their eight positional bytes. Bytes are
paired by position; two differing bytes spoil two pairs at most, so such fingerprints agree on two of the four pairs.
The inverted index is keyed by two pairs, four positional bytes (six choices): its lists, unlike those of single bytes,
don't grow with the square of the corpus. Within a list the shared positional bytes of each pair of members are tallied,
pairs below the minimum of six go, and the rest are verified by their differing bits. A list of more than HOT members is
split first: its members are posted again under each two of the four other positions, where sharing six bytes puts a pair
in one list, so that no list exceeds 65,536 and the result is the same. Only verified pairs leave a task, and a
fingerprint has at most 2080 neighbours in two bits.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and is linked like any other;
fewer than three words make one shingle; equal fingerprints always share a component; null ids take part but
name a component only if it has no other id (then null); an empty table gives an empty result; repeated rows
are all reported; extra columns are ignored. The pipeline's near-duplicate stage has its own measure (`near_copies`).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import check_columns, load, materialize, slices
from .components import components

SHINGLE = 3
MAX_BITS = 2
MIN_MATCHES = 8 - MAX_BITS
HOT = 2_048
#: The four positions of each choice of two pairs.
CHOICES = tuple((2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(4), 2))
#: Of each choice and each two of its other positions, six positions.
FINER = tuple((*c, *more) for c in CHOICES for more in combinations([p for p in range(8) if p not in c], 2))
ROWS = 65_536
#: Pairs that a task tallies at a time.
PAIRS = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words)
    if n < shingle:
        parts = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[: n - shingle] + 1])
        parts = [joined[a:b] for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, 42) for p in parts], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), ROWS):
        ones += np.unpackbits(hashes[k : k + ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """(keep, fp): the fingerprint of every row, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=[keep, "fp"])

    kind = docs.schema[keep].dataType.simpleString()
    return docs.select(keep, "text").mapInArrow(run, f"`{keep}` {kind}, fp long")


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes agree, given the exclusive or."""
    return (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs within the lists of a sorted run of postings."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    live, d = np.arange(len(key)), 0
    while True:
        d += 1
        live = live[live + d < len(key)]
        live = live[key[live] == key[live + d]]  # the members of one list, d places apart
        if not len(live):
            break
        for k in range(0, len(live), PAIRS):
            i = live[k : k + PAIRS]
            x = fp[i] ^ fp[i + d]
            i = i[_shared_bytes(x) >= MIN_MATCHES]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= MAX_BITS]
            found.append((fp[i], fp[i + d]))
    a, b = (np.concatenate(c) for c in zip(*found))
    if not len(a):
        return a.view(np.int64), b.view(np.int64)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0].copy().view(np.int64), pairs[:, 1].copy().view(np.int64)


def _posted(choices: tuple[tuple[int, ...], ...], number: int):
    """The keys under which a fingerprint is posted: the number of a choice and the bytes at its positions."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = []
    for k, choice in enumerate(choices, number):
        key = F.lit(k << 48).cast("long")
        for slot, p in enumerate(choice):
            key = key.bitwiseOR(F.shiftleft(byte(p), 8 * slot))
        keys.append(key)
    return keys


def links(fps: DataFrame) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints fp that differ in MAX_BITS bits or fewer; a pair may come more than once."""
    postings = fps.select("fp").distinct().select("fp", F.explode(F.array(*_posted(CHOICES, 0))).alias("key"))
    hot = materialize(postings.groupBy("key").count().where(F.col("count") > HOT).select("key"), "hot")
    if hot.limit(1).count():
        finer = _posted(FINER, len(CHOICES))
        per = len(FINER) // len(CHOICES)
        of = F.element_at(F.array(*(F.array(*finer[k * per : (k + 1) * per]) for k in range(len(CHOICES)))), (F.shiftrightunsigned("key", 48) + 1).cast("int"))
        again = postings.join(hot, "key", "left_semi").select("fp", F.explode(of).alias("key"))
        postings = postings.join(hot, "key", "left_anti").select("fp", "key").unionByName(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(upto: int) -> Iterator[pa.RecordBatch]:
            a, b = _links(key[:upto], fp[:upto])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column(1).to_numpy()])
            fp = np.concatenate([fp, batch.column(0).to_numpy().view(np.uint64)])
            if len(key):
                cut = int(np.searchsorted(key, key[-1]))  # the last list may go on: at most 65,536 postings wait
                yield from out(cut)
                key, fp = key[cut:], fp[cut:]
        yield from out(len(key))

    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def grouped(fps: DataFrame) -> DataFrame:
    """fps (with fp) and root, the smallest fingerprint of its component."""
    roots = materialize(components(links(fps)), "roots")
    return fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    check_columns(docs, "doc_id", "text")
    fps = materialize(fingerprints(docs), "fingerprints")
    names = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")  # map-side combined: a hot fingerprint shrinks to a row a task
    classes = grouped(names)
    named = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    of = materialize(classes.join(named, "root").select("fp", "component_id"), "named")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
