"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted by k-means on a bounded sample (SAMPLE vectors, the first by a hash of their row); every
vector is then assigned to its nearest centroid, and its residual is coded by SUBSPACES bytes. How many lists a query probes
is measured: the true neighbours of CALIBRATION queries are found among all rows, and the probes are as many as hold
COVER of them. So clustered vectors need few lists however many there are, and vectors that fill their space evenly, where
no list says much, need many. A query looks its lists up with a table of partial distances (asymmetric: the query isn't
quantised), keeps the SHORTLIST best a group of lists, and the SHORTLIST best of all are reranked by exact distances on the
original vectors in double precision.

Lists are packed into groups of about GROUP_ROWS vectors, neighbouring lists together; a list that holds a third of all
vectors is spread over many groups by a hash of the row. Queries are met group by group in blocks of those that start from
the same group. The number of lists grows with the square root of the table up to MAX_LISTS, by which the fit is bounded.

Defined cases: rows, not ids, are queries and candidates: of repeated ids each row is asked and found on its own, and a
query is never its own candidate. Vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do those whose length isn't the most frequent one (ties: the longer), nor null ids; fewer candidates than ten are all
returned if the probes hold them; equal distances go to the smaller id; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import check_columns, load, materialize

TOP = 10
QUERY_MOD = 100
SAMPLE = 16_384
MAX_LISTS = 2_048
SUBSPACES = 32
CODEWORDS = 256
CALIBRATION = 100
COVER = 0.97
SHORTLIST = 100
GROUP_ROWS = 100_000
QUERY_BLOCK = 128


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k centroids of x by Lloyd's iterations; fewer where x has fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    r = np.random.default_rng(seed)
    c = distinct[r.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if (n == 0).any():
            c[n == 0] = distinct[r.choice(len(distinct), int((n == 0).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray, step: int = 2048) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(half - x[a : a + step] @ c.T).argmin(axis=1) for a in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


class IvfPq:
    """The fitted coarse centroids and residual codebooks."""

    def __init__(self, x: np.ndarray, n_lists: int) -> None:
        d = x.shape[1]
        self.centroids = kmeans(x, n_lists)
        residual = x - self.centroids[nearest(x, self.centroids)]
        self.cuts = [(int(a[0]), int(a[-1]) + 1) for a in np.array_split(np.arange(d), min(SUBSPACES, d))]
        self.books = [kmeans(residual[:, a:b], CODEWORDS, 8) for a, b in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centroids)
        residual = x - self.centroids[own]
        return own, np.stack([nearest(residual[:, a:b], book) for (a, b), book in zip(self.cuts, self.books)], axis=1).astype(np.uint8)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each query."""
        dist = (self.centroids * self.centroids).sum(axis=1) - 2 * q @ self.centroids.T
        n = min(n, len(self.centroids))
        return np.argsort(dist, axis=1, kind="stable")[:, :n]

    def distances(self, q: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """(query, code): squared asymmetric distances within list which."""
        residual = q - self.centroids[which]
        out = np.zeros((len(q), len(codes)), np.float32)
        for s, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            r = residual[:, a:b]
            table = (r * r).sum(axis=1)[:, None] - 2 * r @ book.T + (book * book).sum(axis=1)
            out += table.astype(np.float32)[:, codes[:, s]]
        return out


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, v): the vectors that take part, stored with a number for each row."""
    check_columns(df, id_col, vec_col)
    kind = df.schema[vec_col].dataType.elementType.simpleString()
    v = F.col(vec_col) if kind in ("float", "double") else F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(good)
    stored = materialize(kept.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "vectors")
    size = stored.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return stored.where(F.size("v") == (size.d if size else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fit(vectors: DataFrame, n_rows: int) -> IvfPq | None:
    """The index fitted on the SAMPLE vectors that come first by hash."""
    rows = vectors.select("row", "v").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()
    if not rows:
        return None
    return IvfPq(np.array([r.v for r in rows]), max(1, min(MAX_LISTS, int(math.sqrt(n_rows)), len(rows) // 8)))


def calibrated(vectors: DataFrame, queries: DataFrame, model: IvfPq, k: int) -> int:
    """Lists to probe: as many as hold COVER of the true neighbours of CALIBRATION queries among all rows."""
    asked = queries.orderBy(F.xxhash64("row"), "row").limit(CALIBRATION).select("row", "v").collect()
    if not asked:
        return 1
    q, own = np.array([r.v for r in asked], float), np.array([r.row for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dist, lists = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
        for b in batches:
            if len(b):
                x = _matrix(b.column(1)).astype(float)
                d = (x * x).sum(axis=1) - 2 * q @ x.T
                d[own[:, None] == b.column(0).to_numpy()[None, :]] = np.inf
                both = np.concatenate([dist, d], axis=1)
                at = np.concatenate([lists, np.broadcast_to(nearest(x, model.centroids), d.shape)], axis=1)
                best = np.argpartition(both, k - 1, axis=1)[:, :k]
                dist, lists = np.take_along_axis(both, best, 1), np.take_along_axis(at, best, 1)
        have = np.isfinite(dist)
        i = np.broadcast_to(np.arange(len(q))[:, None], dist.shape)[have]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(dist[have]), pa.array(lists[have])], names=["q", "d", "list"])

    near = vectors.select("row", "v").mapInArrow(run, "q long, d double, list long")
    best = near.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy("d", "list"))).where(F.col("_n") <= k).select("q", "list").collect()  # k rows a query
    order = model.probes(q, len(model.centroids))
    place = np.argsort(order, axis=1)
    needed = np.sort([place[r.q, r.list] for r in best]) if best else np.array([0])
    return int(needed[min(len(needed) - 1, math.ceil(COVER * len(needed)))]) + 1


def index_rows(vectors: DataFrame, model: IvfPq) -> DataFrame:
    """(list, row, id, code) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                own, codes = model.encode(_matrix(b.column(2)))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "row", "id", "code"])

    return vectors.select("row", "id", "v").mapInArrow(run, "list int, row long, id long, code binary")


def packed(sizes: dict[int, int], model: IvfPq) -> tuple[np.ndarray, np.ndarray]:
    """Of every list the first of its groups and how many it is spread over; small lists share one, neighbours first."""
    c = model.centroids - model.centroids.mean(axis=0)
    along = c @ np.linalg.svd(c, full_matrices=False)[2][0] if len(c) > 1 else np.zeros(len(c))
    first, parts, group, held = np.zeros(len(c), np.int64), np.ones(len(c), np.int64), 0, 0
    for k in np.argsort(along, kind="stable"):
        n = sizes.get(int(k), 0)
        if held and held + n > GROUP_ROWS:
            group, held = group + 1, 0
        first[k], parts[k] = group, max(1, -(-n // GROUP_ROWS))
        if parts[k] > 1:
            group, n = group + int(parts[k]), 0
        held += n
    return first, parts


def routed(queries: DataFrame, model: IvfPq, probes: int, first: np.ndarray, parts: np.ndarray, blocks: int) -> DataFrame:
    """(group, block, asker, query_id, q, lists): each query once for each group that holds lists that it probes."""
    names = ["group", "block", "asker", "query_id", "q", "lists"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            lists = model.probes(_matrix(b.column(2)), probes)
            take, groups, block, wanted = [], [], [], []
            for i, own in enumerate(lists):
                by: dict[int, list[int]] = {}
                for k in own.tolist():
                    for p in range(int(parts[k])):
                        by.setdefault(int(first[k]) + p, []).append(k)
                home = int(first[own[0]]) * blocks + b.column(0)[i].as_py() % blocks
                for g, w in by.items():
                    take.append(i)
                    groups.append(g)
                    block.append(home)
                    wanted.append(w)
            rows = pa.array(take)
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(block, pa.int64()), *(b.column(c).take(rows) for c in range(3)), pa.array(wanted, pa.list_(pa.int32()))], names=names)

    kind = queries.schema["v"].dataType.simpleString()
    return queries.select("row", "id", "v").mapInArrow(run, f"group long, block long, asker long, query_id long, q {kind}, lists array<int>")


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, shortlist: int = SHORTLIST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of vectors (row, id, v) to each of queries (some of them)."""
    spark = vectors.sparkSession
    n_rows = vectors.count()
    model = fit(vectors, n_rows)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    probes = calibrated(vectors, queries, model, k)
    coded = materialize(index_rows(vectors, model), "ivf")
    first, parts = packed({r[0]: r[1] for r in coded.groupBy("list").count().collect()}, model)  # one row a list: at most MAX_LISTS
    plan = F.broadcast(spark.createDataFrame(list(zip(range(len(first)), first.tolist(), parts.tolist())), "list int, first long, parts long"))
    groups = int((first + parts).max())
    asked = materialize(routed(queries, model, probes, first, parts, -(-queries.count() // (groups * QUERY_BLOCK))), "probes")
    grouped = coded.join(plan, "list").select((F.col("first") + F.pmod(F.xxhash64("row"), "parts")).alias("group"), "list", "row", "id", "code")
    met = grouped.join(asked.select(F.col("group").alias("group"), F.col("block").alias("met")).distinct(), "group")

    def scan(codes: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(codes) or not len(asks):
            return pd.DataFrame({"asker": [], "query_id": [], "row": [], "vec_id": [], "near": []})
        codes = codes.sort_values(["list", "id", "row"], kind="stable")
        ids, rows, lists = (codes[c].to_numpy() for c in ("id", "row", "list"))
        bytes_ = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(ids), -1)
        q, asker = np.array(asks["q"].tolist(), float), asks["asker"].to_numpy()
        d = np.full((len(q), len(ids)), np.inf, np.float32)
        wants: dict[int, list[int]] = {}
        for i, w in enumerate(asks["lists"]):
            for x in w:
                wants.setdefault(int(x), []).append(i)
        edges = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1], True])
        for a, b in zip(edges[:-1], edges[1:]):
            if own := wants.get(int(lists[a])):
                d[own, a:b] = model.distances(q[own], int(lists[a]), bytes_[a:b])
        d[asker[:, None] == rows[None, :]] = np.inf
        n = min(shortlist, len(ids))
        best = np.argpartition(d, n - 1, axis=1)[:, :n]
        near = np.take_along_axis(d, best, 1).reshape(-1)
        ok, at = np.isfinite(near), best.reshape(-1)
        return pd.DataFrame({"asker": np.repeat(asker, n)[ok], "query_id": np.repeat(asks["query_id"].to_numpy(), n)[ok], "row": rows[at][ok], "vec_id": ids[at][ok], "near": near[ok].astype(float)})

    found = met.groupBy("group", "met").cogroup(asked.groupBy("group", "block")).applyInPandas(scan, "asker long, query_id long, row long, vec_id long, near double")
    short = found.withColumn("_n", F.row_number().over(Window.partitionBy("asker").orderBy("near", "vec_id", "row"))).where(F.col("_n") <= shortlist).drop("near", "_n")
    gap = F.zip_with("v", "q", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    exact = short.join(vectors.select("row", "v"), "row").join(queries.select(F.col("row").alias("asker"), F.col("v").alias("q")), "asker").withColumn("score", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)))
    order = Window.partitionBy("asker").orderBy("score", "vec_id", "row")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ivf_pq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors, vectors.where(F.col("id") % QUERY_MOD == 0))
