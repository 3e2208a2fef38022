"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled documents
(PER_LANGUAGE documents a language, SAMPLE_DOCS in all and then fewer of each; WINDOWS windows of each) and labels every
byte position; a document's probabilities are the pooled log-probabilities of all its positions. Texts are cut into windows of WINDOW
bytes that the recurrences run over side by side, so a document of any length is read whole in bounded
memory and time linear in its bytes.

Defined cases: a text that is null or holds no letter is `und` with score 0; with no labelled document every
text is `und`; null languages are never learned; a language with few documents is learned from those; ties
between languages go to the smaller name; empty tables give empty results; repeated rows are labelled alike;
extra columns are ignored (query) or kept (`keep_known`). Letters are the characters of Unicode category L.

`keep_known` rejects what is `und` and what the network is less sure of, a byte, than it is of nearly all labelled
documents of that language outside its training fold; the floors cover all of those. A null lang becomes the predicted one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import check_columns, crc_mod, keep_rows, load, materialize, numbered, shielded, slices

#: Bound of the training sample: documents a language, windows of a document.
PER_LANGUAGE = 250
SAMPLE_DOCS = 50_000
WINDOWS = 3
WINDOW = 128
HIDDEN = 8
EMBED = 8
EPOCHS = 8
#: Windows that inference runs side by side.
BLOCK = 1024
_LETTER = regex.compile(r"\p{L}")


def _soft(x: np.ndarray) -> np.ndarray:
    """Softsign in place: x / (1 + |x|), which needs no transcendental function."""
    d = np.abs(x)
    d += 1.0
    x /= d
    return x


class ByteGRU:
    """Two gated recurrent layers, one in each direction, and a softmax on every position.

    Gates are 0.5 + 0.5 softsign, candidates softsign. Arrays run (time, window, hidden): a step works on all
    windows side by side.
    """

    def __init__(self, n_out: int, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) * 1.5 / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": g(257, EMBED) * 6, "V": g(2 * HIDDEN, n_out), "c": np.zeros(n_out, np.float32)}
        for d in "fb":
            for k in "zrn":
                self.p |= {f"W{k}{d}": g(EMBED, HIDDEN), f"U{k}{d}": g(HIDDEN, HIDDEN), f"a{k}{d}": np.zeros(HIDDEN, np.float32)}

    def run(self, x: np.ndarray, keep: bool = False):
        """Hidden states (2, time, window, hidden) of x (time, window) of bytes, 256 for none."""
        t, n = x.shape
        p = self.p
        out = np.zeros((2, t, n, HIDDEN), np.float32)
        saved: list[list] = [[], []]
        for k, d in enumerate("fb"):
            tz, tr, tn = (p["E"] @ p[f"W{g}{d}"] + p[f"a{g}{d}"] for g in "zrn")  # what each byte adds to a gate
            uz, ur, un = (p[f"U{g}{d}"] for g in "zrn")
            h = np.zeros((n, HIDDEN), np.float32)
            for i in range(t) if k == 0 else range(t - 1, -1, -1):
                z, r, c = tz.take(x[i], axis=0), tr.take(x[i], axis=0), tn.take(x[i], axis=0)
                z += h @ uz
                r += h @ ur
                for gate in (_soft(z), _soft(r)):
                    gate *= 0.5
                    gate += 0.5
                rh = r * h
                c += rh @ un
                _soft(c)
                if keep:
                    saved[k].append((i, h, z, r, rh, c))
                new = out[k, i]
                np.subtract(c, h, out=new)
                new *= z
                new += h
                h = new
        return (out, saved) if keep else out

    def logits(self, states: np.ndarray) -> np.ndarray:
        """(time, window, class)."""
        _, t, n, _ = states.shape
        z = states[0].reshape(-1, HIDDEN) @ self.p["V"][:HIDDEN]
        z += states[1].reshape(-1, HIDDEN) @ self.p["V"][HIDDEN:]
        z += self.p["c"]
        return z.reshape(t, n, -1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients, by backpropagation through time, of the mean cross entropy over positions that hold a byte."""
        states, saved = self.run(x, keep=True)
        p, n = self.p, x.shape[1]
        z = self.logits(states)
        z -= z.max(axis=2, keepdims=True)
        q = np.exp(z)
        q /= q.sum(axis=2, keepdims=True)
        live = (x < 256).astype(np.float32)
        own = np.arange(n)
        loss = float(-(np.log(q[:, own, y] + 1e-9) * live).sum() / live.sum())
        q[:, own, y] -= 1
        dz = q * (live / live.sum())[:, :, None]
        flat = dz.reshape(-1, dz.shape[2])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["V"] = np.concatenate([states[k].reshape(-1, HIDDEN).T @ flat for k in (0, 1)])
        g["c"] = flat.sum(axis=0)
        dgate = lambda s: 0.5 * (1 - np.abs(2 * s - 1)) ** 2
        for k, d in enumerate("fb"):
            uz, ur, un = (p[f"U{e}{d}"] for e in "zrn")
            dout = (flat @ p["V"][k * HIDDEN : (k + 1) * HIDDEN].T).reshape(*x.shape, HIDDEN)
            steps: dict[str, list] = {"z": [], "r": [], "n": []}
            order, dh = [], np.zeros((n, HIDDEN), np.float32)
            for i, h, zt, r, rh, c in reversed(saved[k]):
                dh = dh + dout[i]
                dc = dh * zt * (1 - np.abs(c)) ** 2
                dzt = dh * (c - h) * dgate(zt)
                drh = dc @ un.T
                dr = drh * h * dgate(r)
                g[f"Un{d}"] += rh.T @ dc
                g[f"Uz{d}"] += h.T @ dzt
                g[f"Ur{d}"] += h.T @ dr
                for e, v in (("z", dzt), ("r", dr), ("n", dc)):
                    steps[e].append(v)
                order.append(x[i])
                dh = dh * (1 - zt) + drh * r + dzt @ uz.T + dr @ ur.T
            bytes_ = np.concatenate(order)
            for e in "zrn":
                v = np.concatenate(steps[e])
                table = np.stack([np.bincount(bytes_, v[:, j], 257) for j in range(HIDDEN)], axis=1).astype(np.float32)
                g[f"W{e}{d}"] = p["E"].T @ table
                g[f"a{e}{d}"] = table.sum(axis=0)
                g["E"] += table @ p[f"W{e}{d}"].T
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.03, seed: int = 11) -> None:
        """Adam over windows x (window, time) with classes y."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), batch):
                pick = order[a : a + batch]
                _, g = self.gradients(np.ascontiguousarray(x[pick].T), y[pick])
                step += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                scale, lr = min(1.0, 1.0 / (norm + 1e-9)), rate * (1 - step / (total + 1))
                for k, v in g.items():
                    v = v * scale
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.01 * (v * v - s[k])
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)


def windows(text: bytes) -> np.ndarray:
    """(window, time): the text cut into windows, the last one filled with 256."""
    a = np.frombuffer(text, np.uint8).astype(np.int16)
    n = -(-len(a) // WINDOW)
    out = np.full(n * WINDOW, 256, np.int16)
    out[: len(a)] = a
    return out.reshape(n, WINDOW)


def pooled(model: ByteGRU, texts: list[bytes]) -> np.ndarray:
    """(text, class): mean log-probability over all positions of each text."""
    n_out = len(model.p["c"])
    sums, count = np.zeros((len(texts), n_out)), np.array([max(1, len(t)) for t in texts], float)
    queue, owners, held = [], [], 0

    def flush() -> None:
        x = np.ascontiguousarray(np.concatenate(queue).T.astype(np.int64))
        owner = np.concatenate(owners)
        for a in range(0, x.shape[1], BLOCK):
            part = np.ascontiguousarray(x[:, a : a + BLOCK])
            z = np.ascontiguousarray(model.logits(model.run(part)).reshape(-1, n_out).T)  # rows of one class each
            z -= z.max(axis=0)
            z -= np.log(np.exp(z).sum(axis=0))
            z *= (part < 256).reshape(-1)
            np.add.at(sums, owner[a : a + BLOCK], z.reshape(n_out, WINDOW, -1).sum(axis=1, dtype=np.float64).T)

    for i, t in enumerate(texts):
        for a in range(0, len(t), WINDOW * BLOCK):  # a very long text passes through in parts
            w = windows(t[a : a + WINDOW * BLOCK])
            queue.append(w)
            owners.append(np.full(len(w), i))
            held += len(w)
            if held >= BLOCK:
                flush()
                queue, owners, held = [], [], 0
    if held:
        flush()
    return sums / count[:, None]


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(text, lang) of the training documents: the PER_LANGUAGE first by hash of each language outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2))
    n_langs = known.agg(F.count_distinct("lang")).first()[0]
    most = max(1, min(PER_LANGUAGE, SAMPLE_DOCS // max(1, n_langs)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")  # cut to the bound a task before its shuffle
    rows = known.select("lang", "doc_id").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("lang", "doc_id").distinct()  # at most SAMPLE_DOCS ids
    # of a training document, WINDOWS windows are used; they start at its begin, middle and end
    n = F.length("text")
    piece = lambda k: F.substring("text", F.greatest(F.lit(1), ((n - WINDOW) * k / max(1, WINDOWS - 1)).cast("int") + 1), F.lit(WINDOW))
    parts = F.array(*(piece(k) for k in range(WINDOWS)))
    found = known.join(F.broadcast(rows), ["lang", "doc_id"]).select("lang", "doc_id", F.explode(F.array_distinct(parts)).alias("part"))
    return [(r.part, r.lang) for r in found.orderBy("lang", F.xxhash64("doc_id"), "doc_id", "part").limit(SAMPLE_DOCS * WINDOWS).collect()]


def train(rows: list[tuple[str, str]]) -> tuple[list[str], ByteGRU | None]:
    rows = [(t, y) for t, y in rows if t]
    langs = sorted({y for _, y in rows})
    if not langs:
        return [], None
    x = [windows(t.encode("utf-8", "replace")[:WINDOW])[0] for t, _ in rows]
    model = ByteGRU(len(langs))
    model.fit(np.array(x), np.array([langs.index(y) for _, y in rows]))
    return langs, model


def predict(texts: list[str | None], langs: list[str], model: ByteGRU | None) -> tuple[list[str], list[float], list[float]]:
    """Of each text the language, its pooled probability, and how sure the network is of it a byte (a geometric mean)."""
    blank = [not t or not _LETTER.search(t) for t in texts]
    if not langs:
        return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    z = pooled(model, [b"" if b else t.encode("utf-8", "replace") for t, b in zip(texts, blank)])
    best = z.argmax(axis=1)
    # the pooled probability: geometric means of the positions' probabilities, normalised over languages
    p = np.exp(z - z.max(axis=1, keepdims=True))
    score, sure = 1.0 / p.sum(axis=1), np.exp(z.max(axis=1))
    return ["und" if b else langs[k] for b, k in zip(blank, best)], np.where(blank, 0.0, score).tolist(), np.where(blank, 0.0, sure).tolist()


def labelled(docs: DataFrame, langs: list[str], model: ByteGRU | None) -> DataFrame:
    """docs (text last) without text, with lang_pred, score and sure."""
    keep = [c for c in docs.columns if c != "text"]
    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("sure")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pred, score, sure = predict(batch.column(len(keep)).to_pylist(), langs, model)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.float64())], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def op1_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    check_columns(docs, "doc_id", "text", "lang")
    langs, model = train(sample(docs))
    return labelled(docs.select("doc_id", "text"), langs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


#: Share of the labelled documents of a language beyond whose sureness (and MARGIN times it, as logarithms) a text is rejected.
REJECTED, MARGIN = 0.001, 1.25


def keep_known(docs: DataFrame) -> DataFrame:
    """docs whose language is known: those labelled `und`, or surer than which nearly all documents of the language are, go."""
    check_columns(docs, "doc_id", "text", "lang")
    return shielded(docs, ("doc_id", "text", "lang"), _kept)


def _kept(docs: DataFrame) -> DataFrame:
    cols = docs.columns
    rows = numbered(docs)
    langs, model = train(sample(docs))
    if not langs:  # nothing was learned: only texts without a letter are known to be none
        return docs.where(F.col("text").rlike(r"\p{L}"))
    held = (crc_mod(F.col("doc_id"), 4) == 2).alias("held")
    found = materialize(labelled(rows.select("_f", "_r", "lang", held, "text"), langs, model), "languages")
    own = found.where("held AND lang = lang_pred AND sure > 0")
    floors = own.groupBy("lang_pred").agg((F.percentile_approx(F.log("sure"), REJECTED, 10_000) * MARGIN).alias("floor"))
    sure = found.where("lang_pred != 'und'").join(floors, "lang_pred", "left").where(F.col("floor").isNull() | (F.log("sure") >= F.col("floor")))
    known = keep_rows(rows, sure.select("_f", "_r", "lang_pred"), cols, "lang_pred")
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*cols)
