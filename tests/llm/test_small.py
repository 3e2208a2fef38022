"""Brute-force and edge-case tests of the corpus operators on small tables."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import ann, elias_fano, langid, mixing, near_copies, ngram_lm, pii, quality, registry, sentencepieces, sharding, simhash, suffix_dedup
from quarry.llm.common import posix, side_rows, side_table
from quarry.llm.elias_fano import EliasFano
from quarry.llm.suffixes import permuted_lcp, suffix_array

WORDS = "the of and to in was he it for on river stone cloud garden paper window little winter music north".split()
FRENCH = "le la les des une dans avec pour être rivière pierre nuage jardin papier fenêtre petit hiver musique été".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, _source string, score double"


def text(r, n, words=WORDS):
    return " ".join(r.choice(words) for _ in range(n))


def table():
    r = random.Random(4)
    rows = []
    for i in range(60):
        fr = i % 3 == 0
        rows.append((i, text(r, r.randint(60, 120), FRENCH if fr else WORDS), "fr" if fr else "en", f"s{i % 4}" if i % 7 else None))
    rows += [(100, None, "en", "s0"), (101, "", "en", "s0"), (102, "  \n\t ", None, "s1"), (103, "12 34 !!", "en", "s1"), (104, rows[3][1], "en", "s2"), (104, rows[3][1], "en", "s2"), (105, rows[5][1] + " tail", None, None), (None, "some words without an id", "en", "s3"), (106, "x" * 30_000, "en", "s0"), (107, text(r, 8000), "en", "s0"), (108, "one two", "en", "s1")]
    return [(*x, len(x[1] or ""), 1, 2, "clash", 0.5) for x in rows]


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    """A folder with small tables of all edge cases, and one with empty tables."""
    root = tmp_path_factory.mktemp("tables")
    r = random.Random(9)
    docs = spark.createDataFrame(table(), SCHEMA)
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    vectors += [(300, vectors[0][1]), (400, None), (401, [0.0] * 8), (402, [1.0, float("nan")] + [0.0] * 6), (403, [1.0, 2.0]), (404, [None] + [1.0] * 7), (None, vectors[1][1])]
    emb = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(104, 0, 0), (None, 1, 0), (999, 1, None)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("embeddings", emb), ("labels", labels)):
        df.repartition(3).write.parquet(f"{root}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
    return root


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, home, name):
    assert registry.queries()[name](spark, f"{home}/empty").collect() == []


def rows_of(spark, home, name):
    return registry.queries()[name](spark, f"{home}/full").collect()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_language(spark, home):
    got = rows_of(spark, home, "op1_byte_gru_language")
    assert len(got) == len(table())
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    by = {r.doc_id: r.lang_pred for r in got}
    assert all(by[i] == "und" for i in (100, 101, 102, 103))
    assert np.mean([by[i] == ("fr" if i % 3 == 0 else "en") for i in range(60)]) > 0.95


def test_letters_by_category():
    assert langid.predict(["½ ²", "é", "", None, "12 ٣"], ["en"], langid.ByteGRU(1))[0] == ["und", "en", "und", "und", "und"]


def test_unknown_languages_go(spark, home, tmp_path):
    docs = spark.read.parquet(f"{home}/full/documents.parquet")
    out = langid.keep_known(docs)
    got = out.collect()
    assert out.columns == docs.columns
    ids = [r.doc_id for r in got]
    assert not {100, 101, 102, 103} & set(ids) and sum(i is not None and i < 60 for i in ids) >= 58
    texts = {r[0]: r[1] for r in table()}
    assert all(r.text == texts[r.doc_id] and r.lang for r in got)
    assert langid.keep_known(spark.read.parquet(f"{home}/empty/documents.parquet")).collect() == []
    spark.createDataFrame([(1, "no label", None), (2, "12", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/d")
    assert [r.doc_id for r in langid.keep_known(spark.read.parquet(f"{tmp_path}/d")).collect()] == [1]


CLASH = ["_f", "_r", "_k", "_who", "_c", "_rid", "size", "held", "sure", "lang_pred", "n", "low"]


@pytest.mark.parametrize("stage", [langid.keep_known, near_copies.deduplicate, pii.redact, mixing.mix_documents])
def test_stages_with_clashing_names(spark, tmp_path, stage):
    rows = [(i, text(random.Random(i % 5), 60), "en", "s", *range(len(CLASH))) for i in range(12)]
    kind = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} long" for c in CLASH)
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    out = stage(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all([r[c] for c in CLASH] == list(range(len(CLASH))) for r in got)
    assert stage(docs.where("false")).collect() == []


def test_gru_gradients():
    m = langid.ByteGRU(2)
    x = np.random.default_rng(0).integers(0, 257, (9, 5))
    y = np.array([0, 1, 0, 1, 1])
    _, g = m.gradients(x, y)
    for k in ("E", "V", "Uzf", "Unb", "Wrf", "anb"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, e = m.p[k][i], 1e-2
        m.p[k][i] = old + e
        a = m.gradients(x, y)[0]
        m.p[k][i] = old - e
        b = m.gradients(x, y)[0]
        m.p[k][i] = old
        assert abs((a - b) / 2 / e - g[k][i]) < 2e-3


def test_neighbours(spark, home):
    got = rows_of(spark, home, "op2_ivf_pq_neighbours")
    v = {r.vec_id: r.embedding for r in spark.read.parquet(f"{home}/full/embeddings.parquet").collect() if r.vec_id is not None and r.vec_id <= 300}
    for query in (0, 100, 200, 300):
        d = sorted((math.dist(v[query], v[i]), i) for i in v if i != query)[:10]
        own = sorted((r for r in got if r.query_id == query), key=lambda r: r["rank"])
        assert [r.vec_id for r in own] == [i for _, i in d] and all(abs(r.score - s) < 1e-9 for r, (s, _) in zip(own, d))
    assert len(got) == 40


def test_neighbours_by_lists_and_rows(spark, tmp_path, monkeypatch):
    """Recall against brute force where lists are probed and groups are many; rows of one id are asked on their own."""
    monkeypatch.setattr(ann, "GROUP_ROWS", 700)
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16)) * 3
    x = (centres[r.integers(0, 12, 3000)] + r.normal(size=(3000, 16))).astype(np.float32)
    ids = [*range(2998), 100, 100]
    spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    v = ann.usable(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), "vec_id", "embedding")
    model = ann.fit(v, 3000)
    assert ann.calibrated(v, v.where("id % 100 = 0"), model, 10) < len(model.centroids) / 2
    got: dict = {}
    for row in ann.op2_ivf_pq_neighbours(spark, str(tmp_path)).collect():
        got.setdefault(row.query_id, []).append(row)
    assert len(got[100]) == 30 and all(len(w) == 10 for q, w in got.items() if q != 100)
    hits = 0
    for q in [q for q in got if q != 100]:
        d = ((x.astype(float) - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        own = sorted(got[q], key=lambda w: w["rank"])
        hits += len({w.vec_id for w in own} & {ids[k] for k in np.argsort(d, kind="stable")[:10]})
        assert [w["rank"] for w in own] == list(range(1, 11)) and all(a.score <= b.score for a, b in zip(own, own[1:]))
    assert hits >= 0.9 * 10 * (len(got) - 1)


def fingerprint(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, home):
    got = rows_of(spark, home, "op3_simhash_groups")
    t = {r[0]: r[1] for r in table()}
    assert len(got) == len(table())
    ids = sorted((i for i in t if i is not None))
    fp = {i: fingerprint(t[i]) for i in t}
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (fp[a] ^ fp[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    for r in got:
        assert r.fingerprint == f"{fp[r.doc_id]:016x}"
        if r.doc_id is not None:
            assert r.component_id == root[r.doc_id]


def test_one_document_of_each_group_stays(spark, home):
    docs = spark.read.parquet(f"{home}/full/documents.parquet")
    out = near_copies.deduplicate(docs)
    assert out.columns == docs.columns
    roots = {r.doc_id: r.component_id for r in rows_of(spark, home, "op3_simhash_groups") if r.doc_id is not None}
    got = out.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(set(roots.values()))
    texts = {r[0]: r[1] for r in table()}
    assert all(r.text == texts[r.doc_id] for r in got)
    assert near_copies.deduplicate(spark.read.parquet(f"{home}/empty/documents.parquet")).collect() == []


@pytest.mark.parametrize("hot", [2048, 5])
def test_links(spark, monkeypatch, hot):
    """Against all pairs; hot=5 splits most lists."""
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 3))) for b in base for _ in range(12)} | {(7 << 32) | k for k in range(200)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {tuple(sorted((x.a % (1 << 64), x.b % (1 << 64)))) for x in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    assert got == {(x, y) for i, x in enumerate(fps) for y in fps[i + 1 :] if (x ^ y).bit_count() <= 2}


def test_mix(spark, home):
    got = rows_of(spark, home, "op4_mix_sources")
    again = rows_of(spark, home, "op4_mix_sources")
    key = lambda r: repr(tuple(r))
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(table())
    size = Counter()
    for r in table():
        size[r[3]] += len(words(r[1]))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in full)
        level = left / sum(weight[s] for s in order if s not in full)
        new = {s for s in order if s not in full and level * weight[s] > 3 * size[s]}
        if not new:
            break
        full |= new
    want = {s: 3 * size[s] if s in full else level * weight[s] for s in order}
    taken = Counter()
    for r in got:
        s = next(s for s in order if size[s] == r.source_size)
        assert abs(r.target - want[s]) < 1e-6 * want[s] and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)


def test_mixed_documents_follow_the_plan(spark, home):
    docs = spark.read.parquet(f"{home}/full/documents.parquet")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    times = Counter((r.doc_id, r.text) for r in out.collect())
    plan: dict = {}
    for r in rows_of(spark, home, "op4_mix_sources"):
        plan.setdefault((r.doc_id, r["size"]), []).append(r)
    for (i, t), n in times.items():
        own = plan[i, len(words(t))]
        exact = sum(r.taken / r["size"] for r in own)
        assert abs(n - exact) <= 0.5 * len(own) + 1e-9 and (exact % 1 or n == exact)
    assert all(times[r.doc_id, r.text] for r in docs.collect() if sum(p.taken for p in plan[r.doc_id, len(words(r.text))]) > 0.5 * max(1, len(words(r.text))))


def test_shards(spark, home):
    got = rows_of(spark, home, "op5_hypergeometric_shards")
    assert len(got) == len(table())
    n = Counter(r.shard for r in got)
    sizes = [n[s] for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n[s])) for s in n)
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in table())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_communication_matrix_is_uniform():
    counts = [5, 0, 9, 2]
    seen = np.mean([sharding.communication_matrix(counts, 4, s) for s in range(3000)], axis=0)
    assert np.allclose(seen, np.array(counts)[:, None] / 4, atol=0.1)
    big = [sharding.hypergeometric(np.random.default_rng(s), 10**9, 10**9, 1000) for s in range(400)]
    assert abs(np.mean(big) - 500) < 4 and 11 < np.std(big) < 21


def test_pieces_round_trip(spark, home):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepieces.MODEL)
    got = {r.doc_id: r for r in rows_of(spark, home, "op6_sentencepiece_lattice")}
    for r in table():
        assert list(got[r[0]].ids) == sp.encode(r[1] or "") and got[r[0]].round_trip


def test_words_folded_together():
    p = sentencepieces.Pieces()
    r = random.Random(8)
    texts = ["".join(r.choice("ab ▁ \n\té😀\x00<0x1>word the") for _ in range(r.randint(0, 60))) for _ in range(2000)] + ["x" * 5000, " a  b \n\n c"]
    for t in texts:
        assert [sentencepieces._word(k) for k in p.keys(t)] == p.split(t)
    ws = sorted({w for t in texts for w in p.split(t)})
    got = p.fold_many(ws)
    assert all(np.frombuffer(got[w], np.int32).tolist() == p.fold(w) for w in ws)


def test_lattice_folds(spark):
    p = sentencepieces.Pieces()
    r = random.Random(3)
    ws = sorted({w for _ in range(150) for w in p.split("".join(r.choice("abeinot é😀\n<0x1>") for _ in range(12)))})
    for unigram in (False, True):
        p.unigram = unigram
        got = {x.word: list(x.ids) for x in sentencepieces.encode_words(spark.createDataFrame([(w,) for w in ws], "word string"), p).collect()}
        assert got == {w: p.fold(w) for w in ws}


def counts(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if words(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, home):
    got = rows_of(spark, home, "op7_risk_controlled_quality")
    t = {r[0]: r[1] for r in table()}
    for r in got:
        c = counts(t[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_collision_path(spark, monkeypatch):
    """With one hash bit left nearly every window collides, and the exact path counts."""
    layers = quality.repeat_words()
    r = random.Random(1)
    texts = [text(r, n, WORDS[:4]) for n in (3, 4, 9, 40)] + ["a a a a a a", ""]
    df = spark.createDataFrame([(x,) for x in texts], "text string").selectExpr("text", "array_remove(split(text, ' '), '') AS words")
    for k, layer in enumerate(layers):
        if k == 2:
            df = df.selectExpr("*", "CASE WHEN size(words) > 3 THEN sort_array(transform(slice(words, 1, size(words) - 2), (w, i) -> shiftleft(1L, _bits) | i)) ELSE cast(array() AS array<bigint>) END AS _s")
            continue
        df = df.withColumns(layer)
    assert {x.text: x.n_repeat_words for x in df.collect()} == {x: counts(x)[4] for x in texts}


def measured_docs(spark, path, rows):
    """As the query does: tables are stored, and so are the counts of the documents."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    return quality.materialize(quality.measure(spark.read.parquet(path)), "measured")


def test_repeated_labels_certify_nothing(spark, tmp_path):
    """Forty good documents are too few for any level, however often their labels or texts repeat."""
    for copies in (1, 32):
        measured = measured_docs(spark, f"{tmp_path}/{copies}", [(i + 1000 * k, text(random.Random(i), 80), "en") for i in range(40) for k in range(copies)])
        labels = spark.createDataFrame([(i + 1000 * k, 1) for i in range(40) for k in range(copies)] * copies, "doc_id long, quality int")
        assert quality.cutoffs(measured, labels).collect() == []


def test_certified_cutoffs(spark, tmp_path):
    """Every document's verdict against cutoffs and binomial tails counted apart, with numbers of hits on both sides of the bound."""
    r = random.Random(11)
    docs = [(i, text(r, 60) + (" ####" * r.randint(0, 2) if i % 10 == 0 else "") + (" $$$$$$$$$$$$" * 20 if i % 50 == 7 else ""), "en") for i in range(2400)]
    measured = measured_docs(spark, f"{tmp_path}/d", docs)
    labels = spark.createDataFrame([(i, int(i % 50 != 7)) for i, *_ in docs], "doc_id long, quality int")
    cut = quality.cutoffs(measured, labels).collect()
    kept = {x.doc_id: x.kept for x in quality.judge(measured, spark.createDataFrame(cut)).collect()}
    assert len(cut) == 1
    good = [i for i, *_ in docs if i % 50 != 7]
    assert sum(not kept[i] for i in good) <= quality.ALPHA * len(good) and not any(kept[i] for i, *_ in docs if i % 50 == 7)


def test_binomial_tail(spark):
    df = spark.createDataFrame([(100, 0), (100, 3), (5000, 60), (900, 900), (400_000, 7_900)], "n long, x long").select("n", "x", quality.binomial_cdf("n", "x", 0.02).alias("p"))
    for r in df.collect():
        want = sum(math.comb(r.n, k) * 0.02**k * 0.98 ** (r.n - k) for k in range(r.x + 1)) if r.n < 1000 else None
        assert 0 <= r.p <= 1 and (want is None or abs(r.p - want) < 1e-9)


def base(t):
    d = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d(m[0])) <= 19 and pii.luhn(d(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(d(m[0])) <= 15]


def test_base_spans():
    r = random.Random(5)
    for _ in range(4000):
        t = "".join(r.choice("1.@a+- 2(4é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == base(t)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_personal_data(spark):
    t = 'mail a.b@c.org or token = "9f8e7d6c5b4a39281706f5e4d3c2b1a0" from 10.0.0.1 call +1 (555) 123-4567'
    docs = spark.createDataFrame([(1, t), (2, None), (3, "nothing here")], "doc_id long, text string")
    found = pii.extract(docs)
    got = {r.doc_id: r for r in pii.all_spans(found, pii.accepted(found)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_phone) == (1, 1, 1)
    assert got[1].base_sha256 == hashlib.sha256(pii.joined(base(t)).encode()).hexdigest()
    assert "secret:" in got[1].spans and got[2].spans == got[3].spans == ""
    red = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert red[1] == 'mail <EMAIL> or token = "<SECRET>" from <IP> call <PHONE>' and red[2] is None and red[3] == "nothing here"


def test_labelers_disagree(spark):
    """Public identifiers lose against the labelers; keys win with and without a cue; no digit run or crowd of matches hurts."""
    yes = [f"use AKIA{i:03d}QRSTUVWXYZ234 now" for i in range(20)] + [f"password=ab{i}f9c3d7e1a4b87" for i in range(20)]
    no = [f"commit 9f8e-{i}-session-notes-of-2024 was reverted" for i in range(20)] + [f"see https://a.example/chapter-{i}-some-long-name/2024 for more" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(yes + no)), "doc_id long, text string")
    found = pii.extract(docs)
    assert len({v % pii.VOTES for r in found.collect() for _, _, _, v in r.cands}) > 3
    got = {r.doc_id: r for r in pii.all_spans(found, pii.accepted(found)).collect()}
    assert all(got[i].spans.startswith("secret:") and got[i].n_spans == 1 for i in range(40))
    assert not any(got[i].spans for i in range(40, 80))
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)]
    t = "+1 (269) 555-3296 4524132264652876"
    assert not pii.base_spans(t) and [pii.KINDS[k] for k, *_ in pii.candidates(t, [])] == ["tel", "pan"]
    many = " (269) 555-3296" * 20_000
    assert len(pii.candidates(many, pii.base_spans(many))) == 20_000


def test_personal_data_of_whole_tables(spark, home):
    for r in rows_of(spark, home, "op8_weakly_supervised_pii"):
        own = base({x[0]: x[1] for x in table()}[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(pii.joined(own).encode()).hexdigest() and r.n_spans >= len(own)


def test_reliable_labelers_win():
    yes, no = 2 * 27 + 2 * 9 + 2 * 3 + 2, 2 * 27 + 9 + 0 + 0
    post, log = pii.estimate({yes: 500, no: 500})
    assert post[yes] > 0.95 > 0.5 > post[no]


def test_scores(spark, home):
    got = rows_of(spark, home, "op9_elias_fano_scores")
    docs = [(r[0], (r[1] or "").encode().lower().split() + [b" "]) for r in table()]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    one, two = Counter(), Counter()
    for i, t in docs:
        if not held(i):
            one.update(t)
            two.update(zip([b" ", *t[:-1]], t))
    follow = Counter(u for u, _ in two)
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    by = dict(docs)
    for r in got:
        t = by[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(w in one for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10(p(w)) for w in t), rel_tol=1e-9)
        s = sum(math.log10(p(w) if u not in one else max(two[u, w] - 0.75, 0) / one[u] + 0.75 * follow[u] / one[u] * p(w)) for u, w in zip([b" ", *t[:-1]], t))
        assert math.isclose(r.score, s, rel_tol=1e-3)


def test_words_in_arrow():
    """Runs of tokens, against splitting texts one by one; batches that begin within a buffer included."""
    r = random.Random(2)
    marks = [chr(k) for k in range(128)] + ["é", "É", "\x85", "\xa0", "\u2003", "漢"]
    texts = ["".join(r.choice(marks) for _ in range(r.choice([0, 1, 9, 300]))) if k % 7 else None for k in range(120)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array(texts)], names=["id", "text"])
    for batches, most in (([whole], 10_000), ([whole], 50), ([whole.slice(0, 37), whole.slice(37, 50), whole.slice(87)], 200), ([whole], 1)):
        got = []
        for codes, words, rows, sizes, batch in ngram_lm.documents(iter(batches), 1, most):
            assert len(set(words)) == len(words) and len(codes) == sum(sizes) and (len(rows) == 1 or sum(sizes[:-1]) < most)
            ends = np.cumsum(sizes)
            got += [(batch.column(0)[k].as_py(), [words[c] for c in codes[b - n : b]]) for k, n, b in zip(rows, sizes, ends)]
        assert got == [(k, [*(t or "").encode().lower().split(), ngram_lm.END]) for k, t in enumerate(texts)]


def test_elias_fano():
    for s in range(60):
        r = np.random.default_rng(s)
        v = np.unique(r.integers(0, r.choice([9, 10**6, 2**45]), r.integers(1, 200)))
        e, x = EliasFano.build(v), np.r_[v, r.integers(0, int(v[-1]) + 9, 40)]
        i, hit = e.find(x)
        assert (e.access(np.arange(len(v))) == v).all() and (i == np.searchsorted(v, x)).all() and (hit == np.isin(x, v)).all()


def test_suffix_array():
    r = random.Random(0)
    for _ in range(300):
        t = np.array([r.randrange(r.choice([1, 2, 26])) for _ in range(r.randint(1, 50))] * r.choice([1, 3]))
        sa = suffix_array(t)
        assert list(sa) == sorted(range(len(t)), key=lambda i: list(t[i:]))
        lcp = permuted_lcp(t, sa)
        for a, b in zip(sa, sa[1:]):
            e = 0
            while max(a, b) + e < len(t) and t[a + e] == t[b + e]:
                e += 1
            assert lcp[b] == e


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(spark, home, monkeypatch, tmp_path, hot):
    """Against brute force; hot=1 sends every mixed anchor down the counted path."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(6)
    letters = "abcdefghij é"
    make = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = make(420)
    texts = [make(300) + shared + make(200), shared, make(100) + shared[:250] + make(90) + shared[200:], make(199), "z" * 1000, None, "", make(700)]
    texts += [texts[-1], texts[0][:350] + "X" + texts[0][351:]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in suffix_dedup.op10_suffix_array_dedup(spark, str(tmp_path)).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    for k, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        x = got[k]
        assert (x.n_bytes, x.n_removed, x.n_spans) == (len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()))
        assert x.kept_sha256 == hashlib.sha256(rest).hexdigest()


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_regions_told_apart(spark, home, monkeypatch, rows):
    """One pass over the regions finds copies and contents, wherever its parts end."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 2)
    r = random.Random(rows)
    made = [(a := r.randrange(12), 100 * a + r.randrange(1 + a % 4), 1, k, 5 * k, 200 + a) for k in range(90)] + [(50, 1, 1, 900, 0, 200), (51, 1, 1, 901, 0, 200), (51, 2, 1, 902, 0, 200)]
    try:
        got = suffix_dedup.told_apart(spark.createDataFrame(made, "ah long, rh long, _f long, _r long, lo long, len long"), rows).collect()
    finally:
        spark.conf.set(name, before)
    n = Counter((x[0], x[1]) for x in made)
    content = {x[3]: x[:2] for x in made}
    several = {a for a in {x[0] for x in made} if len({x[1] for x in made if x[0] == a}) > 1}
    assert sorted(tuple(x)[2:] for x in got if x.n == 0) == sorted(x[2:] for x in made if n[x[:2]] > 1)
    assert sorted((content[x._r], x.n) for x in got if x.n) == sorted((k, c) for k, c in n.items() if k[0] in several)


def test_side_tables_in_blocks(spark, home):
    """What belongs to one large file is written by several tasks and found again."""
    df = spark.range(1000).select(F.lit(7).cast("long").alias("_f"), F.col("id").alias("_r"), (F.col("id") * 3).alias("x"))
    path = side_table(df, "blocks", 100)
    assert len(os.listdir(f"{posix(path)}/_f=7")) == 10
    assert side_rows(path, 7, 95, 312, 100).column("x").to_pylist() == [3 * k for k in range(95, 313)]
    assert side_rows(path, 7, 1000, 1005, 100) is None and side_rows(path, 8, 0, 5, 100) is None


def test_suffix_array_of_long_repeats():
    """Prefixes that stay alike for long, and common ones over the ends of four-letter words, against sorting."""
    r = random.Random(1)
    for n in (1, 2, 3, 4, 5, 8, 31, 64):
        t = np.array(([r.randrange(3) for _ in range(n)] * 40)[: 40 * n - r.randrange(n)])
        sa = suffix_array(t)
        assert list(sa) == sorted(range(len(t)), key=lambda i: list(t[i:]))
        lcp = permuted_lcp(t, sa)
        for a, b in zip(sa, sa[1:]):
            assert lcp[b] == next((e for e in range(len(t) - max(a, b)) if t[a + e] != t[b + e]), len(t) - max(a, b))


def test_kmeans_with_few_points():
    x = np.array([[0.0, 0], [1, 1], [1, 1]])
    assert len(ann.kmeans(x, 5)) == 2


def test_unknown_words_only(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    root = ngram_lm.train(d.where("false"))
    assert ngram_lm.scored(d, root).first().score == 0.0


def test_near_copies_of_four_fifths_go(spark, tmp_path):
    r = random.Random(6)
    shared = text(r, 12)
    rows = [(i, f"{shared} {text(r, r.randint(20, 90))}") for i in range(40)]
    for i in range(40):  # copies with a few words changed, on both sides of the limit
        w = rows[i][1].split()
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    far = sum((fingerprint(dict(rows)[a]) ^ fingerprint(dict(rows)[b])).bit_count() > 2 for a, b in near)
    assert far > 5 and len(near) < 35
    root = {i: i for i in sets}
    for _ in near:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    got = near_copies.deduplicate(spark.read.parquet(f"{tmp_path}/d"))
    assert sorted(x.doc_id for x in got.collect()) == sorted(set(root.values()))


@pytest.mark.parametrize("tokens", [1_000_000, 700])
def test_scores_with_two_words_of_context(spark, home, monkeypatch, tokens):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", tokens)
    docs = [(r[0], (r[1] or "").encode().lower().split() + [b" "]) for r in table()]
    one, two, three = Counter(), Counter(), Counter()
    for i, t in docs:
        if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1:
            one.update(t)
            two.update(zip([b" ", *t[:-1]], t))
            three.update(zip([b" ", *t[:-2]], t, t[1:]))
    follow, follow2 = Counter(u for u, _ in two), Counter((s, u) for s, u, _ in three)
    n, v = sum(one.values()), len(one)
    by = dict(docs)
    changed = 0
    for r in rows_of(spark, home, "op9_elias_fano_scores"):
        t, want = by[r.doc_id], 0.0
        for k, w in enumerate(t):
            p, u = (one[w] + 0.5) / (n + 0.5 * (v + 1)), t[k - 1] if k else b" "
            if u in one:
                p = max(two[u, w] - 0.75, 0) / one[u] + 0.75 * follow[u] / one[u] * p
            s = t[k - 2] if k > 1 else b" "
            if k and (s, u) in two:
                p = max(three[s, u, w] - 0.75, 0) / two[s, u] + 0.75 * follow2[s, u] / two[s, u] * p
            want += math.log10(p)
        assert math.isclose(r.score_3, want, rel_tol=1e-3)
        changed += abs(r.score_3 - r.score) > 1
    assert changed > 30


def test_near_copies_through_the_byte_index(spark, tmp_path, monkeypatch):
    """Fingerprints of the five-word sets go through the positional byte index; what it links is what brute force finds within two bits."""
    r = random.Random(8)
    rows = [(i, text(r, r.randint(150, 300))) for i in range(30)]
    for i in range(30):
        rows.append((100 + i, rows[i][1] + " tail" * (1 + i % 3)))
    rows += [(200, ""), (201, None), (202, rows[3][1])]
    sets = {near_copies.xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0: s for s in (near_copies.shingles(t) for _, t in rows)}
    fps = {np.uint64(k).view(np.int64).item(): near_copies.fingerprint(s) for k, s in sets.items()}
    for k, s in sets.items():
        bits = [sum(int(h) >> b & 1 for h in s) for b in range(64)]
        assert near_copies.fingerprint(s) == sum(1 << b for b in range(64) if 2 * bits[b] > len(s)), k
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = near_copies._mapped(docs, "doc_id", "long", lambda s: s)
    got = {(x.a, x.b) for x in near_copies.fingerprinted(marks).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2}
    assert want == got and len(want) > 5
    calls = []
    monkeypatch.setattr(near_copies, "links", lambda f: calls.append(1) or simhash.links(f))
    docs.write.parquet(f"{tmp_path}/d")
    kept = near_copies.deduplicate(spark.read.parquet(f"{tmp_path}/d"))
    assert calls and sorted(x.doc_id for x in kept.collect()) == [*range(30), 200]


def test_large_groups_of_near_copies_cost_few_pairs(spark, tmp_path, monkeypatch):
    """120 variants of one text and as many of a farther one: far fewer pairs are compared whole than the square of a group, and the groups are those of brute force."""
    r = random.Random(12)
    one = text(r, 400).split()
    far = [w if k % 90 else "other" for k, w in enumerate(one)]
    rows = []
    for i in range(240):
        w = list(one if i < 120 else far)
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = f"changed{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    sets = {i: near_copies.shingles(t) for i, t in rows}
    shared = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in sets for b in sets if a < b}
    near = [(a, b) for (a, b), n in shared.items() if 9 * n >= 4 * (len(sets[a]) + len(sets[b]))]
    for (a, b), n in list(shared.items())[::97]:  # parities never rule a link out
        x, y = (np.frombuffer(near_copies.parity(sets[k]), np.uint64) for k in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(sets[a]) + len(sets[b]) - 2 * n
    root = {i: i for i in sets}
    for _ in range(20):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    compared, whole = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *a: compared.append(pairs.count()) or whole(pairs, *a))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    kept = near_copies.deduplicate(spark.read.parquet(f"{tmp_path}/d"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(root.values()))
    assert len(near) > 7_000 > 1.5 * sum(compared) > 0


def test_nth_bit():
    """Against a walk over the bits; 64 where a word has too few."""
    r = random.Random(2)
    for x in [r.getrandbits(64) for _ in range(40)] + [0, 1, 1 << 63, (1 << 64) - 1]:
        places = [k for k in range(64) if x >> k & 1]
        k = np.arange(64)
        got = elias_fano.nth_bit(np.full(64, x, np.uint64), k.astype(np.uint64))
        assert got.tolist() == places + [64] * (64 - len(places))


def test_stages_need_one_python_worker_a_task(spark, home, monkeypatch):
    """Workers beyond one a core, and those of plain rows, stay in the memory of an executor."""
    plans = []

    def seen(module):
        whole = module.materialize

        def materialize(df, tag):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return whole(df, tag)

        monkeypatch.setattr(module, "materialize", materialize)

    for module in (near_copies, mixing, langid, sentencepieces):
        seen(module)
    docs = spark.read.parquet(f"{home}/full/documents.parquet")
    last = [langid.keep_known(docs), near_copies.deduplicate(docs), pii.redact(docs), mixing.mix_documents(docs), sentencepieces.encode(docs, sentencepieces.Pieces())]
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in last]
    words = sentencepieces.encode_words(spark.createDataFrame(pa.table({"word": ["a"]})), sentencepieces.Pieces())
    plans.append(words._jdf.queryExecution().executedPlan().toString())
    assert sum("MapInArrow" in p for p in plans) > 8
    assert not any("ExistingRDD" in p for p in plans)
    for plan in plans:
        for stage in re.split("Exchange", plan):
            assert stage.count("MapInArrow") < 2


def test_dictionaries_of_earlier_tables_go(spark, home):
    sentencepieces.encode(spark.read.parquet(f"{home}/full/documents.parquet"), sentencepieces.Pieces()).collect()
    assert sentencepieces.dictionary_at.cache_info().maxsize == 1


def test_grouped_triples():
    for seed in range(20):
        r = np.random.default_rng(seed)
        n = int(r.integers(1, 300))
        u, v, w, c = r.integers(0, 5, n) + (seed % 2 << 30), r.integers(0, 4, n), r.integers(-1, 4, n), r.integers(1, 9, n)
        want = Counter()
        for k, x, y in zip((u << 32 | v).tolist(), w.tolist(), c.tolist()):
            want[k, x] += y
        got = ngram_lm.grouped(u << 32 | v, w, c)
        assert list(zip(*(x.tolist() for x in got))) == [(*k, want[k]) for k in sorted(want)]
        got = ngram_lm.grouped(u << 32 | v, w)
        assert dict(zip(zip(got[0].tolist(), got[1].tolist()), got[2].tolist())) == Counter(zip((u << 32 | v).tolist(), w.tolist()))
        assert (ngram_lm.unpacked(ngram_lm.packed(u, v, w, c), 4) == [u, v, w, c]).all()


@pytest.mark.parametrize("most", [4_000, 7])
def test_triples_move_in_runs(spark, home, monkeypatch, most):
    """Few rows go through the shuffle, none of them large, and they hold every triple."""
    monkeypatch.setattr(ngram_lm, "PACKED", most)
    docs = spark.read.parquet(f"{home}/full/documents.parquet").select("text")
    root = ngram_lm.train(docs)
    rows = ngram_lm.count_triples(docs, root).collect()
    words, want, got = ngram_lm.words_at(root), Counter(), Counter()
    known = sorted({b" "}.union(*((r[1] or "").encode().lower().split() for r in table())))
    name = dict(zip(known, words.ids(ngram_lm.word_hash(known)).tolist()))
    for r in table():
        t = [name[w] for w in [b" ", *(r[1] or "").encode().lower().split(), b" "]]
        want.update(zip(t, t[1:], [*t[2:], -1]))
    sizes = []
    for r in rows:
        u, v, w, c = ngram_lm.unpacked(r.run, 4).tolist()
        sizes.append(len(u))
        for k, x in zip(zip(u, v, w), c):
            got[k] += x
    assert got == want and max(sizes) <= most and (most == 7 or len(rows) < sum(sizes) / 50)
