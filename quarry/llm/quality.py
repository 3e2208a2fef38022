"""Quality rules whose cutoffs carry a risk guarantee.

Every rule rejects a document whose metric exceeds a cutoff. Cutoffs form a nested family of levels (quantiles
of a metric among good documents, taken on one half of the labelled documents, never below a rule's floor).
On the other half, per stratum (language), the number of good documents that a level rejects gives an exact
binomial p-value for "its false rejection rate exceeds ALPHA"; levels are tested from the mildest on and
testing stops at the first that isn't rejected at DELTA divided by the number of strata. So with probability
1 - DELTA at once for all strata, at most ALPHA of a stratum's good documents fall. A stratum whose labels
don't certify any level rejects nothing beyond the base rule.

Defined cases: a null or empty text has no words and fails the base rule; a null language is a stratum of
its own; a document is good where all its labels say so, and counts once; documents of one text count as one, so copies
neither fall in both halves nor pass for independent evidence; labels of unknown documents and null labels are ignored; empty tables give empty results; repeated rows are judged alike; extra columns are ignored.
All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import check_columns, load, materialize, words_of

ALPHA = 0.02
DELTA = 0.05
#: Levels, mildest first: the share of good documents beyond each rule's cutoff.
LEVELS = (0.0005, 0.001, 0.002, 0.003, 0.005, 0.008)
#: Rules and the floors below which no cutoff goes.
RULES = {
    "r_symbols": ("n_symbols / nullif(word_chars, 0)", 0.03),
    "r_dup_lines": ("n_dup_lines / nullif(n_lines, 0)", 0.15),
    "r_repeats": ("n_repeat_words / nullif(n_words, 0)", 0.2),
    "r_capitals": ("n_capitals / nullif(word_chars, 0)", 0.3),
    "r_long_words": ("word_chars / nullif(n_words, 0)", 7.5),
    "r_marks": ("n_marks / nullif(word_chars, 0)", 0.08),
}
MIN_WORDS = 50
ACCURACY = 10_000
RUN = 4_096


def repeat_words(words: str = "words") -> tuple[dict[str, Column], ...]:
    """Layers of columns that end in n_repeat_words: words covered by a 3-word window that the text holds twice or more.

    compared word by word, and a text with a true collision is counted again from the windows themselves.
    """
    at = lambda d: f"(_d[{d}] & _mask)"
    three = lambda p: f"{words}[int({p})], {words}[int({p}) + 1], {words}[int({p}) + 2]"
    last = f"size({words}) - 2"
    cover = "aggregate({q}, struct(0L AS n, 0L AS e), (a, p) -> struct(a.n + p + 3L - greatest(a.e, p) AS n, p + 3L AS e), a -> a.n)"
    exact = f"array_sort(transform(slice({words}, 1, {last}), (w, i) -> struct(concat_ws(' ', w, {words}[i + 1], {words}[i + 2]) AS t, bigint(i) AS p)))"
    near = lambda s, k: f"filter({s}, (x, i) -> (i > 0 AND {k(f'{s}[i - 1]')} = {k('x')}) OR (i + 1 < size({s}) AND {k(f'{s}[i + 1]')} = {k('x')}))"
    return (
        {"_bits": F.expr(f"length(bin(size({words})))")},
        {"_mask": F.expr("shiftleft(1L, _bits) - 1L")},
        {"_s": F.expr(f"CASE WHEN size({words}) > 3 THEN sort_array(transform(slice({words}, 1, {last}), (w, i) -> shiftleft(xxhash64(w, {words}[i + 1], {words}[i + 2]), _bits) | i)) ELSE array() END").cast("array<long>")},
        {"_d": F.expr(near("_s", lambda x: f"({x} | _mask)"))},
        {"_true": F.expr(f"forall(sequence(1, greatest(1, size(_d) - 1)), i -> i >= size(_d) OR (_d[i - 1] | _mask) != (_d[i] | _mask) OR concat_ws(' ', {three(at('i - 1'))}) = concat_ws(' ', {three(at('i'))}))")},
        {"_x": F.expr(f"CASE WHEN NOT _true THEN {exact} END")},
        {
            "n_repeat_words": F.expr(
                f"CASE WHEN _true THEN {cover.format(q='sort_array(transform(_d, x -> x & _mask))')} "
                f"ELSE {cover.format(q='sort_array(transform(' + near('_x', lambda x: f'{x}.t') + ', x -> x.p))')} END"
            )
        },
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of every document."""
    check_columns(docs, "doc_id", "text", "lang")
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("stratum"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    for layer in repeat_words():
        df = df.withColumns(layer)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return df.select(
        "doc_id",
        "stratum",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        count(r"[A-Z]").alias("n_capitals"),
        count(r"[!?]").alias("n_marks"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def binomial_cdf(n: str, x: str, p: float) -> Column:
    """P(Bin(n, p) <= x), summed term by term from the logarithm of the first."""
    p, q = f"{p}D", f"{1 - p!r}D"
    step = f"a.t + ln(double({n} - (j * {RUN}L + k) + 1) / (j * {RUN}L + k)) + ln({p} / {q})"
    first = f"{n} * ln({q})"
    # terms in runs, so that no array is longer than RUN or x / RUN
    inner = f"aggregate(sequence(1L, least({RUN}L, {x} - j * {RUN}L)), r, (a, k) -> struct(double({step}) AS t, double(a.s + exp({step})) AS s))"
    return F.expr(f"CASE WHEN {x} = 0 THEN exp({first}) ELSE least(1D, aggregate(sequence(0L, ({x} - 1) div {RUN}), struct(double({first}) AS t, double(exp({first})) AS s), (r, j) -> {inner}, r -> r.s)) END")


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a certified level: stratum and a cutoff per rule."""
    good = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    strata = measured.select("stratum").distinct()
    held = measured.where("NOT base_failed").join(good, "doc_id")
    metrics = held.withColumns({r: F.expr(f"double({e})") for r, (e, _) in RULES.items()})
    texts = metrics.groupBy("stratum", "text_hash").agg(*(F.max(r).alias(r) for r in RULES))  # of one text all are equal
    held = materialize(texts.select("stratum", F.pmod(F.xxhash64("text_hash"), F.lit(2)).alias("half"), *RULES), "labelled")
    shares = "array(" + ", ".join(f"{1 - t}D" for t in LEVELS) + ")"
    marks = held.where("half = 0").groupBy("stratum").agg(*(F.expr(f"percentile_approx({r}, {shares}, {ACCURACY})").alias(f"c_{r}") for r in RULES))
    marks = marks.withColumns({f"c_{r}": F.expr(f"transform(c_{r}, x -> greatest(x, {floor}D))") for r, (_, floor) in RULES.items()})
    beyond = " OR ".join(f"{r} > c_{r}[t]" for r in RULES)
    falls = ", ".join(f"sum(int(hit[{t}])) AS x{t}" for t in range(len(LEVELS)))
    tested = (
        held.where("half = 1").join(marks, "stratum").withColumn("hit", F.expr(f"transform(sequence(0, {len(LEVELS) - 1}), t -> {beyond})"))
        .groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.expr(x) for x in falls.split(", ")))
    )
    m = F.broadcast(strata.agg(F.count(F.lit(1)).alias("m")))  # one row
    p = [binomial_cdf("n", f"x{t}", alpha) for t in range(len(LEVELS))]
    passed = tested.crossJoin(m).select("stratum", "m", F.array(*p).alias("p")).withColumn("ok", F.expr(f"transform(p, v -> v <= {delta}D / m)"))
    level = passed.select("stratum", F.expr("coalesce(nullif(array_position(ok, false), 0), size(ok) + 1) - 2").cast("int").alias("level")).where("level >= 0")
    return level.join(marks, "stratum").select("stratum", *(F.expr(f"c_{r}[level]").alias(f"c_{r}") for r in RULES))


def judge(measured: DataFrame, cut: DataFrame) -> DataFrame:
    """measured with kept."""
    falls = " OR ".join(f"coalesce({e} > c_{r}, false)" for r, (e, _) in RULES.items())
    verdict = F.expr(f"NOT base_failed AND NOT (NOT base_failed AND ({falls}))")
    return measured.join(cut, "stratum", "left").withColumn("kept", verdict)


def op7_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(measure(load(spark, sf_dir, "documents")), "measured")
    cut = materialize(cutoffs(measured, load(spark, sf_dir, "labels")), "cutoffs")
    return judge(measured, cut).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
