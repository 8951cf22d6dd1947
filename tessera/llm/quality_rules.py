"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio
between a trusted-target and the raw-corpus multinomial.

Features are word bigrams after character folding (runs of upper-case
letters, lower-case letters and digits become one sign each, everything else
stays), hashed into ``BUCKETS`` bins, and the lower-cased words themselves,
hashed into ``WORD_BUCKETS`` bins. Both multinomials are counted over all
documents: the target over the documents with a trusted id, the raw one over
the whole corpus. A document's two scores are the means of
``ln(p_target / p_raw)`` over its bigrams and over its words. The target of the
words is mixed with a fixed share ``WORD_SHARE`` of the raw multinomial, so a
word that no trusted document has weighs ``ln(WORD_SHARE)`` at any table
size. A document is kept that passes the base rules and reaches ``THRESHOLD``
and ``WORD_THRESHOLD``. Word order is not judged.

The texts are read once: base columns and bins of every row are written, and
no bins are shuffled. All bins are counted at once, raw and of the documents
whose id is in a bit table of the trusted ids (``KEY_BITS`` bits an id, at most
``MAX_FILTER_BITS``). The few ids that are in the table by chance are found by an
exact join of ids alone, and their documents' counts are taken off again (if
the table fills up, that correction covers more documents). The ratio table has at most ``WORD_BUCKETS + BUCKETS``
rows and is broadcast; a document's bins are summed where they are, and
one narrow row each is exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import BLANK_CHARS, SYMBOLS, count_chars_in, words
from tessera.session import materialize

BUCKETS = 4096
SMOOTHING = 1.0
THRESHOLD = -1.0
WORD_BUCKETS = 1 << 20
WORD_SHARE = 2e-4  # of the raw multinomial in the target of the words
KEY_BITS, MAX_FILTER_BITS = 16, 1 << 27  # bits of a bit table per key, and at most
WORD_THRESHOLD = -3.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def repeated_words(w: str) -> list[tuple[str, str]]:
    """SQL steps ``(column, expression)`` that count the words lying in a
    3-word window that occurs twice or more, from the array ``w`` of their
    64-bit hashes. Windows are compared by a hash of these; a text without
    equal windows stops after one pass."""
    return [
        ("tri", f"""IF(size({w}) < 4, CAST(array() AS ARRAY<BIGINT>),
            transform(slice({w}, 1, size({w}) - 2), (x, i) -> xxhash64(x, {w}[i + 1], {w}[i + 2])))"""),
        ("sorted_tri", """IF(size(array_distinct(tri)) = size(tri), CAST(array() AS ARRAY<STRUCT<h: BIGINT, i: INT>>),
            sort_array(transform(tri, (h, i) -> struct(h AS h, i AS i))))"""),
        ("hits", """sort_array(transform(filter(transform(sorted_tri, (x, j) -> struct(x.i AS i,
            x.h <=> get(sorted_tri, j - 1).h OR x.h <=> get(sorted_tri, j + 1).h AS dup)), y -> y.dup), y -> y.i))"""),
        ("n_repeat_words", """aggregate(hits, struct(-9 AS last, 0L AS n),
            (s, p) -> struct(p AS last, s.n + least(3, p - s.last) AS n), s -> s.n)"""),
    ]


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def with_base_rules(df: DataFrame) -> DataFrame:
    """The base columns, from the text ``t`` (not NULL) and its words ``w``;
    other columns stay."""
    kept = [c for c in df.columns if c not in ("t", "w")]
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.select(
        *kept, F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"), F.size("w").cast("long").alias("n_words"),
        (F.char_length("t") - count_chars_in(F.col("t"), BLANK_CHARS)).cast("long").alias("word_chars"),
        count_chars_in(F.col("t"), SYMBOLS).alias("n_symbols"), lines.alias("lines"))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    for name, sql in repeated_words("hashes"):
        df = df.withColumn(name, F.expr(sql))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).select(*kept, *BASE)


def fold(text):
    """Letter and digit runs folded to one sign each."""
    t = F.regexp_replace(text, "\\p{Lu}+", "A")
    t = F.regexp_replace(t, "\\p{Ll}+", "a")
    return F.regexp_replace(t, "[0-9]+", "0")


def with_features(df: DataFrame) -> DataFrame:
    """``b``, the word bins, and ``s``, the bins of the folded bigrams (the
    first word pairs with the text start), from ``t`` and ``w``."""
    df = df.withColumn("f", words(fold(F.col("t"))))
    grams = F.expr(f"transform(f, (x, i) -> CAST(pmod(xxhash64(coalesce(get(f, i - 1), '^'), x), {BUCKETS}) AS INT))")
    bins = F.transform("w", lambda x: F.pmod(F.xxhash64(F.lower(x)), F.lit(WORD_BUCKETS)).cast("int"))
    return df.withColumn("b", bins).withColumn("s", grams).drop("f")


def texts(docs: DataFrame, *columns) -> DataFrame:
    """``columns``, the text ``t`` (NULL as empty) and its words ``w``."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("t"), words(F.col("text")).alias("w"))


def _dense(rows: DataFrame, size: int, value: str, missing) -> DataFrame:
    """One row with the array of ``value`` by ``bucket`` (0 to ``size`` - 1)."""
    every = rows.sparkSession.range(size).join(rows, F.col("id") == F.col("bucket"), "left") \
        .select("id", F.coalesce(value, F.lit(missing)).alias("v"))
    runs = every.groupBy(F.expr("id div 1024").alias("run")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("v"))
    return runs.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "v"))), lambda x: x["v"])).alias("v"))


def bit_table(rows: DataFrame, *key: str) -> tuple[DataFrame, int]:
    """The bit table of the hashed key columns, one row with an array of
    longs, and its size in bits, which has a bound."""
    size = 64
    while size < min(KEY_BITS * rows.count(), MAX_FILTER_BITS):
        size *= 2
    bit = F.pmod(F.xxhash64(*key), F.lit(size))
    words_ = (rows.select(F.shiftright(bit, 6).alias("bucket"), bit.bitwiseAND(F.lit(63)).cast("int").alias("k"))
              .groupBy("bucket").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("bits")))
    return materialize(_dense(words_, size // 64, "bits", 0)), size


def in_table(found: tuple[DataFrame, int], *key: str):
    """Condition: the row's key may be in the table."""
    table, size = found
    bit = F.pmod(F.xxhash64(*key), F.lit(size))
    word = F.get(table.scalar(), F.shiftright(bit, 6).cast("int"))
    return F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1


def judged_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, bins`` and the base columns of every row: the one
    pass over the texts, written once. ``bins`` are the word bins, then (from
    ``WORD_BUCKETS`` on) the bigram bins; written they take about as much
    room as the compressed texts."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = with_features(texts(docs, "doc_id", text_hash.alias("text_hash")))
    bins = F.concat("b", F.transform("s", lambda x: x + WORD_BUCKETS))
    return materialize(with_base_rules(rows.withColumn("bins", bins).drop("b", "s")))


def bin_counts(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """``bucket, raw, target``: at most ``WORD_BUCKETS + BUCKETS`` rows."""
    good = trusted.select("doc_id").filter(F.col("doc_id").isNotNull())
    marked = F.col("doc_id").isNotNull() & in_table(bit_table(good, "doc_id"), "doc_id")
    counts = materialize(rows.select(marked.cast("int").alias("m"), F.explode("bins").alias("bucket"))
                         .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("m").alias("marked")))
    # ids that are in the table by chance, and the counts of their documents
    chance = materialize(rows.select("doc_id").filter(marked).join(good, "doc_id", "left_anti").distinct())
    wrong = rows.filter(marked & in_table(bit_table(chance, "doc_id"), "doc_id")).select("doc_id", "bins")
    over = (wrong.join(chance, "doc_id", "left_semi").select(F.explode("bins").alias("bucket"))
            .groupBy("bucket").agg(F.count(F.lit(1)).alias("over")))
    return counts.join(over, "bucket", "left").select(
        "bucket", "raw", (F.col("marked") - F.coalesce("over", F.lit(0))).alias("target"))


def log_ratios(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """``bucket, llr`` of every bin that occurs. Without trusted documents both
    multinomials agree by definition and every ratio is 0."""
    counts = materialize(bin_counts(rows, trusted))
    is_word = F.col("bucket") < WORD_BUCKETS
    total = counts.agg(*[F.sum(F.when(kind, F.col(c))).alias(f"{name}_{c}")
                         for name, kind in (("w", is_word), ("s", ~is_word)) for c in ("raw", "target")]).first()
    w_raw, w_target, s_raw, s_target = (float(total[f"{k}_{c}"] or 0) for k in "ws" for c in ("raw", "target"))
    if not w_target:
        return counts.select("bucket", F.lit(0.0).alias("llr"))
    by_word = F.log((1 - WORD_SHARE) * (F.col("target") / w_target) / (F.col("raw") / w_raw) + WORD_SHARE)
    pad = SMOOTHING * BUCKETS
    by_bigram = F.log(((F.col("target") + SMOOTHING) / (s_target + pad)) / ((F.col("raw") + SMOOTHING) / (s_raw + pad)))
    return materialize(counts.select("bucket", F.when(is_word, by_word).otherwise(by_bigram).alias("llr")))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text_hash``, the base columns, ``base_failed``, ``score`` and
    ``word_score`` (mean log-likelihood ratios, NULL without words) and ``kept``
    for every row of ``docs`` (needs ``doc_id, text``; other columns are
    ignored). ``trusted`` names the trusted ids. NULL text counts as empty: 0
    words, base_failed. Rows with NULL ids are scored and never trusted;
    repeated rows get equal results; an empty table gives no rows."""
    rows = judged_rows(docs)
    ratios = log_ratios(rows, trusted)  # at most WORD_BUCKETS + BUCKETS rows
    is_word = F.col("bucket") < WORD_BUCKETS
    # a row's bins are summed in its own task; one narrow row each is exchanged
    scored = (rows.select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), F.explode("bins").alias("bucket"))
              .join(F.broadcast(ratios), "bucket").groupBy("s_id", "s_hash")
              .agg(F.avg(F.when(is_word, F.col("llr"))).alias("word_score"), F.avg(F.when(~is_word, F.col("llr"))).alias("score")))
    out = rows.drop("bins").join(scored, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash")), "left")
    verdict = ~F.col("base_failed") & (F.round("score", 6) >= threshold) & (F.round("word_score", 6) >= WORD_THRESHOLD)
    return out.select("doc_id", "text_hash", *BASE, "score", "word_score", F.coalesce(verdict, F.lit(False)).alias("kept"))


def kept_documents(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their
    columns. Rows whose id and text hash are not in the bit table of the
    rejected ones stay where they are read; only the others, the rejected and
    the few in the table by chance, are compared exactly."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    carried = docs.select(row, "doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"))
    rejected = materialize(quality_rules(docs, trusted, threshold).filter(~F.col("kept"))
                           .select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash")).distinct())
    named = rejected.select(F.col("r_id").alias("doc_id"), F.col("r_hash").alias("text_hash"))
    marked = in_table(bit_table(named, "doc_id", "text_hash"), "doc_id", "text_hash")
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash"))
    doubtful = carried.filter(marked).join(rejected, same, "left_anti")
    return carried.filter(~marked).select("row.*").unionByName(doubtful.select("row.*"))
