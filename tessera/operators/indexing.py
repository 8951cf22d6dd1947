"""Document indexing: decode (P6), blank filter (P7), words (D1), token cost
(D2), chunking (D3), chunk counts (D4), annotations (D5/D6), cache status
(D7), upsert (D8), packing (D9), error isolation (D10) and the run summary
(A10).

A document is the unit of parallelism: chunking is order-dependent inside a
document and independent across documents, so it runs in Arrow batches of
documents (``mapInPandas``) that emit one row per chunk. Everything else
is built-in Spark SQL. The index is kept exploded as
``(key, chunk_no, chunks, summary)`` rows; ``pack_index`` gives the nested
``(key, chunks, summaries[])`` form.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.chunking import chunk_text
from tessera.functions.columns import words as _words
from tessera.session import ship_package

MAX_TOKENS = 8000          # fixed value: chunk budget of the reference
FAILED = "[Error] no annotation"

STATUS_SKIPPED, STATUS_EMPTY = "Skipped", "Empty"
STATUS_CACHED, STATUS_PROCESSED, STATUS_ERROR = "Cached", "Processed", "Error"
# A character that the chunker does not treat as a blank (all Unicode blanks and U+001C..1F).
VISIBLE = r"(?U)[^\s\x1c-\x1f]"


# ------------------------------------------------------------------ P6, P7, D1, D2

def decode_text(objects: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """UTF-8 decode that drops invalid bytes (Python ``errors='ignore'``).
    Valid texts stay as they are. In others ``make_valid_utf8`` marks each
    invalid sequence with U+FFFD, which is then removed; a U+FFFD of the text
    itself is written as an escape (U+FFFE and a digit) meanwhile."""
    raw = F.col(content).cast("string")
    mark, escape = F.lit("\ufffd"), F.lit("\ufffe")
    own_mark, own_escape = F.lit("\ufffe1"), F.lit("\ufffe0")
    escaped = F.replace(F.replace(raw, escape, own_escape), mark, own_mark)
    kept = F.replace(F.make_valid_utf8(escaped), mark, F.lit(""))
    cleaned = F.replace(F.replace(kept, own_mark, mark), own_escape, escape)
    return objects.withColumn(out, F.when(F.is_valid_utf8(raw), raw).otherwise(cleaned))


def non_empty(docs: DataFrame, text: str = "text") -> DataFrame:
    """Keep documents that contain a non-whitespace character."""
    return docs.filter(F.col(text).rlike(VISIBLE))


def tokenize_words(docs: DataFrame, text: str = "text", out: str = "words") -> DataFrame:
    """Whitespace-run split without empty words."""
    return docs.withColumn(out, _words(text))


def token_cost(word: Column | str) -> Column:
    """Default token cost of ``word + ' '`` = ceil((length + 1) / 4)."""
    w = F.col(word) if isinstance(word, str) else word
    return F.floor((F.length(w) + 4) / 4).cast("int")


# ------------------------------------------------------------------ D3, D4

# Chunk rows per emitted frame, so that an Arrow batch of documents never holds all its chunks at once.
FRAME_ROWS = 1000


def _chunk_batches(max_tokens: int, counter: Callable | None, keep_empty_first: bool, isolate: bool):
    def frame(rows):
        keys, nos, texts = zip(*rows)
        return pd.DataFrame({"key": keys, "chunk_no": pd.Series(nos, dtype="int32"),
                             "chunk": pd.Series(texts, dtype="object")})

    def run(batches):
        rows = []
        for pdf in batches:
            for k, t in zip(pdf["key"], pdf["__text"]):
                try:
                    found = chunk_text(t, max_tokens, counter, keep_empty_first) or ()
                except Exception:
                    if not isolate:
                        raise
                    rows.append((k, 0, None))
                    continue
                for i, c in enumerate(found):
                    rows.append((k, i + 1, c))
                    if len(rows) >= FRAME_ROWS:
                        yield frame(rows)
                        rows = []
        if rows:
            yield frame(rows)
    return run


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a DataFrame that has fewer input partitions than the
    cluster has cores (e.g. one large file with one row group), so that the
    per-document Python work is not serialised in one task. Wide inputs (the
    normal case at scale) are left as they are: no extra shuffle."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df


def chunk_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, counter: Callable | None = None,
                    keep_empty_first: bool = True, key: str = "key", text: str = "text",
                    isolate: bool = False) -> DataFrame:
    """D3: ``(key, chunk_no, chunk)`` with chunk_no from 1.

    ``counter(words) -> costs`` replaces the default token estimate (e.g. an
    exact tokenizer); it runs inside the same Arrow batch. With ``isolate`` a
    document whose counter raises gives one row with chunk_no 0 and a NULL
    chunk (D10) instead of ending the job."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("__text"))
    # mapInPandas emits the chunk rows directly: one Python pass per
    # document and no generator (an inferred ``size(udf(...)) > 0`` filter
    # beneath an explode would evaluate the chunker twice).
    return spread(src).mapInPandas(_chunk_batches(max_tokens, counter, keep_empty_first, isolate),
                                   "key string, chunk_no int, chunk string")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Number of chunks per document."""
    return chunks.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("chunks"))


# ------------------------------------------------------------------ D6

def fill_failed(df: DataFrame, col: str = "summary", text: str = FAILED) -> DataFrame:
    """A NULL or empty annotation becomes the failure marker."""
    return df.withColumn(col, F.when(F.coalesce(F.col(col), F.lit("")) == "", F.lit(text))
                         .otherwise(F.col(col)))


# ------------------------------------------------------------------ D7, D8, D9

def index_status(counts: DataFrame, index: DataFrame, by: str = "count") -> DataFrame:
    """``Cached`` when the key is indexed with the same chunk count,
    otherwise ``Processed``. ``by="hash"`` compares a content hash instead
    (both sides need a ``text_hash`` column), fixing the blind spot of equal
    counts for edited text."""
    if by == "hash":
        prev = index.select("key", F.col("text_hash").alias("__prev")).dropDuplicates(["key"])
        same = F.col("__prev") == F.col("text_hash")
    else:
        prev = index.select("key", F.col("chunks").alias("__prev")).dropDuplicates(["key"])
        same = F.col("__prev") == F.col("chunks")
    j = counts.join(prev, "key", "left")
    return j.withColumn("status", F.when(F.col("__prev").isNotNull() & same, F.lit(STATUS_CACHED))
                        .otherwise(F.lit(STATUS_PROCESSED))).drop("__prev")


def upsert_index(index: DataFrame, updates: DataFrame, prune_keys: DataFrame | None = None) -> DataFrame:
    """Rows of updated keys replace all rows of those keys; other keys
    stay, even when their object is gone, unless ``prune_keys`` (the keys
    still present) is given."""
    keep = index.join(updates.select("key").distinct(), "key", "left_anti")
    if prune_keys is not None:
        keep = keep.join(prune_keys.select("key").distinct(), "key", "left_semi")
    return keep.unionByName(updates.select(*index.columns))


def pack_index(rows: DataFrame) -> DataFrame:
    """``(key, chunks, summaries[])`` with summaries in chunk order."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "summary")))
    return rows.groupBy("key").agg(
        F.max("chunks").alias("chunks"),
        F.transform(ordered, lambda s: s["summary"]).alias("summaries"))


def explode_index(packed: DataFrame) -> DataFrame:
    """T1 (inverse of D9): ``(file, chunk, summary)``, chunk from 1; a
    missing summaries list gives no rows."""
    return packed.select(F.col("key").alias("file"), F.posexplode("summaries").alias("__p", "summary")) \
        .select("file", (F.col("__p") + 1).alias("chunk"), "summary")


# ------------------------------------------------------------------ D10, A10

def guarded(df: DataFrame, fn: Callable[[str], str], col: str, out: str) -> DataFrame:
    """Apply a per-row Python hook (extractor, model call) in Arrow
    batches; a failing row gets NULL in ``out`` and its message in
    ``error`` instead of failing the job."""
    ship_package(df.sparkSession)
    schema = StructType(list(df.schema.fields) + [StructField(out, StringType()), StructField("error", StringType())])

    def run(batches):
        for pdf in batches:
            res, err = [], []
            for v in pdf[col]:
                try:
                    res.append(fn(v))
                    err.append(None)
                except Exception as e:  # isolate the bad row
                    res.append(None)
                    err.append(f"{type(e).__name__}: {e}")
            pdf[out], pdf["error"] = res, err
            yield pdf
    return df.mapInPandas(run, schema)


def index_run_summary(status: DataFrame) -> DataFrame:
    """A10: documents per outcome."""
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("documents"))
