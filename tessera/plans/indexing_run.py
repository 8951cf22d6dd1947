"""The indexing job: objects -> status per key + index rows of changed keys.

objects ``(key, content BINARY)`` -> extension test (P5) -> decode (P6) ->
blank test (P7) -> chunk (D3) -> cache test against the previous index (D7)
-> annotate new/changed documents (D5, D6) -> upsert (D8).

The chunked frame feeds both the cache test and the annotation, so it is
checkpointed into the shared checkpoint folder (reliable: survives executor
loss and cuts the lineage) when ``checkpoint=True``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import indexing as D
from tessera.operators.annotate import annotate_chunks
from tessera.operators.listing import supported_files
from tessera.session import materialize

INDEX_COLUMNS = ["key", "chunk_no", "chunks", "summary"]


def empty_index(spark) -> DataFrame:
    return spark.createDataFrame([], "key string, chunk_no int, chunks int, summary string")


def index_columns(by: str) -> list[str]:
    """Columns of the index: a run by hash keeps ``text_hash`` as well."""
    return INDEX_COLUMNS + (["text_hash"] if by == "hash" else [])


def index_documents(objects: DataFrame, index: DataFrame, by: str = "count", **options):
    """Returns ``(status, new_index)``: the statuses of ``index_updates`` and
    the full index rows after the upsert."""
    status, updates = index_updates(objects, index, by=by, **options)
    return status, D.upsert_index(index.select(*index_columns(by)), updates)


def index_updates(objects: DataFrame, index: DataFrame, max_tokens: int = D.MAX_TOKENS,
                  counter=None, by: str = "count", checkpoint: bool = True,
                  n_keywords: int = 8, n_sentences: int = 2, model_fn=None, extractor=None):
    """Returns ``(status, updates)``: the statuses of ``changed_chunks`` and
    all index rows of the processed keys. Keyword weights use the chunks of
    this run. With ``checkpoint`` the chunks to annotate are written too, as
    they are read more than once."""
    status, todo, chunks = changed_chunks(objects, index, max_tokens, counter, by, checkpoint, extractor)
    if checkpoint:
        todo = materialize(todo)
    ann = annotate_chunks(todo, n_keywords, n_sentences, model_fn=model_fn, corpus=chunks)
    return status, with_summaries(todo, ann).select(*index_columns(by))


def with_summaries(chunks: DataFrame, annotated: DataFrame) -> DataFrame:
    """Chunk rows with their annotation as ``summary`` (D6 where there is none)."""
    return D.fill_failed(chunks.join(
        annotated.select("key", "chunk_no", F.col("annotation").alias("summary")), ["key", "chunk_no"], "left"))


def changed_chunks(objects: DataFrame, index: DataFrame, max_tokens: int = D.MAX_TOKENS, counter=None,
                   by: str = "count", checkpoint: bool = True, extractor=None):
    """Returns ``(status, todo, chunks)``; ``status`` is ``(key, status,
    chunks)`` for every object (a NULL or unreadable content, or one whose hook
    raises, is ``Error`` and leaves its index entry as it was), ``todo`` the
    chunks ``(key, chunk_no, chunk, chunks)`` of the processed keys, ``chunks``
    those of all readable objects. With ``by="hash"`` a document is processed
    when its SHA-256 differs from the index's ``text_hash``, which ``todo``
    then has too."""
    tagged = supported_files(objects.select("key", "content"))
    is_pdf = F.lower("key").endswith(".pdf")

    def settled(df, status):
        return df.select("key", F.lit(status).alias("status"), F.lit(None).cast("int").alias("chunks"))

    # .pdf needs the extractor hook (bytes -> text); without one it is skipped like the others.
    skipped = tagged.filter(~F.col("supported") if extractor else ~F.col("supported") | is_pdf)
    readable = tagged.filter(F.col("supported") & ~is_pdf & F.col("content").isNotNull())
    text = D.decode_text(readable).select("key", "text")
    if extractor is not None:
        pdf = tagged.filter(F.col("supported") & is_pdf & F.col("content").isNotNull()).select("key", "content")
        text = text.unionByName(materialize(D.guarded(pdf, extractor, "content", "text").select("key", "text")))
    unread = tagged.filter(F.col("supported") & F.col("content").isNull() & (F.lit(bool(extractor)) | ~is_pdf))
    failed = settled(unread, D.STATUS_ERROR).unionByName(settled(text.filter(F.col("text").isNull()), D.STATUS_ERROR))
    text = text.filter(F.col("text").isNotNull())
    blank = text.filter(~F.col("text").rlike(D.VISIBLE))
    docs = D.non_empty(text)
    chunks = D.chunk_documents(docs, max_tokens, counter, isolate=True)
    if checkpoint:
        chunks = materialize(chunks)
    failed = failed.unionByName(settled(chunks.filter(F.col("chunk").isNull()), D.STATUS_ERROR))
    chunks = chunks.filter(F.col("chunk").isNotNull())
    counts = D.chunk_counts(chunks)
    if by == "hash":
        counts = counts.join(docs.select("key", F.sha2("text", 256).alias("text_hash")), "key")
    st = D.index_status(counts, index, by=by)
    if checkpoint:
        st = materialize(st)  # one row per document; the texts are hashed for it once
    changed = st.filter(F.col("status") == D.STATUS_PROCESSED).drop("status")
    todo = chunks.join(changed, "key")
    status = reduce(DataFrame.unionByName,
                    [settled(skipped, D.STATUS_SKIPPED), failed, settled(blank, D.STATUS_EMPTY),
                     st.select("key", "status", "chunks")])
    return status, todo, chunks
