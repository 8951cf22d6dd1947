"""D11 with state: an index over a file stream that does not depend on which
micro-batch an object came in.

Two streams work on one index folder:

* ``start_ingest`` takes new objects, chunks those
  that are new or changed by hash, and commits per micro-batch their chunks, the
  status of every object, and the *changes* of the document frequencies: +1 for
  a term of a new chunk, -1 for one of a chunk that is replaced. Stored chunks
  are looked up for the keys of the batch only.
* ``start_statistics`` reads the published changes as a stream and keeps
  document frequencies and corpus size as the state of a streaming aggregation
  (the state store of its checkpoint); every micro-batch writes the terms whose
  frequency changed, newest value per term.

``published_index`` annotates the stored chunks with those frequencies, so
keywords and summaries equal those of one batch run over the same objects,
whatever the order, the number of waves, and objects that were replaced.

Exactly once: chunk and status commits carry the stream and batch id and
are not repeated by a replay. Changes are written aside, named in no commit
before the chunks are committed, and then published by one rename; a replay
of a batch that stopped in between repeats only the rename.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import terms
from tessera.operators.annotate import annotate_chunks
from tessera.plans.indexing_run import INDEX_COLUMNS, changed_chunks, with_summaries
from tessera.session import materialize, parts_of, release, shuffles_dropped
from tessera.sources.objects import BINARY_FILE_SCHEMA, OBJECTS, list_objects, object_folder, read_contents, relative_key
from tessera.sources.store import commit_part, commits, make_folder, move, read_parts
from tessera.streaming.index_stream import query_id

CHUNK_SCHEMA = "key string, chunk_no int, chunk string, chunks int, text_hash string"
STATUS_SCHEMA = "key string, status string, chunks int"
CHANGE_SCHEMA = "term string, change long"
TERM_SCHEMA = "term string, df long"
LIST_ROWS = 5_000  # objects in a file of a listing
CORPUS = ""  # the term that counts chunks; terms are runs of letters, never empty


def _stored(spark, root, name, schema, keys, wanted=None) -> DataFrame:
    rows = read_parts(spark, f"{root}/{name}", "parquet", schema, keys, wanted)
    return spark.createDataFrame([], schema) if rows is None else rows


def stored_chunks(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    return _stored(spark, root, "chunks", CHUNK_SCHEMA, ["key"], wanted)


def stored_statuses(spark: SparkSession, root: str) -> DataFrame:
    """The latest status of every object, ``Empty`` and ``Error`` included."""
    return _stored(spark, root, "status", STATUS_SCHEMA, ["key"])


def stored_statistics(spark: SparkSession, root: str) -> DataFrame:
    """``(term, df)``; the empty term has the number of chunks."""
    return _stored(spark, root, "terms", TERM_SCHEMA, ["term"])


def frequency_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """``(term, change)`` between the chunks that come and those that go."""
    def counted(chunks, sign):
        listed = F.concat(F.array(F.lit(CORPUS)), F.array_distinct(terms("chunk")))
        return chunks.select(F.explode(listed).alias("term"), F.lit(sign).cast("long").alias("change"))
    both = counted(new, 1).unionByName(counted(old, -1))
    return both.groupBy("term").agg(F.sum("change").alias("change")).filter("change <> 0")


def _ingest(spark, root, key, options):
    def apply(batch: DataFrame, number: int):
        stream = query_id(batch)
        published = f"{root}/changes/{stream}-{number}"
        staged = f"{root}/staged/{stream}-{number}"
        if any((c.stream, c.batch) == (stream, number) for c in commits(spark, f"{root}/chunks")):
            move(spark, staged, published)
            return
        # the newest of several objects with one key
        objects = materialize(batch.groupBy(key.alias("key")).agg(
            F.max_by("content", F.struct("modificationTime", "path")).alias("content")))
        before = materialize(stored_chunks(spark, root, objects.select("key")))
        status, todo, _ = changed_chunks(objects, before, by="hash", **options)
        todo = materialize(todo.select("key", "chunk_no", "chunk", "chunks", "text_hash"))
        commit_part(status, f"{root}/status", "parquet", ["key"], batch=number, stream=stream)
        replaced = before.join(todo.select("key").distinct(), "key", "left_semi")
        with shuffles_dropped(spark):
            frequency_changes(todo, replaced).write.mode("overwrite").parquet(staged)
        commit_part(todo, f"{root}/chunks", "parquet", ["key"], batch=number, stream=stream)
        move(spark, staged, published)
        for table in (objects, before, todo):
            release(table)
    return apply


def _list_new(spark: SparkSession, base: str, root: str) -> str:
    """Add the objects below ``base`` that are in no listing yet to the
    listings of the index, as a few files of rows; returns their folder."""
    listed = f"{root}/listed/{hashlib.sha256(base.encode()).hexdigest()[:16]}"
    make_folder(spark, listed)
    known = spark.read.schema(OBJECTS).option("recursiveFileLookup", "true").parquet(listed)
    new = materialize(list_objects(spark, base).join(known.select("key"), "key", "left_anti"))
    n = new.count()
    if n:
        staged = f"{root}/staged/listed-{uuid.uuid4().hex}"
        new.repartition(parts_of(spark, n, LIST_ROWS)).write.parquet(staged)
        move(spark, staged, f"{listed}/{uuid.uuid4().hex}")
    release(new)
    return listed


def start_ingest(spark: SparkSession, src: str, root: str, checkpoint: str, key=None, available_now: bool = True, **options):
    """Start the stream of objects below ``src``. ``key`` is a column over
    ``path`` (default: the path relative to ``src``); ``options`` are those of
    ``changed_chunks`` (``max_tokens``, ``counter``, ``extractor``). An object
    replaces the one with the same key; as a file stream takes every path
    once, a new version comes under a new path and ``key`` maps both to the
    object. A deleted object stays indexed, as in the reference. Objects that fail keep their old chunks.

    With ``available_now`` tasks list what is there and the stream is one of listings (``root/listed``), whose rows
    tasks read: a file stream of the objects themselves keeps every path on the driver. It is used where
    the stream goes on, or ``src`` is no folder that Python opens."""
    for folder in ("changes", "staged"):
        make_folder(spark, f"{root}/{folder}")
    base = object_folder(spark, src) if available_now else None
    if base is None:
        stream = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
                  .option("recursiveFileLookup", "true").load(src))
    else:
        listed = (spark.readStream.schema(OBJECTS).option("recursiveFileLookup", "true").parquet(_list_new(spark, base, root)))
        stream = read_contents(listed, base).select(
            F.concat(F.lit(base + "/"), "key").alias("path"), F.timestamp_millis("modified").alias("modificationTime"), "length", "content")
    apply = _ingest(spark, root, relative_key(src) if key is None else key, options)
    return _started(stream.writeStream.foreachBatch(apply), checkpoint, available_now)


def start_statistics(spark: SparkSession, root: str, checkpoint: str, available_now: bool = True):
    """Start the stream that keeps document frequencies and corpus size."""
    make_folder(spark, f"{root}/changes")
    changes = (spark.readStream.schema(CHANGE_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{root}/changes"))
    frequencies = changes.groupBy("term").agg(F.sum("change").alias("df"))

    def apply(batch: DataFrame, number: int):
        if not batch.isEmpty():
            commit_part(batch.select("term", "df"), f"{root}/terms", "parquet", ["term"], batch=number, stream=query_id(batch))
    return _started(frequencies.writeStream.outputMode("update").foreachBatch(apply), checkpoint, available_now)


def _started(writer, checkpoint: str, available_now: bool):
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def index_new_objects(spark: SparkSession, src: str, root: str, key=None, **options) -> None:
    """Run both streams over what is there (the reference's tool call)."""
    start_ingest(spark, src, root, f"{root}/checkpoints/ingest", key, **options).awaitTermination()
    start_statistics(spark, root, f"{root}/checkpoints/statistics").awaitTermination()


def published_index(spark: SparkSession, root: str, n_keywords: int = 8, n_sentences: int = 2, model_fn=None) -> DataFrame:
    """The index rows ``(key, chunk_no, chunks, summary)`` with the
    frequencies of all objects so far."""
    chunks = materialize(stored_chunks(spark, root))
    annotated = annotate_chunks(chunks, n_keywords, n_sentences, model_fn=model_fn,
                                statistics=stored_statistics(spark, root).filter("df > 0"))
    return with_summaries(chunks, annotated).select(*INDEX_COLUMNS)
