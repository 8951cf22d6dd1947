"""Incremental indexing over a file stream.

New objects under ``src`` are picked up by a ``binaryFile`` file stream
(the stream's own checkpoint remembers which files were seen); each
micro-batch runs the batch indexing job against the current index and appends
the rows of its own keys (``compact_index`` merges parts as a job of its own;
keyword weights use the documents of the micro-batch; ``corpus_index`` keeps
them independent of it). The commit is keyed by the stream id (kept in the
checkpoint) and the micro-batch id, so a
batch replayed after a failure is not applied twice. ``trigger(availableNow)``
processes what is there and stops - the shape of the reference tool, which
indexes whatever is new each time it is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.indexing_run import index_updates
from tessera.session import materialize
from tessera.sources.objects import BINARY_FILE_SCHEMA, relative_key
from tessera.sources.store import append_index, read_index


def query_id(batch: DataFrame) -> str:
    """Id of the running stream; it is kept in the stream's checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def start_index_stream(spark: SparkSession, src: str, index_root: str, checkpoint: str,
                       available_now: bool = True, **index_options):
    stream = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("recursiveFileLookup", "true").load(src)
              .select(relative_key(src).alias("key"), "content"))

    def apply(batch, batch_id: int):
        current = read_index(spark, index_root, index_options.get("by") == "hash", batch.select("key"))
        updates = materialize(index_updates(batch, current, **index_options)[1])
        if not updates.isEmpty():
            append_index(updates, index_root, batch=batch_id, stream=query_id(batch))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
