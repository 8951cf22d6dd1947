"""Top-k retrieval over impact-ordered postings with block maxima (T2 and T4
for many questions at once).

``build_postings`` cuts every term's postings into blocks by impact: level 0
holds the best (at least ``BLOCK`` of them, all of a rarer term), each further
level about ``GROWTH`` times as many. A small directory has each block's size and
best weight. The written postings are partitioned by level, and a block is
spread over hash parts of about ``PART_ROWS`` rows, so no term is one task's
work however common it is. Levels come from a histogram of impacts per term
(at most ``BINS`` rows a term); no task sorts a term's postings.

``top_k`` then reads what can matter only:

1. Level 0 of the question terms, i.e. the rare terms whole and the best
   postings of common ones. The k-th best partial sum is a threshold: k
   chunks reach it, so no chunk under it is in the result.
2. Per question the terms of least best weight whose weights together stay
   under the threshold are optional: a chunk with none of the other,
   essential terms cannot reach it. Only blocks of essential terms are read,
   and of these only blocks whose best weight and the other terms' best
   weights together reach it.
3. The ``PROBES * k`` chunks with the best essential sums are scored exactly,
   which gives a threshold close to the true k-th score. Chunks whose
   essential sum and all optional best weights together reach it are
   completed with their optional weights from the term table.

Weights are the exact decimals that ``retrieval.bm25`` sums; bounds are
compared with half a unit of its rounding to spare, so ranks, ties
included, equal ``retrieval.best_chunks`` for every input.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import B, K1, TOP_K, question_terms, scaled_top, term_stats, term_weight
from tessera.session import materialize, release, scratch_path, shuffles_dropped

BLOCK = 128        # postings of a term's first block
GROWTH = 4         # how much larger each further block is
BINS = 256         # impact classes of the histogram that levels are cut from
PART_ROWS = 65_536 # postings of a block in one hash part
TASK_ROWS = 2_000_000   # postings that a task sorts and writes, at most about
TASK_PAIRS = 1_000_000  # pairs of question and chunk that a task sums, at most about
PROBES = 8         # chunks scored exactly per result row, for the second threshold
SLACK = 0.000001   # scores are ranked after rounding to 6 decimals


@dataclass
class Postings:
    """``table``: the term table ``(file, chunk, dl, term, tf)``. ``blocks``:
    ``(term, part, file, chunk, w, level)``, partitioned by level.
    ``directory``: ``(term, idf, level, n, parts, best)`` per block. ``k1, b``: the
    weights' parameters, ``avgdl`` the mean length they use."""
    table: DataFrame
    blocks: DataFrame
    directory: DataFrame
    avgdl: float | None
    k1: float
    b: float


def build_postings(table: DataFrame, k1: float = K1, b: float = B, block: int = BLOCK, root: str | None = None) -> Postings:
    """Blocks and directory of a ``term_table``, written below ``root``
    (default: the shared checkpoint folder)."""
    spark = table.sparkSession
    root = root or scratch_path(spark, f"postings-{uuid.uuid4().hex}")
    n, avgdl = term_stats(table).first()[0]  # two numbers
    mean = F.lit(avgdl)
    # share of the best weight that any chunk can have for the term, whatever the term's idf
    impact = term_weight(F.lit(1.0), F.col("tf"), F.col("dl"), mean, k1, b) / (k1 + 1)
    bin_ = F.least(F.lit(BINS - 1), F.floor((F.lit(1.0) - impact) * BINS)).cast("int")
    p = table.select("file", "chunk", "term", "tf", "dl", bin_.alias("bin"))
    hist = materialize(p.groupBy("term", "bin").agg(F.count(F.lit(1)).alias("n")))
    better = F.coalesce(F.sum("n").over(Window.partitionBy("term").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = F.sum("n").over(Window.partitionBy("term"))
    level = F.when(F.col("better") < block, 0).otherwise(1 + F.floor(F.log(float(GROWTH), F.col("better") / block)))
    levels = hist.withColumn("better", better).withColumn("df", df).withColumn("level", level.cast("int"))
    size = F.sum("n").over(Window.partitionBy("term", "level"))
    levels = materialize(levels.select("term", "bin", "level", _idf(n, F.col("df")).alias("idf"),
                                       F.ceil(size / PART_ROWS).cast("int").alias("parts")))
    w = F.round(term_weight(F.col("idf"), F.col("tf"), F.col("dl"), mean, k1, b), 9).cast("decimal(18,9)")
    rows = hist.agg(F.sum("n")).first()[0] or 0
    release(hist)
    placed = _spread(p, rows, TASK_ROWS, "term", "bin") if rows > TASK_ROWS * usual_parts(spark) else p
    placed = placed.join(levels, ["term", "bin"]).select(
        "term", F.pmod(F.xxhash64("file", "chunk"), F.col("parts")).cast("int").alias("part"), "file", "chunk", w.alias("w"), "level")
    path = f"{root}/blocks"
    # written where the join has them: a block's postings are not shuffled a second time
    with shuffles_dropped(spark):
        (placed.sortWithinPartitions("level", "term", "file", "chunk").write.option("compression", "zstd")
         .partitionBy("level").parquet(path))
    blocks = spark.read.schema(placed.schema).parquet(path)
    best = blocks.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("best"))
    directory = materialize(best.join(levels.select("term", "level", "idf", "parts").distinct(), ["term", "level"])
                            .select("term", "idf", "level", "n", "parts", "best"))
    return Postings(table, blocks, directory, avgdl, k1, b)


def _idf(n, df):
    return F.log(F.lit(1.0) + (F.lit(n) - df + 0.5) / (df + 0.5))


def _sums(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(query_id, file, chunk, have)`` over the postings of the wanted blocks
    ``(query_id, term, level, n, parts)``.

    The wanted postings are partitioned by chunk before they meet the
    questions (broadcast while they are small), so pairs of question and chunk
    are summed where they arise. The directory tells how many there are: a
    task has about ``TASK_PAIRS`` of them, however large the table is."""
    pairs = wanted.agg(F.sum("n")).first()[0] or 0
    keys = wanted.select("term", "level", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).distinct()
    own = blocks.join(keys, ["term", "level", "part"], "left_semi").select("term", "level", "file", "chunk", "w")
    return (_spread(own, pairs, TASK_PAIRS, "file", "chunk").join(wanted.select("query_id", "term", "level"), ["term", "level"])
            .groupBy("query_id", "file", "chunk").agg(F.sum("w").alias("have")))


def _spread(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """Partitioned by ``keys``, into more than the session's number of
    partitions where these would have over ``each`` of ``rows``."""
    parts = -(-rows // each)
    return df.repartition(*([parts] if parts > usual_parts(df.sparkSession) else []), *keys)


def usual_parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_blocks(questions: DataFrame, index: Postings, k: int = TOP_K) -> DataFrame:
    """``(query_id, term, idf, level, n, parts, best, threshold, optional,
    read)`` for every block of every question term: is the term optional, and
    has the block to be read in the second pass?"""
    q = question_terms(questions)
    d = materialize(q.join(index.directory, "term"))  # rows of the directory
    first = _sums(d.filter("level = 0"), index.blocks.filter("level = 0"))
    order = Window.partitionBy("query_id").orderBy(F.col("have").desc(), "file", "chunk")
    kth = (first.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
           .groupBy("query_id").agg(F.max("r").alias("found"), F.min("have").alias("have"))
           .select("query_id", F.when(F.col("found") == k, F.col("have")).alias("threshold")))
    kth = materialize(kth)  # one row a question
    # best weights per question term: few rows a question
    bound = d.groupBy("query_id", "term").agg(F.max("best").alias("bound"))
    run = Window.partitionBy("query_id").orderBy("bound", "term")
    bound = (bound.join(kth, "query_id", "left")
             .withColumn("below", F.sum("bound").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
             .withColumn("total", F.sum("bound").over(Window.partitionBy("query_id"))))
    threshold = F.coalesce(F.col("threshold"), F.lit(0).cast("decimal(28,9)"))
    slack = F.lit(SLACK).cast("decimal(28,9)")
    bound = bound.select("query_id", "term", "bound", "total", threshold.alias("threshold"),
                         (F.col("below") + slack < threshold).alias("optional"))
    reach = F.col("best") + F.col("total") - F.col("bound") + slack >= F.col("threshold")
    return d.join(bound, ["query_id", "term"]).select(
        "query_id", "term", "idf", "level", "n", "parts", "best", "bound", "threshold", "optional",
        (~F.col("optional") & reach).alias("read"))


def _completed(found: DataFrame, optional: DataFrame, index: Postings) -> DataFrame:
    """``(query_id, file, chunk, bm25)``: the essential sums ``have`` of the
    found chunks plus their weights of the optional terms, which are looked up
    in the term table."""
    w = F.round(term_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.lit(index.avgdl), index.k1, index.b), 9).cast("decimal(18,9)")
    asked = found.join(optional, "query_id").select("query_id", "file", "chunk", "term", "idf")
    more = (index.table.join(asked, ["file", "chunk", "term"]).groupBy("query_id", "file", "chunk")
            .agg(F.sum(w).alias("more")))
    exact = F.col("have") + F.coalesce("more", F.lit(0).cast("decimal(28,9)"))
    return (found.join(more, ["query_id", "file", "chunk"], "left")
            .select("query_id", "file", "chunk", F.round(exact, 6).cast("double").alias("bm25")))


def top_k(questions: DataFrame, index: Postings, k: int = TOP_K) -> DataFrame:
    """``(query_id, file, chunk, bm25, score, rank)`` of the ``k`` best chunks
    per question, as ``retrieval.best_chunks``."""
    plan = materialize(plan_blocks(questions, index, k))  # blocks of the question terms: rows of the directory
    terms = plan.filter("level = 0")
    optional = terms.filter("optional").select("query_id", "term", "idf")
    zero = F.lit(0).cast("decimal(28,9)")
    per_question = terms.groupBy("query_id").agg(
        F.first("threshold").alias("threshold"), F.sum(F.when(F.col("optional"), F.col("bound")).otherwise(zero)).alias("rest"))
    have = materialize(_sums(plan.filter("read"), index.blocks))
    # a better threshold: the k-th best of the chunks with the best essential sums, scored exactly
    order = Window.partitionBy("query_id").orderBy(F.col("have").desc(), "file", "chunk")
    probes = have.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= PROBES * k).drop("r")
    place = Window.partitionBy("query_id").orderBy(F.col("bm25").desc())
    reached = (_completed(probes, optional, index).withColumn("r", F.row_number().over(place)).filter(F.col("r") == k)
               .select("query_id", F.col("bm25").cast("decimal(28,9)").alias("reached")))
    bar = materialize(per_question.join(reached, "query_id", "left").select(
        "query_id", "rest", F.greatest("threshold", F.coalesce("reached", zero)).alias("bar")))
    slack = F.lit(SLACK).cast("decimal(28,9)")
    found = materialize(have.join(bar, "query_id").filter(F.col("have") + F.col("rest") + slack >= F.col("bar"))
                        .select("query_id", "file", "chunk", "have"))
    return scaled_top(_completed(found, optional, index), k)


def postings_read(questions: DataFrame, index: Postings, k: int = TOP_K) -> DataFrame:
    """``(query_id, postings, postings_read)``: the postings of the question's
    terms, and those that ``top_k`` reads in its two passes."""
    plan = plan_blocks(questions, index, k)
    read = F.col("read") | (F.col("level") == 0)
    return plan.groupBy("query_id").agg(F.sum("n").alias("postings"),
                                        F.sum(F.when(read, F.col("n")).otherwise(0)).alias("postings_read"))
