"""D5 topics: latent Dirichlet allocation over a written term table, by
expectation maximisation of the posterior (MAP).

Each step splits the ``tf`` of every posting over the topics in proportion to
the topic weights of its term and of its chunk, and sums the shares per chunk
and per term. Shares are summed as whole millionths: the result depends neither on
partitioning nor on the order of rows, and a rerun with the same seed is equal.

Chunks are dealt to blocks of at most about ``BLOCK_ROWS`` postings. Postings
are gathered by chunk where they are read; a block numbers its terms and holds a
chunk as one row of term numbers, packed once. A
step hands a block the counts of its own terms and chunks and gets their new
counts back, so what is shuffled by term is one row per block and term, never
a posting, and a chunk's weights never leave its block.

Nothing grows on the driver: there is no vocabulary limit and no matrix of all
terms; only ``k`` totals per step are collected. A common term has one row per
block. Every step is written to the shared folder, which cuts the lineage; the step
before it is then removed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize, release, ship_package

ALPHA, BETA = 0.1, 0.01  # weight of every topic in a chunk, of every term in a topic, before any count
UNIT = 1_000_000         # shares are counted in millionths
CHUNK = ["file", "chunk"]
BLOCK_ROWS = 4_000_000   # postings of a block in a large table
LEAST_ROWS = 100_000     # postings of a block where there are fewer blocks than tasks
SLICE = 500_000          # postings weighed at once inside a block


def _start(terms: DataFrame, k: int, seed: int) -> DataFrame:
    """``(block, kind, id, tid, x0..)``: a hash of term, topic and seed below
    2^30; the first weights are ``0.5 + x / 2^30``."""
    return terms.select("block", F.lit(0).alias("kind"), "id", "tid", *[F.pmod(F.xxhash64(F.col("term"), F.lit(seed), F.lit(i)), F.lit(1 << 30)).alias(f"x{i}") for i in range(k)])


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of a block: kind 0 is a term with its number in the block, kind 1
    a chunk with the numbers and frequencies of its terms."""
    rows = rows.reset_index(drop=True)
    ends = np.cumsum([len(x) for x in rows["names"]])
    at, terms = pd.factorize(np.concatenate(list(rows["names"])))
    block = rows["block"].iloc[0]
    nothing = [None] * len(terms)
    vocabulary = pd.DataFrame({"block": block, "kind": 0, "id": np.arange(len(terms)), "term": terms, "file": nothing,
                               "chunk": pd.array(nothing, "Int32"), "terms": nothing, "tfs": nothing})
    chunks = pd.DataFrame({"block": block, "kind": 1, "id": np.arange(len(rows)), "term": None, "file": rows["file"],
                           "chunk": rows["chunk"].astype("Int32"),
                           "terms": pd.Series(np.split(at.astype(np.int32), ends[:-1]), dtype=object), "tfs": rows["tfs"]})
    return pd.concat([vocabulary, chunks], ignore_index=True)


def _shares(k: int, totals: list[float] | None):
    """Function of a block's chunks and its counts ``(kind, id, tid, x0..)``
    (kind 0: by term, over all blocks; kind 1: by chunk) that gives the
    block's new counts in the same form. Without ``totals`` it is the first
    step: no counts by chunk, and hashes in place of counts by term."""
    columns = [f"x{i}" for i in range(k)]

    def placed(rows):
        out = np.zeros((k, int(rows["id"].max()) + 1))
        out[:, rows["id"].to_numpy()] = rows[columns].to_numpy(dtype=np.float64).T
        return out

    def run(chunks: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(chunks):
            return pd.DataFrame(columns=["block", "kind", "id", "tid", *columns])
        by_term = state[state["kind"] == 0]
        phi, theta = placed(by_term), None
        size = phi.shape[1]
        if totals is None:
            phi = 0.5 + phi / (1 << 30)
        else:
            phi = (phi / UNIT + BETA) / np.array(totals)[:, None]
            theta = placed(state[state["kind"] == 1])[:, chunks["id"].to_numpy()] / UNIT + ALPHA
        lengths = np.array([len(x) for x in chunks["terms"]])
        ends = np.cumsum(lengths)
        of_terms, of_chunks, used = np.zeros((k, size), np.int64), np.zeros((k, len(chunks)), np.int64), np.zeros(size, bool)
        lo = 0
        while lo < len(chunks):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
            term = np.concatenate(list(chunks["terms"].iloc[lo:hi]))
            tf = np.concatenate(list(chunks["tfs"].iloc[lo:hi])).astype(np.float64)
            own = np.repeat(np.arange(lo, hi), lengths[lo:hi])
            raw = [p[term] if theta is None else p[term] * theta[i][own] for i, p in enumerate(phi)]
            whole = reduce(lambda a, b: a + b, raw)
            starts = np.concatenate([[0], np.cumsum(lengths[lo:hi])[:-1]])
            used[term] = True
            for i in range(k):
                share = np.floor(tf * raw[i] / whole * UNIT + 0.5)
                of_chunks[i, lo:hi] = np.add.reduceat(share, starts)
                of_terms[i] += np.bincount(term, weights=share, minlength=size).astype(np.int64)
            lo = hi
        tids = np.zeros(size, np.int64)
        tids[by_term["id"].to_numpy()] = by_term["tid"].to_numpy()
        found = np.flatnonzero(used)
        return pd.DataFrame({
            "block": chunks["block"].iloc[0], "kind": np.repeat([0, 1], [len(found), len(chunks)]),
            "id": np.concatenate([found, chunks["id"].to_numpy()]),
            "tid": np.concatenate([tids[found], np.zeros(len(chunks), np.int64)]),
            **{c: np.concatenate([of_terms[i][found], of_chunks[i]]) for i, c in enumerate(columns)}})
    return run


def topic_model(table: DataFrame, k: int = 8, steps: int = 12, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``(chunks, terms)`` from a ``retrieval.term_table``: ``(file, chunk,
    weights, topic)`` with the ``k`` topic weights of every chunk, which sum to
    1, and its largest topic (ties: the first), and ``(term, counts, weights)``
    with the term's count in every topic and its probability in it. Chunks
    without terms have no row; an empty table gives no rows. Chunks with a NULL
    in their name count in the first step only."""
    topics = range(k)
    spark = table.sparkSession
    ship_package(spark)
    n = table.count()
    blocks = max(-(-n // BLOCK_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)), 1)
    block = F.pmod(F.xxhash64(*CHUNK), F.lit(blocks)).cast("int").alias("block")
    packed = (table.select(block, *CHUNK, "term", "tf").groupBy("block", *CHUNK)
              .agg(F.collect_list("term").alias("names"), F.collect_list("tf").alias("tfs")))
    packed = materialize(packed.groupBy("block").applyInPandas(
        _pack, "block int, kind int, id int, term string, file string, chunk int, terms array<int>, tfs array<long>"))
    own = packed.filter("kind = 0").select("block", "id", "term")
    names = materialize(own.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")))
    chunks = packed.filter("kind = 1").select(*[F.col(c).alias(c) for c in ("block", "id", *CHUNK, "terms", "tfs")])
    named = chunks.filter("file IS NOT NULL AND chunk IS NOT NULL")
    starts = own.join(names, "term").select("block", "id", "term", "tid")
    state = _start(starts, k, seed)
    counts = [f"x{i}" for i in topics]
    every = Window.partitionBy("tid")
    totals, step = None, None
    for s in range(steps):
        mine = (chunks if s == 0 else named).select("block", "id", "terms", "tfs")
        last, step = step, materialize(mine.groupBy("block").cogroup(state.select("block", "kind", "id", "tid", *counts).groupBy("block")).applyInPandas(
            _shares(k, totals), f"block int, kind int, id int, tid long, {', '.join(c + ' long' for c in counts)}"))
        if last is not None:
            release(last)
        by_term = step.filter("kind = 0")
        if s < 2:  # then the terms stay the same
            size = by_term.select("tid").distinct().count()
        total = by_term.agg(*[F.sum(c).alias(c) for c in counts]).first()  # k numbers
        totals = [(total[c] or 0) / UNIT + size * BETA for c in counts]
        state = by_term.select("block", "kind", "id", "tid", *[F.sum(c).over(every).alias(c) for c in counts]).unionByName(
            step.filter("kind = 1"))
    theta = step.filter("kind = 1").join(chunks.select("block", "id", *CHUNK), ["block", "id"]).select(
        *CHUNK, *[(F.col(c) / UNIT + ALPHA).alias(f"h{i}") for i, c in enumerate(counts)])
    whole = reduce(lambda a, b: a + b, [F.col(f"h{i}") for i in topics])
    weights = F.array(*[F.col(f"h{i}") / whole for i in topics])
    weighed = theta.select(*CHUNK, weights.alias("weights"))
    weighed = weighed.withColumn("topic", (F.array_position("weights", F.array_max("weights")) - 1).cast("int"))
    sums = step.filter("kind = 0").groupBy("tid").agg(*[F.sum(c).alias(c) for c in counts]).join(names, "tid")
    terms = sums.select("term", F.array(*[F.col(c) / UNIT for c in counts]).alias("counts"),
                        F.array(*[(F.col(c) / UNIT + BETA) / F.lit(t) for c, t in zip(counts, totals)]).alias("weights"))
    return weighed, terms


def topic_words(terms: DataFrame, n: int = 10) -> DataFrame:
    """``(topic, words)``: the ``n`` most probable terms of every topic (ties:
    smallest term)."""
    each = terms.select("term", F.posexplode("weights").alias("topic", "weight"))
    order = Window.partitionBy("topic").orderBy(F.col("weight").desc(), "term")
    best = each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n)
    return best.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("words"))
