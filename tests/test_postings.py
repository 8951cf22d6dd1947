import random

from pyspark.sql import functions as F

from tessera.operators import postings as P
from tessera.operators import retrieval as T

COLS = ["query_id", "file", "chunk", "bm25", "score", "rank"]


def corpus(seed, n_files):
    """Most chunks hold the common terms, few a rare one, some are copies."""
    rnd = random.Random(seed)
    common = ["the", "and", "of", "to", "in"]
    rare = [f"w{a}{b}" for a in "abcdef" for b in "abcdef"]
    chunks = []
    for f in range(n_files):
        words = [rnd.choice(common) for _ in range(rnd.randint(5, 60))] + [rnd.choice(rare) for _ in range(rnd.randint(0, 3))]
        rnd.shuffle(words)
        chunks.append((f"f{f:04d}", 1 + f % 3, " ".join(words) + "."))
    chunks += [(f"g{f:04d}", 1, "the and of") for f in range(n_files // 5)] + [("h", 1, None), ("h", 2, "1 2 3")]
    return chunks


QUESTIONS = [(1, "the wab and"), (2, "the and of to"), (3, "wcd wfe the"), (4, "zzz"), (5, "wbb"), (6, "of of OF"),
             (7, None), (8, "the and of to in waa wbc wde wfa"), (9, "wab wab waf wee")]


def frames(spark, seed=7, n_files=900):
    c = spark.createDataFrame(corpus(seed, n_files), "file string, chunk int, text string")
    return spark.createDataFrame(QUESTIONS, "query_id bigint, text string"), T.term_table(c)


def test_block_max_top_k_equals_full_scoring(spark):
    for seed, n_files, block, ks in ((7, 900, 16, (1, 3, 10)), (8, 40, 4, (3, 100)), (9, 300, 1, (2,))):
        questions, table = frames(spark, seed, n_files)
        index = P.build_postings(table, block=block)
        for k in ks:
            want = sorted(T.best_chunks(questions, None, k, table=table).select(*COLS).collect())
            assert sorted(P.top_k(questions, index, k).select(*COLS).collect()) == want


def test_blocks_are_cut_by_impact_and_skipped(spark):
    questions, table = frames(spark)
    index = P.build_postings(table, block=16)
    assert index.blocks.count() == table.count()
    by_term = {}
    for r in index.directory.collect():
        by_term.setdefault(r.term, []).append((r.level, r.n, r.best))
    for levels in by_term.values():
        levels.sort()
        assert [b for _, _, b in levels] == sorted((b for _, _, b in levels), reverse=True)
    assert max(len(v) for v in by_term.values()) >= 3 and len(by_term["wab"]) <= 2
    read = {r.query_id: (r.postings, r.postings_read) for r in P.postings_read(questions, index).collect()}
    assert read[1][1] < read[1][0] / 3  # a rare term makes the common ones optional
    assert read[3][1] < read[3][0] / 3
    assert all(a >= b for a, b in read.values())
    first = P._sums(P.plan_blocks(questions, index).filter("level = 0"), index.blocks.filter("level = 0"))
    plan = first._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "(level#" in plan and " = 0)" in plan  # other levels are not listed


def test_block_max_of_an_empty_corpus_and_of_equal_weights(spark):
    questions, _ = frames(spark, 1, 10)
    empty = T.term_table(spark.createDataFrame([], "file string, chunk int, text string"))
    assert P.top_k(questions, P.build_postings(empty)).count() == 0
    same = spark.createDataFrame([(f"f{i:03d}", 1, "the and") for i in range(200)], "file string, chunk int, text string")
    table = T.term_table(same)
    got = sorted(P.top_k(questions, P.build_postings(table, block=4)).select(*COLS).collect())
    assert got == sorted(T.best_chunks(questions, None, table=table).select(*COLS).collect())
    assert [r.file for r in got if r.query_id == 1] == ["f000", "f001", "f002"]


def test_hot_block_is_spread_over_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_ROWS", 50)
    questions, table = frames(spark)
    index = P.build_postings(table, block=16)
    parts = index.blocks.groupBy("term", "level").agg(F.countDistinct("part").alias("p"), F.count(F.lit(1)).alias("n"))
    assert parts.filter("n > 200 AND p < 4").count() == 0
    assert sorted(P.top_k(questions, index).select(*COLS).collect()) == sorted(
        T.best_chunks(questions, None, table=table).select(*COLS).collect())


def test_pairs_of_a_task_are_bounded_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_PAIRS", 200, raising=False)
    monkeypatch.setattr(P, "TASK_ROWS", 500, raising=False)
    questions, table = frames(spark)
    index = P.build_postings(table, block=16)
    plan = P.materialize(P.plan_blocks(questions, index))
    sums = P._sums(plan, index.blocks)
    sizes = [r.n for r in sums.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 800 and sum(sizes) > 2000
    assert "hashpartitioning(query_id" not in sums._jdf.queryExecution().executedPlan().toString()
    assert sorted(P.top_k(questions, index).select(*COLS).collect()) == sorted(
        T.best_chunks(questions, None, table=table).select(*COLS).collect())


def test_postings_are_shuffled_once_to_their_blocks(spark, monkeypatch):
    import os
    questions, table = frames(spark)
    asked, spread, tables, write = [], P._spread, [], P.materialize
    monkeypatch.setattr(P, "TASK_ROWS", 50, raising=False)
    monkeypatch.setattr(P, "_spread", lambda df, rows, each, *keys: asked.append(keys) or spread(df, rows, each, *keys))
    monkeypatch.setattr(P, "materialize", lambda df: tables.append(write(df)) or tables[-1])
    index = P.build_postings(table, block=16)
    assert asked == [("term", "bin")]
    assert not os.path.isdir(tables[0]._written.removeprefix("file:"))  # the histogram
    assert sorted(P.top_k(questions, index).select(*COLS).collect()) == sorted(
        T.best_chunks(questions, None, table=table).select(*COLS).collect())
