"""What is shuffled: rows that grow with (question, chunk) pairs or with the
terms of all chunks stay where they are."""
import re

from tessera.operators import annotate as AN
from tessera.operators import graph as G
from tessera.operators import retrieval as T
from tessera.plans.indexing_run import index_updates

TEXTS = ["The cat sat. A dog ran!", "A dog and a cat. The end.", "Nothing here? No. A bird", "the the the"]


def chunks(spark, n=40):
    return spark.createDataFrame([(f"f{i:02d}", i % 3, f"{TEXTS[i % 4]} word{i}.") for i in range(n)], "file string, chunk int, text string")


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)]


def questions(spark):
    return spark.createDataFrame([(1, "the cat"), (2, "a dog ran"), (3, "unknown"), (3, "bird")], "query_id bigint, text string")


def test_pairs_are_not_shuffled(spark):
    table = T.term_table(chunks(spark))
    for df in (T.bm25(questions(spark), table), T.score_chunks(questions(spark), None, table=table)):
        assert all("query_id" not in x or x.startswith("query_id, 4") for x in exchanges(df)), exchanges(df)
    for df in (T.best_chunks(questions(spark), None, table=table), T.top_chunks(T.score_chunks(questions(spark), None, table=table))):
        assert not any(re.match("query_id, (file|_)", x) for x in exchanges(df)), exchanges(df)
        assert "Partial" in re.search(r"WindowGroupLimit.*", df._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(query_id")[1])[0]


def test_top_chunks_of_scored_rows_equal_best_chunks(spark):
    table = T.term_table(chunks(spark))
    cols = ["query_id", "file", "chunk", "bm25", "score", "rank"]
    a = T.top_chunks(T.score_chunks(questions(spark), None, table=table)).select(*cols).collect()
    b = T.best_chunks(questions(spark), None, table=table).select(*cols).collect()
    assert sorted(a) == sorted(b) and len(a) == 9


def test_kept_rows_are_written_before_they_meet_the_texts(spark):
    ch = chunks(spark)
    top = T.best_chunks(questions(spark), None, table=T.term_table(ch))
    for df in (T.answers(questions(spark), top, ch), T.summarize_context(questions(spark), top, ch)):
        assert not any(x.startswith("file") for x in exchanges(df)), exchanges(df)


def test_frequencies_count_chunks_once(spark):
    rows = chunks(spark).unionByName(chunks(spark)).unionByName(
        spark.createDataFrame([("f00", 0, "cat"), ("f00", 0, "cat cat dog"), (None, 0, "cat")], "file string, chunk int, text string"))
    got = {r.term: r.df for r in T.frequencies(rows, T.term_table(rows)).collect()}
    tf = AN.term_frequencies(rows, "text", ["file", "chunk"])
    want = {r.term: r["count"] for r in tf.groupBy("term").count().collect()}
    assert got == want | {"": rows.count()}


def test_annotation_shuffles_texts_and_frequencies_only(spark):
    ch = chunks(spark).select(AN.F.col("file").alias("key"), AN.F.col("chunk").alias("chunk_no"), AN.F.col("text").alias("chunk"))
    df = AN.annotate_chunks(ch)
    assert {x.rpartition(", ")[0] for x in exchanges(df)} == {"key, chunk_no"}
    got = {r.key: r for r in df.collect()}
    assert got["f00"].keywords[0] == "ran" and got["f00"].title == "The cat sat."
    assert got["f03"].keywords == ["the", "word"] and got["f03"].summary == "the the the word3."


def test_graph_difference_counts_each_row_once(spark):
    nodes = "id string, label string"
    a, b = spark.createDataFrame([("x", "x")] * 3 + [("y", None)], nodes), spark.createDataFrame([("x", "x")] + [("z", "z")] * 2, nodes)
    none = spark.createDataFrame([], "`from` string, `to` string, type string")
    df = G.graph_changed(a, none, b, none, [])
    assert len(exchanges(df)) == 1
    assert sorted((r.change, r.id) for r in df.collect()) == [("added", "z")] * 2 + [("removed", "x")] * 2 + [("removed", "y")]


def test_tasks_do_not_grow_with_the_table(spark, monkeypatch):
    ch = chunks(spark)
    asked = questions(spark).filter("query_id < 3")
    want = sorted(T.best_chunks(asked, None, table=T.term_table(ch)).collect())
    monkeypatch.setattr(T, "TASK_CHARS", 100)
    monkeypatch.setattr(T, "TASK_PAIRS", 7)
    table = T.term_table(ch)
    parts = {f.rsplit("/", 1)[1].split("-")[1] for f in table.inputFiles()}
    assert len(parts) > 4  # the session's number of partitions
    scored = T.bm25(asked, table)
    pairs = T.question_terms(asked).join(table, "term").count()
    assert f"file, chunk, {-(-pairs // 7)}" in exchanges(scored) and pairs > 28
    assert sorted(T.best_chunks(asked, None, table=table).collect()) == want


def test_annotation_tasks_do_not_grow_with_the_table(spark, monkeypatch):
    ch = chunks(spark).select(AN.F.col("file").alias("key"), AN.F.col("chunk").alias("chunk_no"), AN.F.col("text").alias("chunk"))
    want = sorted(AN.annotate_chunks(ch).collect())
    monkeypatch.setattr(AN, "TASK_CHARS", 100)
    chars = sum(len(r.chunk) for r in ch.collect())
    df = AN.annotate_chunks(ch)
    assert set(exchanges(df)) == {f"key, chunk_no, {-(-chars // 100)}"} and chars > 400
    assert sorted(df.collect()) == want
    none = ch.filter("false")
    assert AN.annotate_chunks(none).count() == 0
    assert T.term_table(none.select(AN.F.col("key").alias("file"), AN.F.col("chunk_no").alias("chunk"), AN.F.col("chunk").alias("text"))).count() == 0


def test_terms_are_found_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(T, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    rows = spark.createDataFrame([("a", 1, None), ("b", 1, ""), ("c", 1, "x y x")], "file string, chunk int, text string")
    assert sorted(map(tuple, T.term_table(rows).collect())) == [("c", 1, 3, "x", 2), ("c", 1, 3, "y", 1)]
    assert plans[0].count("regexp_extract_all") == 1, plans[0]


def test_index_run_hashes_and_joins_texts_once(spark):
    objs = spark.createDataFrame([("a.txt", b"One. Two."), ("b.txt", b"Three."), ("c.txt", b" ")], "key string, content binary")
    empty = spark.createDataFrame([], "key string, chunk_no int, chunks int, summary string, text_hash string")
    status, updates = index_updates(objs, empty, by="hash")
    for df in (status, updates):
        assert "sha2" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.key, r.status) for r in status.collect()) == [("a.txt", "Processed"), ("b.txt", "Processed"), ("c.txt", "Empty")]
    assert sorted(r.key for r in updates.collect()) == ["a.txt", "b.txt"]
