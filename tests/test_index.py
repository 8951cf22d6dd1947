from pyspark.sql import functions as F

from tessera.operators import indexing as D
from tessera.operators.annotate import annotate_chunks
from tessera.plans.indexing_run import empty_index, index_documents, index_updates
from tessera.sources.store import (append_index, compact_index, export_index_json, import_index_json, live_parts, read_index,
                                   write_index)

INDEX = "key string, chunk_no int, chunks int, summary string"


def test_index_status_states(spark):
    index = spark.createDataFrame([("same", 1, 2, "s1"), ("same", 2, 2, "s2"), ("grew", 1, 1, "g"),
                                   ("gone", 1, 1, "x"), ("edited", 1, 1, "old")], INDEX)
    counts = spark.createDataFrame([("same", 2), ("grew", 3), ("new", 1), ("edited", 1)], "key string, chunks int")
    st = {r.key: r.status for r in D.index_status(counts, index).collect()}
    assert st == {"same": "Cached", "grew": "Processed", "new": "Processed", "edited": "Cached"}
    # by hash: same count but changed text is processed
    idx_h = spark.createDataFrame([("edited", "h-old")], "key string, text_hash string")
    c_h = spark.createDataFrame([("edited", 1, "h-new")], "key string, chunks int, text_hash string")
    assert D.index_status(c_h, idx_h, by="hash").collect()[0].status == "Processed"


def test_upsert_idempotent_and_pack(spark):
    index = spark.createDataFrame([("a", 1, 1, "a1"), ("b", 1, 2, "b1"), ("b", 2, 2, "b2")], INDEX)
    upd = spark.createDataFrame([("b", 2, 2, "B2"), ("b", 1, 2, "B1"), ("c", 1, 1, "c1")], INDEX)
    once = D.upsert_index(index, upd)
    twice = D.upsert_index(once, upd)
    assert sorted(once.collect()) == sorted(twice.collect())
    packed = {r.key: (r.chunks, r.summaries) for r in D.pack_index(once).collect()}
    assert packed == {"a": (1, ["a1"]), "b": (2, ["B1", "B2"]), "c": (1, ["c1"])}
    ex = sorted((r.file, r.chunk, r.summary) for r in D.explode_index(D.pack_index(once)).collect())
    assert ex[:3] == [("a", 1, "a1"), ("b", 1, "B1"), ("b", 2, "B2")]
    pruned = D.upsert_index(index, upd, prune_keys=spark.createDataFrame([("b",), ("c",)], "key string"))
    assert {r.key for r in pruned.collect()} == {"b", "c"}


def test_fill_failed_and_guarded(spark):
    df = spark.createDataFrame([("k", None), ("j", ""), ("i", "ok")], "key string, summary string")
    got = {r.key: r.summary for r in D.fill_failed(df).collect()}
    assert got == {"k": D.FAILED, "j": D.FAILED, "i": "ok"}

    def hook(text):
        if text == "boom":
            raise ValueError("bad input")
        return text.upper()
    g = {r.t: (r.out, r.error) for r in D.guarded(
        spark.createDataFrame([("boom",), ("fine",)], "t string"), hook, "t", "out").collect()}
    assert g["fine"] == ("FINE", None) and g["boom"][0] is None and "bad input" in g["boom"][1]


def test_annotations(spark):
    chunks = spark.createDataFrame([
        ("d1", 1, "Cats purr softly. Dogs bark loudly at night! Cats sleep."),
        ("d2", 1, "Dogs run. Birds sing."),
    ], "key string, chunk_no int, chunk string")
    a = {r.key: r for r in annotate_chunks(chunks, n_keywords=2, n_sentences=1).collect()}
    assert a["d1"].title == "Cats purr softly."
    assert a["d1"].keywords[0] == "cats"
    assert a["d1"].annotation.startswith("Title: Cats purr softly.\nKeywords: cats")


def test_index_run_statuses(spark):
    objs = spark.createDataFrame([
        ("a.txt", b"one two three"), ("b.md", b"  \n "), ("c.bin", b"x"), ("d.pdf", b"%PDF"),
    ], "key string, content binary")
    status, idx = index_documents(objs, empty_index(spark), max_tokens=2, checkpoint=False)
    st = {r.key: r.status for r in status.collect()}
    assert st == {"a.txt": "Processed", "b.md": "Empty", "c.bin": "Skipped", "d.pdf": "Skipped"}
    assert idx.filter(F.col("key") == "a.txt").count() == 2
    status2, _ = index_documents(objs, idx, max_tokens=2, checkpoint=False)
    assert {r.key: r.status for r in status2.collect()}["a.txt"] == "Cached"
    summary = {r.status: r.documents for r in D.index_run_summary(status).collect()}
    assert summary == {"Processed": 1, "Empty": 1, "Skipped": 2}


def test_store_snapshots(spark, workdir):
    root = workdir + "/index"
    assert read_index(spark, root).count() == 0
    i1 = spark.createDataFrame([("a", 1, 1, "x")], INDEX)
    assert write_index(i1, root, batch=0) == 1
    assert write_index(i1, root, batch=0) == 1  # replayed batch is not written twice
    i2 = D.upsert_index(read_index(spark, root), spark.createDataFrame([("b", 1, 1, "y")], INDEX))
    assert write_index(i2, root) == 2
    assert sorted(r.key for r in read_index(spark, root).collect()) == ["a", "b"]
    export_index_json(read_index(spark, root), workdir + "/json")
    assert sorted(import_index_json(spark, workdir + "/json").collect()) == sorted(read_index(spark, root).collect())


def test_appended_parts_replace_keys_and_compact(spark, workdir):
    root = workdir + "/parts"
    write_index(spark.createDataFrame([("a", 1, 1, "a1"), ("b", 1, 2, "b1"), ("b", 2, 2, "b2"), (None, 1, 1, "n")], INDEX), root)
    append_index(spark.createDataFrame([("b", 1, 1, "B1"), ("c", 1, 1, "c1")], INDEX), root, batch=0, stream="s")
    append_index(spark.createDataFrame([("x", 1, 1, "x")], INDEX), root, batch=0, stream="s")  # replay
    append_index(spark.createDataFrame([("c", 1, 1, "C1", "h")], INDEX + ", text_hash string"), root)
    want = [("B1", "b", None), ("C1", "c", "h"), ("a1", "a", None), ("n", None, None)]

    def stored():
        return sorted((r.summary, r.key, r.text_hash) for r in read_index(spark, root, hashes=True).collect())
    assert stored() == want and live_parts(spark, root) == [1, 2, 3]
    assert compact_index(spark, root) == 4
    assert stored() == want and live_parts(spark, root) == [4]


def test_run_by_hash_sees_an_edit_with_the_same_chunk_count(spark, workdir):
    root = workdir + "/hash"

    def run(text):
        objs = spark.createDataFrame([("a.txt", text), ("b.txt", b"never changes.")], "key string, content binary")
        status, updates = index_updates(objs, read_index(spark, root, hashes=True), by="hash")
        found = {r.key: r.status for r in status.collect()}
        append_index(updates, root)
        return found
    assert run(b"Old words.") == {"a.txt": "Processed", "b.txt": "Processed"}
    assert run(b"New words.") == {"a.txt": "Processed", "b.txt": "Cached"}
    assert {r.key: r.summary.split("\n")[0] for r in read_index(spark, root).collect()} == {
        "a.txt": "Title: New words.", "b.txt": "Title: never changes."}
