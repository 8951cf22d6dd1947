"""Rows in = rows out: key assignment over many partitions, index commits,
statuses, index JSON and object keys."""

import json
import os

from pyspark.sql import functions as F

from tessera.operators import quality as Q
from tessera.plans.indexing_run import empty_index, index_documents
from tessera.sources.objects import read_objects
from tessera.sources.store import import_index_json, read_index, write_index


def test_append_many_rows_over_many_partitions(spark):
    n = 300_000
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        target = spark.createDataFrame([(5, "x", "old@x")], "id long, name string, email string")
        batch = spark.range(n).select(F.repeat(F.lit("n"), 100).alias("name"),
                                      F.concat(F.md5(F.col("id").cast("string")), F.lit("@x")).alias("email"))
        out = Q.append_with_keys(target, batch, "id", "email").filter("outcome = 'inserted'")
        got = out.agg(F.count("id").alias("c"), F.countDistinct("id").alias("d"), F.min("id").alias("a"),
                      F.max("id").alias("b")).first()
        assert tuple(got) == (n, n, 6, n + 5)
        pairs = out.select("id", "email").orderBy("id").limit(1000).collect()
        assert [r.email for r in pairs] == sorted(r.email for r in pairs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_append_null_unique_is_rejected_not_lost(spark):
    target = spark.createDataFrame([(1, "a", "a@x")], "id long, name string, email string")
    batch = spark.createDataFrame([("n", None), ("m", "m@x"), (None, "z@x")], "name string, email string")
    got = sorted(((r.email, r.outcome, r.id) for r in Q.append_with_keys(target, batch, "id", "email").collect()), key=str)
    assert got == [("m@x", "inserted", 2), ("z@x", "inserted", 3), (None, "rejected", None)]


def test_commits_are_per_stream(spark, workdir):
    root = workdir + "/index"
    a = spark.createDataFrame([("a", 1, 1, "s")], "key string, chunk_no int, chunks int, summary string")
    both = a.unionByName(a.withColumn("key", F.lit("b")))
    assert write_index(a, root, batch=0, stream="one") == 1
    assert write_index(a, root, batch=0, stream="one") == 1
    assert write_index(both, root, batch=0, stream="two") == 2
    assert {r.key for r in read_index(spark, root).collect()} == {"a", "b"}


def test_every_object_gets_a_status(spark):
    rows = [("a.txt", b"some text"), ("b.txt", None), ("c.txt", "\u2003\u00a0 \x1c".encode()), ("d.txt", b""),
            ("e.bin", b"x"), ("f.pdf", b"pdf"), ("g.pdf", b"bad")]
    objects = spark.createDataFrame(rows, "key string, content binary")

    def extract(content):
        if bytes(content) == b"bad":
            raise ValueError("broken")
        return "extracted words"

    plain = {r.key: r.status for r in index_documents(objects, empty_index(spark))[0].collect()}
    assert plain == {"a.txt": "Processed", "b.txt": "Error", "c.txt": "Empty", "d.txt": "Empty", "e.bin": "Skipped",
                     "f.pdf": "Skipped", "g.pdf": "Skipped"}
    status, index = index_documents(objects, empty_index(spark), extractor=extract)
    assert {r.key: r.status for r in status.collect()} == plain | {"f.pdf": "Processed", "g.pdf": "Error"}
    assert {r.key for r in index.collect()} == {"a.txt", "f.pdf"}


def test_index_json_as_one_indented_object(spark, workdir):
    whole = {"a": {"chunks": 2, "summaries": ["x", "y"]}, "b": {"chunks": 1, "summaries": ["z"]}}
    for name, text in (("one", json.dumps(whole, indent=4)), ("flat", json.dumps(whole)), ("bad", "{ not json")):
        path = f"{workdir}/{name}.json"
        with open(path, "w") as f:
            f.write(text)
        got = sorted((r.key, r.chunk_no, r.chunks, r.summary) for r in import_index_json(spark, path).collect())
        assert got == ([] if name == "bad" else [("a", 1, 2, "x"), ("a", 2, 2, "y"), ("b", 1, 1, "z")])


def test_object_keys_for_uri_roots(spark, workdir):
    os.makedirs(f"{workdir}/it's/sub")
    for k in ("it's/sub/a.txt", "it's/b.txt"):
        with open(f"{workdir}/{k}", "w") as f:
            f.write("x")
    for root in (workdir, f"file://{workdir}", f"file:{workdir}", workdir + "/"):
        assert {r.key for r in read_objects(spark, root).collect()} == {"it's/sub/a.txt", "it's/b.txt"}
    assert [r.key for r in read_objects(spark, workdir, prefix="it's/s").collect()] == ["it's/sub/a.txt"]


def test_raising_counter_is_an_error_status_and_keeps_the_old_entry(spark):
    from tessera.plans.indexing_run import index_documents

    def counter(words):
        if "boom" in words:
            raise ValueError("bad document")
        return [1] * len(words)
    objects = spark.createDataFrame([("a.txt", bytearray(b"one two three")), ("b.txt", bytearray(b"x boom y"))],
                                    "key string, content binary")
    index = spark.createDataFrame([("b.txt", 1, 1, "old")], "key string, chunk_no int, chunks int, summary string")
    status, new_index = index_documents(objects, index, max_tokens=2, counter=counter)
    assert {r.key: (r.status, r.chunks) for r in status.collect()} == {"a.txt": ("Processed", 2), "b.txt": ("Error", None)}
    rows = new_index.collect()
    assert sorted((r.key, r.chunk_no) for r in rows) == [("a.txt", 1), ("a.txt", 2), ("b.txt", 1)]
    assert [r.summary for r in rows if r.key == "b.txt"] == ["old"]
