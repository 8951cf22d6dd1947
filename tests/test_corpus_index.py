"""The state-backed index stream against one batch run over the same objects."""

import os
import random

from pyspark.sql import functions as F

from tessera.plans.indexing_run import empty_index, index_documents
from tessera.streaming import corpus_index as CI


def put(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def text(rnd, n):
    return " ".join(rnd.choice(["Red", "fox", "runs.", "Blue", "sea", "waits!", "stone", "wind"]) + rnd.choice("abc") for _ in range(n)).encode()


def batch_run(spark, src, **options):
    newest = {}
    for folder, _, names in os.walk(src):
        for n in names:
            version, key = os.path.relpath(os.path.join(folder, n), src).split("/", 1)
            newest[key] = max(newest.get(key, ("",)), (version, open(os.path.join(folder, n), "rb").read()))
    rows = [(k, v[1]) for k, v in newest.items()]
    objects = spark.createDataFrame(rows, "key string, content binary")
    status, index = index_documents(objects, empty_index(spark), **options)
    return sorted(map(tuple, status.collect()), key=str), sorted(map(tuple, index.collect()))


def test_waves_equal_one_batch(spark, workdir):
    rnd = random.Random(4)
    src, root = workdir + "/src", workdir + "/index"
    key = F.regexp_extract("path", "/v[0-9]/(.*)$", 1)  # folders v1, v2 hold versions of the objects
    put(src, "v1/a/1.txt", text(rnd, 40))
    put(src, "v1/a/2.md", b" \n ")
    put(src, "v1/b.bin", b"x")
    put(src, "v1/c.txt", text(rnd, 3))
    CI.index_new_objects(spark, src, root, key, max_tokens=20)
    first = batch_run(spark, src, max_tokens=20)
    assert sorted(map(tuple, CI.published_index(spark, root).collect())) == first[1]
    early = {r.key: r.summary for r in CI.published_index(spark, root).collect() if r.key == "a/1.txt" and r.chunk_no == 1}
    for n in range(6):
        put(src, f"v2/d/{n}.txt", text(rnd, 25))
    put(src, "v2/c.txt", text(rnd, 30))  # another text under a known key
    CI.index_new_objects(spark, src, root, key, max_tokens=20)
    CI.index_new_objects(spark, src, root, key, max_tokens=20)  # nothing new
    status, index = batch_run(spark, src, max_tokens=20)
    assert sorted(map(tuple, CI.published_index(spark, root).collect())) == index
    assert sorted(map(tuple, CI.stored_statuses(spark, root).collect()), key=str) == status
    assert {s for _, s, _ in status} == {"Processed", "Empty", "Skipped"}
    late = {k: s for k, n, _, s in index if k == "a/1.txt" and n == 1}
    assert early.keys() == late.keys()
    n_chunks = CI.stored_statistics(spark, root).filter("term = ''").first().df
    assert n_chunks == len(index)


def test_a_replayed_batch_changes_nothing(spark, workdir):
    rnd = random.Random(5)
    src, root = workdir + "/src", workdir + "/index"
    put(src, "a.txt", text(rnd, 30))
    CI.index_new_objects(spark, src, root)
    frequencies = sorted(map(tuple, CI.stored_statistics(spark, root).collect()))
    stream = CI.commits(spark, root + "/chunks")[0].stream
    # a batch that stopped between its commit and the publishing of its changes
    os.rename(f"{root}/changes/{stream}-0", f"{root}/staged/{stream}-0")
    apply = CI._ingest(spark, root, F.col("path"), {})
    batch = spark.createDataFrame([("a.txt", b"other words")], "path string, content binary").withColumn(
        "modificationTime", F.current_timestamp())
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", stream)
    try:
        apply(batch, 0)
    finally:
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
    assert os.path.isdir(f"{root}/changes/{stream}-0") and len(CI.commits(spark, root + "/chunks")) == 1
    assert sorted(map(tuple, CI.stored_statistics(spark, root).collect())) == frequencies
