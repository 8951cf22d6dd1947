"""Commits of several writers, data skipping, compaction beside appends."""

import threading

from pyspark.sql import functions as F

from tessera.sources import store as S

INDEX = "key string, chunk_no int, chunks int, summary string"


def rows(spark, keys, text):
    return spark.createDataFrame([(k, 1, 1, text) for k in keys], INDEX)


def test_concurrent_writers_lose_nothing(spark, workdir):
    root, errors = workdir + "/many", []

    def write(n):
        try:
            S.append_index(rows(spark, [f"own{n}", "shared"], f"w{n}"), root, batch=0, stream=f"s{n}")
        except Exception as e:
            errors.append(e)
    writers = [threading.Thread(target=write, args=(n,)) for n in range(8)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors
    found = S.commits(spark, root)
    assert [c.number for c in found] == list(range(1, 9)) and len({c.part for c in found}) == 8
    got = {r.key: r.summary for r in S.read_index(spark, root).collect()}
    assert {k: v for k, v in got.items() if k != "shared"} == {f"own{n}": f"w{n}" for n in range(8)}
    assert got["shared"] == "w" + found[-1].stream[1:]  # the newest commit has it


def test_a_taken_number_is_not_replaced(spark, workdir):
    path = workdir + "/x/00.json"
    S.make_folder(spark, workdir + "/x")
    assert S.create_new(spark, path, "one") and not S.create_new(spark, path, "two")
    assert open(path).read() == "one"


def test_lookup_opens_only_parts_that_may_hold_the_keys(spark, workdir):
    root = workdir + "/skip"
    for n in range(6):
        S.append_index(rows(spark, [f"k{n}-{i}" for i in range(20)] + ([None] if n == 2 else []), f"v{n}"), root)
    S.append_index(rows(spark, ["k1-3"], "new"), root)
    wanted = spark.createDataFrame([("k1-3",), ("k1-4",), ("nowhere",)], "key string")
    found = S.read_index(spark, root, wanted=wanted)
    assert sorted((r.key, r.summary) for r in found.collect()) == [("k1-3", "new"), ("k1-4", "v1")]
    assert len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) == 2  # of seven parts
    null = S.read_index(spark, root, wanted=spark.createDataFrame([(None,)], "key string"))
    assert [(r.key, r.summary) for r in null.collect()] == [(None, "v2")]
    none = S.read_index(spark, root, wanted=wanted.filter("key = 'nowhere'"))
    assert none.count() == 0 and none.columns == ["key", "chunk_no", "chunks", "summary"]


def test_compaction_keeps_what_is_committed_meanwhile(spark, workdir):
    root = workdir + "/compact"
    S.append_index(rows(spark, ["a", "b"], "1"), root)
    S.append_index(rows(spark, ["b"], "2"), root)
    whole = S.read_index(spark, root, hashes=True)
    S.append_index(rows(spark, ["a", "c"], "3"), root)  # while the compaction below is being written
    assert S.commit_part(whole, root, "parquet", ["key"], True, 2) == 4
    assert {r.key: r.summary for r in S.read_index(spark, root).collect()} == {"a": "3", "b": "2", "c": "3"}
    assert S.live_parts(spark, root) == [4, 3]
    assert S.compact_index(spark, root) == 5 and S.live_parts(spark, root) == [5]
    S.write_index(rows(spark, ["z"], "9"), root)
    assert [r.key for r in S.read_index(spark, root).collect()] == ["z"]


def test_parts_without_a_commit_are_not_read(spark, workdir):
    root = workdir + "/half"
    S.append_index(rows(spark, ["a"], "1"), root)
    rows(spark, ["b"], "lost").withColumn("text_hash", F.lit(None).cast("string")).write.parquet(root + "/part=unfinished")
    assert [r.key for r in S.read_index(spark, root).collect()] == ["a"]
