"""Objects written by tasks, and the licence tokens counted over whole tables."""
import os

from tessera.llm import licenses
from tessera.operators.long_chunking import chunk_blocks, line_blocks
from tessera.operators.indexing import chunk_documents
from tessera.sources.objects import read_object_lines, read_objects, write_objects


def test_written_objects_come_back(spark, workdir):
    rows = [(1, "en", "one\ntwo"), (2, "en", ""), (3, None, None), (4, "a/b=c%", "ünï"), (5, "", "x"), (1, "de", "other"), (-7, "en", "minus"),
            (1, "en", "one\ntwo")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    write_objects(df, workdir, ["lang", "doc_id"])
    got = {r.key: bytes(r.content).decode() for r in read_objects(spark, workdir).collect()}
    none = "lang=__HIVE_DEFAULT_PARTITION__"
    assert got == {"lang=en/doc_id=1.txt": "one\ntwo\none\ntwo\n", "lang=en/doc_id=2.txt": "\n", f"{none}/doc_id=3.txt": "\n",
                   "lang=a%2Fb%3Dc%25/doc_id=4.txt": "ünï\n", f"{none}/doc_id=5.txt": "x\n", "lang=de/doc_id=1.txt": "other\n",
                   "lang=en/doc_id=-7.txt": "minus\n"}
    assert not [f for _, d, names in os.walk(workdir) for f in names + d if f.startswith("_") or f.startswith("doc_id=") and not f.endswith(".txt")]
    write_objects(df.limit(0), workdir, ["lang", "doc_id"])
    write_objects(df.filter("doc_id = 2").withColumn("lang", df.lang), f"file://{workdir}/more", ["doc_id"])
    assert [r.key for r in read_objects(spark, f"{workdir}/more").collect()] == ["doc_id=2.txt"]


def test_blocks_of_many_objects_share_frames(spark, workdir):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 90))) for i in range(1, 60)], "doc_id long, text string")
    write_objects(docs, workdir, ["doc_id"])
    for size in (40, 1 << 19):
        got = chunk_blocks(line_blocks(read_object_lines(spark, workdir), size), 20)
        want = chunk_documents(docs.selectExpr("concat('doc_id=', doc_id, '.txt') AS key", "text"), 20)
        assert sorted(got.collect()) == sorted(want.collect())


def test_distinctive_tokens_are_counted_over_all_paragraphs(spark):
    """'version' is in every third of 9,000 paragraphs, outside the first words."""
    text = "concat('filler ', repeat('word ', 100), IF(id % 3 = 0, 'version', 'public'), ' ', id)"
    docs = spark.range(9000).selectExpr("id AS doc_id", f"IF(id < 60, concat('foundation ', id), {text}) AS text")
    paras = licenses.paragraphs(docs)
    known = licenses.distinctive_tokens(licenses.training_rows(paras), paras)
    assert "version" not in known and "public" not in known and "foundation" in known and "apache" in known


def test_folder_prefix_is_listed_as_a_folder(spark, workdir):
    for name in ("pre/_d/x.txt", "pre/sub/y.txt", "pre/z.txt", "prefix.txt", "other/z.txt"):
        os.makedirs(os.path.join(workdir, os.path.dirname(name)), exist_ok=True)
        with open(os.path.join(workdir, name), "w") as f:
            f.write("a")
    from tessera.sources import objects
    asked = []

    class Reader:
        def load(self, paths):
            asked.append(paths)
            return paths
    objects._found_below(Reader(), "/r", "pre/")
    assert asked == [["/r/pre/", "/r/pre/[_.]*"]]
    for prefix, want in (("pre/", ["pre/_d/x.txt", "pre/sub/y.txt", "pre/z.txt"]), ("other/", ["other/z.txt"]), ("none/", []),
                         ("pre", ["pre/sub/y.txt", "pre/z.txt", "prefix.txt"])):
        for read in (read_objects, read_object_lines):
            assert sorted(r.key for r in read(spark, workdir, prefix).collect()) == want
