"""Objects listed by tasks: nothing on the driver names them one by one."""
import glob
import io
import os
import random

from tessera.sources import objects as O
from tessera.streaming import corpus_index as CI


def put(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_ranges_have_every_line_once():
    rnd = random.Random(2)
    for _ in range(400):
        data = bytes(rnd.choice(b"ab\r\n\r\n") for _ in range(rnd.randrange(40)))
        step = rnd.randrange(1, 12)
        got = [x for s in range(0, len(data), step) for x in O.range_lines(io.BytesIO(data), s, s + step, len(data))]
        assert got == data.splitlines(), (data, step)
    assert O.range_lines(io.BytesIO(b"\xef\xbb\xbfa\nb"), 0, 9, 6) == [b"a", b"b"]


def test_lines_equal_those_of_sparks_reader(spark, workdir):
    src = f"{workdir}/o"
    for name, data in {"a=1/x.txt": b"one\r\ntwo\rthree\n\nfour", "a=1/b/_y=2.txt": b"\xef\xbb\xbfmark\n", "a=1/_no.txt": b"hidden",
                       ".d/z.txt": b"hidden", "_d/z.txt": b"hidden", "e.txt": b"", "c[1] +%41/\xc3\xbc.txt".encode("latin1").decode(): b"\xff\xfe\n"}.items():
        put(src, name, data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("7", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = O.read_object_lines(spark, src)
            assert not [f for f in got.inputFiles() if "/o/" in f]  # the driver has no list of them
            plain = O.read_object_lines(spark, src, glob="*")
            of = lambda df: sorted((r.key, bytes(r.b)) for r in df.selectExpr("key", "CAST(line AS BINARY) AS b").collect())
            assert of(got) == of(plain) and len(of(got)) == 7
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    put(src, "p.txt.gz", __import__("gzip").compress(b"packed\n"))
    assert "packed" in {r.line for r in O.read_object_lines(spark, src).collect()}


def test_the_stream_keeps_no_path_of_an_object(spark, workdir):
    src, root = f"{workdir}/src", f"{workdir}/index"
    for i in range(30):
        put(src, f"f{i % 3}/doc{i}.txt", b"Red fox %d." % i)
    put(src, "_hidden/doc.txt", b"Not seen.")
    CI.index_new_objects(spark, src, root)
    put(src, "f9/late.txt", b"Late fox.")
    CI.index_new_objects(spark, "file://" + src, root)
    CI.index_new_objects(spark, src, root)
    assert CI.stored_statuses(spark, root).count() == 31
    assert sorted(c.batch for c in CI.commits(spark, f"{root}/chunks")) == [0, 1]
    for f in glob.glob(f"{root}/checkpoints/ingest/**/*", recursive=True):
        if os.path.isfile(f):
            assert b"/src/" not in open(f, "rb").read()
    assert {r.key for r in CI.stored_chunks(spark, root).collect()} >= {"f0/doc0.txt", "f9/late.txt"}
