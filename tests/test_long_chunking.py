import random

import numpy as np
import pytest

from tessera.functions.chunking import chunk_text, length_cost
from tessera.operators import indexing as D
from tessera.operators import long_chunking as LC
from tessera.sources.objects import read_object_lines, read_objects


def texts(seed, n):
    rnd = random.Random(seed)
    word = lambda: "x" * rnd.choice([1, 2, 3, 5, 9, 30, 90])
    return [" ".join(word() for _ in range(rnd.choice([0, 1, 2, 40, 300]))) for _ in range(n)] + ["   ", None, "y" * 400 + " a", "a\n\n b\tc"]


def test_block_maps_compose_to_the_sequential_packer():
    rnd = random.Random(2)
    for _ in range(300):
        costs = np.array([rnd.choice([0, 1, 1, 2, 3, 7, 12]) for _ in range(rnd.randrange(1, 40))])
        limit = rnd.randrange(1, 11)
        words = [str(i) for i in range(len(costs))]
        state, no = 0, 1
        chunks = {}
        at = 0
        while at < len(words):
            size = rnd.randrange(1, 9)
            w, c = words[at:at + size], costs[at:at + size]
            for i, piece in enumerate(LC.cut_block(w, c, state, limit)):
                chunks.setdefault(no + i, []).extend(piece)
            after, closed = LC.block_map(c, limit)
            state, no, at = int(after[state]), no + int(closed[state]), at + size
        want = chunk_text(" ".join(words), limit, lambda ws: costs)
        assert [" ".join(chunks[k]) for k in sorted(chunks)] == want


@pytest.mark.parametrize("max_tokens,block_words,fan", [(4, 3, 2), (15, 7, 3), (60, 50, 64), (8000, 10, 4)])
def test_long_chunking_equals_chunk_documents(spark, max_tokens, block_words, fan):
    docs = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts(max_tokens, 25))], "key string, text string")
    for keep in (True, False):
        want = sorted(map(tuple, D.chunk_documents(docs, max_tokens, keep_empty_first=keep).collect()))
        blocks = LC.document_blocks(docs, block_words=block_words)
        assert sorted(map(tuple, LC.chunk_blocks(blocks, max_tokens, keep_empty_first=keep, fan=fan).collect())) == want
    counted = lambda ws: [len(w) % 4 for w in ws]  # noqa: E731  (words without cost)
    want = sorted(map(tuple, D.chunk_documents(docs, max_tokens, counted).collect()))
    assert sorted(map(tuple, LC.chunk_blocks(LC.document_blocks(docs, block_words=block_words), max_tokens, counted,
                                             fan=fan).collect())) == want


def test_one_long_document_is_spread(spark):
    text = " ".join("w" * (1 + i % 11) for i in range(60_000))
    docs = spark.createDataFrame([("long", text)], "key string, text string")
    blocks = LC.document_blocks(docs, block_words=500)
    assert blocks.count() == 120 and blocks.selectExpr("max(length(text))").first()[0] < 500 * 12
    got = sorted((r.chunk_no, r.chunk) for r in LC.chunk_blocks(blocks, 333, fan=5).collect())
    assert [c for _, c in got] == chunk_text(text, 333) and [n for n, _ in got] == list(range(1, len(got) + 1))
    assert LC.chunk_blocks(blocks.filter("false")).count() == 0


def test_objects_are_read_in_ranges(spark, workdir):
    rnd = random.Random(1)
    lines = {"a b+%41/x.txt": ["line %d %s" % (i, "z" * rnd.randrange(60)) for i in range(3000)], "c/y.txt": ["one", "", "three"], "c[1]/z.txt": ["q"]}
    import os
    for k, v in lines.items():
        os.makedirs(os.path.dirname(f"{workdir}/o/{k}"), exist_ok=True)
        with open(f"{workdir}/o/{k}", "w") as f:
            f.write("\n".join(v) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = read_object_lines(spark, f"{workdir}/o")
        rows = sorted((r.key, r["range"], r.line_no, r.line) for r in got.collect())
        for k, v in lines.items():
            assert [r[3] for r in rows if r[0] == k] == v
        assert len({r[1] for r in rows if r[0] == "a b+%41/x.txt"}) > 5  # several tasks read it
        chunks = LC.chunk_blocks(LC.line_blocks(got, 700), 50, fan=4)
        for k, v in lines.items():
            mine = sorted((r.chunk_no, r.chunk) for r in chunks.filter(chunks.key == k).collect())
            assert [c for _, c in mine] == chunk_text("\n".join(v), 50, length_cost)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for f in (read_objects, read_object_lines):
        assert f(spark, f"{workdir}/o", prefix="none/").count() == 0 == f(spark, f"{workdir}/nowhere").count()
        assert {r.key for r in f(spark, f"{workdir}/o", prefix="c").select("key").collect()} == {"c/y.txt", "c[1]/z.txt"}
        assert {r.key for r in f(spark, f"{workdir}/o", prefix="c[1]/z").select("key").collect()} == {"c[1]/z.txt"}
