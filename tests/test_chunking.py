import random

from tessera.functions.chunking import chunk_text
from tessera.operators import indexing as D


def cost(w):
    return -(-(len(w) + 1) // 4)


def test_edge_words():
    assert chunk_text("abcdefghijklmnop b", 2) == ["", "abcdefghijklmnop", "b"]   # first word over budget
    assert chunk_text("a abcdefghijklmnop b", 2) == ["a", "abcdefghijklmnop", "b"]  # middle word alone
    assert chunk_text("ab cd", 2) == ["ab cd"]                                      # exact fit
    assert chunk_text("word", 8000) == ["word"]
    assert chunk_text("  \n ", 10) == []
    assert chunk_text("abcdefghijklmnop b", 2, keep_empty_first=False) == ["abcdefghijklmnop", "b"]


def test_packing_properties():
    """Words and their order are kept, no chunk of several words is over
    budget, and no chunk could have taken the next one's first word."""
    rnd = random.Random(7)
    for _ in range(300):
        words = ["x" * rnd.randint(1, 30) for _ in range(rnd.randint(0, 60))]
        seps = [rnd.choice([" ", "  ", "\n", "\t "]) for _ in words]
        text = rnd.choice(["", " ", "\n"]) + "".join(w + s for w, s in zip(words, seps))
        budget = rnd.randint(1, 40)
        got = [c.split() for c in chunk_text(text, budget)]
        assert [w for c in got for w in c] == words
        assert all(sum(map(cost, c)) <= budget for c in got if len(c) > 1)
        assert all(sum(map(cost, a)) + cost(b[0]) > budget for a, b in zip(got, got[1:]))
        assert all(got[1:]) and (not got or got[0] or cost(words[0]) > budget)


def test_chunk_documents_frame(spark):
    docs = spark.createDataFrame([("k1", "a b c d e f"), ("k2", "zzzzzzzzzzzzz y"), ("k3", "   ")],
                                 "key string, text string")
    rows = sorted((r.key, r.chunk_no, r.chunk) for r in D.chunk_documents(docs, max_tokens=2).collect())
    assert rows == [("k1", 1, "a b"), ("k1", 2, "c d"), ("k1", 3, "e f"),
                    ("k2", 1, ""), ("k2", 2, "zzzzzzzzzzzzz"), ("k2", 3, "y")]
    counts = {r.key: r.chunks for r in D.chunk_counts(D.chunk_documents(docs, max_tokens=2)).collect()}
    assert counts == {"k1": 3, "k2": 3}


def test_custom_counter(spark):
    docs = spark.createDataFrame([("k", "a b c d")], "key string, text string")
    rows = D.chunk_documents(docs, max_tokens=2, counter=lambda ws: [1] * len(ws)).collect()
    assert [r.chunk for r in sorted(rows, key=lambda r: r.chunk_no)] == ["a b", "c d"]
