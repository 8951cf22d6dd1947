"""Edge rows shared by the tests of all document operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, `key` string, `row` string"


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta omega kappa sigma theta lambda zeta".split()) + str(rng.randrange(400))
                    for _ in range(n))


def edge_texts(seed=1):
    """NULL, empty, blank, short, long, tied, repeated, near-copied and junk
    texts."""
    rng = random.Random(seed)
    base = [sentence(rng, 120) for _ in range(6)]
    near = [b.replace(b.split()[60], "changed", 1) for b in base[:4]]
    passage = sentence(rng, 70)
    shared = [sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 30) for _ in range(4)]
    long = "\n".join(sentence(rng, 40) for _ in range(150))
    return ([None, "", " \t\n\x0b\x0c\r", "one", "one two three four", "One two three four", "x " * 200] + base + base[:2]
            + near + shared + [long, "A!! " * 90, "naïve  café \U0001f600 " * 30, "a\n\na\na b\n" * 20])


def edge_rows(seed=1):
    rows = [(i * 3 + 1, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, i, None, "r")
            for i, t in enumerate(edge_texts(seed))]
    return rows + [rows[8], (None, rows[8][1], "en", "s1", 5, None, "k", None), (None, None, None, None, None, None, None, None)]


def edge_docs(spark, seed=1):
    return spark.createDataFrame(edge_rows(seed), SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
