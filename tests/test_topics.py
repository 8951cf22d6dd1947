import random
from functools import reduce
from operator import add

from pyspark.sql import functions as F

from tessera.operators import retrieval as T
from tessera.operators import topics as TP

PLANTED = (["wheat", "barley", "harvest", "plough", "field", "seed", "tractor", "soil"],
           ["violin", "cello", "melody", "concert", "tempo", "chord", "opera", "rhythm"])


def table(spark, seed=3, n=80, parts=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        own = PLANTED[i % 2]
        rows.append((f"f{i:03d}", 1, " ".join(rnd.choice(own) if rnd.random() < .9 else "the" for _ in range(rnd.randint(15, 40)))))
    rows.append(("none", 1, "123"))
    return T.term_table(spark.createDataFrame(rows, "file string, chunk int, text string").repartition(parts))


def test_two_planted_topics_are_found(spark):
    chunks, terms = TP.topic_model(table(spark), k=2, steps=15)
    found = {r.file: (r.topic, r.weights) for r in chunks.collect()}
    assert len(found) == 80 and "none" not in found
    assert all(abs(sum(w) - 1) < 1e-9 and w[t] == max(w) for t, w in found.values())
    kinds = [{found[f"f{i:03d}"][0] for i in range(p, 80, 2)} for p in (0, 1)]
    assert all(len(k) == 1 for k in kinds) and kinds[0] != kinds[1]
    words = {r.topic: set(r.words) for r in TP.topic_words(terms, 8).collect()}
    assert len(words[kinds[0].pop()] & set(PLANTED[0])) >= 7 and len(words[kinds[1].pop()] & set(PLANTED[1])) >= 7
    probability = [sum(r.weights[t] for r in terms.collect()) for t in (0, 1)]
    assert all(abs(p - 1) < 1e-9 for p in probability)


def test_topics_do_not_depend_on_partitioning_or_run(spark):
    runs = [sorted(map(tuple, TP.topic_model(table(spark, parts=p), k=3, steps=4)[0].collect())) for p in (1, 7, 7)]
    assert runs[0] == runs[1] == runs[2]
    other = sorted(map(tuple, TP.topic_model(table(spark), k=3, steps=4, seed=8)[0].collect()))
    assert other != runs[0]


def test_counts_are_kept_and_empty_tables_give_no_rows(spark):
    t = table(spark)
    _, terms = TP.topic_model(t, k=4, steps=3)
    want = {r.term: r.n for r in t.groupBy("term").agg({"tf": "sum"}).withColumnRenamed("sum(tf)", "n").collect()}
    got = {r.term: sum(r.counts) for r in terms.collect()}
    assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-2 for w in want)
    chunks, terms = TP.topic_model(t.filter("false"), k=2, steps=2)
    assert chunks.count() == 0 == terms.count()


def plain_steps(rows, starts, k, steps):
    """Shares per chunk by the plain rule, one posting at a time."""
    phi, theta = starts, None
    for _ in range(steps):
        of_chunk, of_term = {}, {}
        for file, chunk, term, tf in rows:
            if theta is not None and None in (file, chunk):
                continue
            raw = [phi[term][i] * (theta[file, chunk][i] if theta else 1.0) for i in range(k)]
            whole = reduce(add, raw)
            for i in range(k):
                share = int(tf * raw[i] / whole * 1_000_000 + 0.5)
                of_chunk.setdefault((file, chunk), [0] * k)[i] += share
                of_term.setdefault(term, [0] * k)[i] += share
        theta = {c: [x / 1_000_000 + TP.ALPHA for x in v] for c, v in of_chunk.items()}
        total = [sum(v[i] for v in of_term.values()) / 1_000_000 + len(of_term) * TP.BETA for i in range(k)]
        phi = {t: [(v[i] / 1_000_000 + TP.BETA) / total[i] for i in range(k)] for t, v in of_term.items()}
    return {c: [x / reduce(add, v) for x in v] for c, v in theta.items()}


def test_steps_shuffle_no_postings_and_equal_the_plain_rule(spark, monkeypatch):
    rows = [("a", 1, "x y z x"), ("a", 2, "y y w"), ("b", 1, "z w v u"), ("c", 1, "x u"), (None, 1, "x only"), ("d", None, "y"), ("a", 1, "v v"), ("e", 1, None)]
    t = T.term_table(spark.createDataFrame(rows, "file string, chunk int, text string"))
    post = [(r.file, r.chunk, r.term, r.tf) for r in t.collect()]
    starts = {r.term: [0.5 + r[f"p{i}"] / (1 << 30) for i in range(3)] for r in t.select("term").distinct().select(
        "term", *[F.pmod(F.xxhash64("term", F.lit(7), F.lit(i)), F.lit(1 << 30)).alias(f"p{i}") for i in range(3)]).collect()}
    plans, write = [], TP.materialize
    monkeypatch.setattr(TP, "BLOCK_ROWS", 4, raising=False)
    monkeypatch.setattr(TP, "SLICE", 2, raising=False)
    monkeypatch.setattr(TP, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    for steps in (1, 3):
        plans.clear()
        got = {(r.file, r.chunk): list(r.weights) for r in TP.topic_model(t, k=3, steps=steps)[0].collect()}
        want = plain_steps(post, starts, 3, steps)
        assert got == want and ((None, 1) in got) == (steps == 1)
    # only the two tables made once shuffle rows by term or by chunk name
    assert sum("Exchange hashpartitioning(term" in p or "Exchange hashpartitioning(file" in p for p in plans) <= 2


def test_postings_are_gathered_before_they_are_shuffled_and_old_steps_removed(spark, monkeypatch):
    import os
    t = table(spark)
    written, write = [], TP.materialize
    plans = []

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        written.append(write(df))
        return written[-1]
    monkeypatch.setattr(TP, "materialize", spy)
    chunks, terms = TP.topic_model(t, k=2, steps=5)
    packed = plans[0]
    assert packed.index("Exchange hashpartitioning(block") < packed.rindex("partial_collect_list")
    assert not any("term" in p and "SortMergeJoin" in p and "tf#" in p for p in plans)
    there = [os.path.isdir(w._written.removeprefix("file:")) for w in written]
    assert there == [True, True] + [False] * 4 + [True]  # packed chunks, names, the last of five steps
    assert chunks.count() == 80 and terms.count() > 10
