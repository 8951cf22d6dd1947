"""Annotation by blocks of chunks against the plain rule, and what it leaves on disk."""
import math
import re
import time
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tessera.operators import annotate as AN
from tessera.session import materialize

ROWS = [("a", 1, "Red fox. Blue sea waits! Red stone."), ("a", 2, "  ... 12 34. Fox fox fox? Ça où. "), ("b", 1, "Wind. wind; wind"),
        ("c", 1, None), ("d", 1, ""), ("e", 1, " \n "), ("f", 1, "Sea.Sea"), (None, 1, "Red sea."), ("g", None, "Fox."),
        ("h", 1, "Same text here. Same fox."), ("h", 1, "Same text here. Same fox."), ("i", 1, "123. 45!")] + \
       [(f"k{i}", i % 3, f"Red w{chr(97 + i % 7)} runs. Blue {chr(97 + i % 5)}{chr(97 + i % 3)} stone waits.") for i in range(40)]


def rounded(x):
    return float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP))


def terms(text):
    return re.findall(r"[^\W\d_]+", text.lower())


def plain(rows, n_keywords, n_sentences, df=None, n=None):
    n = len(rows) if n is None else n
    df = Counter(t for _, _, x in rows for t in set(terms(x or ""))) if df is None else df
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    out = []
    for key, no, text in rows:
        merged = [x for k, m, x in rows if (k, m) == (key, no) and None not in (key, no) and x is not None]
        tf = Counter(t for x in merged for t in terms(x))
        w = {t: rounded(c * idf[t]) if t in idf else None for t, c in tf.items()}
        words = sorted(w, key=lambda t: (w[t] is not None, -(w[t] or 0), t))[:n_keywords]
        runs = re.findall(r"[^.!?]+[.!?]*", text or "")
        uses = {}
        for x in merged:
            for i, s in enumerate(re.findall(r"[^.!?]+[.!?]*", x), 1):
                if s.strip():
                    uses.setdefault(i, []).extend(w[t] for t in terms(s))
        mean = {}
        for i, ws in uses.items():
            ws = sorted(v for v in ws if v is not None)
            mean[i] = rounded(sum(ws) / len(ws)) if ws else 0.0
        best = sorted(sorted(mean, key=lambda i: (-mean[i], i))[:n_sentences])
        summary = " ".join(runs[i - 1].strip() for i in best) if uses else None
        title = None if text is None else runs[0].strip() if runs else ""
        out.append((key, no, title, tuple(words), summary))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.key, r.chunk_no, r.title, tuple(r.keywords), r.summary) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", (60, 4_000_000))
def test_blocks_equal_the_plain_rule(spark, monkeypatch, size):
    monkeypatch.setattr(AN, "TASK_CHARS", size)
    chunks = spark.createDataFrame(ROWS, "key string, chunk_no int, chunk string")
    for n_keywords, n_sentences in ((8, 2), (2, 1)):
        assert found(AN.annotate_chunks(chunks, n_keywords, n_sentences)) == plain(ROWS, n_keywords, n_sentences)
    # stored statistics that lack a term, and those of a larger corpus
    stats = {"": 90, "red": 3, "fox": 7, "sea": 2, "wind": 1}
    given = spark.createDataFrame(list(stats.items()), "term string, df long")
    df = {t: d for t, d in stats.items() if t}
    assert found(AN.annotate_chunks(chunks, 3, 2, statistics=given)) == plain(ROWS, 3, 2, df, 90)
    few = [r for r in ROWS if r[0] in ("a", "b", "h")]
    df = Counter(t for _, _, x in ROWS for t in set(terms(x or "")))
    assert found(AN.annotate_chunks(chunks.filter("key IN ('a', 'b', 'h')"), 3, 2, corpus=chunks)) == plain(few, 3, 2, df, len(ROWS))


def test_occurrences_are_not_shuffled_by_term(spark, monkeypatch):
    """With a vocabulary too large to broadcast, too: every plan has a row per block and term."""
    chunks = materialize(spark.range(300).selectExpr("CAST(id AS STRING) AS key", "1 AS chunk_no", "repeat('the cat ran. ', 40) AS chunk"))
    rows, write = [], AN.materialize
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(AN, "materialize", lambda df: (lambda t: rows.append(t.count()) or t)(write(df)))
    try:
        df = AN.annotate_chunks(chunks)
        assert "hashpartitioning(term" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows[1] == 300 and rows[0] <= 3 * spark.sparkContext.defaultParallelism


def test_rounding_is_half_up_on_the_shortest_decimal(spark):
    xs = [0.0, 1.0, 2.5e-9, 0.0000000005, 1.0000000005, 3.1234567895, 3.1234567885, 7.0000000025, 123456.7890123455, 29999.1234567895, 0.1 + 0.2]
    want = [r.r for r in spark.createDataFrame([(x,) for x in xs], "x double").select(F.round("x", 9).alias("r")).collect()]
    assert AN.half_up(AN.np.array(xs)).tolist() == want


def test_shuffle_files_of_a_written_table_are_removed(spark):
    def files():
        kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {kept.apply(i).getName() for i in range(kept.size()) if kept.apply(i).getName().startswith("shuffle_")}
    before = files()
    out = materialize(spark.range(1000).repartition(7, "id").groupBy("id").count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
