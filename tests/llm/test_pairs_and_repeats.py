"""Operators 3, 7 and 9 against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import fingerprints, ngram_join, suffix_dedup
from tests.llm.cases import edge_docs, edge_rows, empty_docs, sentence

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(t):
    w = WORDS.findall(lower_ascii(t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def brute_components(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is None or j is None or not a or not b:
            continue
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def near_rows():
    """Families of near copies around the threshold."""
    import random
    rng = random.Random(7)
    rows = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(80)), None, "s", None, 0, "", "") for k in range(12)]
    for k in range(100, 220):
        w = rows[rng.randrange(12)][1].split()
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(3000)}"
        rows.append((k, " ".join(w), None, "s", None, 0, "", ""))
    return rows


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_components(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    for rows in (edge_rows(), near_rows()):
        docs = edge_docs(spark).limit(0).unionByName(spark.createDataFrame(rows, edge_docs(spark).schema))
        got = ngram_join.jaccard_components(docs)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


@pytest.mark.parametrize("bits", [1, 4])
def test_jaccard_components_with_clashing_ids(spark, bits):
    """Many sets share an id of a few bits; they go by the other half."""
    for rows in (edge_rows(), near_rows()):
        docs = spark.createDataFrame(rows, edge_docs(spark).schema).repartition(3)
        got = ngram_join.jaccard_components(docs, bits=bits)
        assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


def test_class_heads_keep_apart_texts_under_one_id(spark):
    a, b, c = (sentence(random.Random(k), 60) for k in range(3))
    near = b + " more"
    rows = [(1, a), (1, b), (2, near), (2, c), (3, c), (3, c), (1, a), (4, None), (4, ""), (4, ""), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = {r.h: r.text for r in docs.selectExpr("xxhash64(text) AS h", "text").collect()}
    got = [(r.doc_id, texts[r.text_hash], r.copies) for r in ngram_join.class_heads(docs).collect()]
    want = [(1, a, 2), (1, b, 1), (2, c, 1), (4, None, 1), (4, "", 1), (4, "", 1), (None, a, 1), (None, a, 1)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ngram_join.class_heads(empty_docs(spark)).count() == 0


def test_jaccard_empty_table(spark):
    assert ngram_join.jaccard_components(empty_docs(spark)).count() == 0


def test_node_bound_never_drops_a_link():
    """The bound must admit every pair that links, at any node level."""
    import numpy as np
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        keep = rng.random(len(a)) < 0.93
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 1 << 63, int(len(a) * 0.05)).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        other = [np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 200))).astype(np.uint64)) for _ in range(20)]
        sets = [a, b] + other
        sizes, maps = [len(s) for s in sets], [ngram_join.bitmap(s) for s in sets]
        left = ngram_join.build_tree(sizes, list(range(22)), maps, [0] + list(range(2, 12)))
        right = ngram_join.build_tree(sizes, list(range(22)), maps, [1] + list(range(12, 22)))
        assert (0, 1) in set(ngram_join.traverse(left, right))


def brute_repeats(rows):
    seen = {}
    ids = [(1 << 63) - 1 if r[0] is None else r[0] for r in rows]
    texts = [WORDS.findall(r[1] or "") for r in rows]
    for i, w in zip(ids, texts):
        for p in range(len(w) - 49):
            k = tuple(w[p:p + 50])
            seen[k] = min(i, seen.get(k, i))
    out = []
    for r, i, w in zip(rows, ids, texts):
        gone = set()
        for p in range(len(w) - 49):
            if seen[tuple(w[p:p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [512, 1])
def test_substring_dedup(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    got = suffix_dedup.remove_repeats(edge_docs(spark)).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(edge_rows())
    assert sum(r.n_removed > 0 for r in got) > 5


def test_substring_dedup_empty_table(spark):
    assert suffix_dedup.remove_repeats(empty_docs(spark)).count() == 0


def brute_pieces(text):
    """Pieces of a text as strings, cut by the rule of the docstring."""
    out = set()
    for words, grid in [(24, 384)] + [(6, 30)] * (len(text) < 1500) + [(1, 1)] * (len(text) < 400):
        piece = ""
        for i, x in enumerate(re.findall(r"\S{1,40}\s*|\s+", text, re.ASCII), 1):
            piece += x
            h = xxhash.xxh64(x.encode(), seed=42).intdigest()
            h -= (h >> 63) << 64
            if "\n" in x or h % words == 0 or i % grid == 0:
                out.add(piece)
                piece = ""
        if piece:
            out.add(piece)
    return out


def test_fingerprints(spark):
    rows = edge_rows()
    got = fingerprints.fingerprint_versions(edge_docs(spark)).collect()
    assert len(got) == len(rows)
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    by_id = {}
    for g in got:
        by_id.setdefault(g.doc_id, []).append(g)
    def jaccard(x, y):
        a, b = brute_pieces(x), brute_pieces(y)
        return 1.0 if not a | b else round(len(a & b) / len(a | b), 6)
    for r, follower in zip(named, named[1:]):
        if len(by_id[r[0]]) > 1 or len(by_id[follower[0]]) > 1:
            continue
        t, nxt = r[1] or "", follower[1] or ""
        k = len(t) // 3
        edited = t[:len(t) - k] + nxt[:k]
        g = by_id[r[0]][0]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (g.near_edited, g.near_next) == (jaccard(t, edited), jaccard(t, nxt))
    same = {}
    for g, t in ((g, t) for r in rows for g in by_id[r[0]] for t in [r[1] or ""] if len(by_id[r[0]]) == 1):
        assert same.setdefault(t, g.fingerprint) == g.fingerprint


def test_fingerprints_empty_table_and_single_document(spark):
    assert fingerprints.fingerprint_versions(empty_docs(spark)).count() == 0
    one = fingerprints.fingerprint_versions(edge_docs(spark).filter("doc_id = 28")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_of_short_lines_and_insertions(spark):
    """Short one-line texts are nearer to their edited version than to a
    stranger, and a word at the start of a long line changes few pieces."""
    rng = random.Random(5)
    short = [sentence(rng, 9 + i % 20) for i in range(60)] + ["spam " * 80, "a" * 300]
    got = fingerprints.fingerprint_versions(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")).collect()
    assert all(r.near_edited > r.near_next for r in got)
    line = sentence(rng, 2000)
    pair = spark.createDataFrame([(1, line), (2, "inserted " + line)], "doc_id long, text string")
    assert all(r.near_next > 0.75 for r in fingerprints.fingerprint_versions(pair).collect())


def test_prefix_tokens_are_shuffled_once_and_without_copies(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i % 3) * 7 + j}" for j in range(12))) for i in range(30)], "doc_id long, text string").coalesce(1)
    plans, write = [], ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    posts = ngram_join.postings(docs, (np.empty(0, np.uint64), np.empty(0, np.int64)), frozenset(), 64)
    assert posts.count() == posts.distinct().count() > 0  # ten copies of each text in one task
    twice = posts.unionByName(posts)
    assert sorted(ngram_join.trees(twice).collect()) == sorted(ngram_join.trees(posts).collect())
    assert all(p.count("Exchange hashpartitioning(token") == p.count("Exchange") == 1 for p in plans)


def test_first_retry_writes_and_shuffles_no_digests(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 100 + j}" for j in range(80))) for i in range(20)], "doc_id long, text string")
    plans, written, write = [], [], fingerprints.materialize

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        written.append(write(df))
        return written[-1]
    monkeypatch.setattr(fingerprints, "materialize", spy)
    out = fingerprints.fingerprint_versions(docs).collect()
    assert len(out) == 20 and all(r.near_next == 0 and 0 < r.near_edited < 1 for r in out)
    assert not any("hashpartitioning(row" in p for p in plans)
    first = next(t for t in written if "fingerprint" in t.columns)
    digests = "aggregate(left, 0, (s, x) -> s + size(x.a) + size(x.b))"
    assert first.selectExpr(f"sum({digests}) AS n").first().n < 20 * 2 * 160 / 4


def test_difference_equals_subtracted_sketches(spark):
    rows = spark.createDataFrame([([1, 2, 3], [3, 4]), ([], [7]), ([5], []), ([], [])], "a array<bigint>, b array<bigint>")
    for r in rows.selectExpr(fingerprints.difference("a", "b", "1") + " AS x",
                             fingerprints.subtract(fingerprints.sketch("a", "1"), fingerprints.sketch("b", "1")) + " AS y").collect():
        assert r.x == r.y
