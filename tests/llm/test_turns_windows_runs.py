"""Conversation repair, window packing and periodic runs against brute force."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_repair as CR
from tessera.llm import periodic_runs as PR
from tessera.llm import window_packing as WP
from tests.llm.cases import SCHEMA, edge_docs, edge_rows, empty_docs, sentence

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ operator 11

@functools.cache
def cheapest(sig, out="", inserted=0):
    """All edit strings of a signature, by recursion: (cost, audit)."""
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[out]
    options = [(0, "")] if not sig and out in ("", "a") else []
    if inserted < 3:
        for role in set("ua") & set(allowed):
            cost, audit = cheapest(sig, role, inserted + 1)
            options.append((cost + 5, "I" + audit))
    if sig:
        symbol, rest = sig[0], sig[1:]
        charge = 5 if symbol.isupper() else 0
        cost, audit = cheapest(rest, out)
        options.append((cost + 2, "D" + audit))
        if symbol != "x":
            if symbol.lower() in allowed:
                cost, audit = cheapest(rest, symbol.lower())
                options.append((cost + charge, "K" + audit))
            for role in set("ua") & set(allowed):
                cost, audit = cheapest(rest, role)
                options.append((cost + charge + 1, "R" + audit))
    return min(options) if options else (10 ** 9, "")


def test_automaton_gives_the_cheapest_smallest_audit():
    rng = random.Random(3)
    sigs = {"".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(0, 11))) for _ in range(3000)}
    endings = CR.Endings()
    for sig in sorted(sigs, key=lambda s: s[::-1]):
        endings.visit(sig[::-1])
        assert endings.result() == cheapest(sig), sig
    assert len(endings.automaton.tables) < 50  # endings share tables


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        sp = lambda x: " " if x is None else str(x)
        c = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if c == 0:
            continue
        text = "" if c == 1 else "".join(x for x in text if x not in ".!?") if c == 2 else text
        out += [(conv, turn, "user" if c == 4 else role, text)] * (2 if c == 3 else 1)
    return out


def brute_repair(rows, ids):
    groups = {i: [] for i in ids}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        seen, sig, count = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in turns:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
            symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
            sig += "x" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol
            if fault:
                count[fault] += 1
        initials = [r[2][:1] for r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        known = [r[1] for r in turns if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit = cheapest(sig)
        lines, left, last = [], list(turns), ""
        for e in audit:
            if e != "I":
                _, _, role, text = left.pop(0)
            if e == "D":
                continue
            made = "assistant" if last == "u" else "user"
            role, text = (made, "") if e == "I" else (made, text) if e == "R" else (role, text)
            last = role[0]
            lines.append(f"{role}:{text}")
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conv_rows(seed=4):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Hello there.", "Why?", "no end", " ", "", "\n\t", "ok! ", "Same.", None, "x" * 3000 + ".", "é…"])
    role = lambda: rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
    rows = []
    for conv in range(60):
        turns = [t + (3 if t > 4 else 0) for t in range(rng.randrange(1, 9))]
        rows += [(conv, t, role(), text()) for t in turns]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hi."), (77, None, "user", "A."), (77, None, "user", "A."),
             (77, None, None, None), (-5, 10 ** 17, "user", "Far."), (-5, 10 ** 17 + 1, "assistant", "Away.")]
    rows += [(900, t, ["user", "assistant"][t % 2], rng.choice(["A.", "B?", f"Turn {t}.", f"cut {t}"])) for t in range(700)]  # most rows
    return rows


CONV = "conv_id long, turn long, role string, text string, conv int, sig string, part int, tag int"


def conv_table(spark, rows, n=5):
    return spark.createDataFrame([(*r, 1, "u", 2, 3) for r in rows], CONV).repartition(n)


def collected(df):
    return {r["conv_id"]: tuple(r[c] for c in (*CR.NUMBERS, "audit", "repaired_sha256")) for r in df.collect()}


@pytest.fixture(scope="module")
def deep():
    import sys
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(20000)
    yield
    sys.setrecursionlimit(old)


def test_damage_and_repair_match_brute_force(spark, deep):
    rows = conv_rows()
    table = conv_table(spark, rows)
    hurt = damaged(rows)
    assert sorted(map(repr, map(tuple, CR.damage(table).collect()))) == sorted(map(repr, hurt))
    got = collected(CR.repair_conversations(CR.damage(table), table.select("conv_id")))
    assert got == brute_repair(hurt, {r[0] for r in rows})


def test_repair_does_not_depend_on_the_partitioning(spark, deep):
    rows = conv_rows(9)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")  # the long conversation lies in many slices
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert collected(CR.repair_conversations(conv_table(spark, rows, 9))) == brute_repair(
            [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], set())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repaired_turns_follow_the_grammar_and_hash(spark):
    rows = conv_rows(11)
    table = conv_table(spark, rows)
    turns = {}
    for r in CR.repaired_turns(table).orderBy("position").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["edit"], r["position"]))
    import re
    for conv, result in collected(CR.repair_conversations(table)).items():
        own = turns.get(conv, [])
        assert [t[3] for t in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0][0] for t in own))
        assert "".join(t[2] for t in own) == result[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r}:{x}" for r, x, *_ in own).encode()).hexdigest() == result[7]


def test_repair_of_an_empty_table(spark):
    empty = conv_table(spark, [])
    assert CR.repair_conversations(empty).count() == 0
    ids = spark.createDataFrame([(4,), (4,), (None,)], "conv_id long")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert collected(CR.repair_conversations(empty, ids)) == {4: nothing, None: nothing}


# ------------------------------------------------------------------ operator 12

def hugging_face():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


SPECIAL = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "a\r\n\t\x00\x0b    \n\n x's 'LL don't 12345 ½ ² _ ",
           "日本語テキスト 한국어 ́e‍ İ ſ'S ٣٤٥", " " * 3000 + "x" * 3000]


def check_packing(packed, docs, capacity):
    """Every token once, windows gapless, no padding outside powers of two."""
    tok = hugging_face()
    expected = sorted((i, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4").tobytes()))
                      for i, t in docs)
    rows = packed.collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_tokens"]))
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
    for parts in by_seq.values():
        at = 0
        for offset, length, used in sorted(parts):
            assert offset == at
            at += length
        assert at == used and (at == capacity or at < capacity and at & (at - 1) == 0)
    seen = []
    for doc, parts in by_doc.items():
        parts.sort()
        if sum(1 for i, _ in docs if i == doc) == 1:
            at = 0
            for start, length, _, total in parts:
                assert start == at
                at += length
            assert at == total
            seen.append((doc, zlib.crc32(b"".join(p[2] for p in parts))))
    single = [e for e in expected if sum(1 for i, _ in docs if i == e[0]) == 1]
    assert sorted(seen) == single
    return rows, by_seq


def test_window_packing_keeps_every_token(spark):
    rng = random.Random(2)
    docs = [(n, t) for n, t in enumerate(["", None, *SPECIAL, sentence(rng, 4000)]
                                         + [sentence(rng, rng.randrange(1, 300)) for _ in range(150)])]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, part int, ids int").repartition(7)
    rows, seqs = check_packing(WP.pack_windows(table, open_windows=4, fan=2), docs, 1024)  # three merging rounds
    tokens = sum(r["length"] for r in rows)
    assert tokens == sum(len(hugging_face().encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    assert sum(len(p) == 1 for p in seqs.values()) < len(seqs)


def test_window_packing_of_edge_rows(spark):
    packed = WP.pack_windows(edge_docs(spark))
    rows = packed.collect()
    tok = hugging_face()
    texts = [r[1] for r in edge_rows()]
    assert sum(r["length"] for r in rows) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert WP.pack_windows(empty_docs(spark)).count() == 0
    digests = {r["ids_crc32"] for r in WP.piece_digests(packed).collect()}
    assert digests == {zlib.crc32(bytes(r["ids"])) for r in rows}


def test_windows_place_best_fit_and_emit_the_fullest():
    w = WP.Windows(10, 2)
    ids = np.arange(100, dtype="<u4")
    assert w.add("a", 0, ids[:6], 6) == [] and w.add("b", 0, ids[:7], 7) == []
    assert w.add("c", 0, ids[:2], 2) == []  # rooms 4 and 3: goes to b
    out = w.add("d", 0, ids[:8], 8)  # rooms 4 and 1: b is emitted with one token of d, the rest opens a window
    assert [[(p[0], p[1], len(p[2])) for p in s] for s in out] == [[("b", 0, 7), ("c", 0, 2), ("d", 0, 1)]]
    out = w.add("e", 0, ids[:25], 25)  # two whole windows, five tokens that fit nowhere
    assert [[(p[0], p[1], len(p[2])) for p in s] for s in out] == [
        [("e", 0, 10)], [("e", 10, 10)], [("d", 1, 7), ("e", 20, 3)]]
    assert [[(p[0], len(p[2])) for p in s] for s in w.finish()] == [[("a", 6), ("e", 2)]]
    rng = random.Random(1)
    for _ in range(200):
        w, total, made = WP.Windows(16, rng.randrange(1, 5)), 0, []
        for k in range(rng.randrange(30)):
            n = rng.randrange(1, 40)
            total += n
            made += w.add(k, 0, ids[:n], n)
        made += w.finish()
        sizes = [sum(len(p[2]) for p in s) for s in made]
        assert sum(sizes) == total and all(s == 16 or s & (s - 1) == 0 and s < 16 for s in sizes)


# ------------------------------------------------------------------ operator 13

def brute_runs(x, shortest=12):
    n, out = len(x), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i:
                s = x[i:j + q]
                if len(s) >= max(shortest, 2 * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                    out.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    n, letters = rng.choice([0, 1, 12, 40, 90, 200, 350]), rng.choice([1, 2, 2, 3, 40])
    x = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n >= 4:
            a, p = rng.randrange(n), 1 + rng.randrange(n // 2)
            for i in range(a + p, min(n, a + p * rng.randrange(2, 6) + rng.randrange(p))):
                x[i] = x[i - p]
    if rng.random() < .2:  # two periodic stretches out of phase: a run of every fitting longer period
        b = [rng.randrange(2) for _ in range(rng.choice([1, 2, 3, 5]))]
        x = b * (n // (2 * len(b))) + b[:rng.randrange(len(b) + 1)] + b * (n // (2 * len(b)))
    return x


@pytest.mark.parametrize("short", [8, 16])
def test_find_runs_matches_brute_force(short, monkeypatch):
    monkeypatch.setattr(PR, "SHORT", short)
    rng = random.Random(short)
    for _ in range(400):
        docs = [periodic_words(rng) for _ in range(rng.randrange(1, 5))]
        ids = np.concatenate([np.array(d + [-1 - k], dtype=np.int64) for k, d in enumerate(docs)])
        expected, at = [], 0
        for d in docs:
            expected += [(s + at, n, q) for s, n, q in brute_runs(d)]
            at += len(d) + 1
        assert list(map(tuple, PR.find_runs(ids, np.array([len(d) for d in docs])).tolist())) == expected


def planted(doc_id, text):
    ws = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(ws)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    return ws


def digest_row(doc_id, text):
    ws = planted(doc_id, text)
    runs = brute_runs(ws)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    start, length, period = best or (None, None, None)
    return (doc_id, len(runs), start, length, period, None if best is None else 1000 * length // period,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in drop)).hexdigest(), len(ws))


def test_periodic_runs_of_edge_rows_and_documents(spark):
    docs = edge_docs(spark).unionByName(spark.createDataFrame(
        [(-7, "ab cd " * 40 + "cd ab " * 40, None, None, None, None, None, None)], SCHEMA))
    real = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 4000").select("doc_id", "text")
    for table in (docs.select("doc_id", "text", F.lit(1).alias("n"), F.lit("x").alias("w"), F.lit(2).alias("runs")), real):
        got = sorted(map(repr, map(tuple, PR.run_digests(PR.periodic_runs(PR.plant_periods(table))).collect())))
        assert got == sorted(repr(digest_row(*r)) for r in table.select("doc_id", "text").collect())
    assert PR.periodic_runs(empty_docs(spark)).count() == 0


def test_batches_of_texts_are_cut_by_words(spark, monkeypatch):
    monkeypatch.setattr(PR, "WORDS_AT_ONCE", 50)
    texts = [("a b c " * 20, None, "", "one two")[k % 4] for k in range(20)]
    frames = [PR._runs_of_texts([k], [t], 12) for k, t in enumerate(texts)]
    whole = PR._runs_of_texts(list(range(20)), texts, 12)
    assert whole.to_dict("records") == [r for f in frames for r in f.to_dict("records")]
