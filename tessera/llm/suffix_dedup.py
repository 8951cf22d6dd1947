"""Substring dedup with prefix-partitioned suffix trees.

A word goes if a window of 50 words that covers it also starts in a document
with a smaller id. Every window start is a suffix. Its prefix up to the end of
the window's minimiser (the 8-word shingle with the smallest hash among the
43 in the window, leftmost on ties) is a prefix of variable length that equal
windows share, so suffixes are partitioned by it. Neighbouring suffixes with
the same minimiser travel together as one context (the words from the first
of them to the end of the last one's window).

1. Per document the distinct (minimiser, context hash) pairs; whole copies of
   a smaller document are settled by a digest of all words.
2. Minimisers seen in one document only cannot repeat and drop out. A context
   that a smaller document has as a whole repeats as a whole.
3. Only the distinct contexts that are left differ somewhere; they are
   fetched as words. Per minimiser, a group of at most ``GROUP`` contexts
   fits in memory: its suffixes are sorted, and the runs with a common prefix
   of 50 words are the leaves below the deep internal nodes of the suffix tree.
   In each run the smallest id stays. Groups that are larger get their prefix
   extended to the full 50 words, where every group is one deep node, and only
   its smallest id is needed: a plain grouped minimum, however hot the passage.
4. Documents with repeats are read again, the contexts found are marked and
   the covered words removed.

Between the passes only hashes are shuffled, except for the contexts of step 3
and the texts of step 4.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bits import build_filter, may_contain
from tessera.llm.ngram_join import groups_of
from tessera.llm.text import byte_words, mix64, shingle_hashes, word_hashes
from tessera.session import materialize, ship_package

WINDOW = 50
SHINGLE = 8
GROUP = 512
FILTER_BITS = 1 << 25
NO_ID = (1 << 63) - 1  # NULL ids come after all others
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p)


def leftmost_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of every ``width`` consecutive values."""
    idx, span = np.arange(len(v), dtype=np.int64), 1
    while span < width:
        step = min(span, width - span)
        a, b = idx[:-step], idx[step:]
        idx = np.where(v[a] <= v[b], a, b)
        span += step
    return idx


def contexts(h: np.ndarray):
    """``(minimiser, context hash, first start, starts)`` arrays of a document
    given its word hashes; empty for fewer than ``WINDOW`` words."""
    if len(h) < WINDOW:
        e = np.empty(0, dtype=np.int64)
        return e, e, e, e
    v = shingle_hashes(h, SHINGLE)
    chosen = leftmost_minimum(v, WINDOW - SHINGLE + 1)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    count = np.diff(np.r_[first, len(chosen)])
    total = np.r_[np.uint64(0), np.cumsum(h * _powers(_BASE, len(h)))]
    region = (total[first + count + WINDOW - 1] - total[first]) * _powers(_INVERSE, len(h))[first]
    place = ((chosen[first] - first) * 64 + count).astype(np.uint64)
    return v[chosen[first]].view(np.int64), mix64(region + mix64(place)).view(np.int64), first, count


def _sequence_id(ws) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(b" ".join(ws))
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _survey(frames):
    for f in frames:
        rows, size = [], 0
        for id_, text in zip(f["id"], f["text"]):
            ws = byte_words(text)
            hi, lo = _sequence_id(ws)
            m, c, _, _ = contexts(word_hashes(ws))
            if len(m):
                pairs = np.unique(np.stack([m, c], axis=1), axis=0)
                m, c = pairs[:, 0], pairs[:, 1]
            rows.append((id_, hi, lo, len(ws), hashlib.sha256(b" ".join(ws)).hexdigest(), m, c))
            size += len(m)
            if size > 1 << 19:
                yield pd.DataFrame(rows, columns=["id", "hi", "lo", "n_words", "sha", "mins", "ctxs"])
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["id", "hi", "lo", "n_words", "sha", "mins", "ctxs"])


def _keys(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")


def _pair_key(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return m ^ c


def fetch_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``mini, ctx, words`` (word hashes as bytes) of the contexts in
    ``wanted`` (mini, ctx, owner), read again from the texts of their
    owners."""
    table = build_filter(wanted, F.col("mini").bitwiseXOR(F.col("ctx")), FILTER_BITS)
    owners = build_filter(wanted, F.xxhash64("owner"), FILTER_BITS)
    shared = docs.sparkSession.sparkContext.broadcast((table, owners))

    def emit(frames):
        table, owners = shared.value
        for f in frames:
            rows, size = [], 0
            own = may_contain(owners, f["h"].to_numpy(dtype=np.int64))
            for id_, text, hit in zip(f["id"], f["text"], own):
                if not hit:
                    continue
                h = word_hashes(byte_words(text))
                m, c, first, count = contexts(h)
                if not len(m):
                    continue
                seen = set()
                for k in np.flatnonzero(may_contain(table, _pair_key(m, c))):
                    key = (int(m[k]), int(c[k]))
                    if key not in seen:
                        seen.add(key)
                        part = h[first[k]:first[k] + count[k] + WINDOW - 1]
                        rows.append((*key, id_, part.tobytes()))
                        size += len(part)
                if size > 1 << 19:
                    yield pd.DataFrame(rows, columns=["mini", "ctx", "owner", "words"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["mini", "ctx", "owner", "words"])

    got = _keys(docs).withColumn("h", F.xxhash64("id")).mapInPandas(emit, "mini long, ctx long, owner long, words binary")
    return got.join(wanted, ["mini", "ctx", "owner"], "left_semi").dropDuplicates(["mini", "ctx"])


def _windows(words: bytes) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(words, dtype=np.uint64), WINDOW)


def repeats_in_tree(rows) -> list[tuple[int, int, list[int]]]:
    """``(mini, ctx, offsets)``: suffixes of a group that have a 50-word
    prefix in common with one of a smaller owner."""
    tables = [_windows(r.words) for r in rows]
    sizes = [len(t) for t in tables]
    suffixes = np.ascontiguousarray(np.concatenate(tables))
    owner = np.repeat(np.array([r.owner for r in rows], dtype=np.int64), sizes)
    order = np.argsort(suffixes.view(f"V{8 * WINDOW}").ravel(), kind="stable")
    ranked = suffixes[order]
    node = np.r_[0, np.cumsum((ranked[1:] != ranked[:-1]).any(axis=1))]  # deep nodes in suffix order
    least = np.full(node[-1] + 1, NO_ID, dtype=np.int64)
    np.minimum.at(least, node, owner[order])
    hit = np.empty(len(order), dtype=bool)
    hit[order] = owner[order] > least[node]
    found, at = [], 0
    for r, n in zip(rows, sizes):
        offsets = np.flatnonzero(hit[at:at + n])
        if len(offsets):
            found.append((r.mini, r.ctx, offsets.tolist()))
        at += n
    return found


def _tree_tasks(frames):
    for _, rows in groups_of(frames, ("mini",)):
        found = repeats_in_tree(rows)
        if found:
            yield pd.DataFrame(found, columns=["mini", "ctx", "offsets"])


def _full_prefixes(frames):
    """One row per suffix of a large group, with the digest of its 50 words."""
    for f in frames:
        for r in f.itertuples(index=False):
            w = _windows(r.words)
            d = [xxhash.xxh3_128_digest(x.tobytes()) for x in w]
            yield pd.DataFrame({"mini": r.mini, "ctx": r.ctx, "owner": r.owner, "offset": range(len(d)), "node": d})


def shared_minimisers(pairs: DataFrame, id_: str) -> DataFrame:
    """``mini`` of the minimisers that ``pairs`` (mini, id_) has with two ids
    or more. Each task sends one row per minimiser, however hot it is."""
    ends = pairs.groupBy("mini").agg(F.min(id_).alias("a"), F.max(id_).alias("b"))
    return ends.filter("a < b").select("mini")


def partial_repeats(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``mini, ctx, offsets`` for the contexts that repeat in parts."""
    fetched = materialize(fetch_contexts(docs, wanted))
    counts = wanted.groupBy("mini").agg(F.count(F.lit(1)).alias("c"))
    # the words join on all three columns, which spreads the contexts of a hot minimiser
    rows = fetched.join(wanted.join(counts, "mini").select("mini", "ctx", "owner", "c"), ["mini", "ctx", "owner"])
    small = rows.filter(F.col("c") <= GROUP).drop("c").repartition("mini").sortWithinPartitions("mini")
    trees = small.mapInPandas(_tree_tasks, "mini long, ctx long, offsets array<int>")
    deep = materialize(rows.filter(F.col("c") > GROUP).drop("c").mapInPandas(
        _full_prefixes, "mini long, ctx long, owner long, offset int, node binary"))
    least = deep.groupBy("node").agg(F.min("owner").alias("least"))
    large = (deep.join(least, "node").filter("owner > least").groupBy("mini", "ctx")
             .agg(F.sort_array(F.collect_list("offset")).alias("offsets")))
    return trees.unionByName(large)


def _remove(frames):
    for f in frames:
        out = []
        for id_, lo, text, marks in zip(f["id"], f["lo"], f["text"], f["marks"]):
            ws = byte_words(text)
            m, c, first, count = contexts(word_hashes(ws))
            known = {(x["mini"], x["ctx"]): x["offsets"] for x in marks}
            edge = np.zeros(len(ws) + 1, dtype=np.int64)
            for k in range(len(m)):
                key = (int(m[k]), int(c[k]))
                if key in known:
                    o = known[key]
                    starts = first[k] + (np.arange(count[k]) if o is None or len(o) == 0 else np.asarray(o, dtype=np.int64))
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + WINDOW, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join(w for w, g in zip(ws, gone) if not g)
            out.append((id_, lo, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(out, columns=["id", "lo", "n_removed", "kept_sha256", "kept_text"])


def _marked_texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Texts of the documents in ``marks``; a fixed-size filter keeps most
    others out of the shuffle, the join is exact."""
    shared = docs.sparkSession.sparkContext.broadcast(build_filter(marks, F.xxhash64("id"), FILTER_BITS))

    def emit(frames):
        for f in frames:
            f = f[may_contain(shared.value, f["h"].to_numpy(dtype=np.int64))]
            yield pd.DataFrame({"id": f["id"], "lo": [_sequence_id(byte_words(t))[1] for t in f["text"]], "text": f["text"]})

    texts = _keys(docs).withColumn("h", F.xxhash64("id")).mapInPandas(emit, "id long, lo long, text string")
    return texts.distinct().join(marks, ["id", "lo"])


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``
    (needs ``doc_id, text``; other columns are ignored), with ``with_text``
    also ``kept_text``: NULL where nothing was removed, else the kept words.

    NULL text has no words (digest of the empty string). A NULL id counts as
    larger than every id. Rows with equal ids do not remove each other's words;
    repeated rows get equal results. An empty table gives no rows."""
    ship_package(docs.sparkSession)
    s = materialize(_keys(docs).mapInPandas(
        _survey, "id long, hi long, lo long, n_words long, sha string, mins array<long>, ctxs array<long>"))
    first = s.groupBy("hi", "lo").agg(F.min("id").alias("first"))
    heads = s.select("id", "hi", "lo", "mins", "ctxs").join(first, ["hi", "lo"]).filter("id = first")
    seen = heads.select("id", "lo", F.explode(F.arrays_zip("mins", "ctxs")).alias("x")) \
        .select("id", "lo", F.col("x.mins").alias("mini"), F.col("x.ctxs").alias("ctx"))
    # over all rows, copies too: a superset of what the heads share, without their join
    everywhere = s.select("id", F.explode("mins").alias("mini"))
    seen = materialize(seen.join(shared_minimisers(everywhere, "id"), "mini", "left_semi"))
    owner = materialize(seen.groupBy("mini", "ctx").agg(F.min("id").alias("owner")))
    wanted = materialize(owner.join(shared_minimisers(owner, "owner"), "mini", "left_semi"))
    parts = materialize(partial_repeats(docs, wanted))
    found = seen.join(owner, ["mini", "ctx"])
    whole = found.filter("id > owner").select("id", "lo", "mini", "ctx", F.array().cast("array<int>").alias("offsets"))
    some = found.filter("id = owner").join(parts, ["mini", "ctx"]).select("id", "lo", "mini", "ctx", "offsets")
    marks = materialize(whole.unionByName(some).groupBy("id", "lo").agg(
        F.collect_list(F.struct("mini", "ctx", "offsets")).alias("marks")))
    result = _marked_texts(docs, marks).mapInPandas(
        _remove, "id long, lo long, n_removed long, kept_sha256 string, kept_text string")
    result = result if with_text else result.drop("kept_text")
    nothing = hashlib.sha256(b"").hexdigest()
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= WINDOW)
    out = s.drop("mins", "ctxs").join(first, ["hi", "lo"]).join(result.dropDuplicates(["id", "lo"]), ["id", "lo"], "left")
    columns = [F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words",
               F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
               F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")]
    if with_text:
        columns.append(F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out.select(*columns)
