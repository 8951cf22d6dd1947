"""Periodic runs of words: a run is a stretch with smallest period q (words
q apart are identical) of at least ``max(MIN_LENGTH, 2 * q)`` words that no
neighbouring word extends with that period.

Periods under ``SHORT`` are found by direct lag scans. Longer ones are found
scale by scale, a scale holding the periods ``P <= q < 2P``. There the word
k-grams (k = P/2) are hashed and the minima of every window of w = P/2
k-grams are kept. A run holds two whole copies of its period and the first
w + k - 1 < q words of both are equal, so a minimum of the first copy's first
window is a minimum q words later too: one equal-minimizer pair at distance q
is certain. Pairs are seeds only; each is extended word by word in both
directions, so the result is exact.

Equal minimizers at most k/2 apart overlap, so their k-gram is itself periodic
and they form one arithmetic cluster. Two members of one cluster seed no run
(the stretch would have the cluster's own smaller period). Two clusters
seed each distance between their members once, whatever their sizes, and at
most eight clusters of one k-gram start within 2P words. So the seeds
grow with the words, never with the square of a group.

Documents are independent rows; many are laid behind each other in one array
with a separator of its own after each, which equals no word, and all scans
run over the whole array. Memory is bounded by ``WORDS_AT_ONCE`` words or
the longest document. There is no shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import byte_words, mix64, words
from tessera.session import ship_package

MIN_LENGTH = 12  # words of the shortest run
SHORT = 16       # periods below are scanned directly; a power of two, at least 8
WORDS_AT_ONCE = 1 << 20
RESULT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _window(x: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``size`` neighbours; ``size`` is
    a power of two."""
    j = 1
    while j < size:
        x = best(x[:-j], x[j:])
        j *= 2
    return x


def _gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    h = mix64(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    j = 1
    while j < k:
        h = mix64(h[:-j] * np.uint64(0xD6E8FEB86659FD93) + h[j:])
        j *= 2
    return h


def _minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the minimum of some window of ``w``."""
    if len(h) < w:
        return np.empty(0, dtype=np.int64)
    low = _window(h, w, np.minimum)
    pad = np.zeros(w - 1, dtype=np.uint64)
    return np.flatnonzero(_window(np.concatenate([pad, low, pad]), w, np.maximum) == h)


def _seeds(h: np.ndarray, at: np.ndarray, k: int, low: int, high: int):
    """``(position, distance)`` for equal k-grams at distances ``low`` to
    ``high``, one per cluster pair and distance."""
    at = at[np.argsort(h[at], kind="stable")]
    value = h[at]
    near = (value[1:] == value[:-1]) & (at[1:] - at[:-1] <= high)
    member = np.zeros(len(at), dtype=bool)
    member[1:] |= near
    member[:-1] |= near
    at, value = at[member], value[member]
    if not len(at):
        return []
    gap = np.diff(at)
    cut = np.flatnonzero((value[1:] != value[:-1]) | (gap > k // 2))
    first = np.concatenate([[0], cut + 1])
    last = np.concatenate([cut, [len(at) - 1]])
    inner = np.concatenate([[0], gap])  # distance to the member before, 0 for the first of a cluster
    inner[first] = 0
    step = np.gcd.reduceat(inner, first)
    a0, a1, value = at[first], at[last], value[first]
    out = []
    for hop in range(1, len(first)):
        left, right = slice(0, len(first) - hop), slice(hop, len(first))
        ok = (value[left] == value[right]) & (a0[right] - a1[left] <= high)
        if not ok.any():
            break
        fa, la, fb, lb = a0[left][ok], a1[left][ok], a0[right][ok], a1[right][ok]
        d = np.maximum(np.gcd(step[left][ok], step[right][ok]), 1)
        nearest = fb - la
        lo = nearest + np.maximum(0, -(-(low - nearest) // d)) * d
        n = np.maximum(0, (np.minimum(high, lb - fa) - lo) // d + 1)
        which = np.repeat(np.arange(len(n)), n)
        q = lo[which] + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * d[which]
        out.append(np.stack([np.maximum(fa[which], fb[which] - q), q], axis=1))
    return out


def _stretch(ids: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The largest ``[s, e)`` around ``i`` with ``ids[j] == ids[j + q]``;
    ``(i, i)`` when that fails at ``i``."""
    e, step, size = i, 64, len(ids)
    while e + q < size:
        n = min(step, size - q - e)
        bad = ids[e:e + n] != ids[e + q:e + q + n]
        k = int(bad.argmax())
        if bad[k]:
            e += k
            break
        e += n
        step *= 2
    s, step = i, 64
    while s > 0:
        n = min(step, s)
        bad = (ids[s - n:s] != ids[s - n + q:s + q])[::-1]
        k = int(bad.argmax())
        if bad[k]:
            s -= k
            break
        s -= n
        step *= 2
    return s, e


def _smallest(ids: np.ndarray, s: int, e: int, q: int) -> bool:
    """Has the stretch ``[s, e)``, which has period ``q`` and at least ``2q``
    words, no smaller one? A smaller one divides ``q`` (Fine and Wilf)."""
    rest, f = q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            p = q // f
            if np.array_equal(ids[s:e - p], ids[s + p:e]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def find_runs(ids: np.ndarray, lengths: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows ``(start, length, period)``, ordered by start and period, of the
    runs in documents of ``lengths`` words that lie behind each other in
    ``ids``, each followed by a separator of its own. A run cannot cross a
    separator: at most q - 1 words in a row have their partner q words on in
    the next document."""
    found = []
    for q in range(1, SHORT):
        if len(ids) <= q:
            break
        bad = np.concatenate([[-1], np.flatnonzero(ids[q:] != ids[:-q]), [len(ids) - q]])
        equal = np.diff(bad) - 1
        for k in np.flatnonzero(equal >= max(min_length, 2 * q) - q):
            s, n = int(bad[k]) + 1, int(equal[k]) + q
            if _smallest(ids, s, s + n, q):
                found.append((s, n, q))
    sub, where, size, scale = ids, None, lengths, SHORT
    while True:
        keep = size >= 2 * scale  # a run of this scale has at least two whole periods
        if not keep.any():
            break
        if not keep.all():
            mask = np.repeat(keep, size + 1)
            where = np.flatnonzero(mask) if where is None else where[mask]
            sub, size = sub[mask], size[keep]
        k = w = scale // 2
        h = _gram_hashes(sub, k)
        seeds = _seeds(h, _minimizers(h, w), k, scale, 2 * scale - 1)
        if seeds:
            seeds = np.concatenate(seeds)
            seeds = seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))]
            last_q, end = 0, -1
            for i, q in seeds.tolist():
                if q == last_q and i < end:
                    continue  # inside the stretch just seen
                s, e = _stretch(sub, i, q)
                last_q, end = q, e
                n = e - s + q
                if n >= max(min_length, 2 * q) and _smallest(sub, s, s + n, q):
                    found.append((s if where is None else int(where[s]), n, q))
        scale *= 2
    if not found:
        return np.empty((0, 3), dtype=np.int64)
    runs = np.unique(np.array(found, dtype=np.int64), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(ws: list[bytes], runs) -> str:
    """The words outside of every run's repetitions (a run keeps its first
    period), joined by one space."""
    if len(runs):
        drop = np.zeros(len(ws) + 1, dtype=np.int64)
        np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
        ws = [w for w, d in zip(ws, np.cumsum(drop).tolist()) if not d]
    return b" ".join(ws).decode("utf-8", "surrogatepass")


def _runs_of_texts(ids_of_rows, texts, min_length) -> pd.DataFrame:
    number = defaultdict(count().__next__)  # word -> number, exact
    ws = [byte_words(t) for t in texts]
    lengths = np.array([len(w) for w in ws], dtype=np.int64)
    ends = np.cumsum(lengths + 1)
    ids = np.empty(int(ends[-1]), dtype=np.int64)
    for k, (end, w) in enumerate(zip(ends.tolist(), ws)):
        ids[end - 1 - len(w):end - 1] = np.fromiter(map(number.__getitem__, w), dtype=np.int64, count=len(w))
        ids[end - 1] = -1 - k
    runs = find_runs(ids, lengths, min_length)
    first = np.searchsorted(runs[:, 0], ends - lengths - 1)
    after = np.append(first[1:], len(runs))
    listed, collapsed = [], []
    for k, w in enumerate(ws):
        own = runs[first[k]:after[k]] - [ends[k] - lengths[k] - 1, 0, 0]
        listed.append([{"start": s, "length": n, "period": q} for s, n, q in own.tolist()])
        collapsed.append(collapse(w, own))
    return pd.DataFrame({"doc_id": pd.Series(ids_of_rows, dtype="object"), "n_words": lengths, "runs": listed, "collapsed": collapsed})


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``, one row per row of ``docs``
    (needs ``doc_id, text``; other columns are ignored): all runs of the whole
    text, ordered by start and period, and the text without their repetitions
    (each run keeps its first period).

    NULL and blank texts have no words, no runs and an empty ``collapsed``.
    Repeated rows and NULL ids give a row each. Runs may overlap; equal starts
    are ordered by period. An empty table gives no rows."""
    ship_package(docs.sparkSession)

    def run(batches):
        for frame in batches:
            ids = frame["doc_id"].tolist()
            texts, room, begin = [], WORDS_AT_ONCE, 0
            for t in frame["text"]:
                texts.append(t)
                room -= 1 + len(t or "") // 6
                if room < 0:
                    yield _runs_of_texts(ids[begin:begin + len(texts)], texts, min_length)
                    begin, texts, room = begin + len(texts), [], WORDS_AT_ONCE
            if texts:
                yield _runs_of_texts(ids[begin:], texts, min_length)

    # ids travel as text: a NULL must not turn them into floats
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return named.mapInPandas(run, RESULT.replace("doc_id long", "doc_id string")) \
        .withColumn("doc_id", F.col("doc_id").cast("long"))


def plant_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the contract's periods: with h the CRC-32 of the
    decimal id and g = h / 10, where ``h % 10 = 0`` every word from ``a = g %
    n`` on repeats the first ``p = 1 + (n - a) / (3 + g % 8)`` words there.
    Other texts, those without words and rows without an id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    g = F.floor(F.col("h") / 10)
    w = w.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.pmod(g, F.col("n"))).cast("int"))
    w = w.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod(g, F.lit(8))))).cast("int"))
    rest = F.col("n") - F.col("a")
    copies = F.ceil(rest / F.col("p")).cast("int")
    planted = F.concat(F.slice("w", F.lit(1), F.col("a")),
                       F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), copies)), F.lit(1), rest))
    return w.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and SHA-256 of all
    runs as ``start,length,period`` lines and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    length, period = best["length"], -best["period"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words")
