"""Deterministic chunk annotations (title, keywords, summary) standing in
for the reference's hosted-model call, plus an optional model hook.

* title    - first sentence of the chunk
* keywords - top-n terms by TF-IDF over the chunk corpus
* summary  - the n sentences with the highest mean term TF-IDF, in text order

Chunks are dealt to blocks. A block gives its distinct terms with their numbers
of chunks and gets the weights of these terms back, so what is shuffled by term
is one row per block and term, never an occurrence. With these weights a block
finds keywords and sentence sums of its own chunks, in one row per chunk; a
chunk's terms are bounded by the chunk budget, so no row grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import strip_ws, terms
from tessera.operators.indexing import guarded
from tessera.session import materialize, parts_of, ship_package

SENTENCE = r"[^.!?]+[.!?]*"
CHUNK_KEY = ["key", "chunk_no"]
TASK_CHARS = 4_000_000  # characters of text that a task annotates, at most about


def sentences(chunks: DataFrame, text: str = "chunk", keys=CHUNK_KEY) -> DataFrame:
    """``(keys..., sent_no, sentence)``: sentence runs ending in . ! or ?,
    stripped, empty ones dropped; sent_no from 1."""
    s = chunks.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(SENTENCE), 0))
                      .alias("__p", "__s"))
    return (s.select(*keys, (F.col("__p") + 1).alias("sent_no"), strip_ws("__s").alias("sentence"))
            .filter(F.col("sentence") != ""))


def term_frequencies(chunks: DataFrame, text: str = "chunk", keys=CHUNK_KEY) -> DataFrame:
    """``(keys..., term, tf)``."""
    t = chunks.select(*keys, F.explode(terms(text)).alias("term"))
    return t.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(chunks: DataFrame, text: str = "chunk", keys=CHUNK_KEY,
          corpus: DataFrame | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """``(keys..., term, tf, tfidf)`` with smooth idf
    ``ln((1 + N) / (1 + df)) + 1``, rounded to 9 decimals so that ranking is
    stable across engines. ``N`` and ``df`` come from ``corpus`` (default:
    the chunks themselves), so annotating a subset uses whole-corpus
    statistics, or from stored ``statistics`` ``(term, df)``, in which the
    empty term has the number of chunks."""
    tf = term_frequencies(chunks, text, keys)
    if statistics is not None:
        n = statistics.filter("term = ''").agg(F.max("df").alias("n")).scalar()
        df = statistics.filter("term <> ''")
    else:
        base = chunks if corpus is None else corpus
        ctf = tf if corpus is None else term_frequencies(corpus, text, keys)
        n = base.agg(F.count(F.lit(1)).alias("n")).scalar()
        df = ctf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return tf.join(df, "term").select(*keys, "term", "tf", F.round(F.col("tf") * idf, 9).alias("tfidf"))


def keywords(weights: DataFrame, n: int = 8, keys=CHUNK_KEY) -> DataFrame:
    """Top-n terms per chunk as an ordered array."""
    w = Window.partitionBy(*keys).orderBy(F.col("tfidf").desc(), "term")
    top = weights.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    return top.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__r", "term"))), lambda s: s["term"])
        .alias("keywords"))


def _idf(found: DataFrame, base: DataFrame, corpus: DataFrame | None, statistics: DataFrame | None, text: str) -> DataFrame:
    """``(block, term, idf)`` for the terms of every block ``(block, term, n)``,
    NULL where a term has no frequency: from the blocks' own numbers of
    chunks, a corpus, or stored statistics, as in ``tfidf``."""
    if statistics is not None:
        n = statistics.filter("term = ''").agg(F.max("df").alias("n")).scalar()
        df = statistics.filter("term <> ''")
    else:
        n = (base if corpus is None else corpus).agg(F.count(F.lit(1)).alias("n")).scalar()
        df = None if corpus is None else (corpus.select(F.explode(F.array_distinct(terms(text))).alias("term"))
                                          .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    if df is None:  # a term has a row per block at most
        found = found.withColumn("df", F.sum("n").over(Window.partitionBy("term")))
    else:
        found = found.join(df.select("term", "df"), "term", "left")
    return found.select("block", "term", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))


def half_up(x: np.ndarray, digits: int = 9) -> np.ndarray:
    """Non-negative numbers (or NaN) rounded as SQL rounds doubles: half up on
    the shortest decimal that stands for the number."""
    y = x * 10.0 ** digits
    low = np.floor(y)
    out = np.floor(y + 0.5) / 10.0 ** digits
    close = np.flatnonzero(np.abs(y - low - 0.5) < 1e-3 + y * 1e-15)
    unit = Decimal(1).scaleb(-digits)
    out[close] = [float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) for v in x[close].tolist()]
    return out


def _lists(values, owners: np.ndarray, size: int) -> pa.ListArray:
    """One list per owner ``0 .. size - 1`` from values sorted by owner."""
    ends = np.cumsum(np.bincount(owners, minlength=size))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def _weigh(keys: list[str], n_keywords: int):
    """Function of a block's chunks ``(keys..., sizes, tokens)`` and its terms
    ``(term, idf)`` that gives per chunk its keywords and, per sentence in
    order, the number ``sent_no``, the sum ``total`` of the weights of its terms
    and how many these are. ``sizes`` has the number of terms of every sentence
    run, -1 for a blank one. Rows with equal keys are one chunk."""
    def run(chunks: pa.Table, lookup: pa.Table) -> pa.Table:
        own = chunks.select(keys).to_pandas().astype(object)
        own = own.groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if len(own) else np.zeros(0, np.int64)
        sizes, tokens = chunks["sizes"].combine_chunks(), chunks["tokens"].combine_chunks()
        runs = pc.list_value_length(sizes).to_numpy(zero_copy_only=False).astype(np.int64)
        size = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(own)), runs)
        sent = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + 1
        per_run = np.maximum(size, 0)
        # terms by number, in the order of their bytes
        coded = tokens.flatten().dictionary_encode()
        names = coded.dictionary
        by_name = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(names), np.int64)
        rank[by_name] = np.arange(len(names))
        term = rank[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        names = names.take(pa.array(by_name))
        at = pc.index_in(names, value_set=lookup["term"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.float64)
        idf = np.full(len(names), np.nan)
        known = np.flatnonzero(~np.isnan(at))
        idf[known] = lookup["idf"].to_numpy().astype(np.float64)[at[known].astype(np.int64)]
        chunk = np.repeat(own[row], per_run)
        pair, which, tf = np.unique(chunk * max(len(names), 1) + term, return_inverse=True, return_counts=True)
        of_chunk, of_term = np.divmod(pair, max(len(names), 1))
        weight = half_up(tf * idf[of_term])
        # keywords: heaviest first, of equal ones the smaller term; terms without a weight before all
        best = np.lexsort((of_term, np.where(np.isnan(weight), -np.inf, -weight), of_chunk))
        first = np.searchsorted(of_chunk[best], of_chunk[best])
        best = best[np.arange(len(best)) - first < n_keywords]
        # sentences: weights are added in ascending order, so that sums do not depend on the order of terms
        bare = size == 0
        place = np.concatenate([chunk, own[row[bare]]]), np.concatenate([np.repeat(sent, per_run), sent[bare]])
        value = np.concatenate([weight[which], np.full(int(bare.sum()), np.nan)])
        width = int(place[1].max(initial=0)) + 1
        spot, group = np.unique(place[0] * width + place[1], return_inverse=True)
        order = np.lexsort((np.where(np.isnan(value), -np.inf, value), group))
        total = np.bincount(group[order], weights=np.nan_to_num(value[order]), minlength=len(spot)).astype(np.float64)
        count = np.bincount(group, weights=~np.isnan(value), minlength=len(spot)).astype(np.int32)
        owner = spot // width
        made = int(own.max(initial=-1)) + 1
        out = {k: chunks[k].combine_chunks().take(pa.array(np.unique(own, return_index=True)[1])) for k in keys}
        out["keywords"] = _lists(names.take(pa.array(of_term[best])), of_chunk[best], made)
        out["sent_no"] = _lists(pa.array((spot % width).astype(np.int32)), owner, made)
        out["total"], out["n"] = _lists(pa.array(total), owner, made), _lists(pa.array(count), owner, made)
        out = pa.table(out)
        return out.filter(pc.greater(pc.list_value_length(out["sent_no"]), 0))
    return run


def annotate_chunks(chunks: DataFrame, n_keywords: int = 8, n_sentences: int = 2,
                    text: str = "chunk", keys=CHUNK_KEY,
                    model_fn: Callable[[str], str] | None = None,
                    corpus: DataFrame | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """``(keys..., title, keywords, summary, annotation)``.

    ``model_fn`` (optional) replaces the annotation text with a per-chunk
    call made in Arrow batches with per-row error isolation (D10); a failed
    call leaves NULL, which ``fill_failed`` turns into the marker.

    A block has about ``TASK_CHARS`` characters of text (they are read once more
    for it), so a task's work stays the same as the table grows. Weights per
    block and term, then keywords and sentences per chunk are written, and only
    these meet the texts."""
    spark = chunks.sparkSession
    ship_package(spark)
    keys = list(keys)
    n = parts_of(spark, chunks.agg(F.sum(F.char_length(text))).first()[0], TASK_CHARS)
    block = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias("block")
    found = (chunks.select(block, text).repartition(n, "block").select("block", F.explode(F.array_distinct(terms(text))).alias("term"))
             .groupBy("block", "term").agg(F.count(F.lit(1)).alias("n")))
    lookup = materialize(_idf(found, chunks, corpus, statistics, text))
    # Runs of letters never cross a sentence end, so these are the terms of the whole chunk.
    of_runs = F.transform("runs", lambda r: terms(r))
    sizes = F.zip_with("runs", "found", lambda r, t: F.when(F.size(t) > 0, F.size(t)).when(r.rlike(r"\S"), 0).otherwise(-1))
    dealt = (chunks.select(block, *keys, text).dropna(subset=keys).repartition(n, "block")
             .select("block", *keys, F.regexp_extract_all(F.col(text), F.lit(SENTENCE), 0).alias("runs"))
             .select("*", of_runs.alias("found")).select("block", *keys, sizes.alias("sizes"), F.flatten("found").alias("tokens"))
             .filter("sizes IS NOT NULL"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*keys).schema)
    w = materialize(dealt.groupBy("block").cogroup(lookup.groupBy("block")).applyInArrow(
        _weigh(keys, n_keywords), f"{kinds}, keywords array<string>, sent_no array<int>, total array<double>, n array<int>"))
    mean = F.expr("""transform(arrays_zip(sent_no, total, n), x -> struct(
        -coalesce(round(x.total / nullif(x.n, 0), 9), 0D) AS least, x.sent_no AS sent_no))""")
    best = w.select(*keys, "keywords", F.array_sort(F.slice(F.array_sort(mean), 1, n_sentences)["sent_no"]).alias("best"))
    runs = F.regexp_extract_all(F.col(text), F.lit(SENTENCE), 0)
    summary = F.array_join(F.transform("best", lambda i: strip_ws(F.element_at("runs", i))), " ")
    spread = chunks.select(*keys, F.col(text).alias(text)).repartition(n, *keys)
    out = (spread.select(*keys, strip_ws(F.regexp_extract(F.col(text), SENTENCE, 0)).alias("title"), runs.alias("runs"))
           .join(best, keys, "left")
           .select(*keys, "title", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), summary.alias("summary")))
    annotation = F.concat_ws("\n",
                             F.concat(F.lit("Title: "), F.col("title")),
                             F.concat(F.lit("Keywords: "), F.array_join("keywords", ", ")),
                             F.concat(F.lit("Summary: "), F.coalesce("summary", F.lit(""))))
    out = out.withColumn("annotation", annotation)
    if model_fn is not None:
        out = guarded(out.join(chunks.select(*keys, text), keys), model_fn, text, "__model") \
            .withColumn("annotation", F.col("__model")).drop("__model", text)
    return out


def chunk_topics(annotated: DataFrame, keys=CHUNK_KEY) -> DataFrame:
    """D5 topics ``(keys..., topic, topic_chunks)``: of a chunk's keywords the
    one that most chunks of the corpus have as a keyword too (ties: smallest
    term), with that number. No vocabulary limit; chunks without keywords
    have no topic."""
    kw = materialize(annotated.select(*keys, F.explode("keywords").alias("topic")))  # read twice
    use = kw.groupBy("topic").agg(F.count(F.lit(1)).alias("topic_chunks"))
    best = F.min(F.struct((-F.col("topic_chunks")).alias("n"), "topic")).alias("b")
    return (kw.join(use, "topic").groupBy(*keys).agg(best)
            .select(*keys, F.col("b.topic").alias("topic"), (-F.col("b.n")).alias("topic_chunks")))
