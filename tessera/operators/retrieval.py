"""Retrieval: scoring (T2), reply parsing (T3), top-k (T4), threshold (T5),
context (T6), truncation (T7), prompts (T8), extractive answer summary (T9)
and output clipping (T10). T1 lives in ``indexing.explode_index``.

T2 scores many questions in one job with BM25 over a written term table: the
question terms are equi-joined to it on ``term`` and summed per (question,
chunk), never crossing questions with chunks. Corpus statistics (chunk
count, mean length) are a scalar subquery over the same table; document
frequencies are one grouped count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import strip_ws, terms
from tessera.operators.annotate import SENTENCE
from tessera.session import materialize, parts_of

# Fixed values of the reference.
TOP_K = 3
MIN_SCORE = 0.4
CONTEXT_LIMIT, CONTEXT_KEEP = 12000, 4000
CLIP = 3000
CONTEXT_HEADER = "Top Relevant Chunks and the answer:"
CONTEXT_LINE = "Related report: "

K1, B = 1.2, 0.75

TASK_CHARS = 8_000_000  # characters of text whose terms a task counts, at most about
TASK_PAIRS = 2_000_000  # pairs of question term and chunk that a task sums, at most about


def term_table(chunks: DataFrame, text: str = "text") -> DataFrame:
    """The inverted index ``(file, chunk, dl, term, tf)`` of chunks
    ``(file, chunk, text)``, written once to the shared folder: term and
    document frequencies, lengths and corpus size are all read from it, so
    the texts are tokenised once.

    Chunks are partitioned before their terms are exploded: texts are smaller
    than term rows, ``tf`` then needs no shuffle of its own, and the written
    rows of a chunk stay together. A chunk is one row, so its length is the
    size of its term array. There are as many partitions as the texts need
    (they are read once more for it), so the counts of a task fit its memory."""
    n = parts_of(chunks.sparkSession, chunks.agg(F.sum(F.char_length(text))).first()[0], TASK_CHARS)
    t = chunks.select("file", "chunk", text).repartition(n, "file", "chunk").select("file", "chunk", terms(text).alias("__t"))
    # plain explode would have the terms found a second time, by a filter for empty arrays below the shuffle
    t = t.select("file", "chunk", F.size("__t").alias("dl"), F.explode_outer("__t").alias("term")).filter("term IS NOT NULL")
    return materialize(t.groupBy("file", "chunk", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))


def question_terms(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", F.explode(F.array_distinct(terms("text"))).alias("term"))


def term_stats(table: DataFrame) -> DataFrame:
    """Both corpus statistics as one struct ``(n, avgdl)``; chunks without
    terms count for neither."""
    return table.groupBy("file", "chunk").agg(F.max("dl").alias("dl")).agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")))


def frequencies(chunks: DataFrame, table: DataFrame) -> DataFrame:
    """``(term, df)`` for ``annotate.tfidf``: the number of chunks ``(file,
    chunk)`` that have a term; the empty term has the number of chunk rows.

    Counted over the term table, without a shuffle of its rows. It has a chunk
    once per length, so texts of several lengths under one name are counted
    out again: only their rows are grouped."""
    several = (table.groupBy("file", "chunk").agg(F.min("dl").alias("a"), F.max("dl").alias("b"))
               .filter("a <> b").select("file", "chunk"))
    several = materialize(several)  # none where names are unique
    more = (table.join(several, ["file", "chunk"], "left_semi").groupBy("term", "file", "chunk")
            .agg((F.lit(1) - F.count(F.lit(1))).alias("df")).select("term", "df"))
    counted = table.groupBy("term").agg(F.count(F.lit(1)).alias("df")).unionByName(more)
    size = chunks.agg(F.lit("").alias("term"), F.count(F.lit(1)).alias("df"))
    return counted.groupBy("term").agg(F.sum("df").alias("df")).unionByName(size)


def term_weight(idf, tf, dl, avgdl, k1: float, b: float):
    """BM25 weight of one term in one chunk."""
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25(questions: DataFrame, table: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, file, chunk, bm25)`` of every chunk that shares a term
    with the question, from a ``term_table``.

    Only the question terms are joined to the index. Term weights are rounded
    to 9 decimals and summed as whole billionths, so that sums do not depend on
    the engine or the summation order; a sum is rounded half up to 6 decimals.

    The question terms and their frequencies are written, so their size is
    known and they are broadcast while they are small. The postings of the
    question terms are weighed once and partitioned by chunk before they meet
    the questions: the shuffle carries postings, not pairs of question and
    chunk, and the sums per pair need none of their own. The frequencies tell
    how many pairs there will be: a task sums about ``TASK_PAIRS`` of them."""
    stats = term_stats(table).scalar()
    n, avgdl = stats.getField("n"), stats.getField("avgdl")
    asked = materialize(question_terms(questions))
    df = materialize(table.join(asked.select("term").distinct(), "term", "left_semi")
                     .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = F.round(term_weight(idf, F.col("tf"), F.col("dl"), avgdl, k1, b), 9).cast("decimal(18,9)")
    own = table.join(df, "term").select("file", "chunk", "term", (w * 1_000_000_000).cast("long").alias("w"))
    pairs = asked.join(df, "term").agg(F.sum("df")).first()[0]
    return (own.repartition(parts_of(table.sparkSession, pairs, TASK_PAIRS), "file", "chunk").join(asked, "term").groupBy("query_id", "file", "chunk")
            .agg(F.expr("(sum(w) + 500) DIV 1000 / 1e6D").alias("bm25")))


def score_chunks(questions: DataFrame, chunks: DataFrame | None, text: str = "text",
                 k1: float = K1, b: float = B, table: DataFrame | None = None) -> DataFrame:
    """``(query_id, file, chunk, bm25, score)`` for every chunk sharing a
    term with the question (the reference scores every chunk); ``score`` is
    BM25 scaled to 0-10 by the best chunk of that question. ``table`` is a
    prebuilt ``term_table``.

    The best score is a grouped max, one row per question, broadcast back to
    the pairs: they are never shuffled, however many chunks a question pairs
    with, and both uses read one shuffle of postings."""
    s = bm25(questions, table if table is not None else term_table(chunks, text), k1, b)
    best = s.groupBy("query_id").agg(F.max("bm25").alias("__best"))
    return s.join(F.broadcast(best), "query_id").select("query_id", "file", "chunk", "bm25", _scale("__best"))


def _scale(best: str):
    return F.round(F.try_divide(F.col("bm25") * 10, F.col(best)), 6).alias("score")


def best_chunks(questions: DataFrame, chunks: DataFrame | None, k: int = TOP_K, text: str = "text",
                k1: float = K1, b: float = B, table: DataFrame | None = None) -> DataFrame:
    """T2 and T4 in one: ``(query_id, file, chunk, bm25, score, rank)`` of the
    ``k`` best chunks per question by (rounded) BM25, then file and chunk.

    Pairs are partitioned by (question, chunk), so the limit is applied
    in every task before anything is shuffled by question, and only
    the kept rows are scaled to 0-10. ``table`` as in ``score_chunks``."""
    return scaled_top(bm25(questions, table if table is not None else term_table(chunks, text), k1, b), k)


def scaled_top(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows per question by BM25, then file and chunk, scaled."""
    order = Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), "file", "chunk")
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return (top.withColumn("__best", F.max("bm25").over(Window.partitionBy("query_id")))
            .select("query_id", "file", "chunk", "bm25", _scale("__best"), "rank"))


def top_chunks(scored: DataFrame, k: int = TOP_K, buckets: int | None = None) -> DataFrame:
    """T4: the k best chunks per question (score desc, then file, chunk).

    Two phases, exact because the order is total: every task keeps the k best
    of its rows per question where they are (``WindowGroupLimit``), and only
    these are shuffled by question. With ``buckets`` the rows are first spread
    by (question, hash bucket of the chunk), for a table that is partitioned by
    question already, so that a hot question is not one task's."""
    if buckets is not None:
        scored = scored.repartition("query_id", F.pmod(F.xxhash64("file", "chunk"), F.lit(buckets)))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "file", "chunk")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def relevant_only(top: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """T5: keep ``score >= min_score``; applied after the top-k cut."""
    return top.filter(F.col("score") >= min_score)


def build_context(questions: DataFrame, kept: DataFrame) -> DataFrame:
    """Header plus one ``Related report:`` line per kept chunk in rank
    order; a question without hits gets the header only."""
    lines = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "answer"))).alias("__l"))
    j = questions.select("query_id").join(lines, "query_id", "left")
    body = F.transform(F.coalesce("__l", F.array().cast("array<struct<rank:int,answer:string>>")),
                       lambda x: F.concat(F.lit(CONTEXT_LINE), x["answer"]))
    return j.select("query_id", F.array_join(F.concat(F.array(F.lit(CONTEXT_HEADER)), body), "\n")
                    .alias("context"))


def truncate_context(df: DataFrame, col: str = "context", limit: int = CONTEXT_LIMIT,
                     keep: int = CONTEXT_KEEP) -> DataFrame:
    """Longer than ``limit`` characters -> first ``keep`` characters."""
    c = F.col(col)
    return df.withColumn(col, F.when(F.length(c) > limit, F.substring(c, 1, keep)).otherwise(c))


def clip_output(df: DataFrame, col: str, n: int = CLIP) -> DataFrame:
    """First ``n`` characters followed by ``...`` (always)."""
    return df.withColumn(col, F.concat(F.substring(F.col(col), 1, n), F.lit("...")))


def parse_scored_reply(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Parse ``Score: <n>, Reason: <r>, Anser: <a>``.

    Only the text between the first and a second ``Score:`` is read; it must
    split on commas into three parts (a comma in the reason moves the rest
    into the answer); the score must be a plain decimal number; reason is
    stripped, answer is not. Unparseable replies are dropped."""
    seg = strip_ws(F.try_element_at(F.split(F.col(reply), "Score:"), F.lit(2)))
    parts = F.split(seg, ",", 3)
    raw = strip_ws(F.try_element_at(parts, F.lit(1)))
    num = F.when(raw.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.expr("try_cast(__raw AS double)"))
    out = (replies.withColumn("__parts", parts).withColumn("__raw", raw)
           .filter(F.col(reply).contains("Score:") & (F.size("__parts") == 3))
           .withColumn("score", num)
           .filter(F.col("score").isNotNull())
           .withColumn("reason", strip_ws(F.col("__parts")[1]))
           .withColumn("answer", F.col("__parts")[2]))
    return out.drop("__parts", "__raw")


def answers(questions: DataFrame, top: DataFrame, chunks: DataFrame, text: str = "text") -> DataFrame:
    """``top`` with ``reason`` and ``answer`` as T3 leaves them, an offline
    stand-in for the scoring model's answer: the chunk's sentence with the
    most distinct question terms (ties: the first), looked for in the whole
    chunk. Only kept rows meet their texts; they are written first, so their
    size is known and the texts are not shuffled to them. A chunk without a
    sentence answers with nothing; the reason states the BM25 value."""
    top = materialize(top)
    j = (top.join(chunks.select("file", "chunk", F.col(text).alias("__t")), ["file", "chunk"])
         .join(questions.select("query_id", F.array_distinct(terms("text")).alias("__qt")), "query_id"))
    sentences = F.filter(F.transform(F.regexp_extract_all("__t", F.lit(SENTENCE), 0), strip_ws), lambda x: x != "")
    rated = F.transform(sentences, lambda x, i: F.struct(
        F.size(F.array_intersect(terms(x), F.col("__qt"))).alias("hits"), (-i).alias("pos"), x.alias("sentence")))
    best = F.coalesce(F.array_max(rated)["sentence"], F.lit(""))
    return j.select(*top.columns,
                    F.concat(F.lit("Reason: bm25 "), F.col("bm25").cast("decimal(18,6)").cast("string")).alias("reason"),
                    F.concat(F.lit(" Anser: "), best).alias("answer"))


# T8 prompt templates. Only the reply format of "score" is fixed (T3 parses it).
PROMPTS = {
    "annotate": "Text:\n{chunk}\n\nWrite a heading for it, name its subjects and search terms, and retell it in a paragraph.",
    "score": ("Question: {question}\n\nChunk summary:\n{chunk}\n\nRate the relevance of the chunk to the "
              "question from 0 to 10 and answer in the form: Score: <number>, Reason: <short reason>, "
              "Anser: <answer>"),
    "summarize": ("Someone asked: {question}\n\nNotes:\n{context}\n\nUsing the notes alone, state what they "
                  "show about it and close with one sentence."),
    "graph": ("Notes:\n{context}\n\nTurn the notes into a JSON object with the lists nodes (id, label) and "
              "edges (from, to, type). Reply with the object and nothing else."),
}


def _render(template: str, **cols):
    """``str.format``-style template -> ``concat`` of literals and columns
    (``{{`` / ``}}`` are literal braces)."""
    parts, lit, i = [], [], 0
    while i < len(template):
        ch = template[i]
        if ch in "{}" and template[i:i + 2] in ("{{", "}}"):
            lit.append(ch)
            i += 2
        elif ch == "{":
            j = template.index("}", i)
            parts += [F.lit("".join(lit)), F.coalesce(cols[template[i + 1:j]], F.lit(""))]
            lit, i = [], j + 1
        else:
            lit.append(ch)
            i += 1
    parts.append(F.lit("".join(lit)))
    return F.concat(*parts)


def build_prompts(questions: DataFrame, top: DataFrame, contexts: DataFrame, chunks: DataFrame,
                  text: str = "text") -> DataFrame:
    """Prompts for offline batch inference as ``(kind, query_id, file,
    chunk, prompt)``: one annotation prompt per chunk, one scoring prompt per
    (question, top chunk), one summary and one graph prompt per question."""
    a = chunks.select(F.lit("annotate").alias("kind"), F.lit(None).cast("bigint").alias("query_id"),
                      "file", "chunk", _render(PROMPTS["annotate"], chunk=F.col(text)).alias("prompt"))
    s = (materialize(top).join(chunks.select("file", "chunk", F.col(text).alias("__c")), ["file", "chunk"])
         .join(questions.select("query_id", F.col("text").alias("__q")), "query_id")
         .select(F.lit("score").alias("kind"), "query_id", "file", "chunk",
                 _render(PROMPTS["score"], question=F.col("__q"), chunk=F.col("__c")).alias("prompt")))
    qc = contexts.join(questions.select("query_id", F.col("text").alias("__q")), "query_id")
    m = qc.select(F.lit("summarize").alias("kind"), "query_id", F.lit(None).cast("string").alias("file"),
                  F.lit(None).cast("int").alias("chunk"),
                  _render(PROMPTS["summarize"], question=F.col("__q"), context=F.col("context")).alias("prompt"))
    g = qc.select(F.lit("graph").alias("kind"), "query_id", F.lit(None).cast("string").alias("file"),
                  F.lit(None).cast("int").alias("chunk"),
                  _render(PROMPTS["graph"], context=F.col("context")).alias("prompt"))
    return a.unionByName(s).unionByName(m).unionByName(g)


def summarize_context(questions: DataFrame, top: DataFrame, chunks: DataFrame, n: int = 3,
                      text: str = "text") -> DataFrame:
    """Extractive answer summary per question: sentences of the question's
    top chunks, scored by the number of distinct question terms they contain,
    best ``n`` (ties: rank, file, chunk, sentence position) re-joined in
    reading order. Questions without hits get an empty summary."""
    src = materialize(top.select("query_id", "file", "chunk", "rank")).join(
        chunks.select("file", "chunk", F.col(text).alias("__t")), ["file", "chunk"])
    sent = src.select("query_id", "rank", "file", "chunk",
                      F.posexplode(F.regexp_extract_all("__t", F.lit(SENTENCE), 0)).alias("__p", "__s")) \
        .select("query_id", "rank", "file", "chunk", (F.col("__p") + 1).alias("sent_no"),
                strip_ws("__s").alias("sentence")).filter(F.col("sentence") != "")
    qterms = questions.select("query_id", F.array_distinct(terms("text")).alias("__qt"))
    scored = sent.join(qterms, "query_id").withColumn(
        "overlap", F.size(F.array_intersect(F.array_distinct(terms("sentence")), F.col("__qt"))))
    w = Window.partitionBy("query_id").orderBy(F.col("overlap").desc(), "rank", "file", "chunk", "sent_no")
    best = scored.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    agg = best.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "file", "chunk", "sent_no", "sentence"))),
        lambda x: x["sentence"]), " ").alias("summary"))
    return questions.select("query_id").join(agg, "query_id", "left").fillna({"summary": ""})


def diverse_summary(questions: DataFrame, top: DataFrame, chunks: DataFrame, n: int = 3, weight: float = 0.5,
                    text: str = "text") -> DataFrame:
    """T9 without repetition: ``(query_id, summary)`` by maximal marginal
    relevance. Of the sentences of a question's chunks, one at a time is
    taken: the one with the largest ``weight * relevance - (1 - weight) *
    similarity`` (ties: rank, file, chunk, sentence position), where relevance is
    the share of the question's terms in the sentence and similarity the
    largest Jaccard similarity of terms with a taken one. A sentence with the
    text or all the terms of a taken one is never taken, so copies in several
    chunks appear once. The ``n`` sentences are joined in reading order.

    All steps are windows over one partitioning by question; a question has
    the sentences of its kept chunks only."""
    src = top.select("query_id", "file", "chunk", "rank").join(
        chunks.select("file", "chunk", F.col(text).alias("__t")), ["file", "chunk"])
    sent = src.select("query_id", "rank", "file", "chunk",
                      F.posexplode(F.regexp_extract_all("__t", F.lit(SENTENCE), 0)).alias("sent_no", "__s")) \
        .withColumn("sentence", strip_ws("__s")).filter(F.col("sentence") != "")
    asked = questions.select("query_id", F.array_distinct(terms("text")).alias("asked"))
    own = F.array_distinct(terms("sentence"))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("own", "asked")), F.size("asked")), F.lit(0.0))
    state = (sent.join(asked, "query_id").withColumn("own", own).withColumn("relevance", share)
             .withColumn("similar", F.lit(0.0)).withColumn("taken", F.lit(False))
             .select("query_id", "rank", "file", "chunk", "sent_no", "sentence", "own", "relevance", "similar", "taken"))
    place = ["rank", "file", "chunk", "sent_no"]
    whole = Window.partitionBy("query_id")
    for _ in range(n):
        value = F.round(weight * F.col("relevance") - (1 - weight) * F.col("similar"), 9)
        free = ~F.col("taken") & (F.col("similar") < 1.0)
        best = F.min(F.when(free, F.struct((-value).alias("v"), *place, "sentence", "own"))).over(whole)
        state = state.withColumn("best", best)
        same = F.lit(True)
        for c in place:
            same = same & (F.col(c) == F.col(f"best.{c}"))
        jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect("own", "best.own")), F.size(F.array_union("own", "best.own"))), F.lit(0.0))
        state = state.withColumn("taken", F.col("taken") | F.coalesce(same, F.lit(False))).withColumn("similar", F.greatest(
            "similar", F.when(F.col("best").isNull(), 0.0).when(F.col("sentence") == F.col("best.sentence"), 1.0).otherwise(jaccard)))
    taken = state.filter("taken").groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(*place, "sentence"))), lambda x: x["sentence"]), " ").alias("summary"))
    return questions.select("query_id").join(taken, "query_id", "left").fillna({"summary": ""})
