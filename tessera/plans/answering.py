"""The answering job for a table of questions (the reference answers one
question at a time with one model call per chunk):

chunks -> term table -> exact top-k per question (T2, T4) -> answers of the
kept chunks -> threshold (T5) -> context (T6). Truncation (T7) and clipping
(T10) are steps of their own. Scores are never rendered as replies and parsed
back; T3 is for replies of a real model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators import postings as P
from tessera.operators import retrieval as T


def best(questions: DataFrame, chunks: DataFrame | None, k: int = T.TOP_K, table: DataFrame | None = None,
         index: P.Postings | None = None) -> DataFrame:
    """Exact top-k: from impact-ordered postings where an ``index`` is given
    (it skips the blocks that cannot matter), else by scoring every chunk that
    shares a term. Both give the same rows."""
    return P.top_k(questions, index, k) if index is not None else T.best_chunks(questions, chunks, k, table=table)


def top_candidates(questions: DataFrame, chunks: DataFrame, k: int = T.TOP_K,
                   table: DataFrame | None = None, index: P.Postings | None = None) -> DataFrame:
    """Exact top-k per question with answers: ``(query_id, file, chunk, bm25,
    score, rank, reason, answer)``."""
    return T.answers(questions, best(questions, chunks, k, table, index), chunks)


def relevant(questions: DataFrame, chunks: DataFrame, k: int = T.TOP_K, min_score: float = T.MIN_SCORE,
             table: DataFrame | None = None, index: P.Postings | None = None) -> DataFrame:
    """T5 over the top-k; chunks below the threshold are dropped before their
    texts are read."""
    return T.answers(questions, T.relevant_only(best(questions, chunks, k, table, index), min_score), chunks)


def contexts(questions: DataFrame, chunks: DataFrame, k: int = T.TOP_K, min_score: float = T.MIN_SCORE,
             table: DataFrame | None = None, index: P.Postings | None = None) -> DataFrame:
    return T.build_context(questions, relevant(questions, chunks, k, min_score, table, index))
