"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

A text becomes hashed term counts in three blocks (trigrams of character
classes over all bytes, words, immediate word repeats), square-root scaled,
weighted by inverse document frequency and projected on the leading singular
vectors of a labelled sample. A document's score is the similarity-weighted
mean label of its nearest labelled vectors; all cosines against the sample
are computed exactly, block by block. Equal similarities at the border all
vote, so the score does not depend on any order.

The fit uses at most ``FIT_ROWS`` labelled rows (smallest hash of the id), so
the broadcast vectors are bounded: ``FIT_ROWS * DIMENSIONS`` floats. Scoring
reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import byte_words
from tessera.session import ship_package

FIT_ROWS = 4000
DIMENSIONS = 64
NEIGHBOURS = 25
SHARPNESS = 8
BLOCK = 256
_CLASSES = 12
_WORD_BINS = 512
_REPEAT_BINS = 2
TERMS = _CLASSES ** 3 + _WORD_BINS + _REPEAT_BINS


def _class_table() -> np.ndarray:
    t = np.full(256, 11, dtype=np.int16)
    for k, chars in enumerate([b" \t\x0b\x0c\r", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                               b"0123456789", b"#*$%&", b"|<>", b".?", b"!", b",;:'\"()-"]):
        t[list(chars)] = k
    t[128:] = 10
    return t


CLASS_OF = _class_table()


def term_counts(text: str | None) -> np.ndarray:
    """Weighted term vector of a text before the document-frequency weights;
    all zero for a text without words."""
    v = np.zeros(TERMS, dtype=np.float32)
    ws = byte_words(text)
    if not ws:
        return v
    c = CLASS_OF[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    n3 = _CLASSES ** 3
    if len(c) > 2:
        v[:n3] = np.bincount(c[:-2] * (_CLASSES * _CLASSES) + c[1:-1] * _CLASSES + c[2:], minlength=n3)
        v[:n3] = np.sqrt(v[:n3] / (len(c) - 2))
    h = np.fromiter(map(zlib.crc32, ws), dtype=np.uint32, count=len(ws))
    v[n3:n3 + _WORD_BINS] = 0.5 * np.sqrt(np.bincount(h & (_WORD_BINS - 1), minlength=_WORD_BINS) / len(ws))
    repeats = float((h[1:] == h[:-1]).sum()) / max(1, len(ws) - 1)
    v[-2:] = np.sqrt(repeats), np.sqrt(1.0 - repeats)
    return v


class Model:
    """Projection, labelled vectors and labels; small enough to broadcast."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        df = (counts > 0).sum(axis=0)
        self.idf = np.log((1.0 + len(counts)) / (1.0 + df)).astype(np.float32) + 1.0
        weighted = counts * self.idf
        _, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32))
        self.vectors = self.project(counts) if len(counts) else np.zeros((0, DIMENSIONS), np.float32)

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = (counts * self.idf) @ self.axes
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(norm > 0, norm, 1)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Vote for a block of rows; rows without terms get the prior."""
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        sims = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, sims.shape[1])
        border = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
        weight = np.where(sims >= border[:, None], np.clip(sims, 0, None) ** SHARPNESS, 0).astype(np.float64)
        total = weight.sum(axis=1)
        vote = (weight @ self.labels.astype(np.float64)) / np.where(total > 0, total, 1)
        return np.where((total > 0) & counts.any(axis=1), vote, self.prior)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled rows outside the held-out fold, at most ``rows``."""
    usable = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def vectors(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "quality": f["quality"],
                                "counts": [term_counts(t).tobytes() for t in f["text"]]})

    got = sample.mapInPandas(vectors, "doc_id long, quality int, counts binary").orderBy("doc_id", "counts").collect()
    counts = np.array([np.frombuffer(r["counts"], dtype=np.float32) for r in got]).reshape(-1, TERMS)
    return Model(counts, np.array([r["quality"] for r in got], dtype=np.float32))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``
    (needs ``doc_id, text``; other columns are ignored). NULL and word-less
    texts score the label mean; NULL ids are scored, not held out; repeated
    rows score alike; without usable labels every score is 0.5; an empty
    table gives no rows."""
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    def score(frames):
        for f in frames:
            out = np.empty(len(f))
            texts = f["text"].tolist()
            for at in range(0, len(texts), BLOCK):
                counts = np.array([term_counts(t) for t in texts[at:at + BLOCK]])
                out[at:at + BLOCK] = model.value.score(counts)
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "score": np.round(out, 6)})

    rows_in = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = rows_in.mapInPandas(score, "doc_id string, held_out boolean, score double")
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))
