"""Corpus pipeline: quality rules -> near duplicates -> personal data ->
mixing -> packing. Every stage but the last returns the columns of
``documents``; its result is written as Parquet and reread by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join, packing, pii, quality_rules
from tessera.llm.text import free_name
from tessera.session import materialize, scratch_path


def rules_stage(spark, docs, sf_dir):
    """Documents that the quality rules keep (operator 10), judged where they
    are read. NULL and blank texts fail the base rules; an empty table stays
    empty; repeated rows share a verdict."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return quality_rules.kept_documents(docs, trusted)


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each group of near duplicates (operator 3): its
    smallest id, then text hash. A document is its id with its text: of rows
    equal in both one stays (the smallest hash of the whole row), unrelated
    texts under one id all stay. Texts without words and rows without an id
    are in no group and stay. An empty table stays empty."""
    tag = free_name(docs, "text_hash")
    keep = materialize(ngram_join.class_heads(docs)).withColumnRenamed("text_hash", tag)
    named = docs.withColumn(tag, F.xxhash64("text"))
    out = named.join(keep.filter("copies = 1"), ["doc_id", tag], "left_semi").select(*docs.columns)
    repeated = keep.filter("copies > 1")
    if not repeated.isEmpty():
        row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")
        out = out.unionByName(named.join(repeated, ["doc_id", tag], "left_semi").groupBy("doc_id", tag).agg(row).select("row.*"))
    return out.unionByName(docs.filter(F.col("doc_id").isNull()))


def pseudonym_stage(spark, docs, sf_dir):
    """Personal data replaced by pseudonyms (operator 1); ``n_chars`` stays
    right because pseudonyms keep their length or are recounted."""
    out = pii.pseudonymise(docs).drop("pii_found")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def mixing_stage(spark, docs, sf_dir):
    """The mix itself (operator 8): every row as often as the mix takes it,
    in part where a target ends. NULL and blank texts have no words and are
    not taken; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def packing_stage(spark, docs, sf_dir):
    """Where each document's words go (operator 6). Rows without words have
    no piece; repeated rows are packed each; an empty table gives no rows."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", rules_stage),
    ("near duplicates", near_duplicate_stage),
    ("pseudonyms", pseudonym_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # SQL expresses neither the near duplicates nor the packing; tests compare with brute force


def run(spark, sf_dir):
    """All stages in order over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
