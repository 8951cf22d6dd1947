"""Registered queries of this subpackage: each applies one operator with its
production parameters to its whole table. ``oracle_sql`` has DuckDB SQL where
SQL can say the same; the other queries are tested against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import (conversation_repair, fingerprints, licenses, mixing, ngram_join, packing, periodic_runs, pii, quality_knn,
                         quality_rules, suffix_dedup, warc, window_packing)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pseudonyms(spark, sf_dir):
    out = pii.pseudonymise(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("pii_found").cast("long").alias("pii_found"))


def op2_license_scan(spark, sf_dir):
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark, sf_dir):
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_arc_to_warc(spark, sf_dir):
    return warc.archive_pages_scratch(_table(spark, sf_dir, "pages"), "op4")


def op5_knn_quality(spark, sf_dir):
    return quality_knn.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_iblt_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_versions(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark, sf_dir):
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    trusted = _table(spark, sf_dir, "labels").filter("quality = 1")
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), trusted).drop("text_hash")


def op11_conversation_repair(spark, sf_dir):
    conversations = _table(spark, sf_dir, "conversations")
    return conversation_repair.repair_conversations(conversation_repair.damage(conversations), conversations.select("conv_id"))


def op12_window_packing(spark, sf_dir):
    return window_packing.piece_digests(window_packing.pack_windows(_table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark, sf_dir):
    planted = periodic_runs.plant_periods(_table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(planted))


def queries():
    found = [op1_pseudonyms, op2_license_scan, op3_ngram_jaccard, op4_arc_to_warc, op5_knn_quality, op6_best_fit_packing,
             op7_iblt_fingerprints, op8_source_mixing, op9_substring_dedup, op10_quality_rules, op11_conversation_repair,
             op12_window_packing, op13_periodic_runs]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"op8_source_mixing": mixing.oracle()}
