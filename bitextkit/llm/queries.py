"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextkit.llm import (
    collocations, decontaminate, license_scan, line_dedup, lm_scores, near_dedup, packing, periodic_runs, quality_rules,
    secret_scan, token_counts, toxicity, vector_search)
from bitextkit.llm.common import documents
from bitextkit.session import read_table


def op1_lm_scores(spark, sf_dir):
    return lm_scores.lm_scores(documents(spark, sf_dir))


def op2_secret_scan(spark, sf_dir):
    return secret_scan.secret_report(documents(spark, sf_dir))


def op3_decontamination(spark, sf_dir):
    found = decontaminate.contaminated(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return found.drop("th")


def op4_quality_rules(spark, sf_dir):
    return quality_rules.quality_report(documents(spark, sf_dir))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op6_minhash_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.line_report(documents(spark, sf_dir))


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir))


def op9_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


def op10_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.run_report(documents(spark, sf_dir))


def op12_nearest_neighbours(spark, sf_dir):
    return vector_search.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op13_collocations(spark, sf_dir):
    return collocations.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_lm_scores, op2_secret_scan, op3_decontamination, op4_quality_rules, op5_toxicity, op6_minhash_dedup, op7_line_dedup,
    op8_token_counts, op9_packing, op10_license_scan, op11_periodic_runs, op12_nearest_neighbours, op13_collocations)}
