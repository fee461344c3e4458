"""The corpus pipeline: five stages, each one of the operators of ``bitextkit.llm``.

Every stage works on all documents that its predecessor kept; all but the last
return the columns of ``documents``.  ``n_chars`` follows the text when line
dedup shortens it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextkit.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from bitextkit.llm.common import cut, documents
from bitextkit.session import read_table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the plain rules or the outlier test reject go."""
    return quality_rules.filter_quality(docs)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: recurring lines go from the texts; every document stays."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of every group of near-duplicates the least id stays."""
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that re-use a benchmark item go."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of the kept documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", reject_low_quality),
    ("line dedup", drop_recurring_lines),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack_documents),
]

# The stages use robust estimates, 64-bit hashes and a tokenizer that SQL cannot
# express; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written as
    Parquet in the shared checkpoint folder and read again for the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
