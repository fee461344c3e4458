"""Cleaning on Structured Streaming.

The reference has no streaming operator; what carries over is that
normalisation (P01) and the content filters (F01-F06) are stateless, so the
same column expressions run on a streaming DataFrame.  Exact "keep the first
occurrence" dedup (W01) needs unbounded state on an unbounded stream; it is
offered only with an event-time watermark (state expires), and the batch
funnel remains the reference-equivalent path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextkit.operators.clean import normalize_pairs, post_dedup_fail, pre_dedup_fail


def label_stream(df: DataFrame, src: str = "src", tgt: str = "tgt", min_chars: int = 2,
                 max_len_ratio: float = 2.5, max_latin: float = 0.25) -> DataFrame:
    """Normalise and attach the first failing content check (no dedup)."""
    n = normalize_pairs(df, src, tgt)
    s, t = F.col(src), F.col(tgt)
    return n.withColumn("first_fail", F.coalesce(pre_dedup_fail(s, t, min_chars),
                                                 post_dedup_fail(s, t, max_len_ratio, max_latin)))


def clean_stream(df: DataFrame, **kw) -> DataFrame:
    """Rows that pass every stateless check."""
    return label_stream(df, **kw).filter(F.col("first_fail").isNull()).drop("first_fail")


def funnel_counts_stream(df: DataFrame, **kw) -> DataFrame:
    """Running drop counts per content check (state = one row per step, so
    ``complete`` output mode is bounded)."""
    lab = label_stream(df, **kw).withColumn(
        "step", F.coalesce(F.col("first_fail"), F.lit("kept")))
    return lab.groupBy("step").agg(F.count(F.lit(1)).alias("rows"))


def dedup_stream(df: DataFrame, event_time: str, delay: str = "1 hour",
                 keys=("src", "tgt")) -> DataFrame:
    """Streaming exact dedup with bounded state: duplicates arriving within
    the watermark delay are dropped (Spark's dropDuplicatesWithinWatermark)."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


__all__ = ["label_stream", "clean_stream", "funnel_counts_stream", "dedup_stream"]
