"""Sinks (S09-S13).  Every writer is a distributed ``df.write``: output is a
directory of part files (no single-writer JSON array, no driver collect)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, UTF-8, doubled-quote escaping, no index column; cells
    as they are (the writer would trim them by default)."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
       .option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_triplets(df: DataFrame, path: str, fmt: str = "jsonl", mode: str = "overwrite") -> None:
    """Triplets as JSON Lines (HF ``to_json`` default; each file gzipped, which
    Spark's and pandas' readers undo by its name) or Parquet.  A
    pretty JSON array needs a single writer and is not offered."""
    if fmt == "jsonl":
        df.write.mode(mode).option("compression", "gzip").json(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError("fmt must be 'jsonl' or 'parquet'")


def metrics_json(scores: DataFrame, by: str = "direction", overall_label: str = "overall",
                 metrics=("bleu", "chrf")) -> DataFrame:
    """S11 (shape): rollup rows (by, n, metrics...) -> one row holding the
    nested document {overall_<m>..., per_direction: {dir: {m..., n}}}."""
    per = F.map_from_entries(F.collect_list(F.when(
        F.col(by) != overall_label,
        F.struct(F.col(by), F.struct(*[F.col(m) for m in metrics], F.col("n"))))))
    overall = [F.max(F.when(F.col(by) == overall_label, F.col(m))).alias(f"overall_{m}")
               for m in metrics]
    doc = scores.agg(*overall, per.alias("per_direction"))
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("json"))


def write_metrics(scores: DataFrame, path: str, mode: str = "overwrite", **kw) -> None:
    """Nested metrics JSON (one small document)."""
    metrics_json(scores, **kw).write.mode(mode).text(path)


def write_funnel(funnel: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """The cleaning report (step, dropped, remaining[, dropped_pct])."""
    w = funnel.orderBy("step_no").coalesce(1).write.mode(mode)
    if fmt == "json":
        w.json(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        raise ValueError("fmt must be 'json' or 'csv'")


def write_split(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """Held-out sets as Parquet partitioned by split (train/val/test
    directories; readers prune to the split they need)."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)
