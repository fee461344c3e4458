"""Readers (S01-S08).

CSV and JSON Lines readers declare their schema (names come from the first
line, no inference pass); a JSON array is inferred, one task a file.
Line-numbered reads (S06, S08) order lines by the place of their split in the
file, the only key those formats have.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitextkit.sources.csv_blocks import csv_records, without_headers

# The strings pandas' CSV reader treats as missing by default.
PANDAS_DEFAULT_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                     "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                     "nan", "null"]

EXTRA = "_extra_field"


def _csv_reader(spark: SparkSession, multi_line: bool):
    # a cell can hold any string but this one, so that a blank cell stays ""
    return (spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"')
            .option("escape", '"').option("encoding", "UTF-8").option("nullValue", "\x00\x01")
            .option("emptyValue", ""))


def read_parallel_csv(spark: SparkSession, path: str, src: str = "src", tgt: str = "tgt",
                      tolerant: bool = True, na_values=PANDAS_DEFAULT_NA,
                      multi_line: bool | str = True) -> DataFrame:
    """CSV with header (UTF-8, doubled quotes), columns by name.

    The header's names are read first (one line); ``src`` and ``tgt`` must be
    among them, in any place beside any other columns.  A column after the
    header's own catches what stands beyond them.
    tolerant=True: a row with too many fields is skipped; a row with too few is
    kept with NULLs (pandas ``on_bad_lines='skip'``).
    tolerant=False: FAILFAST (stricter than pandas: short rows fail too).
    ``na_values`` cells become NULL, as in pandas.  ``multi_line`` allows line
    breaks inside quotes and makes a file one task; ``multi_line="split"`` allows
    them too, and large files are split (tolerant only); without it they are split
    and every line is a record."""
    if multi_line == "split" and not tolerant:
        raise ValueError("the strict reader takes a file as one task: multi_line=True")
    names = _csv_reader(spark, False).csv(path).columns
    missing = [c for c in (src, tgt) if c not in names]
    if missing:
        raise ValueError(f"missing columns {missing}; found {names}")
    fields = [T.StructField(c, T.StringType(), True) for c in names]
    if multi_line == "split":
        schema = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in [*fields, T.StructField(EXTRA, T.StringType())])
        df = without_headers(csv_records(spark, path)).select(F.from_csv(
            "record", schema, {"quote": '"', "escape": '"', "nullValue": "\x00\x01", "emptyValue": "", "mode": "PERMISSIVE"}
            ).alias("_r")).select("_r.*").filter(F.col(EXTRA).isNull())
    elif tolerant:
        reader = _csv_reader(spark, multi_line)
        df = reader.schema(T.StructType([*fields, T.StructField(EXTRA, T.StringType(), True)])).option(
            "mode", "PERMISSIVE").csv(path).filter(F.col(EXTRA).isNull())
    else:
        df = _csv_reader(spark, multi_line).schema(T.StructType(fields)).option("mode", "FAILFAST").csv(path)
    df = df.select(src, tgt)
    if na_values:
        na = list(na_values)
        df = df.select(*[F.when(F.col(c).isin(na), F.lit(None).cast("string")).otherwise(F.col(c))
                         .alias(c) for c in (src, tgt)])
    return df


def with_row_ids(df: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """Ids that grow in scan order (the reference relies on list order for
    'first wins' dedup); unique, and dense within a partition."""
    return df.select(F.monotonically_increasing_id().alias(id_col), *df.columns)


def numbered_lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """(line_no, name): lines of one text file, numbered from 0 in file order.
    A split knows its place in the file; the lines before it are counted."""
    from bitextkit.operators.ranking import bounded_broadcast
    lines = spark.read.text(path).select(
        F.col("value").alias(name), F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    splits = lines.groupBy("_f", "_b").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_f", "_b")) - F.col("_n")     # one row a split
    splits = splits.select("_f", "_b", "_first", before.alias("_before"))
    return lines.join(bounded_broadcast(splits), ["_f", "_b"]).select(
        (F.col("_before") + F.col("_i") - F.col("_first")).alias("line_no"), name)


def csv_quality(spark: SparkSession, path: str, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """raw_lines (physical lines minus one header a file), parsed rows, and
    malformed = raw_lines - parsed (a quoted multi-line cell counts as extra
    physical lines, as in the reference).  Files may be many and are split."""
    files = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("_f")).agg((F.count(F.lit(1)) - 1).alias("n"))
    raw = files.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("raw_lines"))
    parsed = read_parallel_csv(spark, path, src, tgt, multi_line="split").agg(
        F.count(F.lit(1)).cast("long").alias("parsed"))
    one = F.lit(1)
    return (raw.withColumn("_k", one).join(parsed.withColumn("_k", one), "_k").drop("_k")
            .withColumn("malformed", F.col("raw_lines") - F.col("parsed")))


def load_parallel(spark: SparkSession, path: str, src_col: str = "source",
                  tgt_col: str = "target") -> DataFrame:
    """Dispatch on the file extension, rename to (source, target), check
    that both columns exist."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".csv":
        df = spark.read.option("header", True).option("multiLine", True).option(
            "escape", '"').csv(path)
    elif ext == ".jsonl":
        first = spark.read.text(path).filter(F.trim("value") != "").select(
            F.json_object_keys("value").alias("k")).first()
        names = list(first["k"] or []) if first else [src_col, tgt_col]
        df = spark.read.schema(T.StructType([T.StructField(c, T.StringType(), True) for c in names])).json(path)
    elif ext == ".json":
        df = spark.read.option("multiLine", True).json(path)
    elif ext == ".parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported file type {ext!r}: use .csv, .json, .jsonl or .parquet")
    missing = [c for c in (src_col, tgt_col) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df.withColumnsRenamed({src_col: "source", tgt_col: "target"}) if (
        src_col, tgt_col) != ("source", "target") else df


TRIPLET_SCHEMA = T.StructType([T.StructField("source", T.StringType(), True),
                               T.StructField("preferred", T.StringType(), True),
                               T.StructField("unpreferred", T.StringType(), True),
                               T.StructField("direction", T.StringType(), True)])
TEST_SET_SCHEMA = T.StructType([T.StructField("source", T.StringType(), True),
                                T.StructField("target", T.StringType(), True),
                                T.StructField("direction", T.StringType(), True)])


def read_triplets(spark: SparkSession, path: str, schema: T.StructType = TRIPLET_SCHEMA) -> DataFrame:
    """A pretty-printed JSON array (or JSON Lines) of records.  A JSON
    array is one task per file; convert it once to JSONL/Parquet for scale."""
    multi = not path.rstrip("/").endswith(".jsonl")
    return spark.read.schema(schema).option("multiLine", multi).json(path)


def read_line_pairs(spark: SparkSession, preds_path: str, refs_path: str,
                    check: bool = True) -> DataFrame:
    """Line i of the predictions file with line i of the references
    file, each stripped.  ``check`` fails on a line-count mismatch (the
    reference's zip would silently truncate)."""
    from bitextkit.functions.text import strip_ws
    sides = [numbered_lines(spark, path, name).withColumn(name, strip_ws(name))
             for path, name in ((preds_path, "prediction"), (refs_path, "reference"))]
    j = sides[0].join(sides[1], "line_no", "full_outer")
    if check:       # lines are numbered 0, 1, 2, ... on both sides: as many lines are the same numbers
        if spark.read.text(preds_path).count() != spark.read.text(refs_path).count():
            raise ValueError("predictions and references have different line counts")
    return j


LEDGER_CONFIG = T.StructType([T.StructField(n, t, True) for n, t in [
    ("learning_rate", T.DoubleType()), ("dpo_beta", T.DoubleType()), ("max_steps", T.LongType()),
    ("n_train", T.LongType()), ("batch_size", T.LongType()), ("grad_accum", T.LongType()),
    ("max_source_length", T.LongType()), ("max_length", T.LongType())]])
LEDGER_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in [
    ("iter", T.LongType()), ("track", T.StringType()), ("change", T.StringType()),
    ("bleu", T.DoubleType()), ("metric", T.StringType()), ("value", T.DoubleType()),
    ("keep", T.BooleanType()), ("status", T.StringType()), ("note", T.StringType()),
    ("run_url", T.StringType()), ("train_run", T.StringType()), ("eval_run", T.StringType()),
    ("benchmark", T.StringType()), ("config", LEDGER_CONFIG)]])


def read_ledger(spark: SparkSession, path: str, default_track: str = "main") -> DataFrame:
    """JSON Lines ledger whose keys drift between rows; one superset
    schema, ``score`` = coalesce(value, bleu), missing track -> default."""
    df = spark.read.schema(LEDGER_SCHEMA).json(path)
    return df.withColumn("score", F.coalesce("value", "bleu")).withColumn(
        "track", F.coalesce(F.col("track"), F.lit(default_track)))


def scrape_metric(spark: SparkSession, log_path: str, key: str = "FINAL_BLEU") -> DataFrame:
    """S08 + L05: the last ``KEY=<number>`` in the log(s), one row (NULL if none)."""
    import re
    pat = re.escape(key) + r"=([0-9]+(\.[0-9]+)?)"
    lines = spark.read.text(log_path).select(
        F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_line"),
        F.regexp_extract_all("value", F.lit(pat), 1).alias("_hits"))
    hits = lines.filter(F.size("_hits") > 0).select(
        "_file", "_line", F.element_at("_hits", -1).cast("double").alias("v"))
    return hits.agg(F.max_by("v", F.struct("_file", "_line")).alias(key.lower()),
                    F.count(F.lit(1)).cast("long").alias("occurrences"))


def scrape_metric_value(spark: SparkSession, log_path: str, key: str = "FINAL_BLEU") -> float:
    """S08 as a scalar: raises when the key never appears (the reference exits 1)."""
    row = scrape_metric(spark, log_path, key).first()
    if row is None or row[0] is None:
        raise ValueError(f"could not parse {key} from {log_path}")
    return float(row[0])
