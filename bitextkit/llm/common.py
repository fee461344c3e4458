"""Helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextkit.session import read_table, scratch_path

UPPER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_AZ = UPPER_AZ.lower()
WS_RUN = "[\\x20\\x09-\\x0D]+"          # ASCII white space


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_of(col: str = "text") -> Column:
    """The text with null read as the empty string."""
    return F.coalesce(F.col(col), F.lit(""))


def lower_az(col: Column) -> Column:
    """Lower-case the letters A-Z only."""
    return F.translate(col, UPPER_AZ, LOWER_AZ)


def ws_words(col: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order (empty array for an empty text)."""
    return F.array_remove(F.split(col, WS_RUN), "")


def id_bucket(mod: int, col: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def packed(docs: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """(_row, doc_id, text, more): every column of ``docs`` inside one struct,
    so that no name of theirs can clash; ``select("_row.*")`` brings them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       *[c.alias(k) for k, c in more.items()])


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read
    it back: the lineage ends at files every executor can see, so a lost
    executor costs a re-read and not a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_cache(key, build):
    """An object built once per Python worker process and kept between its
    tasks (vocabularies, automata); ``build()`` must depend on ``key`` alone."""
    store = sys.__dict__.setdefault("_llm_worker_cache", {})
    if key not in store:
        store[key] = build()
    return store[key]


#: A small side is broadcast up to this many rows (counted), else joined salted.
BROADCAST_ROWS = 20_000
SALTS = 32


def attach(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``df`` to a table with one row a key (a written table: it is counted
    first).  Up to ``BROADCAST_ROWS`` rows it is broadcast; beyond, both sides
    get a salt, so that a key with a third of all rows meets its row in
    ``SALTS`` tasks.  Keys must not be null."""
    if table.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), keys, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [*keys, "_salt"], how).drop("_salt")
