"""Leakage exclusion: rows whose sentence pair is held out, in either order.

A pair's key is unordered, so a held-out pair also excludes its mirror.  A Bloom
filter of the held-out keys, built by an aggregation and of a counted size, lets
all rows pass that surely are no leak; only its hits meet the exact keys.  Up to
``BROADCAST_BYTES`` of keys these are broadcast; beyond, both sides are shuffled
with a salt, as one pair may hold a third of all rows.

Defined results: NULL is a value of its own, equal to NULL only; the empty string
is not NULL; repeated rows stay or go together; nothing held out keeps all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextkit.session import materialize

BITS_A_KEY = 12
HASHES = 5
MAX_FILTER_BITS = 1 << 28            # 32 MB; more keys than that make a fuller filter, not a larger one
BROADCAST_BYTES = 64 << 20
SALTS = 32

# Fixed value: the task prefix of a prompt.
PROMPT = "^translate [^:]*: "


def bare_prompt(col: str) -> Column:
    """The sentence of a prompt."""
    return F.regexp_replace(F.col(col), PROMPT, "")


def pair_key(a: Column, b: Column) -> Column:
    """struct(k1, k2) of strings, equal for (a, b) and (b, a); NULL sides are marked."""
    x, y = (F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c)) for c in (a, b))
    return F.struct(F.least(x, y).alias("k1"), F.greatest(x, y).alias("k2"))


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit places of 64-bit hashes, one column a hash function."""
    h = h.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(HASHES)], axis=1)


def bloom_filter(hashes: DataFrame, n_keys: int) -> np.ndarray:
    """The filter of the column ``h``: every task fills words of the filter, the
    words are or-ed by an aggregate, and at most ``MAX_FILTER_BITS`` bits come
    to the driver."""
    bits = 64
    while bits < n_keys * BITS_A_KEY and bits < MAX_FILTER_BITS:
        bits *= 2

    def words(batches):
        for frame in batches:
            at = np.unique(_places(frame["h"].to_numpy(), bits))
            word, mask = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.r_[True, np.diff(word) != 0]) if len(at) else np.zeros(0, int)
            yield pd.DataFrame({"word": word[first], "mask": np.bitwise_or.reduceat(mask, first).view(np.int64)
                                if len(first) else np.zeros(0, np.int64)})
    filled = np.zeros(bits // 64, np.int64)
    table = hashes.mapInPandas(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    filled[table["word"].to_numpy(dtype=np.int64)] = table["mask"].to_numpy(dtype=np.int64)
    return filled.view(np.uint64)


def maybe_in(words: np.ndarray, spark) -> object:
    """A column function: whether a hash may be in the filter (never a wrong no)."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        held = shared.value
        at = _places(h.to_numpy(), len(held) * 64)
        return pd.Series(((held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1).all(axis=1))
    return test


def exclude_pairs(df: DataFrame, held_out: DataFrame, sides: tuple[Column, Column], held_sides: tuple[Column, Column],
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``df`` whose unordered pair of ``sides`` is no pair of
    ``held_sides`` in ``held_out``; columns as they are."""
    keys = materialize(held_out.select(pair_key(*held_sides).alias("_key")).select("_key.*").distinct())
    size = keys.agg(F.count(F.lit(1)).alias("n"),
                    F.coalesce(F.sum(F.octet_length("k1") + F.octet_length("k2") + 64), F.lit(0)).alias("bytes")).first()
    if not size["n"]:
        return df
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), pair_key(*sides).alias("_key"))
    rows = rows.select("_row", F.col("_key.k1").alias("k1"), F.col("_key.k2").alias("k2"),
                       F.xxhash64("_key.k1", "_key.k2").alias("h"))
    hit = maybe_in(bloom_filter(keys.select(F.xxhash64("k1", "k2").alias("h")), size["n"]), df.sparkSession)
    rows = rows.withColumn("_hit", hit("h"))
    passed, hits = rows.filter(~F.col("_hit")), rows.filter("_hit")
    if size["bytes"] <= broadcast_bytes:
        clean = hits.join(F.broadcast(keys), ["k1", "k2"], "left_anti")
    else:
        salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # the number of a row in its partition: equal rows are dealt out too
        hits = hits.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
        clean = hits.join(salted, ["k1", "k2", "_salt"], "left_anti")
    return passed.select("_row").unionByName(clean.select("_row")).select("_row.*")
