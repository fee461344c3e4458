"""Distributed seeded ranking: the engine behind splits (W02/W03), samples
(L01-L03) and batch assignment (W04).

The reference shuffles a Python list with a seeded RNG and slices it.  A
global ``row_number()`` over a seeded key reproduces that but runs in ONE
task.  Instead rows are ordered by ``md5(seed:id)`` and ranked in two phases:

1. ``bucket`` = first ``bucket_hex`` hex digits of the key (16^k buckets, equal
   size by construction; k follows the size of the data).  Count rows per (stratum, bucket): a partial
   aggregate, tiny output.
2. Prefix-sum the bucket counts per stratum (window over the small table)
   -> ``bucket_offset``; the table has at most strata x 16^k rows, is
   checkpointed, its row count checked, and broadcast only below
   ``MAX_BROADCAST_ROWS`` (else an ordinary shuffle join).
3. A row's rank is ``bucket_offset + rank inside its bucket``.  Threshold
   operators (split, top-k by hash) need the inner rank only for the few
   buckets that straddle a threshold; every other bucket is assigned whole
   with a map-side join and no shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitextkit.functions.hashing import hash_key
from bitextkit.session import input_bytes, materialize

MAX_BROADCAST_ROWS = 2_000_000
BUCKET_ROWS = 1 << 16     # rows a bucket should hold
ROW_BYTES = 64            # what the size estimate of a plan is divided by for rows


def bounded_broadcast(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Checkpoint ``small``, count it, and mark it for broadcast only if it is
    provably small; otherwise return it unmarked (sort-merge / AQE decides)."""
    small = materialize(small)
    return F.broadcast(small) if small.count() <= max_rows else small


def join_null_safe(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where a NULL key matches a NULL key."""
    own = [f"_on_{i}" for i in range(len(keys))]
    small = small.withColumnsRenamed(dict(zip(keys, own)))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)])
    return df.join(small, on, how).drop(*own)


def bucket_digits(df: DataFrame) -> int:
    """Hex digits of the bucket so that buckets keep their size when the data
    grow (2 to 6, from the size of the input; ranks do not depend on it)."""
    return min(6, max(2, math.ceil(math.log(max(input_bytes(df) / ROW_BYTES / BUCKET_ROWS, 1), 16))))


def with_hash_key(df: DataFrame, seed, id_cols, key: str = "_hkey",
                  bucket_hex: int = 4) -> DataFrame:
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return df.withColumn(key, hash_key(seed, *ids)).withColumn(
        "_bucket", F.substring(F.col(key), 1, bucket_hex))


COARSE_HEX = 3            # digits of the upper level of the prefix sum: 4096 rows a stratum


def bucket_offsets(keyed: DataFrame, by: list[str], bucket_hex: int = 4) -> DataFrame:
    """(by..., _bucket, _bcount, _boffset, _n) with _boffset = rows of the
    stratum in earlier buckets and _n = stratum size.

    Up to 65,536 buckets a stratum the prefix sum is one window.  Beyond, it has two
    levels: sums by the first ``COARSE_HEX`` digits are summed up, and inside
    each of these the buckets are, so no task sees all buckets."""
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_bcount"))

    def summed(df, keys, order, count, before, total):
        w = Window.partitionBy(*keys)
        run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({before: F.sum(count).over(run) - F.col(count), total: F.sum(count).over(w)})

    if bucket_hex <= 4:
        return summed(counts, by, "_bucket", "_bcount", "_boffset", "_n").select(
            *by, "_bucket", "_bcount", "_boffset", "_n")
    counts = counts.withColumn("_coarse", F.substring("_bucket", 1, COARSE_HEX))
    upper = counts.groupBy(*by, "_coarse").agg(F.sum("_bcount").alias("_rows"))
    upper = summed(upper, by, "_coarse", "_rows", "_before", "_n").drop("_rows")
    counts = summed(counts, [*by, "_coarse"], "_bucket", "_bcount", "_inner", "_all")
    joined = join_null_safe(counts, upper, [*by, "_coarse"])
    return joined.select(*by, "_bucket", "_bcount", (F.col("_before") + F.col("_inner")).alias("_boffset"), "_n")


def _join_offsets(keyed: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    return join_null_safe(keyed, bounded_broadcast(offsets), [*by, "_bucket"])


def _inner_rank(df: DataFrame, by: list[str], id_cols: list[str], key: str) -> DataFrame:
    w = Window.partitionBy(*by, "_bucket").orderBy(key, *id_cols)
    return df.withColumn("_rank", F.col("_boffset") + F.row_number().over(w))


def global_rank(df: DataFrame, seed, id_cols, by=(), rank_col: str = "rank",
                bucket_hex: int | None = None) -> DataFrame:
    """Exact 1-based rank of every row in md5(seed:ids) order within ``by``.

    One balanced shuffle by bucket (16^k equal buckets), never one task per
    stratum."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    by = list(by)
    digits = bucket_hex or bucket_digits(df)
    keyed = with_hash_key(df, seed, ids, bucket_hex=digits)
    joined = _join_offsets(keyed, bucket_offsets(keyed, by, digits), by)
    ranked = _inner_rank(joined, by, ids, "_hkey")
    return ranked.withColumn(rank_col, F.col("_rank").cast("long")).drop(
        "_hkey", "_bucket", "_bcount", "_boffset", "_rank").withColumnRenamed("_n", "_stratum_n")


def assign_by_thresholds(df: DataFrame, seed, id_cols, by, cuts, labels, out: str,
                         bucket_hex: int | None = None) -> DataFrame:
    """Label each row by where its rank falls among per-stratum cut points.

    ``cuts(n)`` maps the stratum size column to a list of Column thresholds
    c1 <= c2 <= ...; rank <= c1 -> labels[0], <= c2 -> labels[1], ..., else
    labels[-1].  Rows whose whole bucket lies in one label range get it
    without the inner rank (no shuffle); only straddling buckets are ranked.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    by = list(by)
    digits = bucket_hex or bucket_digits(df)
    keyed = with_hash_key(df, seed, ids, bucket_hex=digits)
    offsets = bucket_offsets(keyed, by, digits)
    n = F.col("_n")
    cut_cols = cuts(n)

    def label_of(rank_col):
        expr = None
        for c, lab in zip(cut_cols, labels[:-1]):
            expr = F.when(rank_col <= c, F.lit(lab)) if expr is None else expr.when(
                rank_col <= c, F.lit(lab))
        return expr.otherwise(F.lit(labels[-1]))

    first = F.col("_boffset") + 1
    last = F.col("_boffset") + F.col("_bcount")
    offsets = offsets.withColumn("_whole", F.when(label_of(first) == label_of(last),
                                                  label_of(first)))
    joined = _join_offsets(keyed, offsets, by)
    whole = joined.filter(F.col("_whole").isNotNull()).withColumn(out, F.col("_whole"))
    edge = _inner_rank(joined.filter(F.col("_whole").isNull()), by, ids, "_hkey")
    edge = edge.withColumn(out, label_of(F.col("_rank"))).drop("_rank")
    drop = ["_hkey", "_bucket", "_bcount", "_boffset", "_n", "_whole"]
    return whole.unionByName(edge).drop(*drop)
