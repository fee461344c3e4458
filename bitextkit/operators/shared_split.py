"""One split for all rows of a group, e.g. both directions of a sentence pair.

Groups are ordered by ``md5(seed:group)``.  A group goes to the part in which the
place of its first row falls, counting rows in that order, so the parts have the
sizes of the ratios up to one group.  The order is never made as a whole: rows are
counted in buckets of the hash, a prefix sum over the buckets tells where each one
begins, and only the buckets in which a part ends have their groups counted and
ranked.  Rows meet whole buckets by a broadcast of one row a bucket, and the ranked
groups by a join; they are not sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitextkit.operators.ranking import bounded_broadcast, bucket_digits, join_null_safe, with_hash_key
from bitextkit.session import materialize


def split_groups(df: DataFrame, group="pair_id", ratios=(0.8, 0.1, 0.1), seed=42, labels=("train", "val", "test"),
                 out: str = "split", bucket_hex: int | None = None) -> DataFrame:
    """``df`` with the label of its group; ``group`` is a column or several.
    NULL groups are one group; rows of a group never part."""
    cols = [group] if isinstance(group, str) else list(group)
    labels = list(labels)[:len(ratios)]
    keyed = with_hash_key(df, seed, cols, bucket_hex=bucket_hex or bucket_digits(df))
    buckets = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # at most 16 ** bucket_hex rows
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = materialize(buckets.select("_bucket", "_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")))
    total = buckets.agg(F.sum("_rows")).first()[0] or 0
    ends, at = [], 0
    for r in list(ratios)[:-1]:
        at += int(total * r)
        ends.append(at)

    def label(place):
        x = F.lit(labels[-1])
        for end, name in reversed(list(zip(ends, labels))):
            x = F.when(place < end, F.lit(name)).otherwise(x)
        return x

    first, last = label(F.col("_before")), label(F.col("_before") + F.col("_rows") - 1)
    buckets = buckets.select("_bucket", "_before", F.when(first == last, first).alias("_whole"))
    joined = keyed.join(bounded_broadcast(buckets), "_bucket")
    edge = joined.filter("_whole IS NULL")
    sizes = edge.groupBy("_bucket", "_before", "_hkey", *cols).agg(F.count(F.lit(1)).alias("_rows"))
    run = Window.partitionBy("_bucket").orderBy("_hkey", *cols).rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_before") + F.coalesce(F.sum("_rows").over(run), F.lit(0))
    ranked = bounded_broadcast(sizes.select(*cols, label(place).alias(out)))
    whole = joined.filter("_whole IS NOT NULL").withColumn(out, F.col("_whole"))
    edge = join_null_safe(edge, ranked, cols)
    names = [*df.columns, out]
    return whole.select(*names).unionByName(edge.select(*names))
