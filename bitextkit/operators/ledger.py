"""Experiment-ledger analytics: running best / keep decision (W06), gap to a
target or baseline (W07), run-vs-baseline delta (J08), best configuration
(A18), top-k (L04) and the parameter grid (J06).

Running best at scale.  ``max(value) over (partition by track order by iter)``
puts a whole track in one task; a track may hold a third of the ledger.  The
prefix maximum is therefore computed in blocks of ``block`` iterations:
block maxima (small), an exclusive prefix max over blocks (window on the
small table), then a within-block running max partitioned by (track, block).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextkit.operators.ranking import bounded_broadcast, join_null_safe


def running_best(df: DataFrame, by: str = "track", order: str = "iter", value: str = "value",
                 block: int = 1 << 16) -> DataFrame:
    """Adds ``prev_best`` (best earlier value of the track), ``best_so_far``
    and ``keep`` = value is not NULL and beats every earlier value."""
    blk = F.floor(F.col(order) / F.lit(block)).cast("long")
    x = df.withColumn("_blk", blk)
    bmax = x.groupBy(by, "_blk").agg(F.max(value).alias("_bmax"))
    wb = Window.partitionBy(by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bprev = bmax.select(by, "_blk", F.max("_bmax").over(wb).alias("_before_blk"))
    x = join_null_safe(x, bounded_broadcast(bprev), [by, "_blk"], "left")
    wi = Window.partitionBy(by, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.greatest(F.col("_before_blk"), F.max(value).over(wi))
    x = x.withColumn("prev_best", prev)
    v = F.col(value)
    keep = v.isNotNull() & (F.col("prev_best").isNull() | (v > F.col("prev_best")))
    return (x.withColumn("keep", keep)
             .withColumn("best_so_far", F.greatest(F.col("prev_best"), v))
             .drop("_blk", "_before_blk"))


def gap_to(df: DataFrame, target: float | None = None, by: str = "track", order: str = "iter",
           value: str = "value", digits: int = 6) -> DataFrame:
    """Gap of each run to a fixed target and to its track's baseline (the
    first non-NULL value of the track)."""
    base = (df.filter(F.col(value).isNotNull()).groupBy(by)
              .agg(F.min_by(value, order).alias("baseline")))
    x = join_null_safe(df, bounded_broadcast(base), [by], "left")
    out = x.withColumn("gap_to_baseline", F.round(F.col(value) - F.col("baseline"), digits))
    if target is not None:
        out = out.withColumn("gap_to_target", F.round(F.col(value) - F.lit(float(target)), digits))
    return out


def metric_delta(df: DataFrame, run: str = "run", metric: str = "metric", value: str = "value",
                 baseline: str = "baseline", candidate: str = "candidate",
                 digits: int = 6) -> DataFrame:
    """Candidate - baseline per metric (a pivot by conditional
    aggregation: one shuffle, no self-join)."""
    r, v = F.col(run), F.col(value)
    g = df.groupBy(metric).agg(F.avg(F.when(r == baseline, v)).alias("_b"),
                               F.avg(F.when(r == candidate, v)).alias("_c"))
    return g.select(metric, F.round("_b", digits).alias(baseline),
                    F.round("_c", digits).alias(candidate),
                    F.round(F.col("_c") - F.col("_b"), digits).alias("delta"))


def best_run(df: DataFrame, metric: str = "bleu", order: str = "config_id") -> DataFrame:
    """The best row by ``metric``; ties go to the first in ``order``."""
    return df.orderBy(F.col(metric).desc_nulls_last(), F.col(order).asc()).limit(1)


def top_k(df: DataFrame, metric: str = "bleu", k: int = 10, order: str = "config_id") -> DataFrame:
    """L04."""
    return df.orderBy(F.col(metric).desc_nulls_last(), F.col(order).asc()).limit(k)


def grid_array(grid: dict[str, list]) -> Column:
    """The Cartesian product of the value lists as a literal array of
    structs (config_id first, in itertools.product order).  Driver-side and
    bounded by the product of the list lengths; applied to data with
    ``explode`` -- a Generate, never a cross join."""
    names = list(grid)
    structs = []
    for i, combo in enumerate(itertools.product(*[grid[n] for n in names])):
        structs.append(F.struct(F.lit(i).alias("config_id"),
                                *[F.lit(v).alias(n) for n, v in zip(names, combo)]))
    return F.array(*structs)
