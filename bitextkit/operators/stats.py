"""Significance of system differences: paired scores (J05), approximate
randomization test (A16) and paired Cohen's d (A17).

Randomization test plan.  The reference draws, per trial, one coin per
sentence from a global unseeded RNG.  Here the coin of a sentence is a bit of a
counter-based generator: ids are numbered 0, 1, 2, ... in their order, and bit
``number mod 64`` of ``mix64(seed, trial, number div 64)`` is the coin, so one
number serves 64 sentences, nothing depends on gaps between ids, on
partitioning or on retries, and SQL can recompute it.  The differences of a block
of 64 sentences are sliced into bit planes; a trial's sum over a block is the sum
over planes of 2^plane times the number of ones in (coins and plane), all numpy
over (blocks x trials) inside ``mapInPandas``.  Each task emits one partial sum
per trial (shuffle = trials x tasks rows); the p-value is one global count.
Score differences are integers (a scale turns fractional scores into units),
so the ``>=`` comparison of sums is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
STEP_ROWS = 4096          # sentences a task should have at least

# Increments and multipliers of the splitmix64 generator.
GAMMA, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
TRIAL_STEP = 0xD1B54A32D192ED03


def paired_scores(a: DataFrame, b: DataFrame, on: str = "id", a_col: str = "score",
                  b_col: str = "score") -> DataFrame:
    """(id, score_a, score_b) for ids scored by both systems."""
    return a.select(on, F.col(a_col).alias("score_a")).join(
        b.select(on, F.col(b_col).alias("score_b")), on)


def mix64(x):
    """The output function of splitmix64 on a numpy array of uint64."""
    import numpy as np
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def coin_words(seed: int, trials, blocks):
    """64 coins of every (block, trial): mix64(seed + block * GAMMA + trial * TRIAL_STEP)."""
    import numpy as np
    at = blocks.astype(np.uint64)[:, None] * np.uint64(GAMMA) + trials.astype(np.uint64)[None, :] * np.uint64(TRIAL_STEP)
    return mix64(at + np.uint64(seed % (1 << 64)))


def dense_numbers(rows: DataFrame, id_col: str = "id", out: str = "number") -> DataFrame:
    """``rows`` (one row an id) numbered 0, 1, 2, ... in the order of their ids,
    whatever the ids are: a range partitioning, the place in each sorted part, and
    the sizes of the parts before it (one row a part).  NULL ids come first."""
    from bitextkit.session import materialize
    parts = rows.repartitionByRange(id_col).sortWithinPartitions(id_col)
    # the id counts up inside a part, whose number stands in its upper bits
    at = F.monotonically_increasing_id()
    parts = materialize(parts.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(sizes), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def _differences(df: DataFrame, a: str, b: str, id_col: str, scale: int | None) -> DataFrame:
    """(id, d): the integer difference of every id; rows that share an id are summed."""
    types = dict(df.dtypes)
    diff = F.col(a) - F.col(b)
    if scale is not None:
        diff = F.round(diff * F.lit(scale))
    elif any(types[c] in ("float", "double") or types[c].startswith("decimal") for c in (a, b)):
        raise ValueError("fractional scores need scale, e.g. 10_000 for units of 1e-4")
    return df.select(F.col(id_col).alias("id"), diff.cast("long").alias("d")).groupBy("id").agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("d"))


def bit_planes(d):
    """Two's complement bits of ``d`` (blocks x 64, int64): (weight, words) a
    plane, a word's bit j for the block's sentence j."""
    import numpy as np
    top = int(max(int(d.max(initial=0)), -int(d.min(initial=0)) - 1, 0)).bit_length()
    shift = np.arange(BLOCK, dtype=np.uint64)
    for p in range(top + 1):
        bits = ((d >> p) & 1).astype(np.uint64)
        words = np.bitwise_or.reduce(bits << shift, axis=1)
        if words.any():
            yield (-(1 << p) if p == top else 1 << p), words


def randomization_test(df: DataFrame, a: str = "score_a", b: str = "score_b", id_col: str = "id",
                       trials: int = 10_000, seed: int = 42, scale: int | None = None) -> DataFrame:
    """p = #{trials with |sum s_i d_i| >= |sum d_i|} / trials (no +1),
    where swapping a pair flips the sign of its difference.

    Sums are exact integers.  Scores that are not integers need ``scale``: their
    differences are rounded to units of 1 / scale.  Ids may be of any ordered
    type; rows that share an id share a coin; a missing score counts as no
    difference.  An empty table has a p-value of 1."""
    import pandas as pd
    spark = df.sparkSession
    rows = dense_numbers(_differences(df, a, b, id_col, scale))
    number = F.col("number")
    blocks = rows.groupBy(F.shiftright(number, 6).alias("blk")).agg(
        F.collect_list(F.struct(number.bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("j"), "d")).alias("xs"))
    n = rows.count()
    # every row fans out to all trials: tasks by rows, which the bytes of the table do not show
    parts = max(1, min(n // STEP_ROWS, max(4 * spark.sparkContext.defaultParallelism, n >> 20)))
    n_trials = int(trials)

    def run(batches):
        import numpy as np
        trial = np.arange(n_trials)
        swapped, total = np.zeros(n_trials, dtype=np.int64), 0
        for frame in batches:
            for at in range(0, len(frame), BLOCK):
                some = frame.iloc[at:at + BLOCK]
                d = np.zeros((len(some), BLOCK), dtype=np.int64)
                for i, xs in enumerate(some["xs"]):
                    for x in xs:
                        d[i, x["j"]] = x["d"]
                total += int(d.sum())
                coins = coin_words(seed, trial, some["blk"].to_numpy())
                for weight, words in bit_planes(d):
                    swapped += weight * np.bitwise_count(coins & words[:, None]).sum(axis=0, dtype=np.int64)
        yield pd.DataFrame({"trial": trial.astype(np.int64), "s": total - 2 * swapped, "obs": np.full(n_trials, total)})

    per = blocks.repartition(parts).mapInPandas(run, "trial long, s long, obs long")
    by_trial = per.groupBy("trial").agg(F.sum("s").alias("s"), F.sum("obs").alias("obs"))
    return by_trial.agg(
        F.count(F.when(F.abs("s") >= F.abs("obs"), 1)).cast("long").alias("hits"),
        F.count(F.lit(1)).cast("long").alias("trials"),
        F.max(F.abs("obs")).cast("long").alias("observed_abs_sum"),
    ).select("hits", "trials", (F.col("hits") / F.col("trials")).alias("p_value"),
             "observed_abs_sum")


def cohens_d(df: DataFrame, a: str = "score_a", b: str = "score_b", scale: float = 1.0,
             digits: int = 6) -> DataFrame:
    """mean(diff) / (stddev_samp(diff) + 1e-10); NULL for one row."""
    diff = (F.col(a) - F.col(b)).cast("double") / F.lit(scale)
    return df.agg(F.count(F.lit(1)).cast("long").alias("n"),
                  F.round(F.avg(diff) / (F.stddev_samp(diff) + F.lit(1e-10)), digits).alias("cohens_d"),
                  F.round(F.avg(diff), digits).alias("mean_diff"))
