"""Preference-set construction: bidirectional expansion (B01), prompts (P06),
DPO view (P07), direction filter (F09), splits (W02/W03), batches (W04),
seeded samples (L01-L03), direction counts (A07), unions (B02).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextkit.functions.text import direction_of, prompt_prefix
from bitextkit.operators.ranking import assign_by_thresholds, global_rank


def expand_directions(df: DataFrame, src_lang: str, tgt_lang: str, both: bool = True,
                      src: str = "src", tgt: str = "tgt", id_col: str = "pair_id") -> DataFrame:
    """B01 + P06: one row per direction with the task prefix on the source.

    ``inline(array(struct, struct))`` emits both rows from a single scan (a
    Generate node), not a union of two scans."""
    fwd = F.struct(F.concat(F.lit(prompt_prefix(src_lang, tgt_lang)), F.col(src)).alias("source"),
                   F.col(tgt).alias("target"), F.lit("src2tgt").alias("direction"))
    rows = [fwd]
    if both:
        rows.append(F.struct(
            F.concat(F.lit(prompt_prefix(tgt_lang, src_lang)), F.col(tgt)).alias("source"),
            F.col(src).alias("target"), F.lit("tgt2src").alias("direction")))
    return df.select(id_col, F.inline(F.array(*rows)))


def to_triplets(df: DataFrame, preferred: str = "target") -> DataFrame:
    """Triplet schema (source, preferred, unpreferred placeholder)."""
    return df.withColumnRenamed(preferred, "preferred")


def to_dpo(df: DataFrame, source: str = "source", preferred: str = "preferred",
           unpreferred: str = "unpreferred") -> DataFrame:
    """Rename to the DPO trainer schema (prompt, chosen, rejected)."""
    return df.withColumnsRenamed({source: "prompt", preferred: "chosen",
                                  unpreferred: "rejected"})


def filter_direction(df: DataFrame, direction: str, src_lang: str, tgt_lang: str,
                     source: str = "source") -> DataFrame:
    """all | src2tgt | tgt2src using the lower-cased prefix rule."""
    if direction == "all":
        return df
    if direction not in ("src2tgt", "tgt2src"):
        raise ValueError(f"direction must be all, src2tgt or tgt2src, got {direction!r}")
    return df.filter(direction_of(source, src_lang, tgt_lang, rule="prefix") == direction)


def split_by(df: DataFrame, by=("direction",), ratios=(0.8, 0.1, 0.1), seed=42,
             id_cols=("pair_id", "direction"), labels=None, out: str = "split",
             bucket_hex: int | None = None) -> DataFrame:
    """Per-stratum seeded split with the reference's exact sizes:
    train = floor(n*r1), val = floor(n*r2), test = the rest."""
    ratios = list(ratios)
    if labels is None:
        labels = ["train", "val", "test"][:len(ratios)] if len(ratios) == 3 else ["train", "val"]

    def cuts(n: Column):
        out_cuts, acc = [], None
        for r in ratios[:-1]:
            part = F.floor(n.cast("double") * F.lit(float(r)))
            acc = part if acc is None else acc + part
            out_cuts.append(acc)
        return out_cuts

    return assign_by_thresholds(df, seed, list(id_cols), list(by or ()), cuts, labels, out,
                                bucket_hex=bucket_hex)


def assign_batches(df: DataFrame, size: int, seed=42, id_cols=("id",), by=(),
                   out: str = "batch_id") -> DataFrame:
    """Shuffled batches of ``size`` rows: batch = floor((rank-1)/size)."""
    ranked = global_rank(df, seed, list(id_cols), by=by, rank_col="_r")
    return ranked.withColumn(out, F.floor((F.col("_r") - 1) / F.lit(size)).cast("long")).drop(
        "_r", "_stratum_n")


def sample_k(df: DataFrame, k: int, seed=42, id_cols=("pair_id",), by=()) -> DataFrame:
    """The first ``k`` rows in md5(seed:id) order (per stratum when
    ``by`` is given); ``k <= 0`` keeps all rows; ``k`` above the size keeps all.

    A hash-threshold select, the same for every ``k`` and size: whole buckets
    below the cut pass, those above go, and only the bucket at the cut is
    ranked."""
    ids = list(id_cols)
    if k <= 0:
        return df
    tagged = assign_by_thresholds(df, seed, ids, list(by), lambda n: [F.least(n, F.lit(k))],
                                  ["in", "out"], "_sample")
    return tagged.filter(F.col("_sample") == "in").drop("_sample")


def sample_per_direction(df: DataFrame, k: int, src_lang: str, tgt_lang: str, seed=42,
                         source: str = "source", id_cols=("pair_id", "direction")) -> DataFrame:
    """min(k, n) rows per direction; a row is eligible for a direction if
    its prompt contains that direction's phrase (two independent tests, so a
    row matching both can be drawn twice)."""
    s = F.col(source)
    strata = F.array(F.when(s.contains(f"{src_lang} to {tgt_lang}"), F.lit("src2tgt")),
                     F.when(s.contains(f"{tgt_lang} to {src_lang}"), F.lit("tgt2src")))
    tagged = df.withColumn("stratum", F.explode(strata)).filter(F.col("stratum").isNotNull())
    return sample_k(tagged, k, seed, list(id_cols) + ["stratum"], by=("stratum",))


def count_by_direction(df: DataFrame, direction: str = "direction") -> DataFrame:
    """A07."""
    return df.groupBy(direction).agg(F.count(F.lit(1)).alias("n"))


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Concatenation of split parts / directions."""
    return reduce(lambda a, b: a.unionByName(b), parts)
