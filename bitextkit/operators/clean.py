"""Parallel-corpus cleaning: filters F01-F06, F08, F10, dedup W01, the ordered
funnel F07 and its summary A19.

Plan shape of the funnel (``clean_parallel``)::

    scan -> project(norm_text) -> HashAggregate(partial, key=src,tgt)
         -> Exchange hash(src,tgt) -> HashAggregate(final)
         -> project(first_fail) -> [filter kept | global aggregate of counts]

Every funnel predicate except "duplicate" is a function of the normalised
(src, tgt) pair only, so one aggregation by the pair gives each group's
first failing step, the duplicate count (group size - 1) and the surviving
row (smallest id).  Partial aggregation collapses a hot pair to one row per
map task before the shuffle, so a pair holding a third of the corpus costs
one row per task, not a third of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextkit.functions.text import (has_artifact, heavy_latin, length_ratio,
                                      norm_text, latin_share)

# Funnel steps in the order the reference applies them.
STEPS = ["empty", "too_short", "identical", "duplicate", "length_ratio", "artifact",
         "heavy_latin"]


def normalize_pairs(df: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """P01 on both sides.  The texts come out of a generator of one row: a filter on
    them stays above it, so each side is normalised once however often a
    predicate names it."""
    made = F.inline(F.array(F.struct(norm_text(src).alias(src), norm_text(tgt).alias(tgt))))
    return df.select(*[c for c in df.columns if c not in (src, tgt)], made).select(*df.columns)


def pre_dedup_fail(src: Column, tgt: Column, min_chars: int = 2, label=F.lit) -> Column:
    """First failing step among F01-F03 (NULL = passes), as ``label`` gives it."""
    return (F.when((src == "") | (tgt == ""), label("empty"))
             .when((F.length(src) < min_chars) | (F.length(tgt) < min_chars), label("too_short"))
             .when(src == tgt, label("identical")))


def ratio_outlier(src: Column, tgt: Column, max_len_ratio: float = 2.5) -> Column:
    r = length_ratio(src, tgt)
    return ~((r <= F.lit(float(max_len_ratio))) & (r >= F.lit(1.0 / float(max_len_ratio))))


def post_dedup_fail(src: Column, tgt: Column, max_len_ratio: float = 2.5,
                    max_latin: float = 0.25, label=F.lit) -> Column:
    """First failing step among F04-F06 (NULL = passes), as ``label`` gives it."""
    return (F.when(ratio_outlier(src, tgt, max_len_ratio), label("length_ratio"))
             .when(has_artifact(src) | has_artifact(tgt), label("artifact"))
             .when(heavy_latin(src, max_latin) | heavy_latin(tgt, max_latin),
                   label("heavy_latin")))


# ---------------------------------------------------------------- single filters

def drop_empty(df, src="src", tgt="tgt"):
    """F01."""
    return df.filter((F.col(src) != "") & (F.col(tgt) != ""))


def min_chars(df, n: int = 2, src="src", tgt="tgt"):
    """F02."""
    return df.filter((F.length(src) >= n) & (F.length(tgt) >= n))


def drop_identity(df, src="src", tgt="tgt"):
    """F03."""
    return df.filter(F.col(src) != F.col(tgt))


def ratio_band(df, r: float = 2.5, src="src", tgt="tgt"):
    """keep 1/r <= (len(src)+1)/(len(tgt)+1) <= r."""
    return df.filter(~ratio_outlier(F.col(src), F.col(tgt), r))


def drop_artifacts(df, src="src", tgt="tgt"):
    """F05."""
    return df.filter(~(has_artifact(src) | has_artifact(tgt)))


def drop_heavy_latin(df, max_share: float = 0.25, src="src", tgt="tgt"):
    """F06."""
    return df.filter(~(heavy_latin(src, max_share) | heavy_latin(tgt, max_share)))


def drop_null_pairs(df, src="src", tgt="tgt"):
    """F08."""
    return df.dropna(subset=[src, tgt])


# ---------------------------------------------------------------- dedup

def dedup_pairs(df: DataFrame, keys=("src", "tgt"), order: str = "pair_id") -> DataFrame:
    """Exact dedup on ``keys`` keeping the row with the smallest ``order``.

    ``min_by`` over a struct is a partial-aggregatable aggregate, unlike a
    ``row_number`` window (which would sort a hot key inside one task), and
    unlike ``dropDuplicates`` it promises *which* row survives.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if rest == [order]:      # a plain minimum aggregates by hash
        return df.groupBy(*keys).agg(F.min(order).alias(order)).select(*df.columns)
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return agg.select(*[F.col(f"_first.{c}").alias(c) for c in rest], *keys).select(*df.columns)


# ---------------------------------------------------------------- funnel

def _step_code(step: str) -> Column:
    return F.lit(STEPS.index(step) + 1)


def _name(code: Column) -> Column:
    expr = None
    for i, step in enumerate(STEPS, start=1):
        expr = (F.when(code == i, F.lit(step)) if expr is None
                else expr.when(code == i, F.lit(step)))
    return expr


def pair_groups(df: DataFrame, src: str = "src", tgt: str = "tgt", id_col: str = "pair_id",
                min_chars: int = 2, max_len_ratio: float = 2.5, max_latin: float = 0.25,
                normalize: bool = True) -> DataFrame:
    """One row per distinct normalised pair: smallest id, group size, and the
    first failing step of the ordered funnel (NULL = kept).

    The step labels are computed per row in their own projection (the
    normalised text is produced once and referenced, not re-inlined) and
    carried through the aggregate as ``max`` (they are functions of the
    grouping key, so max = the group's label).  A filter on them therefore
    stays above the aggregate instead of being pushed below it with the
    normalisation expressions duplicated into the predicate."""
    if normalize:
        df = normalize_pairs(df, src, tgt)
    s, t = F.col(src), F.col(tgt)
    rest = [c for c in df.columns if c not in (src, tgt, id_col)]
    # integer step codes (hash-aggregatable, unlike max over strings), given by the tests
    # themselves: a code looked up by a step's name would run all of them for each name
    labeled = df.select(id_col, src, tgt, *rest,
                        pre_dedup_fail(s, t, min_chars, _step_code).alias("_pre"),
                        post_dedup_fail(s, t, max_len_ratio, max_latin, _step_code).alias("_post"))
    aggs = [F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n_rows"),
            F.max("_pre").alias("_pre"), F.max("_post").alias("_post")]
    if rest:
        aggs.append(F.min_by(F.struct(*rest), F.col(id_col)).alias("_rest"))
    g = labeled.groupBy(src, tgt).agg(*aggs)
    g = g.withColumn("first_fail", _name(F.coalesce(F.col("_pre"), F.col("_post"))))
    # the other n_rows-1 rows of a group that passes F01-F03 are the duplicates
    g = g.withColumn("pre_ok", F.col("_pre").isNull()).drop("_pre", "_post")
    if rest:
        g = g.select("*", *[F.col(f"_rest.{c}").alias(c) for c in rest]).drop("_rest")
    return g


def funnel_from_groups(groups: DataFrame, with_pct: bool = False) -> DataFrame:
    """F07 counts: (step_no, step, dropped, remaining) for the seven steps;
    ``with_pct`` adds dropped_pct = dropped / input rows x 100 (S12 report)."""
    ff, n = F.col("first_fail"), F.col("n_rows")
    counts = {
        "empty": F.sum(F.when(ff == "empty", n).otherwise(0)),
        "too_short": F.sum(F.when(ff == "too_short", n).otherwise(0)),
        "identical": F.sum(F.when(ff == "identical", n).otherwise(0)),
        "duplicate": F.sum(F.when(F.col("pre_ok"), n - 1).otherwise(0)),
        "length_ratio": F.count(F.when(ff == "length_ratio", 1)),
        "artifact": F.count(F.when(ff == "artifact", 1)),
        "heavy_latin": F.count(F.when(ff == "heavy_latin", 1)),
    }
    one = groups.agg(F.sum(n).cast("long").alias("_total"),
                     *[c.cast("long").alias(k) for k, c in counts.items()])
    # Unpivot the single aggregated row; remaining = total - running sum.
    # The running sum is arithmetic on one row: no window, no shuffle.
    running = F.lit(0).cast("long")
    rows = []
    for i, step in enumerate(STEPS, start=1):
        running = running + F.coalesce(F.col(step), F.lit(0))
        fields = [F.lit(i).cast("long").alias("step_no"), F.lit(step).alias("step"),
                  F.coalesce(F.col(step), F.lit(0)).alias("dropped"),
                  (F.coalesce(F.col("_total"), F.lit(0)) - running).alias("remaining")]
        if with_pct:
            fields.append(F.round(F.coalesce(F.col(step), F.lit(0)) * 100.0
                                  / F.greatest(F.col("_total"), F.lit(1)), 4).alias("dropped_pct"))
        rows.append(F.struct(*fields))
    return one.select(F.inline(F.array(*rows)))


def clean_parallel(df: DataFrame, src: str = "src", tgt: str = "tgt", id_col: str = "pair_id",
                   min_chars: int = 2, max_len_ratio: float = 2.5, max_latin: float = 0.25,
                   normalize: bool = True, materialize_groups: bool = False):
    """ordered cleaning funnel.  Returns ``(clean_df, funnel_df)``.

    The counts equal the reference's sequential pandas funnel (each step
    counted over the survivors of the previous one).  With
    ``materialize_groups`` the grouped table is checkpointed to the shared
    checkpoint folder so the two outputs do not both recompute the shuffle.
    """
    groups = pair_groups(df, src, tgt, id_col, min_chars, max_len_ratio, max_latin, normalize)
    if materialize_groups:
        from bitextkit.session import materialize
        groups = materialize(groups)
    keep_cols = [id_col, src, tgt] + [c for c in groups.columns
                                      if c not in (id_col, src, tgt, "n_rows", "first_fail",
                                                   "pre_ok")]
    clean = groups.filter(F.col("first_fail").isNull()).select(*keep_cols)
    return clean, funnel_from_groups(groups)


def clean_pairs_fast(df: DataFrame, src: str = "src", tgt: str = "tgt",
                     id_col: str = "pair_id", min_chars: int = 2,
                     max_len_ratio: float = 2.5, max_latin: float = 0.25) -> DataFrame:
    """F07 result set without counts: all predicates depend on (src, tgt) only,
    so filtering *before* the dedup shuffle gives the same kept rows and
    shuffles only the survivors."""
    df = normalize_pairs(df, src, tgt)
    s, t = F.col(src), F.col(tgt)
    df = df.filter(pre_dedup_fail(s, t, min_chars).isNull()
                   & post_dedup_fail(s, t, max_len_ratio, max_latin).isNull())
    return dedup_pairs(df, (src, tgt), id_col).select(id_col, src, tgt,
                                                      *[c for c in df.columns
                                                        if c not in (id_col, src, tgt)])


def cleaning_summary(groups: DataFrame) -> DataFrame:
    """Input rows, kept rows, dropped rows, kept percentage."""
    total = F.sum("n_rows").cast("long")
    kept = F.count(F.when(F.col("first_fail").isNull(), 1)).cast("long")
    return groups.agg(total.alias("input_rows"), kept.alias("final_rows")).select(
        "input_rows", "final_rows", (F.col("input_rows") - F.col("final_rows")).alias("dropped_rows"),
        F.round(F.col("final_rows") * 100.0 / F.greatest(F.col("input_rows"), F.lit(1)), 4)
        .alias("kept_pct"))


def quality_profile(groups: DataFrame, min_chars: int = 2, max_len_ratio: float = 2.5,
                    max_latin: float = 0.25, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """percentage of rows failing each check, measured independently
    (no funnel order), plus the share of 'noisy' rows (any content check)."""
    s, t, n = F.col(src), F.col(tgt), F.col("n_rows")
    checks = {
        "empty": (s == "") | (t == ""),
        "too_short": (F.length(s) < min_chars) | (F.length(t) < min_chars),
        "identical": s == t,
        "ratio_outlier": ratio_outlier(s, t, max_len_ratio),
        "artifact": has_artifact(s) | has_artifact(t),
        "heavy_latin": heavy_latin(s, max_latin) | heavy_latin(t, max_latin),
    }
    noisy = checks["empty"] | checks["too_short"] | checks["identical"] | checks["artifact"] \
        | checks["heavy_latin"]
    total = F.sum(n)
    aggs = [F.round(F.sum(F.when(c, n).otherwise(0)) * 100.0 / total, 4).alias(f"pct_{k}")
            for k, c in checks.items()]
    aggs.append(F.round(F.sum(n - 1) * 100.0 / total, 4).alias("pct_duplicate"))
    aggs.append(F.round(F.sum(F.when(noisy, n).otherwise(0)) * 100.0 / total, 4).alias("pct_noisy"))
    aggs.append(total.cast("long").alias("rows"))
    return groups.agg(*aggs)


def with_latin_share(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, latin_share(col))
