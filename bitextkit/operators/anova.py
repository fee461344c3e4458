"""Repeated-measures analysis of variance with post-hoc paired t-tests.

Systems (conditions) are scored on the same sentences (subjects).  One shuffle
brings a subject's scores into one row, the mean of the subject is taken off
there, and what is left are central moments, which Spark merges without
subtracting large sums from each other: the variation between systems is that of
the column means, the error the variation around them.

Defined results: several scores of one cell count as their mean; NULL and NaN
scores are missing; a subject with a missing cell takes no part and is counted in
``n_dropped``; with fewer than two complete subjects F, t and p are NULL; without
any error variation F (t) is infinite and p 0 if the systems differ, else both are
NULL.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextkit.functions.distributions import f_tail, t_two_sided


def subject_rows(df: DataFrame, systems: list, subject: str, system: str, score: str) -> DataFrame:
    """One row a subject: ``x0, x1, ...`` its mean score under every system."""
    x = F.col(score).cast("double")
    x = F.when(~F.isnan(x), x)
    return df.groupBy(F.col(subject).alias("_subject")).agg(*[
        F.avg(F.when(F.col(system) == F.lit(s), x)).alias(f"x{i}") for i, s in enumerate(systems)])


def _complete(rows: DataFrame, k: int) -> Column:
    whole = F.lit(True)
    for i in range(k):
        whole = whole & F.col(f"x{i}").isNotNull()
    return whole


def _ratio(between: Column, error: Column) -> Column:
    """A test statistic, defined where there is no error variation too."""
    return F.when(error > 0, between / error).when(between != 0, F.signum(between) * float("inf"))


def repeated_measures_anova(df: DataFrame, systems: list, subject: str = "id", system: str = "system",
                            score: str = "score") -> DataFrame:
    """One row: ``n, n_dropped, k, ss_systems, ss_subjects, ss_error, df_systems,
    df_error, f, p_value``."""
    k = len(systems)
    if k < 2:
        raise ValueError("two systems or more are needed")
    rows = subject_rows(df, systems, subject, system, score)
    mean = sum((F.col(f"x{i}") for i in range(1, k)), F.col("x0")) / F.lit(float(k))
    rows = rows.withColumn("_all", _complete(rows, k)).withColumn("_mean", F.when(F.col("_all"), mean))
    rows = rows.withColumns({f"d{i}": F.col(f"x{i}") - F.col("_mean") for i in range(k)})      # NULL if not complete
    m = rows.agg(F.count("_mean").alias("n"), F.count(F.when(~F.col("_all"), 1)).alias("n_dropped"),
                 F.var_pop("_mean").alias("_subjects"),
                 *[f(f"d{i}").alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("v", F.var_pop))])
    n = F.col("n").cast("double")
    m = m.select("n", "n_dropped", F.lit(k).cast("long").alias("k"),
                 (n * sum((F.col(f"m{i}") * F.col(f"m{i}") for i in range(1, k)), F.col("m0") * F.col("m0"))).alias("ss_systems"),
                 (n * k * F.col("_subjects")).alias("ss_subjects"),
                 (n * sum((F.col(f"v{i}") for i in range(1, k)), F.col("v0"))).alias("ss_error"),
                 F.lit(k - 1).cast("long").alias("df_systems"), ((F.col("n") - 1) * (k - 1)).alias("df_error"))
    f = F.when(F.col("n") > 1, _ratio(F.col("ss_systems") / F.col("df_systems"), F.col("ss_error") / F.col("df_error")))
    m = m.withColumn("f", f)
    return m.withColumn("p_value", f_tail(F.col("f"), F.col("df_systems"), F.col("df_error")))


def paired_t_tests(df: DataFrame, systems: list, subject: str = "id", system: str = "system",
                   score: str = "score") -> DataFrame:
    """One row for every two systems: ``system_a, system_b, n, mean_diff, t, df,
    p_value, p_holm``, the last one after Holm's step-down correction over all of
    them.  The subjects are those of the analysis of variance."""
    k = len(systems)
    rows = subject_rows(df, systems, subject, system, score)
    rows = rows.filter(_complete(rows, k))
    pairs = list(itertools.combinations(range(k), 2))
    moments = rows.agg(F.count(F.lit(1)).alias("n"), *[
        f(F.col(f"x{i}") - F.col(f"x{j}")).alias(f"{name}_{i}_{j}") for i, j in pairs
        for name, f in (("m", F.avg), ("s", F.stddev_samp))])
    t = moments.select(F.col("n"), F.inline(F.array(*[
        F.struct(F.lit(str(systems[i])).alias("system_a"), F.lit(str(systems[j])).alias("system_b"),
                 F.col(f"m_{i}_{j}").alias("mean_diff"), F.col(f"s_{i}_{j}").alias("_s")) for i, j in pairs])))
    stat = F.when(F.col("n") > 1, _ratio(F.col("mean_diff"), F.col("_s") / F.sqrt(F.col("n").cast("double"))))
    t = t.withColumn("t", stat).withColumn("df", F.col("n") - 1)
    t = t.withColumn("p_value", t_two_sided(F.col("t"), F.col("df")))
    # one row a pair of systems: a small table
    by_p = Window.partitionBy(F.lit(1)).orderBy(F.col("p_value").asc_nulls_last(), "system_a", "system_b")
    tests = F.count("p_value").over(Window.partitionBy(F.lit(1)))
    t = t.withColumn("_step", F.least(F.lit(1.0), (tests - F.row_number().over(by_p) + 1) * F.col("p_value")))
    upto = by_p.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.select("system_a", "system_b", "n", "mean_diff", "t", "df", "p_value",
                    F.when(F.col("p_value").isNotNull(), F.max("_step").over(upto)).alias("p_holm"))
