"""Leakage exclusion, shared split, repeated-measures ANOVA."""
import math
import random

import pytest
from pyspark.sql import functions as F

from bitextkit.functions.distributions import f_tail, incomplete_beta, t_two_sided
from bitextkit.operators import leakage
from bitextkit.operators.anova import paired_t_tests, repeated_measures_anova
from bitextkit.operators.shared_split import split_groups


# ------------------------------------------------------------ leakage

@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_no_row_shares_a_pair_in_either_order(spark, bound):
    rnd = random.Random(4)
    side = [None, "", "a", "b", "=a", "A", "é"] + [f"s{i}" for i in range(60)]
    rows = [(rnd.choice(side), rnd.choice(side), i) for i in range(3000)] + [("hot", "pair", i) for i in range(1500)]
    held = [(rnd.choice(side), rnd.choice(side)) for _ in range(400)] + [("pair", "hot"), (None, "a"), (None, None)]
    d = spark.createDataFrame(rows, "s string, t string, h long").selectExpr("*", "h AS k1", "h AS _row", "h AS _salt")
    out = leakage.exclude_pairs(d, spark.createDataFrame(held, "x string, y string"), (F.col("s"), F.col("t")),
                                (F.col("x"), F.col("y")), broadcast_bytes=bound)
    gone = set(held) | {(b, a) for a, b in held}
    assert out.columns == d.columns
    assert sorted(r.h for r in out.select("h").collect()) == sorted(h for s, t, h in rows if (s, t) not in gone)


def test_nothing_held_out_and_empty(spark):
    d = spark.createDataFrame([("a", "b")], "s string, t string")
    sides = (F.col("s"), F.col("t"))
    assert leakage.exclude_pairs(d, d.filter("false"), sides, sides).collect() == d.collect()
    assert leakage.exclude_pairs(d.filter("false"), d, sides, sides).collect() == []
    assert leakage.exclude_pairs(d, d.select(F.col("t").alias("s"), F.col("s").alias("t")), sides, sides).collect() == []


def test_filter_has_no_wrong_no(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    words = leakage.bloom_filter(keys, 20_000)
    hit = leakage.maybe_in(words, spark)
    assert keys.filter(~hit("h")).count() == 0
    others = spark.range(20_000, 60_000).select(F.xxhash64("id").alias("h"))
    assert others.filter(hit("h")).count() < 2_000


# ------------------------------------------------------------ shared split

def check_split(rows, got, ratios):
    part = {}
    for r in got:
        part.setdefault(r.g, set()).add(r.split)
    assert all(len(x) == 1 for x in part.values()) and len(got) == len(rows)
    largest = max((sum(1 for g, _ in rows if g == x) for x in {g for g, _ in rows}), default=0)
    upto = want = 0
    for name, ratio in zip(("train", "val", "test"), ratios[:-1]):
        upto, want = upto + sum(r.split == name for r in got), want + int(len(rows) * ratio)
        assert want <= upto < want + max(largest, 1)


@pytest.mark.parametrize("digits", [1, 2, 4])
@pytest.mark.parametrize("ratios", [(0.8, 0.1, 0.1), (0.5, 0.25, 0.25)])
def test_groups_stay_whole_and_sizes_hold(spark, digits, ratios):
    rnd = random.Random(digits)
    rows = [(g, i) for i in range(900) for g in [rnd.choice([None, *range(250)])]]
    d = spark.createDataFrame(rows, "g long, i long")
    got = split_groups(d, "g", ratios, bucket_hex=digits).collect()
    check_split(rows, got, ratios)
    again = split_groups(d.repartition(7).orderBy(F.desc("i")), "g", ratios, bucket_hex=3).collect()
    assert {(r.g, r.i): r.split for r in got} == {(r.g, r.i): r.split for r in again}


def test_one_group_of_a_third(spark):
    rows = [(0, i) for i in range(300)] + [(i, i) for i in range(1, 600)]
    check_split(rows, split_groups(spark.createDataFrame(rows, "g long, i long"), "g").collect(), (0.8, 0.1, 0.1))
    assert split_groups(spark.createDataFrame([], "g long, i long"), "g").collect() == []


# ------------------------------------------------------------ distributions

def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def lit(x):
    return F.lit(float(x))


def test_incomplete_beta_identities(spark):
    for x in (1e-9, 0.01, 0.3, 0.5, 0.77, 0.999):
        for b in (0.5, 1.0, 3.5, 40.0, 2000.0):
            got = value(spark, F.struct(incomplete_beta(lit(x), lit(1 - x), lit(1), lit(b)).alias("one"),
                                        incomplete_beta(lit(x), lit(1 - x), lit(b), lit(1)).alias("power"),
                                        incomplete_beta(lit(0.5), lit(0.5), lit(b), lit(b)).alias("half")))
            assert math.isclose(got.one, -math.expm1(b * math.log1p(-x)), rel_tol=1e-9, abs_tol=1e-12)
            assert math.isclose(got.power, x ** b, rel_tol=1e-9, abs_tol=1e-300)
            assert math.isclose(got.half, 0.5, rel_tol=1e-9)


def test_published_critical_values(spark):
    """Quantiles of the t and F tables."""
    for t, df, p in ((12.706204736, 1, 0.05), (2.228138852, 10, 0.05), (3.169272667, 10, 0.01), (2.042272456, 30, 0.05),
                     (1.959963985, 10**9, 0.05), (63.656741162, 1, 0.01)):
        assert abs(value(spark, t_two_sided(lit(t), lit(df))) - p) < 1e-6
    for f, a, b, p in ((3.098391212, 3, 20, 0.05), (4.102821015, 2, 10, 0.05), (161.4476387975, 1, 1, 0.05), (9.0, 2, 2, 0.1)):
        assert abs(value(spark, f_tail(lit(f), lit(a), lit(b))) - p) < 1e-6
    assert value(spark, t_two_sided(lit(0), lit(5))) == 1.0 and value(spark, f_tail(lit("inf"), lit(2), lit(5))) == 0.0
    assert value(spark, f_tail(F.lit(None).cast("double"), lit(2), lit(5))) is None


# ------------------------------------------------------------ ANOVA

DRUGS = [[30, 28, 16, 34], [14, 18, 10, 22], [24, 20, 18, 30], [38, 34, 20, 44], [26, 28, 14, 30]]


def long(spark, table, shift=0.0):
    rows = [(i, f"d{j}", None if x is None else float(x) + shift) for i, row in enumerate(table) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "id long, system string, score double")


@pytest.mark.parametrize("shift", [0.0, 1e8])
def test_published_table(spark, shift):
    """Four drugs on five patients: F(3, 12) = 24.75887, p = 1.99e-5; no cancellation far from zero."""
    r = repeated_measures_anova(long(spark, DRUGS, shift), [f"d{j}" for j in range(4)]).first()
    assert (r.n, r.n_dropped, r.k, r.df_systems, r.df_error) == (5, 0, 4, 3, 12)
    assert abs(r.ss_systems - 698.2) < 1e-5 and abs(r.ss_subjects - 680.8) < 1e-5 and abs(r.ss_error - 112.8) < 1e-5
    assert abs(r.f - 24.758865) < 1e-5 and abs(r.p_value - 1.9925e-5) < 1e-8


def test_paired_tests_against_plain_sums(spark):
    t = {(r.system_a, r.system_b): r for r in paired_t_tests(long(spark, DRUGS), [f"d{j}" for j in range(4)]).collect()}
    assert len(t) == 6
    ordered = sorted(t.values(), key=lambda r: r.p_value)
    run = 0.0
    for i, r in enumerate(ordered):
        d = [row[int(r.system_a[1])] - row[int(r.system_b[1])] for row in DRUGS]
        m = sum(d) / 5
        s = math.sqrt(sum((x - m) ** 2 for x in d) / 4)
        assert math.isclose(r.mean_diff, m) and math.isclose(r.t, m / (s / math.sqrt(5))) and r.df == 4
        run = max(run, min(1.0, (6 - i) * r.p_value))
        assert math.isclose(r.p_holm, run)


def test_missing_cells_and_no_variation(spark):
    table = [[1, 2], [2, 4], [5, None], [float("nan"), 1], [3, 3.5]]
    d = long(spark, table).unionByName(long(spark, [[3.0, 4.0]]))          # a cell twice: its mean
    r = repeated_measures_anova(d, ["d0", "d1"]).first()
    assert (r.n, r.n_dropped) == (3, 2)
    t = paired_t_tests(d, ["d0", "d1"]).first()
    assert t.n == 3 and math.isclose(t.t ** 2, r.f) and math.isclose(t.p_value, r.p_value) and t.p_holm == t.p_value
    same = repeated_measures_anova(long(spark, [[1, 1], [2, 2], [3, 3]]), ["d0", "d1"]).first()
    assert same.f is None and same.p_value is None
    apart = repeated_measures_anova(long(spark, [[1, 2], [2, 3], [3, 4]]), ["d0", "d1"]).first()
    assert apart.f == float("inf") and apart.p_value == 0.0
    none = repeated_measures_anova(long(spark, [[1, 2]]), ["d0", "d1"]).first()
    assert none.n == 1 and none.f is None and none.p_value is None
    assert repeated_measures_anova(long(spark, [[1, 2]]).filter("false"), ["d0", "d1"]).first().p_value is None
