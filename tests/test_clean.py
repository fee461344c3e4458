from pyspark.sql import functions as F

from bitextkit.operators import clean as C
from bitextkit.plans import fixtures as fx
from conftest import SF001

# FIXTURES.md table: sf 0.001 counts per step and kept rows
EXPECTED_SF001 = [393, 149, 193, 158, 183, 283, 138]


def test_funnel_counts_match_fixture_table(spark):
    p = fx.parallel(spark, SF001)
    clean, funnel = C.clean_parallel(p)
    rows = funnel.orderBy("step_no").collect()
    assert [r.dropped for r in rows] == EXPECTED_SF001
    assert rows[-1].remaining == 2013 == clean.count()
    assert p.count() == sum(EXPECTED_SF001) + 2013


def test_fast_path_same_rows(spark):
    p = fx.parallel(spark, SF001)
    a = {tuple(r) for r in C.clean_parallel(p)[0].collect()}
    b = {tuple(r) for r in C.clean_pairs_fast(p).collect()}
    assert a == b


def test_dedup_keeps_lowest_id_and_hot_key(spark):
    rows = [(i, "अआइ", "कखग") for i in range(300, 0, -1)] + [(1000 + i, f"अ{i}आ", f"क{i}ख")
                                                            for i in range(600)]
    df = spark.createDataFrame(rows, "pair_id long, src string, tgt string").repartition(7)
    clean, funnel = C.clean_parallel(df)
    f = {r.step: r.dropped for r in funnel.collect()}
    assert f["duplicate"] == 299
    hot = clean.filter(F.col("src") == "अआइ").collect()
    assert [r.pair_id for r in hot] == [1]
    assert clean.count() == 601


def test_sequential_semantics_small(spark):
    # a duplicate of a row that later fails the ratio filter counts as duplicate first
    rows = [(1, "अ", "आ"), (2, "अआ", "कखगघङचछज"), (3, "अआ", "कखगघङचछज"), (4, None, "x"),
            (5, "ab", "ab"), (6, "अआइ", "{क}")]
    df = spark.createDataFrame(rows, "pair_id long, src string, tgt string")
    f = {r.step: r.dropped for r in C.clean_parallel(df)[1].collect()}
    assert f == {"empty": 1, "too_short": 1, "identical": 1, "duplicate": 1, "length_ratio": 1,
                 "artifact": 1, "heavy_latin": 0}


def test_quality_profile_independent(spark):
    g = fx.groups(spark, SF001)
    r = C.quality_profile(g).first()
    assert r.rows == 3510
    assert 0 < r.pct_ratio_outlier < 100


def test_filters_normalise_each_side_once(spark):
    from bitextkit.operators.clean import clean_pairs_fast, drop_heavy_latin
    d = spark.createDataFrame([(1, ' "abc" ', "\u0915\u0916"), (2, None, "x")], "pair_id long, src string, tgt string")
    for out in (drop_heavy_latin(C.normalize_pairs(d)), clean_pairs_fast(d)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("\\u1680") == 4      # the class of blanks names it twice, once a side


def test_parallel_is_dealt_out_and_costs_the_same_again(spark):
    """No table of an earlier run is used: a run's cost says nothing about which ran before."""
    p = fx.parallel(spark, SF001)
    assert "Repartition" in p._jdf.queryExecution().optimizedPlan().toString()
    assert fx.stored(p, "a").inputFiles() != fx.stored(p, "a").inputFiles()
    dup = p.filter(f"pair_id >= {fx.DUP_OFFSET}")
    assert dup.count() == p.filter(f"pair_id < {fx.DUP_OFFSET} AND pair_id % {fx.DUP_MOD} = 0").count()


def test_a_row_meets_each_funnel_test_once(spark):
    p = C.pair_groups(fx.parallel(spark, SF001))._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("[A-Za-z]") == 2         # the Latin share of both sides
