import math

import random

import pytest
from pyspark.sql import functions as F

from bitextkit.functions import vector as V
from bitextkit.operators import reward as R
from bitextkit.operators import stats as ST


def test_gamma_reward_golden(spark):
    rows = [(1.0, 1.0, 0.367879), (0.5, 1.0, 0.303265), (-0.5, 1.0, -0.824361), (0.5, 2.0, 0.183940),
            (1.0, 2.0, 0.135335)]
    df = spark.createDataFrame(rows, "rho double, phi double, want double")
    for r in df.select(V.gamma_reward("rho", F.col("phi")).alias("g"), "want").collect():
        assert r.g == pytest.approx(r.want, abs=1e-6)


def test_dpo_golden(spark):
    df = spark.createDataFrame([(-1.0, -1.2, -2.0, -1.5), (-1.0, -1.0, -1.0, -1.0)],
                               "pp double, rp double, pu double, ru double")
    got = df.select((-V.log_sigmoid(V.dpo_margin("pp", "rp", "pu", "ru", 0.1))).alias("l")).collect()
    assert got[0].l == pytest.approx(0.658760, abs=1e-6)
    assert got[1].l == pytest.approx(math.log(2), abs=1e-12)


def test_cosine_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])],
                               "a array<double>, b array<double>")
    assert [r.c for r in df.select(V.cosine("a", "b").alias("c")).collect()] == [0.0, 1.0]


def test_seq_logprob_mask_and_clamp(spark):
    df = spark.createDataFrame([([-1.0, -2.0, -3.0], [5, -100, 7]), ([-1.0], [-100])],
                               "lp array<double>, lab array<int>")
    got = [r.s for r in df.select(V.seq_logprob("lp", "lab").alias("s")).collect()]
    assert got == [-2.0, 0.0]


def test_reinforce_identity(spark):
    df = spark.createDataFrame([(0, 1.0, -1.0), (0, 3.0, -2.0)], "batch_id long, reward double, logp double")
    r = R.reinforce_loss(df).first()
    # r - mean = (-1, 1); -mean((-1)(-1) + (1)(-2)) / 2 = -(1 - 2)/2 = 0.5
    assert r.reinforce_loss == pytest.approx(0.5)


def test_cohens_d_golden(spark):
    df = spark.createDataFrame([(0.02, 0.0), (-0.01, 0.0), (0.03, 0.0), (0.0, 0.0)], "score_a double, score_b double")
    assert ST.cohens_d(df).first().cohens_d == pytest.approx(0.547723, abs=1e-6)


def test_randomization_identical_systems(spark):
    df = spark.createDataFrame([(i, 100 + i % 7, 100 + i % 7) for i in range(500)],
                               "id long, score_a long, score_b long")
    r = ST.randomization_test(df, trials=300).first()
    assert r.p_value == 1.0 and r.trials == 300


def test_randomization_clear_difference(spark):
    df = spark.createDataFrame([(i, 200 + i % 5, 100) for i in range(400)], "id long, score_a long, score_b long")
    assert ST.randomization_test(df, trials=200).first().p_value == 0.0


def test_randomization_partition_independent(spark):
    rows = [(i, (i * 37) % 101, (i * 53) % 97) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, score_a long, score_b long")
    a = ST.randomization_test(df, trials=100).first()
    b = ST.randomization_test(df.repartition(11), trials=100).first()
    assert a == b


def test_randomization_of_fractional_scores_and_any_ids(spark):
    rows = [(i - 20, f"s{i}", 0.9, 0.1) for i in range(40)]
    d = spark.createDataFrame(rows, "id long, name string, score_a double, score_b double")
    with pytest.raises(ValueError):
        ST.randomization_test(d, trials=10)
    for key in ("id", "name"):
        r = ST.randomization_test(d, id_col=key, trials=500, scale=10_000).first()
        assert r.observed_abs_sum == 320_000 and r.p_value == 0.0 and r.trials == 500
    far = d.withColumn("id", F.col("id") + F.lit(2 ** 60))
    assert ST.randomization_test(far, trials=200, scale=10_000).first().p_value == 0.0


def test_reinforce_loss_does_not_cancel(spark):
    rows = [(0, 1e9 + x, y) for x, y in ((1.0, -3.0), (2.0, -9.0), (3.0, -24.0))]
    d = spark.createDataFrame(rows + [(0, None, 5.0)], "batch_id long, reward double, logp double")
    assert abs(R.reinforce_loss(d).first().reinforce_loss - 7.0) < 1e-6


def test_randomization_against_the_coins(spark):
    """Every trial's sum again in plain Python, with gaps between ids, text ids and large differences."""
    rnd = random.Random(7)

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2 ** 64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2 ** 64
        return x ^ x >> 31

    for ids, kind in ((sorted(rnd.sample(range(-10**15, 10**15), 150)), "long"), (sorted(f"s{i}" for i in range(70)), "string")):
        diff = [rnd.choice([-1, 0, 1, 2, 10**12, -10**9]) * rnd.randrange(1, 50) for _ in ids]
        rows = [(i, d, 0) for i, d in zip(ids, diff)] + [(ids[3], 5, 0)]         # an id twice
        diff[3] += 5
        hits = 0
        for t in range(120):
            words = [mix((42 + b * 0x9E3779B97F4A7C15 + t * 0xD1B54A32D192ED03) % 2 ** 64) for b in range(len(ids) // 64 + 1)]
            hits += abs(sum(-d if words[i // 64] >> i % 64 & 1 else d for i, d in enumerate(diff))) >= abs(sum(diff))
        df = spark.createDataFrame(rows, f"id {kind}, score_a long, score_b long").repartition(5)
        r = ST.randomization_test(df, trials=120).first()
        assert (r.hits, r.trials, r.observed_abs_sum) == (hits, 120, abs(sum(diff)))


def test_dense_numbers(spark):
    ids = [None, -5, 0, 3, 10**17] + list(range(1000, 3000, 7))
    got = ST.dense_numbers(spark.createDataFrame([(i,) for i in ids], "id long").repartition(9)).collect()
    assert [r.number for r in sorted(got, key=lambda r: (r.id is not None, r.id or 0))] == list(range(len(ids)))
    assert ST.dense_numbers(spark.createDataFrame([], "id long")).collect() == []
