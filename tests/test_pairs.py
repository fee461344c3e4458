import math

from pyspark.sql import functions as F

from bitextkit.functions.hashing import hash_key
from bitextkit.operators import pairs as P
from bitextkit.plans import fixtures as fx
from conftest import SF01


def test_split_sizes_disjoint_complete(spark):
    p = fx.pairs(spark, SF01)
    s = P.split_by(p).cache()
    counts = {(r.direction, r.split): r.n for r in
              s.groupBy("direction", "split").agg(F.count("*").alias("n")).collect()}
    for d in ("src2tgt", "tgt2src"):
        n = sum(v for (dd, _), v in counts.items() if dd == d)
        t = math.floor(n * 0.8)
        v = math.floor(n * 0.1)
        assert counts[(d, "train")] == t
        assert counts[(d, "val")] == v
        assert counts[(d, "test")] == n - t - v
    assert s.select("pair_id", "direction").distinct().count() == p.count()


def test_split_invariant_under_repartition(spark):
    p = fx.pairs(spark, SF01)
    a = {tuple(r) for r in P.split_by(p).select("pair_id", "direction", "split").collect()}
    b = {tuple(r) for r in P.split_by(p.repartition(13)).select(
        "pair_id", "direction", "split").collect()}
    assert a == b


def test_sample_k_is_the_least_keys(spark):
    p = fx.pairs(spark, SF01)
    got = {(r.pair_id, r.direction) for r in P.sample_k(p, 100, 42, ("pair_id", "direction")).collect()}
    again = {(r.pair_id, r.direction) for r in
             P.sample_k(p.repartition(5), 100, 42, ("pair_id", "direction")).collect()}
    rows = p.select("pair_id", "direction", hash_key(42, "pair_id", "direction").alias("k")).collect()
    least = sorted(rows, key=lambda r: (r.k, r.pair_id, r.direction))[:100]
    assert got == again == {(r.pair_id, r.direction) for r in least}
    assert P.sample_k(p, 10 ** 9).count() == p.count()
    assert P.sample_k(p, 0).count() == p.count()


def test_batches(spark):
    p = fx.pairs(spark, SF01)
    b = P.assign_batches(p, 8, 42, ("pair_id", "direction"))
    sizes = sorted((r.batch_id, r.n) for r in b.groupBy("batch_id").agg(F.count("*").alias("n")).collect())
    n = p.count()
    assert len(sizes) == math.ceil(n / 8)
    assert all(s == 8 for _, s in sizes[:-1]) and sizes[-1][1] == n - 8 * (len(sizes) - 1)


def test_expand_directions_one_scan(spark):
    df = spark.createDataFrame([(1, "a", "b")], "pair_id long, src string, tgt string")
    rows = P.expand_directions(df, "kangri", "hindi").collect()
    assert [(r.source, r.target, r.direction) for r in rows] == [
        ("translate kangri to hindi: a", "b", "src2tgt"), ("translate hindi to kangri: b", "a", "tgt2src")]
    one = P.expand_directions(df, "kangri", "hindi", both=False)
    assert one.count() == 1


def test_null_stratum_is_split_and_batched(spark):
    rows = [(i, [None, "a", "b"][i % 3]) for i in range(90)]
    d = spark.createDataFrame(rows, "pair_id long, direction string")
    got = P.split_by(d, id_cols=("pair_id",)).groupBy("direction", "split").count().collect()
    assert {(r.direction, r.split): r["count"] for r in got} == {
        (k, s): n for k in (None, "a", "b") for s, n in (("train", 24), ("val", 3), ("test", 3))}
    b = P.assign_batches(d, 8, 42, ("pair_id",), by=("direction",)).collect()
    assert len(b) == 90 and {r.batch_id for r in b if r.direction is None} == {0, 1, 2, 3}
    assert P.sample_k(d, 5, 42, ("pair_id",), by=("direction",)).count() == 15


def test_two_level_prefix_sums_give_the_same_ranks(spark):
    from bitextkit.operators.ranking import global_rank
    d = spark.range(3000).selectExpr("id", "nullif(id % 3, 2) AS s")
    want = sorted(map(tuple, global_rank(d, 42, "id", by=("s",), bucket_hex=2).select("id", "rank", "_stratum_n").collect()))
    got = global_rank(d.repartition(5), 42, "id", by=("s",), bucket_hex=5).select("id", "rank", "_stratum_n")
    assert sorted(map(tuple, got.collect())) == want
    plain = global_rank(d, 42, "id", bucket_hex=6).select("id", "rank").collect()
    assert sorted(r.rank for r in plain) == list(range(1, 3001))
