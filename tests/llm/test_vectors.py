"""Operator 12 against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from bitextkit.llm import vector_search as V


def brute(rows, k, is_query):
    """rows: distinct (id, vector) -> {query: [(rank, id, score)]}"""
    rows = [(i, np.asarray(v, float)) for i, v in rows]
    x = np.stack([v / np.linalg.norm(v) for _, v in rows])
    out = {}
    for n, (i, _) in enumerate(rows):
        if is_query(i):
            s = x @ x[n]
            near = sorted(((-round(float(s[m]), 9), rows[m][0]) for m in range(len(rows)) if m != n))[:k]
            out[i] = [(r + 1, j, -c) for r, (c, j) in enumerate(near)]
    return out


def result(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    return out


def recall(got, want):
    hits = sum(len({j for _, j, _ in want[q]} & {j for _, j, _ in got[q]}) for q in want)
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_test_tables(spark, sf):
    e = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    got, want = result(V.nearest(e, F.col("id") % 50 == 0)), brute(rows, 5, lambda i: i % 50 == 0)
    assert set(got) == set(want) and all([r for r, _, _ in x] == [1, 2, 3, 4, 5] for x in got.values())
    assert recall(got, want) >= 0.95
    score = {(q, j): s for q, x in brute(rows, len(rows), lambda i: i % 50 == 0).items() for _, j, s in x}
    assert all(abs(score[q, j] - s) < 1e-8 for q, x in got.items() for _, j, s in x)


def test_copies_ties_and_cells(spark, monkeypatch):
    """A third of the rows is one vector; cells of few rows, cut into blocks."""
    monkeypatch.setattr(V, "CELL_ROWS", 40)
    monkeypatch.setattr(V, "BLOCK_ROWS", 25)
    monkeypatch.setattr(V, "STOP", 1e9)         # every leaf is verified: the result is exact
    rng = np.random.default_rng(5)
    rows = [(i, [0.25, 0.5, 0.75, 0.125]) for i in range(0, 300)]
    rows += [(i, [float(x) for x in rng.integers(-4, 5, 4) + 0.5]) for i in range(300, 900)]
    d = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<float>")
    assert result(V.nearest(d, F.col("id") % 7 == 0)) == brute(rows, 5, lambda i: i % 7 == 0)


def test_clustered_vectors_are_pruned(spark, monkeypatch):
    """Where neighbours are near, few leaves are verified and recall holds."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(300, 32)), 10, axis=0) + rng.normal(scale=0.01, size=(3000, 32))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    monkeypatch.setattr(V, "LEAF", 32)
    tree = V.CellTree(x, [[i] for i in range(len(x))], V.projection(32))
    gaps = V.box_distances(unit @ V.projection(32), tree.low, tree.high)
    row = tree.search(unit, unit @ V.projection(32), np.full(3000, -np.inf), 6)
    s = unit @ unit.T
    want = np.argsort(-s, axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b[:6])) / 6 for a, b in zip(want, row)]) >= 0.95
    kth = np.sort(s, axis=1)[:, -6]
    assert (gaps <= V.reach(kth)[:, None]).mean() < 0.2


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (None, [1.0, 0.0]), (8, [1e-300, 1e-300]), (9, [1e300, -1e300]), (10, [-2.0]), (0, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "vec_id AS id", "vec_id AS v", "vec_id AS block", "vec_id AS ids", "vec_id AS q", "vec_id AS score")
    got = result(V.nearest(d, F.col("id") >= 0))
    h = round(float(np.sqrt(0.5)), 9)
    assert set(got) == {0, 1, 8, 9, 10} and all(len(x) == 4 for x in got.values())
    assert got[0][1:] == [(2, 8, h), (3, 9, h), (4, 10, -1.0)]
    assert got[10][-1] == (4, 0, -1.0)
    one = d.filter("vec_id = 0")
    assert V.nearest(one, F.col("id") >= 0).collect() == [] and V.nearest(d.filter("false"), F.col("id") >= 0).collect() == []
    several = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r, j) for r, j, _ in result(V.nearest(several, F.col("id") == 2))[2]] == [(1, 1), (2, 1)]
