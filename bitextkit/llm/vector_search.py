"""Operator 12, nearest neighbours by cosine over stable projections and kd-trees.

Unit vectors are projected to ``PROJECTED`` dimensions with a fixed Gaussian
matrix (a 2-stable distribution): the squared length of a projected difference,
divided by the squared true distance, follows a chi-square law with
``PROJECTED`` degrees.  A search takes the leaves of a kd-tree over projected
points in the order of their projected distance and verifies their vectors by
exact cosine.  It stops when a leaf lies further than the k-th best distance
allows: a neighbour as near as the k-th best one would be projected beyond that
leaf with a probability of ``1 - CERTAINTY`` at most, so every neighbour is found
with a probability of ``CERTAINTY`` or more.

The upper levels of the tree are fitted on ``SAMPLE`` rows (the least by hash)
and split the rows into cells; every row is indexed.  A query first searches its
own cell, then, with the k-th best distance found there, only the cells whose
bounding box passes the test.  One task holds one cell block at a time (at most
some ``BLOCK_ROWS`` rows; fuller cells are cut by hash) and lets its queries
stream by in Arrow batches: nothing grows with a cell's queries.  Equal vectors
are one point that carries its ``k + 1`` least ids, so a vector that a third of
all rows share is one row.  To the driver come the sample and one bounding box a
cell block.

Defined results: null, empty, zero vectors and those with null or non-finite
components, and rows without id, take no part; a shorter vector counts as filled
up with zeros; rows equal in id and vector count once; an id with several
vectors is several candidates, and as a query it gets the nearest of all of
them; an empty table has no neighbours; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextkit.llm.common import attach, cut

PROJECTED = 12
CERTAINTY = 0.95
STOP = 21.02606981748307         # fixed value: the 0.95 quantile of chi-square with 12 degrees
SAMPLE = 20_000
MIN_CELLS = 16
CELL_ROWS = 65_536               # cells grow up to this size before their number grows
BLOCK_ROWS = 131_072
LEAF = 256
SEED = 20_240_612
UNKNOWN = float("-inf")          # no k-th best cosine yet
SPARE = 3                        # verified beside the k best, so that rounding of products cannot change them


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim, PROJECTED))


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and the lengths.  Squares of very large or
    small components are kept in range by scaling a row first."""
    top = np.abs(x).max(axis=1, initial=0.0)
    extreme = (top > 1e140) | (top < 1e-140)
    x = np.where(extreme[:, None], x / np.where(top > 0, top, 1.0)[:, None], x)
    return x, np.sqrt((x * x).sum(axis=1))


def matrix(column, dim: int) -> np.ndarray:
    """Vectors of a pandas column as rows, filled up with zeros."""
    out = np.zeros((len(column), dim))
    for row, v in zip(out, column):
        row[:len(v)] = v
    return out


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that take part, equal ones once."""
    v = F.col("v")
    d = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.filter(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return d.distinct()


def points(rows: DataFrame, ids: int) -> DataFrame:
    """(v, ids): distinct vectors of ``rows`` (id, v) with their least ``ids``
    ids.  The window's limit is applied before the shuffle too."""
    d = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("_n") <= ids)
    return d.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def fit_cells(sample: np.ndarray, cells: int) -> list[tuple]:
    """The upper kd-tree as a list of nodes: (dimension, threshold, left, right)
    or (-1, cell, 0, 0) at the leaves."""
    nodes: list[tuple] = []
    count = 0

    def grow(x, n):
        nonlocal count
        at = len(nodes)
        nodes.append(())
        if n == 1 or len(x) < 2:
            nodes[at] = (-1, count, 0, 0)
            count += 1
            return at
        dim = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
        half = n // 2
        threshold = float(np.quantile(x[:, dim], half / n))
        low = x[:, dim] <= threshold
        nodes[at] = (dim, threshold, grow(x[low], half), grow(x[~low], n - half))
        return at

    grow(sample, cells)
    return nodes


def cell_of(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int32)
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        dim, value, left, right = nodes[at]
        if dim < 0:
            out[rows] = value
            continue
        low = x[rows, dim] <= value
        todo += [(left, rows[low]), (right, rows[~low])]
    return out


def box_distances(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from projected queries to boxes (queries x boxes)."""
    out = np.zeros((len(queries), len(low)))
    for j in range(queries.shape[1]):
        q = queries[:, j:j + 1]
        gap = np.maximum(np.maximum(low[:, j] - q, q - high[:, j]), 0.0)
        out += gap * gap
    return out


class CellTree:
    """The lower kd-tree over the points of one cell block."""

    def __init__(self, raw: np.ndarray, ids: list, g: np.ndarray):
        self.raw, self.ids = raw, ids
        scaled, norm = unit_rows(raw)
        self.unit = scaled / norm[:, None]
        p = self.unit @ g
        self.leaves = []
        todo = [np.arange(len(raw))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                continue
            x = p[rows]
            order = np.argsort(x[:, int(np.argmax(x.max(axis=0) - x.min(axis=0)))], kind="stable")
            todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
        self.low = np.array([p[r].min(axis=0) for r in self.leaves])
        self.high = np.array([p[r].max(axis=0) for r in self.leaves])

    def search(self, unit: np.ndarray, projected: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
        """Rows of the ``k + SPARE`` best points found for every query, -1 where
        there are less.  ``bound``: a cosine that k points are known to reach.
        Leaves come in the order of their projected distance, in doubling
        numbers; those of one step are verified leaf by leaf."""
        n, keep = len(unit), k + SPARE
        score = np.full((n, keep), -np.inf)
        row = np.full((n, keep), -1)
        gaps = box_distances(projected, self.low, self.high)
        order = np.argsort(gaps, axis=1, kind="stable")
        begin, step = 0, 1
        while begin < len(self.leaves):
            ranks = order[:, begin:begin + step]
            kth = np.maximum(bound, score[:, k - 1])
            near = np.take_along_axis(gaps, ranks, 1) <= reach(kth)[:, None]
            if not near.any():
                break
            q, c = np.nonzero(near)
            leaf = ranks[q, c]
            by = np.argsort(leaf, kind="stable")
            q, leaf = q[by], leaf[by]
            cuts = np.flatnonzero(np.diff(leaf)) + 1
            for who, at in zip(np.split(q, cuts), leaf[np.r_[0, cuts]]):
                rows = self.leaves[at]
                both = np.concatenate([score[who], unit[who] @ self.unit[rows].T], axis=1)
                places = np.concatenate([row[who], np.broadcast_to(rows, (len(who), len(rows)))], axis=1)
                top = np.argpartition(-both, min(keep, both.shape[1]) - 1, axis=1)[:, :keep]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable"), 1)
                score[who], row[who] = np.take_along_axis(both, top, 1), np.take_along_axis(places, top, 1)
            begin, step = begin + step, step * 2
        return row


def reach(kth: np.ndarray) -> np.ndarray:
    """The squared projected distance at which the stopping test holds, given
    the k-th best cosine (the squared distance of unit vectors is 2 - 2 cos)."""
    return STOP * np.maximum(2.0 - 2.0 * kth, 1e-12)


def _searcher(dim: int, k: int):
    """The function over partitions sorted by (block, kind): the points of a
    block (kind 0), then its queries (kind 1).  ``same`` marks the point of the
    query's own vector."""
    g = projection(dim)

    def run(batches):
        at, parts, tree = None, [], None
        for frame in batches:
            for block, rows in frame.groupby("block", sort=True):
                if block != at:
                    at, parts, tree = block, [], None
                held, asked = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
                if len(held):
                    parts.append((matrix(held["v"], dim), list(held["ids"])))
                if not len(asked) or not parts:
                    continue
                if tree is None:
                    tree = CellTree(np.concatenate([x for x, _ in parts]), [i for _, x in parts for i in x], g)
                scaled, norm = unit_rows(matrix(asked["v"], dim))
                unit, bound = scaled / norm[:, None], asked["bound"].to_numpy()
                row = tree.search(unit, unit @ g, bound, k)
                q, c = np.nonzero(row >= 0)
                other, length = unit_rows(tree.raw[row[q, c]])
                exact = (scaled[q] * other).sum(axis=1) / (norm[q] * length)   # one order of additions for every pair
                good = exact >= bound[q] - 1e-9
                same = (other == scaled[q]).all(axis=1) & (length == norm[q])
                yield pd.DataFrame({"q": list(asked["v"].to_numpy()[q[good]]), "score": exact[good], "same": same[good],
                                    "ids": [tree.ids[r] for r in row[q, c][good]]})
    return run


def _placer(dim: int, nodes: list[tuple]):
    g = projection(dim)

    def run(batches):
        for frame in batches:
            scaled, norm = unit_rows(matrix(frame["v"], dim))
            p = (scaled / norm[:, None]) @ g
            yield frame.assign(cell=cell_of(nodes, p), p=list(p))
    return run


def _search(rows: DataFrame, queries: DataFrame, dim: int, k: int, parts: int) -> DataFrame:
    """(q, score, ids): the best points of the blocks to which queries (block, v,
    bound) were sent."""
    both = rows.select("block", F.lit(0).alias("kind"), "v", "ids", F.lit(0.0).alias("bound")).unionByName(
        queries.select("block", F.lit(1).alias("kind"), "v", F.array().cast("array<bigint>").alias("ids"), "bound"))
    element = rows.schema["v"].dataType.elementType.simpleString()
    return both.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInPandas(
        _searcher(dim, k), f"q array<{element}>, score double, same boolean, ids array<bigint>")


def _best_points(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best points of every query point."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for every
    row that fulfils ``queries`` (a condition on the columns id and v)."""
    spark = vectors.sparkSession
    rows = cut(valid(vectors, id_col, vector_col), "vectors")
    base = cut(points(rows, k + 1), "vector-points")
    size = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, cells = size["dim"], max(MIN_CELLS, -(-size["n"] // CELL_ROWS))
    sample = base.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toPandas()
    scaled, norm = unit_rows(matrix(sample["v"], dim))
    nodes = fit_cells((scaled / norm[:, None]) @ projection(dim), cells)
    kind = base.schema["v"].dataType.simpleString()

    placed = cut(base.mapInPandas(_placer(dim, nodes), f"v {kind}, ids array<bigint>, cell int, p array<double>"),
                 "vector-cells")
    # one row a cell, then one row and box a block: both small enough to broadcast
    fill = cut(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")), "vector-fill")
    part = F.pmod(F.xxhash64("v"), F.col("blocks")).alias("part")
    placed = placed.join(F.broadcast(fill), "cell").select("cell", part, "v", "ids", "p")
    edges = [f(F.col("p")[j]).alias(f"{n}{j}") for n, f in (("low", F.min), ("high", F.max)) for j in range(PROJECTED)]
    boxes = placed.groupBy("cell", "part").agg(*edges).orderBy("cell", "part").toPandas()
    low, high = (boxes[[f"{n}{j}" for j in range(PROJECTED)]].to_numpy() for n in ("low", "high"))
    blocks = F.broadcast(spark.createDataFrame(
        [(int(c), int(p), i) for i, (c, p) in enumerate(zip(boxes["cell"], boxes["part"]))], "cell int, part long, block int"))
    held = cut(placed.join(blocks, ["cell", "part"]).select("block", "v", "ids"), "vector-blocks")

    # queries of equal vectors are one search
    asked = cut(rows.filter(queries).select("id", "v"), "vector-queries")
    search = asked.select("v").distinct().mapInPandas(_placer(dim, nodes), f"v {kind}, cell int, p array<double>")
    search = search.join(F.broadcast(fill), "cell").select("cell", part, "v", "p")
    search = cut(search.join(blocks, ["cell", "part"], "left").select(F.coalesce("block", F.lit(0)).alias("block"), "v", "p"),
                 "vector-searches")
    home = cut(_best_points(_search(held, search.withColumn("bound", F.lit(UNKNOWN)), dim, k + 1, len(boxes)), k + 1), "vector-home")
    kth = home.groupBy("q").agg(F.when(F.count(F.lit(1)) == k + 1, F.min("score")).otherwise(UNKNOWN).alias("bound"))

    @F.pandas_udf("array<int>")
    def others(p: pd.Series, own: pd.Series, bound: pd.Series) -> pd.Series:
        near = box_distances(np.stack(p.to_list()), low, high) <= reach(bound.to_numpy())[:, None]
        near[np.arange(len(p)), own.to_numpy()] = False
        return pd.Series([np.flatnonzero(x).astype(np.int32) for x in near])

    sent = search.join(kth.withColumnRenamed("q", "v"), "v", "left").withColumn("bound", F.coalesce("bound", F.lit(UNKNOWN)))
    sent = sent.select("v", "bound", F.explode(others("p", "block", "bound")).alias("block"))
    away = _search(held, sent, dim, k + 1, len(boxes))
    found = cut(_best_points(home.drop("_n").unionByName(away), k + 1).groupBy("q").agg(
        F.collect_list(F.struct("score", "same", "ids")).alias("near")), "vector-found")       # k + 1 points at most
    pairs = attach(asked.withColumnRenamed("v", "q"), found, ["q"]).select("id", F.explode("near").alias("_p"))
    pairs = pairs.select(F.col("id").alias("query_id"), "_p.same", "_p.score", F.explode("_p.ids").alias("vec_id"))
    pairs = pairs.filter(~(F.col("same") & (F.col("vec_id") == F.col("query_id"))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
