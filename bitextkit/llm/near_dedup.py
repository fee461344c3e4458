"""Operator 6, near-duplicates by bottom-k sketches of one hash function.

1. A document's set is the hashes of its distinct word 5-grams; its sketch the
   ``K`` least ones.  Equal sets are folded first: their least id stands for
   all, so copies cost one row each from then on.
2. Inverted lists of retained values.  Two sets that are similar enough share
   many sketch values, so of a sketch only its rarest values need a list: with
   the values ordered by how many sketches hold them, the prefixes of two such
   sketches must meet (``need`` of them are shared; see :func:`needed`).
   Passages that many documents share are the frequent values and stay out.
3. Overlaps.  In every list each document meets the list's least id (its hub);
   the hub that it shares most lists with is its candidate.  So a group of near
   copies costs one candidate a member, not all pairs.
4. Candidates pass the size bound, then the union-sketch estimate, then the
   exact Jaccard of the full sets.
5. Links give components.  Where a list still holds several components, the
   pairs between different components that can be similar at all are found by
   the prefixes of the full sets (:func:`cross_pairs`) and tried as well: an
   exact finish, since a pair inside a component cannot change the result.

A link can only be missed when a sketch misjudges it: at the threshold itself
the shared values would have to fall ``SIGMAS`` standard deviations below their
mean (see :func:`safe_share`); sets that fit in a sketch are exact.

Defined results: null and empty texts and texts without words have an empty
set, are linked with nothing and are kept; texts under five words have one
shingle; a null id has the component null and is kept; rows that share an id
count as one document.  Other columns pass through :func:`drop_near_duplicates`.
Which text stands for an id that has several is not defined.  An empty table has no
components.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextkit.llm.common import cut, lower_az, packed, text_of, ws_words

WIDTH = 5
K = 64
SIGMAS = 5
BROADCAST_IDS = 500_000


def shingle_set(text: Column, width: int = WIDTH) -> tuple[Column, ...]:
    """Expressions for two projections in turn: words ``_w``, then the sorted set."""
    n = F.size("_w")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))),
                        lambda i: F.xxhash64(F.slice("_w", i, width)))
    return ws_words(lower_az(text)), F.when(n > 0, F.sort_array(F.array_distinct(grams))).otherwise(
        F.array().cast("array<bigint>"))


def with_set(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, set) from (doc_id, text)."""
    words, grams = shingle_set(F.col("_t"), width)
    return docs.select("doc_id", text_of().alias("_t")).select("doc_id", words.alias("_w")).select(
        "doc_id", grams.alias("set"))


def safe_share(percent: int, k: int) -> float:
    """Share of a union sketch that similar sets have in common all but surely."""
    p = percent / 100
    return p - SIGMAS * math.sqrt(p * (1 - p) / k)


def needed(n: Column, m: Column, percent: int, k: int) -> Column:
    """How many values two sketches must share: n set size, m sketch size."""
    whole = F.ceil(n * percent / F.lit(100))
    return F.when(n <= k * percent // 100, whole).otherwise(F.floor(m * safe_share(percent, k))).cast("int")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id of every component of ``links`` (a, b).  Least
    labels of neighbours and pointer jumping, until nothing changes; only the
    number of changes reaches the driver."""
    e = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
            "links")
    labels = cut(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")).select(
        "id", F.least("id", "label").alias("label")), "labels")
    step = 0
    while True:
        near = e.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("label").alias("near"))
        new = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = cut(new.join(jump, "label").select("id", F.least("label", "next").alias("label"), "old"), f"labels{step}")
        if not new.filter("label < old").limit(1).count():
            return new.select("id", "label")
        labels, step = new.select("id", "label"), step + 1


def linked(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) that are similar: size bound, union-sketch estimate,
    then the exact Jaccard of the full sets."""
    def side(t, column, name):
        return t.select(F.col("doc_id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in column])

    p = pairs.join(side(reps, ["n", "sketch"], "a"), "a").join(side(reps, ["n", "sketch"], "b"), "b")
    p = p.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    p = p.withColumn("_u", F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, k))
    p = p.withColumn("_x", F.size(F.array_intersect("_u", F.array_intersect("sketch_a", "sketch_b"))))
    p = p.filter(F.col("_x") >= F.floor(F.size("_u") * safe_share(percent, k))).select("a", "b", "n_a", "n_b")
    p = p.join(side(sets, ["set"], "a"), "a").join(side(sets, ["set"], "b"), "b")
    p = p.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("set_a", "set_b")).alias("x"))
    return p.filter(100 * F.col("x") >= percent * (F.col("n_a") + F.col("n_b") - F.col("x"))).select("a", "b")


def cross_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: every pair of documents of different components that can
    be similar, by the prefixes of their full sets.  ``sets``: doc_id, set, c.

    With the elements ordered by how many of these documents hold them, rarest
    first, the overlap that similarity asks for leaves no room beyond a short
    prefix: of the smaller set 2t / (1 + t), of the larger one t of the
    elements must be shared, and the first shared one lies in both prefixes.
    Elements of one document alone come first, so a document whose edits fill
    its prefix meets nobody.  Lists are paired by component first: members of
    one component never meet."""
    e = sets.select("doc_id", "c", F.size("set").alias("n"), F.explode_outer("set").alias("g"))
    often = e.groupBy("g").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    held = e.join(often, "g").groupBy("doc_id", "c", "n").agg(
        F.sort_array(F.collect_list(F.struct("f", "g"))).alias("xs"))          # at most the set
    n, alone = F.col("n"), F.col("n") - F.size("xs")
    long = n - F.ceil(n * percent / F.lit(100)).cast("int") + 1
    short = n - F.ceil(n * (2 * percent) / F.lit(100 + percent)).cast("int") + 1
    held = held.withColumns({"alone": alone, "short": short}).withColumn(
        "xs", F.slice("xs", F.lit(1), F.greatest(long - F.col("alone"), F.lit(0))))
    p = cut(held.select("doc_id", "c", "n", "alone", "short", F.posexplode_outer("xs").alias("i", "x"))
            .filter(F.col("x").isNotNull()).select(
                F.col("x.g").alias("g"), "doc_id", "c", "n", (F.col("alone") + F.col("i")).alias("i"),
                (F.col("alone") + F.col("i") < F.col("short")).alias("short")), "prefixes")
    keys = ["c", "n", "i"]
    small = p.filter("short").select("g", *[F.col(k).alias(f"{k}1") for k in keys], F.col("doc_id").alias("x"))
    large = p.select("g", *[F.col(k).alias(f"{k}2") for k in keys], F.col("doc_id").alias("y"))
    # members of a component with the same size and place are one row here; what
    # can still be shared behind the places must reach the overlap asked for
    meet = small.drop("x").distinct().join(large.drop("y").distinct(), "g").filter(
        f"c1 <> c2 and n1 <= n2 and 100 * n1 >= {percent} * n2 "
        f"and (100 + {percent}) * least(n1 - i1, n2 - i2) >= {percent} * (n1 + n2)")
    pairs = meet.join(small, ["g", "c1", "n1", "i1"]).join(
        large, ["g", "c2", "n2", "i2"]).filter("n1 < n2 or x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH, k: int = K,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; a link is
    100 * intersection >= ``percent`` * union."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = with_set(docs, width).select(
        "doc_id", F.size("set").cast("long").alias("n"), F.xxhash64("set").alias("s1"),
        F.hash("set").alias("s2"), F.slice("set", 1, k).alias("sketch"))
    d = cut(d, "sketches")
    # written, so that the join below has an exchange of its own and a large class can be split
    classes = cut(d.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("s1", "s2", "n").agg(
        F.min("doc_id").alias("rep")), "classes")
    members = d.drop("sketch").join(classes, ["s1", "s2", "n"], "left").select("doc_id", "n", "rep")
    reps = cut(d.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2", "n"), ["doc_id", "s1", "s2", "n"])
               .select("doc_id", "n", "sketch").dropDuplicates(["doc_id"]), "representatives")

    values = reps.select("doc_id", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    held = values.join(shared, "v").groupBy("doc_id", "n", "m").agg(
        F.sort_array(F.collect_list(F.struct("f", "v"))).alias("vs"))             # at most k
    need = needed(F.col("n"), F.col("m"), percent, k)
    held = held.withColumn("need", need).filter(F.size("vs") >= F.col("need"))
    # values held by nobody else come first in the prefix of m - need + 1
    lists = cut(held.select("doc_id", F.explode(F.slice("vs", F.lit(1), F.size("vs") - F.col("need") + 1)).alias("x"))
                .select("doc_id", F.col("x.v").alias("v")), "inverted-lists")
    ids = cut(lists.select("doc_id").distinct(), "candidate-ids")
    small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = cut(with_set(docs.join(small, "doc_id", "left_semi"), width).dropDuplicates(["doc_id"]), "sets")

    hubs = lists.groupBy("v").agg(F.min("doc_id").alias("hub"))
    first = lists.join(hubs, "v").filter("doc_id <> hub").groupBy("doc_id", "hub").agg(F.count(F.lit(1)).alias("c"))
    first = cut(first.groupBy("doc_id").agg(F.max(F.struct("c", (-F.col("hub")).alias("h"))).alias("x")).select(
        (-F.col("x.h")).alias("a"), F.col("doc_id").alias("b")), "hub-pairs")
    links = cut(linked(first, reps, sets, percent, k), "hub-links")
    found = components(links)

    # what is left: pairs of different components that share a list
    place = lists.join(found.select(F.col("id").alias("doc_id"), "label"), "doc_id", "left").select(
        "v", "doc_id", F.coalesce("label", "doc_id").alias("c"))
    mixed = place.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    doubt = place.join(mixed.select("v"), "v").select("doc_id", "c").distinct()
    rest = cross_pairs(sets.join(doubt, "doc_id"), percent)
    rest = rest.join(first, ["a", "b"], "left_anti")
    more = cut(linked(rest, reps, sets, percent, k), "rest-links")
    labels = components(links.unionByName(more))
    out = members.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are not the least id of their component."""
    gone = cut(near_duplicates(docs, percent, id_col=id_col, text_col=text_col).filter("not kept").select(
        F.col("doc_id").alias("_gone_id")).distinct(), "near-duplicates")
    rows = packed(docs, id_col, text_col).drop("text")
    return rows.join(gone, F.col("doc_id") == F.col("_gone_id"), "left_anti").select("_row.*")
