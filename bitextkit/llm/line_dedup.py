"""Operator 7, line dedup with a log-template tree.

Every line is parsed to a fixed depth: words with a digit become ``<*>``; the
first levels of the tree are the number of tokens and the leading ``LEAD``
tokens, which are never generalised; the rest is cut into ``PARTS`` parts, and
a line stands under its exact template and, if it is long enough, under each
template that leaves one part variable.  So lines that differ in one region
only meet at one node without being compared pairwise.

A template recurs if it stands in two unrelated documents; then its lines are
dropped from every document but the first one (least id).  Copies and near
copies of a document are no boilerplate - the near-duplicate operator has to
see them: two documents are related if the word pairs of their lines have a
Jaccard similarity of ``RELATED`` or more, told from bottom-``SKETCH`` sketches
(exact for documents of up to ``SKETCH`` distinct pairs).  Documents of equal
sketch are folded first; a template recurs if any document that holds it is
unrelated to the one of least sketch hash.  How many copies there are, and how
many documents in all, plays no part.

Scale: one shuffle of (template hash, sketch hash, id) with map-side
combination, so a line that a third of all documents hold is one row a task.
The least and the greatest sketch hash decide most templates; only the
templates whose two extremes are related are joined to all their documents.
Sketches meet in distinct pairs, two a template or one a document and
reference; recurring templates are broadcast below a counted bound, else joined
by a shuffle; texts are shuffled once, to meet their dropped lines.

Defined results: null and empty texts have no lines and pass unchanged (null
stays null); lines under ``MIN_TOKENS`` tokens are never dropped; rows equal in
id and text count once and are treated alike; other columns pass through; an empty
table stays empty.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextkit.llm.common import SALTS, attach, cut, packed, text_of

MIN_TOKENS = 3
RELATED = 0.7
SKETCH = 128                     # word pairs kept of a document: four bytes each
LEAD = 2
PARTS = 3
MIN_PART = 2                     # least tokens in the tail for each part
MAX_BROADCAST = 500_000          # recurring templates: two longs each
HOT_KEY = 256                    # pairs of one sketch hash beyond which they are dealt out by salt
OTHER_WS = "[\\x09\\x0B-\\x0D]"    # white space beside space and line feed
VARIABLE = "(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D0-9]*+[0-9][^\\x20\\x09-\\x0D]*+"


def mask(line: Column) -> Column:
    """Words with a digit become the variable token."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, "<*>")).otherwise(line)


def line_tokens(line: Column) -> Column:
    """Hashes of a line's words, words with a digit alike; ``line`` has spaces
    as its only white space."""
    return F.transform(F.array_remove(F.split(mask(line), " "), ""), lambda x: F.xxhash64(x))


def part_hashes(tokens: Column) -> Column:
    """Hashes of the leading tokens and of each part of the rest, so that every
    token is read once however many templates a line stands under."""
    tail = F.size(tokens) - LEAD

    def part(p):
        a, b = ((tail * x / PARTS).cast("int") for x in (p, p + 1))
        return F.xxhash64(F.slice(tokens, LEAD + 1 + a, b - a))

    return F.array(F.xxhash64(F.slice(tokens, 1, LEAD)), *[part(p) for p in range(PARTS)])


def template_keys(n: Column, parts: Column) -> Column:
    """Hashes of the templates a line of ``n`` tokens stands under, from its
    ``part_hashes``: the exact one first, then one for each variable part.  Every
    hash covers the token count and the leading tokens."""
    def key(p):
        return F.xxhash64(F.lit(p), n, *[F.get(parts, F.lit(i)) for i in range(PARTS + 1) if i != p + 1])

    return F.when(n - LEAD >= PARTS * MIN_PART, F.array(key(-1 - PARTS), *[key(p) for p in range(PARTS)])).otherwise(
        F.array(key(-1 - PARTS)))


def parsed_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, th, lines of (line, keys), sketch, sig) of every document, the
    lines those of ``MIN_TOKENS`` tokens or more.  No filter on the lines may
    stand here: Spark would push it below and parse every text for it as well."""
    # looking for a character is much cheaper than a pattern, and few texts hold one
    other = reduce(or_, [F.contains(F.col("_t"), F.lit(c)) for c in "\x09\x0b\x0c\x0d"])
    spaced = F.when(other, F.regexp_replace("_t", OTHER_WS, " ")).otherwise(F.col("_t"))
    d = docs.select("doc_id", text_of().alias("_t")).select(
        "doc_id", F.xxhash64("_t").alias("th"), F.split(spaced, "\n").alias("_l"))
    d = d.select("doc_id", "th", F.filter(
        F.transform("_l", lambda x, i: F.struct(i.alias("line"), line_tokens(x).alias("w"))),
        lambda s: F.size(s["w"]) >= MIN_TOKENS).alias("_l"))
    pairs = F.flatten(F.transform("_l", lambda s: F.zip_with(
        F.slice(s["w"], F.lit(1), F.size(s["w"]) - 1), F.slice(s["w"], F.lit(2), F.size(s["w"]) - 1),
        lambda a, b: F.hash(a, b))))
    parts = F.transform("_l", lambda s: F.struct(
        s["line"].alias("line"), F.size(s["w"]).alias("n"), part_hashes(s["w"]).alias("p")))
    d = d.select("doc_id", "th", F.transform(parts, lambda s: F.struct(
        s["line"].alias("line"), template_keys(s["n"], s["p"]).alias("keys"))).alias("lines"),
        F.slice(F.sort_array(F.array_distinct(pairs)), 1, SKETCH).alias("sketch"))
    return d.withColumn("sig", F.xxhash64("sketch"))


def related(a: Column, b: Column) -> Column:
    """Whether the sets of two bottom-k sketches have a Jaccard similarity of ``RELATED``."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) >= F.size(union) * F.lit(RELATED)


def with_sketch(rows: DataFrame, pairs: DataFrame, sketches: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` (s1, s2) with the sketch of their ``key`` as ``name``.  A line
    that many documents share gives its least or greatest sketch hash to very
    many pairs: such keys, found by a count over the written ``pairs``, are
    dealt out by a salt, for which their one sketch is repeated."""
    hot = cut(pairs.groupBy(key).count().filter(F.col("count") > HOT_KEY).select(key, F.lit(True).alias("_hot")),
              "hot-sketches")
    side = attach(sketches.select(F.col("sig").alias(key), F.col("sketch").alias(name)), hot, [key], "left")
    side = side.withColumn("_part", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1)))
                                              .otherwise(F.array(F.lit(0))))).drop("_hot")
    rows = attach(rows, hot, [key], "left").withColumn("_part", F.when(
        F.col("_hot"), F.pmod(F.xxhash64("s1", "s2"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    return rows.join(side, [key, "_part"]).drop("_part")


def unrelated_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (s1, s2: sketch hashes) whose documents are unrelated."""
    p = cut(pairs.distinct(), "sketch-pairs")
    p = with_sketch(p, p, sketches, "s2", "_b")
    p = with_sketch(p, p, sketches, "s1", "_a")
    return p.filter(~related(F.col("_a"), F.col("_b"))).select("s1", "s2")


def recurring(docs: DataFrame) -> DataFrame:
    """(k, first_id): templates of ``docs`` (of :func:`parsed_docs`) that stand
    in two unrelated documents."""
    seen = docs.select("doc_id", "sig", F.explode(F.array_distinct(F.flatten("lines.keys"))).alias("k"))
    t = cut(seen.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.min("sig").alias("s1"), F.max("sig").alias("s2"))
            .filter(F.col("s1") != F.col("s2")), "shared-templates")
    sketches = docs.select("sig", "sketch").dropDuplicates(["sig"])
    apart = cut(unrelated_pairs(t.select("s1", "s2"), sketches), "unrelated-extremes")
    t = cut(t.join(apart.withColumn("_apart", F.lit(True)), ["s1", "s2"], "left"), "judged-templates")
    sure, rest = t.filter("_apart").select("k", "first_id"), t.filter("_apart IS NULL").select("k", "first_id", "s1")
    # the rest: every document against the one of least sketch hash
    held = attach(seen.select("k", F.col("sig").alias("s2")), cut(rest, "doubtful-templates"), ["k"])
    held = cut(held.filter(F.col("s1") != F.col("s2")).select("k", "first_id", "s1", "s2").distinct(), "template-holders")
    apart = unrelated_pairs(held.select("s1", "s2"), sketches)
    return sure.unionByName(held.join(apart, ["s1", "s2"], "left_semi").select("k", "first_id").distinct())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines cut out of the text, plus ``_n_lines``
    and ``_n_dropped``; all rows stay."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parsed = cut(parsed_docs(d), "lines").filter(F.size("lines") > 0)
    often = cut(recurring(parsed), "line-templates")
    if often.count() <= MAX_BROADCAST:
        often = F.broadcast(often)
    lines = parsed.select("doc_id", "th", F.explode("lines").alias("_l")).select(
        "doc_id", "th", "_l.line", F.explode("_l.keys").alias("k"))
    gone = lines.join(often, "k").filter(
        ~F.col("doc_id").eqNullSafe(F.col("first_id")))
    gone = gone.groupBy(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")).agg(
        F.collect_set("line").alias("_gone"))
    text = F.col("text")
    names = [c for c in docs.columns if c != text_col]
    rows = packed(docs, id_col, text_col).withColumn("_row", F.struct(*[F.col(f"_row.`{c}`").alias(c) for c in names]))
    out = rows.join(gone.hint("shuffle_hash"), (F.xxhash64(text_of()) == F.col("_gone_th"))
                                              & F.col("doc_id").eqNullSafe(F.col("_gone_id")), "left")
    out = out.withColumn("_l", F.split(text, "\n"))
    out = out.withColumn("_n", F.when(text.isNull() | (text == ""), 0).otherwise(F.size("_l")))
    some = F.col("_gone").isNotNull()
    out = out.withColumn("_kept", F.when(some, F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), "_gone")))
    new = F.when(some, F.array_join(F.transform("_kept", lambda i: F.get("_l", i)), "\n")).otherwise(text)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], new.alias(text_col),
                      F.col("_n").alias("_n_lines"), F.when(some, F.size("_gone")).otherwise(0).alias("_n_dropped"))


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"),
                      F.col("_n_dropped").cast("long").alias("n_dropped"), "text")
