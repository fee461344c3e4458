"""Operator 4, quality rules by robust multivariate outliers.

Per document a handful of statistics is computed inside its row.  Documents
that fail the plain rules are rejected outright; the statistics of the others
are transformed (ratios shrunk for short texts, logarithms), written as
fixed-point integers, and every group - a language and source, or what is left
of small ones - gets a minimum-covariance-determinant estimate of location and
scatter: from the medians and quartiles, concentration steps keep the
``KEEP`` share of documents that lie closest and estimate anew.  A document is
rejected if its Mahalanobis distance, scaled so that the median distance of
its group agrees with the chi-squared median, exceeds ``CUT``.

Scale: texts are read twice and never shuffled; the steps run over one narrow
row a document.  Sums are exact decimals and quantiles come from integer
histograms, so the estimates depend neither on partitioning nor on task order.
Group tables are broadcast only below a counted bound, else joined with salted
keys, since one source may hold a third of the rows.

Defined results: a null text has no words and fails the plain rules; null
languages and sources form groups of their own; repeated rows get the same
verdict; a pool of fewer than ``MIN_GROUP`` documents rejects none; other
columns (whatever their names) pass through :func:`filter_quality`; an empty table
has no verdicts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextkit.llm.common import WS_RUN, attach, cut, text_of, ws_words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 20, 30          # plain rules: words; percent of words in repeated windows
KEEP = 0.75                             # share of a group that the estimate is made of
STEPS = 3
MIN_GROUP = 100
CHI2_MEDIAN = 4.3515                    # chi-squared, 5 degrees of freedom
CUT = 45.0                              # far beyond its 0.9999 quantile (25.7): clean documents stay
SCALE = 1024
#: name -> least standard deviation: what counts as no spread at all
FEATURES = {"f_word": 0.10, "f_symbol": 0.50, "f_lines": 0.10, "f_repeat": 0.10, "f_upper": 0.04}
NAMES = list(FEATURES)
P = len(NAMES)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the struct ``_q`` of statistics; no shuffle."""
    t = text_of(text_col)
    words = ws_words(F.col("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    own = list(docs.columns)
    d = docs.withColumn("_t", t)
    d = d.withColumns({"_w": words, "_l": lines})
    n = F.size("_w")
    d = d.withColumns({
        "_n": n,
        "_chars": F.length(F.regexp_replace("_t", WS_RUN, "")),
        "_sym": F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")),
        "_up": F.length(F.regexp_replace("_t", "[^A-Z]+", "")),
        "_nl": F.size("_l"), "_dup": F.size("_l") - F.size(F.array_distinct("_l")),
        "_h": F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))),
                                             lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))),
    }).drop("_w", "_l", "_t")
    # only a text with an equal pair of windows needs their places
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(
        F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("_h")
    twice = F.filter("_s", lambda e, i: F.get("_s", i + 1)["x"].eqNullSafe(e["x"])
                     | F.get("_s", i - 1)["x"].eqNullSafe(e["x"]))
    d = d.withColumn("_p", F.array_sort(F.transform(twice, lambda e: e["i"]))).drop("_s")
    covered = F.aggregate(
        F.coalesce("_p", F.array().cast("array<int>")),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"),
                              (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")))["n"]
    d = d.withColumn("_rep", covered).drop("_p")
    nw, chars, rep = F.col("_n"), F.col("_chars"), F.col("_rep")
    raw = {
        "f_word": F.log((chars + 100) / (nw + 20)),
        "f_symbol": F.log1p(F.lit(1000.0) * F.col("_sym") / (chars + 200)),
        "f_lines": F.col("_dup") / (F.col("_nl") + 5),
        "f_repeat": rep / (nw + 50),
        "f_upper": F.col("_up") / (chars + 100),
    }
    failed = (nw < MIN_WORDS) | (100 * rep > MAX_REPEAT * nw)
    return d.select(*[F.col(f"`{c}`") for c in own], F.struct(
        nw.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
        F.col("_sym").cast("long").alias("n_symbols"), F.col("_dup").cast("long").alias("n_dup_lines"),
        rep.cast("long").alias("n_repeat_words"), failed.alias("base_failed"),
        *[F.round(x * SCALE).cast("int").alias(k) for k, x in raw.items()]).alias("_q"))


def _group_of(lang: str, source: str) -> tuple[Column, Column]:
    return (F.coalesce(F.col(lang).cast("string"), F.lit("\x00")),
            F.coalesce(F.col(source).cast("string"), F.lit("\x00")))


def group_table(rows: DataFrame) -> DataFrame:
    """(_lang, _source, g): the group of each language and source.  Small ones
    are pooled by language, and pools that stay small into one."""
    sizes = rows.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    pool = sizes.filter(F.col("n") < MIN_GROUP).groupBy("_lang").agg(F.sum("n").alias("pooled"))
    return sizes.join(pool, "_lang", "left").select(
        "_lang", "_source",
        F.when(F.col("n") >= MIN_GROUP, F.concat_ws("\x01", F.lit("s"), "_lang", "_source"))
        .when(F.col("pooled") >= MIN_GROUP, F.concat_ws("\x01", F.lit("l"), "_lang"))
        .otherwise(F.lit("all")).alias("g"))


def _precision(d: DataFrame) -> DataFrame:
    """Means ``m_i`` and covariances ``c_i_j`` -> ``m_i`` and the entries
    ``p_i_j`` of the inverse covariance matrix, by its Cholesky factor L: first
    L, then its inverse W column by column, then W'W.  One row a group."""
    def less(terms, first):
        return reduce(lambda a, b: a - b, terms, first)

    for j in range(P):
        d = d.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(
            less([F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.col(f"c_{j}_{j}")),
            F.lit(1e-3 * (SCALE * FEATURES[NAMES[j]]) ** 2))))
        for i in range(j + 1, P):
            d = d.withColumn(f"l_{i}_{j}", less(
                [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.col(f"c_{i}_{j}")) / F.col(f"l_{j}_{j}"))
    for j in range(P):
        for i in range(j, P):
            d = d.withColumn(f"w_{i}_{j}", (F.lit(1.0) if i == j else less(
                [F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)], F.lit(0.0))) / F.col(f"l_{i}_{i}"))
    return d.select("g", *[F.col(f"m_{i}") for i in range(P)], *[
        reduce(lambda a, b: a + b, [F.col(f"w_{k}_{i}") * F.col(f"w_{k}_{j}") for k in range(i, P)]).alias(f"p_{i}_{j}")
        for i in range(P) for j in range(i + 1)])


def _distance(d: DataFrame, feature=lambda k: F.col(k)) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance."""
    off = [feature(k) - F.col(f"m_{i}") for i, k in enumerate(NAMES)]
    d2 = reduce(lambda a, b: a + b, [off[i] * off[j] * F.col(f"p_{i}_{j}") * (1.0 if i == j else 2.0)
                                     for i in range(P) for j in range(i + 1)])
    return d.withColumn("d2", d2).drop(*[f"m_{i}" for i in range(P)],
                                       *[f"p_{i}_{j}" for i in range(P) for j in range(i + 1)])


def _bin() -> Column:
    """1/64 octave bins of 1 + d2: some 2,000 at most."""
    return F.floor(F.lit(64.0) * F.log2(F.lit(1.0) + F.least(F.col("d2"), F.lit(1e9)))).cast("int")


def _quantile_bin(rows: DataFrame, share: float) -> DataFrame:
    """(g, top): the least bin that holds ``share`` of a group's documents."""
    hist = rows.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g").orderBy("bin")
    return hist.select("g", "bin", F.sum("n").over(w).alias("upto"),
                       F.sum("n").over(Window.partitionBy("g")).alias("all")).filter(
        F.col("upto") >= F.lit(share) * F.col("all")).groupBy("g").agg(F.min("bin").alias("top"))


def estimate(rows: DataFrame, steps: int = STEPS, keep: float = KEEP) -> DataFrame:
    """MCD estimates of every group of ``rows`` (g and the features):
    ``g, m_i, p_i_j, scale``; groups under ``MIN_GROUP`` have none."""
    quart = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[
        F.percentile(F.floor(F.col(k) / 16), [0.25, 0.5, 0.75]).alias(k) for k in NAMES])
    start = quart.filter(F.col("n") >= MIN_GROUP).select(
        "g", *[(F.col(k)[1] * 16 + 8).alias(f"m_{i}") for i, k in enumerate(NAMES)],
        *[(F.pow((F.col(NAMES[i])[2] - F.col(NAMES[i])[0]) * 16 / 1.349, F.lit(2.0))
           + (SCALE * FEATURES[NAMES[i]]) ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}")
          for i in range(P) for j in range(i + 1)])
    params = cut(_precision(start), "mcd-start")
    dec = "decimal(20,0)"
    for step in range(steps):
        near = _distance(attach(rows, params, ["g"])).withColumn("bin", _bin())
        best = attach(near, cut(_quantile_bin(near, keep), f"mcd-bins{step}"), ["g"]).filter(
            F.col("bin") <= F.col("top"))
        sums = best.groupBy("g").agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            *[F.sum(F.col(k).cast(dec)).cast("double").alias(f"s_{i}") for i, k in enumerate(NAMES)],
            *[F.sum((F.col(NAMES[i]).cast("long") * F.col(NAMES[j])).cast(dec)).cast("double").alias(f"s_{i}_{j}")
              for i in range(P) for j in range(i + 1)])
        params = cut(_precision(sums.select(
            "g", *[(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(P)],
            *[(F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n") / F.col("n")
               + F.lit((SCALE * FEATURES[NAMES[i]]) ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}")
              for i in range(P) for j in range(i + 1)])), f"mcd-step{step}")
    near = _distance(attach(rows, params, ["g"])).withColumn("bin", _bin())
    middle = _quantile_bin(near, 0.5).select(
        "g", F.greatest(F.lit(1.0), (F.pow(F.lit(2.0), (F.col("top") + 1) / 64) - 1) / CHI2_MEDIAN).alias("scale"))
    return cut(params.join(middle, "g"), "mcd")


def _fit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with _lang, _source, base_failed and the features -> the group
    table and the estimates."""
    good = rows.filter(~F.col("base_failed")).select("_lang", "_source", *NAMES)
    groups = cut(group_table(good), "quality-groups")
    return groups, estimate(attach(good, groups, ["_lang", "_source"]).select("g", *NAMES))


def _verdict(rows: DataFrame, groups: DataFrame, params: DataFrame, failed: Column,
             feature=lambda k: F.col(k)) -> DataFrame:
    """Adds ``_kept``."""
    d = attach(attach(rows, groups, ["_lang", "_source"], how="left"), params, ["g"], how="left")
    # the id keeps a filter on the verdict above the statistics, which would
    # else be written into its condition once for every mention
    d = _distance(d, feature).withColumn("_row_no", F.monotonically_increasing_id())
    return d.withColumn("_kept", ~failed & (F.col("d2").isNull() | (F.col("d2") <= F.lit(CUT) * F.col("scale"))))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a document: its statistics, ``base_failed`` and ``kept``."""
    lang, source = _group_of(lang_col, source_col)
    d = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                                    lang.alias("_lang"), source.alias("_source")))
    rows = cut(d.select("doc_id", "_lang", "_source", "_q.*"), "quality")
    out = _verdict(rows, *_fit(rows), F.col("base_failed"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", F.col("_kept").alias("kept"), F.round("d2", 4).alias("distance"))


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                   source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are."""
    lang, source = _group_of(lang_col, source_col)
    # the statistics are computed once and written beside the rows they are of
    rows = cut(with_statistics(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("text"),
        lang.alias("_lang"), source.alias("_source"))).drop("text"), "quality")
    groups, params = _fit(rows.select("_lang", "_source", "_q.base_failed", *[f"_q.{k}" for k in NAMES]))
    out = _verdict(rows, groups, params, F.col("_q.base_failed"), lambda k: F.col(f"_q.{k}"))
    return out.filter(F.col("_kept") & (F.col("_row_no") >= 0)).select("_row.*")
