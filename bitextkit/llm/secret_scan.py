"""Operator 2, secret scans by two character Markov models.

Labelled samples train two first-order models over the characters a key may
hold: ``random`` strings (values that the plain rules found in the sample
documents, and digests of document ids written in hex and base64) and
``ordinary`` ones (the distinct words of the sample documents).  A candidate -
16 or more key characters with a digit among them - is a secret if the
log-likelihood ratio of the models exceeds ``min_llr``.  The plain rules'
findings (assignments, access keys, long hex) always stay.

The training sample is bounded (``train_docs`` documents, drawn by a hash of
the id); its bigram counts are at most 2 x 66^2 rows, which become a constant.
The scan itself is map-only: expressions over one row, no Python.

Defined results: a null text is empty and has no spans; repeated rows are
scanned one by one; an empty sample leaves both models uniform, so the method
adds nothing; an empty table has no rows; a very long text is scanned whole, in time
linear in its matches; only the id and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextkit.llm.common import WS_RUN, text_of
from bitextkit.llm.license_scan import match_spans

# The plain rules.
ASSIGN = ("(?i:(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
          "([A-Za-z0-9+/_.=-]+))")
ASSIGN_MIN = 6
ACCESS = "AKIA[A-Z0-9]{16,}"       # AKIA[A-Z0-9]+ of 20 or more: the greedy run decides both
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
KEY = "A-Za-z0-9+/_="
CANDIDATE = f"(?<![{KEY}])(?=[A-Za-z+/_=]*+[0-9])[{KEY}]{{16,}}"
TRAIN_DOCS = 5_000
MIN_LLR = 8.0
SMOOTH = 0.5


def plain_spans(text: Column) -> Column:
    """(s, k, e) of the plain rules, ordered by start and rule."""
    def tag(spans, k):
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.filter(F.zip_with(match_spans(text, F.lit(ASSIGN)), value,
                                 lambda x, v: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.length(v).alias("n"))),
                      lambda x: x["n"] >= ASSIGN_MIN)
    return F.array_sort(F.concat(tag(assign, 0), tag(match_spans(text, F.lit(ACCESS)), 1),
                                 tag(match_spans(text, F.lit(HEX)), 2)))


def training_strings(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(token, random) labelled samples from at most about ``train_docs`` documents."""
    n = docs.count()
    sample = docs.select("doc_id", text_of().alias("_t")).filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, train_docs / max(n, 1))))
    rows = sample.select(
        F.concat(F.transform(F.concat(F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2)),
                                      F.regexp_extract_all("_t", F.lit(ACCESS), F.lit(0)),
                                      F.regexp_extract_all("_t", F.lit(HEX), F.lit(0)),
                                      F.array(F.base64(F.unhex(F.sha2(F.col("doc_id").cast("string"), 256))),
                                              F.md5(F.col("doc_id").cast("string")))),
                             lambda x: F.struct(x.alias("token"), F.lit(True).alias("random"))),
                 F.transform(F.split("_t", "[^" + KEY + "]+"),
                             lambda x: F.struct(x.alias("token"), F.lit(False).alias("random")))).alias("x"))
    return rows.select(F.inline("x")).filter(F.length("token") >= 4).distinct()


def ratio_table(strings: DataFrame) -> list[float]:
    """log P_random(b | a) - log P_ordinary(b | a) for every pair of alphabet
    places (0 for any other character), row by row.  Collects at most 2 x 66^2
    counts."""
    size = len(ALPHABET) + 1
    pairs = strings.select("random", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substr("token", i, F.lit(2)))).alias("ab"))
    counts = pairs.groupBy("random", "ab").count().select(
        "random", F.instr(F.lit(ALPHABET), F.substring("ab", 1, 1)).alias("a"),
        F.instr(F.lit(ALPHABET), F.substring("ab", 2, 1)).alias("b"), "count")
    table = {True: [[SMOOTH] * size for _ in range(size)], False: [[SMOOTH] * size for _ in range(size)]}
    for r in counts.groupBy("random", "a", "b").agg(F.sum("count").alias("n")).collect():
        table[r["random"]][r["a"]][r["b"]] += r["n"]
    out = []
    for a in range(size):
        rand, plain = table[True][a], table[False][a]
        out += [math.log(rand[b] / sum(rand)) - math.log(plain[b] / sum(plain)) for b in range(size)]
    return out


def _llr(token: Column, table: Column) -> Column:
    size = len(ALPHABET) + 1
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.aggregate(
        places, F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("sum")),
        lambda acc, p: F.struct(
            p.alias("at"),
            F.when(acc["at"] < 0, acc["sum"]).otherwise(
                acc["sum"] + F.get(table, acc["at"] * size + p)).alias("sum")))["sum"]


def scan_secrets(docs: DataFrame, ratios: list[float], min_llr: float = MIN_LLR,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<s,k,e>>``: positions in code points, end
    exclusive, ``k`` the place in :data:`KINDS`, by start then kind."""
    t = F.col("_t")
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"))
    d = d.select("doc_id", "_t",
                 F.when(t.rlike(f"(?i:password|passwd|secret|token|api_?key)|AKIA|{HEX}"), plain_spans(t))
                 .otherwise(none).alias("_base"),
                 F.when(t.rlike(CANDIDATE), match_spans(t, F.lit(CANDIDATE)))
                 .otherwise(F.array().cast("array<struct<s:int,e:int>>")).alias("_c"))
    free = F.filter("_c", lambda c: ~F.exists("_base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    added = F.transform(
        F.filter(free, lambda c: _llr(F.substr(t, c["s"] + 1, c["e"] - c["s"]), table) >= min_llr),
        lambda c: F.struct(c["s"].alias("s"), F.lit(KINDS.index("markov")).alias("k"), c["e"].alias("e")))
    return d.select("doc_id", F.array_sort(F.concat("_base", added)).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(F.array(*map(F.lit, KINDS)), x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_report(docs: DataFrame, train_docs: int = TRAIN_DOCS, min_llr: float = MIN_LLR) -> DataFrame:
    """Digest of :func:`scan_secrets` with models trained on ``docs``."""
    found = scan_secrets(docs, ratio_table(training_strings(docs, train_docs)), min_llr)

    def n(kind):
        return F.size(F.filter("spans", lambda x: x["k"] == KINDS.index(kind))).cast("long")

    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(spans_text(F.filter("spans", lambda x: x["k"] < KINDS.index("markov"))), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"), n("markov").alias("n_markov"))
