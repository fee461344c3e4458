"""Operator 5, toxicity by a weighted lexicon.

Terms and weights are learned from labelled documents: a word, or the first
four to six letters of words (which covers inflected and compounded forms), is
a term if it stands in enough toxic documents and in next to no others; its
weight is the smoothed log odds.  A few written terms start the lexicon.  Texts
are folded (case, look-alike letters, digits and signs that stand for letters),
one Aho-Corasick automaton finds terms and exception phrases in a single pass,
hits inside an exception phrase are dropped, and the summed weight and its
share of the length go through a logistic curve fitted on the same labels.

The training sample is bounded: ``MAX_TRAIN`` labelled documents, drawn by a
hash of the id; the lexicon has ``MAX_TERMS`` terms at most.  Scoring is
map-only, and uses nothing but the text.

Defined results: null and empty texts have no hits and get the least score;
null labels and labels of unknown documents are not used; without both labels
the written terms and a fixed curve are used; repeated rows are scored one by
one; an empty table has no scores; a very long text is one pass of the automaton;
only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextkit.llm.common import id_bucket, text_of, worker_cache

MAX_TRAIN = 20_000
MAX_TERMS = 3_000
MIN_TOXIC_DOCS = 8
MIN_LOG_ODDS = 4.0
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

# Terms that start the lexicon, and phrases in which they are harmless.
START = {"idiot": 4.0, "moron": 4.0, "stupid": 3.5, "scum": 4.0, "loser": 3.5, "trash": 3.0, "pathetic": 3.5,
         "worthless": 3.5, "disgusting": 3.0, "clown": 3.0, "imbecile": 4.0, "filth": 3.0, "vermin": 3.5}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "clown nose",
              "pond scum", "scum line", "sore loser rule", "loser bracket", "village idiot savant", "idiot proof")
# Letters of other scripts that look like Latin ones, and signs for letters.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕһԁοαρνικτɡɪı",
    "aeopcyxijshdoapviktgii")
SIGNS = str.maketrans("0134578@$!|", "oieastbasil")
# the signs may stand inside a word or before it, and after it only as digits
DISGUISED = re.compile(r"(?<![^\W\d_])[0134578@$!|]*[^\W\d_]+(?:[0134578@$!|]+[^\W\d_]+|[0134578]+)+"
                       r"|(?<![\w@$!|])[0134578@$!|]+[^\W\d_]+")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Folded words between single spaces, with a space at both ends."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(HOMOGLYPHS)
    t = DISGUISED.sub(lambda m: m[0].translate(SIGNS), t)
    return " " + NOT_LETTERS.sub(" ", t).strip() + " "


class Lexicon:
    """Terms (``=word`` or ``^prefix`` -> weight) and exception phrases."""

    def __init__(self, terms: dict[str, float], exceptions=EXCEPTIONS):
        import ahocorasick
        self.a = ahocorasick.Automaton()
        for term, weight in terms.items():
            key = f" {term[1:]} " if term[0] == "=" else f" {term[1:]}"
            old = self.a.get(key, None)
            self.a.add_word(key, (len(key), max(weight, old[1] if old else 0.0)))
        for phrase in exceptions:
            self.a.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.a.make_automaton()

    def hits(self, text: str) -> tuple[float, int]:
        """(summed weight of the words with a hit, words)."""
        t = fold(text)
        words: dict[int, float] = {}
        harmless = []
        for end, (n, weight) in self.a.iter(t):
            at = end - n + 1
            if weight is None:
                harmless.append((at, end))
            elif weight > words.get(at, 0.0):
                words[at] = weight
        for a, b in harmless:
            for at in [x for x in words if a <= x < b]:
                del words[at]
        return sum(words.values()), t.count(" ") - 1 if len(t) > 2 else 0


def training_documents(docs: DataFrame, labels: DataFrame, mod: int = 4, held_out: int = 2,
                       max_train: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of at most about ``max_train`` labelled documents outside
    the held-out fold."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                          & (id_bucket(mod) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_train / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")


def learn_terms(train: DataFrame) -> dict[str, float]:
    """At most ``MAX_TERMS`` terms with weights, the written ones included."""
    counts = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    out = {"=" + w: x for w, x in START.items()}
    if not pos or not neg:
        return out
    words = F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))
    terms = train.select("toxic", words.alias("w")).select("toxic", F.explode(F.array_distinct(F.concat(
        F.transform("w", lambda w: F.concat(F.lit("="), w)),
        *[F.transform(F.filter("w", lambda w, n=n: F.length(w) >= n),
                      lambda w, n=n: F.concat(F.lit("^"), F.substring(w, 1, n))) for n in PREFIXES]))).alias("term"))
    found = terms.groupBy("term").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (neg + 1))
    best = found.filter((F.col("p") >= MIN_TOXIC_DOCS) & (F.length("term") > 2)).withColumn("w", odds).filter(
        F.col("w") >= MIN_LOG_ODDS).orderBy(F.desc("p"), "term").limit(MAX_TERMS)
    out.update({r["term"]: min(float(r["w"]), 8.0) for r in best.select("term", "w").collect()})
    return out


def hits_udf(terms: dict[str, float], exceptions=EXCEPTIONS):
    key = ("toxic", tuple(sorted(terms.items())), tuple(exceptions))

    @F.pandas_udf("weight double, words long")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexicon = worker_cache(key, lambda: Lexicon(terms, exceptions))
        for texts in batches:
            yield pd.DataFrame([lexicon.hits(t) for t in texts], columns=["weight", "words"])
    return hits


def features(weight, words, lib=math):
    return lib.log1p(weight), lib.log1p(1000.0 * weight / (words + 50))


def fit_curve(rows: list[tuple[float, float, int]], ridge: float = 1.0, steps: int = 30) -> list[float]:
    """Logistic regression by Newton steps on (x1, x2, label)."""
    y = np.array([r[2] for r in rows], float)
    if len(set(y)) < 2:
        return [-4.0, 2.0, 0.5]
    x = np.column_stack([np.ones(len(rows)), np.array([r[:2] for r in rows], float)])
    b = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        grad = x.T @ (p - y) + ridge * b * [0, 1, 1]
        hess = (x.T * (p * (1 - p) + 1e-9)) @ x + ridge * np.diag([1e-6, 1, 1])
        b -= np.linalg.solve(hess, grad)
    return [float(v) for v in b]


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 4, held_out: int = 2, max_train: int = MAX_TRAIN,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` (and ``weight``, ``n_words``) for
    every row, learned from the labels outside the held-out fold."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    train = training_documents(docs, labels.select("doc_id", "toxic"), mod, held_out, max_train)
    hits = hits_udf(learn_terms(train))
    seen = train.select(hits("text").alias("h"), "toxic").select("h.weight", "h.words", "toxic").collect()
    a, b, c = fit_curve([(*features(r["weight"], r["words"]), r["toxic"]) for r in seen])
    out = docs.select("doc_id", (id_bucket(mod) == held_out).alias("held_out"), hits(text_of()).alias("h"))
    x1, x2 = features(F.col("h.weight"), F.col("h.words"), F)
    return out.withColumn("score", 1 / (1 + F.exp(-(a + b * x1 + c * x2)))).select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("h.weight").alias("weight"), F.col("h.words").alias("n_words"))
