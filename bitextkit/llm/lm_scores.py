"""Operator 1, language-model scores by a log-bilinear model.

The words of the training documents are counted (all of them).  The
``N_WORDS`` most frequent ones are outputs of the model by themselves; the
others fall into ``N_CLASSES`` classes by their last three bytes (the most
frequent endings have a class each, the rest share the others), and inside a
class a word has its add-one share.  So the vocabulary is open, every output
has a probability that sums to one, and the neural part stays small.

The prediction vector of a token is bilinear in its context: position weights
times the vectors of the ``CONTEXT`` outputs before it, plus weights times the
mean vector of all outputs before it in the document.  Training is
noise-contrastive estimation in numpy: each task runs once over its documents
(batches share a noise sample drawn from the unigram distribution, Adagrad
steps) and returns its parameters, which are averaged by token counts; a second
round, over the other half of the documents, starts from the average.
Scoring normalises explicitly: a product with all output vectors for a batch of
tokens, then log-sum-exp.

Scale: each training document is read once for counts and once for training.
The model and the ``MAX_LOCAL`` most frequent words are broadcast (bounded by
these parameters), a task holds one Arrow batch and the vectors of at most
``PART`` + 4 ``BATCH`` tokens; the counts of rarer words are joined by a shuffle that
carries only those words.

Defined results: null and empty texts hold the end token alone; a null id is
bucketed as the empty text; repeated rows are scored one by one; without
training words the model is uniform over one output; an empty table has no scores;
only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextkit.llm.common import cut, id_bucket, text_of

N_WORDS, N_CLASSES = 128, 128
MAX_LOCAL = 200_000            # words whose counts are broadcast
DIM, CONTEXT = 16, 3
NOISE, BATCH = 32, 4096
PART = 1 << 16                 # tokens after which the context of a very long text starts anew
RATE = 0.04
FLUSH = 300_000                # distinct words a task holds before it passes counts on
END = b"\n"                    # cannot be a word
MOD, HELD_OUT = 7, 2


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then the end token
    (bytes: only ASCII letters and white space are special)."""
    out = text.encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, c) over all training texts."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def out():
            return pd.DataFrame({"word": list(seen), "c": list(seen.values())})
        for df in batches:
            for t in df["_t"]:
                seen.update(words_of(t))
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        yield out()

    return train.select(text_of().alias("_t")).mapInPandas(count, "word binary, c long").groupBy("word").agg(
        F.sum("c").alias("c"))


class Vocabulary:
    """Outputs of the model and the add-one shares inside them."""

    def __init__(self, counts: DataFrame):
        level = F.floor(8 * F.log2(F.col("c").cast("double")))
        levels = counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).orderBy(
            F.desc("l")).collect()                                          # some hundred rows
        self.n, self.v = sum(r["n"] for r in levels), sum(r["v"] for r in levels)
        least, held = math.inf, 0
        for r in levels:
            held += r["v"]
            if held > MAX_LOCAL:
                break
            least = r["l"]
        top = counts.filter(level >= (least if levels and least < math.inf else 1 << 30)).collect()    # <= MAX_LOCAL
        top.sort(key=lambda r: (-r["c"], bytes(r["word"])))
        single = [bytes(r["word"]) for r in top[:N_WORDS]]
        self.single = {w: i for i, w in enumerate(single)}
        ending = F.substring("word", -3, 3)
        plain = counts.filter(~F.col("word").isin([bytearray(w) for w in single])) if single else counts
        per = plain.groupBy(ending.alias("e")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
        per = cut(per, "endings")
        own = per.orderBy(F.desc("n"), "e").limit(N_CLASSES // 2).collect()
        self.endings = {bytes(r["e"]): len(single) + i for i, r in enumerate(own)}
        self.rest = len(single) + len(own)
        self.n_rest = N_CLASSES - N_CLASSES // 2
        self.size = self.rest + self.n_rest
        self.mass = np.zeros(self.size)            # training tokens of an output
        self.kinds = np.zeros(self.size)           # distinct words of a class
        for r in top[:N_WORDS]:
            self.mass[self.single[bytes(r["word"])]] = r["c"]
        shared = per.filter(~F.col("e").isin([bytearray(e) for e in self.endings])) if own else per
        others = shared.groupBy((F.crc32("e") % self.n_rest).alias("k")).agg(
            F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
        for k, r in [*((self.endings[bytes(r["e"])], r) for r in own), *((self.rest + r["k"], r) for r in others)]:
            self.mass[k], self.kinds[k] = r["n"], r["v"]
        # log10 of what a count is divided by: inside a class, and in the whole vocabulary
        self.inside = np.where(np.arange(self.size) < len(single), 0.0, np.log10(self.mass + self.kinds + 1))
        self.whole = math.log10(self.n + self.v + 1)
        self.local = {bytes(r["word"]): i for i, r in enumerate(top)}
        self.local_output = np.array([self.output(w) for w in self.local], np.int32)
        self.local_log = np.log10(np.array([r["c"] for r in top], float) + 1)

    def output(self, word: bytes) -> int:
        k = self.single.get(word)
        if k is None:
            k = self.endings.get(word[-3:])
            if k is None:
                k = self.rest + zlib.crc32(word[-3:]) % self.n_rest
        return k

    def outputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Outputs of the words, places in the local table (-1: not there), and
        where those are that are not."""
        get = self.local.get
        place = np.array([get(w, -1) for w in words], np.int32)
        rare = np.flatnonzero(place < 0)
        out = self.local_output[place] if len(self.local) else np.zeros(len(words), np.int32)
        for i in rare.tolist():
            out[i] = self.output(words[i])
        return out, place, rare


class Model:
    """Parameters: Q output vectors, R context vectors, C position weights (the
    last row weighs the mean), b biases."""

    def __init__(self, mass: np.ndarray):
        size = len(mass)
        rng = np.random.default_rng(11)
        p = (mass + 1) / (mass + 1).sum()
        self.log_p = np.log(p).astype(np.float32)
        self.q = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
        self.r = rng.normal(0, 0.3, (size, DIM)).astype(np.float32)
        self.c = np.full((CONTEXT + 1, DIM), 0.3, np.float32)
        self.c[-1] = 1.0
        self.b = self.log_p.copy()

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.q, self.r, self.c, self.b)])

    def load(self, flat: np.ndarray):
        at = 0
        for x in (self.q, self.r, self.c, self.b):
            x[...] = flat[at:at + x.size].reshape(x.shape)
            at += x.size

    @staticmethod
    def places(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Number of outputs before each row in its document, and each row's
        document start; documents begin with ``CONTEXT`` padding rows."""
        starts = np.repeat(np.cumsum([0, *lengths[:-1]]), lengths)
        return np.maximum(np.arange(len(starts)) - starts - CONTEXT, 0), starts

    def context(self, x: np.ndarray, before: np.ndarray, starts: np.ndarray):
        """Prediction vectors, context vectors and means of a batch.  The
        padding has a zero vector, so neighbours never cross documents."""
        rx = np.concatenate([np.zeros((CONTEXT, DIM), np.float32),
                             np.concatenate([self.r, np.zeros((1, DIM), np.float32)])[x]])
        near = [rx[CONTEXT - i:len(rx) - i] for i in range(1, CONTEXT + 1)]
        total = np.cumsum(rx[CONTEXT - 1:], axis=0)          # row t: the sum before t
        mean = total[:-1] - total[starts]
        mean /= np.maximum(before, 1)[:, None].astype(np.float32)
        vec = mean * self.c[-1]
        for i, s in enumerate(near):
            vec += s * self.c[i]
        return vec, near, mean

    def log10_probs(self, x: np.ndarray, lengths: list[int]) -> np.ndarray:
        """log10 P(output) of every row, normalised over all outputs (0 for padding)."""
        before, starts = self.places(lengths)
        vec, _, _ = self.context(x, before, starts)
        vec = np.concatenate([vec, np.ones((len(vec), 1), np.float32)], axis=1)
        q = np.ascontiguousarray(np.concatenate([self.q, self.b[:, None]], axis=1).T)
        ones = np.ones(q.shape[1], np.float32)
        longest = float(np.sqrt((q * q).sum(axis=0).max()))
        pad = x == len(self.b)
        y = np.where(pad, 0, x)
        out = np.empty(len(x))
        for a in range(0, len(x), 1024):
            v = vec[a:a + 1024]
            z = v @ q
            own = z[np.arange(len(z)), y[a:a + 1024]]
            top = 0.0
            if longest * float(np.sqrt((v * v).sum(axis=1).max())) > 80:     # exp could leave float32
                top = z.max(axis=1)
                z -= top[:, None]
            np.exp(z, out=z)
            out[a:a + 1024] = own - top - np.log(z @ ones)
        out[pad] = 0
        return out / math.log(10)

    def train(self, x: np.ndarray, lengths: list[int], rng, sums: dict):
        """One NCE step over the rows ``x`` of whole documents (or parts)."""
        before, starts = self.places(lengths)
        vec, near, mean = self.context(x, before, starts)
        pad = x == len(self.b)
        y = np.where(pad, 0, x)
        noise = rng.choice(len(self.b), NOISE, p=self.noise_p)
        k = math.log(NOISE)
        pos = (vec * self.q[y]).sum(axis=1) + self.b[y] - self.log_p[y] - k
        neg = vec @ self.q[noise].T + self.b[noise] - self.log_p[noise] - k
        gp = -1 / (1 + np.exp(np.clip(pos, -30, 30)))
        gn = 1 / (1 + np.exp(-np.clip(neg, -30, 30)))
        gp[pad] = 0
        gn[pad] = 0
        dvec = gp[:, None] * self.q[y] + gn @ self.q[noise]
        order = np.argsort(x, kind="stable")
        xs = x[order]
        cuts = np.flatnonzero(np.diff(xs, prepend=-1))
        used = xs[cuts]
        size = len(self.b)
        dq, dr = np.zeros((size + 1, DIM), np.float32), np.zeros((size + 1, DIM), np.float32)   # the last row: padding
        db = np.zeros(size + 1, np.float32)
        dq[used] = np.add.reduceat((gp[:, None] * vec)[order], cuts, axis=0)
        np.add.at(dq, noise, gn.T @ vec)
        db[used] = np.add.reduceat(gp[order], cuts)
        np.add.at(db, noise, gn.sum(axis=0))
        # what every token gets from the tokens that it is context of
        back = np.zeros_like(vec)
        dc = np.empty_like(self.c)
        for i, s in enumerate(near, 1):
            dc[i - 1] = (dvec * s).sum(axis=0)
            back[:-i] += (dvec * self.c[i - 1])[i:]
        dc[-1] = (dvec * mean).sum(axis=0)
        part = dvec * self.c[-1] / np.maximum(before, 1)[:, None].astype(np.float32)
        total = np.concatenate([np.zeros((1, DIM), np.float32), np.cumsum(part, axis=0)])
        back += total[starts + np.repeat(lengths, lengths)] - total[1:]
        dr[used] = np.add.reduceat(back[order], cuts, axis=0)
        for name, value, grad in (("q", self.q, dq[:-1]), ("r", self.r, dr[:-1]), ("c", self.c, dc), ("b", self.b, db[:-1])):
            s = sums.setdefault(name, np.full_like(value, 1e-2))
            s += grad * grad
            value -= RATE * grad / np.sqrt(s)


def _batches(texts, vocabulary):
    """Output numbers of whole documents, some ``BATCH`` tokens at a time; a
    longer document is cut into parts of ``BATCH``."""
    padding = np.full(CONTEXT, vocabulary.size, np.int32)
    parts, lengths, held = [], [], 0
    for t in texts:
        doc = vocabulary.outputs(words_of(t))[0]
        for a in range(0, len(doc), BATCH):
            part = doc[a:a + BATCH]
            if held and held + len(part) > BATCH:
                yield np.concatenate(parts), lengths
                parts, lengths, held = [], [], 0
            parts += [padding, part]
            lengths.append(len(part) + CONTEXT)
            held += lengths[-1]
    if held:
        yield np.concatenate(parts), lengths


def train_model(train: DataFrame, vocabulary, rounds: int = 2) -> Model:
    """NCE training in ``rounds`` passes over disjoint parts of the documents.
    Every task returns one parameter vector; the averages are summed by Spark."""
    sc = train.sparkSession.sparkContext
    shared = sc.broadcast(vocabulary)
    model = Model(vocabulary.mass)
    size = len(model.flat())
    for turn in range(rounds):
        start = sc.broadcast(model.flat())

        def run(batches: Iterator[pd.DataFrame], start=start) -> Iterator[pd.DataFrame]:
            v = shared.value
            m = Model(v.mass)
            m.load(start.value)
            m.noise_p = np.exp(m.log_p.astype(np.float64))
            m.noise_p /= m.noise_p.sum()
            rng, sums, tokens = np.random.default_rng(5), {}, 0
            for df in batches:
                for x, lengths in _batches(df["_t"], v):
                    m.train(x, lengths, rng, sums)
                    tokens += len(x)
            if tokens:
                yield pd.DataFrame({"i": np.arange(size, dtype=np.int32), "v": m.flat() * float(tokens),
                                    "w": float(tokens)})

        part = train.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == turn)
        mean = part.select(text_of().alias("_t")).mapInPandas(run, "i int, v double, w double").groupBy("i").agg(
            (F.sum("v") / F.sum("w")).alias("v")).collect()                  # one row a parameter
        if mean:
            flat = np.zeros(size, np.float32)
            for r in mean:
                flat[r["i"]] = r["v"]
            model.load(flat)
    return model


def lm_scores(docs: DataFrame, mod: int = MOD, held_out: int = HELD_OUT, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    for every row of ``docs``; learned from the rows outside the held-out fold."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    train = docs.filter(id_bucket(mod) != held_out)
    counts = cut(word_counts(train), "word-counts")
    vocabulary = Vocabulary(counts)
    model = train_model(train, vocabulary)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((vocabulary, model))
    whole = vocabulary.whole

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, m = shared.value
        n_single, inside = len(v.single), v.inside
        padding = np.full(CONTEXT, v.size, np.int32)
        first = TaskContext.get().partitionId() << 40
        for df in batches:
            # a row for the document (its word cannot occur: it holds a space), and one for each rare word
            key, word, n = [], [], []
            sums, parts, lengths, places = np.zeros((len(df), 4)), [], [], []

            def flush():
                if parts:
                    p = m.log10_probs(np.concatenate(parts), lengths)
                    np.add.at(sums[:, 3], places, np.add.reduceat(p, np.cumsum([0, *lengths[:-1]])))
                    parts.clear(), lengths.clear(), places.clear()

            held = 0
            for row, t in enumerate(df["_t"]):
                words = words_of(t)
                doc, place, rare = v.outputs(words)
                known = place >= 0
                logs = v.local_log[place[known]].sum()
                alone = known & (doc < n_single)        # the model needs no share inside a class
                sums[row] = (len(words), known.sum(), logs - len(words) * whole,
                             logs - v.local_log[place[alone]].sum() - inside[doc].sum())
                for w, times in Counter([words[i] for i in rare.tolist()]).items():
                    key.append(first + row)
                    word.append(w)
                    n.append(times)
                for a in range(0, len(doc), PART):
                    parts += [padding, doc[a:a + PART]]
                    lengths.append(CONTEXT + len(parts[-1]))
                    places.append(row)
                    held += lengths[-1]
                    if held >= 4 * BATCH:
                        flush()
                        held = 0
            flush()
            rows = np.arange(len(df))
            yield pd.DataFrame({
                "k": np.concatenate([first + rows, np.array(key, np.int64)]),
                "word": [b" %d" % (first + r) for r in rows] + word,
                "n": np.concatenate([np.zeros(len(df), np.int64), np.array(n, np.int64)]),
                "doc_id": pd.concat([df["doc_id"].astype("Int64"), pd.Series([None] * len(key), dtype="Int64")],
                                    ignore_index=True),
                "held_out": pd.concat([df["held_out"].astype("boolean"), pd.Series([None] * len(key), dtype="boolean")],
                                      ignore_index=True),
                **{c: np.concatenate([sums[:, i], np.zeros(len(key))])
                   for i, c in enumerate(("tokens", "known", "base", "model"))}})
            first += len(df)

    rows = docs.select("doc_id", text_of().alias("_t"), (id_bucket(mod) == held_out).alias("held_out")).mapInPandas(
        score, "k long, word binary, n long, doc_id long, held_out boolean, tokens double, known double, "
               "base double, model double")
    c = F.coalesce("c", F.lit(0))
    add = F.sum(F.col("n") * F.log10(c + 1))
    out = rows.join(counts, "word", "left").groupBy("k").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        F.sum("tokens").cast("long").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(c > 0, F.col("n")).otherwise(0))).cast("long").alias("n_known"),
        (F.sum("base") + add).alias("base_score"), (F.sum("model") + add).alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.n).cast("long").alias("train_tokens"),
                      "base_score", "score")
