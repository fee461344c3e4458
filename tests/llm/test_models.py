"""Operators 1 and 5: exact parts against brute force, learned parts on held-out rows."""
import collections
import math
import re
import zlib

import numpy as np
import pytest

from bitextkit.llm import lm_scores, toxicity

WS = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


@pytest.fixture(scope="module")
def scored(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return {r.doc_id: r.text for r in d.collect()}, lm_scores.lm_scores(d).collect()


def test_lm_base_score(scored):
    texts, found = scored
    words = {k: WS.findall((x or "").translate(UP)) + ["\n"] for k, x in texts.items()}
    c = collections.Counter(w for k, x in words.items() if fold_of(k, 7) != 2 for w in x)
    n, v = sum(c.values()), len(c)
    assert len(found) == len(texts)
    for r in found:
        x = words[r.doc_id]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (
            len(x), sum(c[w] > 0 for w in x), n, fold_of(r.doc_id, 7) == 2)
        assert abs(r.base_score - base) <= 1e-9 * abs(base)


def test_lm_beats_its_base_on_held_out_documents(scored):
    held = [r for r in scored[1] if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.99
    assert sum(r.score > r.base_score for r in held) > 0.8 * len(held)


def padded(x, size=40):
    return np.concatenate([np.full(lm_scores.CONTEXT, size), x]).astype(np.int32)


def test_lm_probabilities_sum_to_one():
    m = lm_scores.Model(np.arange(1.0, 41.0))
    context = np.array([3, 7, 7], np.int32)
    p = [10 ** m.log10_probs(padded(np.append(context, k)), [7])[-1] for k in range(40)]
    assert abs(sum(p) - 1) < 1e-4


def test_lm_training_raises_the_likelihood():
    rng = np.random.default_rng(0)
    mass = np.full(20, 100.0)
    m = lm_scores.Model(mass)
    m.noise_p = np.full(20, 0.05)
    sums = {}

    def doc():
        return (rng.integers(0, 10, 200) + 10 * rng.integers(0, 2)).astype(np.int32)    # two topics
    n = 200 + lm_scores.CONTEXT
    before = m.log10_probs(padded(doc(), 20), [n]).sum()
    for _ in range(150):
        x = np.concatenate([padded(doc(), 20) for _ in range(10)])
        m.train(x, [n] * 10, rng, sums)
    after = np.mean([m.log10_probs(padded(doc(), 20), [n]).sum() for _ in range(20)])
    assert after > before + 200 * 0.15           # a topic halves the choice: 0.30 a token at most


def test_lm_gradient_of_context_matches_differences():
    rng = np.random.default_rng(1)
    m = lm_scores.Model(np.full(6, 5.0))
    x, lengths = np.concatenate([padded([0, 1, 2, 3], 6), padded([1, 5, 4], 6)]), [7, 6]
    before, starts = m.places(lengths)
    m.r = rng.normal(0, 1, m.r.shape).astype(np.float32)
    vec, _, _ = m.context(x, before, starts)
    one = m.context(x[7:], *m.places([6]))[0]
    assert np.allclose(vec[10:], one[3:], atol=1e-5)                         # documents do not mix
    want = m.c[0] * m.r[2] + m.c[1] * m.r[1] + m.c[2] * m.r[0] + m.c[3] * m.r[[0, 1, 2]].mean(axis=0)
    assert np.allclose(vec[6], want, atol=1e-5) and np.allclose(vec[3], 0)


def test_lm_gradient_matches_differences():
    """The gradient step of the context vectors against finite differences of
    the same noise-contrastive loss."""
    rng = np.random.default_rng(4)
    m = lm_scores.Model(np.full(6, 5.0))
    m.noise_p = np.full(6, 1 / 6)
    m.q, m.r = (rng.normal(0, 1, m.q.shape).astype(np.float32) for _ in range(2))
    x, lengths = np.concatenate([padded([0, 1, 2, 3], 6), padded([1, 5, 4, 4, 2], 6)]), [7, 8]
    noise = np.random.default_rng(9).choice(6, lm_scores.NOISE, p=m.noise_p)

    def loss():
        vec, _, _ = m.context(x, *m.places(lengths))
        vec, y = vec[x < 6].astype(float), x[x < 6]
        k = math.log(lm_scores.NOISE)
        pos = (vec * m.q[y]).sum(axis=1) + m.b[y] - m.log_p[y] - k
        neg = vec @ m.q[noise].T + m.b[noise] - m.log_p[noise] - k
        return np.logaddexp(0, -pos).sum() + np.logaddexp(0, neg).sum()

    r0, step = m.r.copy(), 1e-2
    want = np.zeros_like(r0)
    for i in np.ndindex(*r0.shape):
        m.r[i] = r0[i] + step
        up = loss()
        m.r[i] = r0[i] - step
        want[i] = (up - loss()) / (2 * step)
        m.r[i] = r0[i]
    sums = {}
    m.train(x, lengths, np.random.default_rng(9), sums)
    assert np.allclose(np.sqrt(sums["r"] - 1e-2), np.abs(want), rtol=0.02, atol=0.02)


def test_lm_edges(plain_edge, empty):
    got = lm_scores.lm_scores(plain_edge).collect()
    assert len(got) == plain_edge.count()
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 3)) and all(math.isfinite(r.score) for r in got)
    assert lm_scores.lm_scores(empty).collect() == []


def test_toxicity_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.toxicity(d, labels).collect()
    assert all(r.held_out == (fold_of(r.doc_id, 4) == 2) and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted and truth[r.doc_id] for r in held)
    assert hit >= 0.8 * sum(truth[r.doc_id] for r in held) and hit >= 0.85 * sum(r.predicted for r in held)


def test_toxic_words_in_disguise():
    lexicon = toxicity.Lexicon({"=idiot": 4.0, "=trash": 3.0, "^moro": 2.0, "=moron": 5.0})
    for text in ("you idiot", "You 1d10t!!", "an іdiot", "IDIOT."):
        assert lexicon.hits(text)[0] == 4.0, text
    assert lexicon.hits("moron moronic")[0] == 7.0
    assert lexicon.hits("the trash can") == (0.0, 3) and lexicon.hits("trash can be trash")[0] == 3.0
    assert lexicon.hits("idiots 5 $$$") == (0.0, 1) and lexicon.hits("") == (0.0, 0)


def test_toxicity_edges(spark, plain_edge, empty):
    labels = spark.createDataFrame([(4, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(plain_edge, labels).collect()
    assert len(got) == plain_edge.count() and all(0 <= r.score < 0.3 for r in got)
    assert toxicity.toxicity(empty, labels).collect() == []
    assert len(toxicity.toxicity(plain_edge, labels.filter("false")).collect()) == plain_edge.count()
