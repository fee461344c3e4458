"""Operator 13 against a plain count."""
import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from bitextkit.llm import collocations as C

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) >= 2 and a >= 10}
    rows = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        if any(lang == g and len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
               for (g, q), b in cand.items() if len(p) == 2):
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                             for k in range(1, len(p)))
        rows[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in rows.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def corpus(seed, size=300):
    rnd = random.Random(seed)
    words = ["a", "B", "ü", "\U0001f600", "x" * 300, "c-d", "\x1c", "Z z", "q", "w", "e", "r"] + [f"w{i}" for i in range(40)]
    out = []
    for _ in range(size):
        t = ""
        for _ in range(rnd.randrange(0, 60)):
            t += rnd.choice([rnd.choice(words), "new york city", "New York", "of the", "a a a a"]) + rnd.choice(
                [" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ; "])
        out.append((rnd.choice(["en", "de", None, "und"]), t))
    return out + [("en", None), ("fr", ""), ("en", " \t.,"), ("fr", "one")]


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("phrases", [300_000, 40])
def test_against_brute_force(spark, monkeypatch, phrases):
    monkeypatch.setattr(C, "TRIE_PHRASES", phrases)
    docs = corpus(phrases)
    d = spark.createDataFrame([(i, t, l) for i, (l, t) in enumerate(docs)], "doc_id long, text string, lang string").repartition(3)
    got = rows(C.collocations(d.selectExpr("*", "doc_id AS words", "doc_id AS a", "doc_id AS n", "doc_id AS w1")))
    assert got == brute(docs) and len(got) > 50
    assert rows(C.collocations(d, top=3)) == brute(docs, 3)


def test_collisions_of_proposed_keys_change_nothing(spark, monkeypatch):
    """With 16-bit keys very many phrases share one: counts stay exact."""
    monkeypatch.setattr(C, "KEY_BITS", 16)
    monkeypatch.setattr(C, "MAP_BITS", 12)
    docs = corpus(9, 120)
    assert rows(C.collocations(spark.createDataFrame([(l, t) for l, t in docs], "lang string, text string"))) == brute(docs)


def test_phrases_stay_off_the_driver_and_the_texts_are_read_once_for_all_tries(spark, monkeypatch):
    """Small slices and many tries: the driver gets no phrases, and no trie reads the texts again."""
    docs = corpus(11, 150)
    d = spark.createDataFrame(docs, "lang string, text string").repartition(2)
    monkeypatch.setattr(C, "TRIE_PHRASES", 5)
    monkeypatch.setattr(C, "SLICE_BYTES", 500)

    def refuse(*_, **__):
        raise AssertionError("phrases on the driver")
    monkeypatch.setattr(type(d), "toArrow", refuse)
    read, passes = [], type(d).mapInArrow
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, *a, **k: read.append("text" in self.columns) or passes(self, *a, **k))
    assert rows(C.collocations(d)) == brute(docs)
    assert sum(read) == 4


def test_slices_keep_to_their_bytes_and_lose_no_text(monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 100)
    texts = [("en" if i % 3 else "de", "w" * (i * 7 % 60) + "\u00fc") for i in range(200)] + [("en", "x" * 1000)]
    got = list(C.slices(pa.RecordBatch.from_pydict({"lang": [x for x, _ in texts], "text": [x for _, x in texts]})))
    assert sorted((lang, t.decode()) for lang, part in got for t in part) == sorted(texts)
    assert all(sum(map(len, part)) < 2 * 100 or len(part) == 1 or max(map(len, part)) > 100 for _, part in got) and len(got) > 20


def test_empty(spark, empty, edge):
    assert C.collocations(empty).collect() == []
    docs = [(r.lang, r.text) for r in edge.collect()]
    assert rows(C.collocations(edge)) == brute(docs)


def test_double_array():
    rnd = random.Random(1)
    phrases = {tuple(rnd.randrange(1, 60) for _ in range(rnd.choice([2, 2, 3]))) for _ in range(1500)}
    phrases = sorted(phrases | {p[:2] for p in phrases} | {(7, 8, c) for c in range(1, 61)} | {(7, 8)})
    t = C.DoubleArray(np.array([(*p, 0)[:3] for p in phrases]), 60)
    base, check = t.tables()
    state = dict(zip(phrases, t.states.tolist()))
    assert len(set(state.values())) == len(phrases) and min(state.values()) > 60
    for a in range(1, 61):
        s = C.advance(base, check, np.full(60, a), np.arange(1, 61))
        assert [state.get((a, b), 0) for b in range(1, 61)] == s.tolist()
        for b in np.flatnonzero(s):
            s3 = C.advance(base, check, np.full(60, s[b]), np.arange(1, 61))
            assert [state.get((a, int(b) + 1, c), 0) for c in range(1, 61)] == s3.tolist()
