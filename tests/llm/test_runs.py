"""Operator 11 against brute force."""
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from bitextkit.llm import periodic_runs as R


def brute_runs(w):
    """{(start, length, period)}: every period by comparison with the shifted words."""
    code = {}
    w = np.array([code.setdefault(x, len(code)) for x in w], dtype=np.int64)
    found = set()
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]]).astype(np.int8)
        for i, j in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            length, root = int(j - i + q), w[i:i + q].tolist()
            if length >= max(6, 4 * q) and not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q)):
                found.add((int(i), length, q))
    return found


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def key(r):
    return tuple((x is None, x) for x in r)


def check(spark, docs):
    got = sorted(map(tuple, R.run_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=key)
    assert got == sorted((brute_row(*d) for d in docs), key=key)


def planted(rnd, n):
    """Words with repeats of many periods, powers of powers and neighbours that meet."""
    w = []
    while len(w) < n:
        root = [rnd.choice("abc") for _ in range(rnd.choice([1, 1, 2, 3, 4, 5, 7, 8, 16, 31, 64]))]
        if rnd.random() < 0.3:
            root = root * rnd.randrange(1, 4)
        w += (root * rnd.randrange(1, 9))[:rnd.randrange(1, 400)]
        w += [rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 12))]
    return " ".join(w[:n])


def test_runs_against_brute_force(spark):
    rnd = random.Random(3)
    check(spark, [(i, planted(rnd, rnd.choice([3, 6, 12, 40, 150, 600]))) for i in range(150)])


def test_tiles_of_long_texts(spark, monkeypatch):
    """Tiles of 64 words: runs cross many tiles and octaves have tiles of their own."""
    monkeypatch.setattr(R, "TILE", 64)
    monkeypatch.setattr(R, "TILE_PERIOD", 4)
    monkeypatch.setattr(R, "SHORT_TEXT", 128)
    rnd = random.Random(4)
    check(spark, [(i, planted(rnd, rnd.choice([60, 300, 1100]))) for i in range(60)])


def test_given_documents(spark, docs001):
    check(spark, [(r.doc_id, r.text) for r in docs001.collect()])


def test_z_function():
    rnd = random.Random(5)
    for _ in range(300):
        s = [rnd.choice("ab") for _ in range(rnd.randrange(1, 30))]
        for i, z in enumerate(R.z_function(s)):
            assert s[:z] == s[i:i + z] and (i + z == len(s) or s[z] != s[i + z])


def test_edges(spark, edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect() if r.doc_id != 6]
    want = sorted((brute_row(*d) for d in rows), key=key)
    got = R.run_report(edge).collect()
    assert sorted((tuple(r) for r in got if r.doc_id != 6), key=key) == want
    assert R.run_report(empty).collect() == [] and len(R.run_report(empty).columns) == 8
    # 30,000 equal words and one other: one run, however many tiles it crosses
    long = next(r for r in got if r.doc_id == 6)
    if zlib.crc32(b"6") % 10:
        assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 30_000, 1)


@pytest.mark.parametrize("n", [8_193, 40_000])
def test_long_period(spark, n):
    """One run whose period needs an octave of its own."""
    rnd = random.Random(n)
    root = [f"w{rnd.randrange(10**6)}" for _ in range(n // 5)]
    text = " ".join(["x"] + root * 5 + ["y"])
    ident = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    r = R.run_report(spark.createDataFrame([(ident, text)], "doc_id long, text string")).collect()[0]
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 1, len(root) * 5, len(root), 5000)
    assert r.collapsed_sha256 == hashlib.sha256(" ".join(["x"] + root + ["y"]).encode()).hexdigest()
