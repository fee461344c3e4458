import random

import pytest
from pyspark.sql import functions as F

from bitextkit.functions import text as T

WS_CHARS = [c for c in map(chr, range(0x3001)) if c.isspace()] + [" ", "　"]


def run1(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first().y


def test_whitespace_class_matches_python(spark):
    rng = random.Random(7)
    alphabet = ["a", "b", "अ", "​", '"', "'"] + WS_CHARS
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    got = df.select("x", T.strip_ws("x").alias("s"), F.array_join(T.ws_tokens("x"), "|").alias("t"),
                    T.norm_text("x").alias("n")).collect()
    for r in got:
        assert r.s == r.x.strip()
        assert r.t == "|".join(r.x.split())
        import re
        py = re.sub(r"\s+", " ", r.x.replace("​", " ")).strip().strip('"').strip("'")
        assert r.n == py


@pytest.mark.parametrize("value,mixed,sequential", [
    ("'\"x\"'", "x", "\"x\""),
    ("  \"a  b\"  ", "a b", "a b"),
    ("\"'q'\"", "q", "q"),
])
def test_clean_text_variants(spark, value, mixed, sequential):
    assert run1(spark, T.clean_text(F.col("x")), value) == mixed
    assert run1(spark, T.clean_text(F.col("x"), "sequential"), value) == sequential


def test_norm_text_null_and_zero_width(spark):
    assert run1(spark, T.norm_text(F.col("x")), None) == ""
    assert run1(spark, T.norm_text(F.col("x")), '"​ab "') == " ab "


@pytest.mark.parametrize("value,tokens", [
    ("The dog bit the man.", "The dog bit the man ."),
    ("It wasn't surprising.", "It wasn't surprising ."),
    ("3.5 and 1,000 -- x-1 2-3", "3.5 and 1,000 -- x-1 2 - 3"),
    ("a &amp; b &lt;c&gt;", "a & b < c >"),
])
def test_tokenize_13a(spark, value, tokens):
    assert run1(spark, F.array_join(T.tokenize_13a(F.col("x")), " "), value) == tokens


def test_chrf_words_split_edge_punctuation(spark):
    got = run1(spark, F.array_join(T.chrf_words(F.col("x")), "|"), "(hi) a, .b c")
    assert got == "(hi|)|a|,|.|b|c"


def test_latin_share_and_artifacts(spark):
    df = spark.createDataFrame([("abअआ",), ("",), ("x....y",), ("{a}",)], "x string")
    r = df.select(T.latin_share("x").alias("l"), T.has_artifact("x").alias("a"),
                  T.heavy_latin("x").alias("h")).collect()
    assert [x.l for x in r] == [0.5, 0.0, 2 / 6, 1 / 3]
    assert [x.a for x in r] == [False, False, True, True]
    assert [x.h for x in r] == [True, False, True, True]


def test_direction_rules(spark):
    df = spark.createDataFrame([("translate kangri to hindi: x",), ("hindi to kangri y",), ("z",)],
                               "s string")
    r = df.select(T.direction_of("s", "kangri", "hindi", "substring").alias("a"),
                  T.direction_of("s", "kangri", "hindi", "prefix").alias("b")).collect()
    assert [x.a for x in r] == ["src2tgt", "tgt2src", None]
    assert [x.b for x in r] == ["src2tgt", "tgt2src", "tgt2src"]


def test_units_of_odd_texts(spark):
    import string
    from bitextkit.functions.text import chrf_words, norm_text, tokenize_13a
    texts = ['"abc" d', "..", '" a', "a\u2003\u00a0b.", "1,5 x-y 3-4", "a. .b &quot;c", "\x1ca\x85 b", "\U0001f600. 'q"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = d.select("t", chrf_words("t").alias("w"), tokenize_13a("t").alias("k"), norm_text("t").alias("n")).orderBy("i").collect()
    marks = set(string.punctuation)

    def words(t):
        for w in t.split():
            if len(w) > 1 and w[-1] in marks:
                yield from (w[:-1], w[-1])
            elif len(w) > 1 and w[0] in marks:
                yield from (w[0], w[1:])
            else:
                yield w
    assert [r.w for r in got] == [list(words(t)) for t in texts]
    assert [r.n for r in got] == [" ".join(t.split()).strip('"').strip("'") for t in texts]
    assert got[3].k == ["a", "b", "."] and got[4].k == ["1,5", "x-y", "3", "-", "4"] and got[5].k == ["a", ".", ".", "b", '"', "c"]
