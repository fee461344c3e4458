import pytest

from bitextkit.operators import meteor as ME
from bitextkit.operators import mt_metrics as M
from bitextkit.operators.evaluate import evaluate
from bitextkit.plans import standins

GOLDEN = [  # (hyp, ref, bleu, chrf++, meteor exact) from SURVEY 2.11
    ("The dog bit the man.", "The dog bit the man.", 100.0, 100.0, 0.996),
    ("It wasn't surprising.", "It was not unexpected.", 14.7940, 23.7933, 0.128205),
    ("The man had just bitten him.", "The man bit him first.", 15.6197, 36.6131, 0.367647),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(i, "d", h, r) for i, (h, r, *_ ) in enumerate(GOLDEN)]
    return spark.createDataFrame(rows, "id long, direction string, hyp string, ref string")


def test_sentence_bleu_chrf(golden):
    got = {r.id: r for r in M.corpus_scores(M.sentence_stats(golden), by=("id",)).collect()}
    for i, (_, _, b, c, _) in enumerate(GOLDEN):
        assert got[i].bleu == pytest.approx(b, abs=1e-4)
        assert got[i].chrf == pytest.approx(c, abs=1e-4)


def test_corpus_bleu_chrf(golden):
    r = M.corpus_scores(M.sentence_stats(golden)).first()
    assert r.bleu == pytest.approx(45.0675, abs=1e-4)
    assert r.chrf == pytest.approx(51.7310, abs=1e-4)


def test_meteor(golden):
    s = {r.id: r.meteor for r in ME.sentence_meteor(golden).collect()}
    for i, (*_, m) in enumerate(GOLDEN):
        assert s[i] == pytest.approx(m, abs=1e-6)
    assert ME.corpus_meteor(golden).first().meteor == pytest.approx(49.7284, abs=1e-4)


def test_effective_order_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "a b"), (2, "", "a b")], "id long, hyp string, ref string")
    got = {r.id: r for r in M.corpus_scores(M.sentence_stats(df, keep=()), by=("id",)).collect()}
    assert got[1].bleu == 0.0 and got[1].bleu_eff == 100.0
    assert got[2].bleu == 0.0 and got[2].chrf == 0.0


def test_identity_properties(spark):
    text = "अआ इई उऊ ऋऌ ऍऎ एऐ ऑऒ"
    df = spark.createDataFrame([(1, text, text)], "id long, hyp string, ref string")
    r = M.corpus_scores(M.sentence_stats(df, keep=())).first()
    assert r.bleu == 100.0 and r.chrf == 100.0
    m = ME.sentence_meteor(df, keep=()).first()
    assert m.meteor == pytest.approx(1 - 0.5 / 7 ** 3)


def test_rollup_overall_modes(spark):
    rows = [(1, "x", "a b c d", "a b c d"), (2, "y", "a b", "a b c d"), (3, None, "q", "a b c d")]
    df = spark.createDataFrame(rows, "id long, direction string, hyp string, ref string")
    st = M.sentence_stats(df)
    allm = {r.direction: r.n for r in M.evaluate_by(st, overall="all").collect()}
    matched = {r.direction: r.n for r in M.evaluate_by(st, overall="matched").collect()}
    assert allm == {"x": 1, "y": 1, "overall": 3}
    assert matched == {"x": 1, "y": 1, "overall": 2}


def test_greedy_match_identical_tokens(spark):
    rows = [(1, 0, 0, [1.0, 0.0]), (1, 0, 1, [0.0, 1.0]), (1, 1, 0, [0.0, 2.0]), (1, 1, 1, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "sent_id long, side int, pos int, vec array<double>")
    r = ME.greedy_match_f1(df).first()
    assert r.f1 == pytest.approx(1.0)


def test_meteor_stem_and_synonym_stages(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "cats run fast", "cat runs quickly")],
                               "id long, hyp string, ref string")
    exact = ME.sentence_meteor(df, keep=()).first()
    assert exact.m == 0 and exact.meteor == 0.0
    stemmed = ME.sentence_meteor(df, keep=(), stems=lambda w: F.regexp_replace(w, "s$", "")).first()
    assert stemmed.m == 2
    syn = spark.createDataFrame([("fast", "quickly")], "word string, synonym string")
    both = ME.sentence_meteor(df, keep=(), stems=lambda w: F.regexp_replace(w, "s$", ""),
                              synonyms=syn).first()
    assert both.m == 3 and both.chunks == 1
    assert both.meteor == pytest.approx(1 - 0.5 / 27)


def test_chrf_beyond_the_bmp_and_repeated_ids(spark):
    rows = [(1, "\U0001f600\U0001f601", "\U0001f600\U0001f602"), (1, "a b c d", "a b c d"), (2, "", "x y")]
    st = {(r.chrf_h1, r.chrf_r1): r for r in M.sentence_stats(
        spark.createDataFrame(rows, "id long, hyp string, ref string"), keep=()).collect()}
    assert len(st) == 3 and st[2, 2].chrf_m1 == 1 and st[2, 2].chrf_h2 == 1 and st[4, 4].chrf_m1 == 4


def test_greedy_f1_of_orthogonal_tokens_is_zero(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])]
    t = spark.createDataFrame(rows, "sent_id long, side int, vec array<float>")
    assert ME.greedy_match_f1(t).first().f1 == 0.0


def test_synonym_pairs_do_not_carry_over(spark):
    syn = spark.createDataFrame([("fast", "quickly"), ("quickly", "rapidly")], "word string, synonym string")
    rows = [(1, "he ran quickly", "he ran rapidly"), (2, "he ran fast", "he ran rapidly"),
            (3, "quickly fast", "rapidly quickly")]
    d = spark.createDataFrame(rows, "id long, hyp string, ref string")
    got = {r.id: r.m for r in ME.sentence_meteor(d, keep=(), synonyms=syn).collect()}
    assert got == {1: 3, 2: 2, 3: 1}


def test_metric_subsets(spark):
    d = spark.createDataFrame([(1, "a b", "a b"), (2, "", "x")], "id long, hyp string, ref string")
    enc = standins.code_point_encoder()
    got = {r.metric: r.score for r in evaluate(d, encoder_factory=enc).collect()}
    assert set(got) == {"bleu", "chrf", "meteor", "bertscore"} and abs(got["bertscore"] - 50) < 1e-9
    assert [r.metric for r in evaluate(d, ("meteor",)).collect()] == ["meteor"]
    for bad in (("bertscore",), ("rouge",), ()):
        with pytest.raises(ValueError):
            evaluate(d, bad)


def test_clipped_matches_against_counters():
    """Grams counted one by one, over slices and sentences of every length."""
    import collections

    import numpy as np
    rnd = np.random.default_rng(5)
    h = [rnd.integers(0, 4, n).tolist() for n in (0, 1, 2, 7, 30, 0, 12)]
    r = [rnd.integers(0, 4, n).tolist() for n in (3, 0, 2, 9, 25, 0, 12)]
    got = M.clipped_matches(np.array(sum(h, [])), np.array([len(x) for x in h]),
                            np.array(sum(r, [])), np.array([len(x) for x in r]), 6)
    for n in range(1, 7):
        for i, (a, b) in enumerate(zip(h, r)):
            ca, cb = (collections.Counter(tuple(x[j:j + n]) for j in range(len(x) - n + 1)) for x in (a, b))
            assert got[n - 1, i] == sum((ca & cb).values())


def test_statistics_do_not_depend_on_slices(spark, monkeypatch):
    rows = [(i, "the cat \U0001f600 sat. " * (i % 5), "the cat sat on \U0001f600, " * (i % 4)) for i in range(40)]
    d = spark.createDataFrame(rows, "id long, hyp string, ref string")
    want = sorted(M.sentence_stats(d, keep=()).collect())
    monkeypatch.setattr(M, "UNITS", 50)
    assert sorted(M.sentence_stats(d, keep=()).collect()) == want


def test_counts_of_wide_units_equal_counters():
    """Units of 41 bits: numbers pass 63 bits and are ranked in between."""
    import collections
    import numpy as np
    from bitextkit.operators.mt_metrics import clipped_matches
    rng = np.random.default_rng(5)
    for step in (1, 1 << 38):
        hn, rn = rng.integers(0, 25, 40), rng.integers(0, 25, 40)
        h, r = (rng.integers(0, 6, n.sum()) * step for n in (hn, rn))
        got = clipped_matches(h, hn, r, rn, 6)
        ends = [np.cumsum(x) for x in (hn, rn)]
        for i in range(40):
            x, y = (u[e[i] - k[i]:e[i]].tolist() for u, e, k in zip((h, r), ends, (hn, rn)))
            for n in range(1, 7):
                a, b = (collections.Counter(tuple(z[j:j + n]) for j in range(len(z) - n + 1)) for z in (x, y))
                assert got[n - 1, i] == (a & b).total()


def test_exact_meteor_shuffles_texts_once(spark):
    from bitextkit.operators import meteor as ME
    rows = [(1, "a b a c", "a a b c"), (2, "", "a"), (None, "a", "a"), (3, "A b", "b a"), (4, "x y", "x y"), (4, "y z", "z y")]
    d = spark.createDataFrame(rows, "id long, hyp string, ref string")
    s = ME.sentence_meteor(d, keep=())
    got = sorted((r.id or 0, r.hyp_len, r.ref_len, r.m, r.chunks) for r in s.collect())
    # texts that share an id are one sentence, a NULL id matches nothing
    tok = [ME._positions(d, c, c) for c in ("hyp", "ref")]
    want = {r.id: (r.m, r.chunks) for r in ME.chunks(ME.align_exact(*tok)).collect()}
    assert got == sorted((i or 0, len(h.split()), len(r.split()), *want.get(i, (0, 0))) for i, h, r in rows)
    plan = ME.sentence_meteor(d, keep=())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "posexplode" not in plan


def test_statistics_of_several_hypotheses_of_a_reference(spark):
    from pyspark.sql import functions as F
    rows = [(1, "a b. c", ["a b", "", "a b. c"], ["p", "q", "r"]), (2, "x", ["y x"], ["p"]), (3, "", [], []), (4, None, [None, "z"], ["s", "t"])]
    d = spark.createDataFrame(rows, "id long, ref string, hyp array<string>, name array<string>")
    flat = d.select("id", "ref", F.inline(F.arrays_zip("hyp", "name")))
    got = M.sentence_stats(d, keep=(), many=("name",))
    want = M.sentence_stats(flat, keep=("name",))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


ODD_TEXTS = ["", " ", "a", "-", "a.b, c", "U.S. 3.5,6 1-2 -3", '"quoted" (x)', "a-\nb\n", "line\nnext -\n", "x&quot;y &amp;lt; <skipped>z",
             "<skip<skipped>ped> -<skipped>\nq", "अआ. अइ, \U0001f600! \U0001f601", "a b c\u0085d\x1ce", "...!? ,,. . .", "'tis don't 'a'", "a\tb-", "​zero", "$5 50%-60%", None]


def test_units_of_strings_equal_the_columns(spark):
    from pyspark.sql import functions as F
    from bitextkit.functions import text as TX
    d = spark.createDataFrame([(t,) for t in ODD_TEXTS], "t string")
    for t, tok, chars, words in d.select("t", TX.tokenize_13a("t"), TX.chrf_chars("t"), TX.chrf_words("t")).collect():
        assert (TX.py_tokenize_13a(t or ""), TX.py_chrf_chars(t or ""), TX.py_chrf_words(t or "")) == (tok, chars, words), t
        if "\n" not in (t or ""):       # word by word
            assert sum(map(TX.py_tokenize_13a, (t or "").split()), []) == tok


def test_hypotheses_that_begin_alike_are_counted_together(spark, monkeypatch):
    """Every beginning of odd texts, in lists with each other: as one by one, and only the whole ones are laid out."""
    import numpy as np
    rnd = np.random.default_rng(7)
    texts = [t for t in ODD_TEXTS if t] + ["a b a b a c. a b", "a b a b", "a  b a", "a b c", "a bc"]
    hyps, refs = [], []
    for t in texts:
        words = t.split(" ")
        hyps.append([" ".join(words[:i]).strip() for i in range(len(words) + 1)] + ["a b", "", "a b"])
        refs.append(" ".join(rnd.permutation(words)) + " a b. a")
    cut = M._cutters(M.KINDS)
    got = M._count_hypotheses(hyps, [M._words(r) for r in refs], cut)
    flat = [(M._words(h), M._words(r)) for x, r in zip(hyps, refs) for h in x]
    want = M._count_texts([h for h, _ in flat], [r for _, r in flat], np.arange(len(flat)), cut)
    assert all((got[k] == want[k]).all() for k in want) and got.keys() == want.keys()
    whole, of = M._beginnings(["a b c", "a", "a b", "", "a bc", "a"])
    assert whole == [["a", "bc"], ["a", "b", "c"]] and of == [(1, 3), (1, 1), (1, 2), (1, 0), (0, 2), (1, 1)]


def test_partial_sums_of_batches(spark):
    rows = [(i, "the cat sat. " * (i % 5), "the cat sat on, " * (i % 4), (None, "x", "y")[i % 3]) for i in range(40)]
    d = spark.createDataFrame(rows, "id long, hyp string, ref string, direction string").coalesce(1)
    part = M.sentence_stats(d, summed=True)
    assert part.count() == 3 and "id" not in part.columns       # not a row a sentence
    for overall in ("all", "matched"):
        assert sorted(M.evaluate_by(part, overall=overall).collect()) == sorted(M.evaluate_by(M.sentence_stats(d), overall=overall).collect())
    empty = M.corpus_scores(M.sentence_stats(d.limit(0), keep=(), summed=True)).first()
    assert empty == M.corpus_scores(M.sentence_stats(d.limit(0), keep=())).first() and empty.n == 0
    lists = spark.createDataFrame([(1, "a b", ["a", "a b", "b"], [[1], [1, 2], [3]]), (2, "x", ["x", "y"], [[1, 2], [1]])],
                                  "id long, ref string, hyp array<string>, sets array<array<int>>").coalesce(1)
    got = {tuple(r.sets): r.n_rows for r in M.sentence_stats(lists, keep=(), many=("sets",), summed=True).collect()}
    assert got == {(1,): 2, (1, 2): 2, (3,): 1}


def test_token_match_of_sentences_of_every_shape(spark, monkeypatch):
    """Sentences multiplied together give what each gives alone; the encoder sees one text a call."""
    import numpy as np
    from bitextkit.operators import evaluate as EV
    monkeypatch.setattr(EV, "MATCH_ROWS", 7)
    monkeypatch.setattr(EV, "MATCH_CELLS", 30)

    def factory():
        place = lambda tokens: [[len(t), ord(t[0]) % 5, i + 1.0, -1.0] for i, t in enumerate(tokens)]
        return place            # a token's vector depends on its place in the text
    rnd = np.random.default_rng(3)
    words = ["a", "bb", "ccc", "d-d", "e"]
    texts = [" ".join(rnd.choice(words, n)) for n in [*range(9), 3, 3, 3, 40]]
    rows = [(i, texts[i % 13], texts[(5 * i + 2) % 13] if i % 11 else None) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, hyp string, ref string").coalesce(1)
    got = {r.id: r.f for r in d.select("id", EV.token_match_f1(d.hyp, d.ref, factory).alias("f")).collect()}
    for i, h, r in rows:
        h, r = (np.array(factory()((t or "").split())).reshape(-1, 4) for t in (h, r))
        if not len(h) or not len(r):
            assert got[i] == 0
            continue
        sim = (h / np.linalg.norm(h, axis=1, keepdims=True)) @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T
        p, q = sim.max(axis=1).mean(), sim.max(axis=0).mean()
        assert got[i] == pytest.approx(2 * p * q / (p + q) if p + q > 0 else 0.0)


def test_corpus_queries_send_sums_not_sentences(spark):
    """Out of the Arrow pass of a corpus query come sums of batches."""
    from bitextkit.plans.queries import QUERIES
    from conftest import SF001
    for q in ("a05_metric_bundle", "a06_evaluate_by_direction_matched", "u06_sweep"):
        plan = QUERIES[q](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
        assert "n_rows" in plan, q
