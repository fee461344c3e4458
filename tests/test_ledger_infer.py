from pyspark.sql import functions as F

from bitextkit.operators import infer as U
from bitextkit.operators import ledger as LG
from bitextkit.plans import standins as SI

LEDGER_BLEU = [2.3526, 2.3430, 2.8155, 2.5885, 2.8368, 2.9293, 2.8361, 2.7836, 2.9295, 3.8672, 3.7504,
               3.8987, 3.8926, 3.8995, 3.8874, 3.8984, 4.0740, 4.0024, 5.2567]
LEDGER_KEEP = [True, False, True, False, True, True, False, False, True, True, False, True, False, True,
               False, False, True, False, True]


def test_running_best_replays_ledger_keep(spark):
    # the published iterations 0-18 of the main track; block=4 forces several blocks
    rows = [(i, "main", v) for i, v in enumerate(LEDGER_BLEU)] + [(19, "main", None)]
    df = spark.createDataFrame(rows, "iter long, track string, value double")
    got = [r.keep for r in LG.running_best(df, block=4).orderBy("iter").collect()]
    assert got == LEDGER_KEEP + [False]


def test_grid_and_topk(spark):
    grid = {"num_beams": [4, 6, 8], "max_length": [48, 64, 80], "length_penalty": [0.8, 1.0, 1.2],
            "repetition_penalty": [1.0, 1.1]}
    g = spark.range(1).select(F.inline(LG.grid_array(grid)))
    assert g.count() == 54
    first = g.orderBy("config_id").first()
    assert (first.num_beams, first.max_length, first.length_penalty, first.repetition_penalty) == (4, 48, 0.8, 1.0)
    scored = g.withColumn("bleu", (F.col("config_id") % 7).cast("double"))
    top = [r.config_id for r in LG.top_k(scored, "bleu", 10).collect()]
    assert top[:3] == [6, 13, 20]


def test_generate_rejected_keeps_key(spark):
    df = spark.createDataFrame([(i, f"translate a to b: w1 w2 w3 w4 w{i}") for i in range(50)],
                               "pair_id long, source string").repartition(3)
    out = U.generate_rejected(df, SI.dropping_generator(3), batch_size=7)
    got = {r.pair_id: r.unpreferred for r in out.collect()}
    assert got[5] == "w1 w2 w4 w5"
    assert len(got) == 50


def test_model_reward_and_embed(spark):
    df = spark.createDataFrame([(1, "s", "abc", "abcd")], "id long, source string, hyp string, ref string")
    r = U.model_reward(df, SI.length_ratio_scorer()).first()
    assert r.reward == 5 / 4
    r2 = U.model_reward(df, SI.length_ratio_scorer(), input_format="concat").first()
    assert r2.reward == len("s abcd abc") / 1000.0
    e = U.embed(df, "hyp", SI.hashing_encoder(8)).first()
    assert len(e.embedding) == 8


def test_metric_delta(spark):
    df = spark.createDataFrame([("baseline", "bleu", 22.4497), ("candidate", "bleu", 21.8603)],
                               "run string, metric string, value double")
    assert LG.metric_delta(df).first().delta == -0.5894


def test_sweep_scores_equal_outputs_once(spark):
    """Folded outputs give what every configuration alone gives."""
    from bitextkit.operators import mt_metrics as M
    from bitextkit.plans.fixtures import GRID
    from bitextkit.plans.standins import dropping_generator
    rows = [(i, f"translate a to b: {' '.join(f'w{(i * k) % 7}' for k in range(1, n))}", f"w1 w2 w{i % 5} w3 w4")
            for i, n in enumerate([1, 2, 5, 9, 14, 20, 33])]
    d = spark.createDataFrame(rows, "id long, source string, ref string")
    got = U.sweep(d, GRID, dropping_generator(3), batch_size=3).collect()
    assert len(got) == 54 and len({r.config_id for r in got}) == 54
    folded = U.generate_for_grid(d, GRID, dropping_generator(3), "source", "hyp", "configs", 2).collect()
    assert len(folded) == len({(r.id, r.hyp) for r in folded}) < 54 * len(rows)
    for r in got[::11]:
        alone = spark.createDataFrame([(f.id, f.hyp, f.ref) for f in folded if r.config_id in f.configs],
                                      "id long, hyp string, ref string")
        want = M.corpus_scores(M.sentence_stats(alone, keep=())).first()
        assert alone.count() == len(rows) and (r.bleu, r.chrf) == (want.bleu_eff, want.chrf)


def test_embed_against_plain_trigram_counts(spark):
    """Every vector of the hashing stand-in again, trigram by trigram."""
    import math
    import zlib
    texts = ["", None, "a", "abc abc", "é\U0001f600 x" * 5, "the cat"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    got = {r.id: r.embedding for r in U.embed(d, "t", SI.hashing_encoder(16), batch_size=2).collect()}
    for i, t in enumerate(texts):
        s, want = f"  {t or ''} ", [0.0] * 16
        for j in range(len(s) - 2):
            want[zlib.crc32(s[j:j + 3].encode()) % 16] += 1.0
        norm = math.sqrt(sum(x * x for x in want)) or 1.0
        assert [round(x, 5) for x in got[i]] == [round(x / norm, 5) for x in want]
