"""
the lower-cased operator ID.  Each takes ``(spark, sf_dir)`` and returns a
DataFrame over the whole input tables (or data Spark derives from them).

Doubles are rounded at the edge (6 places for scalars/rewards/losses, 4 for
corpus metrics) so that the independent SQL oracle can compare values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextkit.functions import text as T
from bitextkit.operators import clean as C
from bitextkit.operators import pairs as P
from bitextkit.plans import fixtures as fx
from bitextkit.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------ P: projections

@query("p01_norm_text")
def p01(spark, d):
    return fx.parallel(spark, d).select(
        "pair_id", T.norm_text("src").alias("src_norm"), T.norm_text("tgt").alias("tgt_norm"))


@query("p02_clean_text")
def p02(spark, d):
    return fx.parallel(spark, d).select(
        "pair_id", T.clean_text("src").alias("src_clean"), T.clean_text("tgt").alias("tgt_clean"))


@query("p03_clean_text_sequential")
def p03(spark, d):
    return fx.parallel(spark, d).select(
        "pair_id", T.clean_text("src", "sequential").alias("src_clean"),
        T.clean_text("tgt", "sequential").alias("tgt_clean"))


@query("p04_normalize_for_bleu")
def p04(spark, d):
    return fx.parallel(spark, d).select(
        "pair_id", T.normalize_for_bleu("src").alias("src_bleu"),
        T.normalize_for_bleu("tgt").alias("tgt_bleu"))


@query("p05_strip")
def p05(spark, d):
    return fx.parallel(spark, d).select(
        "pair_id", T.strip_ws("src").alias("src_strip"), T.strip_ws("tgt").alias("tgt_strip"))


@query("p06_add_prompt")
def p06(spark, d):
    return fx.clean(spark, d).select(
        "pair_id", T.add_prompt("src", fx.SRC_LANG, fx.TGT_LANG).alias("source"))


@query("p08_latin_share")
def p08(spark, d):
    return fx.normalized(spark, d).select(
        "pair_id", F.round(T.latin_share("src"), 6).alias("src_latin"),
        F.round(T.latin_share("tgt"), 6).alias("tgt_latin"))


@query("p09_has_artifact")
def p09(spark, d):
    return fx.normalized(spark, d).select(
        "pair_id", T.has_artifact("src").alias("src_artifact"),
        T.has_artifact("tgt").alias("tgt_artifact"))


@query("p10_length_ratio")
def p10(spark, d):
    return fx.normalized(spark, d).select(
        "pair_id", F.round(T.length_ratio("src", "tgt"), 6).alias("len_ratio"))


@query("p11_direction_of")
def p11(spark, d):
    pr = fx.prompts(spark, d)
    stored = F.when(F.col("pair_id") % fx.PROMPT_BARE_MOD == 0,
                    F.lit(None).cast("string")).otherwise(F.col("direction"))
    return pr.select(
        "pair_id", F.col("direction").alias("stored_direction"),
        T.direction_of("source", fx.SRC_LANG, fx.TGT_LANG, "substring").alias("dir_substring"),
        T.direction_of("source", fx.SRC_LANG, fx.TGT_LANG, "prefix").alias("dir_prefix"),
        T.direction_of(stored, fx.SRC_LANG, fx.TGT_LANG, "stored").alias("dir_stored"))


@query("p12_tokenize_13a")
def p12(spark, d):
    toks = T.tokenize_13a("text")
    return read_table(spark, d, "documents").select(
        "doc_id", F.array_join(toks, " ").alias("tokens"), F.size(toks).cast("long").alias("n_tokens"))


@query("p13_chrf_units")
def p13(spark, d):
    words = T.chrf_words("text")
    return read_table(spark, d, "documents").select(
        "doc_id", T.chrf_chars("text").alias("chars"),
        F.array_join(words, " ").alias("words"), F.size(words).cast("long").alias("n_words"))


@query("p14_ws_tokens")
def p14(spark, d):
    toks = T.ws_tokens("text")
    return read_table(spark, d, "documents").select(
        "doc_id", F.size(toks).cast("long").alias("n_tokens"),
        F.array_join(toks, " ").alias("joined"))


# ------------------------------------------------------------ F: filters

def _filtered(fn):
    def run(spark, d):
        return fn(fx.normalized(spark, d)).select("pair_id", "src", "tgt")
    return run


QUERIES["f01_drop_empty"] = _filtered(C.drop_empty)
QUERIES["f02_min_chars"] = _filtered(C.min_chars)
QUERIES["f03_drop_identity"] = _filtered(C.drop_identity)
QUERIES["f04_length_ratio"] = _filtered(C.ratio_band)
QUERIES["f05_drop_artifacts"] = _filtered(C.drop_artifacts)
QUERIES["f06_drop_heavy_latin"] = _filtered(C.drop_heavy_latin)


@query("f07_clean_funnel")
def f07(spark, d):
    return C.clean_parallel(fx.parallel(spark, d))[1]


@query("f07_clean_pairs")
def f07_pairs(spark, d):
    return fx.clean(spark, d)


@query("f07_clean_pairs_fast")
def f07_fast(spark, d):
    return C.clean_pairs_fast(fx.parallel(spark, d))


@query("f08_dropna")
def f08(spark, d):
    return C.drop_null_pairs(fx.parallel(spark, d))


@query("f09_filter_direction")
def f09(spark, d):
    return P.filter_direction(fx.prompts(spark, d), "tgt2src", fx.SRC_LANG, fx.TGT_LANG).select(
        "pair_id", "source", "direction")


@query("f10_quality_profile")
def f10(spark, d):
    return C.quality_profile(fx.groups(spark, d))


# ------------------------------------------------------------ W / B / L / A (corpus shape)

@query("w01_dedup")
def w01(spark, d):
    return C.dedup_pairs(fx.normalized(spark, d), ("src", "tgt"), "pair_id")


@query("b01_expand_directions")
def b01(spark, d):
    return fx.pairs(spark, d)


@query("b02_concat_parts")
def b02(spark, d):
    s = P.split_by(fx.pairs(spark, d, store=True))
    parts = [s.filter(F.col("split") == lab) for lab in ("train", "val", "test")]
    return P.union_parts(parts).select("pair_id", "direction", "split")


@query("a07_direction_counts")
def a07(spark, d):
    return P.count_by_direction(fx.pairs(spark, d))


@query("a19_cleaning_summary")
def a19(spark, d):
    return C.cleaning_summary(fx.groups(spark, d))


@query("a20_inspect")
def a20(spark, d):
    df = fx.parallel(spark, d)
    first = F.min_by(F.struct("pair_id", "src", "tgt"), F.col("pair_id"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), first.alias("f")).select(
        "n_rows", F.lit(",".join(df.columns)).alias("columns"),
        F.col("f.pair_id").alias("first_pair_id"), F.col("f.src").alias("first_src"),
        F.col("f.tgt").alias("first_tgt"))


@query("s12_funnel_report")
def s12(spark, d):
    return C.funnel_from_groups(fx.groups(spark, d), with_pct=True)


@query("w02_split")
def w02(spark, d):
    return P.split_by(fx.pairs(spark, d, store=True)).select("pair_id", "direction", "split")


@query("w03_split_train_val")
def w03(spark, d):
    return P.split_by(fx.pairs(spark, d, store=True), by=(), ratios=(0.9, 0.1)).select(
        "pair_id", "direction", "split")


@query("w04_batches")
def w04(spark, d):
    return P.assign_batches(fx.pairs(spark, d, store=True), 8, 42, ("pair_id", "direction")).select(
        "pair_id", "direction", "batch_id")


@query("l01_sample_k")
def l01(spark, d):
    return P.sample_k(fx.pairs(spark, d, store=True), 256, 42, ("pair_id", "direction"))


@query("l02_sample_per_direction")
def l02(spark, d):
    return P.sample_per_direction(fx.prompts(spark, d, store=True), 5_000, fx.SRC_LANG, fx.TGT_LANG).select(
        "pair_id", "direction", "stratum", "source")


# ------------------------------------------------------------ MT metrics

from bitextkit.operators import infer as U  # noqa: E402
from bitextkit.operators.evaluate import METRICS, evaluate  # noqa: E402
from bitextkit.operators import ledger as LG  # noqa: E402
from bitextkit.operators import meteor as ME  # noqa: E402
from bitextkit.operators import mt_metrics as M  # noqa: E402
from bitextkit.operators import reward as R  # noqa: E402
from bitextkit.operators import stats as ST  # noqa: E402
from bitextkit.plans import standins as SI  # noqa: E402
from bitextkit.functions import vector as V  # noqa: E402


def _stats_a(spark, d, keep=("direction",), bleu=True, chrf=True, summed=True, store=False):
    h = fx.hyps(spark, d)
    h = fx.stored(h.select("direction", "hyp_a", "ref"), "hyps") if store else h
    return M.sentence_stats(h, "id", "hyp_a", "ref", keep=keep, bleu=bleu,
                            chrf=chrf, summed=summed)


@query("a01_corpus_bleu")
def a01(spark, d):
    return M.corpus_scores(_stats_a(spark, d, (), chrf=False), chrf=False).select(
        "n", "bleu", F.col("bleu_eff").alias("bleu_effective"))


@query("a02_corpus_chrf")
def a02(spark, d):
    return M.corpus_scores(_stats_a(spark, d, (), bleu=False), bleu=False)


@query("j03_clipped_matches")
def j03(spark, d):
    st = _stats_a(spark, d, (), summed=False)
    return st.select("id", "bleu_hyp_len", "bleu_ref_len",
                     *[f"bleu_m{n}" for n in M.BLEU_CODES],
                     *[f"chrf_m{k}" for k in range(1, 9)])


@query("a03_corpus_meteor")
def a03(spark, d):
    return ME.corpus_meteor(fx.hyps(spark, d), "hyp_a", "ref")


@query("j04_meteor_alignment")
def j04(spark, d):
    s = ME.sentence_meteor(fx.hyps(spark, d), "id", "hyp_a", "ref", keep=())
    return s.select("id", "hyp_len", "ref_len", "m", "chunks",
                    F.round("meteor", 6).alias("meteor"))


@query("a04_bertscore_f1")
def a04(spark, d):
    return ME.corpus_greedy_f1(fx.tok_emb(spark, d))


@query("a04_greedy_match")
def a04s(spark, d):
    return ME.greedy_match_f1(fx.tok_emb(spark, d))


def _bundle(spark, d, metrics):
    x = evaluate(fx.hyps(spark, d, store=len(metrics) > 1), metrics, "hyp_a", "ref", encoder_factory=SI.code_point_encoder())
    return x.select("metric", F.round("score", 4).alias("score"))


@query("a05_metric_bundle")
def a05(spark, d):
    return _bundle(spark, d, METRICS)


@query("a05_metric_subset")
def a05_subset(spark, d):
    return _bundle(spark, d, ("chrf", "bertscore"))


@query("a06_evaluate_by_direction")
def a06(spark, d):
    return M.evaluate_by(_stats_a(spark, d, store=True), "direction", overall="all")


@query("a06_evaluate_by_direction_matched")
def a06m(spark, d):
    return M.evaluate_by(_stats_a(spark, d), "direction", overall="matched")


@query("j01_pair_predictions")
def j01(spark, d):
    h = fx.hyps(spark, d, store=True)
    preds = h.filter(F.col("id") % 11 != 0).select("id", F.col("hyp_a").alias("prediction"))
    refs = h.filter(F.col("id") % 23 != 5).select("id", "ref", "direction")
    return M.pair_predictions(preds, refs, "id")


@query("u01_generate_rejected")
def u01(spark, d):
    p = fx.pairs(spark, d).withColumnRenamed("target", "preferred")
    return U.generate_rejected(p, SI.dropping_generator(3), batch_size=64)


@query("p07_to_dpo")
def p07(spark, d):
    p = fx.pairs(spark, d).withColumnRenamed("target", "preferred")
    g = U.generate_rejected(p, SI.dropping_generator(3), batch_size=64)
    from bitextkit.operators.pairs import to_dpo
    return to_dpo(g).select("pair_id", "direction", "prompt", "chosen", "rejected")


@query("p15_tokenize_pairs")
def p15(spark, d):
    t = U.tokenize_pairs(fx.pairs(spark, d), 8, 6)
    return t.select("pair_id", "direction", F.array_join("input_tokens", " ").alias("input_tokens"),
                    F.array_join("label_tokens", " ").alias("label_tokens"))


# ------------------------------------------------------------ significance

@query("j05_paired_scores")
def j05(spark, d):
    return fx.scores(spark, d)


@query("a16_randomization_test")
def a16(spark, d):
    return ST.randomization_test(fx.scores(spark, d), trials=10_000, seed=42)


@query("a17_cohens_d")
def a17(spark, d):
    return ST.cohens_d(fx.scores(spark, d), scale=10000.0)


# ------------------------------------------------------------ rewards and losses

@query("a08_cosine")
def a08(spark, d):
    return fx.vec_pairs(spark, d).select("vec_id", F.round(V.cosine("a", "b"), 6).alias("cosine"))


@query("a09_gamma_reward")
def a09(spark, d):
    c = V.cosine("a", "b")
    return fx.vec_pairs(spark, d).select(
        "vec_id", F.round(V.gamma_reward(c, 1.0), 6).alias("reward_phi1"),
        F.round(V.gamma_reward(c, 2.0), 6).alias("reward_phi2"))


PHIS = [0.1, 0.5, 1.0, 2.0]


@query("j07_phi_sweep")
def j07(spark, d):
    x = R.phi_sweep(R.with_cosine(fx.vec_pairs(spark, d)), PHIS)
    return x.select("vec_id", "phi", F.round("reward", 6).alias("reward"))


@query("a10_mean_reward_by_phi")
def a10(spark, d):
    m = R.mean_reward_by_phi(R.with_cosine(fx.vec_pairs(spark, d)), PHIS)
    return m.withColumn("mean_reward", F.round("mean_reward", 6))


@query("a11_seq_logprob")
def a11(spark, d):
    return fx.token_lp(spark, d).select(
        "vec_id", F.round(V.seq_logprob("token_lp", "labels"), 6).alias("logp"))


def _reward_rows(spark, d):
    vp = R.with_gamma_reward(R.with_cosine(fx.vec_pairs(spark, d)), "cosine", 1.0)
    lp = R.with_seq_logprob(fx.token_lp(spark, d)).select("vec_id", "logp")
    rows = vp.join(lp, "vec_id")
    return P.assign_batches(rows, 8, 42, ("vec_id",))


def _dpo_rows(spark, d):
    return P.assign_batches(fx.pref_lp(spark, d), 8, 42, ("id",))


@query("a12_reinforce_loss")
def a12(spark, d):
    return R.reinforce_loss(_reward_rows(spark, d)).withColumn("reinforce_loss", F.round("reinforce_loss", 6))


@query("a13_dpo_loss")
def a13(spark, d):
    return R.dpo_loss(_dpo_rows(spark, d), beta=0.1).withColumn("dpo_loss", F.round("dpo_loss", 6))


@query("a14_combined_loss")
def a14(spark, d):
    both = R.combined_loss(R.dpo_loss(_dpo_rows(spark, d), 0.1), R.reinforce_loss(_reward_rows(spark, d)))
    return both.withColumns({c: F.round(c, 6) for c in ("dpo_loss", "reinforce_loss", "total_loss")})


@query("a15_epoch_summary")
def a15(spark, d):
    pl = fx.pref_lp(spark, d).withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
    b = P.assign_batches(pl, 8, 42, ("id", "epoch"), by=("epoch",))
    per_batch = b.groupBy("epoch", "batch_id").agg(
        F.avg(-V.log_sigmoid(V.dpo_margin("pp", "rp", "pu", "ru", 0.1))).alias("dpo_loss"))
    return R.epoch_summary(per_batch, "dpo_loss").withColumn(
        "mean_dpo_loss", F.round("mean_dpo_loss", 6))


@query("u03_with_reward")
def u03(spark, d):
    x = fx.vec_pairs(spark, d).withColumnsRenamed({"a": "hyp_emb", "b": "ref_emb"})
    return R.with_reward(x, "HGR", phi=1.0).select("vec_id", F.round("reward", 6).alias("reward"))


@query("u05_model_reward")
def u05(spark, d):
    h = fx.hyps(spark, d).select("id", "source", "hyp_a", "ref")
    x = U.model_reward(h, SI.length_ratio_scorer(), batch_size=8, input_format="triple",
                       hyp="hyp_a", ref="ref")
    return x.select("id", F.round("reward", 6).alias("reward"))


@query("u02_embed")
def u02(spark, d):
    e = U.embed(fx.pairs(spark, d), "target", SI.hashing_encoder(32))
    return e.select("pair_id", "direction", F.size("embedding").alias("dim"),
                    F.round(V.l2norm("embedding"), 4).alias("norm"))


# ------------------------------------------------------------ sweep, ledger

@query("u06_sweep")
def u06(spark, d):
    return fx.sweep(spark, d)


@query("a18_best_run")
def a18(spark, d):
    return LG.best_run(fx.ledger(spark, d), "value", "iter")


@query("a18_best_decode")
def a18_decode(spark, d):
    return LG.best_run(fx.sweep(spark, d), "bleu", "config_id")


@query("l04_top_k")
def l04(spark, d):
    return LG.top_k(fx.ledger(spark, d), "value", 10, "iter")


@query("l04_top_decodes")
def l04_decodes(spark, d):
    return LG.top_k(fx.sweep(spark, d), "bleu", 10, "config_id")


@query("j06_param_grid")
def j06(spark, d):
    """The grid itself, with the number of evaluated sentences of every configuration."""
    n = fx.hyps(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", F.inline(LG.grid_array(fx.GRID)))


@query("l03_inspection_sample")
def l03(spark, d):
    h = fx.hyps(spark, d, store=True).select("id", "source", F.col("ref").alias("reference"),
                                 F.col("hyp_a").alias("prediction"), "direction")
    return P.sample_k(h, 30, 42, ("id",))


@query("w06_running_best")
def w06(spark, d):
    return LG.running_best(fx.ledger(spark, d), "track", "iter", "value", block=1024).select(
        "iter", "track", "value", "prev_best", "best_so_far", "keep")


@query("w07_gap_to")
def w07(spark, d):
    return LG.gap_to(fx.ledger(spark, d), target=25.0).select(
        "iter", "track", "gap_to_baseline", "gap_to_target")


@query("j08_metric_delta")
def j08(spark, d):
    ev = read_table(spark, d, "events").select(
        F.when(F.col("event_id") % 2 == 0, F.lit("baseline")).otherwise(F.lit("candidate"))
        .alias("run"), F.col("event_type").alias("metric"), "value")
    return LG.metric_delta(ev)


@query("f07_dialogue_funnel")
def f07_dialogue(spark, d):
    """F07 on the second, unmodified input (B2: user turn -> next assistant turn)."""
    return C.clean_parallel(fx.dialogue(spark, d))[1]


# ------------------------------------------------------------ sources and sinks: round trips of the given tables
# Each writes a table with a sink into the shared checkpoint folder and reads it with a source.

from bitextkit import sources as IO  # noqa: E402
from bitextkit.session import partitions_for, scratch_path  # noqa: E402


def _written(spark, name, write):
    path = scratch_path(spark, name)
    write(path)
    return path


def _csv(spark, d):
    return _written(spark, "csv", lambda p: IO.write_csv(
        fx.parallel(spark, d).select("pair_id", "tgt", "src"), p))     # other column, other order


@query("s01_read_tolerant_csv")
def s01(spark, d):
    return IO.read_parallel_csv(spark, _csv(spark, d), multi_line=False)


@query("s02_read_strict_csv")
def s02(spark, d):
    return IO.read_parallel_csv(spark, _csv(spark, d), tolerant=False, na_values=())


@query("s03_csv_quality")
def s03(spark, d):
    return IO.csv_quality(spark, _csv(spark, d))


@query("s01_read_multi_line_csv")
def s01_multi(spark, d):
    """Whole documents, line breaks and quotes inside their cells, read back from splits."""
    docs = read_table(spark, d, "documents").select(
        F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('",')).alias("src"), F.coalesce("text", F.lit("")).alias("tgt"))
    path = _written(spark, "multi-csv", lambda p: IO.write_csv(docs, p))
    rows = IO.read_parallel_csv(spark, path, na_values=(), multi_line="split")
    return rows.select("src", F.length("tgt").cast("long").alias("n_chars"), F.md5("tgt").alias("text_md5"))


@query("s04_load_jsonl")
def s04(spark, d):
    pairs = fx.clean(spark, d).select(F.col("src").alias("kangri"), F.col("tgt").alias("hindi"))
    path = _written(spark, "pairs", lambda p: pairs.write.json(p + "/pairs.jsonl")) + "/pairs.jsonl"
    return IO.load_parallel(spark, path, "kangri", "hindi").select("source", "target")


@query("s05_triplet_round_trip")
def s05(spark, d):
    t = u01(spark, d).select("source", "preferred", "unpreferred", "direction")
    path = _written(spark, "triplets", lambda p: IO.write_triplets(t, p + "/t.jsonl")) + "/t.jsonl"
    return IO.read_triplets(spark, path)


@query("s06_line_pairs")
def s06(spark, d):
    h = fx.hyps(spark, d, store=True)
    h = h.repartition(partitions_for(h), "id").sortWithinPartitions("id")
    a, b = (_written(spark, c, lambda p, c=c: h.select(c).write.option("compression", "gzip").text(p)) for c in ("hyp_a", "ref"))
    return IO.read_line_pairs(spark, a, b).select("prediction", "reference")


@query("s07_read_ledger")
def s07(spark, d):
    path = _written(spark, "ledger", lambda p: fx.ledger(spark, d).write.json(p))
    return IO.read_ledger(spark, path).select("iter", "track", "score")


@query("s08_scrape_metric")
def s08(spark, d):
    line = F.concat(F.lit("step FINAL_BLEU="), F.abs("value").cast("decimal(18,2)").cast("string"))
    log = fx.ledger(spark, d).orderBy("iter").select(F.coalesce(line, F.lit("no value")).alias("value"))
    return IO.scrape_metric(spark, _written(spark, "log", lambda p: log.write.text(p)))


@query("s11_metrics_document")
def s11(spark, d):
    """The nested metrics document of A06, written and read back as rows."""
    scores = M.evaluate_by(_stats_a(spark, d), "direction", overall="all").select(
        "direction", "n", F.col("bleu_eff").alias("bleu"), "chrf")
    path = _written(spark, "metrics", lambda p: IO.write_metrics(scores, p))
    doc = spark.read.schema("overall_bleu double, overall_chrf double, "
                            "per_direction map<string, struct<bleu: double, chrf: double, n: bigint>>").json(path)
    return doc.select("overall_bleu", "overall_chrf", F.explode("per_direction").alias("direction", "s")).select(
        "direction", "s.n", "s.bleu", "s.chrf", "overall_bleu", "overall_chrf")


@query("s13_split_round_trip")
def s13(spark, d):
    s = P.split_by(fx.pairs(spark, d, store=True)).select("pair_id", "direction", "split")
    return spark.read.parquet(_written(spark, "split", lambda p: IO.write_split(s, p))).select(
        "pair_id", "direction", "split")


# ------------------------------------------------------------ promised by the reference, without code there

from bitextkit.operators import anova as AN  # noqa: E402
from bitextkit.operators import leakage as LK  # noqa: E402
from bitextkit.operators.shared_split import split_groups  # noqa: E402


@query("s210_leakage_exclusion")
def leakage(spark, d):
    """Preference rows (both directions) without the pairs of the test split, in either order."""
    rows = fx.pairs(spark, d, store=True).select("pair_id", "direction", "source", "target")
    test = P.split_by(rows).filter(F.col("split") == "test")
    sides = (LK.bare_prompt("source"), F.col("target"))
    return LK.exclude_pairs(rows, test, sides, sides).select("pair_id", "direction")


@query("s210_shared_split")
def shared_split(spark, d):
    return split_groups(fx.pairs(spark, d, store=True), "pair_id").select("pair_id", "direction", "split")


def _by_event_type(spark, d):
    return read_table(spark, d, "events").select("user_id", "event_type", "value")


@query("s210_anova")
def anova(spark, d):
    a = AN.repeated_measures_anova(_by_event_type(spark, d), fx.EVENT_TYPES, "user_id", "event_type", "value")
    return a.select("n", "n_dropped", "k", "df_systems", "df_error", F.round("ss_systems", 3).alias("ss_systems"),
                    F.round("ss_subjects", 3).alias("ss_subjects"), F.round("ss_error", 3).alias("ss_error"),
                    F.round("f", 6).alias("f"), F.round("p_value", 6).alias("p_value"))


@query("s210_posthoc_t")
def posthoc(spark, d):
    t = AN.paired_t_tests(_by_event_type(spark, d), fx.EVENT_TYPES, "user_id", "event_type", "value")
    return t.select("system_a", "system_b", "n", "df", *[F.round(c, 6).alias(c) for c in (
        "mean_diff", "t", "p_value", "p_holm")])
