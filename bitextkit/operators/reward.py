"""Reward and loss scoring on tables: cosine (A08), gamma reward (A09), phi
sweep (J07) and its mean (A10), sequence log-prob (A11), REINFORCE (A12),
DPO (A13), combined loss (A14), epoch summary (A15), and the reward column
by name (U03).

Batch losses are aggregates keyed by ``batch_id`` (from W04), so they run
with partial aggregation; REINFORCE with the batch-mean baseline is minus the
population covariance of reward and log-probability, one built-in aggregate.
Nothing is rounded here, so losses may be added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextkit.functions.vector import cosine, dpo_margin, gamma_reward, log_sigmoid, seq_logprob

# Defaults of the reference's loss configuration.
DEFAULT_PHI = 1.0
DEFAULT_BETA = 0.1
DEFAULT_ALPHA = 0.5
DEFAULT_GAMMA = 0.5
PRINTED_WEIGHT_OFFSET = 0.1


def with_cosine(df: DataFrame, a: str = "a", b: str = "b", out: str = "cosine") -> DataFrame:
    """A08."""
    return df.withColumn(out, cosine(a, b))


def with_gamma_reward(df: DataFrame, rho: str = "cosine", phi: float = DEFAULT_PHI,
                      out: str = "reward") -> DataFrame:
    """A09."""
    return df.withColumn(out, gamma_reward(rho, phi))


def phi_sweep(df: DataFrame, phis, rho: str = "cosine") -> DataFrame:
    """Every row under every phi -- a Generate over a literal array (a
    driver-side parameter list), not a join."""
    arr = F.array(*[F.lit(float(p)) for p in phis])
    return df.withColumn("phi", F.explode(arr)).withColumn(
        "reward", gamma_reward(F.col(rho), F.col("phi")))


def mean_reward_by_phi(df: DataFrame, phis, rho: str = "cosine") -> DataFrame:
    """A10: mean reward per phi and the printed weight (mean + 0.1)."""
    s = phi_sweep(df, phis, rho).groupBy("phi").agg(F.avg("reward").alias("_m"),
                                                      F.count(F.lit(1)).cast("long").alias("n"))
    return s.select("phi", "n", F.col("_m").alias("mean_reward"),
                    F.round(F.col("_m") + PRINTED_WEIGHT_OFFSET, 4).alias("weight"))


def with_seq_logprob(df: DataFrame, token_lp: str = "token_lp", labels: str = "labels",
                     out: str = "logp") -> DataFrame:
    """A11."""
    return df.withColumn(out, seq_logprob(token_lp, labels))


def reinforce_loss(df: DataFrame, reward: str = "reward", logp: str = "logp",
                   by: str = "batch_id") -> DataFrame:
    """Per batch -mean((r - mean_batch(r)) * logp), over the rows that have
    both values."""
    return df.groupBy(by).agg(F.count(F.lit(1)).cast("long").alias("n"),
                              (-F.covar_pop(reward, logp)).alias("reinforce_loss"))


def dpo_loss(df: DataFrame, beta: float = DEFAULT_BETA, by: str | None = "batch_id",
             pp: str = "pp", rp: str = "rp", pu: str = "pu", ru: str = "ru") -> DataFrame:
    """-mean(logsigmoid(beta * ((pp - rp) - (pu - ru)))) per batch (or overall)."""
    per_row = -log_sigmoid(dpo_margin(pp, rp, pu, ru, beta))
    g = df.groupBy(by) if by else df.groupBy()
    out = g.agg(F.avg(per_row).alias("_l"), F.count(F.lit(1)).cast("long").alias("n"))
    cols = ([by] if by else []) + ["n", F.col("_l").alias("dpo_loss")]
    return out.select(*cols)


def combined_loss(dpo: DataFrame, reinforce: DataFrame, alpha: float = DEFAULT_ALPHA,
                  gamma: float = DEFAULT_GAMMA, by: str = "batch_id") -> DataFrame:
    """Alpha * DPO + gamma * REINFORCE per batch (batches present in both)."""
    j = dpo.select(by, "dpo_loss").join(reinforce.select(by, "reinforce_loss"), by)
    return j.select(by, "dpo_loss", "reinforce_loss",
                    (F.lit(alpha) * F.col("dpo_loss") + F.lit(gamma) * F.col("reinforce_loss")).alias("total_loss"))


def epoch_summary(batch_losses: DataFrame, loss: str = "dpo_loss", epoch: str = "epoch") -> DataFrame:
    """Mean of batch losses per epoch (a short last batch weighs the same)."""
    return batch_losses.groupBy(epoch).agg(
        F.count(F.lit(1)).cast("long").alias("batches"),
        F.avg(loss).alias(f"mean_{loss}"))


REWARDS = ("hgr", "bleurt", "comet")


def with_reward(df: DataFrame, reward: str = "hgr", out: str = "reward", **params) -> DataFrame:
    """A reward column chosen by name (case-insensitive).

    ``hgr``: gamma reward of the cosine between embedding columns
    ``hyp_emb``/``ref_emb`` (params ``hyp_emb``, ``ref_emb``, ``phi``), native.
    ``bleurt`` / ``comet``: a user scorer over text columns via
    :func:`bitextkit.operators.infer.model_reward` (param ``scorer_factory``).
    """
    name = reward.lower()
    if name not in REWARDS:
        raise ValueError(f"unknown reward {reward!r}; expected one of {REWARDS}")
    if name == "hgr":
        he, re_ = params.get("hyp_emb", "hyp_emb"), params.get("ref_emb", "ref_emb")
        return df.withColumn(out, gamma_reward(cosine(he, re_), params.get("phi", DEFAULT_PHI)))
    from bitextkit.operators.infer import model_reward
    factory = params.get("scorer_factory")
    if factory is None:
        raise ValueError(f"reward {name!r} needs scorer_factory")
    fmt = "concat" if name == "bleurt" else "triple"
    return model_reward(df, factory, batch_size=params.get("batch_size", 8), input_format=fmt, out=out,
                        src=params.get("src", "source"), hyp=params.get("hyp", "hyp"),
                        ref=params.get("ref", "ref"))
