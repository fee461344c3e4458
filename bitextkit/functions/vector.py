"""Numeric column expressions on scalars and arrays.

Array math uses Spark's higher-order functions (``zip_with``, ``aggregate``)
so it is evaluated in the JVM without Python; float embeddings are widened to
double before any product.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_EPS = 1e-8     # fixed value: norm clamp of the cosine similarity
MASK_LABEL = -100   # fixed value: ignored label id


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _dsum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _dsum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2norm(a) -> Column:
    return F.sqrt(_dsum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b, eps: float = NORM_EPS) -> Column:
    """A.b / (max(|a|, eps) * max(|b|, eps)); a zero vector gives 0."""
    return dot(a, b) / (F.greatest(l2norm(a), F.lit(eps)) * F.greatest(l2norm(b), F.lit(eps)))


def gamma_reward(rho, phi=1.0) -> Column:
    """Rho * exp(-phi * rho)."""
    rho = _c(rho)
    phi = phi if isinstance(phi, Column) else F.lit(float(phi))
    return rho * F.exp(-phi * rho)


def seq_logprob(token_lp, labels, mask_label: int = MASK_LABEL) -> Column:
    """Sum of token log-probs where label != mask, over max(#unmasked, 1)."""
    kept = F.zip_with(_c(token_lp), _c(labels),
                      lambda lp, lab: F.when(lab != mask_label, lp.cast("double"))
                      .otherwise(F.lit(0.0)))
    n = F.size(F.filter(_c(labels), lambda lab: lab != mask_label))
    return _dsum(kept) / F.greatest(n, F.lit(1)).cast("double")


def log_sigmoid(z) -> Column:
    """Stable log(sigmoid(z)) = min(z, 0) - log(1 + exp(-|z|))."""
    z = _c(z)
    return F.least(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))


def dpo_margin(pp, rp, pu, ru, beta) -> Column:
    """beta * ((policy_pref - ref_pref) - (policy_unpref - ref_unpref))."""
    beta = beta if isinstance(beta, Column) else F.lit(float(beta))
    return beta * ((_c(pp) - _c(rp)) - (_c(pu) - _c(ru)))
