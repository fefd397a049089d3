"""Token-level losses, KL estimators and KL control."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, x))


def kl(p: Column, q: Column, kind: str) -> Column:
    """Estimate of the divergence at a token from log-probabilities p and reference q."""
    d = p - q
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        e = _clamp(q - p, -20.0, 20.0)
        return _clamp(F.exp(e) - e - 1, -10.0, 10.0)
    raise ValueError(kind)


def full_kl(p: Column, q: Column) -> Column:
    """The divergence of two arrays of log-probabilities over the vocabulary."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def penalised(score: Column, divergence: Column, mask: Column, coef: float) -> Column:
    """Token rewards less the weighted divergence where the mask is 1 (arrays)."""
    return F.zip_with(score, F.zip_with(divergence, mask, lambda k, m: k * m), lambda s, k: s - coef * k)


def average(df: DataFrame, value: str, mask: str, row: str, mode: str, eps: float = 1e-8) -> DataFrame:
    """Column loss: the mean over tokens, or the mean over rows (column row) of their means."""
    v, m = F.col(value) * F.col(mask), F.col(mask)
    if mode == "token":
        return df.agg((F.sum(v) / (F.sum(m) + eps)).alias("loss"))
    if mode == "seq":
        return df.groupBy(row).agg((F.sum(v) / (F.sum(m) + eps)).alias("v")).agg(F.avg("v").alias("loss"))
    raise ValueError(mode)


def policy_loss(old: Column, new: Column, advantage: Column, low: float, high: float, dual: float) -> dict[str, Column]:
    """Clipped surrogate loss of a token with its clip flags."""
    d = _clamp(new - old, -20.0, 20.0)
    plain = -advantage * F.exp(d)
    clipped = -advantage * F.exp(_clamp(d, math.log(1 - low), math.log(1 + high)))
    bound = -advantage * dual
    higher = F.greatest(plain, clipped)
    return {
        "loss": F.when(advantage < 0, F.least(higher, bound)).otherwise(higher),
        "clipped_higher": (plain < clipped).cast("double"),
        "clipped_lower": ((higher > bound) & (advantage < 0)).cast("double"),
        "kl": -d,
        "entropy": -new,
    }


def value_loss(predicted: Column, returns: Column, values: Column, clip: float) -> dict[str, Column]:
    """Half the greater of the plain and the clipped squared error of a token."""
    near = _clamp(predicted, values - clip, values + clip)
    a, b = (predicted - returns) * (predicted - returns), (near - returns) * (near - returns)
    return {"loss": 0.5 * F.greatest(a, b), "clipped": (a < b).cast("double"), "predicted": predicted}


class AdaptiveKL:
    """A coefficient that follows a target divergence."""

    def __init__(self, coef: float, target: float, horizon: float) -> None:
        self.coef, self.target, self.horizon = coef, target, horizon

    def update(self, now: float, steps: int) -> float:
        error = min(max(now / self.target - 1, -0.2), 0.2)
        self.coef *= 1 + error * steps / self.horizon
        return self.coef


class FixedKL:
    def __init__(self, coef: float) -> None:
        self.coef = coef

    def update(self, now: float, steps: int) -> float:
        return self.coef


def kl_controller(kind: str, coef: float, target: float = 0.0, horizon: float = 0.0):
    if kind == "fixed":
        return FixedKL(coef)
    if kind == "adaptive":
        if horizon <= 0:
            raise ValueError("horizon must be positive")
        return AdaptiveKL(coef, target, horizon)
    raise ValueError(kind)


def warmup(step: Column, steps: int) -> Column:
    return F.least(F.lit(1.0), step / max(1, steps))
