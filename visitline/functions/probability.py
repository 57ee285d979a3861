"""Expressions over a probability vector held in an ARRAY<DOUBLE> column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Clipping constants of the uncertainty and log-loss definitions.
ENTROPY_FLOOR = 1e-15
LOG_LOSS_EPS = 2.220446049250313e-16


def vector(*cols: Column | str) -> Column:
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in cols])


def confidence(prob: Column) -> Column:
    return F.array_max(prob)


def predicted_class(prob: Column) -> Column:
    """Index of the largest probability, the first one on ties."""
    return (F.array_position(prob, F.array_max(prob)) - 1).cast("int")


def entropy(prob: Column, size: int | None = None) -> Column:
    """Clipped Shannon entropy; with a known ``size`` the sum is written out, which Spark compiles."""

    def term(p: Column) -> Column:
        clipped = F.least(F.greatest(p, F.lit(ENTROPY_FLOOR)), F.lit(1.0))
        return clipped * F.log(clipped)

    if size is not None:
        return F.when(prob.isNotNull(), -sum((term(F.get(prob, F.lit(i))) for i in range(size)), F.lit(0.0)))
    return -F.aggregate(F.transform(prob, term), F.lit(0.0), lambda acc, x: acc + x)


def margin(prob: Column) -> Column:
    ranked = F.sort_array(prob, asc=False)
    return F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))


def total(prob: Column) -> Column:
    return F.aggregate(prob, F.lit(0.0), lambda acc, x: acc + x)


def renormalize(prob: Column) -> Column:
    t = total(prob)
    return F.transform(prob, lambda p: p / t)


def clipped_log_loss(p: Column) -> Column:
    return -F.log(F.least(F.greatest(p, F.lit(LOG_LOSS_EPS)), F.lit(1.0 - LOG_LOSS_EPS)))


def brier(prob: Column, truth: Column, size: int | None = None) -> Column:
    """Sum of squared gaps between the vector and the one-hot truth.

    With a known ``size`` the sum is written out, which Spark compiles into one expression.
    """
    if size is not None:
        gaps = [F.get(prob, F.lit(i)) - F.when(truth == i, 1.0).otherwise(0.0) for i in range(size)]
        return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
    gaps = F.transform(prob, lambda p, i: F.pow(p - F.when(i == truth, 1.0).otherwise(0.0), F.lit(2.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)


def vote_weights(n_members: int, weights: Sequence[float] | None) -> list[float]:
    """Normalised non-negative voting weights; uniform when none are given."""
    values = [1.0] * n_members if weights is None else [float(w) for w in weights]
    if not values:
        raise ValueError("Soft voting needs at least one member.")
    if len(values) != n_members:
        raise ValueError(f"Got {len(values)} weights for {n_members} members.")
    if any(w < 0 for w in values):
        raise ValueError("Voting weights must be non-negative.")
    if sum(values) <= 0:
        raise ValueError("Voting weights must sum to a positive value.")
    return [w / sum(values) for w in values]


def _scaled(prob: Column, weight: float) -> Column:
    return F.transform(prob, lambda p: p * F.lit(weight))


def soft_vote(members: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Weighted mean of member vectors, put back on the simplex."""
    mixed = None
    for member, weight in zip(members, vote_weights(len(members), weights)):
        scaled = _scaled(member, weight)
        mixed = scaled if mixed is None else F.zip_with(mixed, scaled, lambda a, b: a + b)
    return renormalize(mixed)


def calibrated_or_base(calibrated: Column, base: Column) -> Column:
    """Renormalised calibrated vector; a row whose calibrated mass is zero keeps its base vector."""
    return renormalize(F.when(total(calibrated) <= 0, base).otherwise(calibrated))


def off_simplex(prob: Column) -> Column:
    return F.abs(total(prob) - F.lit(1.0))
