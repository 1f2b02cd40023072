"""Expressions over logit and probability vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from strandwise.functions.keys import let


def softmax(logits: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    values = logits.cast("array<double>")
    raised = let(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))
    return let(
        raised,
        lambda r: let(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(r, lambda x: x / total)),
    )


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def max_prob(probs: Column) -> Column:
    return F.array_max(probs)


def top_k(probs: Column, k: int) -> Column:
    """The k best classes as array of struct(class, prob), best first, lower class first on ties."""
    pairs = F.transform(probs, lambda p, i: F.struct((-p).alias("neg"), i.alias("class")))
    return F.transform(
        F.slice(F.array_sort(pairs), 1, k),
        lambda s: F.struct(s["class"].alias("class"), (-s["neg"]).alias("prob")),
    )


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def cross_entropy(logits: Column, target: Column, weights: Sequence[float] | None = None) -> Column:
    """-log softmax at the true class, times the class weight."""
    values = logits.cast("array<double>")
    loss = let(
        F.array_max(values),
        lambda top: F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top - F.get(values, target),
    )
    return loss if weights is None else loss * F.get(F.array(*[F.lit(float(w)) for w in weights]), target)


def focal_loss(
    logits: Column, target: Column, gamma: float = 2.0, weights: Sequence[float] | None = None
) -> Column:
    """(1 - p_true)^gamma times the weighted cross-entropy."""
    plain = cross_entropy(logits, target)
    return F.pow(1.0 - F.exp(-plain), F.lit(gamma)) * cross_entropy(logits, target, weights)


def one_vs_rest_focal_loss(
    logits: Column,
    target: Column,
    gamma: float = 1.0,
    alpha_pos: Sequence[float] | None = None,
    alpha_neg: Sequence[float] | None = None,
) -> Column:
    """Sum over classes of sigmoid focal terms with separate weights for the true and other classes."""

    def weight(alpha: Sequence[float] | None, i: Column) -> Column:
        return F.lit(1.0) if alpha is None else F.get(F.array(*[F.lit(float(a)) for a in alpha]), i)

    def term(x: Column, i: Column) -> Column:
        z = x.cast("double")
        p = F.lit(1.0) / (1.0 + F.exp(-z))
        hit = F.pow(F.greatest(1.0 - p, F.lit(1e-6)), F.lit(gamma)) * _softplus(-z) * weight(alpha_pos, i)
        miss = F.pow(F.greatest(p, F.lit(1e-6)), F.lit(gamma)) * _softplus(z) * weight(alpha_neg, i)
        return F.when(i == target, hit).otherwise(miss)

    return F.aggregate(F.transform(logits, term), F.lit(0.0), lambda a, x: a + x)
