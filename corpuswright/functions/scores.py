"""Scalar and array expressions on logits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import argmax, array_sum, col

# Below this a uniform draw is raised before taking logarithms.
TINY = 1e-12


def nan_to_zero(x) -> Column:
    return F.coalesce(F.nanvl(col(x).cast("double"), F.lit(0.0)), F.lit(0.0))


def ratio(numerator, denominator) -> Column:
    """Double quotient with 0/0 (and x/0) as 0."""
    return F.coalesce(F.try_divide(col(numerator).cast("double"), col(denominator).cast("double")), F.lit(0.0))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x).cast("double")))


def _with_each(values, one, combine) -> Column:
    """Combine every entry with ``one``, which is evaluated once per row: inside a
    lambda it would be evaluated once per entry."""
    return F.zip_with(values, F.array_repeat(one, F.size(values)), combine)


def _shifted(logits) -> tuple[Column, Column]:
    """Exponentials of the logits less their largest, and that one."""
    logits = F.transform(col(logits), lambda x: x.cast("double"))
    peak = F.array_max(logits)
    return _with_each(logits, peak, lambda x, p: F.exp(x - p)), peak


def softmax(logits) -> Column:
    shifted, _ = _shifted(logits)
    return _with_each(shifted, array_sum(shifted), lambda x, total: x / total)


def log_sum_exp(logits) -> Column:
    shifted, peak = _shifted(logits)
    return peak + F.ln(array_sum(shifted))


def class_one(logits) -> Column:
    """Second logit of a two-class row."""
    return F.element_at(col(logits), 2)


def bce_with_logits(logit, label) -> Column:
    x, y = col(logit).cast("double"), col(label).cast("double")
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def cross_entropy(logits, label) -> Column:
    """Negative log-likelihood of the 0-based class ``label``."""
    picked = F.element_at(col(logits), (col(label) + 1).cast("int")).cast("double")
    return log_sum_exp(logits) - picked


def gumbel(draw) -> Column:
    safe = F.least(F.greatest(draw, F.lit(TINY)), F.lit(1.0 - TINY))
    return -F.ln(-F.ln(safe))


def gumbel_argmax(logits, draw_of_index, temperature: float = 1.0) -> Column:
    """0-based index sampled from ``softmax(logits / temperature)``.

    ``draw_of_index`` maps the index column to that entry's uniform draw.
    """
    if temperature <= 0 or math.isnan(temperature):
        raise ValueError("temperature must be positive")
    noisy = F.transform(
        col(logits), lambda x, i: x.cast("double") / F.lit(float(temperature)) + gumbel(draw_of_index(i))
    )
    return argmax(noisy)
