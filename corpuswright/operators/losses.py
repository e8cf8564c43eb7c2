"""Loss values as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DISCRIMINATOR_FACTOR
from ..functions.arrays import col
from ..functions.scores import bce_with_logits, cross_entropy
from .metrics import kept


def binary_loss(logit, label) -> Column:
    """Mean binary cross-entropy over the rows whose label is kept."""
    return F.avg(F.when(kept(label), bce_with_logits(logit, label)))


def class_loss(logits, label) -> Column:
    """Mean cross-entropy over the rows whose label is kept."""
    safe = F.when(kept(label), col(label))
    return F.avg(F.when(kept(label), cross_entropy(logits, safe)))


def squared_loss(prediction, label) -> Column:
    gap = col(prediction).cast("double") - col(label).cast("double")
    return F.avg(gap * gap)


def document_loss(prediction, label, regression: bool) -> Column:
    """Squared error for regression, otherwise cross-entropy on the logits."""
    return squared_loss(prediction, label) if regression else class_loss(prediction, label)


def combined_loss(generator, discriminator, factor: float = DISCRIMINATOR_FACTOR) -> Column:
    return col(generator) + F.lit(float(factor)) * col(discriminator)
