"""Evaluation metrics as aggregate columns and grouped jobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import IGNORE, VOCAB_SIZE
from ..functions.arrays import argmax, col
from ..functions.scores import class_one, nan_to_zero, ratio, sigmoid, softmax
from ..session import materialized
from .ordering import range_buckets, running_total
from .skew import salted_lookup

CONFUSION = ("tp", "fp", "tn", "fn")


def positive_probability(logits, mode: str = "sigmoid") -> Column:
    """Probability of class 1 from one logit (``sigmoid``) or two (``softmax``)."""
    if mode == "sigmoid":
        return sigmoid(logits)
    if mode == "softmax":
        return F.element_at(softmax(logits), 2)
    raise ValueError(f"unknown mode {mode!r}")


def two_class_score(logits, mode: str = "sigmoid") -> Column:
    """Score of a two-logit row: by default the second logit on its own."""
    return positive_probability(class_one(logits) if mode == "sigmoid" else logits, mode)


def confusion(probability, label, threshold: float = 0.5) -> dict[str, Column]:
    """Counts of the four outcomes; predicted positive at or above the threshold."""
    yes, y = col(probability) >= F.lit(threshold), col(label)
    return {
        "tp": F.count_if(yes & (y == 1)),
        "fp": F.count_if(yes & (y == 0)),
        "tn": F.count_if(~yes & (y == 0)),
        "fn": F.count_if(~yes & (y == 1)),
    }


def confusion_metrics(tp="tp", fp="fp", tn="tn", fn="fn") -> dict[str, Column]:
    """Accuracy, precision, recall, F1 and MCC; every 0/0 counts as 0.

    All products are taken in doubles, so that counts cannot overflow.
    """
    tp, fp, tn, fn = (col(c).cast("double") for c in (tp, fp, tn, fn))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    margins = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return {
        "ACCURACY": ratio(tp + tn, tp + fp + tn + fn),
        "PRECISION": precision,
        "RECALL": recall,
        "F1": ratio(F.lit(2.0) * precision * recall, precision + recall),
        "MCC": ratio(tp * tn - fp * fn, margins),
    }


def binary_metrics(df: DataFrame, probability: str, label: str, group: list[str] = ()) -> DataFrame:
    """Confusion counts and their metrics per group, in one aggregation."""
    counts = df.groupBy(*group).agg(*[e.alias(k) for k, e in confusion(probability, label).items()])
    return counts.select("*", *[e.alias(k) for k, e in confusion_metrics().items()])


def _ranked_scores(df: DataFrame, score: str, label: str, group: list[str]) -> DataFrame:
    """One row per group and distinct score: ``_pos`` and ``_neg`` labels, and
    ``_before``, the negatives at lower scores.

    Equal scores are merged first, so that a frequent score is one row before
    anything is sorted. The merged rows are stored: the input is read once.
    """
    merged = materialized(
        df.select(*group, F.col(score).cast("double").alias("_score"), label)
        .groupBy(*group, "_score")
        .agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    )
    return running_total(range_buckets(merged, ["_score"]), "_neg", ["_score"], group)


def _area() -> Column:
    """Aggregate over ranked scores: area under the ROC curve, ties counting half;
    null if one class is missing."""
    pos, neg = F.col("_pos").cast("double"), F.col("_neg").cast("double")
    wins = F.sum(pos * (F.col("_before").cast("double") + neg / F.lit(2.0)))
    return F.try_divide(wins, F.sum(pos) * F.sum(neg))


def auc(df: DataFrame, score: str, label: str, group: list[str] = ()) -> DataFrame:
    """Area under the ROC curve per group."""
    ranked = _ranked_scores(df, score, label, list(group))
    return ranked.groupBy(*group).agg(_area().alias("AUC"))


def binary_report(
    df: DataFrame, probability: str, label: str, group: list[str] = (), threshold: float = 0.5
) -> DataFrame:
    """Confusion counts, their metrics and the AUC per group, from one reading."""
    ranked = _ranked_scores(df, probability, label, list(group))
    yes = F.col("_score") >= F.lit(threshold)

    def total(where: Column, counts: str) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(counts))), F.lit(0)).cast("bigint")

    counts = ranked.groupBy(*group).agg(
        total(yes, "_pos").alias("tp"), total(yes, "_neg").alias("fp"),
        total(~yes, "_neg").alias("tn"), total(~yes, "_pos").alias("fn"), _area().alias("AUC"),
    )
    return counts.select("*", *[e.alias(k) for k, e in confusion_metrics().items()])


def average_ranks(values: DataFrame, value: str, weight: str, out: str) -> DataFrame:
    """Add the rank of each distinct value when it stands for ``weight`` rows;
    equal rows share the mean of their ranks."""
    ranked = running_total(range_buckets(values, [value]), weight, [value])
    mean = F.col("_before").cast("double") + (F.col(weight).cast("double") + F.lit(1.0)) / F.lit(2.0)
    return ranked.select(*values.columns, mean.alias(out))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman and Pearson correlation (one row, ``SPEARMAN_CORR`` and
    ``PEARSON_CORR``) from one reading of the values; undefined gives 0.

    Equal pairs are merged first. Ranks go back to the pairs by a salted join, so
    a value shared by very many pairs is not one task's work.
    """
    pairs = materialized(
        df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .where("_x is not null and _y is not null")
        .groupBy("_x", "_y")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = pairs
    for value, other, rank in (("_x", "_y", "_rx"), ("_y", "_x", "_ry")):
        # _rows rows stand behind a value; it occurs in _pairs rows of the join.
        per_value = pairs.groupBy(value).agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_pairs"))
        ranks = materialized(average_ranks(per_value, value, "_rows", rank).drop("_rows"))
        ranked = salted_lookup(ranked, ranks, value, [other], "_pairs")
    n = F.col("_n").cast("double")
    total = pairs.agg(F.sum("_n")).scalar().cast("double")
    middle = (total + F.lit(1.0)) / F.lit(2.0)
    means = [pairs.agg(F.sum(F.col(v) * n) / F.sum("_n")).scalar() for v in ("_x", "_y")]

    def moments(names: tuple[str, str, str], a, b) -> list[Column]:
        return [F.sum(n * p * q).alias(k) for k, p, q in zip(names, (a, a, b), (b, a, b))]

    sums = ranked.agg(
        *moments(("rxy", "rxx", "ryy"), F.col("_rx") - middle, F.col("_ry") - middle),
        *moments(("xy", "xx", "yy"), F.col("_x") - means[0], F.col("_y") - means[1]),
    )
    return sums.select(
        ratio("rxy", F.sqrt("rxx") * F.sqrt("ryy")).alias("SPEARMAN_CORR"),
        ratio("xy", F.sqrt("xx") * F.sqrt("yy")).alias("PEARSON_CORR"),
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation (one row, ``SPEARMAN_CORR``); undefined gives 0."""
    return correlations(df, x, y).select("SPEARMAN_CORR")


def pearson(x, y) -> Column:
    """Aggregate: Pearson correlation, 0 where undefined.

    ``corr`` itself fails on constant input when ANSI arithmetic is on.
    """
    x, y = col(x).cast("double"), col(y).cast("double")
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def multiclass_accuracy(logits, label) -> Column:
    """Aggregate: share of rows whose largest logit is the label's."""
    return nan_to_zero(F.avg((argmax(logits) == col(label)).cast("double")))


def kept(label) -> Column:
    """True where a label is to be scored."""
    return col(label) != IGNORE


def token_accuracy(prediction, label) -> Column:
    """Aggregate over token rows: share of scored positions predicted right."""
    return nan_to_zero(F.avg(F.when(kept(label), (col(prediction) == col(label)).cast("double"))))


_COUNTS = ["selected", "right", "replaced", "replaced_right"]


def masked_accuracy(corrupted: DataFrame, prediction: str = "sampled_input_ids") -> DataFrame:
    """Accuracy over the selected positions, counted inside each row's arrays.

    ``mlm_accuracy`` takes all selected positions; the ones left unreplaced show
    their own id and are always right. ``replaced_accuracy`` leaves those out.
    """
    names = ["masked", "replaced", "labels_generator", prediction]

    def counts(lists: list[pa.Array]) -> list[int]:
        masked, replaced, target, predicted = (x.flatten() for x in lists)
        right = pc.fill_null(pc.equal(predicted, target), False)
        masked, replaced = pc.fill_null(masked, False), pc.fill_null(replaced, False)
        each = (masked, pc.and_(masked, right), replaced, pc.and_(replaced, right))
        return [pc.sum(x, min_count=0).as_py() for x in each]

    def run(batches):
        for batch in batches:
            lists = [batch.column(i) for i in range(4)]
            widths = [pc.fill_null(pc.list_value_length(x), -1) for x in lists]
            if not all(w.equals(widths[0]) for w in widths):
                # Lists of unequal length: what is missing at an end is not known.
                most = [max(w) for w in zip(*(w.to_pylist() for w in widths))]
                lists = [pa.array([[*(v or []), *[None] * (n - len(v or []))] for v, n in zip(x.to_pylist(), most)], x.type) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in counts(lists)], _COUNTS)

    found = corrupted.select(*names).mapInArrow(run, ", ".join(f"{c} bigint" for c in _COUNTS))
    sums = found.agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return sums.select(
        "selected", "replaced",
        ratio("right", "selected").alias("mlm_accuracy"),
        ratio("replaced_right", "replaced").alias("replaced_accuracy"),
    )


def document_loss_sums(corrupted: DataFrame, tokens: DataFrame, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """``doc_id, s, n, gs, gn`` per row: sum and number of the token-level losses, and of the
    generator's losses. ``tokens`` has ``id, logit, surprise`` for at most ``vocab_size`` ids,
    which travel to the tasks; other ids are left out."""
    rows = tokens.select("id", "logit", "surprise").orderBy("id").limit(vocab_size + 1).collect()
    if len(rows) > vocab_size:
        raise ValueError(f"more than {vocab_size} tokens have a logit")
    ids = np.array([r["id"] for r in rows], np.int64)
    logit, surprise = (np.array([r[c] for r in rows], np.float64) for c in ("logit", "surprise"))

    def sums(batch: pa.RecordBatch, name: str, label: str, loss) -> tuple[pa.Array, pa.Array]:
        lists = batch.column(label)
        rows = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        x, y = (pc.fill_null(batch.column(c).flatten(), IGNORE).to_numpy(zero_copy_only=False) for c in (name, label))
        at = np.flatnonzero(y != IGNORE)
        place = np.minimum(np.searchsorted(ids, x[at]), max(len(ids) - 1, 0))
        known = ids[place] == x[at] if len(ids) else np.zeros(len(at), bool)
        at, place = at[known], place[known]
        n = np.bincount(rows[at], minlength=len(lists))
        total = np.bincount(rows[at], loss(place, y[at]), len(lists))
        return pa.array(total.astype(np.float64), mask=n == 0), pa.array(n.astype(np.int64), mask=n == 0)

    def judged(place, label):
        # The stable form of the binary cross entropy of a logit.
        x = logit[place]
        return np.maximum(x, 0.0) - x * label + np.log1p(np.exp(-np.abs(x)))

    def run(batches):
        for batch in batches:
            s, n = sums(batch, "sampled_input_ids", "labels_at_token_level", judged)
            gs, gn = sums(batch, "labels_generator", "labels_generator", lambda place, _: surprise[place])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), s, n, gs, gn], ["doc_id", "s", "n", "gs", "gn"])

    lists = ["sampled_input_ids", "labels_at_token_level", "labels_generator"]
    kind = corrupted.schema["doc_id"].dataType.simpleString()
    return corrupted.select("doc_id", *lists).mapInArrow(run, f"doc_id {kind}, s double, n bigint, gs double, gn bigint")


def evaluation_loss(batches: DataFrame, loss: str, examples: str, compat: bool = False) -> Column:
    """Aggregate over one row per batch (mean loss, number of examples).

    The mean over examples, or with ``compat`` the sum of batch means divided by
    the number of examples, which shrinks as batches grow.
    """
    weighted = F.col(loss) if compat else F.col(loss) * F.col(examples)
    return ratio(F.sum(weighted), F.sum(examples))


def macro_score(result) -> Column:
    """Aggregate: plain mean of the chosen metric over the tasks that were run."""
    return F.avg(col(result))
