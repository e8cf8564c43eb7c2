"""Encoded documents to aligned, batched feature rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BOS, CHUNK_LENGTH, MAX_LENGTH, MAX_SENTENCE_LENGTH, MAX_SENTENCES, PAD, SEP
from ..functions.arrays import (
    cap_sentences,
    chunk_width,
    close_sentences,
    pad_right,
    position_numbers,
    sequence_numbers,
)
from ..functions.hashing import uniform, uniform_index
from .ordering import global_index, range_buckets

VECTORS = ("input_ids", "position_ids", "sequence_ids")


@dataclass(frozen=True)
class FeatureConfig:
    """Limits for feature rows; None, the default, is no limit."""

    max_sentence_length: int | None = None
    max_sentences: int | None = None
    max_length: int | None = None
    chunk_length: int = CHUNK_LENGTH
    seed: int = 42
    epoch: int = 0
    include_last: bool = False
    slice_positions: bool = False


WHOLE = FeatureConfig()
LIMITED = FeatureConfig(MAX_SENTENCE_LENGTH, MAX_SENTENCES, MAX_LENGTH)


def numbered(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), ids: str = "input_ids") -> DataFrame:
    """Truncate the sentences, then flatten to ids, positions and sentence numbers."""
    nested = close_sentences(cap_sentences(ids, cfg.max_sentences), cfg.max_sentence_length)
    return df.withColumn("_nested", nested).withColumns({
        "input_ids": F.flatten("_nested"),
        "position_ids": position_numbers("_nested"),
        "sequence_ids": sequence_numbers("_nested"),
    }).drop("_nested")


def segment_offset(length: Column, key: str, cfg: FeatureConfig) -> Column:
    """0-based start of the segment; new for every epoch.

    The last start is not drawn unless ``include_last`` is set.
    """
    room = length - cfg.max_length + (1 if cfg.include_last else 0)
    draw = uniform(cfg.seed, f"segment:{cfg.epoch}", key)
    return F.when(length > cfg.max_length, uniform_index(draw, room)).otherwise(F.lit(0)).cast("int")


def cut_segment(df: DataFrame, offset: str, cfg: FeatureConfig) -> DataFrame:
    """Cut the three vectors at ``offset`` and repair the ends.

    A shifted segment starts with BOS, and every cut one ends with SEP. Positions
    and sentence numbers are the document's first ones, unless
    ``slice_positions`` asks for those of the segment.
    """
    n, start = cfg.max_length, F.col(offset)
    long = F.size("input_ids") > n
    body = F.slice("input_ids", start + 2, F.lit(max(n - 2, 0)))
    first = F.when(start > 0, F.lit(BOS)).otherwise(F.element_at("input_ids", 1))
    head = F.array(first) if n > 1 else F.array().cast("array<int>")
    other_start = start + 1 if cfg.slice_positions else F.lit(1)
    cut = {"input_ids": F.concat(head, body, F.array(F.lit(SEP)))}
    cut |= {c: F.slice(c, other_start, F.lit(n)) for c in VECTORS[1:]}
    return df.withColumns({c: F.when(long, e).otherwise(F.col(c)) for c, e in cut.items()})


def features(df: DataFrame, key: str, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Feature rows: one map over the encoded documents, no shuffle."""
    out = numbered(df, cfg)
    if not cfg.max_length:
        return out
    out = out.withColumn("offset", segment_offset(F.size("input_ids"), key, cfg))
    return cut_segment(out, "offset", cfg)


def assign_batches(df: DataFrame, key: str, batch_size: int) -> DataFrame:
    """``batch_id``: consecutive rows in key order, ``batch_size`` to a batch."""
    indexed = global_index(range_buckets(df, [key]), [key], out="_rn")
    return indexed.withColumn("batch_id", F.floor((F.col("_rn") - 1) / F.lit(float(batch_size))).cast("bigint")).drop(
        "_rn"
    )


def pad_batches(batched: DataFrame, cfg: FeatureConfig = FeatureConfig(), to_chunk: bool = False) -> DataFrame:
    """Pad all vectors to the longest row of their batch (at most batch_size rows)."""
    width = F.max(F.size("input_ids")).over(Window.partitionBy("batch_id"))
    out = batched.withColumn("width", width)
    if to_chunk:
        out = out.withColumn("width", chunk_width("width", cfg.chunk_length))
    return out.withColumns({c: pad_right(c, "width", PAD) for c in VECTORS})


def batched(df: DataFrame, key: str, batch_size: int, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Encoded documents in, feature rows with ``batch_id`` and ``width`` out, not yet padded.

    Batches and widths are settled on keys and sizes; the rows themselves are moved
    once, to meet their batch. Keys are unique.
    """
    rows = features(df, key, cfg)
    sizes = assign_batches(rows.select(key, F.size("input_ids").alias("_size")), key, batch_size)
    widths = sizes.select(key, "batch_id", F.max("_size").over(Window.partitionBy("batch_id")).alias("width"))
    return rows.join(widths, key)


def collate(df: DataFrame, key: str, batch_size: int, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Encoded documents in, padded batches out: :func:`batched`, and padding as a map."""
    return batched(df, key, batch_size, cfg).withColumns({c: pad_right(c, "width", PAD) for c in VECTORS})


def resume(batched: DataFrame, global_step: int, steps_per_epoch: int) -> DataFrame:
    """Batches still to do in the epoch that ``global_step`` falls in."""
    return batched.where(F.col("batch_id") >= global_step % steps_per_epoch).withColumn(
        "epoch", F.lit(global_step // steps_per_epoch)
    )


def feature_violations(cfg: FeatureConfig = FeatureConfig(), max_position: int | None = None) -> list[Column]:
    """Aggregates counting the rows that break an invariant of feature rows."""
    if max_position is not None and cfg.max_length and max_position < cfg.max_length:
        raise ValueError("the position limit is below max_length")
    missing = F.lit(False)
    for c in VECTORS:
        missing = missing | F.col(c).isNull()
    uneven = (F.size("input_ids") != F.size("position_ids")) | (F.size("input_ids") != F.size("sequence_ids"))
    out = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(missing).alias("missing"),
        F.count_if(uneven).alias("uneven"),
    ]
    if cfg.max_sentence_length and cfg.max_sentences:
        limit = cfg.max_sentence_length * cfg.max_sentences
        out.append(F.count_if(F.size("input_ids") > limit).alias("too_wide"))
    return out


def step_plan(
    n: Column, batch: int, accumulation: int, epochs: float, log_every: int, eval_every: int | float
) -> dict[str, Column]:
    """Step counts for ``n`` training rows; whole-number intervals are in rows,
    a fractional evaluation interval is a share of an epoch."""
    effective = batch * accumulation
    per_epoch = F.greatest(F.floor(n / F.lit(float(effective))), F.lit(1)).cast("bigint")
    if isinstance(eval_every, int):
        evals = F.lit(eval_every // effective).cast("bigint")
    else:
        evals = F.floor(F.lit(eval_every) * (n / F.lit(float(effective)))).cast("bigint")
    return {
        "steps_per_epoch": per_epoch,
        "max_steps": F.ceil(F.lit(float(epochs)) * per_epoch).cast("bigint"),
        "log_steps": F.lit(log_every // effective).cast("bigint"),
        "eval_steps": evals,
    }
