"""Training-log jobs: numbering steps, loss since the last log, gates, marks.

A run is a group of log rows ordered by time. One run may hold a large share of
the log, so nothing here needs a run in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import microseconds
from .ordering import carry_forward, global_index, range_buckets


def timeline(df: DataFrame, order: list[str], time: str) -> DataFrame:
    """Bucket rows by time (microseconds), then by the tie-breaking column."""
    return range_buckets(df.withColumn("_t", microseconds(df, time)), ["_t", *order[1:]]).drop("_t")


def number_steps(df: DataFrame, run: str, order: list[str], time: str) -> DataFrame:
    """1-based ``step`` of every row in its run, and ``last_step`` of the run."""
    return global_index(timeline(df, order, time), order, [run], out="step", total="last_step")


def window_of(step, size: int) -> Column:
    """0-based number of the window of ``size`` steps that ``step`` falls in."""
    return F.floor((F.col(step) - 1) / F.lit(float(size))).cast("bigint")


def logged_loss(steps: DataFrame, run: str, loss: str, every: int) -> DataFrame:
    """Per log (each ``every`` steps): growth of the running loss since the last
    log, divided by ``every``. The growth is the sum of the steps in between, so
    no running sum over the whole run is needed."""
    logs = steps.groupBy(run, window_of("step", every).alias("_w")).agg(
        F.max("step").alias("step"), F.count(F.lit(1)).alias("_rows"), F.sum(loss).alias("_sum")
    )
    return logs.where(F.col("_rows") == every).select(run, "step", (F.col("_sum") / F.lit(float(every))).alias("loss"))


def accumulated_loss(steps: DataFrame, run: str, loss: str, accumulation: int) -> DataFrame:
    """Per ``update`` the number of its sub-steps and the sum of their losses, each
    divided by the accumulation.

    An update that the run does not complete has ``is_update`` False: its sum is still
    pending at the end. Only a run that is not longer than the accumulation updates at
    its last step (as in :func:`periodic_marks`).
    """
    updates = steps.groupBy(run, window_of("step", accumulation).alias("update")).agg(
        F.count(F.lit(1)).alias("sub_steps"),
        F.sum(F.col(loss) / F.lit(float(accumulation))).alias("loss"),
        F.max("last_step").alias("_last"),
    )
    done = (F.col("sub_steps") == accumulation) | (F.col("_last") <= accumulation)
    return updates.withColumn("is_update", done).drop("_last")


def threshold_gate(
    df: DataFrame, run: str, metric: str, order: list[str], time: str, threshold: float, out: str = "gate"
) -> DataFrame:
    """True while the run's latest metric is above the threshold.

    A missing metric keeps the state, which starts as True.
    """
    decided = df.withColumn("_decided", F.col(metric) > F.lit(float(threshold)))
    return carry_forward(
        timeline(decided, order, time), "_decided", order, [run], out, F.lit(True)
    ).drop("_decided")


def periodic_marks(
    log: int, evaluate: int, save: int, accumulation: int = 1, step: str = "step", last_step: str = "last_step"
) -> dict[str, Column]:
    """Which actions follow a sub-step.

    An update happens every ``accumulation`` sub-steps, and at the last one of an
    epoch that is not longer than the accumulation. Actions are due every so many
    updates.
    """
    here, last = F.col(step), F.col(last_step)
    short = (here == last) & (last <= accumulation)
    update = (F.pmod(here, F.lit(accumulation)) == 0) | short
    number = F.ceil(here / F.lit(float(accumulation))).cast("bigint")

    def due(every):
        return update & (F.pmod(number, F.lit(every)) == 0)

    return {
        "is_update": update, "update_no": number,
        "do_log": due(log), "do_evaluate": due(evaluate), "do_save": due(save),
    }
