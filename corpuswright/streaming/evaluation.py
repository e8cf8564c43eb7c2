"""Running evaluation of a log stream, and the gate that follows it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.clock import instant
from ..operators.metrics import confusion, confusion_metrics

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# Scores are ranked at this resolution; a power of two, so that bins of a double are exact.
AUC_BINS = 1 << 14

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed(
    log: DataFrame, time: str, width: str, delay: str, aggregates: list[Column], keys: list[str] = ()
) -> DataFrame:
    """Tumbling-window aggregates; rows later than ``delay`` are dropped.

    Rows are combined before the shuffle, and state is one row per window and
    key, so a key with very many rows costs no more than others.
    """
    clocked = log.withColumn("_at", instant(log, time)).withWatermark("_at", delay)
    grouped = clocked.groupBy(F.window("_at", width), *keys).agg(*aggregates)
    bounds = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    return grouped.select(*bounds, *[c for c in grouped.columns if c != "window"])


def area_under_curve(bins) -> tuple[Column, Column]:
    """AUC from a list of ``bin, positives, negatives``, and how far it can be from that of
    the scores themselves: pairs of one bin count half, whichever of the two is higher."""
    start = F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("area"), F.lit(0.0).alias("tied"), F.lit(0.0).alias("positives"))

    def add(acc, b):
        y, n = b["positives"].cast("double"), b["negatives"].cast("double")
        return F.struct(
            (acc["below"] + n).alias("below"), (acc["area"] + y * (acc["below"] + n / 2)).alias("area"),
            (acc["tied"] + y * n / 2).alias("tied"), (acc["positives"] + y).alias("positives"),
        )

    def share(name):
        return F.aggregate(F.sort_array(bins), start, add, lambda acc: F.try_divide(acc[name], acc["below"] * acc["positives"]))

    return share("area"), share("tied")


def evaluation_log(
    log: DataFrame, time: str, probability: Column, label: Column, loss: str, width: str, delay: str, bins: int = AUC_BINS
) -> DataFrame:
    """Rows, mean loss, confusion counts, their metrics and the AUC per logging window.

    State is one row per window and score bin, merged as rows arrive; a closed window's bins,
    at most ``bins``, are then summed up. ``auc_error`` bounds what binning can change. The AUC
    is null where all labels are equal; rows without a probability are not ranked.
    """
    scored = log.withColumns({"_probability": probability, "_label": label})
    place = F.least(F.floor(F.col("_probability") * bins), F.lit(bins - 1))
    counts = {"n": F.count(F.lit(1)), "loss_sum": F.sum(loss), "loss_n": F.count(loss), **confusion("_probability", "_label")}
    marked = {"positives": F.count_if(F.col("_label") == 1), "negatives": F.count_if(F.col("_label") == 0)}
    clocked = scored.withColumn("_at", instant(scored, time)).withWatermark("_at", delay).withColumn("_bin", place)
    binned = clocked.groupBy(F.window("_at", width).alias("window"), "_bin").agg(*[e.alias(k) for k, e in {**counts, **marked}.items()])
    ranked = F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct("_bin", "positives", "negatives")))
    whole = binned.groupBy(F.window(F.window_time("window"), width).alias("window")).agg(
        *[F.sum(k).alias(k) for k in counts], ranked.alias("bins")
    )
    auc, error = area_under_curve("bins")
    return whole.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n",
        F.try_divide("loss_sum", "loss_n").alias("loss"), *confusion("_probability", "_label"),
        *[e.alias(k.lower()) for k, e in confusion_metrics().items()], auc.alias("auc"), error.alias("auc_error"),
    )


class GateProcessor(StatefulProcessor):
    """Keeps one flag per run: was the latest metric above the threshold?"""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "open boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # One row per evaluation, not per log row: a run's new rows are few.
        found = self.state.get()
        state = bool(found[0]) if found is not None else True
        out = []
        for row in sorted(rows, key=lambda r: (r["at"] is None, r["at"] or 0)):
            metric = row["metric"]
            if not _absent(metric):
                state = bool(metric > self.threshold)
            out.append(Row(run=key[0], at=row["at"], gate=state))
        self.state.update((state,))
        return iter(out)

    def close(self) -> None:
        pass


def _absent(metric: float | None) -> bool:
    return metric is None or metric != metric


def gate_stream(evaluations: DataFrame, threshold: float) -> DataFrame:
    """Gate per evaluation from a stream of ``(run, window_start, metric)``.

    Rows go to the state as they are, many runs to an Arrow batch: a frame for every run
    would cost more than all the rest of it.
    """
    micros = evaluations.select("run", F.unix_micros("window_start").alias("at"), F.col("metric").cast("double").alias("metric"))
    gates = micros.groupBy("run").transformWithState(
        statefulProcessor=GateProcessor(threshold),
        outputStructType="run bigint, at bigint, gate boolean",
        outputMode="append",
        timeMode="none",
    )
    return gates.select("run", F.timestamp_micros("at").alias("window_start"), "gate")


class RunGateProcessor(StatefulProcessor):
    """The gate by event time, for runs that report out of order and end.

    Evaluations wait in a list until the watermark has passed them; a timer at each one's
    time takes all that are due, in order of time. A run that has been silent for ``idle``
    starts anew with an open gate, and a second timer takes its state out of the store.
    """

    def __init__(self, threshold: float, idle_ms: int):
        self.threshold, self.idle_ms = threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, metric double")
        self.gate = handle.getValueState("gate", "open boolean, last bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = [(r["at"], None if _absent(r["metric"]) else float(r["metric"])) for r in rows]
        due = [(at, m) for at, m in due if at is not None and at > passed * 1000]
        if due:
            self.waiting.appendList(due)
            # One timer: when it fires, it sees to the next one.
            self.handle.registerTimer(_fires(min(at for at, _ in due)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [(r[0], r[1]) for r in self.waiting.get()]
        due = sorted((h for h in held if _fires(h[0]) <= passed), key=lambda h: (h[0], h[1] is not None, h[1] or 0.0))
        found = self.gate.get()
        is_open, last = found if found is not None else (True, None)
        out = []
        for at, metric in due:
            restarted = last is None or at - last > self.idle_ms * 1000
            if restarted:
                is_open = True
            if metric is not None:
                is_open = metric > self.threshold
            last = at
            out.append(Row(run=key[0], at=at, gate=bool(is_open), restarted=restarted))
        rest = [h for h in held if _fires(h[0]) > passed]
        ended = last is not None and last + self.idle_ms * 1000 < passed * 1000
        if due:
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(_fires(min(at for at, _ in rest)))
            else:
                self.waiting.clear()
        if ended:
            self.gate.clear()
        elif due:
            self.gate.update((bool(is_open), last))
            self.handle.registerTimer(_fires(last + self.idle_ms * 1000) + 1)
        return iter(out)

    def close(self) -> None:
        pass


def _fires(micros: int) -> int:
    """The first millisecond at or after a moment."""
    return -(-micros // 1000)


def run_gate_stream(evaluations: DataFrame, threshold: float, delay: str, idle_ms: int) -> DataFrame:
    """``run, window_start, gate, restarted`` per evaluation of a stream ``run, window_start,
    metric`` in which a run's rows may come up to ``delay`` late, in any order.

    A row is given out once the watermark has passed it; later ones are dropped. Rows of
    one moment count in order of their metric, nulls first, which leave the gate as it is. After
    more than ``idle_ms`` of event time without an evaluation a run is over: its next one
    starts with an open gate. State is what waits and one flag per live run.
    """
    clocked = evaluations.withWatermark("window_start", delay)
    micros = clocked.select("run", "window_start", "metric", F.unix_micros("window_start").alias("at"))
    gates = micros.groupBy("run").transformWithState(
        statefulProcessor=RunGateProcessor(threshold, idle_ms),
        outputStructType="run bigint, at bigint, gate boolean, restarted boolean",
        outputMode="append",
        timeMode="eventTime",
    )
    return gates.select("run", F.timestamp_micros("at").alias("window_start"), "gate", "restarted")


def use_rocksdb(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB store; a cluster may have set it already."""
    if spark.conf.get(STATE_STORE, "") != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)
