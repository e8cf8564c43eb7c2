"""Metric ledger: metrics as rows, configuration as a text map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import col
from ..functions.text import with_prefix
from ..operators.metrics import macro_score
from ..session import delete_path, publish

# Configuration keys shown before all others.
FIRST_CONFIG_KEYS = ["learning_rate", "pretrain_path", "num_hidden_layers"]


def sanitized(config: dict) -> dict[str, str | None]:
    """Configuration as text: plain values as Spark prints them, the rest as str."""
    out = {}
    for key, value in config.items():
        out[key] = str(value).lower() if isinstance(value, bool) else str(value)
    return out


def config_map(config: dict) -> Column:
    entries = sanitized(config)
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv]) if entries else F.create_map()


def config_json(**columns) -> Column:
    """JSON text of plain values and columns."""
    fields = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in columns.items()]
    return F.to_json(F.struct(*fields))


def to_rows(wide: DataFrame, run: Column, metrics: list[str], label: str, step: Column) -> DataFrame:
    """Wide metrics to ``(run, step, metric, value)``; keys get label and prefix."""
    entries = F.array(
        *[F.struct(F.lit(f"{label}_{m}").alias("key"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    long = wide.select(run.alias("run"), step.alias("step"), F.explode(entries).alias("m"))
    return long.select("run", "step", with_prefix(F.col("m.key")).alias("metric"), F.col("m.value").alias("value"))


def append(ledger: DataFrame, path: str) -> None:
    """Append ledger rows, one folder per run.

    Rows are spread by run and metric, so that a run with many rows is written by
    several tasks.
    """
    ledger.repartition("run", "metric").write.mode("append").partitionBy("run").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("run", F.col("run").cast("string"))


def metric_order(metric="metric") -> list[Column]:
    """Sort keys: metrics with AUC in their name first, then by name."""
    return [F.when(F.contains(col(metric), F.lit("AUC")), 0).otherwise(1).asc(), col(metric).asc()]


def config_order(key="key") -> list[Column]:
    """Sort keys: the leading configuration keys in their order, then by name."""
    place = F.array_position(F.array(*[F.lit(k) for k in FIRST_CONFIG_KEYS]), col(key))
    return [F.when(place > 0, place).otherwise(len(FIRST_CONFIG_KEYS) + 1).asc(), col(key).asc()]


def task_results(tasks: DataFrame, ledger: DataFrame, subset: str = "run") -> DataFrame:
    """Tasks with the value of their chosen metric; tasks not run drop out."""
    values = ledger.select(F.col(subset).alias("subset"), "metric", F.col("value").alias("result"))
    return tasks.join(values, ["subset", "metric"])


def suite_score(results: DataFrame) -> DataFrame:
    return results.agg(macro_score("result").alias("score"), F.count("result").alias("n_tasks"))



# --- exactly once --------------------------------------------------------------

# Rows of one key are told apart by this: the latest counts.
SEQUENCE = "seq"


def record_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows ``run, step, metric, value, seq`` of one batch, in place of what an
    earlier attempt at the same batch has left. A batch has a folder of its own, so a
    replay changes nothing and no other row is rewritten."""
    wanted = rows.select("run", "step", "metric", F.col("value").cast("double").alias("value"), F.col(SEQUENCE).cast("long").alias(SEQUENCE))
    wanted.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def record_stream(rows: DataFrame, path: str, checkpoint: str):
    """A stream of ledger rows, recorded batch by batch: a writer to be started."""
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: record_batch(batch, path, number))


def latest(spark: SparkSession, path: str) -> DataFrame:
    """One row per run, step and metric, the one of greatest ``seq``; of equals the greatest
    value, nulls least. Merged before the shuffle."""
    rows = spark.read.parquet(path)
    last = F.max(F.struct(SEQUENCE, "value")).alias("last")
    return rows.groupBy("run", "step", "metric").agg(last).select("run", "step", "metric", "last.value", f"last.{SEQUENCE}")


def compact(spark: SparkSession, path: str, up_to: int) -> None:
    """Put the batches up to a finished one into one folder. The new folder is complete
    before the old ones go, and reading both gives the same rows."""
    old = [i for i in batches(spark, path) if i <= up_to]
    if len(old) < 2:
        return
    folders = [f"{path.rstrip('/')}/batch={i}" for i in old]
    merged = spark.read.parquet(*folders).groupBy("run", "step", "metric").agg(F.max(F.struct(SEQUENCE, "value")).alias("last"))
    half = f"{path.rstrip('/')}/_compact-{up_to}"
    merged.select("run", "step", "metric", "last.value", f"last.{SEQUENCE}").write.mode("overwrite").parquet(half)
    # Negative numbers are no stream's batches; a second compaction takes the first one along.
    publish(spark, half, f"{path.rstrip('/')}/batch={-up_to - 1}")
    for folder in folders:
        delete_path(spark, folder)


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the recorded batches; negative ones are compacted."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(root)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch="))
