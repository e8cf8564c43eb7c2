"""Encoding of arriving documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.text import sentences
from ..operators.encode import encode_words


ROWS_PER_FILE = 20_000


def deliver(
    df: DataFrame, arrival: Column, path: str, order: str, rows_per_file: int = ROWS_PER_FILE,
    batches: int | None = None, apart: bool = False,
) -> int:
    """Write a table as the files of a stream, dated so that they are read in the order of
    ``arrival`` (whole numbers from 0), then of the column ``order``. Files are ranges of
    both, so their number grows with the table; none holds rows of two arrivals.

    Returns how many files to read in a micro-batch so that ``batches`` are enough for all, one
    without that number. Each micro-batch costs the same for its state and its logs, so it is
    the files in one that have to grow, not the micro-batches. With ``apart`` no micro-batch
    has rows of two arrivals: empty files fill up what an arrival's last one lacks.
    """
    spark = df.sparkSession
    rows = df.withColumn("_arrival", arrival)
    n = -(-df.count() // rows_per_file)
    rows.repartitionByRange(max(1, n), "_arrival", order).write.partitionBy("_arrival").parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = root.getFileSystem(conf)
    found: dict[int, list] = {}
    for folder in files.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("_arrival="):
            parts = [f.getPath() for f in files.listStatus(folder.getPath())]
            # Named by the number of their range.
            found[int(name.partition("=")[2])] = sorted(parts, key=lambda p: int(p.getName().split("-")[1]))
    at_once = max(1, -(-sum(map(len, found.values())) // batches)) if batches else 1
    if apart and at_once > 1:
        spark.createDataFrame([], df.schema).coalesce(1).write.parquet(f"{path}/_empty")
        empty = next(f.getPath() for f in files.listStatus(root.suffix("/_empty")) if f.getPath().getName().startswith("part-"))
        copy = spark._jvm.org.apache.hadoop.fs.FileUtil.copy
        for parts in found.values():
            folder = parts[0].getParent()
            for i in range(-len(parts) % at_once):
                filler = folder.suffix(f"/filler-{i}.parquet")
                copy(files, empty, files, filler, False, conf)
                parts.append(filler)
    in_order = [file for _, parts in sorted(found.items()) for file in parts]
    start = files.getFileStatus(root).getModificationTime() - 1000 * (len(in_order) + 1000)
    for i, file in enumerate(in_order):
        files.setTimes(file, start + 1000 * i, -1)
    return at_once


def read_files(spark: SparkSession, folder: str, schema, files_at_once: int | None = None) -> DataFrame:
    """Stream of Parquet files, at most ``files_at_once`` to a micro-batch, so that a
    backlog is worked off in parts."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(folder)


def run_to_end(writer) -> None:
    """Process everything that is there now, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def encode_stream(docs: DataFrame, keep: list[str], vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """Nested ``input_ids`` of streamed documents, next to the ``keep`` columns.

    The same map as in batch, against a vocabulary read once at the start; it has
    no state, and a document is one row.
    """
    return encode_words(docs, sentences(text), vocabulary).select(*keep, "input_ids")


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Append finished rows to Parquet; the sink's log keeps each of them once."""
    run_to_end(
        rows.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
