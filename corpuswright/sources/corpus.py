"""Corpus scan, read-through cache of prepared corpora, and the text sink."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..session import create_text, delete_path, list_folder, overwrite_text, path_exists, read_text, shared_path


def scan(spark: SparkSession, name_or_path: str) -> DataFrame:
    """Parquet at an existing path, otherwise the table of that name."""
    if path_exists(spark, name_or_path):
        return spark.read.parquet(name_or_path)
    return spark.read.table(name_or_path)


def select_split(df: DataFrame, names: list[str] | str) -> DataFrame:
    names = [names] if isinstance(names, str) else list(names)
    return df.where(F.col("split").isin(names))


def prune(df: DataFrame, columns: tuple[str, ...] = ("input_ids",), label: str = "label") -> DataFrame:
    """Only the model's columns; the label comes along if there is one."""
    return df.select(*columns, *([label] if label in df.columns else []))


def require_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Downstream rows must each have a label; a missing one fails the job."""
    missing = F.raise_error(F.lit("row without a label")).cast(df.schema[label].dataType)
    return df.withColumn(label, F.when(F.col(label).isNotNull(), F.col(label)).otherwise(missing))


def file_state(df: DataFrame) -> str:
    """Digest of the files behind a scan: names, sizes and times of change, from the
    file system's listing; no row is read."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    state = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        state.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr(state).encode()).hexdigest()


def cache_path(spark: SparkSession, name: str, subset: str | None, options: dict) -> str:
    """``<shared>/data/<name>-<subset>-<digest>.cache``; the digest covers every
    option that changes the rows, the vocabulary included, and this package's
    version. With the option ``run`` set to this application's id the cache is one of
    its intermediate results, and goes with them."""
    keyed = json.dumps([__version__, options], sort_keys=True)
    digest = hashlib.sha256(keyed.encode()).hexdigest()[:16]
    app = spark.sparkContext.applicationId
    where = ("scratch", app, "data") if options.get("run") == app else ("data",)
    return shared_path(spark, *where, f"{name}-{subset}-{digest}.cache")


COMMIT, LEASE = "_COMMIT", "_USED"
COMMIT_WAITS = 100


def cached(
    spark: SparkSession, name: str, subset: str | None, options: dict, build: Callable[[], DataFrame]
) -> DataFrame:
    """Prepared corpus: read if it was written before, else built and written.

    Each attempt writes a folder of its own; the first one to create the commit file, which
    names the folder, wins, and the others give theirs up. No rename is needed, so it holds
    on object stores too, and a reader sees a whole corpus or none. Every use renews the
    lease that :func:`evict` looks at.
    """
    path = cache_path(spark, name, subset, options)
    found = committed(spark, path)
    if found is None:
        attempt = f"attempt-{uuid.uuid4().hex}"
        build().write.mode("errorifexists").parquet(f"{path}/{attempt}")
        if not create_text(spark, f"{path}/{COMMIT}", attempt):
            delete_path(spark, f"{path}/{attempt}")
        found = committed(spark, path)
    overwrite_text(spark, f"{path}/{LEASE}", found)
    return spark.read.parquet(f"{path}/{found}")


def committed(spark: SparkSession, path: str) -> str | None:
    """The folder that a cache's commit file names, if there is one. A file that another job
    has created but not yet filled is waited for."""
    for _ in range(COMMIT_WAITS):
        found = read_text(spark, f"{path}/{COMMIT}")
        if found != "":
            return found
        time.sleep(0.1)
    raise RuntimeError(f"{path}/{COMMIT} stays empty: its writer was lost, so delete it")


def evict(spark: SparkSession, unused_ms: int) -> list[str]:
    """Delete caches that nobody has used for so long, and attempts without commit that are as
    old. The commit goes first, so no reader finds half a cache; a reader that has begun
    just before may fail and is to be run again. Names of what was deleted."""
    root = shared_path(spark, "data")
    now, gone = int(time.time() * 1000), []
    for name, _ in list_folder(spark, root):
        if not name.endswith(".cache"):
            continue
        inside = dict(list_folder(spark, f"{root}/{name}"))
        last = inside.get(LEASE, max(inside.values(), default=0))
        if now - last >= unused_ms:
            delete_path(spark, f"{root}/{name}/{COMMIT}")
            delete_path(spark, f"{root}/{name}")
            gone.append(name)
    return gone


def write_lines(df: DataFrame, path: str, column: str = "text") -> None:
    """Each text followed by a newline; newlines inside a text stay."""
    df.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def require_sizes(splits: DataFrame) -> DataFrame:
    """Rows per split; train and validation must not be empty, test may be."""
    sizes = splits.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    found = {r["split"]: r["n"] for r in sizes.collect()}
    for needed in ("train", "validation"):
        if not found.get(needed):
            raise ValueError(f"the {needed} set is empty")
    return sizes
