"""Session defaults for local runs, and the folder shared by all executors."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHECKPOINT_SETTING = "spark.checkpoint.dir"

_local_folders: dict[str, str] = {}
_record = threading.local()


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpuswright")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Small inputs are split finely enough to use all cores.
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.files.openCostInBytes", "256k")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder that survives the loss of an executor.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a session of one
    machine (``local[...]``) without that setting gets a fresh temporary folder.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="corpuswright-")
    return _local_folders[app]


def shared_path(spark: SparkSession, *parts: str) -> str:
    return "/".join([shared_folder(spark), "corpuswright", *parts])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate results of this application."""
    return shared_path(spark, "scratch", spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate results. Frames made from them can
    no longer be read."""
    for found in spark.catalog.listTables(pattern=_table_prefix(spark) + "*"):
        spark.sql(f"DROP TABLE IF EXISTS `{found.name}`")
    delete_path(spark, shared_path(spark, "scratch", spark.sparkContext.applicationId))


@contextmanager
def tracked() -> Iterator[list[tuple[str, str]]]:
    """Collects what :func:`materialized` and :func:`bucketed` store in this thread, as
    table name (or nothing) and path, so that it can be given back by :func:`release`."""
    outer = getattr(_record, "made", None)
    _record.made = []
    try:
        yield _record.made
    finally:
        if outer is not None:
            outer += _record.made
        _record.made = outer


def _stored(table: str, path: str) -> None:
    if getattr(_record, "made", None) is not None:
        _record.made.append((table, path))


def release(spark: SparkSession, made: list[tuple[str, str]], keep: DataFrame | None = None) -> None:
    """Delete tracked tables, except those that ``keep`` reads. Other frames made from them
    can no longer be read."""
    kept = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()} if keep is not None else set()
    for table, path in made:
        if path.rpartition("/")[2] not in kept:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS `{table}`")
            delete_path(spark, path)


def materialized(df: DataFrame) -> DataFrame:
    """Write to a new folder of the shared storage and read back.

    Cuts the lineage and keeps a result that several jobs need; a lost executor
    loses nothing of it.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.mode("errorifexists").parquet(path)
    _stored("", path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table_prefix(spark: SparkSession) -> str:
    return "corpuswright_" + re.sub(r"\W", "_", spark.sparkContext.applicationId).lower() + "_"


def bucketed(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """Like :func:`materialized`, but stored in buckets of ``column``, so that joins on it
    do not move these rows. The table's name goes with :func:`clear_scratch`."""
    spark = df.sparkSession
    name = _table_prefix(spark) + uuid.uuid4().hex
    buckets = buckets or scratch_partitions(spark)
    path = scratch_path(spark, "bucketed")
    df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(name)
    _stored(name, path)
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialized` has written and nobody reads again."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/corpuswright/scratch/" in path:
            delete_path(df.sparkSession, path)


def publish(spark: SparkSession, half: str, path: str) -> None:
    """Give a complete folder its final name, unless another job has done so before."""
    here, there = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (half, path))
    files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(there) or not files.rename(here, there):
        files.delete(here, True)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """One small file with this text, in any file system that Spark reaches. Fails if it
    exists, unless it may be overwritten."""
    jvm_path, files = _file_system(spark, path)
    out = files.create(jvm_path, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file only if there is none; of several that try, one succeeds."""
    try:
        write_text(spark, path, text)
    except Py4JJavaError:
        if not path_exists(spark, path):
            raise
        return False
    return True


def overwrite_text(spark: SparkSession, path: str, text: str) -> None:
    write_text(spark, path, text, overwrite=True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, if it exists."""
    jvm_path, files = _file_system(spark, path)
    if not files.exists(jvm_path):
        return None
    source = files.open(jvm_path)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def list_folder(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names in a folder and when each was last written, in milliseconds."""
    jvm_path, files = _file_system(spark, path)
    if not files.exists(jvm_path):
        return []
    return [(f.getPath().getName(), f.getModificationTime()) for f in files.listStatus(jvm_path)]


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """Small fixed table whose size the optimizer knows."""
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not rows:
        return spark.createDataFrame([], schema)
    columns = [pa.array(list(c)) for c in zip(*rows)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=schema.names), schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def scratch_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
