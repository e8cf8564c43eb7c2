"""Corpus catalogue: what each corpus holds and which kind of task it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_spec
from ..session import local_table

ENTRY = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("subset", T.StringType(), True),
    T.StructField("text_columns", T.ArrayType(T.StringType()), False),
    T.StructField("validation_set_names", T.ArrayType(T.StringType()), False),
    T.StructField("test_set_names", T.ArrayType(T.StringType()), False),
    T.StructField("sentence_segmentation", T.BooleanType(), False),
    T.StructField("num_clf_classes", T.IntegerType(), False),
    T.StructField("num_regr", T.IntegerType(), False),
])

_V, _T = ["validation"], ["test"]
_V2, _T2 = ["validation_matched", "validation_mismatched"], ["test_matched", "test_mismatched"]

# Name, subset, text columns, validation splits, test splits,
# sentence segmentation, number of classes, number of regression labels.
ENTRIES = [
    ("glue", "cola", ["sentence"], _V, _T, False, 2, 0),
    ("glue", "sst2", ["sentence"], _V, _T, False, 2, 0),
    ("glue", "mrpc", ["sentence1", "sentence2"], _V, _T, False, 2, 0),
    ("glue", "qqp", ["question1", "question2"], _V, _T, False, 2, 0),
    ("glue", "stsb", ["sentence1", "sentence2"], _V, _T, False, 0, 1),
    ("glue", "mnli", ["premise", "hypothesis"], _V2, _T2, False, 3, 0),
    ("glue", "qnli", ["question", "sentence"], _V, _T, False, 2, 0),
    ("glue", "rte", ["sentence1", "sentence2"], _V, _T, False, 2, 0),
    ("glue", "wnli", ["sentence1", "sentence2"], _V, _T, False, 2, 0),
    ("imdb", None, ["text"], ["test"], [], True, 2, 0),
    ("wikipedia", "20200501.en", ["text"], [], [], False, 0, 0),
    ("bookcorpus", None, ["text"], [], [], False, 0, 0),
    ("openwebtext", None, ["text"], [], [], False, 0, 0),
]

# The task suite (subset, reported metric, epochs).
TASKS = [
    ("cola", "eval_label_MCC", 3),
    ("sst2", "eval_label_ACCURACY", 3),
    ("mrpc", "eval_label_ACCURACY", 3),
    ("stsb", "eval_label_SPEARMAN_CORR", 10),
    ("qqp", "eval_label_ACCURACY", 3),
    ("mnli", "eval_label_ACCURACY", 3),
    ("qnli", "eval_label_ACCURACY", 3),
    ("rte", "eval_label_ACCURACY", 10),
    ("wnli", "eval_label_ACCURACY", 3),
]


def with_task_kind(entries: DataFrame) -> DataFrame:
    """Derived flags. An entry is regression only when it has regression labels."""
    classes, regressions = F.col("num_clf_classes"), F.col("num_regr")
    downstream = (classes > 0) | (regressions > 0)
    return entries.withColumns({
        "is_classification": classes > 0,
        "is_regression": regressions > 0,
        "is_downstream": downstream,
        "is_pretraining": ~downstream,
    })


def catalog(spark: SparkSession) -> DataFrame:
    return with_task_kind(local_table(spark, ENTRIES, ENTRY))


def lookup(entries: DataFrame, name: str, subset: str | None = None) -> DataFrame:
    """The one entry with this name and subset (null matches null)."""
    found = entries.where((F.col("name") == name) & F.col("subset").eqNullSafe(F.lit(subset)))
    n = found.limit(2).count()
    if n != 1:
        raise LookupError(f"{'no' if n == 0 else 'more than one'} catalogue entry for {name}, {subset}")
    return found


def resolve(specs: DataFrame, entries: DataFrame, spec: str = "spec") -> DataFrame:
    """Null-safe lookup of many specs at once; unmatched specs keep null columns. Two
    entries for one spec are an error, as in :func:`lookup`."""
    parsed = specs.withColumn("_p", parse_spec(spec))
    n = F.count(F.lit(1)).over(Window.partitionBy("name", "subset"))
    twice = F.raise_error(F.lit("more than one catalogue entry for a spec")).cast("string")
    entries = entries.withColumn("_n", n).withColumn("name", F.when(F.col("_n") == 1, F.col("name")).otherwise(twice)).drop("_n")
    known = entries.withColumnsRenamed({"name": "_name", "subset": "_subset"})
    match = (F.col("_p.name") == F.col("_name")) & F.col("_p.subset").eqNullSafe(F.col("_subset"))
    return parsed.join(known, match, "left").drop("_name", "_subset").withColumns(
        {"name": F.col("_p.name"), "subset": F.col("_p.subset")}
    ).drop("_p")


def valid_selection() -> list[Column]:
    """Aggregates that judge a selection of entries: ``n_entries`` and ``valid``.

    Valid is: all entries are pretraining, or there is exactly one and it is
    downstream; and no entry has both kinds of label.
    """
    n = F.count(F.lit(1))
    one_kind = F.every((F.col("num_clf_classes") == 0) | (F.col("num_regr") == 0))
    kinds = F.every("is_pretraining") | ((n == 1) & F.every("is_downstream"))
    return [n.alias("n_entries"), F.coalesce(kinds & one_kind, F.lit(False)).alias("valid")]


def check_selection(entries: DataFrame) -> None:
    row = entries.agg(*valid_selection()).first()
    if not row["n_entries"]:
        raise ValueError("no corpus selected")
    if not row["valid"]:
        raise ValueError("select pretraining corpora only, or exactly one downstream corpus")


def zip_ratios(spark: SparkSession, names: list[str], ratios: list[float] | float) -> DataFrame:
    """Positional pairing of corpora and sampling ratios; lengths must agree."""
    if isinstance(ratios, float):
        ratios = [ratios]
    if len(names) != len(ratios):
        raise ValueError("as many ratios as corpora are needed")
    both = local_table(spark, [(names, [float(r) for r in ratios])], "name array<string>, ratio array<double>")
    pairs = F.explode(F.arrays_zip("name", "ratio"))
    return both.select(pairs.alias("p")).select("p.name", "p.ratio")


def tasks(spark: SparkSession) -> DataFrame:
    rows = [(i, *t) for i, t in enumerate(TASKS)]
    return local_table(spark, rows, "ordinal int, subset string, metric string, epochs int")


def task_range(task_table: DataFrame, start: int = 0, end: int | None = None, size: int | None = None) -> DataFrame:
    """Tasks with ``start <= ordinal < end``; ``size`` bounds both ends."""
    if size is not None and not 0 <= start < size:
        raise ValueError("start outside the task list")
    if end is not None and (end <= 0 or (size is not None and end > size)):
        raise ValueError("end outside the task list")
    kept = task_table.where(F.col("ordinal") >= start)
    return kept if end is None else kept.where(F.col("ordinal") < end)
