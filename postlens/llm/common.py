"""What the operators share: words, lines, scratch tables, checked inputs."""

from __future__ import annotations

import contextlib
import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import remove_path, scratch_path

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Spark's setting to remove a query's shuffle files when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written under the cluster's shared folder and read back: cuts the
    lineage, survives lost executors, and gives later joins a plain scan whose
    size is known and whose skewed partitions adaptive execution can split."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with tidy(spark):
        df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
        remove_path(table.sparkSession, path)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """What is written here leaves no shuffle files: Spark removes them as soon
    as the write has ended, not when the driver happens to collect the plan.
    Later steps read the table, so nothing asks for them again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def text_of(col: str | Column = "text") -> Column:
    """A text with null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_array(text: Column) -> Column:
    """Words: the runs of characters outside ``SPACES``. All white space becomes
    plain spaces first, because a split at one plain character needs no regex."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def squeezed(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, SPACES, "")


def line_array(text: Column) -> Column:
    """The \\n-separated lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def worker_cache(name: str, make: Callable):
    """``make()``, kept under ``name`` for the life of a Python worker, which
    runs many tasks: what is slow to set up is set up once in each worker."""
    kept = sys.modules.setdefault("_postlens_worker", types.ModuleType("_postlens_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def worker_forget(name: str) -> None:
    """Drops what an earlier stage kept under ``name`` in this worker."""
    kept = sys.modules.get("_postlens_worker")
    if kept is not None:
        kept.__dict__.pop(name, None)
