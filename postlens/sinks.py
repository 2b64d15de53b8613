"""Sinks for analysis results and validation rows.

Row-level results are written by all tasks in parallel; only results with a
bounded size (top-k, one row per class or language) may be folded into one
file with ``single_file=True``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import file_system, path_exists


def write_result(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = False, mode: str = "overwrite") -> None:
    """Header CSV (or any file format) replacing a previous result."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_accuracy(preds: DataFrame, path: str) -> None:
    """Validation rows ``(Actual, Predicted, Text)``: tab-separated, header,
    gzip, appended to what is there."""
    (
        preds.write.mode("append")
        .option("header", True)
        .option("sep", "\t")
        .option("compression", "gzip")
        .csv(path)
    )


def write_training_csv(corpus: DataFrame, path: str) -> None:
    """``(id, polarity, status)`` as the header-less six-column corpus; the
    three columns that training ignores are empty. Quotes are doubled and line
    breaks written as spaces, so that each row is one line."""
    status = F.regexp_replace("status", r"[\r\n]", " ")
    unused = [F.lit("").alias(c) for c in ("date", "query", "user")]
    corpus.select("polarity", "id", *unused, status.alias("status")).write.mode("overwrite").options(
        escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Posts as JSON lines (the capture and input format)."""
    df.write.mode(mode).json(path)


# Published results: whole versions, one atomic switch.
#
#     path/versions/<name>/   a version's files
#     path/current/<n>-<name> an empty file; the greatest name is the version in force


def _current(spark: SparkSession, path: str) -> list[str]:
    """The switches under ``path``, oldest first."""
    folder = f"{path.rstrip('/')}/current"
    if not path_exists(spark, folder):
        return []
    fs, target = file_system(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(target))


def _version(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/versions/{name.split('-', 1)[1]}"


def stage(df: DataFrame, path: str, fmt: str = "parquet", **options) -> str:
    """Writes ``df`` as a version of the result at ``path`` that no reader sees
    yet; returns its name for ``switch``."""
    name = uuid.uuid4().hex
    df.write.options(**options).format(fmt).save(f"{path.rstrip('/')}/versions/{name}")
    return name


def switch(spark: SparkSession, path: str, name: str, keep: int = 2) -> None:
    """Puts the staged version in force: the creation of one empty file, which
    every file system does at once or not at all. Readers that listed an older version
    keep its files: the last ``keep`` versions in force stay, older ones are removed."""
    if not path_exists(spark, f"{path.rstrip('/')}/versions/{name}/_SUCCESS"):
        raise ValueError(f"version {name} of {path} is not written")
    before = _current(spark, path)
    n = int(before[-1].split("-")[0]) + 1 if before else 0
    fs, target = file_system(spark, f"{path.rstrip('/')}/current/{n:012d}-{name}")
    fs.create(target, False).close()
    in_force = _current(spark, path)
    for old in in_force[: max(0, len(in_force) - max(1, keep))]:
        for gone in (f"{path.rstrip('/')}/current/{old}", _version(path, old)):
            fs, target = file_system(spark, gone)
            fs.delete(target, True)


def publish(df: DataFrame, path: str, fmt: str = "parquet", keep: int = 2, **options) -> str:
    """Replaces the result at ``path``. A reader during the write gets the old
    version whole, one after it the new version; a write that fails leaves the
    old one in force."""
    name = stage(df, path, fmt, **options)
    switch(df.sparkSession, path, name, keep)
    return name


def read_published(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """The version in force now; its files stay while ``keep`` newer ones come."""
    found = _current(spark, path)
    if not found:
        raise ValueError(f"nothing is published at {path}")
    return spark.read.options(**options).format(fmt).load(_version(path, found[-1]))


# Clearing a result: by the list of files that it owns.


def owned_files(spark: SparkSession, path: str) -> list[str]:
    """The files of the result at ``path``: the data files that Spark reads there
    and the marks that its writer leaves beside them."""
    if not path_exists(spark, path):
        return []
    fs, target = file_system(spark, path)
    found, files = [], fs.listFiles(target, True)
    while files.hasNext():
        file = files.next().getPath()
        if file.getName().lstrip(".").startswith(("part-", "_SUCCESS")):
            found.append(file.toString())
    return sorted(found)


def clear_result(spark: SparkSession, files: list[str]) -> int:
    """Removes the files of a result (``owned_files`` as listed when it was
    read), and folders that this leaves empty. Files that came later, or that
    someone else put there, stay. Returns how many were removed."""
    gone, folders = 0, set()
    for file in files:
        fs, target = file_system(spark, file)
        gone += bool(fs.delete(target, False))
        folders.add(target.getParent().toString())
    for folder in sorted(folders, key=len, reverse=True):
        fs, target = file_system(spark, folder)
        if fs.exists(target) and not fs.listStatus(target):
            fs.delete(target, False)
    return gone


def chart_and_clear(spark: SparkSession, result_path: str, read, chart, chart_path: str, fmt: str = "parquet") -> DataFrame:
    """Draws the chart data of a written result, publishes it at ``chart_path``,
    and only then removes the result's files. ``read(spark, path)`` reads the
    result, ``chart`` makes the data of it. If either or the write fails, the
    result stays, and so does an older chart."""
    files = owned_files(spark, result_path)
    publish(chart(read(spark, result_path)), chart_path, fmt)
    clear_result(spark, files)
    return read_published(spark, chart_path, fmt)


def arrive_in_order(spark: SparkSession, path: str, step_ms: int = 1000) -> None:
    """Gives the files of a landing folder rising times of arrival, in the order
    of their names, as if they had been landed one after another."""
    files = owned_files(spark, path)
    now = spark._jvm.java.lang.System.currentTimeMillis()
    for i, file in enumerate(files):
        fs, target = file_system(spark, file)
        fs.setTimes(target, now - step_ms * (len(files) - i), -1)
