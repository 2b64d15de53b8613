"""Published versions, and results that are cleared by the list of their files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from postlens import sinks
from postlens.sources.posts import read_result


def numbers(spark, *k):
    return spark.createDataFrame([(i,) for i in k], "k long")


def published(spark, path):
    return sorted(r.k for r in sinks.read_published(spark, path).collect())


def test_a_reader_sees_the_old_or_the_new_version(spark, tmp_dir):
    path = os.path.join(tmp_dir, "result")
    with pytest.raises(ValueError, match="nothing is published"):
        sinks.read_published(spark, path)
    sinks.publish(numbers(spark, 1, 2), path)
    before = sinks.read_published(spark, path)
    staged = sinks.stage(numbers(spark, 3), path)
    assert published(spark, path) == [1, 2]  # the new files are there, but not in force
    sinks.switch(spark, path, staged)
    assert published(spark, path) == [3]
    assert sorted(r.k for r in before.collect()) == [1, 2]  # a reader that began before keeps its files


def test_a_reader_during_the_write(spark, tmp_dir):
    """Every read that a task of the write makes finds the old version whole."""
    path = os.path.join(tmp_dir, "result")
    sinks.publish(numbers(spark, 1, 2), path)
    versions, current = os.path.join(path, "versions"), os.path.join(path, "current")

    def look(batches):
        for b in batches:
            b["seen"] = [sorted(os.listdir(current))[-1] for _ in range(len(b))]
            yield b

    sinks.publish(numbers(spark, 3, 4).mapInPandas(look, "k long, seen string"), path)
    assert {r.seen[:12] for r in sinks.read_published(spark, path).collect()} == {"0" * 12}
    assert len(os.listdir(versions)) == 2


def test_a_failed_write_leaves_the_old_version(spark, tmp_dir):
    path = os.path.join(tmp_dir, "result")
    sinks.publish(numbers(spark, 1), path)
    with pytest.raises(Exception, match="no good"):
        sinks.publish(numbers(spark, 2).select(F.raise_error(F.lit("no good")).cast("long").alias("k")), path)
    assert published(spark, path) == [1]
    with pytest.raises(ValueError, match="is not written"):
        sinks.switch(spark, path, "missing")
    assert published(spark, path) == [1]


def test_old_versions_go(spark, tmp_dir):
    path = os.path.join(tmp_dir, "result")
    for k in range(12):
        sinks.publish(numbers(spark, k), path, keep=3)
        assert published(spark, path) == [k]
    assert len(os.listdir(os.path.join(path, "versions"))) == 3
    assert sorted(int(x.split("-")[0]) for x in os.listdir(os.path.join(path, "current")) if x[0] != ".") == [9, 10, 11]


def test_publish_csv_and_empty(spark, tmp_dir):
    path = os.path.join(tmp_dir, "result")
    sinks.publish(numbers(spark, 7), path, "csv", header=True)
    assert [r.k for r in sinks.read_published(spark, path, "csv", header=True).collect()] == ["7"]
    sinks.publish(numbers(spark), path + "2")
    assert published(spark, path + "2") == []


def written(spark, tmp_dir):
    path = os.path.join(tmp_dir, "counts")
    sinks.write_result(numbers(spark, 1, 2, 3).repartition(3), path)
    return path, os.path.join(tmp_dir, "chart")


def test_chart_then_clear(spark, tmp_dir):
    path, chart = written(spark, tmp_dir)
    with open(os.path.join(path, "_notes.txt"), "w") as f:
        f.write("not of the result")
    rows = sinks.chart_and_clear(spark, path, read_result, lambda df: df.where("k > 1"), chart)
    assert sorted(r.k for r in rows.collect()) == ["2", "3"]
    assert os.listdir(path) == ["_notes.txt"] and sinks.owned_files(spark, path) == []
    path, _ = written(spark, os.path.join(tmp_dir, "two"))
    sinks.chart_and_clear(spark, path, read_result, lambda df: df, chart)
    assert not os.path.exists(path)  # nothing else was in it


def test_a_failed_chart_leaves_the_result(spark, tmp_dir):
    path, chart = written(spark, tmp_dir)
    broken = lambda df: df.select(F.raise_error(F.lit("no chart")).cast("string").alias("k"))
    with pytest.raises(Exception, match="no chart"):
        sinks.chart_and_clear(spark, path, read_result, broken, chart)
    assert read_result(spark, path).count() == 3
    with pytest.raises(ValueError):
        sinks.read_published(spark, chart)


def test_files_that_come_later_stay(spark, tmp_dir):
    path, chart = written(spark, tmp_dir)

    def late(df):
        numbers(spark, 9).write.mode("append").option("header", True).csv(path)
        return df.where("k < 3")

    sinks.chart_and_clear(spark, path, read_result, late, chart)
    assert [r.k for r in read_result(spark, path).collect()] == ["9"]
    assert sinks.clear_result(spark, ["/no/such/file"]) == 0
