"""Labelled training corpus: header-less CSV, six columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlens.schema import TRAINING


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(polarity int, status string)`` from the six-column corpus; the other
    four columns are pruned at the scan."""
    return (
        spark.read.schema(TRAINING)
        .option("header", "false")
        .option("mode", "PERMISSIVE")
        .option("escape", '"')
        .csv(path)
        .select("polarity", "status")
    )
