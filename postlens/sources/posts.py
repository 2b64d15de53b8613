"""Post sources: JSON lines under the explicit ``POST`` schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.schema import POST


def read_posts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON-lines posts from any Hadoop-compatible path (file, dir, glob).

    Permissive mode: a garbage line or a non-post control record becomes an
    all-NULL row, which every analysis drops through its not-blank filter.
    With a schema given the file source prunes unused fields and splits large
    files across tasks; no inference pass is made.
    """
    return spark.read.schema(POST).option("mode", "PERMISSIVE").json(path)


def parse_posts(lines: DataFrame, value: str = "value", keep_raw: bool = False) -> DataFrame:
    """Posts from a DataFrame of raw JSON strings (e.g. ``read.text`` or a
    streaming text source). ``keep_raw`` keeps the original line as ``raw``."""
    parsed = F.from_json(F.col(value), POST, {"mode": "PERMISSIVE"}).alias("p")
    cols: list[Column] = [parsed]
    if keep_raw:
        cols.append(F.col(value).alias("raw"))
    out = lines.select(*cols).select("p.*", *(["raw"] if keep_raw else []))
    return out


def posts_to_json(posts: DataFrame) -> DataFrame:
    """One JSON string per post (column ``value``), the inverse of
    ``parse_posts``; NULL fields are omitted as in the source feed."""
    fields = [F.col(f.name) for f in POST.fields]
    return posts.select(F.to_json(F.struct(*fields)).alias("value"))


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """A result written as header CSV, read back (all columns as strings, as
    any CSV without a schema). Results are normally chained as DataFrames
    instead of going through files."""
    return spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
