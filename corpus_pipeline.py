"""The corpus pipeline: each stage applies one operator to all its predecessor kept.

``run`` applies the stages to ``documents``; between two stages the documents
are written as Parquet under the cluster's shared folder and read again, which
cuts the lineage.

Nulls, empty and very long texts, ties and empty tables have the results that
the operators state; rejected documents and copies go, whatever columns are null.
Verdicts go by doc_id: rows that share a doc_id (null included) stay together if
one of them is kept, so a row repeated with its id stays as often as it came.
Columns beside those of ``documents`` pass through every stage but the last,
whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import exact_dedup, mixing, near_dedup, packing, quality
from postlens.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their host's boilerplate lines."""
    whole = docs.select("text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = quality.quality(whole, keep_columns=["row"]).where("kept")
    changed, of = F.col("n_removed") > 0, lambda c: F.col(f"row.`{c}`")
    fresh = {
        "text": F.when(changed, F.col("clean_text")).otherwise(of("text")),
        "n_chars": F.when(changed, F.length("clean_text")).otherwise(of("n_chars")).cast("long"),
    }
    return rows.select(*[fresh.get(c, of(c)).alias(c) for c in docs.columns])


def _without(docs: DataFrame, verdicts: DataFrame, name: str) -> DataFrame:
    """``docs`` without the documents of which no row is kept. Only their ids
    meet the texts: usually few enough for a broadcast, else a sort-merge join."""
    key = "gone_id"
    while key in docs.columns:
        key += "_"
    gone = verdicts.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select(F.col("doc_id").alias(key))
    return docs.join(written(gone, name), F.col("doc_id").eqNullSafe(F.col(key)), "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return _without(docs, exact_dedup.exact_dedup(docs).select("doc_id", "kept"), "exact_copies")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return _without(docs, near_dedup.near_dedup(docs).select("doc_id", "kept"), "near_copies")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks, once at least."""
    return mixing.drawn(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing sources", mix),
    ("packing", pack),
]

#: SQL cannot express near duplicates and packing; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "_"))
    return docs
