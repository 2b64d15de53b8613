"""Exact duplicates by skew-safe combining.

Texts are equal when they are identical without white space. The rows of a
text meet in three stages, and every stage groups by the digest *and* the full
content, so a digest collision can never merge two texts:

1. locally: each scan task keeps one row for each of its contents (partial
   aggregation before the exchange);
2. by salt: what the tasks kept meets in ``salts`` groups for a digest, the
   salt being the task's number, so that the copies of one text which make up
   a third of all rows are spread over many reducers;
3. globally: the salt winners, at most ``salts`` for a text, meet.

Only groups of two or more rows are written (digest, second hash, length,
keeper, size) and joined back; the written table is a plain scan, so adaptive
execution splits the partition of a hot digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import squeezed, text_of, written

SALTS = 32


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    content = squeezed(text_of(text))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.length(text_of(text)).alias("n_chars"),
        content.alias("content"),
    ).withColumn("digest", F.sha2("content", 256))


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """(digest, content, first, group_size) for each distinct text; ``first`` is
    the keeper's (-n_chars, id is null, doc_id)."""
    rows = _marked(docs, doc_id, text).select(
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        "digest",
        "content",
        F.struct((-F.col("n_chars")).alias("shortness"), F.col("doc_id").isNull().alias("no_id"), "doc_id").alias("rank"),
    )
    by_salt = rows.groupBy("salt", "digest", "content").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    return by_salt.groupBy("digest", "content").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the most code points in its original text, then the smallest
    doc_id, stays. Null text is the empty text, and all empty or blank texts
    are one group. A null doc_id loses every tie and is kept only as the sole
    row of its text, or with the longest original. Repeated rows (same doc_id
    and text) count one by one in ``group_size`` and share one verdict, because
    doc_id is all that tells rows apart. Further columns are ignored; an empty
    table gives an empty result.
    """
    guard = [F.xxhash64("content").alias("guard"), F.length("content").alias("size")]
    repeated = written(
        duplicate_groups(docs, doc_id, text, salts)
        .where("group_size > 1")
        .select("digest", *guard, F.col("first.doc_id").alias("keeper"), "group_size"),
        "duplicate_groups",
    )
    rows = _marked(docs, doc_id, text).select("doc_id", "digest", *guard)
    keeper = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keeper"))
    return rows.join(repeated, ["digest", "guard", "size"], "left").select(
        "doc_id",
        keeper.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keeper.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
