"""Chart follow-ups: the data behind each chart of an analysis result.

Top-k charts plan as ``TakeOrderedAndProject`` (no global sort); per-series
charts are one ``groupBy`` over all series at once instead of one scan per
series. Nothing is collected to the driver here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions import sentiment as S
from postlens.functions import text as X

# --- fixed values: chart sizes and label widths -----------------------------
TOP_K = 5
LABEL_WIDTH = 30
LONG_LABEL_WIDTH = 50
SHARE_TEXT_WIDTH = 4
BUBBLE_X_SCALE = 100000
# ---------------------------------------------------------------------------


def top_counts(counts: DataFrame, key: str, k: int = TOP_K, width: int | None = None) -> DataFrame:
    """The ``k`` largest ``(key, n)`` rows, ties by key; optional ``label``
    cut to ``width`` characters."""
    top = counts.orderBy(F.desc("n"), F.asc(key)).limit(k)
    if width is not None:
        top = top.withColumn("label", X.truncate(key, width))
    return top


def top_influence(rows: DataFrame, key: str, k: int = TOP_K, width: int = LABEL_WIDTH) -> DataFrame:
    """The ``k`` posts with most followers; label cut to ``width``."""
    return (
        rows.orderBy(F.desc_nulls_last("followers"), F.asc("id"))
        .limit(k)
        .withColumn("label", X.truncate(key, width))
    )


def sentiment_share(counts: DataFrame) -> DataFrame:
    """``(sentiment, n, share, label)``: each class's percentage of all
    classified posts; label like ``Positive(33.3%)`` (share text cut to 4
    characters). ``counts`` has one row per class (at most three), so the
    total is a window over a bounded input."""
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    share = F.col("n") * F.lit(100.0) / total
    return counts.select(
        "sentiment",
        "n",
        F.round(share, 2).alias("share"),
        _share_label("sentiment", share).alias("label"),
    )


def sentiment_summary(timeline: DataFrame) -> DataFrame:
    """``(chart, sentiment, minute, n, share, label, max_followers)``: the class
    shares (chart ``share``, no minute) and the highest follower count by class
    and minute (chart ``timeline``) of ``sentiment_timeline`` rows, in one pass.

    The two groupings are one aggregation over grouping sets: posts are read and
    scored once, and a task sends at most one row for each class and each class
    and minute. The window for the shares sees these grouped rows only."""
    sets = [["sentiment"], ["sentiment", "minute"]]
    grouped = timeline.groupingSets([[F.col(c) for c in s] for s in sets], "sentiment", "minute").agg(
        F.grouping("minute").alias("all_minutes"), F.count(F.lit(1)).alias("n"), F.max("followers").alias("max_followers")
    )
    is_share = F.col("all_minutes") == 1
    total = F.sum("n").over(Window.partitionBy("all_minutes"))
    share = F.when(is_share, F.col("n") * F.lit(100.0) / total)
    return grouped.select(
        F.when(is_share, "share").otherwise("timeline").alias("chart"), "sentiment", "minute", "n",
        F.round(share, 2).alias("share"), _share_label("sentiment", share).alias("label"), "max_followers",
    )


def _share_label(label: str, share: Column) -> Column:
    return F.concat(F.col(label), F.lit("("), F.substring(share.cast("string"), 1, SHARE_TEXT_WIDTH), F.lit("%)"))


def bubble_points(bubble: DataFrame) -> DataFrame:
    """``(id, series, x, y, size)``: x = minute × 100000, y = status count,
    size = followers integer-divided by 2; series from the sentiment sign.
    Neutral rows are real rows, not invented points. A malformed time gives
    x = NULL rather than failing the job (ANSI casts raise)."""
    s = F.col("sentiment")
    series = (
        F.when(s < 0, F.lit(S.NEGATIVE)).when(s > 0, F.lit(S.POSITIVE)).otherwise(F.lit(S.NEUTRAL))
    )
    return bubble.select(
        "id",
        series.alias("series"),
        (F.col("minute").try_cast("int") * F.lit(BUBBLE_X_SCALE)).alias("x"),
        F.col("statuses").alias("y"),
        F.expr("followers div 2").alias("size"),
    )


def series_max(rows: DataFrame, series: str) -> DataFrame:
    """``(series, minute, max_followers)`` for every series in one pass."""
    return rows.groupBy(series, "minute").agg(F.max("followers").alias("max_followers"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct()
