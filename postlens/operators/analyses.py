"""The ten post analyses.

Each takes a posts DataFrame in the ``POST`` shape (or, for the sentiment
analyses, posts already scored by ``operators.classifier.score``) and returns
a lazy DataFrame.

Counting analyses aggregate with partial (map-side) plus final hash
aggregation, so a hot key costs one row per map task; row-level analyses stay
distributed and are never funnelled into one partition.

Sentiment analyses first project the flat columns they read, each once, and
only then derive labels: a label reads the predicted polarity (a model call)
several times, and a projection that does so cannot be merged downward, so a
struct passing through it whole would keep unused nested fields (and the
joins feeding them) alive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions import sentiment as S
from postlens.functions import text as X

FOLLOWERS = "user.followers_count"
STATUSES = "user.statuses_count"


def _ordered(df: DataFrame, *order: Column | str, order_output: bool) -> DataFrame:
    return df.orderBy(*order) if order_output else df


def hashtag_counts(posts: DataFrame, per_tag: bool = False, order_output: bool = True) -> DataFrame:
    """``(tag_list, n)``: how many posts carry each lower-cased tag list.

    The key is the post's whole tag list joined by spaces; a list with any
    tag outside ``[A-Za-z0-9]`` drops the post. ``per_tag=True`` counts single
    tags instead (each tag gated on its own).
    """
    if per_tag:
        tags = posts.select(F.explode(F.col("entities.hashtags.text")).alias("t"))
    else:
        tags = posts.select(X.tag_list().alias("t"))
    counted = (
        tags.filter(X.not_blank("t") & X.alnum_list("t"))
        .groupBy(F.lower("t").alias("tag_list"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _ordered(counted, F.desc("n"), F.asc("tag_list"), order_output=order_output)


def url_counts(posts: DataFrame, order_output: bool = True) -> DataFrame:
    """``(url, n)``: every link token found in the joined link list,
    lower-cased and counted."""
    counted = (
        posts.select(X.link_list().alias("l"))
        .filter(X.not_blank("l"))
        .select(F.explode(X.link_tokens("l")).alias("u"))
        .groupBy(F.lower("u").alias("url"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _ordered(counted, F.desc("n"), F.asc("url"), order_output=order_output)


def influential_hashtags(posts: DataFrame, k: int | None = None, order_output: bool = True) -> DataFrame:
    """``(id, tag_list, followers)``, one row per post with tags, most
    followed authors first (NULL followers last, ties by id)."""
    rows = posts.select(
        "id", X.tag_list().alias("tag_list"), F.col(FOLLOWERS).alias("followers")
    ).filter(X.not_blank("tag_list"))
    return _top(rows, k, order_output)


def influential_urls(posts: DataFrame, k: int | None = None, order_output: bool = True) -> DataFrame:
    """``(id, urls, followers)``: as ``influential_hashtags`` on the joined
    link list (several links of one post stay one string)."""
    rows = posts.select(
        "id", X.link_list().alias("urls"), F.col(FOLLOWERS).alias("followers")
    ).filter(X.not_blank("urls"))
    return _top(rows, k, order_output)


def _top(rows: DataFrame, k: int | None, order_output: bool) -> DataFrame:
    order = (F.desc_nulls_last("followers"), F.asc("id"))
    if k is not None:
        # orderBy + limit plans as TakeOrderedAndProject: each task keeps its
        # own k best rows; no global sort of all posts.
        return rows.orderBy(*order).limit(k)
    return _ordered(rows, *order, order_output=order_output)


def sentiment_counts(
    scored: DataFrame,
    jitter: bool = True,
    draw: Column | None = None,
    langs: list[str] | None = None,
    order_output: bool = True,
    seed: int = 0,
) -> DataFrame:
    """``(sentiment, n)`` over scored posts with non-blank text.

    The noisy label rule applies, with ``draw`` or else
    ``default_draw("id", seed)``; ``jitter=False`` gives plain labels.
    ``langs`` optionally restricts languages.
    """
    rows = _with_text(scored)
    if langs:
        rows = rows.filter(F.col("lang").isin(list(langs)))
    counted = rows.groupBy(_label(jitter, draw, seed).alias("sentiment")).agg(F.count(F.lit(1)).alias("n"))
    if not order_output:
        return counted
    # At most three rows (one per class): order them in one partition rather
    # than range-partitioning them (which costs a sampling job).
    return counted.coalesce(1).sortWithinPartitions(F.desc("sentiment"))


def _with_text(scored: DataFrame) -> DataFrame:
    """Scored posts with a text; posts scored without ``keep_text`` were
    chosen by it before."""
    return scored.filter(X.not_blank("text")) if "text" in scored.columns else scored


def _label(jitter: bool, draw: Column | None, seed: int = 0) -> Column:
    if not jitter:
        return S.polarity_label("polarity")
    return S.jittered_label("polarity", draw if draw is not None else S.default_draw("id", seed))


def sentiment_bubble(scored: DataFrame) -> DataFrame:
    """``(id, followers, statuses, sentiment, minute)`` for posts with text
    and tags; sentiment is the sign -1/0/1 of the predicted polarity."""
    flat = _with_text(scored).filter(X.not_blank(X.tag_list())).select(
        "id",
        F.col(FOLLOWERS).alias("followers"),
        F.col(STATUSES).alias("statuses"),
        "polarity",
        X.minute_of_hour().alias("minute"),
    )
    return flat.select(
        "id", "followers", "statuses", S.polarity_sign("polarity").alias("sentiment"), "minute"
    )


def language_counts(posts: DataFrame, order_output: bool = True) -> DataFrame:
    """``(lang, n)``: posts per lower-cased language code; codes with
    characters outside ``[A-Za-z0-9]`` (``zh-cn``) are dropped."""
    counted = (
        posts.select("lang")
        .filter(X.not_blank("lang") & X.alnum_list("lang"))
        .groupBy(F.lower("lang").alias("lang"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _ordered(counted, F.desc("n"), F.asc("lang"), order_output=order_output)


def language_followers(posts: DataFrame) -> DataFrame:
    """``(lang, followers)``: followers summed per raw language code; a post
    counts once, so an author counts once per post. NULLs are ignored."""
    return (
        posts.select("lang", F.col(FOLLOWERS).alias("f"))
        .filter(X.not_blank("lang"))
        .groupBy("lang")
        .agg(F.sum("f").cast("bigint").alias("followers"))
    )


def sentiment_timeline(
    scored: DataFrame,
    jitter: bool = True,
    draw: Column | None = None,
    langs: list[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """``(id, followers, sentiment, minute)`` per post with text; the label is
    jittered by default, as in the original timeline."""
    rows = _with_text(scored)
    if langs:
        rows = rows.filter(F.col("lang").isin(list(langs)))
    flat = rows.select(
        "id",
        F.col(FOLLOWERS).alias("followers"),
        "polarity",
        X.minute_of_hour().alias("minute"),
    )
    return flat.select("id", "followers", _label(jitter, draw, seed).alias("sentiment"), "minute")


def language_timeline(posts: DataFrame, bucket: str = "minute_of_hour") -> DataFrame:
    """``(id, lang, followers, minute)`` per post with a language.

    ``bucket="minute_of_hour"`` keeps the two-character minute slice (posts
    of different hours share a bucket); ``bucket="minute"`` gives the real
    minute as a timestamp instead.
    """
    minute = (
        X.minute_of_hour()
        if bucket == "minute_of_hour"
        else F.date_trunc("minute", X.created_ts())
    )
    return posts.filter(X.not_blank("lang")).select(
        "id", "lang", F.col(FOLLOWERS).alias("followers"), minute.alias("minute")
    )
