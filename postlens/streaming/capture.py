"""Capture: keep posts in given languages that mention any tracked word.

Batch form (``capture_filter``) and Structured Streaming form
(``capture_stream``) over a landing directory of JSON lines. The stream keeps
each raw line unchanged and appends it to a file sink; the sink's commit log
plus the checkpoint give exactly-once output across restarts, so a run that
loses executors or the driver resumes where it stopped. Everything that
matches is captured. Only a caller who gives N stops after N posts; that bound
is applied on read, deterministically by (time, id), not by arrival order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions import text as X
from postlens.sources.posts import parse_posts, read_posts

# --- fixed values: capture defaults -----------------------------------------
DEFAULT_LANGS = ("en", "fr", "es", "it", "pl")
DEFAULT_WORDS = (
    "I et en avoir le de que de no a la come io che lui era nie to w na co jest"
).split()
# ---------------------------------------------------------------------------
FILES_PER_TRIGGER = 1000


def parse_list_arg(arg: str) -> list[str]:
    """``"[a, b ,c]"`` → ``["a", "b", "c"]``; whitespace is stripped."""
    if arg is None:
        raise ValueError("list argument is missing")
    body = "".join(arg.split()).strip("[]")
    items = [x for x in body.split(",") if x]
    if not items:
        raise ValueError(f"empty list argument: {arg!r}")
    return items


def parse_count_arg(arg: str | int) -> int:
    n = int("".join(str(arg).split()))
    if n <= 0:
        raise ValueError(f"count must be positive, got {n}")
    return n


def matches(langs: Sequence[str], words: Sequence[str]) -> Column:
    """Language in ``langs`` and, case-insensitively, any of ``words`` as a
    whole word (a maximal run of letters, marks, digits and ``_``, in any
    script) of the text."""
    return F.col("lang").isin(list(langs)) & X.mentions_any("text", words)


def listed_matches(posts: DataFrame, langs: Sequence[str], words: DataFrame, out: str) -> DataFrame:
    """``posts`` plus ``out``: whether ``matches`` holds, with the tracked words
    in the first column of ``words``, a table of any length (case does not
    matter; nulls and words that no text can hold find nothing).

    The distinct words of a text meet the list in a join, so the driver holds no
    pattern. The outcome depends on the text alone, so its digest is the key
    that hits come back by: no text is shuffled for it, and where the list can
    be broadcast, no word either."""
    key, hit = "_pl_text", "_pl_hit"
    keyed = posts.withColumn(key, F.unhex(F.md5(F.lower("text"))))
    tracked = words.select(F.lower(F.col(words.columns[0])).alias("word"))
    asked = keyed.where(F.col("lang").isin(list(langs)))
    pairs = asked.select(F.col(key).alias("key"), F.explode(F.array_distinct(X.word_tokens("text"))).alias("token"))
    hits = X.listed_tokens(pairs, tracked).select(F.col("key").alias(key)).distinct().withColumn(hit, F.lit(True))
    found = keyed.join(hits, key, "left")
    in_langs = F.coalesce(F.col("lang").isin(list(langs)), F.lit(False))
    return found.select(*posts.columns, (F.coalesce(hit, F.lit(False)) & in_langs).alias(out))


def bounded(posts: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` posts by (post time, id); all posts when ``n`` is None.

    Each task keeps ``n`` rows and one task merges them, so ``n`` should be a
    number of posts that one task can hold."""
    if n is None:
        return posts
    return posts.orderBy(X.created_ts().asc_nulls_last(), F.col("id").asc()).limit(n)


def capture_filter(
    posts: DataFrame,
    langs: Sequence[str] = DEFAULT_LANGS,
    words: Sequence[str] | DataFrame = DEFAULT_WORDS,
    n: int | None = None,
) -> DataFrame:
    """Batch capture over posts already at rest; all of them unless ``n`` is
    given. ``words`` may be a DataFrame whose first column holds them."""
    if isinstance(words, DataFrame):
        return bounded(listed_matches(posts, langs, words, "_pl_match").filter("_pl_match").drop("_pl_match"), n)
    return bounded(posts.filter(matches(langs, words)), n)


def start_capture(
    spark: SparkSession,
    landing_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    langs: Sequence[str] = DEFAULT_LANGS,
    words: Sequence[str] = DEFAULT_WORDS,
    available_now: bool = True,
    max_files_per_trigger: int | None = FILES_PER_TRIGGER,
):
    """Starts the streaming capture and returns the ``StreamingQuery``.

    A micro-batch takes ``max_files_per_trigger`` files (None: all there are),
    so a failure restarts one batch and not the whole run; the captured posts
    do not depend on it. The raw JSON line of every matching post is appended, unchanged, to a
    text sink in ``sink_dir`` (which ``read_posts`` reads back)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(landing_dir)
    posts = parse_posts(lines, keep_raw=True)
    kept = posts.filter(matches(langs, words)).select(F.col("raw").alias("value"))
    writer = (
        kept.writeStream.format("text")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def capture_stream(
    spark: SparkSession,
    landing_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    langs: Sequence[str] = DEFAULT_LANGS,
    words: Sequence[str] = DEFAULT_WORDS,
    n: int | None = None,
) -> DataFrame:
    """Runs one ``availableNow`` capture over everything landed so far, then
    returns the captured posts (the first ``n`` of them, if given)."""
    query = start_capture(spark, landing_dir, sink_dir, checkpoint_dir, langs, words)
    query.awaitTermination()
    return read_captured(spark, sink_dir, n)


def read_captured(spark: SparkSession, sink_dir: str, n: int | None = None) -> DataFrame:
    """Captured posts from the sink (committed files only); the first ``n``, if given."""
    return bounded(read_posts(spark, sink_dir), n)
