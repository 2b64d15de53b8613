"""Binding of the supplied test tables to the post and training shapes.

The supplied tables hold no posts, so posts are derived from them with a fixed
rule (one post per document): text and language from ``documents``, time and
author from the event with the same id, the author's status count from all of
their events, one page URL as the link. Tags are empty for ids ending in 0 and
fail the alphanumeric gate for ids ending in 1.

Plan notes for large inputs: what needs the text (tokens, scores, hashed
counts) is computed where documents are scanned, and only its narrow result
meets the other tables. The per-author status counts are pre-aggregated before
they are joined, and the events of hot authors (more than 1/1000 of all events
each) are salted over 32 join keys, so an author holding a third of all events
is spread over 32 join tasks instead of one; salting never changes a result.
Documents ⋈ events is an equi-join on unique ids (sort-merge, or broadcast when
the planner knows a small side); the page key is reduced modulo the page count
before squaring, so it cannot overflow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions import text as X
from postlens.operators import classifier
from postlens.session import file_system

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# What the queries read, so that no job is run to infer it.
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
}
# Up to so many bytes of documents are dealt out (what a scan task reads by default).
SPREAD_BYTES = 128 << 20
# So many labelled ids (8 bytes and a class each) may be broadcast.
FEW_LABELS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, as its files are now."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt_out(docs: DataFrame, sf_dir: str, spread: bool | None = None) -> DataFrame:
    """Documents dealt out by ``doc_id`` if their table is at most
    ``SPREAD_BYTES``: Spark reads so little in one task, which would do all the
    text work alone. Nothing larger is moved. ``spread`` decides instead of the size."""
    if spread is None:
        fs, path = file_system(docs.sparkSession, f"{sf_dir.rstrip('/')}/documents.parquet")
        spread = fs.getContentSummary(path).getLength() <= SPREAD_BYTES
    return docs.repartition("doc_id") if spread else docs


def documents(spark: SparkSession, sf_dir: str, *cols: str, spread: bool | None = None) -> DataFrame:
    """Documents as they are scanned; small tables are ``dealt_out`` for text work."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *cols)
    return dealt_out(docs, sf_dir, spread) if "text" in cols else docs


# --- fixed values: English day and month abbreviations of the post time ------
DAYS = "Sun Mon Tue Wed Thu Fri Sat".split()
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
# ---------------------------------------------------------------------------


def _names(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _two(field: str) -> str:
    return f"lpad(cast({field} AS string), 2, '0')"


def post_time_sql(ts: str = "ts") -> str:
    """``'Wed Oct 10 20:19:24 +0000 2018'`` from the ``timestamp_ntz`` column
    named ``ts``, as a SQL expression.

    Built from the timestamp's own fields, so the result does not depend on
    the session time zone (``date_format`` would go through it)."""
    return (
        f"concat(element_at({_names(DAYS)}, dayofweek({ts})), ' ', "
        f"element_at({_names(MONTHS)}, month({ts})), ' ', {_two(f'day({ts})')}, ' ', "
        f"{_two(f'hour({ts})')}, ':', {_two(f'minute({ts})')}, ':', {_two(f'second({ts})')}, "
        f"' +0000 ', cast(year({ts}) AS string))"
    )


EMPTY = "cast(array() AS array<string>)"
# The row shaping of a post, as SQL evaluated in one projection (one call
# to the JVM instead of one per expression node).
POST_COLUMNS = [
    "doc_id AS id",
    "lang",
    f"{post_time_sql('ts')} AS created_at",
    "cast(NULL AS bigint) AS favorite_count",
    f"""named_struct(
          'hashtags', transform(
             CASE doc_id % 10 WHEN 0 THEN {EMPTY}
                              WHEN 1 THEN array(event_type, concat('src_', source))
                              ELSE array(event_type, upper(lang)) END,
             t -> named_struct('text', t)),
          'urls', transform(
             CASE WHEN url IS NULL THEN {EMPTY} ELSE array(url) END,
             u -> named_struct('expanded_url', u))) AS entities""",
    "named_struct('followers_count', n_chars, 'statuses_count', statuses) AS user",
]


# A key holding more than 1/HOT_SHARE of all events is hot: there can be at
# most HOT_SHARE such authors, whatever the data size, so their list is
# broadcast with a proven bound. Their events are spread over SALTS salts.
HOT_SHARE = 1000
SALTS = 32


class AuthorCounts:
    """Per-author event counts as a join lookup keyed by (user_id, salt)."""

    def __init__(self, hot: DataFrame, lookup: DataFrame):
        self.hot, self.lookup = hot, lookup


def author_counts(events: DataFrame) -> AuthorCounts:
    """``statuses`` per author, pre-aggregated, with one lookup row per
    (author, salt): SALTS rows for hot authors, one (salt 0) for the rest.
    The final aggregate on (user_id, salt) makes the key provably unique."""
    per_user = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("statuses"))
    total = events.agg(F.count(F.lit(1))).scalar()
    hot = per_user.filter(F.col("statuses") * HOT_SHARE > total).select(
        "user_id", F.lit(True).alias("hot")
    )
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    lookup = (
        per_user.join(F.broadcast(hot), "user_id", "left")
        .select("user_id", F.explode(salts).alias("salt"), "statuses")
        .groupBy("user_id", "salt")
        .agg(F.max("statuses").alias("statuses"))
    )
    return AuthorCounts(hot, lookup)


def salted(events: DataFrame, counts: AuthorCounts) -> DataFrame:
    """Events with the salt their author's lookup rows use: a hash of the
    event id for hot authors, 0 otherwise."""
    flagged = events.join(F.broadcast(counts.hot), "user_id", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("event_id"), F.lit(SALTS))).otherwise(F.lit(0))
    return flagged.withColumn("salt", salt.cast("int")).drop("hot")


def post_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, ts, event_type, statuses, url)``: what a post has besides
    its document, the narrow side of every join with documents."""
    events = table(spark, sf_dir, "events").filter(F.col("user_id").isNotNull())
    counts = author_counts(events)
    pages = table(spark, sf_dir, "pages")
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    # One link per page id. Declared as an aggregate on the key, the lookup
    # is known to be unique, so Catalyst drops the whole outer join from
    # queries that never read the link.
    links = pages.groupBy("page_id").agg(F.max("url").alias("url"))

    # event_id = doc_id on joined rows; no pages → NULL key, no link
    e_mod = F.try_mod(F.col("event_id"), n_pages)
    return (
        salted(events.select("event_id", "ts", "user_id", "event_type"), counts)
        # Every author with a non-NULL id has a count row, so this left join
        # equals the inner join; keyed by an aggregate, it is dropped from
        # queries that never read the status count.
        .join(counts.lookup, ["user_id", "salt"], "left")
        .withColumn("page_key", F.try_mod(e_mod * e_mod, n_pages))
        .join(links, F.col("page_key") == links.page_id, "left")
        .select("event_id", "ts", "event_type", "statuses", "url")
    )


def as_posts(docs: DataFrame, events: DataFrame, *extra: str) -> DataFrame:
    """Posts in the nested ``POST`` shape from documents and ``post_events``,
    with the columns ``extra`` of the documents beside them."""
    return docs.join(events, docs.doc_id == events.event_id).selectExpr(*POST_COLUMNS, *extra)


def posts_from_testdata(spark: SparkSession, sf_dir: str, spread: bool | None = None) -> DataFrame:
    """Posts in the nested ``POST`` shape, derived from the test tables."""
    docs = documents(spark, sf_dir, "text", "lang", "source", "n_chars", spread=spread)
    return as_posts(docs, post_events(spark, sf_dir), "text")


def tokens_from_testdata(spark: SparkSession, sf_dir: str, tokens: Column) -> DataFrame:
    """``(id, tokens)`` of the posts: ``tokens`` of a document's text, made where
    documents are scanned, so no text meets the join."""
    docs = documents(spark, sf_dir, "text", "lang", "source", "n_chars").withColumn("tokens", tokens).drop("text")
    return as_posts(docs, post_events(spark, sf_dir), "tokens").select("id", "tokens")


def narrow_posts_from_testdata(spark: SparkSession, sf_dir: str, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The posts, without their texts, whose documents ``choose`` keeps by text
    and language. It sees documents as they are scanned, so no text meets the join."""
    docs = documents(spark, sf_dir, "text", "lang", "source", "n_chars")
    return as_posts(choose(docs).drop("text"), post_events(spark, sf_dir))


def scored_posts_from_testdata(spark: SparkSession, sf_dir: str, model, spread: bool | None = None) -> DataFrame:
    """The posts with text, scored: ``polarity`` instead of ``text``. Documents
    are scored where they are scanned, so no text meets the join."""
    docs = documents(spark, sf_dir, "text", "lang", "source", "n_chars", spread=spread)
    scored = classifier.score(docs.filter(F.col("text") != ""), model, keep_text=False)
    return as_posts(scored, post_events(spark, sf_dir), "polarity")


def labelled_from_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, polarity)`` of the documents with a quality label: quality 0
    is polarity 0 (negative), quality 1 is polarity 4 (positive)."""
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", (F.col("quality") * 4).cast("int").alias("polarity"))


def training_from_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled corpus ``(id, polarity, status)`` with the texts."""
    labels = labelled_from_testdata(spark, sf_dir)
    docs = documents(spark, sf_dir, "text")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), "polarity", F.col("text").alias("status"))


def labelled_at_scan(spark: SparkSession, sf_dir: str, labels: DataFrame, narrow: Callable[[DataFrame], DataFrame], few: int = FEW_LABELS) -> DataFrame:
    """``labels`` (keyed by doc_id) joined with ``narrow`` of the documents,
    which reads the text and drops it.

    Up to ``few`` labels are broadcast, so that only labelled documents are
    worked on, where they are scanned. More are not: then the narrow result of
    all documents meets them in a shuffled join. No text is shuffled either way."""
    docs = documents(spark, sf_dir, "text", spread=False)
    if labels.limit(few + 1).count() <= few:
        docs = docs.join(F.broadcast(labels.select("doc_id").distinct()), "doc_id", "left_semi")
        return narrow(dealt_out(docs, sf_dir)).join(F.broadcast(labels), "doc_id")
    return narrow(dealt_out(docs, sf_dir)).join(labels, "doc_id")


def training_words(spark: SparkSession, sf_dir: str, few: int = FEW_LABELS) -> DataFrame:
    """``(label, words)`` of the labelled documents."""
    labels = labelled_from_testdata(spark, sf_dir).select("doc_id", classifier.polarity_to_class("polarity").alias("label"))
    words = lambda docs: docs.select("doc_id", X.tokens("text").alias("words"))
    return labelled_at_scan(spark, sf_dir, labels.filter(F.col("label").isNotNull()), words, few).select("label", "words")


def validation_from_testdata(spark: SparkSession, sf_dir: str, model, few: int = FEW_LABELS) -> DataFrame:
    """``(Actual, Predicted)`` of the labelled documents, scored at the scan."""
    labels = labelled_from_testdata(spark, sf_dir).withColumnRenamed("polarity", "actual")
    rows = labelled_at_scan(spark, sf_dir, labels, lambda docs: classifier.score(docs, model, keep_text=False), few)
    return rows.select(F.col("actual").cast("double").alias("Actual"), F.col("polarity").cast("double").alias("Predicted"))
