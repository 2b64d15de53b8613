"""Named queries over the supplied test tables.

Every query reads the whole tables through ``posts_from_testdata`` (or the
labelled corpus derived from them) and returns a lazy DataFrame. The
classifier is trained once per folder for the queries of one ``queries()``
call; nothing else is kept between queries. Queries that show a write and read
(capture_stream, json_roundtrip, and those named after files) write when they
are described.
"""

from __future__ import annotations

import contextlib
import io
import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.ml.classification import NaiveBayesModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions import sentiment as S
from postlens.functions import text as X
from postlens.operators import analyses as A
from postlens.operators import charts as G
from postlens.operators import classifier as C
from postlens.session import scratch_path
from postlens.plans import dispatch
from postlens.schema import POST
from postlens.sinks import (
    arrive_in_order,
    chart_and_clear,
    owned_files,
    publish,
    read_published,
    stage,
    switch,
    write_accuracy,
    write_result,
    write_training_csv,
)
from postlens.sources.posts import posts_to_json, read_posts, read_result
from postlens.sources.testdata import (
    narrow_posts_from_testdata,
    posts_from_testdata,
    scored_posts_from_testdata,
    table,
    tokens_from_testdata,
    training_from_testdata,
    training_words,
    validation_from_testdata,
)
from postlens.sources.training import read_training_csv
from postlens.streaming import batches as B
from postlens.streaming import capture as K

Query = Callable[[SparkSession, str], DataFrame]

#: What the checked captures look for: letters outside ASCII, and a bound that bites.
UNICODE_LANGS, UNICODE_WORDS = ("fr", "es"), ("é", "ó", "ñ", "où", "él")
FIRST_N = 100
#: Tracked words of the word table have so many characters at least.
LONG_WORD = 9


class Models:
    """Classifiers trained on the labelled documents of folders. Whoever makes
    the queries holds it: its queries share what was trained once, and a new
    one trains anew."""

    def __init__(self) -> None:
        self._found: dict[tuple, NaiveBayesModel] = {}
        self._lock = threading.RLock()

    def get(self, spark: SparkSession, sf_dir: str) -> NaiveBayesModel:
        key = (spark.sparkContext.applicationId, sf_dir)
        with self._lock:
            if key not in self._found:
                self._found[key] = C.train_words(training_words(spark, sf_dir))
            return self._found[key]


def test_draw(key: str = "id") -> Column:
    """Jitter draw used by the checked queries: ``(id*31 + 7) % 97 % 10``,
    expressible in any SQL engine (``default_draw`` uses xxhash64)."""
    return ((F.col(key) * 31 + 7) % 97) % 10


def _posts(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(posts_from_testdata(spark, sf_dir))


def token_rows(tokens: DataFrame) -> DataFrame:
    return tokens.select("id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every post, made where documents are scanned."""
    return token_rows(tokens_from_testdata(spark, sf_dir, X.tokens("text")))


def nb_predictions(scored: DataFrame) -> DataFrame:
    return scored.select("id", "polarity", S.polarity_label("polarity").alias("sentiment"))


def text_tokens_custom_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without the words of a table: those of the benchmark's texts."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(X.tokens("text", ())).alias("word"))
    tokens = tokens_from_testdata(spark, sf_dir, F.coalesce(X.tokens("text", ()), F.array().cast("array<string>")))
    return token_rows(X.without_words(tokens, "tokens", words))


def capture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lands the posts as JSON lines, captures them with one ``availableNow``
    streaming run, and reads the capture back."""
    landing = scratch_path(spark, "landing")
    posts_to_json(posts_from_testdata(spark, sf_dir)).write.mode("overwrite").text(landing)
    captured = K.capture_stream(
        spark, landing, scratch_path(spark, "sink"), scratch_path(spark, "checkpoint")
    )
    return captured.select("id", "lang", "created_at")


def landed(spark: SparkSession, sf_dir: str, files: int = 12, posts_a_file: int = 100_000) -> str:
    """A landing folder with the posts as JSON lines, in files that follow each
    other in time, by the time of their posts and by that of their arrival."""
    path = scratch_path(spark, "landing")
    posts = posts_from_testdata(spark, sf_dir)
    lines = posts.select(F.to_json(F.struct(*POST.names)).alias("value"), X.created_ts().alias("at"), "id")
    number = max(files, table(spark, sf_dir, "documents").count() // posts_a_file)
    lines.repartitionByRange(number, "at", "id").sortWithinPartitions("at", "id").select("value").write.text(path)
    arrive_in_order(spark, path)
    return path


def _batch_run(spark: SparkSession) -> tuple[str, str]:
    return scratch_path(spark, "batches"), scratch_path(spark, "checkpoint")


def capture_stop_at_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture that ends itself at N posts with files left over, started
    again with the same checkpoint, which adds nothing."""
    landing, (sink, checkpoint) = landed(spark, sf_dir), _batch_run(spark)
    for _ in range(2):
        captured = B.capture_batches(spark, landing, sink, checkpoint, n=FIRST_N, max_files_per_trigger=2)
    return captured.select("id", "lang", "created_at")


class _Broken(RuntimeError):
    pass


def capture_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture that breaks in its second batch, after the batch's lines are
    written, and is started again."""
    landing, (sink, checkpoint) = landed(spark, sf_dir), _batch_run(spark)

    def fail(batch: int) -> None:
        if batch == 1:
            raise _Broken("the run was broken on purpose")

    try:
        B.capture_batches(spark, landing, sink, checkpoint, max_files_per_trigger=4, on_written=fail)
    except StreamingQueryException as e:
        if "broken on purpose" not in str(e):
            raise
    return B.capture_batches(spark, landing, sink, checkpoint, max_files_per_trigger=4).select("id", "lang", "created_at")


def capture_by_language_and_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts captured in two languages by day, read from their folders alone."""
    sink, checkpoint = _batch_run(spark)
    B.capture_batches(spark, landed(spark, sf_dir), sink, checkpoint)
    lines = B.read_lines(spark, sink, where=F.col("lang").isin("en", "fr"))
    return lines.groupBy("lang", "day").agg(F.count(F.lit(1)).alias("n"))


def capture_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured posts, other posts, control records and broken lines, as counted
    while they were written, and as read back from the sink. One page gives one
    control record, one German post a line that breaks off."""
    landing, (sink, checkpoint) = scratch_path(spark, "landing"), _batch_run(spark)
    posts = posts_from_testdata(spark, sf_dir)
    whole = posts_to_json(posts)
    broken = posts_to_json(posts.where("lang = 'de'")).selectExpr("substring(value, 1, length(value) div 2) AS value")
    control = table(spark, sf_dir, "pages").select(F.to_json(F.struct(F.struct(F.col("page_id").alias("track")).alias("limit"))).alias("value"))
    whole.unionByName(broken).unionByName(control).write.text(landing)
    B.capture_batches(spark, landing, sink, checkpoint)
    ledger = B.read_ledger(spark, sink).agg(*[F.sum(k).alias(k) for k in B.KINDS])
    counted = ledger.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n_counted")) for k in B.KINDS])).alias("k")).select("k.*")
    kept = spark.read.schema(B.LINES).text(sink).groupBy("kind").agg(F.count(F.lit(1)).alias("n_kept"))
    return counted.join(kept, "kind", "left").select("kind", "n_counted", F.coalesce("n_kept", F.lit(0).cast("long")).alias("n_kept"))


def capture_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that mention a word of a table: the long words of the conversations."""
    words = table(spark, sf_dir, "conversations").select(F.explode(X.word_tokens("text")).alias("word")).where(F.length("word") >= LONG_WORD)
    captured = narrow_posts_from_testdata(spark, sf_dir, lambda docs: K.capture_filter(docs, words=words))
    return captured.select("id", "lang", "created_at")


def published_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader gets while a second version of a result is written, and
    after the switch: languages of all posts, then of the captured ones."""
    path, posts = scratch_path(spark, "published"), posts_from_testdata(spark, sf_dir)
    publish(A.language_counts(posts, order_output=False), path)
    staged = stage(A.language_counts(K.capture_filter(posts), order_output=False), path)
    during = read_published(spark, path).select(F.lit("during the write").alias("seen"), "lang", "n")
    switch(spark, path, staged)
    return during.unionByName(read_published(spark, path).select(F.lit("after the switch").alias("seen"), "lang", "n"))


def chart_then_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top tag lists of a written result, whose files are removed after."""
    result = scratch_path(spark, "result")
    write_result(A.hashtag_counts(posts_from_testdata(spark, sf_dir), order_output=False), result)
    read = lambda spark, path: read_result(spark, path).withColumn("n", F.col("n").cast("long"))
    chart = chart_and_clear(spark, result, read, lambda df: G.top_counts(df, "tag_list"), scratch_path(spark, "chart"))
    return chart.withColumn("files_left", F.lit(len(owned_files(spark, result))))


def _job(*argv: str) -> None:
    from postlens import jobs

    with contextlib.redirect_stdout(io.StringIO()):  # jobs print their figures
        jobs.main(list(argv))


def job_train_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training and validation jobs over the labelled corpus as CSV."""
    corpus, model, out = (scratch_path(spark, x) for x in ("corpus", "model", "accuracy"))
    write_training_csv(training_from_testdata(spark, sf_dir), corpus)
    _job("train", "--corpus", corpus, "--model", model)
    _job("validate", "--corpus", corpus, "--model", model, "--out", out)
    rows = spark.read.option("header", True).option("sep", "\t").csv(out)
    return rows.groupBy("Actual", "Predicted").agg(F.count(F.lit(1)).alias("n"))


def job_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture job, with white space in its list arguments."""
    landing, (sink, checkpoint) = landed(spark, sf_dir), _batch_run(spark)
    langs, words = (" [ " + " , ".join(x) + " ] " for x in (UNICODE_LANGS, UNICODE_WORDS))
    _job("capture", "--landing", landing, "--sink", sink, "--checkpoint", checkpoint, "--langs", langs, "--words", words)
    return K.read_captured(spark, sink).select("id", "lang", "created_at")


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts written as JSON lines and read back under the explicit schema."""
    path = scratch_path(spark, "posts-json")
    posts_to_json(posts_from_testdata(spark, sf_dir)).write.mode("overwrite").text(path)
    return read_posts(spark, path).select(
        "id",
        "lang",
        F.col(A.FOLLOWERS).alias("followers"),
        F.col(A.STATUSES).alias("statuses"),
        X.tag_list().alias("tag_list"),
        X.link_list().alias("urls"),
        X.minute_of_hour().alias("minute"),
    )


def training_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled corpus written as six-column CSV and read back: documents
    and characters by polarity."""
    path = scratch_path(spark, "corpus")
    write_training_csv(training_from_testdata(spark, sf_dir), path)
    return read_training_csv(spark, path).groupBy("polarity").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("status")).alias("n_chars")
    )


def result_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language counts written as a header CSV and read back, as text."""
    path = scratch_path(spark, "result")
    write_result(A.language_counts(posts_from_testdata(spark, sf_dir), order_output=False), path)
    return read_result(spark, path)


def queries(models: Models | None = None) -> dict[str, Query]:
    models = models or Models()
    draw = test_draw  # built lazily: no Column may exist before a session does

    def _scored(fn: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: fn(scored_posts_from_testdata(spark, sf_dir, models.get(spark, sf_dir)))

    def nb_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.accuracy(validation_from_testdata(spark, sf_dir, models.get(spark, sf_dir)))

    def validation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Validation rows appended as compressed text, and read back."""
        path = scratch_path(spark, "accuracy")
        corpus = training_from_testdata(spark, sf_dir)
        write_accuracy(C.predictions(corpus, models.get(spark, sf_dir)), path)
        rows = spark.read.option("header", True).option("sep", "\t").csv(path)
        return rows.groupBy("Actual", "Predicted").agg(F.count(F.lit(1)).alias("n"))

    def saved_model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Predictions of the model after it was saved and loaded."""
        path = scratch_path(spark, "model")
        C.save(models.get(spark, sf_dir), path)
        return nb_predictions(scored_posts_from_testdata(spark, sf_dir, C.load(path)))

    def dispatch_sentiment_share(spark: SparkSession, sf_dir: str) -> DataFrame:
        name = "Sentiments Piechart(English Only)"
        posts = posts_from_testdata(spark, sf_dir)
        counts = dispatch.run(name, posts, models.get(spark, sf_dir), draw=draw(), order_output=False)
        return dispatch.chart(name, counts)

    return {
        # Q1, G1
        "hashtag_counts": _posts(A.hashtag_counts),
        "hashtag_counts_top5": _posts(
            lambda p: G.top_counts(A.hashtag_counts(p, order_output=False), "tag_list")
        ),
        "hashtag_counts_per_tag": _posts(lambda p: A.hashtag_counts(p, per_tag=True)),
        # Q2, G2
        "url_counts": _posts(A.url_counts),
        "url_counts_top5": _posts(
            lambda p: G.top_counts(A.url_counts(p, order_output=False), "url", width=G.LABEL_WIDTH)
        ),
        # Q3, G3
        "influential_hashtags": _posts(A.influential_hashtags),
        "influential_hashtags_top5": _posts(
            lambda p: G.top_influence(
                A.influential_hashtags(p, order_output=False), "tag_list", width=G.LABEL_WIDTH
            )
        ),
        # Q4, G4
        "influential_urls": _posts(A.influential_urls),
        "influential_urls_top5": _posts(
            lambda p: G.top_influence(
                A.influential_urls(p, order_output=False), "urls", width=G.LONG_LABEL_WIDTH
            )
        ),
        # M1-M5
        "text_tokens": text_tokens,
        "nb_predictions": _scored(nb_predictions),
        "text_tokens_custom_stopwords": text_tokens_custom_stopwords,
        "nb_accuracy": nb_accuracy,
        "training_csv_roundtrip": training_csv_roundtrip,
        "validation_rows": validation_rows,
        "saved_model_predictions": saved_model_predictions,
        # Q5, G5
        "sentiment_counts": _scored(lambda s: A.sentiment_counts(s, jitter=False)),
        "sentiment_counts_jittered": _scored(
            lambda s: A.sentiment_counts(s, jitter=True, draw=draw())
        ),
        "sentiment_share": _scored(
            lambda s: G.sentiment_share(
                A.sentiment_counts(s, jitter=True, draw=draw(), order_output=False)
            )
        ),
        "dispatch_sentiment_share": dispatch_sentiment_share,
        # Q6, G6
        "sentiment_bubble": _scored(A.sentiment_bubble),
        "sentiment_bubble_points": _scored(lambda s: G.bubble_points(A.sentiment_bubble(s))),
        # Q7, Q8, G7, G8
        "language_counts": _posts(A.language_counts),
        "language_followers": _posts(A.language_followers),
        "languages_distinct": _posts(
            lambda p: G.distinct_values(A.language_timeline(p), "lang")
        ),
        # Q9, G9
        "sentiment_timeline": _scored(lambda s: A.sentiment_timeline(s, jitter=True, draw=draw())),
        "sentiment_timeline_max": _scored(
            lambda s: G.series_max(A.sentiment_timeline(s, jitter=True, draw=draw()), "sentiment")
        ),
        # Q5, Q9, G5, G9 in one pass
        "sentiment_summary": _scored(
            lambda s: G.sentiment_summary(A.sentiment_timeline(s, jitter=True, draw=draw()))
        ),
        # Q10, G10
        "language_timeline": _posts(A.language_timeline),
        "language_timeline_max": _posts(lambda p: G.series_max(A.language_timeline(p), "lang")),
        # S8, S2
        "capture_filter": _posts(
            lambda p: K.capture_filter(p).select("id", "lang", "created_at")
        ),
        "capture_filter_unicode": _posts(
            lambda p: K.capture_filter(p, UNICODE_LANGS, UNICODE_WORDS).select("id", "lang", "created_at")
        ),
        "capture_first_n": _posts(
            lambda p: K.capture_filter(p, n=FIRST_N).select("id", "lang", "created_at")
        ),
        "capture_stream": capture_stream,
        "capture_stop_at_n": capture_stop_at_n,
        "capture_resumed": capture_resumed,
        "capture_by_language_and_day": capture_by_language_and_day,
        "capture_line_kinds": capture_line_kinds,
        "capture_word_table": capture_word_table,
        "published_result": published_result,
        "chart_then_clear": chart_then_clear,
        "job_train_validate": job_train_validate,
        "job_capture": job_capture,
        "result_reread": result_reread,
        "json_roundtrip": json_roundtrip,
    }
