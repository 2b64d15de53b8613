"""Run an analysis by its name (case-insensitive).

Sentiment analyses need a trained model; posts are scored once (only those
with non-blank text) and the scored DataFrame feeds the analysis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.ml.classification import NaiveBayesModel
from pyspark.sql import DataFrame

from postlens.functions import text as X
from postlens.operators import analyses as A
from postlens.operators import charts as G
from postlens.operators import classifier as C
from postlens.sources.stopwords import STOP_WORDS

# --- fixed values: the analysis names offered to users ----------------------
ANALYSIS_NAMES = {
    "Top 5 Word Count Hashtags": "hashtag_counts",
    "Top 5 Word Count URLs": "url_counts",
    "Top Influencial Hashtags(hashtags sorted by followers of a user)": "influential_hashtags",
    "Top Influencial URLs(urls sorted by followers of a user)": "influential_urls",
    "Sentiments Piechart(English Only)": "sentiment_counts",
    "Sentiment Bubblechart(English Only)": "sentiment_bubble",
    "Language Piechart Tweet Count": "language_counts",
    "Language Piechart Influence(Followers)": "language_followers",
    "Timeline of Sentiments of Tweets": "sentiment_timeline",
    "Timeline of Languages of Tweets": "language_timeline",
}
# ---------------------------------------------------------------------------

ANALYSES: dict[str, tuple[Callable[..., DataFrame], bool]] = {
    "hashtag_counts": (A.hashtag_counts, False),
    "url_counts": (A.url_counts, False),
    "influential_hashtags": (A.influential_hashtags, False),
    "influential_urls": (A.influential_urls, False),
    "sentiment_counts": (A.sentiment_counts, True),
    "sentiment_bubble": (A.sentiment_bubble, True),
    "language_counts": (A.language_counts, False),
    "language_followers": (A.language_followers, False),
    "sentiment_timeline": (A.sentiment_timeline, True),
    "language_timeline": (A.language_timeline, False),
}

_BY_NAME = {k.lower(): v for k, v in ANALYSIS_NAMES.items()} | {k: k for k in ANALYSES}


def resolve(name: str) -> str:
    key = _BY_NAME.get(" ".join(name.split()).lower()) if name else None
    if key is None:
        raise ValueError(f"unknown analysis {name!r}; known: {sorted(ANALYSIS_NAMES)}")
    return key


def run_many(
    names: list[str],
    posts: DataFrame,
    model: NaiveBayesModel | None = None,
    scored_path: str | None = None,
    options: dict[str, dict] | None = None,
    stop_words: Iterable[str] | DataFrame = STOP_WORDS,
) -> dict[str, DataFrame]:
    """Several analyses over the same posts, keyed by analysis key.
    ``options`` has keyword arguments by analysis (``jitter``, ``draw``,
    ``seed`` and ``langs`` for the sentiment pie and timeline).

    Posts are scored at most once. When more than one sentiment analysis is
    asked for and ``scored_path`` is given (a folder in the shared scratch
    space), the scored posts are written there as a table and read back, so
    tokenising and scoring run once and later analyses do not depend on a
    long lineage (a lost executor does not send them back to the text)."""
    keys = list(dict.fromkeys(resolve(n) for n in names))
    sentiment = [k for k in keys if ANALYSES[k][1]]
    scored = None
    if sentiment:
        if model is None:
            raise ValueError(f"analyses {sentiment} need a trained sentiment model")
        scored = C.score(posts.filter(X.not_blank("text")), model, stop_words=stop_words, keep_text=False)
        if len(sentiment) > 1 and scored_path:
            scored.write.mode("overwrite").parquet(scored_path)
            scored = scored.sparkSession.read.parquet(scored_path)
    chosen = {resolve(k): v for k, v in (options or {}).items()}
    return {k: ANALYSES[k][0](scored if ANALYSES[k][1] else posts, **chosen.get(k, {})) for k in keys}


def run(
    name: str,
    posts: DataFrame,
    model: NaiveBayesModel | None = None,
    stop_words: Iterable[str] | DataFrame = STOP_WORDS,
    **opts,
) -> DataFrame:
    """The named analysis over ``posts``; ``model`` is required for the
    three sentiment analyses. ``opts`` go to the analysis."""
    key = resolve(name)
    return run_many([key], posts, model, options={key: opts}, stop_words=stop_words)[key]


# Chart follow-up of each analysis: the data each chart draws.
CHARTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "hashtag_counts": lambda df: G.top_counts(df, "tag_list"),
    "url_counts": lambda df: G.top_counts(df, "url", width=G.LABEL_WIDTH),
    "influential_hashtags": lambda df: G.top_influence(df, "tag_list", width=G.LABEL_WIDTH),
    "influential_urls": lambda df: G.top_influence(df, "urls", width=G.LONG_LABEL_WIDTH),
    "sentiment_counts": G.sentiment_share,
    "sentiment_bubble": G.bubble_points,
    "language_counts": lambda df: df,
    "language_followers": lambda df: df,
    "sentiment_timeline": lambda df: G.series_max(df, "sentiment"),
    "language_timeline": lambda df: G.series_max(df, "lang"),
}

# Analyses whose chart data has a proven bound (three classes, top-k). Language
# codes are free text of the input, so charts by language are not among them.
BOUNDED_CHARTS = {"hashtag_counts", "url_counts", "influential_hashtags", "influential_urls", "sentiment_counts"}


def chart(name: str, result: DataFrame) -> DataFrame:
    """The chart data for the result of analysis ``name``."""
    return CHARTS[resolve(name)](result)
