"""Multinomial Naive Bayes sentiment classifier on hashed term counts.

Text is normalised with native expressions (``functions.text.tokens``),
hashed into 2^20 features with ``pyspark.ml.feature.HashingTF`` (MurmurHash3,
term counts, duplicates counted) and classified with
``pyspark.ml.classification.NaiveBayes`` (smoothing 1.0).

Scale: scoring is a narrow map (no shuffle); the model is a fixed
2 × 2^20-double matrix regardless of data size and ships with the task
binary. Training sums sparse counts, see ``feature_sums``.

Polarity (0 negative, 2 neutral, 4 positive) is mapped to class indices
0, 2, 1 before training and back after prediction, so that a corpus holding
only 0 and 4 trains exactly two classes.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.ml.classification import NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from postlens.functions import text as X
from postlens.sources.stopwords import STOP_WORDS

# --- fixed values -----------------------------------------------------------
NUM_FEATURES = 1 << 20
SMOOTHING = 1.0
# ---------------------------------------------------------------------------

_TOKENS, _FEATURES, _CLASS = "_pl_tokens", "_pl_features", "_pl_class"


def polarity_to_class(polarity: str | Column) -> Column:
    p = F.col(polarity) if isinstance(polarity, str) else polarity
    return F.when(p == 0, 0.0).when(p == 4, 1.0).when(p == 2, 2.0)


def class_to_polarity(cls: str | Column) -> Column:
    """Class index 0, 1, 2 → polarity 0, 4, 2 (anything else NULL).

    A lookup that reads the class once: the class is a model call, and an
    expression reading it several times would keep Catalyst from merging
    the projection into its neighbours (and from pruning what they carry)."""
    c = F.col(cls) if isinstance(cls, str) else cls
    return F.try_element_at(F.array(F.lit(0), F.lit(4), F.lit(2)), c.cast("int") + 1)


def featurize(
    df: DataFrame, text_col: str, out: str = _FEATURES, stop_words: Iterable[str] | DataFrame = STOP_WORDS
) -> DataFrame:
    """Adds hashed term counts of the normalised text as vector ``out``
    (NULL text counts as no words). ``stop_words`` are words, or a DataFrame
    whose first column holds them, for lists of any length."""
    hashing = HashingTF(inputCol=_TOKENS, outputCol=out, numFeatures=NUM_FEATURES)
    as_table = isinstance(stop_words, DataFrame)
    words = F.coalesce(X.tokens(text_col, () if as_table else stop_words), F.array().cast("array<string>"))
    tokenised = df.withColumn(_TOKENS, words)
    if as_table:
        tokenised = X.without_words(tokenised, _TOKENS, stop_words)
    return hashing.transform(tokenised).drop(_TOKENS)


def train(
    corpus: DataFrame,
    text_col: str = "status",
    polarity_col: str = "polarity",
    smoothing: float = SMOOTHING,
    stop_words: Iterable[str] | DataFrame = STOP_WORDS,
) -> NaiveBayesModel:
    """Fits the classifier on ``(polarity, text)`` rows. Rows whose polarity
    is not 0, 2 or 4 are ignored."""
    as_table = isinstance(stop_words, DataFrame)
    words = X.tokens(text_col, () if as_table else stop_words)
    labelled = corpus.select(polarity_to_class(polarity_col).alias("label"), words.alias("words"))
    return train_words(labelled, smoothing, stop_words if as_table else None)


def feature_sums(labelled: DataFrame, stop_words: DataFrame | None = None) -> DataFrame:
    """``(label, feature, total)`` from ``(label, words)`` rows: how often the
    documents of a class have words of a hashed feature, and, with a null
    feature, how many documents the class has. One pass over the documents.

    Only (class, word) counts are shuffled, summed up in the task first, and
    each distinct word is hashed once per class instead of once per occurrence.
    Words of ``stop_words`` (its first column) are left out by an anti join of
    these counts, not of the occurrences."""
    # a null word stands for the document itself
    each = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("words", F.array().cast("array<string>")))
    rows = labelled.where(F.col("label").isNotNull()).select("label", F.explode(each).alias("word"))
    counts = rows.groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))
    if stop_words is not None:
        listed = stop_words.select(F.col(stop_words.columns[0]).alias("word")).distinct()
        counts = counts.join(listed, "word", "left_anti")
    alone = F.when(F.col("word").isNotNull(), F.array("word")).otherwise(F.array().cast("array<string>"))
    hashed = HashingTF(inputCol=_TOKENS, outputCol=_FEATURES, numFeatures=NUM_FEATURES).transform(counts.withColumn(_TOKENS, alone))
    # the one index of a vector of one word, read from the vector's fields
    fields = F.from_json(F.to_json(F.struct(F.col(_FEATURES).alias("v"))), "v struct<indices: array<int>>")
    return hashed.groupBy("label", F.get(fields["v"]["indices"], F.lit(0)).alias("feature")).agg(F.sum("n").alias("total"))


def train_words(labelled: DataFrame, smoothing: float = SMOOTHING, stop_words: DataFrame | None = None) -> NaiveBayesModel:
    """Fits the classifier on ``(label, words)`` rows, label a class index.

    The corpus is reduced to sums by class and feature (``feature_sums``), of
    which there are at most 2^20 and one per class, the size of the model. They
    become one sparse mean vector for each class, weighted by its documents,
    which is what the fit reads: the class counts and term sums are those of
    the documents, and the first dense vector is the model's own."""
    found = feature_sums(labelled, stop_words).toArrow()  # bounded by the model's size
    label, total = found["label"].to_numpy(), found["total"].to_numpy().astype(float)
    feature = found["feature"].fill_null(-1).to_numpy()
    rows = []
    for c in sorted(set(label)):
        weight = total[(label == c) & (feature < 0)][0]
        own = np.flatnonzero((label == c) & (feature >= 0))
        own = own[np.argsort(feature[own])]
        rows.append((float(c), float(weight), SparseVector(NUM_FEATURES, feature[own], total[own] / weight)))
    means = labelled.sparkSession.createDataFrame(rows, StructType([
        StructField("label", DoubleType()), StructField("weight", DoubleType()), StructField("features", VectorUDT())
    ]))
    nb = NaiveBayes(smoothing=smoothing, modelType="multinomial", featuresCol="features", labelCol="label", weightCol="weight")
    return nb.fit(means.coalesce(1))


def score(
    posts: DataFrame,
    model: NaiveBayesModel,
    text_col: str = "text",
    stop_words: Iterable[str] | DataFrame = STOP_WORDS,
    keep_text: bool = True,
) -> DataFrame:
    """``posts`` plus ``polarity`` (int 0/2/4), predicted from ``text_col``.

    Only the prediction column is computed (no probability vector). Without
    ``keep_text`` the text ends here, so that what follows moves only the
    narrow columns."""
    feats = featurize(posts, text_col, stop_words=stop_words)
    params = {
        model.featuresCol: _FEATURES,
        model.predictionCol: _CLASS,
        model.rawPredictionCol: "",
        model.probabilityCol: "",
    }
    out = model.transform(feats, params)
    out = out.withColumn("polarity", class_to_polarity(_CLASS)).drop(_FEATURES, _CLASS)
    return out if keep_text else out.drop(text_col)


def predictions(
    corpus: DataFrame,
    model: NaiveBayesModel,
    text_col: str = "status",
    polarity_col: str = "polarity",
    stop_words: Iterable[str] | DataFrame = STOP_WORDS,
) -> DataFrame:
    """Validation rows ``(Actual, Predicted, Text)``: actual and predicted
    polarity as doubles, text with newlines removed."""
    rows = corpus.select(
        F.col(polarity_col).cast("double").alias("_actual"),
        F.regexp_replace(text_col, "\n", "").alias("_text"),
    )
    scored = score(rows, model, "_text", stop_words)
    return scored.select(
        F.col("_actual").alias("Actual"),
        F.col("polarity").cast("double").alias("Predicted"),
        F.col("_text").alias("Text"),
    )


def accuracy(preds: DataFrame) -> DataFrame:
    """One row ``(n_total, n_correct, accuracy)``; accuracy in percent with
    two decimals (NULL for no rows). One pass, partial aggregation per task."""
    correct = F.when(F.col("Actual") == F.col("Predicted"), 1).otherwise(0)
    return preds.agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(correct).cast("bigint").alias("n_correct")
    ).select(
        "n_total",
        "n_correct",
        F.round(F.try_divide(F.col("n_correct") * F.lit(100.0), F.col("n_total")), 2).alias("accuracy"),
    )


def holdout_split(corpus: DataFrame, key: str = "id", test_buckets: int = 2, seed: int = 0):
    """Deterministic ``(train, test)`` split by ``pmod(xxhash64(key), 10)``:
    buckets below ``test_buckets`` are held out. Stable under re-execution."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10))
    return corpus.filter(bucket >= test_buckets), corpus.filter(bucket < test_buckets)


def save(model: NaiveBayesModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> NaiveBayesModel:
    return NaiveBayesModel.load(path)
