"""Label maps, the jitter truth table and the classifier."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from postlens.functions import sentiment as S
from postlens.operators import classifier as C

JITTER = {
    0: ["Negative"] * 7 + ["Positive"] + ["Neutral"] * 2,
    4: ["Positive"] * 8 + ["Neutral"] * 2,
    2: ["Positive"] * 10,
    7: ["Positive"] * 10,
}


@pytest.mark.parametrize("polarity", sorted(JITTER))
def test_jitter_truth_table(spark, polarity):
    df = spark.createDataFrame([(polarity, r) for r in range(10)], "p int, r int")
    got = [x.l for x in df.select(S.jittered_label("p", F.col("r")).alias("l")).orderBy("r").collect()]
    assert got == JITTER[polarity]


def test_label_and_sign_maps(spark):
    df = spark.createDataFrame([(0,), (2,), (4,), (1,), (None,)], "p int")
    out = df.select(S.polarity_label("p").alias("l"), S.polarity_sign("p").alias("s")).collect()
    assert [(r.l, r.s) for r in out] == [
        ("Negative", -1), ("Neutral", 0), ("Positive", 1), ("Neutral", 0), ("Neutral", 0)]


def test_default_draw_is_partitioning_invariant(spark):
    base = spark.range(0, 2000)
    one = {r.id: r.d for r in base.coalesce(1).select("id", S.default_draw("id", 7).alias("d")).collect()}
    many = {r.id: r.d for r in base.repartition(13).select("id", S.default_draw("id", 7).alias("d")).collect()}
    assert one == many
    assert set(one.values()) == set(range(10))


def test_classifier_predicts_and_maps_labels_back(spark, toy_model):
    assert toy_model.numClasses == 2
    posts = spark.createDataFrame(
        [(1, "such a bad awful day"), (2, "i love this great thing"), (3, "")], "id long, text string")
    got = {r.id: r.polarity for r in C.score(posts, toy_model).collect()}
    assert got[1] == 0 and got[2] == 4
    assert got[3] in (0, 4)  # no tokens: the larger class prior decides


def test_neutral_class_is_trained_when_present(spark):
    rows = [(0, "bad awful"), (2, "meh okay"), (4, "good great")]
    model = C.train(spark.createDataFrame(rows, "polarity int, status string"))
    assert model.numClasses == 3
    posts = spark.createDataFrame([(1, "okay meh meh")], "id long, text string")
    assert C.score(posts, model).collect()[0].polarity == 2


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_sparse_fit_equals_the_direct_fit(spark, monkeypatch, few):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import HashingTF

    from postlens.sources.testdata import training_words
    from tests.conftest import SF_SMOKE

    monkeypatch.setattr(C, "NUM_FEATURES", 1 << 12)
    words = training_words(spark, SF_SMOKE, few).repartition(40)
    feats = HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 12).transform(words.where("words IS NOT NULL"))
    direct = NaiveBayes(smoothing=1.0, modelType="multinomial").fit(feats)
    model = C.train_words(words)
    assert abs(direct.pi.toArray() - model.pi.toArray()).max() < 1e-9
    assert abs(direct.theta.toArray() - model.theta.toArray()).max() < 1e-9


def test_sums_are_sparse_and_one_pass(spark):
    rows = [(0.0, ["a", "b", "a"]), (1.0, ["b"]), (1.0, None), (1.0, []), (None, ["c"]), (2.0, [])]
    words = spark.createDataFrame(rows, "label double, words array<string>")
    sums = C.feature_sums(words)
    a, b = (C.HashingTF(numFeatures=C.NUM_FEATURES).indexOf(w) for w in "ab")
    assert {(r.label, r.feature): r.total for r in sums.collect()} == {
        (0.0, None): 1, (0.0, a): 2, (0.0, b): 1, (1.0, None): 3, (1.0, b): 1, (2.0, None): 1}
    stop = spark.createDataFrame([("a",), (None,)], "w string")
    assert {(r.label, r.feature): r.total for r in C.feature_sums(words, stop).collect()} == {
        (0.0, None): 1, (0.0, b): 1, (1.0, None): 3, (1.0, b): 1, (2.0, None): 1}
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1  # documents and words are counted together
    model = C.train_words(words)
    assert model.numClasses == 3 and model.numFeatures == C.NUM_FEATURES


def test_few_and_many_labels_give_the_same_rows(spark, toy_model):
    from postlens.sources.testdata import validation_from_testdata
    from tests.conftest import SF_SMOKE

    a, b = (sorted(map(tuple, validation_from_testdata(spark, SF_SMOKE, toy_model, few).collect())) for few in (1_000_000, 0))
    assert a == b and len(a) > 0


def test_share_and_timeline_in_one_pass(spark):
    from postlens.operators import charts as G

    rows = [(1, 5, "Positive", "01"), (2, 9, "Positive", "01"), (3, None, "Negative", "01"), (4, 2, "Negative", None)]
    df = spark.createDataFrame(rows, "id long, followers long, sentiment string, minute string")
    both = G.sentiment_summary(df)
    got = {(r.chart, r.sentiment, r.minute): (r.n, r.share, r.label, r.max_followers) for r in both.collect()}
    assert got == {
        ("share", "Positive", None): (2, 50.0, "Positive(50.0%)", 9), ("share", "Negative", None): (2, 50.0, "Negative(50.0%)", 2),
        ("timeline", "Positive", "01"): (2, None, None, 9), ("timeline", "Negative", "01"): (1, None, None, None),
        ("timeline", "Negative", None): (1, None, None, 2)}
    assert both._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert G.sentiment_summary(df.where("false")).collect() == []


def test_accuracy_and_validation_rows(spark, toy_model):
    rows = [(0, "bad\nawful"), (4, "good great"), (0, "good love")]
    corpus = spark.createDataFrame(rows, "polarity int, status string")
    preds = C.predictions(corpus, toy_model)
    assert preds.columns == ["Actual", "Predicted", "Text"]
    assert preds.collect()[0].Text == "badawful"
    acc = C.accuracy(preds).collect()[0]
    assert (acc.n_total, acc.n_correct, acc.accuracy) == (3, 2, 66.67)


def test_model_save_load_roundtrip(spark, toy_model, tmp_dir):
    path = os.path.join(tmp_dir, "model")
    C.save(toy_model, path)
    loaded = C.load(path)
    posts = spark.createDataFrame([(1, "bad day"), (2, "good times")], "id long, text string")
    a = [r.polarity for r in C.score(posts, toy_model).orderBy("id").collect()]
    b = [r.polarity for r in C.score(posts, loaded).orderBy("id").collect()]
    assert a == b


def test_holdout_split_is_disjoint_and_complete(spark):
    corpus = spark.range(0, 1000)
    train, test = C.holdout_split(corpus)
    a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert not (a & b) and len(a | b) == 1000 and 100 < len(b) < 300


def test_accuracy_of_no_rows_is_null(spark):
    empty = spark.createDataFrame([], "Actual double, Predicted double, Text string")
    r = C.accuracy(empty).collect()[0]
    assert (r.n_total, r.n_correct, r.accuracy) == (0, None, None)


def test_sql_hash_buckets_equal_hashing_tf(spark):
    """The oracle's SQL MurmurHash3 gives every token the index HashingTF does."""
    import duckdb
    from pyspark.ml.feature import HashingTF

    from postlens.functions import text as X
    from postlens.plans.oracle import buckets_sql
    from tests.conftest import SF_SMOKE

    words = sorted({w for r in spark.read.parquet(f"{SF_SMOKE}/documents.parquet")
                    .select(F.explode(X.tokens("text")).alias("w")).distinct().collect() for w in [r.w]})
    words += ["a", "ab", "abc", "abcd", "abcde", "reintest", "ontihain"]
    df = spark.createDataFrame([([w],) for w in words], "t array<string>")
    tf = HashingTF(inputCol="t", outputCol="f", numFeatures=C.NUM_FEATURES).transform(df)
    spark_idx = {r.t[0]: r.f.indices[0] for r in tf.collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE vocab AS SELECT unnest(?::VARCHAR[]) AS w", [words])
    duck_idx = dict(con.execute(buckets_sql("vocab")).fetchall())
    assert duck_idx == spark_idx
    assert spark_idx["reintest"] == spark_idx["ontihain"]  # a real collision
