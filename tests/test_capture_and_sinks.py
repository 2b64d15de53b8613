"""Capture (batch and streaming), dispatch by name, sinks, invariance."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from postlens.operators import analyses as A
from postlens.plans import catalog, dispatch
from postlens.sinks import write_accuracy, write_json_lines, write_result
from postlens.sources.posts import read_posts
from postlens.sources.testdata import posts_from_testdata
from postlens.streaming import capture as K
from tests.conftest import SF_SMOKE, post

QUERIES = catalog.queries()


def test_parse_arguments():
    assert K.parse_list_arg(" [en, fr ,es] ") == ["en", "fr", "es"]
    assert K.parse_count_arg(" 10 ") == 10
    with pytest.raises(ValueError):
        K.parse_count_arg("0")
    with pytest.raises(ValueError):
        K.parse_list_arg("[]")


def test_capture_filter_language_and_whole_words(spark, tmp_dir):
    lines = [
        post(1, text="Buy BrandX now", lang="en"),
        post(2, text="brandxyz is not it", lang="en"),
        post(3, text="brandx en français", lang="fr"),
        post(4, text="brandx", lang="de"),
        post(5, text="#BrandX!", lang="en", created_at="Wed Oct 10 20:18:00 +0000 2018"),
    ]
    with open(os.path.join(tmp_dir, "in.json"), "w") as f:
        f.write("\n".join(lines))
    posts = read_posts(spark, tmp_dir)
    got = [r.id for r in K.capture_filter(posts, ["en", "fr"], ["BrandX"], n=None).orderBy("id").collect()]
    assert got == [1, 3, 5]
    # the bound keeps the earliest posts by time, then id
    assert [r.id for r in K.capture_filter(posts, ["en", "fr"], ["BrandX"], n=2).collect()] == [5, 1]


def test_streaming_capture_resumes_without_duplicates(spark, tmp_dir):
    landing, sink, ck = (os.path.join(tmp_dir, d) for d in ("landing", "sink", "ck"))
    os.makedirs(landing)
    first = [post(i, text="to be or not", lang="en") for i in range(1, 6)] + ["garbage"]
    with open(os.path.join(landing, "a.json"), "w") as f:
        f.write("\n".join(first))
    q = K.start_capture(spark, landing, sink, ck, ["en"], ["to"])
    q.awaitTermination()
    assert K.read_captured(spark, sink, None).count() == 5
    second = [post(i, text="to go", lang="en") for i in range(6, 9)] + [post(9, text="nope", lang="en")]
    with open(os.path.join(landing, "b.json"), "w") as f:
        f.write("\n".join(second))
    q = K.start_capture(spark, landing, sink, ck, ["en"], ["to"])
    q.awaitTermination()
    ids = [r.id for r in K.read_captured(spark, sink, None).collect()]
    assert sorted(ids) == list(range(1, 9))
    # raw lines are kept unchanged
    raw = spark.read.text(sink).collect()
    assert {r.value for r in raw} <= set(first + second)


def test_streaming_matches_batch_on_testdata(spark):
    a = {tuple(r) for r in QUERIES["capture_stream"](spark, SF_SMOKE).collect()}
    b = {tuple(r) for r in QUERIES["capture_filter"](spark, SF_SMOKE).collect()}
    assert a == b and len(a) > 0


def test_dispatch_by_name(spark, edge_posts, toy_model):
    a = dispatch.run("  top 5 word count HASHTAGS ", edge_posts).collect()
    assert a == A.hashtag_counts(edge_posts).collect()
    share = dispatch.run("Sentiments Piechart(English Only)", edge_posts, model=toy_model, draw=F.lit(9))
    assert [tuple(r) for r in share.collect()] == [("Neutral", edge_posts.filter("text <> ''").count())]
    plain = dispatch.run("sentiment_counts", edge_posts, model=toy_model, jitter=False).collect()
    assert {r.sentiment for r in plain} <= {"Negative", "Positive"}
    one = dispatch.run("sentiment_counts", edge_posts, model=toy_model, langs=["zh-cn"]).collect()
    assert sum(r.n for r in one) == edge_posts.filter("text <> '' AND lang = 'zh-cn'").count()
    with pytest.raises(ValueError):
        dispatch.run("Both", edge_posts)
    with pytest.raises(ValueError):
        dispatch.run("sentiment_timeline", edge_posts)
    assert len(dispatch.ANALYSIS_NAMES) == 10


def test_sinks_roundtrip(spark, edge_posts, tmp_dir):
    out = os.path.join(tmp_dir, "counts")
    write_result(A.hashtag_counts(edge_posts), out, single_file=True)
    assert len(glob.glob(os.path.join(out, "*.csv"))) == 1
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["tag_list", "n"] and back.count() == 3

    preds = spark.createDataFrame([(0.0, 0.0, "a"), (4.0, 0.0, "b")], "Actual double, Predicted double, Text string")
    acc = os.path.join(tmp_dir, "accuracy")
    write_accuracy(preds, acc)
    write_accuracy(preds, acc)
    assert glob.glob(os.path.join(acc, "*.csv.gz"))
    assert spark.read.option("header", True).option("sep", "\t").csv(acc).count() == 4

    js = os.path.join(tmp_dir, "posts")
    write_json_lines(edge_posts.filter("id IS NOT NULL"), js)
    assert read_posts(spark, js).count() == 11


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_results_do_not_depend_on_partitioning(spark, parts):
    posts = posts_from_testdata(spark, SF_SMOKE)
    base = {
        "tags": sorted(map(tuple, A.hashtag_counts(posts).collect())),
        "urls": sorted(map(tuple, A.url_counts(posts).collect())),
        "langs": sorted(map(tuple, A.language_followers(posts).collect())),
    }
    moved = posts.repartition(parts)
    assert sorted(map(tuple, A.hashtag_counts(moved).collect())) == base["tags"]
    assert sorted(map(tuple, A.url_counts(moved).collect())) == base["urls"]
    assert sorted(map(tuple, A.language_followers(moved).collect())) == base["langs"]


def test_jobs_end_to_end(spark, edge_lines, tmp_dir):
    """train → validate → analyze (rows and chart) through the job entry point."""
    from postlens import jobs

    corpus = os.path.join(tmp_dir, "corpus.csv")
    with open(corpus, "w") as f:
        f.write('0,1,"Mon Apr 06",NO_QUERY,u1,"bad awful hate, terrible"\n')
        f.write('0,2,"Mon Apr 06",NO_QUERY,u2,"awful sad bad day"\n')
        f.write('4,3,"Mon Apr 06",NO_QUERY,u3,"good great love happy"\n')
        f.write('4,4,"Mon Apr 06",NO_QUERY,u4,"love good fun day"\n')
    model = os.path.join(tmp_dir, "model")
    assert jobs.main(["train", "--corpus", corpus, "--model", model]) == 0
    assert jobs.main(["train", "--corpus", corpus, "--model", model + "-h", "--holdout", "5"]) == 0
    acc = os.path.join(tmp_dir, "acc")
    assert jobs.main(["validate", "--corpus", corpus, "--model", model, "--out", acc]) == 0
    assert spark.read.option("header", True).option("sep", "\t").csv(acc).count() == 4

    posts = os.path.join(tmp_dir, "posts")
    os.makedirs(posts)
    with open(os.path.join(posts, "p.json"), "w") as f:
        f.write("\n".join(edge_lines))
    out = os.path.join(tmp_dir, "share")
    assert jobs.main(["analyze", "--posts", posts, "--analysis", "Sentiments Piechart(English Only)",
                      "--model", model, "--chart", "--out", out]) == 0
    share = spark.read.option("header", True).csv(out).collect()
    assert share and all(r.label.startswith(r.sentiment + "(") for r in share)
    out2 = os.path.join(tmp_dir, "tl")
    assert jobs.main(["analyze", "--posts", posts, "--analysis", "timeline of languages of tweets",
                      "--out", out2]) == 0
    assert spark.read.option("header", True).csv(out2).count() == 11


def test_stop_word_file_and_result_reader(spark, tmp_dir):
    from postlens.functions import text as X
    from postlens.operators import classifier as C
    from postlens.sources import parse_posts, read_result, read_stop_words

    path = os.path.join(tmp_dir, "stop.txt")
    with open(path, "w") as f:
        f.write("Foo\n bar \n\nfoo\n")
    words = read_stop_words(spark, path)
    assert sorted(r.word for r in words.collect()) == ["bar", "foo"]
    texts = [(1, "foo bar baz"), (2, "qux foo baz qux"), (3, "bar"), (4, ""), (5, None)]
    df = spark.createDataFrame(texts, "id long, text string")
    assert df.select(X.tokens("text", ["foo", "bar"]).alias("t")).first().t == ["baz"]
    tokens = df.select("id", "text", X.tokens("text", ()).alias("t"))
    for few in (10_000, 0):  # the list as a constant, and as a table in a join
        kept = {r.id: (r.text, r.t) for r in X.without_words(tokens, "t", words, few).collect()}
        assert kept == {1: (texts[0][1], ["baz"]), 2: (texts[1][1], ["qux", "baz", "qux"]), 3: ("bar", []), 4: ("", []), 5: (None, [])}
    # a list as words and as a table give the same features, model and scores
    corpus = spark.createDataFrame([(0, "foo bad bad"), (4, "bar good"), (4, "foo nice")], "polarity int, status string")
    models = [C.train(corpus, stop_words=w) for w in (("foo", "bar"), words)]
    assert (models[0].theta.toArray() == models[1].theta.toArray()).all()
    scores = [sorted(map(tuple, C.score(df, m, stop_words=w).collect())) for m, w in zip(models, (("foo", "bar"), words))]
    assert scores[0] == scores[1] and len(scores[0]) == 5

    out = os.path.join(tmp_dir, "res")
    write_result(spark.createDataFrame([("en", 3)], "lang string, n bigint"), out)
    back = read_result(spark, out).collect()
    assert [tuple(r) for r in back] == [("en", "3")]

    lines = spark.createDataFrame([(post(7, text="x"),), ("garbage",)], "value string")
    parsed = parse_posts(lines, keep_raw=True).collect()
    assert [r.id for r in parsed] == [7, None] and parsed[1].raw == "garbage"


def test_run_many_scores_once(spark, edge_posts, toy_model, tmp_dir):
    names = ["sentiment_counts", "Timeline of Sentiments of Tweets", "language_counts", "sentiment_bubble"]
    out = dispatch.run_many(names, edge_posts, model=toy_model, scored_path=os.path.join(tmp_dir, "scored"))
    assert list(out) == ["sentiment_counts", "sentiment_timeline", "language_counts", "sentiment_bubble"]
    assert glob.glob(os.path.join(tmp_dir, "scored", "*.parquet"))
    single = dispatch.run("sentiment_timeline", edge_posts, model=toy_model)
    assert sorted(map(tuple, out["sentiment_timeline"].collect())) == sorted(map(tuple, single.collect()))
    assert out["language_counts"].collect() == A.language_counts(edge_posts).collect()
    with pytest.raises(ValueError):
        dispatch.run_many(["sentiment_counts"], edge_posts)


def test_analyze_job_several_analyses(spark, edge_lines, tmp_dir, toy_model):
    from postlens import jobs
    from postlens.operators import classifier as C

    model = os.path.join(tmp_dir, "m")
    C.save(toy_model, model)
    posts = os.path.join(tmp_dir, "posts")
    os.makedirs(posts)
    with open(os.path.join(posts, "p.json"), "w") as f:
        f.write("\n".join(edge_lines))
    out = os.path.join(tmp_dir, "out")
    assert jobs.main(["analyze", "--posts", posts, "--model", model, "--chart", "--out", out,
                      "--analysis", "sentiment_counts", "--analysis", "sentiment_timeline"]) == 0
    assert spark.read.option("header", True).csv(os.path.join(out, "sentiment_counts")).count() >= 1
    assert spark.read.option("header", True).csv(os.path.join(out, "sentiment_timeline")).count() >= 1


def test_capture_job(spark, tmp_dir):
    from postlens import jobs

    landing, sink, ck = (os.path.join(tmp_dir, d) for d in ("landing", "sink", "ck"))
    os.makedirs(landing)
    with open(os.path.join(landing, "a.json"), "w") as f:
        f.write("\n".join([post(1, text="Brand news", lang="en"), post(2, text="brand", lang="de"),
                           post(3, text="other", lang="en")]))
    assert jobs.main(["capture", "--landing", landing, "--sink", sink, "--checkpoint", ck,
                      "--langs", "[en, fr]", "--words", "[BRAND]"]) == 0
    assert [r.id for r in K.read_captured(spark, sink).collect()] == [1]
    first = os.path.join(tmp_dir, "first")
    again = ["capture", "--landing", landing, "--sink", sink + "2", "--checkpoint", ck + "2", "--langs", "[en,de]",
             "--words", "[brand,other]"]
    assert jobs.main([*again, "--count", " 2 ", "--out", first]) == 0
    assert K.read_captured(spark, sink + "2").count() == 3
    assert sorted(r.id for r in read_posts(spark, first).collect()) == [1, 2]
    with pytest.raises(SystemExit):
        jobs.main([*again, "--count", "2"])


def test_capture_takes_words_in_any_script(spark):
    posts = spark.createDataFrame(
        [(1, "un bel été ici"), (2, "día"), (3, "a día"), (4, "się dzieje"), (5, "sie"), (6, "ÉTÉ!"), (7, "été2")],
        "id long, text string").selectExpr("*", "'x' AS lang", "'' AS created_at")
    ids = lambda words: sorted(r.id for r in K.capture_filter(posts, ["x"], words).collect())
    assert ids(["été"]) == [1, 6] and ids(["été", "ici"]) == [1, 6]
    assert ids(["a"]) == [3] and ids(["día"]) == [2, 3] and ids(["się"]) == [4]
    for word in ("not-a-word", "", "two words"):
        with pytest.raises(ValueError):
            K.matches(["x"], ["fine", word])


def test_tables_are_read_as_they_are_now(spark, tmp_dir):
    import shutil

    folder = os.path.join(tmp_dir, "sf")
    os.makedirs(docs := os.path.join(folder, "documents.parquet"))
    for name in os.listdir(SF_SMOKE):  # contents only: the supplied files are read-only
        shutil.copyfile(os.path.join(SF_SMOKE, name), os.path.join(docs, "a.parquet") if name == "documents.parquet" else os.path.join(folder, name))
    queries = catalog.queries()
    before = sum(r.n for r in queries["language_counts"](spark, folder).collect())
    shutil.copyfile(os.path.join(docs, "a.parquet"), os.path.join(docs, "b.parquet"))
    assert sum(r.n for r in queries["language_counts"](spark, folder).collect()) == 2 * before


def test_scratch_folder(spark, tmp_dir):
    from types import SimpleNamespace

    from postlens.session import remove_path, scratch_path, scratch_root

    assert scratch_path(spark, "x", folder=tmp_dir).startswith(tmp_dir)
    context = lambda master: SimpleNamespace(master=master, applicationId="app", getCheckpointDir=lambda: None)
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context(master))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            scratch_root(session(master))
    assert scratch_root(session("local[4]")) and scratch_root(session("local"))
    path = os.path.join(tmp_dir, "table")
    spark.range(3).write.parquet(path)
    remove_path(spark, path)
    assert not os.path.exists(path)


def test_jobs_leave_no_scratch(spark, edge_lines, tmp_dir, toy_model):
    from postlens import jobs
    from postlens.operators import classifier as C

    model, posts, scratch = (os.path.join(tmp_dir, x) for x in ("m", "posts", "scratch"))
    C.save(toy_model, model)
    os.makedirs(posts)
    with open(os.path.join(posts, "p.json"), "w") as f:
        f.write("\n".join(edge_lines))
    assert jobs.main(["--scratch", scratch, "analyze", "--posts", posts, "--model", model, "--out", os.path.join(tmp_dir, "o"),
                      "--analysis", "sentiment_counts", "--analysis", "sentiment_timeline", "--no-jitter", "--langs", "[en]"]) == 0
    assert not glob.glob(os.path.join(scratch, "postlens", "*", "scored"))


@pytest.mark.parametrize("name", ["nb_predictions", "sentiment_timeline_max", "language_timeline_max"])
def test_checked_queries_do_not_depend_on_shuffle_partitions(spark, name):
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    results = []
    try:
        for parts in ("1", "16"):
            spark.conf.set(key, parts)
            results.append(sorted(map(tuple, QUERIES[name](spark, SF_SMOKE).collect())))
    finally:
        spark.conf.set(key, old)
    assert results[0] == results[1] and results[0]


@pytest.mark.parametrize("many", [500_000, 0])
def test_word_table_of_any_length(spark, many, monkeypatch):
    from postlens.functions import text as X

    monkeypatch.setattr(X, "MANY_WORDS", many)  # the list broadcast, and shuffled
    texts = ["An ÉTÉ here", "no", "", None, "été", "a_b c", "été"]
    rows = [(i, t, "x", "") for i, t in enumerate(texts)] + [(7, "été", "y", ""), (8, "été", None, ""), (None, "c", "x", ""), (2, "no C", "x", "")]
    posts = spark.createDataFrame(rows, "id long, text string, lang string, created_at string")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    ids = lambda w: sorted((-1 if r.id is None else r.id) for r in K.capture_filter(posts, ["x"], w).collect())
    assert ids(words("Été", "c", "c", None, "two words", "")) == [-1, 0, 2, 4, 5, 6]
    assert ids(words("a_b")) == [5] and ids(words("missing", None)) == [] and ids(words(None)) == [] and ids(words()) == []
