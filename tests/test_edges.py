"""Analyses over hand-written posts covering the post-format edge cases."""

from __future__ import annotations

from postlens.operators import analyses as A
from postlens.operators import charts as G
from postlens.operators import classifier as C
from postlens.functions import text as X


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_malformed_and_control_lines_are_null_rows(edge_posts):
    assert edge_posts.count() == 13
    assert edge_posts.filter("id IS NULL").count() == 2


def test_hashtag_counts_key_is_whole_tag_list(edge_posts):
    # foo_bar / café fail the gate; empty and absent lists are dropped;
    # ties are ordered by key.
    assert rows(A.hashtag_counts(edge_posts)) == [("foo bar", 3), ("solo", 3), ("other", 1)]


def test_hashtag_counts_per_tag(edge_posts):
    got = dict(rows(A.hashtag_counts(edge_posts, per_tag=True)))
    assert got == {"foo": 3, "bar": 3, "x": 1, "solo": 3, "other": 1}


def test_url_counts_lowercases_and_finds_embedded_links(edge_posts):
    got = dict(rows(A.url_counts(edge_posts)))
    assert got == {"http://a.com/x,y": 1, "https://c": 1, "www.b.org": 1}


def test_influential_urls_keep_links_of_a_post_together(edge_posts):
    got = rows(A.influential_urls(edge_posts))
    assert got == [(1, "http://A.com/x,y https://c", 100), (6, "ftp://www.b.org", 100)]


def test_influential_hashtags_order_nulls_last_ties_by_id(edge_posts):
    got = [r[0] for r in rows(A.influential_hashtags(edge_posts))]
    assert got == [1, 6, 2, 3, 7, 8, 9, 11, 10]
    top = G.top_influence(A.influential_hashtags(edge_posts, order_output=False), "tag_list", k=2, width=3)
    assert rows(top) == [(1, "Foo Bar", 100, "Foo"), (6, "foo BAR", 100, "foo")]


def test_language_counts_gate_and_lowercase(edge_posts):
    assert rows(A.language_counts(edge_posts)) == [("en", 10)]


def test_language_followers_raw_codes_null_ignored(edge_posts):
    got = dict(rows(A.language_followers(edge_posts)))
    assert got == {"en": 360, "zh-cn": 7, "EN": 3}


def test_language_timeline_merges_hours_into_minute(edge_posts):
    tl = A.language_timeline(edge_posts)
    assert tl.count() == 11
    assert {r.minute for r in tl.collect()} == {"19"}
    got = {(r.lang, r.minute): r.max_followers for r in G.series_max(tl, "lang").collect()}
    assert got == {("en", "19"): 100, ("zh-cn", "19"): 7, ("EN", "19"): 3}


def test_real_minute_bucket(edge_posts):
    tl = A.language_timeline(edge_posts, bucket="minute")
    minutes = {r.minute.strftime("%H:%M") for r in tl.collect()}
    assert minutes == {"20:19", "21:19"}


def test_sentiment_analyses_drop_blank_text_and_tags(edge_posts, toy_model):
    scored = C.score(edge_posts.filter(X.not_blank("text")), toy_model)
    assert scored.count() == 9
    assert sum(r.n for r in A.sentiment_counts(scored).collect()) == 9
    bubble = A.sentiment_bubble(scored)
    assert sorted(r.id for r in bubble.collect()) == [1, 2, 3, 6, 9, 10, 11]
    assert A.sentiment_timeline(scored).count() == 9
    points = G.bubble_points(bubble).collect()
    assert all(p.x == 19 * 100000 for p in points)
    assert {p.id: p.size for p in points}[1] == 50
    assert {p.id: p.size for p in points}[10] is None


def test_sentiment_share_label_text(spark):
    counts = spark.createDataFrame(
        [("Positive", 1), ("Neutral", 1), ("Negative", 1)], "sentiment string, n bigint"
    )
    got = {r.sentiment: (r.share, r.label) for r in G.sentiment_share(counts).collect()}
    assert got["Positive"] == (33.33, "Positive(33.3%)")
    one = spark.createDataFrame([("Positive", 4)], "sentiment string, n bigint")
    assert G.sentiment_share(one).collect()[0].label == "Positive(100.%)"


def test_bubble_points_tolerate_malformed_time(spark):
    rows = [(1, 10, 5, 1, "19"), (2, 7, 3, -1, "x:"), (3, 8, 2, 0, None)]
    bubble = spark.createDataFrame(rows, "id long, followers long, statuses long, sentiment int, minute string")
    got = {r.id: (r.series, r.x, r.size) for r in G.bubble_points(bubble).collect()}
    assert got == {1: ("Positive", 1900000, 5), 2: ("Negative", None, 3), 3: ("Neutral", None, 4)}
