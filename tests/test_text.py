"""Golden pairs for the text normaliser (order of the clean-up matters)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postlens.functions import text as X
from postlens.sources.stopwords import STOP_WORDS

GOLDEN = [
    # "rt\s+" has no word boundary: "start today" glues to "statoday"
    ("RT @user: Start today!", ["statoday"]),
    # newlines are deleted, gluing the words around them
    ("line one\nline two", ["line", "oneline", "two"]),
    # link deleted up to '?'; query text survives; "now" is a stop word
    ("visit http://x.com/a?q=hello now", ["visit", "q", "hello"]),
    # "http?" also matches "htt"
    ("htt://foo.bar baz", ["baz"]),
    # tokens with digits or underscores are dropped whole
    ("abc123 x_y hello", ["hello"]),
    # non-ASCII letters separate tokens ("ve" is then a stop word)
    ("naïve café", ["na", "caf"]),
    # duplicates are kept
    ("the good the good", ["good", "good"]),
    # mentions with leading whitespace, then tags
    ("#tag and @me text", ["text"]),
    ("", []),
]


@pytest.mark.parametrize("text,expected", GOLDEN)
def test_tokens_golden(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(X.tokens("text").alias("t")).collect()[0].t == expected


def test_tokens_null_text(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(X.tokens("text").alias("t")).collect()[0].t is None


def test_stop_words_fixed_list():
    assert len(STOP_WORDS) == 153
    assert STOP_WORDS[:3] == ("i", "me", "my") and STOP_WORDS[-1] == "wouldn"


def test_gate_and_links(spark):
    df = spark.createDataFrame(
        [(" Foo  Bar ", "x www.a.b http://c.d/e,f ftp://www.g.h")], "t string, l string"
    )
    r = df.select(X.alnum_list("t").alias("g"), X.link_tokens("l").alias("k")).collect()[0]
    assert r.g is True
    assert r.k == ["www.a.b", "http://c.d/e,f", "www.g.h"]
    bad = spark.createDataFrame([("foo_bar x",), ("café",), ("zh-cn",)], "t string")
    assert [r.g for r in bad.select(X.alnum_list("t").alias("g")).collect()] == [False] * 3


def test_minute_and_timestamp(spark):
    df = spark.createDataFrame([("Wed Oct 10 20:19:24 +0000 2018",)], "c string")
    r = df.select(X.minute_of_hour("c").alias("m"), X.created_ts("c").alias("ts")).collect()[0]
    assert r.m == "19"
    assert r.ts is not None and r.ts.minute == 19


def test_tag_list_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ([],), (["a", None, "b"],)], "h array<string>")
    assert [r.t for r in df.select(X.tag_list("h").alias("t")).collect()] == ["", "", "a b"]


def test_word_tokens_whole_words(spark):
    df = spark.createDataFrame([("Dans la maison, I think",)], "t string")
    assert df.select(X.word_tokens("t").alias("w")).collect()[0].w == [
        "dans", "la", "maison", "i", "think"]
    assert F is not None


def _split_form(col, stop):
    """The plain formulation: clean, split on \\W+, keep alphabetic non-stop tokens."""
    c = F.lower(F.col(col))
    for p in X.CLEAN_PATTERNS:
        c = F.regexp_replace(c, p, "")
    return F.filter(F.split(c, X.TOKEN_SPLIT), lambda w: w.rlike(X.ALPHA_TOKEN) & ~w.isin(stop))


ADVERSARIAL = ["a @b@c #x#y z", "r\nt x", "htthttp://xp://y z", "x@a @b", "@ab @cd!", "ht\ntp://x.com y",
               "/@x/ http://a b", "http:/@x/y.z w", "don't won't i'm", "A An AND", "a1 b_c d", "x//y  z"]


def test_tokens_equal_split_form_on_documents(spark):
    from tests.conftest import SF_CHECK

    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("text")
    extra = spark.createDataFrame([(s,) for s in ADVERSARIAL + [g for g, _ in GOLDEN]], "text string")
    both = docs.unionByName(extra)
    stop = list(STOP_WORDS)
    diff = both.select(X.tokens("text").alias("a"), _split_form("text", stop).alias("b")).filter("NOT (a <=> b)")
    assert diff.count() == 0


def test_mentions_any_equals_token_overlap(spark):
    from tests.conftest import SF_CHECK

    words = ["I", "et", "de", "to", "w", "brand_x", "café", "él", "où"]
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("text")
    extra = spark.createDataFrame([(s,) for s in ["I", "i'm", "To-do", "xto", "brand_x!", "café", "cafés", "él", "quél", "w/", None]],
                                  "text string")
    overlap = F.arrays_overlap(X.word_tokens("text"), F.array(*[F.lit(w.lower()) for w in words]))
    both = docs.unionByName(extra).select(X.mentions_any("text", words).alias("a"), overlap.alias("b"))
    assert both.filter("NOT (a <=> b)").count() == 0
    hits = extra.filter(X.mentions_any("text", ["café", "él"])).collect()
    assert [r.text for r in hits] == ["café", "él"]


def test_listed_words_may_hold_quotes(spark):
    odd = ["it's", "back\\slash", '"x"', "é", "\\'", "%"]
    df = spark.createDataFrame([(1, [*odd, "left", "left"]), (2, None), (3, [])], "id long, t array<string>")
    words = spark.createDataFrame([(w,) for w in [*odd, odd[0]]], "w string")
    for few in (10_000, 0):
        got = {r.id: r.t for r in X.without_words(df, "t", words, few).collect()}
        assert got == {1: ["left", "left"], 2: [], 3: []}


def test_clean_up_looks_for_its_characters_by_bytes(spark):
    rows = [("é@x y",), ("日本 #tag ż/",), ("a http://b.c/d e",), ("",), (None,), ("no mark é",)]
    df = spark.createDataFrame(rows, "text string").select(X.clean_text("text").alias("c"))
    assert [r.c for r in df.collect()] == ["é y", "日本 ż/", "a  e", "", None, "no mark é"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(text" in plan and "instr(text" not in plan
