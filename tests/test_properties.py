"""Property tests: the optimised text expressions equal their plain forms."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlens.functions import text as X
from postlens.sources.stopwords import STOP_WORDS
from tests.test_text import _split_form

# Characters the clean-up patterns and the token rules care about.
ALPHABET = "aAbrtThpsS:/@#._-%!? \n\t19_éK"
texts = st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=200)
words = st.lists(st.text(alphabet="abt_1éKß漢", min_size=1, max_size=3), min_size=1, max_size=4)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts)
def test_tokens_equal_split_form(spark, batch):
    df = spark.createDataFrame([(t,) for t in batch], "text string")
    out = df.select("text", X.tokens("text").alias("a"), _split_form("text", list(STOP_WORDS)).alias("b"))
    bad = out.filter("NOT (a <=> b)").collect()
    assert not bad, bad[:3]


PIECES = ["htt", "p", "s", ":", "/", "//", "://", "http", "https", " ", "  ", "\n", "\t", "@", "#", "a", "b_1", "rt", "-", "%", ".", "é", "\u00a0"]
glued = st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=400)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(glued)
def test_clean_text_equals_the_chain(spark, batch):
    df = spark.createDataFrame([(t,) for t in batch], "text string")
    chain = F.lower("text")
    for pattern in X.CLEAN_PATTERNS:
        chain = F.regexp_replace(chain, pattern, "")
    bad = df.select("text", X.clean_text("text").alias("a"), chain.alias("b")).filter("NOT (a <=> b)").collect()
    assert not bad, bad[:3]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts, words)
def test_mentions_any_equals_token_overlap(spark, batch, tracked):
    df = spark.createDataFrame([(t,) for t in batch], "text string")
    overlap = F.arrays_overlap(X.word_tokens("text"), F.array(*[F.lit(w.lower()) for w in tracked]))
    out = df.select("text", X.mentions_any("text", tracked).alias("a"), overlap.alias("b"))
    bad = out.filter("NOT (a <=> b)").collect()
    assert not bad, (tracked, bad[:3])
