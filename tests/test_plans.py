"""Scale properties of the physical plans, checked without running them."""

from __future__ import annotations

import re

import pytest

from postlens.plans import catalog
from postlens.sources import testdata
from tests.conftest import SF_CHECK

QUERIES = catalog.queries()
# these write when they are described
EAGER = {
    "capture_stream", "json_roundtrip", "training_csv_roundtrip", "validation_rows", "saved_model_predictions", "result_reread",
    "capture_stop_at_n", "capture_resumed", "capture_by_language_and_day", "capture_line_kinds", "published_result",
    "chart_then_clear", "job_train_validate", "job_capture",
}
NAMES = sorted(set(QUERIES) - EAGER)
SENTIMENT = ["nb_predictions", "sentiment_counts", "sentiment_counts_jittered", "sentiment_share", "sentiment_bubble",
             "sentiment_bubble_points", "sentiment_timeline", "sentiment_timeline_max"]


def plan(spark, name: str) -> str:
    df = QUERIES[name](spark, SF_CHECK)
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(spark, name) for name in NAMES}


@pytest.fixture(scope="module")
def large_input_plans(spark):
    """Plans as on inputs too large to broadcast or to deal out."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    small, testdata.SPREAD_BYTES = testdata.SPREAD_BYTES, 0
    try:
        return {name: plan(spark, name) for name in NAMES}
    finally:
        spark.conf.set(key, old)
        testdata.SPREAD_BYTES = small


def test_no_python_evaluation_and_no_pairwise_joins(plans):
    for name, p in plans.items():
        for op in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct",
                   "BroadcastNestedLoopJoin"):
            assert op not in p, (name, op)


@pytest.mark.parametrize("name", ["hashtag_counts", "hashtag_counts_per_tag", "url_counts", "language_counts",
                                  "language_followers", "sentiment_counts", "sentiment_timeline_max",
                                  "language_timeline_max"])
def test_counts_aggregate_partially_before_the_exchange(plans, name):
    p = plans[name]
    assert re.search(r"Functions \[\d+\]: \[partial_(count|sum|max)", p), name


@pytest.mark.parametrize("name", [n for n in NAMES if n.endswith("_top5")])
def test_top_k_keeps_k_rows_per_task(plans, name):
    assert "TakeOrderedAndProject" in plans[name]


@pytest.mark.parametrize("name", ["hashtag_counts", "url_counts", "language_counts", "language_timeline"])
def test_text_is_not_read_when_unused(plans, name):
    schemas = re.findall(r"ReadSchema: (.*)", plans[name])
    assert schemas and all("text:" not in s for s in schemas), schemas


def test_sentiment_scoring_pushes_blank_text_filter_to_the_scan(plans):
    assert re.search(r"PushedFilters: \[IsNotNull\(text\), Not\(EqualTo\(text,\)\)", plans["nb_predictions"])


@pytest.mark.parametrize("name", ["hashtag_counts", "text_tokens", "sentiment_timeline", "language_timeline",
                                  "nb_predictions", "capture_filter"])
def test_unused_lookups_are_eliminated_at_scale(large_input_plans, name):
    p = large_input_plans[name]
    # only documents ⋈ events remains: author counts and page links are dropped
    assert len(re.findall(r"^\(\d+\) SortMergeJoin", p, re.M)) == 1, name
    assert "pages.parquet" not in p


@pytest.mark.parametrize("name", [*SENTIMENT, "nb_accuracy"])
def test_no_text_is_exchanged_for_a_score(large_input_plans, name):
    p = large_input_plans[name]
    exchanges = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", p, re.M)
    assert exchanges and not any(re.search(r"\b(text|status|_pl_tokens)#", e) for e in exchanges), exchanges


def test_documents_are_exchanged_once_at_scale(large_input_plans):
    p = large_input_plans["sentiment_bubble"]
    exchanges = re.findall(r"^\(\d+\) Exchange\nInput.*\nArguments: (.*)$", p, re.M)
    assert len([a for a in exchanges if a.startswith("hashpartitioning(doc_id")]) == 1, exchanges


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_training_exchanges_no_text(spark, few, monkeypatch):
    from postlens.sources.testdata import training_words

    monkeypatch.setattr(testdata, "SPREAD_BYTES", 0)
    df = training_words(spark, SF_CHECK, few)
    p = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    exchanges = re.findall(r"^\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", p, re.M)
    assert exchanges and not any("text#" in e for e in exchanges)
    if few:  # labelled ids go to the scan; no other document is tokenised
        assert p.index("LeftSemi") < p.index("regexp_extract_all")


@pytest.mark.parametrize("name", ["sentiment_summary", "text_tokens", "text_tokens_custom_stopwords"])
def test_one_scan_of_documents_and_no_text_in_exchanges(large_input_plans, name):
    p = large_input_plans[name]
    assert len(re.findall(r"Location: .*documents\.parquet", p)) == 1
    exchanges = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", p, re.M)
    assert exchanges and not any(re.search(r"\btext#", e) for e in exchanges), exchanges


def test_only_small_tables_are_dealt_out(spark, monkeypatch):
    from postlens.sources.testdata import documents

    dealt = lambda: "RepartitionByExpression" in documents(spark, SF_CHECK, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert dealt()
    monkeypatch.setattr(testdata, "SPREAD_BYTES", 1000)
    assert not dealt()


def test_no_text_is_exchanged_for_a_word_table(large_input_plans):
    p = large_input_plans["capture_word_table"]
    exchanges = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", p, re.M)
    # neither texts nor the words of texts; only the listed words are made distinct
    assert exchanges and not any(re.search(r"\b(text|token|_pl_salt)#\d+.*,|\btext#", e) for e in exchanges), exchanges
