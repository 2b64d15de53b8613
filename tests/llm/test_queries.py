"""The registered queries against their SQL, and the pipeline against its parts done plainly."""

from __future__ import annotations

import collections

import pytest

import corpus_pipeline
from postlens.llm import mixing, queries
from tests.compare import compare
from tests.llm import plain
from tests.llm.test_free import check_packed

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    ok, n, _, detail = compare(spark, SMOKE, name, queries.queries()[name], queries.oracle_sql()[name])
    assert ok and n > 0, detail


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_covers_its_table(spark, name):
    rows = queries.queries()[name](spark, SMOKE).select("doc_id").distinct().count()
    assert rows == spark.read.parquet(f"{SMOKE}/documents.parquet").count()


def ids(df) -> list:
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing sources", "packing"]

    kept = stages["quality rules"](spark, docs, SMOKE)
    passes = lambda t: len(w := plain.words(t)) >= 10 and 100 * plain.repeated_words(w) <= 20 * len(w)
    assert kept.columns == columns
    assert set(ids(kept)) <= {r.doc_id for r in docs.collect() if passes(r.text)}
    assert ids(kept) == ids(queries.queries()["op2_line_frequency"](spark, SMOKE).where("kept"))

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    single = stages["exact dedup"](spark, kept, SMOKE)
    assert single.columns == columns and ids(single) == sorted(x[0] for x in plain.exact(rows) if x[3])

    rows = [(r.doc_id, r.text) for r in single.collect()]
    apart = stages["near dedup"](spark, single, SMOKE)
    assert apart.columns == columns
    assert ids(apart) == sorted(i for i, (_, c) in plain.components(rows, 5, 80).items() if c == i)

    mixed = stages["mixing sources"](spark, apart, SMOKE)
    assert mixed.columns == columns
    copies = {r.doc_id: r.copies for r in mixing.mix(apart).collect()}
    assert collections.Counter(ids(mixed)) == collections.Counter(copies)

    rows = [(r.doc_id, r.text) for r in mixed.collect()]
    check_packed(stages["packing"](spark, mixed, SMOKE).collect(), rows, 4096)


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SMOKE).count() > 0


def test_stages_accept_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMOKE).count() == 0


def test_stages_on_edges(spark, edge_docs):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing names."""
    docs = edge_docs.repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, SMOKE)
    assert kept.columns == docs.columns and {None, 6, 7, 8, 9, 14} & {r.doc_id for r in kept.collect()} == set()

    single = stages["exact dedup"](spark, docs, SMOKE)
    verdicts = collections.defaultdict(bool)
    for x in plain.exact(rows):
        verdicts[x[0]] |= x[3]
    assert single.columns == docs.columns and collections.Counter(r.doc_id for r in single.collect()) == collections.Counter(i for i, _ in rows if verdicts[i])

    apart = stages["near dedup"](spark, docs, SMOKE)
    left = {r.doc_id for r in apart.collect()}
    assert apart.columns == docs.columns and {1, 18} <= left and not {2, 4, 5} & left

    mixed = stages["mixing sources"](spark, docs, SMOKE)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {i for i, _ in rows}
    # equal ids cannot be told apart by doc_id, so packing is checked on rows of their own
    own = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    check_packed(stages["packing"](spark, own, SMOKE).collect(), [(k, t) for k, (_, t) in enumerate(rows)], 4096)
    assert stages["packing"](spark, docs, SMOKE).count() >= len(rows)
