"""Every registered query against its DuckDB SQL on the supplied tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from postlens.plans import catalog, oracle
from tests.compare import compare, duck
from tests.conftest import SF_CHECK, SF_SMOKE

QUERIES, SQL = catalog.queries(), oracle.oracle_sql()
NAMES = sorted(QUERIES)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["tag_list", "n"]
    assert len(rows) > 0
    assert [r.n for r in rows] == sorted((r.n for r in rows), reverse=True)


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, n, _, detail = compare(spark, SF_CHECK, name, QUERIES[name], SQL[name], con)
    assert ok, detail
    assert n > 0


@pytest.mark.parametrize("name", ["hashtag_counts", "url_counts", "language_timeline_max", "capture_filter"])
def test_query_matches_sql_smoke_scale(spark, name):
    ok, _, _, detail = compare(spark, SF_SMOKE, name, QUERIES[name], SQL[name])
    assert ok, detail


def test_oracle_takes_nothing_from_the_engine():
    source = open(oracle.__file__, encoding="utf-8").read()
    assert "import" not in source.replace("from __future__ import annotations", "").split("def ", 1)[0].split('"""', 2)[2]


def test_a_changed_pattern_shows(spark, con, monkeypatch):
    from postlens.functions import text as X

    monkeypatch.setattr(X, "ALPHA_RUN", r"(?<!\w)[a-z]{2,}+(?!\w)")
    ok, *_ = compare(spark, SF_CHECK, "text_tokens", QUERIES["text_tokens"], SQL["text_tokens"], con)
    assert not ok
