from __future__ import annotations

import math
import random

import pytest

from postlens.llm import common, near_dedup
from postlens.llm.components import connected_components
from tests.llm import plain


def found(df) -> dict:
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 300), (7, 3), (3, 7), (None, 5)]
    edges = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}
    assert connected_components(edges.limit(0)).collect() == []


def versions(n: int, size: int, edits: int, seed: int) -> list[str]:
    """A text and versions of versions of it, so that their similarities lie around the threshold."""
    draw = random.Random(seed)
    texts = [[f"t{seed}w{k}" for k in range(size)]]
    for i in range(1, n):
        w = list(draw.choice(texts))
        for _ in range(draw.randint(1, edits)):
            w[draw.randrange(size)] = f"n{seed}x{i}{draw.randrange(9)}"
        texts.append(w)
    return [" ".join(w) for w in texts]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_versions(spark, monkeypatch, width, percent):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    texts = versions(120, 150, 4, 1) + versions(40, 60, 2, 2) + versions(30, 12, 1, 3)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), width=width, similarity=percent)
    expected = plain.components(rows, width, percent)
    assert len(set(expected.values())) > 10 and sum(c != i for i, (_, c) in expected.items()) > 60
    assert found(got) == expected


def test_sample(sample):
    docs, rows = sample
    assert found(near_dedup.near_dedup(docs, width=3, similarity=85)) == plain.components(rows, 3, 85)


def test_edges(edge_docs, edge_pairs, no_docs):
    rows = near_dedup.near_dedup(edge_docs, width=3, similarity=85).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert got == plain.components([p for p in edge_pairs if p[0] is not None], 3, 85)
    assert got[4][1] == 1 and got[6] == (0, 6) and got[11][1] == 10
    assert [r.kept for r in rows if r.doc_id == 20] == [True, True]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert near_dedup.near_dedup(no_docs).collect() == []
    with pytest.raises(ValueError):
        near_dedup.near_dedup(no_docs, similarity=50)


@pytest.mark.parametrize("similarity", [80, 85])
def test_signatures_keep_pairs_at_the_threshold(similarity):
    n, p = near_dedup.HASHES, similarity / 100
    least = math.ceil((p - near_dedup.SLACK) * n)
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least)) < 1e-8


def test_few_ids_go_to_the_texts(spark, monkeypatch):
    """Texts are shuffled only if the ids of those whose sets are compared are too many to be broadcast."""
    words = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(words)), (2, " ".join(words[1:])), (3, " ".join(words[:1] + words)), (4, "alone in the table"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = []
        for most in (near_dedup.MOST_IDS, 0):
            plans = {}

            def kept(df, name):
                plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
                return common.written(df, name)

            monkeypatch.setattr(near_dedup, "written", kept)
            monkeypatch.setattr(near_dedup, "MOST_IDS", most)
            found.append(sorted(near_dedup.near_dedup(docs, width=3).collect(), key=str))
            assert ("BroadcastHashJoin" in plans["shingle_sets"]) == (most > 0)
        assert found[0] == found[1]
        assert sorted(r.component_id for r in found[0] if r.component_id is not None) == [2, 2, 2, 4, 5]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
