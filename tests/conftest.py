from __future__ import annotations

import json
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMOKE = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from postlens.session import scratch_root

    scratch_root(s)  # registers a private checkpoint folder only if none is set
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="postlens-test-")


def post(id, text="hello world", lang="en", created_at="Wed Oct 10 20:19:24 +0000 2018",
         tags=None, urls=None, followers=10, statuses=5, user=True):
    """One post as a JSON line; ``tags``/``urls`` of None omit the field."""
    entities = {}
    if tags is not None:
        entities["hashtags"] = [{"text": t, "indices": [0, 1]} for t in tags]
    if urls is not None:
        entities["urls"] = [{"expanded_url": u, "url": "t.co/x"} for u in urls]
    rec = {"id": id, "text": text, "lang": lang, "created_at": created_at, "favorite_count": 0,
           "entities": entities, "extra_field": {"ignored": True}}
    if user:
        rec["user"] = {"followers_count": followers, "statuses_count": statuses, "name": "n"}
    return json.dumps(rec)


@pytest.fixture(scope="session")
def edge_lines():
    """Hand-written posts for the edge cases of the post format."""
    return [
        post(1, tags=["Foo", "Bar"], urls=["http://A.com/x,y", "https://c"], followers=100),
        post(2, tags=["foo_bar", "x"], followers=50),
        post(3, tags=["café"], followers=30),
        post(4, tags=[], urls=[], followers=20),
        post(5, followers=40),  # no entities at all
        post(6, text="see ftp://www.b.org now", urls=["ftp://www.b.org"], tags=["foo", "BAR"],
             followers=100),
        post(7, text="", tags=["Foo", "Bar"], followers=10),
        post(8, text=None, tags=["Solo"], followers=10),
        post(9, lang="zh-cn", tags=["Solo"], followers=7),
        post(10, tags=["Solo"], user=False),
        post(11, created_at="Wed Oct 10 21:19:24 +0000 2018", tags=["Other"], lang="EN",
             followers=3),
        '{"limit":{"track":5,"timestamp_ms":"1539202764000"}}',
        "garbage",
    ]


@pytest.fixture(scope="session")
def edge_posts(spark, edge_lines):
    from postlens.sources.posts import read_posts

    path = tempfile.mkdtemp(prefix="postlens-edge-")
    with open(os.path.join(path, "posts.json"), "w") as f:
        f.write("\n".join(edge_lines) + "\n")
    return read_posts(spark, path).cache()


@pytest.fixture(scope="session")
def toy_model(spark):
    """A classifier trained on a tiny hand-written corpus."""
    from postlens.operators import classifier as C

    rows = [(0, "bad awful hate terrible"), (0, "awful sad bad day"), (0, "hate this bad thing"),
            (4, "good great love happy"), (4, "love good fun day"), (4, "great happy good times")]
    corpus = spark.createDataFrame(rows, "polarity int, status string")
    return C.train(corpus)
