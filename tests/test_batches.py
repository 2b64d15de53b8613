"""Capture in micro-batches: stop at N, resume, partitions, kinds of lines, word tables."""

from __future__ import annotations

import os
import re
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from postlens.sinks import arrive_in_order
from postlens.streaming import batches as B
from postlens.streaming import capture as K
from tests.conftest import post


def at(k: int) -> str:
    return f"Wed Oct {10 + k // 1440:02d} {k // 60 % 24:02d}:{k % 60:02d}:00 +0000 2018"


def land(folder: str, files: list[list[str]]) -> None:
    os.makedirs(folder, exist_ok=True)
    for lines in files:
        k = len(os.listdir(folder))
        path = os.path.join(folder, f"part-{k:03d}.json")
        with open(path, "w") as f:
            f.write("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))


def folders(tmp_dir: str) -> tuple[str, str, str]:
    return tuple(os.path.join(tmp_dir, x) for x in ("landing", "sink", "checkpoint"))


def ids(df) -> list[int]:
    return sorted(r.id for r in df.collect())


def five_a_file(n_files: int) -> list[list[str]]:
    """Each file has five posts, four of which match; within a file the times run backwards."""
    return [[post(10 * f + i, text="to be" if i else "none", created_at=at(100 * f - i)) for i in range(5)] for f in range(n_files)]


def test_stops_inside_the_stream_with_files_left(spark, tmp_dir):
    landing, sink, checkpoint = folders(tmp_dir)
    land(landing, five_a_file(8))
    run = lambda: B.capture_batches(spark, landing, sink, checkpoint, ["en"], ["to"], n=10, max_files_per_trigger=1)
    captured = run()
    # two whole files, then the earliest two of the third by time
    assert ids(captured) == [1, 2, 3, 4, 11, 12, 13, 14, 23, 24]
    ledger = B.read_ledger(spark, sink).orderBy("batch").collect()
    assert [(r.lines, r.captured, r.other, r.total) for r in ledger] == [(5, 4, 1, 4), (5, 4, 1, 8), (5, 2, 3, 10)]  # 5 files are left
    # neither a restart nor new files add anything
    land(landing, five_a_file(2))
    assert ids(run()) == ids(captured) and B.read_ledger(spark, sink).count() == 3
    # a run that is allowed more goes on where that one stopped
    more = B.capture_batches(spark, landing, sink, checkpoint, ["en"], ["to"], n=13, max_files_per_trigger=1)
    assert more.count() == 13 and set(ids(captured)) <= set(ids(more))


def test_state_survives_runs(spark, tmp_dir):
    landing, sink, checkpoint = folders(tmp_dir)
    for f, want in ((0, 4), (1, 8), (2, 10), (3, 10)):
        land(landing, [five_a_file(4)[f]])
        got = B.capture_batches(spark, landing, sink, checkpoint, ["en"], ["to"], n=10)
        assert got.count() == want and B.captured_so_far(spark, sink) == want


def test_a_batch_that_only_reaches_n_ends_the_query(spark, tmp_dir):
    landing, sink, checkpoint = folders(tmp_dir)
    land(landing, five_a_file(5))
    assert B.capture_batches(spark, landing, sink, checkpoint, ["en"], ["to"], n=8, max_files_per_trigger=1).count() == 8
    assert B.read_ledger(spark, sink).count() == 2


def test_fewer_posts_than_n_and_an_empty_landing(spark, tmp_dir):
    landing, sink, checkpoint = folders(tmp_dir)
    os.makedirs(landing)
    assert B.capture_batches(spark, landing, sink, checkpoint, ["en"], ["to"], n=10).count() == 0
    land(landing, five_a_file(1))
    assert B.capture_batches(spark, landing, sink, checkpoint, ["en"], ["to"], n=10).count() == 4


@pytest.mark.parametrize(("broken", "n"), [(0, None), (2, None), (1, 9)])
def test_a_broken_run_resumes(spark, tmp_dir, broken, n):
    landing, sink, checkpoint = folders(tmp_dir)
    land(landing, five_a_file(3))
    options = {"n": n, "max_files_per_trigger": 1}

    def fail(batch):
        if batch == broken:
            raise RuntimeError("broken")

    with pytest.raises(StreamingQueryException):
        B.capture_batches(spark, landing, sink, checkpoint, ["en"], ["to"], on_written=fail, **options)
    # the lines of the broken batch are there, but no reader sees them
    assert os.path.isdir(os.path.join(sink, f"batch={broken}"))
    assert B.read_batches(spark, sink).count() == 4 * broken
    got = B.capture_batches(spark, landing, sink, checkpoint, ["en"], ["to"], **options)
    unbroken = B.capture_batches(spark, landing, sink + "2", checkpoint + "2", ["en"], ["to"], **options)
    assert ids(got) == ids(unbroken) and len(ids(got)) == (n or 12)


def test_writing_a_batch_again_replaces_it(spark, tmp_dir):
    sink = folders(tmp_dir)[1]
    lines = lambda *k: B.line_kinds(spark.createDataFrame([(post(i, text="to"),) for i in k], "value string"), ["en"], ["to"])
    assert B.write_batch(lines(1, 2, 3), sink, 0) == 3
    assert B.write_batch(lines(4, 5), sink, 1) == 5
    assert B.write_batch(lines(4, 6), sink, 1) == 5
    assert ids(B.read_batches(spark, sink)) == [1, 2, 3, 4, 6]


def test_a_sink_belongs_to_one_checkpoint(spark, tmp_dir):
    landing, sink, checkpoint = folders(tmp_dir)
    land(landing, five_a_file(1))
    B.capture_batches(spark, landing, sink, checkpoint, ["en"], ["to"])
    with pytest.raises(ValueError, match="another checkpoint"):
        B.capture_batches(spark, landing, sink, checkpoint + "2", ["en"], ["to"])


KINDS = [
    (post(1, text="to be", lang="en", created_at=at(0)), B.CAPTURED, "en", "2018-10-10"),
    (post(2, text="TO go", lang="fr", created_at=at(1439)), B.CAPTURED, "fr", "2018-10-10"),
    (post(3, text="to", lang="en", created_at=at(1440)), B.CAPTURED, "en", "2018-10-11"),
    (post(4, text="to", lang="en", created_at="some day"), B.CAPTURED, "en", B.UNKNOWN),
    (post(5, text="tower", lang="en", created_at=at(0)), B.OTHER, None, None),
    (post(6, text="to", lang="zz", created_at=at(0)), B.OTHER, None, None),
    (post(7, text=None, lang="en"), B.OTHER, None, None),
    (post(8, text="to", lang=None), B.OTHER, None, None),
    ('{"limit":{"track":5}}', B.CONTROL, B.UNKNOWN, B.UNKNOWN),
    ("{}", B.CONTROL, B.UNKNOWN, B.UNKNOWN),
    ("garbage", B.BROKEN, B.UNKNOWN, B.UNKNOWN),
    ('{"id":9,"text":"to","lang":"en"', B.BROKEN, B.UNKNOWN, B.UNKNOWN),
    ('{"id":"nine","text":"to","lang":"en"}', B.BROKEN, B.UNKNOWN, B.UNKNOWN),
    ("[1]", B.BROKEN, B.UNKNOWN, B.UNKNOWN),
]


@pytest.mark.parametrize("as_table", [False, True])
def test_kinds_of_lines(spark, tmp_dir, as_table):
    landing, sink, checkpoint = folders(tmp_dir)
    land(landing, [[k[0] for k in KINDS], ["", "   ", "garbage"]])
    words = spark.createDataFrame([("To",), (None,), ("to",)], "w string") if as_table else ["to"]
    B.capture_batches(spark, landing, sink, checkpoint, ["en", "fr"], words)
    (entry,) = B.read_ledger(spark, sink).collect()
    want = Counter(k[1] for k in KINDS) + Counter([B.BROKEN])
    assert {k: entry[k] for k in B.KINDS} == want and entry.lines == len(KINDS) + 1
    got = Counter((r.value, r.kind, r.lang, r.day) for k in B.KINDS for r in B.read_lines(spark, sink, k).collect())
    assert got == Counter(k for k in KINDS if k[1] != B.OTHER) + Counter([("garbage", B.BROKEN, B.UNKNOWN, B.UNKNOWN)])


def test_days_do_not_depend_on_the_session_time_zone(spark):
    line = spark.createDataFrame([(post(1, text="to", created_at=at(1439)),)], "value string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert B.line_kinds(line, ["en"], ["to"]).first().day == "2018-10-10"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_reads_prune_languages_and_days(spark, tmp_dir):
    landing, sink, checkpoint = folders(tmp_dir)
    land(landing, [[k[0] for k in KINDS]])
    B.capture_batches(spark, landing, sink, checkpoint, ["en", "fr"], ["to"])
    assert os.path.isdir(os.path.join(sink, "batch=0", "kind=captured", "lang=en", "day=2018-10-11"))
    some = B.read_lines(spark, sink, where=(F.col("lang") == "en") & (F.col("day") == "2018-10-11"))
    assert [r.value for r in some.collect()] == [KINDS[2][0]]
    plan = some._sc._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    filters = "".join(re.findall(r"PartitionFilters: \[(.*)\]", plan))
    assert "lang" in filters and "day" in filters and "kind" in filters
    assert ids(B.read_batches(spark, sink, F.col("lang") == "fr")) == [2]


def test_counts_and_lines_come_from_one_pass(spark, tmp_dir):
    """The source is read once for a batch without a bound."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    lines = spark.createDataFrame([(k[0],) for k in KINDS], "value string").mapInPandas(seen, "value string")
    B.write_batch(B.line_kinds(lines, ["en"], ["to"]), folders(tmp_dir)[1], 0)
    assert reads.value == len(KINDS)


def test_files_arrive_in_order(spark, tmp_dir):
    landing = folders(tmp_dir)[0]
    spark.range(100).repartitionByRange(5, "id").selectExpr("cast(id AS string) value").write.text(landing)
    arrive_in_order(spark, landing)
    files = sorted(f for f in os.listdir(landing) if f.startswith("part-"))
    times = [os.stat(os.path.join(landing, f)).st_mtime for f in files]
    assert len(files) == 5 and times == sorted(set(times))


def test_capture_job_in_batches(spark, tmp_dir):
    from postlens import jobs

    landing, sink, checkpoint = folders(tmp_dir)
    land(landing, five_a_file(3))
    words = os.path.join(tmp_dir, "words.txt")
    with open(words, "w") as f:
        f.write("To\n\nnever\n")
    argv = ["capture", "--landing", landing, "--sink", sink, "--checkpoint", checkpoint, "--langs", " [ en ] "]
    for wrong in (["--stop-at", "5"], ["--words-file", words], ["--batches", "--count", "5", "--out", sink]):
        with pytest.raises(SystemExit):
            jobs.main([*argv, *wrong])
    with pytest.raises(ValueError):
        jobs.main([*argv, "--batches", "--stop-at", "0"])
    assert jobs.main([*argv, "--batches", "--stop-at", " 5 ", "--words-file", words]) == 0
    assert B.read_batches(spark, sink).count() == 5
    assert jobs.main([*argv, "--batches", "--stop-at", "5"]) == 0 and B.captured_so_far(spark, sink) == 5


def test_analyze_job_publishes(spark, tmp_dir):
    from postlens import jobs
    from postlens.sinks import read_published

    landing, out = folders(tmp_dir)[0], os.path.join(tmp_dir, "out")
    land(landing, five_a_file(1))
    for n in (5, 10):
        assert jobs.main(["analyze", "--posts", landing, "--analysis", "language_counts", "--out", out, "--publish"]) == 0
        assert [tuple(r) for r in read_published(spark, out, "csv", header=True).collect()] == [("en", str(n))]
        land(landing, five_a_file(1))


# tracked words as a table


def test_word_table_of_any_length(spark):
    posts = spark.createDataFrame(
        [(1, "un bel été ici", "x"), (2, "w99999x", "x"), (3, "W99999!", "x"), (4, None, "x"), (5, "w5", "y"), (6, "", "x"), (7, "w5", None), (3, "W99999!", "x")],
        "id long, text string, lang string").selectExpr("*", "'' AS created_at")
    words = spark.range(100_000).selectExpr("concat('w', id) AS word").union(spark.createDataFrame([("ÉTÉ",), (None,), ("two words",), ("",)], "word string"))
    assert ids(K.capture_filter(posts, ["x"], words)) == [1, 3, 3]
    plain = ["été", "w99999"]
    assert ids(K.capture_filter(posts, ["x"], plain)) == [1, 3, 3]
    assert ids(K.capture_filter(posts, ["x"], words.where("false"))) == []
    plan = K.capture_filter(posts, ["x"], words)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and not re.search("Join Cross", plan)


def test_hot_word_is_spread(spark):
    """A word of every post is joined under many keys."""
    from postlens.functions import text as X

    pairs = spark.range(2000).selectExpr("cast(id AS string) AS key", "'hot' AS token")
    words = spark.createDataFrame([("hot",), ("hot",), ("cold",)], "word string")
    assert X.listed_tokens(pairs, words).count() == 2000
    parts = pairs.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(X.LIST_SALTS))).groupBy("salt").count().collect()
    assert len(parts) == X.LIST_SALTS and max(r["count"] for r in parts) < 300
