"""Capture in micro-batches that know what was captured before them.

Each micro-batch of a stream over a landing directory writes its lines once,
parted into captured posts, control records and broken lines, and then one
ledger entry: what it saw, and how many posts all batches have captured so far.

* **Stop at N.** A batch starts from the total in the entry before it. The batch
  that reaches N keeps the first posts by (post time, id) that are missing and
  ends the query, so files that no batch has taken stay in the landing folder.
* **Resume.** A batch writes to a folder of its own number, replacing what a
  broken attempt left there. The checkpoint gives a number the same files
  again, so a run that broke anywhere ends with the rows of one that did not.
  A batch that is in the ledger is never written again.
* **Whole batches only.** Readers take the batches that the ledger lists, so a
  batch that is being written is not seen.
* **Partitioned.** Lines lie under batch, kind, language and day of the post;
  reads of some languages or days skip the other folders.
* **Counted in one pass.** The counts are observed while the lines are written;
  only the batch that has too many posts is written a second time.

    sink/batch=7/kind=captured/lang=en/day=2018-10-10/part-*.txt
    sink/_ledger/batch=7/part-*.json
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from postlens.functions import text as X
from postlens.schema import POST
from postlens.session import path_exists
from postlens.sources.posts import parse_posts
from postlens.streaming.capture import DEFAULT_LANGS, DEFAULT_WORDS, FILES_PER_TRIGGER, listed_matches, matches

CAPTURED, CONTROL, BROKEN, OTHER = "captured", "control", "broken", "other"
KINDS = (CAPTURED, CONTROL, BROKEN, OTHER)
LEDGER = "batch long, lines long, captured long, control long, broken long, other long, total long"
LINES = "value string, batch long, kind string, lang string, day string"
UNKNOWN = "unknown"  # a folder cannot be named by an empty text


def line_kinds(lines: DataFrame, langs: Sequence[str], words: Sequence[str] | DataFrame, value: str = "value") -> DataFrame:
    """Raw lines as (value, kind, lang, day, id, at): ``captured`` posts are in
    ``langs`` and mention a word, ``other`` posts are not, ``control`` records
    are JSON objects without an id, ``broken`` lines are no JSON object or have
    a field of the wrong type. What has no language or no readable time has
    ``UNKNOWN`` there; days are those of UTC. Empty lines are left out."""
    bad = "_pl_bad"
    schema = StructType([*POST.fields, StructField(bad, StringType())])
    parsed = F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = lines.where(F.trim(F.col(value)) != "").select(F.col(value).alias("value"), parsed.alias("p")).select("value", "p.*")
    broken, control = F.col(bad).isNotNull(), F.col("id").isNull()
    if isinstance(words, DataFrame):
        rows = listed_matches(rows.where(~(broken | control)), langs, words, "_pl_match").unionByName(rows.where(broken | control).withColumn("_pl_match", F.lit(False)))
        match = F.col("_pl_match")
    else:
        match = F.coalesce(matches(langs, words), F.lit(False))
    kind = F.when(broken, BROKEN).when(control, CONTROL).when(match, CAPTURED).otherwise(OTHER)
    at = F.when(~broken, X.created_ts())
    return rows.select(
        "value", kind.alias("kind"),
        F.when(kind.isin(CAPTURED, OTHER), F.coalesce(F.nullif("lang", F.lit("")), F.lit(UNKNOWN))).otherwise(UNKNOWN).alias("lang"),
        F.when(kind.isin(CAPTURED, OTHER) & at.isNotNull(), F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd")).otherwise(UNKNOWN).alias("day"),
        "id", at.alias("at"),
    )


def _folder(sink: str, batch: int) -> str:
    return f"{sink.rstrip('/')}/batch={batch}"


def _entry(sink: str, batch: int) -> str:
    return f"{sink.rstrip('/')}/_ledger/batch={batch}"


def read_ledger(spark: SparkSession, sink: str) -> DataFrame:
    """A row for each finished batch: its counts, and posts captured so far."""
    path = f"{sink.rstrip('/')}/_ledger"
    if not path_exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).json(path)


def captured_before(spark: SparkSession, sink: str, batch: int) -> int:
    """Posts captured by the batches before ``batch`` (the entry before has it)."""
    if batch == 0:
        return 0
    return spark.read.schema(LEDGER).json(_entry(sink, batch - 1)).first()["total"]  # one row


def captured_so_far(spark: SparkSession, sink: str) -> int:
    return read_ledger(spark, sink).agg(F.coalesce(F.max("total"), F.lit(0).cast("long"))).first()[0]


def _write(lines: DataFrame, path: str) -> dict[str, int]:
    """Writes captured, control and broken lines and returns all kinds' counts."""
    seen = Observation("lines")
    counts = [F.coalesce(F.sum((F.col("kind") == k).cast("long")), F.lit(0).cast("long")).alias(k) for k in KINDS]
    observed = lines.observe(seen, *counts)
    kept = observed.where(F.col("kind") != OTHER).select("value", "kind", "lang", "day")
    kept.write.mode("overwrite").partitionBy("kind", "lang", "day").text(path)
    return {k: seen.get.get(k) or 0 for k in KINDS}


def write_batch(
    lines: DataFrame, sink: str, batch: int, n: int | None = None, on_written: Callable[[int], None] | None = None
) -> int:
    """Writes ``line_kinds`` rows as batch number ``batch`` and its ledger entry;
    returns the posts captured so far, at most ``n``. Repeating it replaces it."""
    spark, path = lines.sparkSession, _folder(sink, batch)
    before = captured_before(spark, sink, batch)
    counts = _write(lines, path)
    if n is not None and before + counts[CAPTURED] > n:
        is_captured = F.col("kind") == CAPTURED
        first = lines.where(is_captured).orderBy(F.asc_nulls_last("at"), "id", "value").limit(n - before)
        _write(lines.where(F.col("kind").isin(CONTROL, BROKEN)).unionByName(first), path)
        counts[OTHER] += counts[CAPTURED] - (n - before)
        counts[CAPTURED] = n - before
    if on_written:
        on_written(batch)
    total = before + counts[CAPTURED]
    row = (sum(counts.values()), *[counts[k] for k in KINDS], total)
    schema = LEDGER.removeprefix("batch long, ")  # the folder's name has the batch
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(_entry(sink, batch))
    return total


def start_batches(
    spark: SparkSession,
    landing_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    langs: Sequence[str] = DEFAULT_LANGS,
    words: Sequence[str] | DataFrame = DEFAULT_WORDS,
    n: int | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = FILES_PER_TRIGGER,
    on_written: Callable[[int], None] | None = None,
):
    """Starts the capture and returns its ``StreamingQuery``, which ends itself
    once ``n`` posts are captured. ``words`` may be a DataFrame whose first
    column holds them. ``on_written`` is called with the number of a batch
    whose lines are written but not yet in the ledger."""
    if not path_exists(spark, f"{checkpoint_dir.rstrip('/')}/metadata") and path_exists(spark, f"{sink_dir.rstrip('/')}/_ledger"):
        raise ValueError("the sink holds the batches of another checkpoint")
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    started: list = []
    ready = threading.Event()

    def end() -> None:
        """Ends the query from inside a batch: no batch starts after this one."""
        ready.wait()
        threading.Thread(target=started[0].stop, daemon=True).start()
        while started[0].isActive:
            time.sleep(0.02)

    def each(batch: DataFrame, number: int) -> None:
        total = captured_before(spark, sink_dir, number)
        if path_exists(spark, f"{_entry(sink_dir, number)}/_SUCCESS"):  # finished, but ended before the checkpoint had it
            total = captured_before(spark, sink_dir, number + 1)
        elif n is None or total < n:
            total = write_batch(line_kinds(batch, langs, words), sink_dir, number, n, on_written)
        if n is not None and total >= n:
            end()

    writer = reader.load(landing_dir).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    started.append(writer.start())
    ready.set()
    return started[0]


def capture_batches(spark: SparkSession, landing_dir: str, sink_dir: str, checkpoint_dir: str, *args, n: int | None = None, **options) -> DataFrame:
    """Captures what has landed, up to ``n`` posts in all runs with this
    checkpoint, and returns the captured posts. Once ``n`` are captured, further
    runs do nothing; one with a larger ``n`` goes on with the files that no batch
    has taken."""
    if n is None or captured_so_far(spark, sink_dir) < n:
        start_batches(spark, landing_dir, sink_dir, checkpoint_dir, *args, n=n, **options).awaitTermination()
    return read_batches(spark, sink_dir)


def read_lines(spark: SparkSession, sink_dir: str, kind: str = CAPTURED, where: Column | None = None) -> DataFrame:
    """(value, batch, kind, lang, day) of the finished batches. ``where`` may
    name ``lang`` and ``day``, which are folders: others are not read."""
    if not path_exists(spark, sink_dir):  # no batch yet
        return spark.createDataFrame([], LINES)
    lines = spark.read.schema(LINES).text(sink_dir).where(F.col("kind") == kind)
    lines = lines if where is None else lines.where(where)
    return lines.join(read_ledger(spark, sink_dir).select("batch"), "batch", "left_semi")


def read_batches(spark: SparkSession, sink_dir: str, where: Column | None = None) -> DataFrame:
    """The captured posts of the finished batches, in the ``POST`` schema."""
    return parse_posts(read_lines(spark, sink_dir, CAPTURED, where))
