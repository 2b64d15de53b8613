"""Filter interaction audit by relations of failing ids.

Each filter has one table of the ids that fail it. What a filter removes as a
step of an order depends only on the set of filters before it (the prefix), so
prefixes are walked as sets, not as the k! orders:

* A step's removals are the filter's failing ids left-anti joined with the
  table of each filter of the prefix.
* Its redundancies are the ids that these joins take out: the left-semi join of
  the same two relations, summed along the prefix.
* Survivors are the documents less the removals so far, which are disjoint.

The walk starts from failing ids, so documents that pass every filter are
counted once and never joined. A prefix grows by filters of rising number, so
each (filter, prefix) is reached once. All of one length are a single pair of
joins on (filter, id), whose keys are unique on the table's side; an id that
fails one filter gets 1 + 4 + 6 + 4 + 1 rows in all at most, 16 with five
filters. The report is put together from at most k * 2^(k-1) counts for a part.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import text_of, word_array, written
from postlens.llm.skew import met
from postlens.session import scratch_path

FEW_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
SYMBOLS = r"[#$%&*|]"
REPORT = ("part", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """A to D: whether ``text`` (not null) fails."""
    words = word_array(text)
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < FEW_WORDS,
        "B": 100 * distinct < DISTINCT_PERCENT * n,
        "C": 100 * upper.cast("long") > UPPER_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A written row per document: key (a number of its own, fixed once
    written), doc_id, part, good, toxic, digest of the text, A to D."""
    t = text_of("t")
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("t"),
    )
    rows = rows.select("key", "doc_id", "part", F.unhex(F.sha2(t, 256)).alias("digest"), *[c.alias(k) for k, c in text_filters(t).items()])
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    return written(rows.join(known, "doc_id", "left").fillna(False, ["good", "toxic"]), "judged")


def repeats(rows: DataFrame) -> DataFrame:
    """The rows of ``judged`` whose text a smaller doc_id has."""
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = written(texts.where("last > first").select("digest", "first", "n"), "shared_texts")
    return met(rows, shared, "digest", "n").where("doc_id > first")


def failing_ids(rows: DataFrame, filters: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One written table (key, part, good, toxic) for each filter; ``filters``
    has the rows that fail it."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "failing")
    all_of = reduce(DataFrame.unionByName, (failing.select("key", *REPORT, F.lit(name).alias("filter")) for name, failing in filters.items()))
    all_of.write.partitionBy("filter").parquet(path)
    table = spark.read.schema(all_of.schema).parquet(path)
    return {name: table.where(F.col("filter") == name).drop("filter") for name in filters}


def prefix_tallies(failing: dict[str, DataFrame]) -> DataFrame:
    """(part, code, n, good, toxic, gone): for each filter number f and prefix
    (a bit set of the other filters), as code = f * 2^k + prefix, how many
    ids the filter removes after the prefix, the label losses among them, and
    how many the prefix's last filter took out of its removals."""
    k = len(failing)
    all_of = reduce(DataFrame.unionByName, (table.select(F.lit(f).alias("f"), "key", *REPORT) for f, table in enumerate(failing.values())))
    hits = all_of.select(F.col("f").alias("g"), "key")
    level = all_of.withColumn("prefix", F.lit(0))

    def tally(rows: DataFrame, removed: bool) -> DataFrame:
        one = lambda c: F.sum(c.cast("long")).alias
        yes, no = F.lit(True), F.lit(False)
        sums = [(yes, "n"), (F.col("good"), "good"), (F.col("toxic"), "toxic")]
        code = (F.col("f") * (1 << k) + F.col("prefix")).alias("code")
        return rows.groupBy("part", code).agg(*[one(c if removed else no)(x) for c, x in sums], one(no if removed else yes)("gone"))

    tallies = tally(level, True)
    for _ in range(k - 1):
        longer = F.filter(F.array(*[F.lit(g) for g in range(k)]), lambda g: (g != F.col("f")) & (F.call_function("shiftleft", F.lit(1), g) > F.col("prefix")))
        steps = level.withColumn("g", F.explode(longer))
        grown = F.expr("prefix | shiftleft(1, g)").alias("prefix")
        columns = ["f", "key", *REPORT, grown]
        tallies = tallies.unionByName(tally(steps.join(hits, ["g", "key"], "left_semi").select(*columns), False))
        level = written(steps.join(hits, ["g", "key"], "left_anti").select(*columns), "prefix_removals")
        tallies = tallies.unionByName(tally(level, True))
    return tallies.groupBy("part", "code").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic", "gone")])


def _orders(names: list[str]) -> list[dict]:
    """Every order's steps: the code of the step, of all steps so far, of the
    prefixes that the redundancies add up along, and the filter's codes by
    the number of orders that have that prefix before the filter."""
    k = len(names)
    found = []
    for order in permutations(range(k)):
        so_far = []
        for at, f in enumerate(order):
            prefix = sorted(order[:at])
            so_far = [*so_far, (f << k) + sum(1 << g for g in prefix)]
            found.append({
                "filter_order": "".join(names[i] for i in order),
                "step": at + 1,
                "code": so_far[-1],
                "so_far": so_far,
                "along": [(f << k) + sum(1 << g for g in prefix[: i + 1]) for i in range(at)],
                "alone": (f << k) + (1 << k) - 1 - (1 << f),
                "of_filter": [[(f << k) + m, factorial(m.bit_count()) * factorial(k - 1 - m.bit_count())] for m in range(1 << k) if not m >> f & 1],
            })
    return found


def interaction_audit(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """The report over all orders of the filters: one row per part,
    filter_order and step with kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley. ``rows`` has a row per document with its
    part, ``failing`` a table (key, part, good, toxic) per filter, named by one
    letter. Filters that nothing fails and parts that fail nothing get zeros;
    without rows the report is empty."""
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    # at most k * 2^(k-1) entries a part
    counts = prefix_tallies(failing).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("code", F.struct("n", "good", "toxic", "gone")))).alias("counts"))
    schema = "array<struct<filter_order: string, step: int, code: int, so_far: array<int>, along: array<int>, alone: int, of_filter: array<array<int>>>>"
    steps = F.explode(F.from_json(F.lit(json.dumps(_orders(list(failing)))), schema)).alias("s")
    each = parts.join(counts, "part", "left").select("part", "total", "counts", steps).select("part", "total", "counts", "s.*")

    def of(code: Column, field: str) -> Column:
        return F.coalesce(F.try_element_at("counts", code)[field], F.lit(0).cast("long"))

    def summed(codes: str, value) -> Column:
        return F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + value(x))

    removed = of(F.col("code"), "n")
    return each.select(
        "part", "filter_order", "step",
        (F.col("total") - summed("so_far", lambda c: of(c, "n"))).alias("kept"),
        removed.alias("removed"),
        summed("along", lambda c: of(c, "gone")).alias("redundant"),
        of(F.col("alone"), "n").alias("unique_fails"),
        of(F.col("code"), "good").alias("good_lost"),
        of(F.col("code"), "toxic").alias("toxic_lost"),
        summed("of_filter", lambda c: c[1] * of(c[0], "n")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``interaction_audit`` of the five text filters over ``docs``.

    A fails under 100 words, B under 80 % distinct words, C over 10 % A-Z among
    the characters, D any symbol of ``SYMBOLS``, E a text equal to that of a
    smaller doc_id anywhere in the table. Null text is empty (fails A, and E as
    other empty texts do); null part is the part ''. A null doc_id has no label,
    is not smaller than any, and has none smaller. Repeated rows are documents of
    their own and, having the same doc_id, no reason for E among themselves. Of several labels of
    a doc_id any counts. Further columns are ignored; an empty table gives an
    empty report."""
    rows = judged(docs, labels, doc_id, text, part)
    filters = {c: rows.where(c) for c in "ABCD"} | {"E": repeats(rows)}
    return interaction_audit(rows, failing_ids(rows, filters))
