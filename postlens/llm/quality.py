"""Quality rules: word and line statistics, and cross-document line frequency.

A line that stands in many documents of one host (``source``) is boilerplate.
Normalised lines are hashed, the documents of the host that hold each are
counted (a document counts once), lines above the host's limit are removed,
and a document that loses nearly everything is rejected.

The limit is a share of the host's documents, so a host has at most
(mean distinct lines of a document) / share lines above it: the list of one
host stays small however large the host is. Documents meet it by host, which
is a broadcast while the table of lists is small and otherwise a sort-merge
join with the written table, whose hot hosts adaptive execution splits. Texts
are never exploded for that join, and no statistic needs a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import SPACES, line_array, text_of, word_array, written

#: A line is boilerplate in a host if more documents hold it than this share of the host's, and than LEAST_DOCS.
SHARE = 0.1
LEAST_DOCS = 20
#: A document that lost lines is depleted below this share of its words, or below this many words.
LEFT_SHARE = 0.3
LEFT_WORDS = 10


def normal_line(line: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    wide = line.rlike(r"[\x09-\x0D]|\x20\x20")
    return F.trim(F.lower(F.when(wide, F.regexp_replace(line, SPACES, " ")).otherwise(line)))


def host_key(host: str) -> Column:
    """The host as a join key; null is a host of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("null"))


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", share: float = SHARE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(host_key, frequent): the hashes of each host's lines above its limit."""
    rows = docs.select(host_key(host).alias("host_key"), text_of(text).alias("t"))
    hosts = rows.groupBy("host_key").agg(F.count(F.lit(1)).alias("n_docs"))
    hashes = F.array_distinct(F.transform(line_array(F.col("t")), lambda line: F.xxhash64(normal_line(line))))
    counted = (
        rows.select("host_key", F.explode(hashes).alias("line"))
        .groupBy("host_key", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > least_docs)
    )
    above = counted.join(hosts, "host_key").where(F.col("n") > share * F.col("n_docs"))
    return above.groupBy("host_key").agg(F.collect_list("line").alias("frequent"))


def _joined(hashes: Column, shift: int) -> Column:
    """The hash of hashes[i] and hashes[i + shift] for each i that has both."""
    size = F.size(hashes) - shift
    return F.zip_with(F.slice(hashes, 1, size), F.slice(hashes, 1 + shift, size), lambda a, b: F.xxhash64(a, b))


def _bound(value: Column, of) -> Column:
    """of(value), with ``value`` computed once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of five words that the text holds twice or
    more. Windows are compared by 64-bit hash, built from hashes of one, two
    and four words; the sort runs only for texts that hold a repeat."""
    width = 5

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            def again(x: Column, i: Column) -> Column:
                return (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"])

            return F.array_sort(F.transform(F.filter(p, lambda x, i: F.coalesce(again(x, i), F.lit(False))), lambda x: x["i"]))

        def summed(s: Column) -> Column:
            return F.aggregate(
                F.transform(s, lambda x, i: F.least(F.coalesce(F.get(s, i + 1) - x, F.lit(width)), F.lit(width))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            )

        return _bound(pairs, lambda p: _bound(starts(p), summed))

    zero = F.lit(0).cast("long")

    def of_windows(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(zero)

    def of_words(one: Column) -> Column:
        fifth = lambda four: F.zip_with(F.slice(four, 1, F.size(one) - 4), F.slice(one, 5, F.size(one) - 4), lambda a, b: F.xxhash64(a, b))
        return _bound(_joined(one, 1), lambda two: _bound(_joined(two, 2), lambda four: _bound(fifth(four), of_windows)))

    return F.when(F.size(words) <= width, zero).otherwise(_bound(F.transform(words, lambda w: F.xxhash64(w)), of_words))


def quality(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    share: float = SHARE,
    least_docs: int = LEAST_DOCS,
    left_share: float = LEFT_SHARE,
    left_words: int = LEFT_WORDS,
    keep_columns: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``keep_columns`` (default doc_id), n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed
    (words in removed lines), kept, and clean_text (the text without the
    removed lines).

    Null text has no words and fails the base rule. A null host is a host of
    its own. Repeated rows are documents of their own. Lines without a word
    are neither counted nor removed. Further columns are ignored unless named
    in ``keep_columns``; an empty table gives an empty result.
    """
    keep = keep_columns or ["doc_id"]
    lists = written(frequent_lines(docs, text, host, share, least_docs), "frequent_lines")
    rows = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("own"),
        text_of(text).alias("t"),
        host_key(host).alias("host_key"),
    ).join(lists, "host_key", "left")

    t = F.col("t")
    lines = F.col("lines")
    is_frequent = lambda line: F.array_contains(F.col("frequent"), F.xxhash64(normal_line(line)))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    n_words = lambda line: F.size(word_array(line)).cast("long")
    gone = F.when(
        F.col("frequent").isNotNull(),
        F.aggregate(F.filter(lines, is_frequent), F.lit(0).cast("long"), lambda a, line: a + n_words(line)),
    ).otherwise(F.lit(0).cast("long"))
    clean = F.when(
        F.col("n_removed") > 0,
        F.array_join(F.filter(F.split(t, "\n"), lambda line: ~(has_word(line) & is_frequent(line))), "\n"),
    ).otherwise(t)

    words = F.col("words")
    measured = (
        rows.withColumns({"words": word_array(t), "lines": line_array(t)})
        .select(
            "own", "t", "frequent",
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.when(t.rlike(r"[#*$%&|<>]"), F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", ""))).otherwise(0).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            gone.alias("n_removed"),
        )
    )
    left = F.col("n_words") - F.col("n_removed")
    depleted = (F.col("n_removed") > 0) & ((left < left_words) | (left < left_share * F.col("n_words")))
    return (
        measured.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .select(
            *[F.col(f"own.`{c}`").alias(c) for c in keep],
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept",
            clean.alias("clean_text"),
        )
    )
