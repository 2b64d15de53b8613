"""Mixing sources to target weights by temperature.

A source with a share p of all tokens gets a weight proportional to
p ** exponent. The exponent is found by bisection, so that the mixture meets a
target entropy or keeps every source at or below a limit of repetitions. The
normalised weights become token budgets, and a budget becomes passes over a
fixed pseudo-random permutation of the source's documents: all whole passes,
then the front of one more.

The permutation orders documents by the MD5 of their id, and consecutive keys
form blocks. The document at which the last pass ends is found by two small
steps: prefix sums over the blocks of each source, then over the documents of
the one block in which the budget ends. No source is ever ordered as a whole,
so one that holds a third of all rows costs no more than its share, and texts
are not shuffled: each document only meets its source's row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import text_of, word_array, written

MAX_REPEATS = 1.5
SEED = 17
#: Documents in a block of the permutation, about.
BLOCK_DOCS = 4096
#: Levels of bisection that one pass over the sources decides, and passes.
LEVELS, PASSES = 5, 8


def order_key(doc_id: str, seed: int) -> Column:
    """A document's place in the permutation: 32 hex digits."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(str(seed))))


def source_key(source: str) -> Column:
    """The source as a join key; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def bisect_exponent(sources: DataFrame, max_repeats: float | None, entropy: float | None) -> float:
    """The smallest exponent in [0, 1] whose mixture repeats no source more
    than ``max_repeats`` times as often as the least repeated one, or the
    largest whose entropy (nats) is at least ``entropy``.

    Each pass evaluates the 2**LEVELS - 1 points that LEVELS bisection steps
    could visit; only those few numbers come to the driver.
    """
    lo, hi, points = 0.0, 1.0, 2**LEVELS
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * k / points for k in range(1, points)]
        at = sources.select("share", F.explode(F.array(*[F.lit(x) for x in grid])).alias("e"))
        w = F.pow("share", F.col("e"))
        found = {
            r["e"]: r
            for r in at.groupBy("e")
            .agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("wlogw"), F.max(w / F.col("share")).alias("most"), F.min(w / F.col("share")).alias("least"))
            .collect()
        }
        if not found:
            return 1.0
        for _ in range(LEVELS):
            mid = lo + (hi - lo) / 2
            r = found[mid]
            if max_repeats is not None:
                lo, hi = (lo, mid) if r["most"] / r["least"] <= max_repeats else (mid, hi)
            else:
                lo, hi = (mid, hi) if math.log(r["z"]) - r["wlogw"] / r["z"] >= entropy else (lo, mid)
    return hi if max_repeats is not None else lo


def mixture(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    max_repeats: float | None = MAX_REPEATS,
    entropy: float | None = None,
    budget: int | None = None,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(rows, plan). ``rows``: doc_id, source_key, n_tokens, order_key for each
    row of ``docs``; ``plan``: source_key, n_tokens, weight, budget, passes and
    cutoff for each source. A document is drawn ``passes`` times, and once more
    if its order_key is below the cutoff.

    ``budget`` is the tokens to draw in all; by default the least at which
    every source is read once or more. Exactly one of ``max_repeats`` and
    ``entropy`` is a number.
    """
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give either max_repeats or entropy")
    rows = written(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            source_key(source).alias("source_key"),
            F.size(word_array(text_of(text))).cast("long").alias("n_tokens"),
            order_key(doc_id, seed).alias("order_key"),
        ),
        "mixing_rows",
    )
    tokens = rows.groupBy("source_key").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    tokens = written(tokens, "mixing_tokens")
    total, most = tokens.agg(F.sum("n_tokens"), F.max("n_docs")).first()
    shares = tokens.where("n_tokens > 0").withColumn("share", F.col("n_tokens") / F.lit(float(total or 1)))
    exponent = bisect_exponent(shares, max_repeats, entropy)
    powers = shares.withColumn("power", F.pow("share", F.lit(exponent)))
    z, least = powers.agg(F.sum("power"), F.max(F.col("n_tokens") / F.col("power"))).first()
    z = z or 1.0
    want = float(budget) if budget is not None else (least or 0.0) * z
    # a budget within a millionth of whole passes is whole passes, so that rounding errors read nothing again
    passes = F.col("budget") / F.col("n_tokens")
    weighted = (
        powers.withColumn("weight", F.col("power") / F.lit(z))
        .withColumn("budget", F.col("weight") * F.lit(want))
        .withColumn("passes", F.floor(passes + 1e-6))
        .withColumn("rest", F.greatest(F.lit(0).cast("long"), F.floor(F.col("budget") - F.col("passes") * F.col("n_tokens") + 1e-6)))
        .select("source_key", "n_tokens", "weight", F.floor(F.col("budget") + 1e-6).alias("budget"), "passes", "rest")
    )

    digits = max(1, math.ceil(math.log(max(1, (most or 1) / BLOCK_DOCS), 16)))
    block = F.substring("order_key", 1, digits)
    blocks = rows.groupBy("source_key", block.alias("block")).agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_key").orderBy("block")) - F.col("n")
    last = (
        blocks.withColumn("before", before)
        .join(weighted.select("source_key", "rest"), "source_key")
        .where("rest > before and rest <= before + n")
        .select("source_key", "block", "before", "rest")
    )
    inside = (
        rows.withColumn("block", block)
        .join(written(last, "mixing_last_blocks"), ["source_key", "block"])
        .groupBy("source_key", "block", "before", "rest", "order_key")
        .agg(F.sum("n_tokens").alias("n"))
    )
    through = F.col("before") + F.sum("n").over(Window.partitionBy("source_key", "block").orderBy("order_key"))
    cut = (
        inside.withColumn("through", through).where("through >= rest")
        .groupBy("source_key").agg(F.min("order_key").alias("last_key"))
    )
    plan = written(
        tokens.select("source_key", "n_docs")
        .join(weighted, "source_key", "left")
        .join(cut, "source_key", "left")
        .select(
            "source_key",
            F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
            F.coalesce("weight", F.lit(0.0)).alias("weight"),
            F.coalesce("budget", F.lit(0)).alias("budget"),
            F.coalesce("passes", F.lit(1)).alias("passes"),
            "last_key",
        ),
        "mixing_plan",
    )
    return rows, plan


def copies() -> Column:
    """How often a document is drawn, of a row joined with its source's plan."""
    return (F.col("passes") + F.when(F.col("order_key") <= F.col("last_key"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, source_key, n_tokens, weight,
    budget, order_key and copies.

    Documents without words, and sources without any, have nothing to weigh
    and are drawn once each pass (a source without words: once). A null source
    is a source of its own; a null doc_id has the key of the text "null".
    Repeated rows have one key and are drawn alike. Further columns are
    ignored; an empty table gives an empty result.
    """
    rows, plan = mixture(docs, **options)
    return rows.join(plan.drop("n_tokens"), "source_key").select(
        "doc_id", "source_key", "n_tokens", "weight", "budget", "order_key", copies().alias("copies")
    )


def drawn(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn."""
    _, plan = mixture(docs, doc_id=doc_id, source=source, seed=seed, **options)
    names = docs.columns
    rows = docs.select(F.struct("*").alias("own"), source_key(source).alias("source_key"), order_key(doc_id, seed).alias("order_key"))
    times = rows.join(plan, "source_key").select("own", copies().alias("copies")).where("copies > 0")
    return times.select("own", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"own.`{c}`").alias(c) for c in names])
