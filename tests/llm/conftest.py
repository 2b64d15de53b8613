from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Columns with names that the operators use inside, of other types and null here and there.
CLASHES = [
    "digest", "content", "salt", "first", "guard", "size", "t", "own", "host_key", "words", "lines", "frequent", "n", "key", "line",
    "pos", "bucket", "u", "v", "m", "node", "component", "signature", "hashes", "band", "block", "shard", "ids", "replies", "anchor",
    "order_key", "source_key", "passes", "copies", "weight", "budget", "share", "kept", "gone_id", "payload", "check", "copy", "hot",
]


def long_text(n: int = 30_000) -> str:
    return "\n".join(" ".join(f"w{(i * 7919 + k) % 9973}x{k % 13}" for k in range(20)) for i in range(n // 20))


@pytest.fixture(scope="session")
def edge_rows():
    base = " ".join(f"word{k}" for k in range(60))
    near = base.replace("word30", "other")
    passage = " ".join(f"shared{k}" for k in range(45))
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", None),
        (3, near, None, "b", 2),
        (4, base.upper(), "en", None, 3),
        (5, "  " + base.replace(" ", "\t") + " ", "en", "a", 4),
        (6, None, "en", "a", 5),
        (7, "", None, None, 6),
        (8, " \t\n\x0b\f\r ", "de", "b", 7),
        (9, "one", "de", "b", 8),
        (10, "one two", "de", "c", 9),
        (11, "one two", "de", "c", 10),
        (12, passage + " " + "tail of its own", "fr", "c", 11),
        (13, "a front of its own " + passage, "fr", "c", 12),
        (14, "x " * 200, "fr", "c", 13),
        (15, "same line here\nsame line here\n\nSame  line here\nother £ ünïcode 漢字 🙂 line", "es", "d", 14),
        (16, "The quick brown fox jumps over the lazy dog near the old river bank today\nsecond line of sixteen", "es", "d", 15),
        (17, "the quick brown fox jumps over the lazy dog near the old river bank today!\nanother line of seventeen", "es", "d", 16),
        (18, long_text(), "en", "a", 17),
        (19, "say <|endoftext|> and <|startoftext|> 'tis it's we'll x #1 *2* $3 & %4 <b>", "en", "a", 18),
        (20, "repeated row", "en", "a", 19),
        (20, "repeated row", "en", "a", 19),
        (None, "no id at all", "en", "a", 20),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows, SCHEMA)
    taken = set(docs.columns)
    return docs.withColumns({c: F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")) for c in CLASHES if c not in taken})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge_pairs(edge_rows):
    return [(r[0], r[1]) for r in edge_rows]


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest supplied documents: a frame, and (doc_id, text) pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
