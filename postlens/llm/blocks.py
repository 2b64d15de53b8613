"""Documents as blocks of words.

Operators that read the corpus several times turn it into blocks once: some
million words of whole documents, with the block's distinct words and a number
for each word. Blocks are written to the shared folder, compressed, as a table
bucketed by their number: what later steps join to a block comes to it, and
blocks themselves are not shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import text_of, tidy
from postlens.session import scratch_path

#: Words in a block, about; a longer document is a block of its own.
BLOCK_WORDS = 1 << 20
#: Buckets at most (Spark takes 100,000); beyond, a bucket holds several blocks.
MOST_BUCKETS = 50_000
SCHEMA = "block long, doc_ids array<long>, sizes binary, words string, numbers binary"


def squeeze(values: np.ndarray) -> bytes:
    """Integers from 0, compressed: how many bytes the largest takes, then the
    bytes by place, the lowest first."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, :width] = planes.T
    return values.view("<i8").reshape(-1)


def joined(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def parted(data: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return parts


def bucket_count(size: int, block_words: int) -> int:
    """About a bucket for each block of a text of ``size`` bytes: a word takes some six."""
    return min(MOST_BUCKETS, max(1, -(-size // (6 * block_words))))


def word_blocks(docs: DataFrame, doc_id: str, text: str, lower: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The blocks of ``docs``, written: doc_ids, sizes (words of each document),
    words (joined by spaces, the frequent first) and numbers (of each word)."""

    def made(block: int, ids: list, sizes: list[np.ndarray], words: list[pa.Array]) -> pa.RecordBatch:
        coded = pa.chunked_array(words).combine_chunks().dictionary_encode() if words else pa.array([], pa.string()).dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block]),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([squeeze(np.concatenate(sizes))], pa.binary()),
                pa.array([" ".join(coded.dictionary.take(pa.array(order)).to_pylist())]),
                pa.array([squeeze(place[codes])], pa.binary()),
            ],
            ["block", "doc_ids", "sizes", "words", "numbers"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sizes, words, n = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = pc.ascii_lower(part.column(1)) if lower else part.column(1)
                split = pc.ascii_split_whitespace(texts)
                flat = split.flatten()
                real = pc.not_equal(flat, "")
                ends = np.concatenate([[0], np.cumsum(np.asarray(real))])[split.offsets.to_numpy() - split.offsets[0].as_py()]
                ids.extend(part.column(0).to_pylist())
                sizes.append(np.diff(ends))
                words.append(flat.filter(real))
                n += int(ends[-1])
                if n >= block_words:
                    yield made(block, ids, sizes, words)
                    block, ids, sizes, words, n = block + 1, [], [], [], 0
        if ids:
            yield made(block, ids, sizes, words)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = bucket_count(size, block_words)
    spark, name = docs.sparkSession, f"postlens_blocks_{uuid.uuid4().hex}"
    made_rows = rows.mapInArrow(cut, SCHEMA).write.bucketBy(buckets, "block")
    with tidy(spark):
        made_rows.option("path", scratch_path(spark, "word_blocks")).saveAsTable(name)
    return spark.table(name)


class Block:
    """A block's row, opened."""

    def __init__(self, doc_ids: list, sizes: bytes, words: str, numbers: bytes):
        self.doc_ids = doc_ids
        self.ends = np.concatenate([[0], np.cumsum(unsqueeze(sizes))]).astype(np.int64)
        self.words = words.split(" ") if words else []
        self.numbers = unsqueeze(numbers)
