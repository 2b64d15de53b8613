"""Repeated passages by FM-indexes.

A window is ``width`` consecutive words of a document. Every word is removed
that lies in a window whose words start anywhere else too.

Equal windows must meet in one shard, so a window is dealt by its anchor, the
least hash of the runs of ``GRAM`` words in it: equal windows have equal
anchors, and neighbouring windows mostly share theirs, so they travel together
as one segment. Only segments whose anchor occurs again at all are dealt. Each
block of documents sends a segment once, with its count, however often it has
it. An anchor of very many segments, from a passage that a large part of all
documents hold, is not one shard's: its windows are dealt one by one, by their
own hash.

A shard joins its distinct segments to one text and builds an FM-index of it:
suffix array, Burrows-Wheeler transform, and a wavelet matrix in packed bits.
The segments are streamed through it from the right; backward search gives the
longest match that occurs twice (the matching statistic of that place), and
matches of ``width`` words or more are reported as intervals. A segment that
several places hold is repeated as a whole and needs no search. The intervals
go back to the blocks that sent the segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.blocks import Block, joined, parted, squeeze, unsqueeze, word_blocks
from postlens.llm.common import written

WIDTH, GRAM = 35, 10
#: Windows in a segment, at most.
SEGMENT = 256
#: Words that a shard's text has, about.
SHARD_WORDS = 1 << 20
#: An anchor of more segments is dealt by window.
HOT = 5000


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _hashes(block: Block) -> np.ndarray:
    """The words' hashes in a row."""
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in block.words), np.uint64, len(block.words))
    return each[block.numbers]


def _grams(stream: np.ndarray, gram: int) -> np.ndarray:
    """The hash of each run of ``gram`` words."""
    grams = np.full(max(0, len(stream) - gram + 1), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(gram):
        grams = _mixed(grams, stream[k : len(grams) + k])
    return grams


def _windows(grams: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows' starts, and their anchors."""
    n = int(ends[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, span = grams, 1
    want = width - gram + 1
    while span < want:
        step = min(span, want - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    last = np.repeat(ends[1:], np.diff(ends))[:n]  # the end of each start's document
    starts = np.flatnonzero(np.arange(n) + width <= last)
    return starts, least[starts]


def _runs(starts: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Where each run of neighbouring windows of one anchor begins."""
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (anchors[1:] != anchors[:-1])
    return np.flatnonzero(new)


def _places(grams: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors, and in how many places of its runs each stands
    (a place that two runs share counts for both)."""
    starts, anchors = _windows(grams, ends, width, gram)
    run = _runs(starts, anchors)
    if not len(run):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values, rank = np.unique(grams, return_inverse=True)
    keys = np.sort(rank * len(grams) + np.arange(len(grams)))
    own = np.searchsorted(values, anchors[run]) * len(grams)
    final = starts[np.append(run[1:], len(starts)) - 1] + width - gram
    n = np.searchsorted(keys, own + final, "right") - np.searchsorted(keys, own + starts[run])
    each, of = np.unique(anchors[run], return_inverse=True)
    return each, np.bincount(of, n).astype(np.int64)


def _segments(stream: np.ndarray, ends: np.ndarray, width: int, gram: int, wanted: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, key) of the segments whose anchors are wanted (sorted), or hot (sorted)."""
    starts, anchors = _windows(_grams(stream, gram), ends, width, gram)

    def among(some: np.ndarray) -> np.ndarray:
        at = np.searchsorted(some, anchors)
        return some[np.minimum(at, len(some) - 1)] == anchors if len(some) else np.zeros(len(anchors), bool)

    is_hot = among(hot)
    single = starts[is_hot]
    keys = np.full(len(single), 0xA0761D6478BD642F, np.uint64)
    for k in range(width):
        keys = _mixed(keys, stream[single + k])
    found = among(wanted) & ~is_hot
    starts, anchors = starts[found], anchors[found]
    run = _runs(starts, anchors)
    place = np.arange(len(starts)) - np.repeat(run, np.diff(np.append(run, len(starts))))
    first = np.flatnonzero(place % SEGMENT == 0)
    last = np.append(first[1:], len(starts))[: len(first)] - 1
    return np.concatenate([starts[first], single]), np.concatenate([starts[last], single]) + width, np.concatenate([anchors[first], keys])


def _distinct(stream: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], shards: int) -> dict[int, dict[bytes, list[int]]]:
    """For each shard the distinct segments, by their hashes, with their starts."""
    out: dict[int, dict[bytes, list[int]]] = {}
    for a, b, shard in zip(found[0].tolist(), found[1].tolist(), (found[2] % np.uint64(shards)).tolist()):
        out.setdefault(shard, {}).setdefault(stream[a:b].tobytes(), []).append(a)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the text's suffixes must differ by some symbol."""
    n = len(text)
    rank = np.append(np.unique(text, return_inverse=True)[1] + 1, 0).astype(np.int64)
    reach = 1
    while True:
        after = np.append(rank[reach:], np.zeros(min(reach, n + 1), np.int64))[: n + 1]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
        if rank[order[-1]] == n:
            return order[1:]  # without the empty suffix
        reach *= 2


class WaveletMatrix:
    """Ranks of symbols in packed bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            words = np.zeros(len(ones) // 64 + 1, np.uint64)
            packed = np.packbits(ones, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.int32)
            self.levels.append((level, words, before, len(ones) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        # where each symbol's places begin below the last level
        self.begin = self.down(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, before, zeros in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self.down(symbols, at) - self.begin[symbols]


class FmIndex:
    """Of segments: symbols from 1, each segment closed by 0."""

    def __init__(self, text: np.ndarray):
        breaks = text == 0
        self.size = len(text)
        order = suffix_array(np.where(breaks, np.cumsum(breaks) - 1, text.astype(np.int64) + int(breaks.sum())))
        self.wavelet = WaveletMatrix(text[order - 1], max(1, int(text.max()).bit_length()))
        counts = np.bincount(text)
        self.before = np.cumsum(counts) - counts

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start with a symbol and then as those from low to high."""
        ranks = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return self.before[symbols] + ranks[: len(low)], self.before[symbols] + ranks[len(low) :]


def repeated_intervals(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of the stretches, in the segments from ``begins``
    to ``ends`` of ``text``, whose windows all occur twice or more in it."""
    index = FmIndex(text)
    which = np.flatnonzero(ends - begins >= width)
    start, end = begins[which], ends[which].copy()
    length, low, high = (np.zeros(len(which), np.int64) for _ in range(3))
    high[:] = index.size
    out = []
    while len(which):
        at = end - length - 1
        open_ = at >= start
        new_low, new_high = index.extend(text[np.maximum(at, 0)], low, high)
        goes = open_ & (new_high - new_low >= 2)
        length = np.where(goes, length + 1, length)
        low, high = np.where(goes, new_low, low), np.where(goes, new_high, high)
        stop = np.flatnonzero(~goes)
        if not len(stop):
            continue
        long = length[stop] >= width
        hit = stop[long]
        out.append((which[hit], end[hit] - length[hit] - start[hit], end[hit] - start[hit]))
        # a match goes on one word further left, so that its first undecided window is the next; else the place before
        end[stop] = np.where(long, end[stop] - length[stop] - 1 + width, end[stop] - 1)
        end[stop[~open_[stop]]] = 0  # reached the segment's start: all is decided
        length[stop], low[stop], high[stop] = 0, 0, index.size
        live = end - start >= width
        if not live.all():
            which, start, end, length, low, high = (x[live] for x in (which, start, end, length, low, high))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ([], [], [])))


def _sent(segments: dict[bytes, list[int]]) -> bytes:
    """A block's segments for a shard, compressed: sizes, counts, words by number, and the numbers' hashes."""
    words, numbers = np.unique(np.frombuffer(b"".join(segments), np.uint64), return_inverse=True)
    sizes, counts = [len(s) // 8 for s in segments], [min(len(x), 2) for x in segments.values()]
    return joined([squeeze(np.array(sizes)), squeeze(np.array(counts)), squeeze(numbers), zstandard.ZstdCompressor(level=1).compress(words.tobytes())])


def _received(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, counts, and the words' hashes in a row."""
    parts = parted(data)
    words = np.frombuffer(zstandard.ZstdDecompressor().decompress(parts[3]), np.uint64)
    return unsqueeze(parts[0]), unsqueeze(parts[1]), words[unsqueeze(parts[2])]


def search_shard(sent: list[bytes], width: int) -> list[bytes]:
    """For each block's segments the repeated stretches: (segment, start, end) as 32-bit integers."""
    opened = [_received(x) for x in sent]
    number: dict[bytes, int] = {}
    weights: list[int] = []
    names: list[list[int]] = []
    for sizes, counts, stream in opened:
        own, at = [], 0
        for size, count in zip(sizes.tolist(), counts.tolist()):
            k = number.setdefault(stream[at : at + size].tobytes(), len(number))
            if k == len(weights):
                weights.append(0)
            weights[k] += count
            own.append(k)
            at += size
        names.append(own)
    sizes = np.array([len(s) // 8 for s in number], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = np.unique(np.frombuffer(b"".join(number), np.uint64), return_inverse=True)[1] + 1
    shared = np.array(weights) > 1
    alone = np.flatnonzero(~shared)
    found: dict[int, list[tuple[int, int]]] = {int(k): [(0, int(sizes[k]))] for k in np.flatnonzero(shared)}
    for k, a, b in zip(*(x.tolist() for x in repeated_intervals(text, (ends - sizes)[alone], ends[alone], width))) if len(alone) else ():
        found.setdefault(int(alone[k]), []).append((a, b))
    return [np.array([(i, a, b) for i, k in enumerate(own) for a, b in found.get(k, ())], "<u4").tobytes() for own in names]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot: int = HOT, block_words: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (the
    kept words, joined by one space).

    Words are runs without white space, unchanged, and are compared by 64-bit
    hash. Null, empty and blank texts have no words. Repeated rows are places
    of their own, so each removes the other's windows. A null doc_id is kept as
    such. Further columns are ignored; an empty table gives an empty result.
    """
    blocks = word_blocks(docs, doc_id, text, **({"block_words": block_words} if block_words else {}))

    def opened(batch: pa.RecordBatch, i: int) -> Block:
        return Block(*(batch.column(k)[i].as_py() for k in ("doc_ids", "sizes", "words", "numbers")))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = opened(batch, i)
                each, n = _places(_grams(_hashes(block), gram), block.ends, width, gram)
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(np.full(len(each), batch.column("block")[i].as_py())), pa.array(n)], ["anchor", "block", "n"])

    seen = written(blocks.mapInArrow(anchors, "anchor long, block long, n long"), "anchors")
    again = seen.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor", (F.col("total") > hot).alias("hot"))
    of_block = seen.join(written(again, "repeated_anchors"), "anchor").groupBy("block").agg(
        F.collect_list(F.when(~F.col("hot"), F.col("anchor"))).alias("wanted"),
        F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"),
        F.sum("n").alias("n"),
    )
    of_block = written(of_block, "anchors_of_blocks")
    total = of_block.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total * (width + gram) // shard_words))
    with_anchors = blocks.join(of_block.drop("n"), "block", "left")

    def segments(batch: pa.RecordBatch, i: int) -> tuple[Block, np.ndarray, dict[int, dict[bytes, list[int]]]]:
        block = opened(batch, i)
        stream = _hashes(block)
        lists = [np.sort(np.array(batch.column(k)[i].as_py() or [], np.int64).view(np.uint64)) for k in ("wanted", "hot")]
        return block, stream, _distinct(stream, _segments(stream, block.ends, width, gram, *lists), shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, found = segments(batch, i)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(found)), pa.array([batch.column("block")[i].as_py()] * len(found)), pa.array([_sent(s) for s in found.values()], pa.binary())], ["shard", "block", "sent"]
                    )

    def search(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": group.block, "shard": group.shard, "found": search_shard(group.sent.tolist(), width)})

    dealt = with_anchors.where(F.col("wanted").isNotNull()).mapInArrow(deal, "shard long, block long, sent binary")
    found = dealt.groupBy("shard").applyInPandas(search, "block long, shard long, found binary")
    answers = written(found.where(F.length("found") > 0).groupBy("block").agg(F.collect_list(F.struct("shard", "found")).alias("answers")), "repeats_of_blocks")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, stream, dealt = segments(batch, i)
                edges = np.zeros(len(stream) + 1, np.int64)
                for answer in batch.column("answers")[i].as_py() or []:
                    places = list(dealt[answer["shard"]].values())
                    for k, a, b in np.frombuffer(answer["found"], "<u4").reshape(-1, 3).tolist():
                        for at in places[k]:
                            edges[at + a] += 1
                            edges[at + b] -= 1
                stays = np.cumsum(edges[:-1]) == 0
                words = np.array(block.words, object)
                sizes = np.diff(block.ends)
                removed = np.diff(np.concatenate([[0], np.cumsum(~stays)])[block.ends])
                texts = [" ".join(words[block.numbers[a:b][stays[a:b]]].tolist()) for a, b in zip(block.ends[:-1], block.ends[1:])]
                for first in range(0, len(texts), 1000):
                    part = slice(first, first + 1000)
                    yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids[part], pa.int64()), pa.array(sizes[part]), pa.array(removed[part]), pa.array(texts[part], pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return with_anchors.join(answers, "block", "left").mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_text string")
