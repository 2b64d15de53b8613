"""Scoring by an n-gram language model in Elias-Fano tries.

The model is interpolated with a Dirichlet prior at every order:

    p(w | h) = (c(h w) + prior * p(w | h')) / (c(h) + prior)

where h' is h without its first word, and p(w) adds 0.1 to every count. A
text's first words have shorter contexts, and contexts do not cross texts.

The corpus becomes blocks of words once. Each order is one round: every block
sends its distinct n-grams, with what it knows from the round before (the
count of the context, the probability by the lower order), to shards by the
hash of the whole n-gram; a shard sums the counts, stores the smoothed
probabilities of the n-grams seen in training in a trie, and answers each
block by searching it. So an n-gram comes once from each block, however
frequent it is, no context is one shard's, and no step holds the model whole.

A shard's trie has a level for each word of the n-gram. A level holds, in
Elias-Fano code, the word numbers of all contexts in one rising sequence (each
context's numbers begin where the one before ended) and the pointers to the
next level; the last level has the probabilities in 8 bits, evenly spaced in
the logarithm. A trie is a file, mapped into memory, and is searched for a
word by the successor of its number in the range of its context.
"""

from __future__ import annotations

import mmap
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.blocks import Block, joined, parted, squeeze, unsqueeze, word_blocks
from postlens.llm.common import text_of, written

#: The prior of each order from 2.
PRIORS = (1000.0, 20.0)
#: Texts whose crc32 of the id has this remainder are held out.
FOLDS, HELD_OUT = 10, 0
#: N-grams and words that a shard gets, about, and words in a block.
SHARD_NGRAMS, SHARD_WORDS, BLOCK_WORDS = 1 << 20, 1 << 20, 3 << 19
#: N-grams that a trie is searched for at a time.
FIND = 1 << 16
CODES = 255
END = 0


class Bits:
    """A bit vector with a directory for selection: the ones before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32)
        self.zeros = np.arange(len(self.ones), dtype=np.int32) * 64 - self.ones

    @staticmethod
    def packed(places: np.ndarray, size: int) -> np.ndarray:
        bits = np.zeros(-(-max(size, 1) // 64) * 64, bool)
        bits[places] = True
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th one or zero, from 0."""
        before = self.ones if one else self.zeros
        word = np.searchsorted(before, k.astype(np.int32), "right") - 1
        rest = (k - before[word]).astype(np.uint8)
        bits, place = (self.words[word] if one else ~self.words[word]), np.zeros(len(k), np.uint8)
        for width in (32, 16, 8, 4, 2, 1):  # the bit within its word, by halves
            low = np.bitwise_count(bits & np.uint64((1 << width) - 1))
            on = low <= rest
            rest -= low * on
            place += on * np.uint8(width)
            bits >>= on * np.uint64(width)
        return word * 64 + place


class EliasFano:
    """A sequence that does not fall: low bits packed, high bits unary."""

    def __init__(self, parts: list[np.ndarray]):
        (self.n, self.width), self.low, high = parts[0].view(np.int64).tolist(), parts[1], parts[2]
        self.high = Bits(high)
        self.last = int(self[np.array([self.n - 1])][0]) if self.n else -1

    @staticmethod
    def build(values: np.ndarray) -> list[np.ndarray]:
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        # a byte for each low bit, never a number
        low = np.unpackbits(values.astype("<i8").view(np.uint8).reshape(n, 8), axis=1, count=width, bitorder="little") if width else np.zeros(0, np.uint8)
        packed = np.packbits(low.reshape(-1), bitorder="little")
        del low
        words = np.zeros(len(packed) // 8 + 2, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        return [np.array([n, width], np.int64).view(np.uint64), words, Bits.packed((values >> width) + np.arange(n), n + (top >> width) + 2)]

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.int64)
        bit = at * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        both = self.low[word] >> shift
        # the next word's bits; shifted twice, because a shift by 64 does nothing
        both |= (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return (both & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ((self.high.select(at, True) - at) << self.width) | self.lows(at)

    def successor(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place from low whose number is ``value`` or more, high if
        there is none, and whether it is ``value``, which is at most the last number."""
        bucket = value >> self.width
        first = np.where(bucket > 0, self.high.select(np.maximum(bucket - 1, 0), False) - bucket + 1, 0)
        last = self.high.select(bucket, False) - bucket
        a, end = np.clip(first, low, high), np.clip(last, low, high)
        b, want = end.copy(), value & ((1 << self.width) - 1)
        while True:  # by halves among the numbers of one bucket
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a, (a < end) & (self.lows(np.minimum(a, self.n - 1)) == want)
            middle = (a[open_] + b[open_]) >> 1
            less = self.lows(middle) < want[open_]
            a[open_[less]], b[open_[~less]] = middle[less] + 1, middle[~less]


class Trie:
    """N-grams and codes, from the parts that ``build`` made."""

    def __init__(self, parts: list[np.ndarray], order: int):
        self.codes = parts[-1].view(np.uint8)
        self.words = [EliasFano(parts[3 * k : 3 * k + 3]) for k in range(order)]
        self.pointers = [EliasFano(parts[3 * k : 3 * k + 3]) for k in range(order, 2 * order - 1)]

    @staticmethod
    def build(columns: list[np.ndarray], codes: np.ndarray) -> list[np.ndarray]:
        """``columns`` hold the n-grams' words, in lexicographic order, without repeats; one or more."""
        order, n = len(columns), len(codes)
        new = np.zeros(n, bool)
        new[0] = True
        words, pointers, parents = [], [], np.zeros(1, np.int64)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
            nodes = np.flatnonzero(new)
            starts = np.searchsorted(nodes, parents)
            own = column[nodes]
            ends = np.append(starts[1:], len(nodes))
            # each context's numbers go on from the last of the one before
            base = np.concatenate([[0], np.cumsum(own[ends - 1])[:-1]])
            words += EliasFano.build(own + np.repeat(base, ends - starts))
            if len(parents) > 1 or pointers or column is not columns[0]:
                pointers += EliasFano.build(np.append(starts, len(nodes)))
            parents = nodes
        padded = np.zeros(-(-n // 8) * 8, np.uint8)
        padded[:n] = codes
        return [*words, *pointers, padded.view(np.uint64)]

    def find(self, columns: list[np.ndarray]) -> np.ndarray:
        """Each n-gram's place among the codes, or -1. N-grams of one context
        that follow each other look it up once."""
        n = len(columns[0])
        place, alive, at = np.full(n, -1, np.int64), np.arange(n), np.zeros(n, np.int64)
        for k, words in enumerate(self.words):
            numbers = columns[k][alive]
            # one search for neighbours that are alike so far
            run = np.ones(len(at), bool)
            run[1:] = at[1:] != at[:-1]
            context = at[run]
            low, high, base = np.zeros(len(context), np.int64), np.full(len(context), words.n, np.int64), np.zeros(len(context), np.int64)
            if k:
                low, high = self.pointers[k - 1][context], self.pointers[k - 1][context + 1]
                base = np.where(low > 0, words[np.maximum(low - 1, 0)], 0)
            of = np.cumsum(run) - 1
            run[1:] |= numbers[1:] != numbers[:-1]
            of_run = of[run]
            value = numbers[run] + base[of_run]
            inside = value <= words.last
            reached, found = words.successor(low[of_run], high[of_run], np.where(inside, value, 0))
            reached = np.where(found & inside, reached, -1)[np.cumsum(run) - 1]
            alive, at = alive[reached >= 0], reached[reached >= 0]
        place[alive] = at
        return place


class TrieFile:
    """A trie's parts in a file without a name, mapped into memory."""

    def __init__(self, parts: list[np.ndarray], order: int):
        with tempfile.TemporaryFile() as f:
            for part in parts:
                f.write(part.tobytes())
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        whole, bounds = np.frombuffer(self.map, np.uint64), np.cumsum([0] + [len(p) for p in parts])
        self.trie = Trie([whole[a:b] for a, b in zip(bounds[:-1], bounds[1:])], order)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct key, the keys rising; each key's number among them."""
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits <= 63:
        # the place in the key's lower bits: numbers are sorted faster than places by them
        ordered = keys << bits
        ordered |= np.arange(len(keys))
        ordered.sort()
        order = ordered & ((1 << bits) - 1)
        ordered >>= bits
    else:
        order = np.argsort(keys)
        ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    each = np.empty(len(keys), np.int64)
    each[order] = np.cumsum(new) - 1
    return order[new], each


def _distinct_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As ``_distinct``, of the columns' rows in lexicographic order. As many columns as a number holds are sorted at once."""
    keys, place = columns[0], len(columns[0]).bit_length()
    width = int(keys.max(initial=0)).bit_length()
    for column in columns[1:]:
        own = int(column.max(initial=0)).bit_length()
        if width + own + place > 63:
            keys, width = _distinct(keys)[1], place
        keys = keys << own | column
        width += own
    return _distinct(keys)


class _ByShard:
    """What goes to each shard, from one sort, however many shards there are."""

    def __init__(self, which: np.ndarray, shards: int):
        which = which.astype(np.min_scalar_type(max(shards - 1, 0)))
        self.order = np.argsort(which, kind="stable")
        self.shards, self.starts = np.unique(which[self.order], return_index=True)
        self.ends = np.append(self.starts[1:], len(which))

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each shard that gets something, and the places that go to it."""
        for shard, a, b in zip(self.shards.tolist(), self.starts.tolist(), self.ends.tolist()):
            yield shard, self.order[a:b]

    def __getitem__(self, shard: int) -> np.ndarray:
        at = int(np.searchsorted(self.shards, shard))
        return self.order[self.starts[at] : self.ends[at]]


def _held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


class _Tokens:
    """A block's tokens: word numbers from 1 in the block, END after each text."""

    def __init__(self, block: Block):
        bounds = block.ends
        self.tokens = np.insert(block.numbers + 1, bounds[1:], END) if len(bounds) > 1 else np.zeros(0, np.int64)
        self.ends = bounds[1:] + np.arange(1, len(bounds))
        sizes = np.diff(np.concatenate([[0], self.ends]))
        self.held_out = np.array([_held_out(d) for d in block.doc_ids], bool)
        self.training = np.repeat(~self.held_out, sizes)
        self.place = np.arange(len(self.tokens)) - np.repeat(self.ends - sizes, sizes)


class _Grams:
    """A block's distinct n-grams of one order.

    ``before`` is the order below: its numbers stand for contexts. ``of`` gives
    the n-gram (or -1) that ends at each token, ``rows`` where each n-gram ends first.
    """

    def __init__(self, tokens: _Tokens, order: int, before: "_Grams | None"):
        n = len(tokens.tokens)
        if before is None:
            self.of = tokens.tokens
            self.counts = np.bincount(self.of, tokens.training, int(self.of.max(initial=0)) + 1).astype(np.int64)
            return
        at = np.flatnonzero(tokens.place >= order - 1)
        keys = before.of[at - 1] * (int(tokens.tokens.max(initial=0)) + 1) + tokens.tokens[at]
        first, each = _distinct(keys)
        self.of = np.full(n, -1, np.int64)
        self.of[at] = each
        self.rows = at[first]
        self.counts = np.bincount(each, tokens.training[at], len(first)).astype(np.int64)


class _Known:
    """What a block knows after the rounds so far."""

    def __init__(self, row: dict, order: int, n: int, distinct: int, texts: int, step: float, priors: tuple):
        self.tokens = _Tokens(block := Block(row["doc_ids"], row["sizes"], row["words"], row["numbers"]))
        self.block, self.step, self.priors = block, step, priors
        # round 1: each word's count and number
        self.numbers, count = np.zeros(len(block.words) + 1, np.int64), np.zeros(len(block.words) + 1, np.int64)
        count[END] = texts
        by_shard = _ByShard(_shards_of(block.words, row["word_shards"]), row["word_shards"])
        for shard, reply in self._replies(row, 1):
            counts, numbers = map(unsqueeze, parted(reply))
            mine = by_shard[shard] + 1
            count[mine], self.numbers[mine] = counts, numbers
        self.base = np.log10((count + 0.1) / (n + 0.1 * (distinct + 1)))
        self.count, self.grams, self.logs, self.codes = count, [_Grams(self.tokens, 1, None)], [self.base], [None]
        self.order = order
        counts = count
        for k in range(2, order + 1):
            grams, contexts, lower = self.order_of(k, counts)
            counts, codes = np.zeros(len(grams.rows), np.int64), np.zeros(len(grams.rows), np.int64)
            by_shard = _ByShard(self.shards_of(self.columns(grams, k), row["gram_shards"]), row["gram_shards"])
            for shard, reply in self._replies(row, k):
                mine = by_shard[shard]
                found = parted(reply)
                codes[mine] = unsqueeze(found[0])
                counts[mine] = unsqueeze(found[1])
            prior = priors[k - 2]
            unseen = lower + np.log10(prior / (contexts + prior))
            self.logs.append(np.where(codes > 0, -(codes - 1) * step, unseen))
            self.codes.append(codes)
            self.grams.append(grams)
        self.counts = counts

    def _replies(self, row: dict, k: int) -> list[tuple[int, bytes]]:
        return [(x["shard"], x["reply"]) for x in row["replies"] or [] if x["round"] == k]

    def order_of(self, k: int, counts: np.ndarray) -> tuple[_Grams, np.ndarray, np.ndarray]:
        """The n-grams of order k; their contexts' counts; their lower orders' logarithms."""
        grams = _Grams(self.tokens, k, self.grams[k - 2])
        return grams, counts[self.grams[k - 2].of[grams.rows - 1]], self.logs[k - 2][self.grams[k - 2].of[grams.rows]]

    def columns(self, grams: _Grams, k: int) -> list[np.ndarray]:
        return [self.numbers[self.tokens.tokens[grams.rows - j]] for j in range(k - 1, -1, -1)]

    @staticmethod
    def shards_of(columns: list[np.ndarray], shards: int) -> np.ndarray:
        h = np.full(len(columns[0]), len(columns), np.uint64)
        for column in columns:
            h = (h ^ column.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return (h % np.uint64(shards)).astype(np.int64)

    def ask(self, k: int, shards: int) -> Iterator[tuple[int, bytes]]:
        """(shard, what it is asked) for the n-grams of order k."""
        grams, contexts, lower = self.order_of(k, self.counts if k > 2 else self.count)
        columns = self.columns(grams, k)
        by_shard = _ByShard(self.shards_of(columns, shards), shards)
        # the lower order's probability in the codes' steps, sixteen to a step
        fine = np.minimum(np.round(-lower / self.step * 16), CODES * 16).astype(np.int64)
        for shard, mine in by_shard:
            yield shard, joined([squeeze(x[mine]) for x in (*columns, grams.counts, contexts, fine)])

    def scores(self) -> list[np.ndarray]:
        """doc_id's rows: held_out, n_tokens, n_known, base_score, score."""
        of, place = self.grams[0].of, self.tokens.place
        best = self.base[of]
        for k in range(2, self.order + 1):
            grams = self.grams[k - 1]
            at = place >= k - 1
            best = np.where(at, self.logs[k - 1][np.maximum(grams.of, 0)] if len(grams.rows) else 0.0, best)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], self.tokens.ends])])
        by_text = lambda x: np.add.reduceat(x, np.concatenate([[0], self.tokens.ends[:-1]])) if len(x) else x
        return [self.tokens.held_out, total(np.ones(len(of), np.int64)), total(self.count[of] > 0), by_text(self.base[of]), by_text(best)]


def _shards_of(words: list[str], shards: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(shards)).astype(np.int64)


def _ask_words(block: Block, shards: int) -> Iterator[tuple[int, bytes]]:
    tokens = _Tokens(block)
    counts = np.bincount(tokens.tokens, tokens.training, len(block.words) + 1).astype(np.int64)[1:]
    words = np.array(block.words, object)
    for shard, mine in _ByShard(_shards_of(block.words, shards), shards):
        yield shard, joined([zstandard.ZstdCompressor(level=3).compress(" ".join(words[mine].tolist()).encode()), squeeze(counts[mine])])


def _answer_words(shard: int, shards: int, asked: list[bytes]) -> tuple[list[bytes], int, int]:
    """For each block its words' counts and numbers; the count of all, and how many words have any."""
    opened = [parted(x) for x in asked]
    words = [pc.split_pattern(pa.array([zstandard.ZstdDecompressor().decompress(p[0])], pa.binary()).cast(pa.string()), " ").flatten() for p in opened]
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy()
    counts = np.bincount(codes, np.concatenate([unsqueeze(p[1]) for p in opened]), len(coded.dictionary)).astype(np.int64)
    numbers = np.empty(len(counts), np.int64)
    # frequent words get small numbers; words of equal counts, by their text, so that a repeated task answers alike
    by_text = pc.sort_indices(coded.dictionary).to_numpy()
    order = by_text[np.argsort(-counts[by_text], kind="stable")]
    numbers[order] = 1 + shard + shards * np.arange(len(counts))
    replies, at = [], 0
    for w in words:
        own = codes[at : at + len(w)]
        at += len(w)
        replies.append(joined([squeeze(counts[own]), squeeze(numbers[own])]))
    return replies, int(counts.sum()), int((counts > 0).sum())


def _answer_grams(asked: list[bytes], order: int, prior: float, step: float, with_counts: bool) -> tuple[list[bytes], bytes]:
    """For each block its n-grams' codes and counts; the shard's trie."""
    opened = [parted(x) for x in asked]
    # one column of all blocks is opened after the other
    first = [unsqueeze(p[0]) for p in opened]
    sizes = [len(x) for x in first]
    columns = [np.concatenate(first), *(np.concatenate([unsqueeze(p[i]) for p in opened]) for i in range(1, order + 3))]
    del opened, first
    words, (counts, contexts, fine) = columns[:order], columns[order:]
    del columns
    distinct, of = _distinct_rows(words)
    total = np.bincount(of, counts, len(distinct)).astype(np.int64)
    p = (total + prior * 10.0 ** (-fine[distinct] * step / 16)) / (contexts[distinct] + prior)
    codes = 1 + np.clip(np.round(-np.log10(p) / step), 0, CODES - 1).astype(np.int64)
    del counts, contexts, fine, p
    seen = total > 0
    found = np.zeros(len(distinct), np.int64)
    parts: list[np.ndarray] = []
    if seen.any():
        parts = Trie.build([w[distinct[seen]] for w in words], codes[seen])
        trie = TrieFile(parts, order).trie
        for at in range(0, len(distinct), FIND):
            some = distinct[at : at + FIND]
            place = trie.find([w[some] for w in words])
            found[at : at + FIND] = np.where(place >= 0, trie.codes[np.maximum(place, 0)], 0)
    replies, at = [], 0
    for n in sizes:
        own = of[at : at + n]
        at += n
        replies.append(joined([squeeze(found[own]), squeeze(total[own] if with_counts else np.zeros(n, np.int64))]))
    return replies, joined([x.tobytes() for x in parts])


REPLY = "block long, round int, shard int, reply binary"


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", priors: tuple = PRIORS, shard_ngrams: int = SHARD_NGRAMS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, model_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10 probabilities of the whole text).

    Tokens are the words of the text, A-Z in lower case, and an end. Texts
    whose crc32 of the id, as text, is 0 modulo 10 are held out, the model
    learns from all others. ``priors`` gives the prior of each order from 2, so
    its length is the order less one. With ``model_path`` the tries are written
    there (order, shard, trie).

    Null and empty texts have the end only. A null doc_id counts as an empty
    text for the remainder, and is held out. Repeated rows are texts of their
    own. Further columns are ignored; an empty table gives an empty result.
    """
    order = 1 + len(priors)
    blocks = word_blocks(docs, doc_id, text, lower=True, block_words=block_words)
    ids = F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit(""))
    texts = docs.where(F.crc32(ids) % FOLDS != HELD_OUT).count()
    size = docs.agg(F.sum(F.octet_length(text_of(text)).cast("long"))).first()[0] or 0
    # a word takes some six bytes of text, and about every fifth is new to its block
    word_shards = max(1, -(-size // (30 * shard_words)))
    gram_shards = max(1, -(-size // (8 * shard_ngrams)))
    names = ["doc_ids", "sizes", "words", "numbers"]

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = list(_ask_words(Block(*(row[k] for k in names)), word_shards))
                if asked:
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(asked)), pa.array([s for s, _ in asked], pa.int32()), pa.array([x for _, x in asked], pa.binary())], ["block", "shard", "asked"])

    def answer_words(group: pd.DataFrame) -> pd.DataFrame:
        replies, total, distinct = _answer_words(int(group.shard.iat[0]), word_shards, group.asked.tolist())
        sums = np.zeros((2, len(group)), np.int64)
        sums[:, 0] = total, distinct
        return pd.DataFrame({"block": group.block, "round": 1, "shard": group.shard, "reply": replies, "total": sums[0], "distinct": sums[1]})

    asked = blocks.mapInArrow(ask_words, "block long, shard int, asked binary")
    answered = written(asked.groupBy("shard").applyInPandas(answer_words, REPLY + ", total long, distinct long"), "word_replies")
    n, distinct = answered.agg(F.sum("total"), F.sum("distinct")).first()
    n, distinct = (n or 0) + texts, (distinct or 0) + (texts > 0)
    step = (np.log10(n + 10.0) + 3) / (CODES - 1)
    replies = answered.select("block", "round", "shard", "reply")

    def known(row: dict, upto: int) -> _Known:
        row |= {"word_shards": word_shards, "gram_shards": gram_shards}
        return _Known(row, upto, n, distinct, texts, step, priors)

    def with_replies() -> DataFrame:
        """Each block with all its replies so far: as many as there are shards, and together as large as the block."""
        return blocks.join(replies.groupBy("block").agg(F.collect_list(F.struct("round", "shard", "reply")).alias("replies")), "block", "left")

    def ask(k: int):
        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    for shard, x in known(row, k - 1).ask(k, gram_shards):
                        yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([shard], pa.int32()), pa.array([x], pa.binary())], ["block", "shard", "asked"])

        return asked

    def answer(k: int):
        def answered(group: pd.DataFrame) -> pd.DataFrame:
            found, trie = _answer_grams(group.asked.tolist(), k, priors[k - 2], step, k < order)
            out = pd.DataFrame({"block": group.block, "round": k, "shard": group.shard, "reply": found})
            return out if model_path is None else pd.concat([out, pd.DataFrame({"block": [-1], "round": [k], "shard": [group.shard.iat[0]], "reply": [trie]})])

        return answered

    for k in range(2, order + 1):
        asked = with_replies().mapInArrow(ask(k), "block long, shard int, asked binary")
        found = written(asked.groupBy("shard").applyInPandas(answer(k), REPLY), f"replies_{k}")
        if model_path is not None:
            found.where("block = -1").select(F.col("round").alias("order"), "shard", F.col("reply").alias("trie")).write.mode("append").parquet(model_path)
        replies = replies.union(found.where("block <> -1"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = known(row, order).scores()
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), *map(pa.array, found)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    rows = with_replies().mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
