"""Packing documents into sequences by lexical retrieval.

Rows are tokenised where they are read, and written. Documents are dealt by
content to shards of about ``SHARD_BYTES`` of text, so that related ones meet
wherever they stand in the corpus: a document's key is its nearest of a few
centroids (projected term weights, learnt from a sample) and, within that, its
heaviest term, weighted by the corpus's document frequencies. Keys lie in a row
by the tokens they hold, and the row is cut into shards. A key that fits into a
shard stays together; in a larger one's stretch, a document's place is drawn
from its row's number, so a key, however frequent, is spread over the shards it
fills. A neighbour of another key is found only if its key falls into the same
shard: the search is approximate.

A document's whole windows are sequences of their own; what is left of it waits
in its shard. A shard holds a BM25 inverted index over the whole texts of its
documents, the terms being token ids, with the corpus's idf and mean length.
The next unused document is the seed of a window, and its best unused
neighbours in the shard fill the window greedily; the neighbour that reaches
the window's end is cut there, and its rest is the next seed. So only a shard's
last sequence can have room left.
"""

from __future__ import annotations

import contextlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from postlens.llm.common import text_of, worker_cache, worker_forget, written

WINDOW = 4096
END = 2
SHARD_BYTES = 2 << 20
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 4 << 20
K1, B = 1.2, 0.75
#: Pieces of words that a worker remembers, and their bytes, before it drops those that came once.
MOST_PIECES, MOST_BYTES = 1 << 19, 8 << 20
#: Rows that come to the tokeniser at a time, and bytes of ids that go back.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
#: Pieces that go to the model at a time.
MOST_AT_ONCE = 1 << 14
#: Centroids, dimensions of the projection, and documents that centroids are learnt from.
CENTROIDS, DIMENSIONS, SAMPLE = 16, 64, 4000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Token ids of whole texts by way of their distinct pieces.

    For tokenizers that drop white space and never merge across it, a text's
    ids are those of its words in a row. A plain word (letters up to U+017F,
    digits, punctuation) is put in lower case and cut into pieces here, a
    batch's distinct words at a time, and new pieces go to the library's model;
    any other word, or one that may hold a special token's string, is one piece
    and goes through the library whole. A piece of a plain word is plain and
    holds no "<|", so it is never the string of a whole word.
    """

    plain = r"^[\x21-\x7E\x{A1}-\x{12F}\x{131}-\x{17F}]+$"
    letters = r"^\p{L}+$"
    parts = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+"

    def __init__(self, tokenizer_json: str):
        # one text at a time: the library's threads would only take memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_str(tokenizer_json)
        # the same model without normaliser and splitting: it gets pieces with a space between
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        # a byte's character there; between pieces a space
        printable = [*range(32, 127), *range(161, 173), *range(174, 256)]
        self.chars = np.arange(256, dtype="<u2")
        other = [b for b in range(256) if b not in printable or b == 32]
        self.chars[other] = 256 + np.arange(len(other))
        self.chars[32] = 32
        # which ids end a word, if every byte has one that does; plain pieces never hold the suffix itself
        suffix, vocabulary = getattr(self.model.model, "end_of_word_suffix", None), self.model.get_vocab()
        self.closing = None
        if suffix == "</w>" and all(chr(c) + suffix in vocabulary for c in self.chars.tolist() if c != 32):
            self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closing[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        # piece k has the ids piece_ids[piece_ends[k] : piece_ends[k + 1]]; the empty piece has none
        # whole words, and pieces of plain words, each with their numbers
        self.known = [(pa.array([], pa.string()), np.zeros(0, np.int32)), (pa.array([""]), np.zeros(1, np.int32))]
        self.piece_ids, self.piece_ends = np.zeros(0, np.uint32), np.zeros(2, np.int32)
        # in how many batches each piece came
        self.uses = np.zeros(1, np.int32)

    def drop_rare(self) -> None:
        """Keeps only what came in several batches; nothing, if that is still much."""
        stays = self.uses > 1
        stays[0] = True
        places = np.cumsum(stays, dtype=np.int32) - 1
        known = [(texts.filter(pa.array(stays[numbers])), places[numbers[stays[numbers]]]) for texts, numbers in self.known]
        if 2 * stays.sum() > MOST_PIECES or 2 * sum(texts.nbytes for texts, _ in known) > MOST_BYTES:
            return self.forget()
        self.known = known
        ids, ends = _gathered(self.piece_ids, self.piece_ends[:-1], np.diff(self.piece_ends), np.flatnonzero(stays))
        self.piece_ids, self.piece_ends, self.uses = ids, ends, np.zeros(len(ends) - 1, np.int32)

    def learn(self, fresh: pa.Array, plain: bool) -> None:
        """Numbers new pieces; those of plain words are encoded many at a time."""
        found, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for first in range(0, len(fresh), MOST_AT_ONCE if plain else 1):
            some = fresh.slice(first, MOST_AT_ONCE if plain else 1).to_pylist()
            if not plain:
                found.append(np.array(self.library.encode(some[0], add_special_tokens=False).ids, np.uint32))
                sizes.append(np.array([len(found[-1])]))
                continue
            row = " ".join(some)
            if not row.isascii():
                row = self.chars[np.frombuffer(row.encode(), np.uint8)].tobytes().decode("utf-16-le")
            if self.closing is not None:
                found.append(np.array(self.model.encode_batch_fast([row], add_special_tokens=False)[0].ids, np.uint32))
                sizes.append(np.diff(np.flatnonzero(self.closing[found[-1]]), prepend=-1))
            else:
                coded = self.model.encode(row.split(" "), is_pretokenized=True, add_special_tokens=False)
                found.append(np.array(coded.ids, np.uint32))
                sizes.append(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(some)))
        ids, sizes = np.concatenate(found), np.concatenate(sizes)
        self.piece_ends = np.concatenate([self.piece_ends, self.piece_ends[-1] + np.cumsum(sizes, dtype=np.int32)])
        self.piece_ids = np.concatenate([self.piece_ids, ids])
        known, places = self.known[plain]
        new = np.arange(len(self.uses), len(self.uses) + len(fresh), dtype=np.int32)
        self.known[plain] = pa.concat_arrays([known, fresh]), np.concatenate([places, new])
        self.uses = np.append(self.uses, np.zeros(len(fresh), np.int32))

    def numbers(self, values: pa.Array, plain: bool) -> np.ndarray:
        """The numbers of pieces of plain words, or of whole words."""
        coded = values.dictionary_encode()
        known, places = self.known[plain]
        # the batch's pieces are fewer than the known ones, so these are looked up among them
        at = pc.index_in(known, coded.dictionary)
        found = np.full(len(coded.dictionary), -1, np.int32)
        met = at.is_valid().to_numpy(zero_copy_only=False)
        found[at.fill_null(0).to_numpy()[met]] = places[met]
        fresh = found < 0
        if fresh.any():
            found[fresh] = np.arange(len(self.uses), len(self.uses) + int(fresh.sum()))
            self.learn(coded.dictionary.filter(pa.array(fresh)), plain)
        self.uses[found] += 1
        return found[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's closed by ``end``; where each text starts, and the end."""
        if len(self.uses) > MOST_PIECES or sum(texts.nbytes for texts, _ in self.known) > MOST_BYTES:
            self.drop_rare()
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        del split
        words = coded.dictionary
        plain = pc.and_(pc.match_substring_regex(words, self.plain), pc.invert(pc.match_substring(words, "<|")))
        lower = pc.utf8_lower(words.filter(plain))
        # a word of letters only is one piece
        mixed = pc.invert(pc.match_substring_regex(lower, self.letters))
        spaced = pc.replace_substring_regex(lower.filter(mixed), self.parts, r"\0 ")
        cut = pc.split_pattern(pc.replace_with_mask(lower, mixed, pc.ascii_rtrim(spaced, characters=" ")), " ")
        ends = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        is_plain = plain.to_numpy(zero_copy_only=False)
        pieces = np.concatenate([self.numbers(cut.flatten(), True), self.numbers(words.filter(pc.invert(plain)), False)])
        del lower, spaced, cut
        first, last = np.empty(len(words) + 1, np.int32), np.empty(len(words) + 1, np.int32)
        first[:-1][is_plain], last[:-1][is_plain] = ends[:-1], ends[1:]
        first[:-1][~is_plain] = ends[-1] + np.arange((~is_plain).sum())
        last[:-1][~is_plain] = first[:-1][~is_plain] + 1
        # the ids of the distinct words, and one word more: the end of a text
        ids, starts = _gathered(self.piece_ids, self.piece_ends[:-1], np.diff(self.piece_ends), pieces)
        first[:-1], last[:-1] = starts[first[:-1]], starts[last[:-1]]
        first[-1], last[-1] = len(ids), len(ids) + 1
        codes = np.insert(coded.indices.to_numpy(), bounds[1:], len(words))
        found, at = _gathered(np.append(ids, np.uint32(end)), first, last - first, codes)
        return found, at[bounds + np.arange(len(bounds))]


def _gathered(values: np.ndarray, first: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[first[i] : first[i] + sizes[i]] for each i of ``which`` in a row, and where each starts, and the end."""
    n = sizes[which]
    starts = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=starts[1:])
    gather = np.repeat(first[which] - starts[:-1], n)
    gather += np.arange(starts[-1], dtype=np.int32)
    return values[gather], starts


def _term_counts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' distinct terms in a row, each text's rising, their counts there, and where each text starts, and the end."""
    flat = np.concatenate(texts)
    # a text's number and a term make one number, of 32 bits if that does
    whole, bits = (np.uint32, 16) if flat.dtype.itemsize == 2 and len(texts) < 1 << 16 else (np.int64, 32)
    owners = np.repeat(np.arange(len(texts), dtype=whole) << whole(bits), [len(t) for t in texts])
    owners |= flat.astype(whole)
    owners.sort()
    new = np.ones(len(owners), bool)
    np.not_equal(owners[1:], owners[:-1], out=new[1:])
    first = np.flatnonzero(new)
    counts = np.diff(first, append=len(owners))
    owners = owners[first]
    terms = (owners & whole((1 << bits) - 1)).astype(np.int64)
    return terms, counts, np.searchsorted(owners >> whole(bits), np.arange(len(texts) + 1, dtype=whole))


def _portions(texts: list[np.ndarray], most: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """The texts in a row, in portions of about ``most`` ids."""
    ends = np.cumsum([len(t) for t in texts])
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most)))
        yield texts[first:last]
        first = last


class Corpus:
    """What is known of the whole corpus: each term's document frequency and
    idf, the mean length, the texts' bytes, and the centroids."""

    def __init__(self, df: np.ndarray, n: int, tokens: int, size: int):
        self.df, self.n, self.mean, self.size = df, n, tokens / max(n, 1), size
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.centroids = np.zeros((1, DIMENSIONS), np.float32)

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * (K1 + 1) / (counts + K1) * self.idf[terms]

    def plane(self) -> np.ndarray:
        size = len(self.df)
        return worker_cache(f"projection {size}", lambda: np.random.default_rng(7).standard_normal((size, DIMENSIONS), np.float32))

    def weighted(self, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each text's terms, and their weights."""
        for some in _portions(texts):
            terms, counts, at = _term_counts(some)
            weights = self.weights(terms, counts)
            yield from ((terms[a:b], weights[a:b]) for a, b in zip(at[:-1], at[1:]))

    def vector(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weights projected on few dimensions, of length 1."""
        v = weights.astype(np.float32) @ self.plane()[terms]
        return v / max(np.linalg.norm(v), 1e-9)

    def learn(self, vectors: np.ndarray) -> None:
        """Spherical k-means."""
        vectors = vectors[np.lexsort(vectors.T)]
        centroids = vectors[:: max(1, len(vectors) // CENTROIDS)][:CENTROIDS].copy()
        for _ in range(8):
            nearest = np.argmax(vectors @ centroids.T, 1)
            for k in np.unique(nearest):
                v = vectors[nearest == k].sum(0)
                centroids[k] = v / max(np.linalg.norm(v), 1e-9)
        self.centroids = centroids

    def keys(self, texts: list[np.ndarray]) -> list[int]:
        """Each text's nearest centroid and heaviest term. A term that no other
        document has brings no neighbour, so it counts nothing."""
        found, plane = [], self.plane() @ self.centroids.T
        for some in _portions(texts):
            terms, counts, at = _term_counts(some)
            weights = self.weights(terms, counts)
            shared = np.where(self.df[terms] > 1, weights, 0.0)
            light, bounds = weights.astype(np.float32), at.tolist()
            # a vector's length does not tell which centroid is nearest
            nearest = np.array([light[a:b] @ plane[terms[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]).argmax(1)
            heaviest = terms[[a + int(shared[a:b].argmax()) for a, b in zip(bounds[:-1], bounds[1:])]]
            found.extend((nearest * len(self.df) + heaviest).tolist())
        return found


class Bm25:
    """An inverted index over documents given as arrays of terms. The idf of
    each term and the mean length are those of ``corpus``, or of the documents."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        lengths = np.array([len(d) for d in docs], np.float64)
        terms, counts, at = _term_counts(docs)
        self.terms = np.split(terms, at[1:-1])
        owners = np.repeat(np.arange(len(docs)), np.diff(at))
        order = np.argsort(terms, kind="stable")
        vocabulary, first, df = np.unique(terms[order], return_index=True, return_counts=True)
        norm = K1 * (1 - B + B * lengths / (corpus.mean if corpus else lengths.mean()))
        idf = corpus.idf[vocabulary] if corpus else np.log1p((len(docs) - df + 0.5) / (df + 0.5))
        weight = counts * (K1 + 1) / (counts + norm[owners])
        self.vocabulary, self.first, self.df = vocabulary, first, df
        self.owners = owners[order]
        self.weights = weight[order] * np.repeat(idf, df)
        self.n = len(docs)

    def scores(self, doc: int) -> np.ndarray:
        """Every document's score for all terms of ``doc``."""
        at = np.searchsorted(self.vocabulary, self.terms[doc])
        n = self.df[at]
        total = np.cumsum(n)
        postings = np.arange(total[-1]) + np.repeat(self.first[at] - (total - n), n)
        return np.bincount(self.owners[postings], self.weights[postings], self.n)


def fill(docs: list[np.ndarray], window: int = WINDOW, whole: list[np.ndarray] | None = None, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start in it, length, sequence, offset there) of
    documents shorter than a window, each id in exactly one piece. Neighbours
    are those of the texts ``whole``, of which ``docs`` may be the ends."""
    index, pieces = Bm25(whole or docs, corpus), []
    unused = np.ones(len(docs), bool)
    sequence, room, waiting, rest = 0, window, [], None
    next_seed = 0
    while True:
        if rest is None:
            while next_seed < len(docs) and not unused[next_seed]:
                next_seed += 1
            if next_seed == len(docs):
                return pieces
        if room == window or not waiting:  # a new seed: rank its neighbours
            seed = rest[0] if rest else next_seed
            scores = index.scores(seed)
            ranked = np.lexsort((np.arange(len(docs)), -scores))
            waiting = [d for d in ranked[unused[ranked]].tolist() if d != seed][::-1]
            doc, start = rest if rest else (seed, 0)
            rest = None
        else:
            doc, start = waiting.pop(), 0
        unused[doc] = False
        length = min(room, len(docs[doc]) - start)
        pieces.append((doc, start, length, sequence, window - room))
        room -= length
        if start + length < len(docs[doc]):
            rest = (doc, start + length)
        if room == 0:
            sequence, room, waiting = sequence + 1, window, []


class Stretches:
    """Each key's place in a row of all keys, as long as the tokens it holds."""

    def __init__(self, keys: np.ndarray, tokens: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.tokens = keys[order], tokens[order]
        self.first, self.total = np.cumsum(self.tokens) - self.tokens, int(tokens.sum())

    def shard(self, key: int, task: int, row: int, shards: int) -> int:
        k = int(np.searchsorted(self.keys, key))
        tokens = int(self.tokens[k])
        # what fits into one shard stays together, what does not is drawn over its stretch
        within = zlib.crc32(b"%d %d" % (task, row)) / 2**32 if tokens * shards > self.total else 0.5
        return min(shards - 1, int((int(self.first[k]) + within * tokens) * shards / self.total))


def _added(counts: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The sum of two counts, of which either may be longer."""
    longer, shorter = (counts, more) if len(counts) > len(more) else (more, counts)
    longer = longer.copy()
    longer[: len(shorter)] += shorter
    return longer


def _corpus(tokenised: DataFrame, kind: str) -> Corpus:
    """Each task's counts are a row of its own, whose number is below 0: ids,
    documents and bytes, then each term's documents. Only a number per term and the sample's vectors come to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, np.int64)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                df = _added(df, np.frombuffer(own, "<i8"))
        places = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(places - 3, pa.int64()), pa.array(df[places], pa.int64())], ["term", "n"])

    rows = tokenised.where("row < 0").select("ids").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
    n, tokens, size = found.pop(-2, 0), found.pop(-3, 0), found.pop(-1, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    corpus = Corpus(df, n, tokens, size)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(ids, kind) for ids in batch.column(0).to_pylist()]
            found = [corpus.vector(*w).astype("<f4").tobytes() for w in corpus.weighted(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["vector"])

    share = 1 << 20 if n <= SAMPLE else max(1, (SAMPLE << 20) // n)
    sample = tokenised.where("row >= 0").where(F.pmod(F.xxhash64("task", "row"), F.lit(1 << 20)) < share).select("ids")
    found = [np.frombuffer(r, "<f4") for r in sample.mapInArrow(vectors, "vector binary").toArrow().column(0).to_pylist()]
    if found:
        corpus.learn(np.array(found))
    return corpus


def _stretches(tokenised: DataFrame, kind: str, corpus: Corpus) -> Stretches:
    """At most a key per centroid and term comes to the driver."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_forget("word encoder")
        for batch in batches:
            texts = [np.frombuffer(ids, kind) for ids in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(corpus.keys(texts), pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["key", "n"])

    rows = tokenised.where("row >= 0").select("ids").mapInArrow(keyed, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return Stretches(rows.column(0).to_numpy(), rows.column(1).to_numpy())


@contextlib.contextmanager
def _batches_of(spark: SparkSession, rows: int):
    """Steps that run here get at most so many rows at a time: whole texts are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """doc_ids and texts, about ``ENCODE_BYTES`` at a time."""
    waiting, size = [], 0

    def joined() -> tuple[pa.Array, pa.Array]:
        return tuple(pa.concat_arrays([b.column(i) for b in waiting]) for i in (0, 1))

    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = max(first + (not waiting), int(np.searchsorted(ends, before + ENCODE_BYTES - size, "right")))
            if last > first:
                waiting.append(batch.slice(first, last - first))
                size += int(ends[last - 1]) - before
            if last < batch.num_rows:
                yield joined()
                waiting, size = [], 0
            first = last
    if waiting:
        yield joined()


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, shard_bytes: int = SHARD_BYTES, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset; ``with_ids`` adds the piece's ids (binary, unsigned
    little-endian 32 bits).

    A document's ids are those of the tokenizers library for the file
    ``tokenizer``, without special tokens, then ``end``; a null or empty text
    is the one id ``end``. Every row is packed, repeated rows each. Further
    columns are ignored; an empty table gives an empty result.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    # between steps an id takes two bytes if it can
    kind = "<u2" if max(end, *Tokenizer.from_str(spec).get_vocab().values()) < 1 << 16 else "<u4"

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache("word encoder", dict)
        if encoder.get("spec") != spec:
            encoder |= {"spec": spec, "made": WordEncoder(spec)}
        encoder = encoder["made"]
        # what earlier stages left in this worker
        pa.default_memory_pool().release_unused()
        task, seen, df = TaskContext.get().partitionId(), 0, np.zeros(3, np.int64)
        for doc_ids, texts in _chunks(batches):
            ids, at = encoder.encode(texts, end)
            ids = ids.astype(kind)
            df[2] += pc.sum(pc.binary_length(texts)).as_py()
            first = 0
            while first < len(texts):  # in portions, counted and sent back
                last = max(first + 1, int(np.searchsorted(at, at[first] + BATCH_BYTES // ids.itemsize, "right")) - 1)
                own = [ids[a:b] for a, b in zip(at[first:last], at[first + 1 : last + 1])]
                terms, counts, _ = _term_counts(own)
                df = _added(df, np.bincount(terms + 3))
                df[:2] += counts.sum(), last - first
                n = last - first
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * n, pa.int64()), pa.array(range(seen, seen + n), pa.int64()), doc_ids.slice(first, n), pa.array([x.tobytes() for x in own], pa.binary())],
                    ["task", "row", "doc_id", "ids"],
                )
                seen, first = seen + n, last
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([-1], pa.int64()), pa.array([None], pa.int64()), pa.array([df.tobytes()], pa.binary())], ["task", "row", "doc_id", "ids"])

    with _batches_of(docs.sparkSession, BATCH_ROWS):
        tokenised = written(rows.mapInArrow(tokenise, "task long, row long, doc_id long, ids binary"), "tokenised")
    corpus = _corpus(tokenised, kind)
    shards = max(1, -(-corpus.size // shard_bytes))
    stretches = _stretches(tokenised, kind, corpus)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_forget("word encoder")
        for batch in batches:
            found = []
            tasks, places, doc_ids, texts = (c.to_pylist() for c in batch.columns)
            texts = [np.frombuffer(ids, kind) for ids in texts]
            for task, row, doc, own, key in zip(tasks, places, doc_ids, texts, corpus.keys(texts)):
                full = len(own) // window * window
                shard = stretches.shard(key, task, row, shards)
                for start in range(0, len(own), window):
                    part = own[start : start + window]
                    crc = zlib.crc32(part.astype("<u4").tobytes()) if start < full else None
                    terms = counts = None
                    if crc is None and full:
                        terms, counts = (x.astype("<u4").tobytes() for x in np.unique(own, return_counts=True))
                    found.append((shard, task, row, doc, start, len(own), crc, part.tobytes() if crc is None or with_ids else None, terms, counts))
            kinds = [pa.int64()] * 7 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * 10, kinds)], names)

    names = ["shard", "task", "row", "doc_id", "start", "doc_tokens", "crc", "ids", "terms", "counts"]
    dealt = tokenised.where("row >= 0").mapInArrow(deal, ", ".join(f"{x} long" for x in names[:7]) + ", ids binary, terms binary, counts binary")
    schema = PIECES + ", ids binary" * with_ids

    def wide(ids: bytes | None) -> bytes | None:
        return ids and np.frombuffer(ids, kind).astype("<u4").tobytes()

    def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        worker_forget("word encoder")
        group = group.sort_values(["task", "row", "start"], kind="stable").reset_index(drop=True)
        full = group[group.crc.notna()]
        rest = group[group.crc.isna()]
        base = int(key[0]) << 32
        out = [(r.doc_id, r.start, window, int(r.crc), r.doc_tokens, base + i, 0, wide(r.ids)) for i, r in enumerate(full.itertuples())]
        if len(rest):
            ids = [np.frombuffer(x, kind) for x in rest.ids]
            doc_ids, starts, lengths = rest.doc_id.tolist(), rest.start.tolist(), rest.doc_tokens.tolist()
            texts = [
                own if t is None else np.repeat(np.frombuffer(t, "<u4"), np.frombuffer(c, "<u4")) for own, t, c in zip(ids, rest.terms, rest.counts)
            ]
            for doc, start, length, sequence, offset in fill(ids, window, texts, corpus):
                part = ids[doc][start : start + length].astype("<u4").tobytes()
                out.append((doc_ids[doc], starts[doc] + start, length, zlib.crc32(part), lengths[doc], base + len(full) + sequence, offset, part))
        frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        frame["doc_id"] = pd.array([None if x is None or x != x else int(x) for x in frame.doc_id], "Int64")
        return frame if with_ids else frame.drop(columns="ids")

    return dealt.groupBy("shard").applyInPandas(packed, schema)
