"""Token counts by compiled finite-state transducers.

A byte-level BPE tokenizer works in two steps, and each is compiled to a
deterministic transducer:

* The pattern that splits a text into pre-tokens becomes a table over classes
  of code points. Its transitions say whether a pre-token starts at this code
  point, or at the one before (the pattern looks ahead by one or two). A text
  is cut into chunks of equal length; each chunk's *state map* (the state it
  ends in, for every state it may start in) is computed for all chunks
  together, a parallel prefix scan composes the maps, and then every chunk
  knows the state in which it starts.
* Within a pre-token, a state holds the places in what was read where a longer
  token may still begin: how far back, which token ends there, and how many
  tokens fewer there are up to it. A byte leads to the next state and emits by
  how much the count of tokens changes. States and transitions are made when a
  text first needs them.

The second transducer rests on two properties of BPE with ranked merges: the
tokens of a text's front are the front of its tokens up to their last, and of
the tokens that could end a text exactly one goes with the token before it,
in the sense that the two, joined as text, are split into these two again.

Tasks are independent of each other: a map over the rows, with no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import text_of, worker_cache

#: Code points that are scanned together, and in a chunk.
SCAN, CHUNK = 1 << 20, 256
#: A worker's compiled states and known pre-tokens, about; beyond these it starts over, so that its memory is bounded.
MOST_STATES, MOST_KNOWN = 150_000, 300_000

# classes of code points; BREAK stands between texts
SPACE, BLANK, QUOTE, STMD, R, V, L, E, LETTER, NUMBER, OTHER, BREAK = range(12)
# states: between pre-tokens; in letters, numbers, others; white space of one or more, by its last
# character; after a quote that starts a pre-token, and the letters after it
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, MORE_SPACE, ONE_BLANK, MORE_BLANK, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
#: What a transition emits.
HERE, BEFORE = 1, 2


def classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, range(0xD800))) + "" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    found = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            found[m.start() : m.end()] = kind
    for kind, chars in ((SPACE, " "), (QUOTE, "'"), (STMD, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e")):
        found[[ord(c) for c in chars]] = kind
    return found


def _start(c: int) -> int:
    """The state after a pre-token's first code point."""
    return {SPACE: ONE_SPACE, BLANK: ONE_BLANK, QUOTE: QUOTED, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}.get(c, IN_LETTERS)


def _step(state: int, c: int) -> tuple[int, int]:
    """(next state, what is emitted) for a code point of class ``c``."""
    letter, other = c in (STMD, R, V, L, E, LETTER), c in (QUOTE, OTHER)
    pending = state in (MORE_SPACE, MORE_BLANK)
    if c == BREAK:
        return FREE, BEFORE if state in (QUOTED_R, QUOTED_V, QUOTED_L) else 0
    if state == IN_LETTERS and letter:
        return IN_LETTERS, 0
    if state == IN_NUMBERS and c == NUMBER:
        return IN_NUMBERS, 0
    if state in (IN_OTHERS, QUOTED) and other:
        return IN_OTHERS, 0
    if state in (ONE_SPACE, MORE_SPACE, ONE_BLANK, MORE_BLANK):
        if c in (SPACE, BLANK):
            return (MORE_SPACE if c == SPACE else MORE_BLANK), 0
        if state in (ONE_SPACE, MORE_SPACE):  # the last space belongs to what follows
            return (IN_LETTERS if letter else IN_NUMBERS if c == NUMBER else IN_OTHERS), BEFORE * pending
        return _start(c), HERE | BEFORE * pending
    if state == QUOTED and c in (STMD, R, V, L):
        return {STMD: FREE, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if c == (L if state == QUOTED_L else E):
            return FREE, 0
        after, emitted = _step(IN_LETTERS, c)
        return after, emitted | BEFORE
    return _start(c), HERE


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next states and emissions, at 12 * state + class."""
    both = [_step(s, c) for s in range(12) for c in range(12)]
    return np.array([x for x, _ in both], np.uint8), np.array([x for _, x in both], np.uint8)


def scan(kinds: np.ndarray, after: np.ndarray, emits: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """What is emitted at each code point, from chunks' state maps and their prefix scan."""
    n = len(kinds)
    rows = -(-max(n, 1) // chunk)
    padded = np.full(rows * chunk, BREAK, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    maps = np.repeat(np.arange(12, dtype=np.uint8)[:, None], rows, axis=1)
    for c in columns:
        maps = after[maps * np.uint8(12) + c]
    reach = 1
    while reach < rows:  # maps[:, i] becomes the composition of the maps of chunks 0 to i
        joined = maps.copy()
        joined[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach], axis=0)
        maps, reach = joined, reach * 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = FREE, maps[FREE, :-1]
    out = np.empty_like(columns)
    for i, c in enumerate(columns):
        at = state * np.uint8(12) + c
        out[i], state = emits[at], after[at]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def vocabulary(tokenizer_json: str) -> tuple[dict[bytes, int], dict[tuple[int, int], tuple[int, int]], list[str]]:
    """Tokens by their bytes, merges as (left, right) -> (rank, token), special strings."""
    spec = json.loads(tokenizer_json)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    raw = lambda token: bytes(byte_of[c] for c in token)
    special = [t["content"] for t in spec["added_tokens"]]
    ids = spec["model"]["vocab"]
    tokens = {raw(t): i for t, i in ids.items() if t not in special}
    merges = {}
    for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]):
        merges[ids[a], ids[b]] = (rank, ids[a + b])
    return tokens, merges, special


class CountTransducer:
    """Counts a pre-token's BPE tokens byte by byte; compiled as it is used."""

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.tokens = tokens
        self.ranks = {pair: rank for pair, (rank, _) in merges.items()}
        self.made = {token: (left, right, rank) for (left, right), (rank, token) in merges.items()}
        if len(self.made) != len(merges):
            raise ValueError("a token of this vocabulary comes from two merges")
        self.fronts = {t[:k] for t in tokens for k in range(1, len(t))}
        self.goes: dict[tuple[int, int], bool] = {}
        self.sound: dict[int, bool] = {}
        # a state: what is kept of the text, and for each place in it where a token may begin
        # (length back, last token before or -1, count there less the count here)
        start = (b"", ((0, -1, 0),))
        self.number, self.states, self.next = {start: 0}, [start], [{}]

    def edge(self, token: int, side: int, end: float) -> list[tuple[int, float]]:
        """The parts that stand at one side of a token while it is put together,
        each with the rank of the merge that takes it up (``end`` for the token)."""
        parts = [(token, end)]
        while token in self.made:
            end = self.made[token][2]
            token = self.made[token][side]
            parts.append((token, end))
        return parts

    def crossed(self, left: int, right: int, end: float) -> bool:
        """Whether a merge across the border comes before both sides are whole:
        one of a lesser rank than those that take up its two parts. Of merges of
        one rank the leftmost comes first."""
        second = self.edge(right, 0, end)
        for x, until in self.edge(left, 1, end):
            for y, then in second:
                rank = self.ranks.get((x, y))
                if rank is not None and rank < until and rank <= then and rank < end:
                    return True
        return False

    def reachable(self, token: int) -> bool:
        """Whether the token's text is split into this one token."""
        if token not in self.sound:
            left, right, rank = self.made.get(token, (0, 0, 0))
            self.sound[token] = token not in self.made or (
                self.reachable(left) and self.reachable(right) and not self.crossed(left, right, rank)
            )
        return self.sound[token]

    def together(self, left: int, right: int) -> bool:
        """Whether the two tokens, joined as text, are these two again (left -1: nothing before)."""
        if (left, right) not in self.goes:
            self.goes[left, right] = self.reachable(right) and (left < 0 or not self.crossed(left, right, float("inf")))
        return self.goes[left, right]

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the count); made on first use."""
        text, places = self.states[state]
        text += bytes([byte])
        end = len(text) - 1
        last = change = None
        for back, before, less in places:
            token = self.tokens.get(text[end - back :])
            if token is not None and self.together(before, token):
                last, change = token, less + 1
                break
        kept = [(back + 1, before, less - change) for back, before, less in places if text[end - back :] in self.fronts]
        longest = kept[0][0] if kept else 0  # places are in order, the longest first
        new = (text[end + 1 - longest :], (*kept, (0, last, 0)))
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
            self.next.append({})
        self.next[state][byte] = made = (self.number[new], change)
        return made

    def count(self, text: bytes) -> int:
        state = total = 0
        table = self.next
        for byte in text:
            step = table[state].get(byte) or self.move(state, byte)
            state = step[0]
            total += step[1]
        return total


class Counter:
    """Counts the tokens of many texts at once."""

    def __init__(self, tokenizer_json: str, kinds: np.ndarray):
        tokens, merges, special = vocabulary(tokenizer_json)
        self.kinds, (self.after, self.emits) = kinds, transitions()
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.compile = lambda: CountTransducer(tokens, merges)
        self.inner, self.known = self.compile(), {}

    def counts(self, texts: list[str]) -> np.ndarray:
        if len(self.inner.states) > MOST_STATES or len(self.known) > MOST_KNOWN:  # compile anew rather than grow
            self.inner, self.known = self.compile(), {}
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts])
        kinds = self.kinds[points]
        kinds[ends - 1] = BREAK
        whole = []  # special strings that lie within one text
        for m in self.special.finditer(joined):
            if np.searchsorted(ends, m.start(), "right") == np.searchsorted(ends, m.end() - 1, "right"):
                kinds[m.start() : m.end()] = BREAK
                whole.append(m.start())
        emitted = scan(kinds, self.after, self.emits)
        starts = (emitted & HERE).astype(bool)
        starts[:-1] |= (emitted[1:] & BEFORE).astype(bool)
        breaks = kinds == BREAK
        firsts = np.flatnonzero(starts | breaks)
        widths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        offsets = np.concatenate([[0], np.cumsum(widths)])
        at = np.append(offsets[firsts], offsets[-1]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(at), pa.py_buffer(joined.encode())])
        coded = pieces.dictionary_encode()
        known, inner = self.known, self.inner
        each = np.fromiter((known.get(p) or known.setdefault(p, inner.count(p)) for p in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        n = each[coded.indices.to_numpy()]
        n[breaks[firsts]] = 0
        n[np.searchsorted(firsts, whole)] = 1
        total = np.concatenate([[0], np.cumsum(n)])
        return np.diff(total[np.searchsorted(firsts, np.concatenate([[0], ends]))])


def token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit
    (n_tokens > limit), as the tokenizers library counts them with the
    byte-level BPE file ``tokenizer``, special strings in texts being special.

    The file is read on the driver and sent to the tasks. Null text is empty;
    an empty text has no tokens. Repeated rows are counted each. Further
    columns are ignored; an empty table gives an empty result.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    kinds = classes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(f"counter {hash(spec)}", lambda: Counter(spec, kinds))
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)
            first = 0
            while first < batch.num_rows:
                end = max(first + 1, first + int(np.searchsorted(np.cumsum(sizes[first:]), SCAN)))
                n = counter.counts(batch.column(1).slice(first, end - first).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(sizes[first:end]), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])
                first = end

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
