"""Plain versions of the operators, over small tables in memory."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def find(parent: dict, x):
    while parent[x] != x:
        x = parent[x]
    return x


def groups(nodes, links) -> dict:
    """Each node's least reachable node."""
    parent = {n: n for n in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def exact(rows: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text)."""
    by = collections.defaultdict(list)
    for i, t in rows:
        by["".join(words(t))].append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = []
    for i, t in rows:
        key = "".join(words(t))
        keep = min(by[key])[3] if len(by[key]) > 1 else i
        out.append((i, keep, len(by[key]), keep == i, hashlib.sha256(key.encode()).hexdigest()))
    return out


def repeated_words(w: list[str]) -> int:
    windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    return len({k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)})


def components(rows: list[tuple], width: int, percent: int) -> dict:
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {}
    for i, t in rows:
        w = words(lower(t or ""))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = groups(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def without_repeats(rows: list[tuple], width: int) -> list[tuple]:
    """(doc_id, words, removed, kept text)."""
    texts = [(i, words(t)) for i, t in rows]
    seen = collections.Counter(tuple(w[k : k + width]) for _, w in texts for k in range(len(w) - width + 1))
    out = []
    for i, w in texts:
        gone = {k + j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(width)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


class Model:
    """The interpolated n-gram model, without shards or codes."""

    def __init__(self, rows: list[tuple], priors: tuple):
        self.priors, self.counts = priors, collections.defaultdict(collections.Counter)
        for i, t in rows:
            if not self.held_out(i):
                w = self.tokens(t)
                for n in range(1, len(priors) + 2):
                    self.counts[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        self.n, self.distinct = sum(self.counts[1].values()), len(self.counts[1])

    @staticmethod
    def held_out(i) -> bool:
        return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0

    @staticmethod
    def tokens(t) -> list[str]:
        return words(lower(t or "")) + [""]

    def score(self, t) -> tuple[int, int, float, float]:
        """Tokens, known tokens, base and full log10 probability."""
        w, base, full = self.tokens(t), 0.0, 0.0
        for k in range(len(w)):
            p = (self.counts[1][(w[k],)] + 0.1) / (self.n + 0.1 * (self.distinct + 1))
            base += math.log10(p)
            for n, prior in enumerate(self.priors, 2):
                if k >= n - 1:
                    h = tuple(w[k - n + 1 : k])
                    p = (self.counts[n][(*h, w[k])] + prior * p) / (self.counts[n - 1][h] + prior)
            full += math.log10(p)
        return len(w), sum(self.counts[1][(x,)] > 0 for x in w), base, full


def levenshtein(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
