"""Vector codes of 16 parts by ball k-means on exact integers.

Vectors are cut into equal parts, each with a codebook of its own. A codebook
entry with the parts that it is nearest to is a ball: the entry is its centre,
the largest distance to it its radius. Two facts spare most distances, and
neither changes a result:

* An entry j can only win a part of ball i if |c_i - c_j| <= 2 |x - c_i|. So it
  is a neighbour of ball i only if |c_i - c_j| <= 2 r_i.
* A part nearer to its centre than half the way to the nearest neighbour is in
  the stable core and keeps its entry. The others lie in rings between the
  half distances to the neighbours, in rising order; a part in ring q meets
  the first q neighbours, and no more.

All comparisons are of squared integers. The radius around a moved centre is
bounded by the old radius and the move, both rounded up. At the start every part
lies in the ball of entry 0, of unbounded radius.

A round is one map over the vectors (codebooks, of entries * dimension
integers, travel with the tasks) and one sum by (part, entry); only these sums
reach the driver, whose number is fixed by the codebooks. Vectors with their
codes are written after each round, so a lost task reads its own part again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import written
from postlens.llm.skew import met

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components are integers below this size, so that squared distances are exact in 64 bits.
MOST = 1 << 24
FAR = np.iinfo(np.int64).max
STATE = "vec_id long, label_key string, vector binary, code binary"


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as integers."""
    x = np.floor(values * float(scale))
    if x.size and np.abs(x).max() >= MOST:
        raise ValueError(f"a vector component times {scale} must be below {MOST} in size")
    return x.astype(np.int64)


def gaps(book: np.ndarray, reach: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """For each entry its neighbours by rising squared gap, and these gaps;
    ``FAR`` for entries outside twice its ball's radius (``reach``)."""
    k = len(book)
    square = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(square, FAR)
    if reach is not None:
        for i, r in enumerate(reach):
            if r is not None and r < 1 << 30:  # beyond it every entry is a neighbour
                square[i, square[i] > 4 * r * r] = FAR
    order = np.argsort(square, axis=1, kind="stable")[:, : k - 1]
    return order, np.take_along_axis(square, order, 1)


def nearest(x: np.ndarray, own: np.ndarray, book: np.ndarray, order: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry to each row of ``x``, the
    lower entry of equals, given that row i lies in the ball of ``own[i]``."""
    best = ((x - book[own]) ** 2).sum(1)
    entry = own.copy()
    rings = (gap[own] <= 4 * best[:, None]).sum(1)
    at = np.flatnonzero(rings)  # the rest are in their stable cores
    q = 0
    while len(at):
        rival = order[own[at], q]
        d = ((x[at] - book[rival]) ** 2).sum(1)
        closer = (d < best[at]) | ((d == best[at]) & (rival < entry[at]))
        best[at[closer]], entry[at[closer]] = d[closer], rival[closer]
        q += 1
        at = at[rings[at] > q]
    return entry, best


class Balls:
    """The codebooks of all parts, with their neighbour rings."""

    def __init__(self, books: np.ndarray, reach: list[list[int | None]] | None = None) -> None:
        self.books = books  # parts, entries, components
        self.rings = [gaps(b, None if reach is None else reach[p]) for p, b in enumerate(books)]

    def codes(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries (rows, parts) and squared distances of vectors (rows, parts, components)."""
        entry, d = np.empty(own.shape, np.int64), np.empty(own.shape, np.int64)
        for p, book in enumerate(self.books):
            entry[:, p], d[:, p] = nearest(x[:, p], own[:, p], book, *self.rings[p])
        return entry, d


def _vectors(batch: pa.RecordBatch, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<i4").astype(np.int64).reshape(n, *shape)
    own = np.frombuffer(b"".join(batch.column("code").to_pylist()), "u1").astype(np.int64).reshape(n, shape[0])
    return x, own


def _binary(rows: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.tobytes() for r in rows.reshape(len(rows), -1).astype(kind)], pa.binary())


def start(rows: DataFrame, parts: int, size: int, scale: int) -> DataFrame:
    """``STATE`` rows: quantised vectors, all in entry 0's balls."""

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            lengths = np.diff(vectors.offsets.to_numpy())
            if (lengths != parts * size).any():
                raise ValueError(f"vectors of {sorted(set(lengths.tolist()))} components among vectors of {parts * size}")
            x = quantised(vectors.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), scale)
            own = np.zeros((batch.num_rows, parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(x, "<i4"), _binary(own, "u1")], ["vec_id", "label_key", "vector", "code"])

    return rows.mapInArrow(quantise, STATE)


def recoded(state: DataFrame, balls: Balls) -> DataFrame:
    """``state`` with the nearest entries as codes."""
    shape = (balls.books.shape[0], balls.books.shape[2])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, _ = balls.codes(*_vectors(batch, shape))
            yield batch.set_column(3, "code", _binary(entry, "u1"))

    return state.mapInArrow(code, STATE)


def ball_sums(state: DataFrame, books: np.ndarray) -> DataFrame:
    """(cell, pos, n, total, radius): for each part and entry (cell) and
    component the number of parts, the sum, and the largest squared distance."""
    parts, k, size = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radius = np.zeros(parts * k, np.int64), np.zeros(parts * k, np.int64)
        total = np.zeros((parts * k, size), np.int64)
        for batch in batches:
            x, own = _vectors(batch, (parts, size))
            d = ((x - books[np.arange(parts), own]) ** 2).sum(2)
            cell = own + np.arange(parts) * k
            np.add.at(n, cell, 1)
            np.add.at(total, cell, x)
            np.maximum.at(radius, cell, d)
        used = np.flatnonzero(n)
        each = [np.repeat(used, size), np.tile(np.arange(size), len(used)), np.repeat(n[used], size), total[used].ravel(), np.repeat(radius[used], size)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in each], ["cell", "pos", "n", "total", "radius"])

    rows = state.mapInArrow(sums, "cell long, pos long, n long, total long, radius long")
    return rows.groupBy("cell", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("radius").alias("radius"))


def moved(books: np.ndarray, found: list) -> Balls:
    """The next codebooks from ``ball_sums``: entries at floor(sum / count),
    unused ones where they were, with a bound of each ball's radius."""
    parts, k, size = books.shape
    new = books.copy()
    radius = [[0] * k for _ in range(parts)]  # unused balls hold nothing
    for r in found:
        p, i = divmod(r.cell, k)
        new[p, i, r.pos] = r.total // r.n
        radius[p][i] = r.radius
    up = lambda square: math.isqrt(square - 1) + 1 if square else 0
    shift = ((new - books) ** 2).sum(2)
    return Balls(new, [[up(radius[p][i]) + up(int(shift[p, i])) for i in range(k)] for p in range(parts)])


def ball_codes(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """One row per kept row: vec_id, code (two hex digits for each part), error
    (squared distance to the code's entries), label_error (error summed over
    the rows of equal label, nulls together) and codebooks_sha256.

    Rows whose vector is null or empty or holds a null, infinite or NaN component are
    dropped. The codebooks start as the vectors of the ``entries`` smallest
    vec_ids, null last, equal ids by vector; with fewer rows they have fewer
    entries. Repeated rows count each. Vectors must be equally long, a multiple
    of ``parts``, and their scaled components below 2^24 in size, else the job fails.
    Further columns are ignored; an empty table gives an empty result.
    """
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    label_key = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label_key.alias("label_key"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") > 0) & finite)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()  # as many as a codebook has
    if not first:
        return rows.selectExpr("vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256").where("false")
    length = len(first[0].v)
    if any(len(r.v) != length for r in first):
        raise ValueError(f"vectors of {sorted({len(r.v) for r in first})} components among vectors of {length}")
    if length % parts or entries > 256:
        raise ValueError(f"{length} components cannot be cut into {parts} parts, or codes exceed a byte")
    books = quantised(np.array([r.v for r in first]), scale).reshape(len(first), parts, length // parts).transpose(1, 0, 2)
    balls = Balls(books)
    state = start(rows, parts, length // parts, scale)
    for _ in range(rounds):
        state = written(recoded(state, balls), "vector_codes")
        balls = moved(balls.books, ball_sums(state, balls.books).collect())  # a row per codebook component
    shape = (parts, length // parts)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, d = balls.codes(*_vectors(batch, shape))
            code = pa.array([r.tobytes().hex() for r in entry.astype("u1")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(d.sum(1), pa.int64())], ["vec_id", "label_key", "code", "error"])

    coded = written(state.mapInArrow(finish, "vec_id long, label_key string, code string, error long"), "coded")
    labels = written(coded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label_errors")
    digest = hashlib.sha256(",".join(map(str, balls.books.ravel().tolist())).encode()).hexdigest()
    return met(coded, labels, "label_key", "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
