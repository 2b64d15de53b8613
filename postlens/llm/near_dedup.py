"""Near-duplicate documents by MinHash.

A document's set holds its distinct shingles of ``width`` words. The set is
sketched by 128 minima of universal hash functions. Documents with equal sets
are one node. Nodes that agree on all four minima of one of 32 bands share a
bucket; two sets of similarity 0.8 miss each other in all bands with a chance
under 1e-7. Candidates are first verified by their signatures (a pair at the
threshold fails that test with a chance under 1e-8), then exactly, on the full
sets. Components come from alternating large-star and small-star.

Buckets may hold thousands of versions of one text, so the nodes of a bucket
are not compared all with all:

1. Every node is compared with one pivot of each of its buckets. The pivot is
   the least by one order of all nodes, so the buckets of a group of versions
   mostly share it, and a node has few pivots.
2. The rest, exactly: in buckets that still hold several components, the nodes
   outside the largest one meet all others, in units of two blocks of at most
   about 2048 nodes. A unit first compares signatures in arrays, each pair in
   the first bucket that it shares. The nodes of the pairs that pass, and only
   these, come to their unit again with their full sets; there the likeliest
   pairs are compared first, and only components that are not joined yet.

No link between components is lost, and no bucket is joined with itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import text_of, written
from postlens.llm.components import connected_components

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: By how much the share of equal minima may fall short of the similarity.
SLACK = 0.22
BLOCK = 2048
UNIT_ROWS = 20_000
#: Ids that are sent to all executors, instead of all texts to the ids.
MOST_IDS = 1_000_000


def shingle_hashes(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; a text
    of fewer words is one shingle, one without words has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten()
    coded = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    stream = each[coded.indices.to_numpy()]
    real = np.asarray(pc.not_equal(words, ""))
    ends = np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    stream = stream[real]

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(parts[0]), len(parts) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for p in parts:
            h = (h ^ p) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return h

    n = len(stream)
    windows = joined([stream[k : n - width + 1 + k] for k in range(width)]) if n >= width else np.zeros(0, np.uint64)
    found = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= width:
            found.append(np.unique(windows[a : b - width + 1]))
        else:
            found.append(joined([stream[i : i + 1] for i in range(a, b)]) if b > a else np.zeros(0, np.uint64))
    return found


def _universal(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of multiply-shift hashing, a universal family."""
    draw = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, (2, HASHES), np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def minima(hashes: np.ndarray, family: tuple[np.ndarray, np.ndarray], piece: int = 4096) -> np.ndarray:
    """The signature: the least upper 32 bits under each function."""
    a, b = family
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), piece):
        values = np.multiply.outer(a, hashes[i : i + piece])
        values += b[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def sketches(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc_id, n_shingles, node (a digest of the set; null if empty), signature."""
    family = _universal()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                sets = shingle_hashes(part.column(1), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([minima(s, family).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "node", "signature"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, node binary, signature binary")


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(node, hashes) for the nodes of ``wanted`` (doc_id, node). Up to
    ``MOST_IDS`` ids go where the texts are; more meet the texts in a shuffle."""
    wanted = written(wanted.select("doc_id", "node"), "wanted_sets")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                found = shingle_hashes(batch.column(0).slice(first, 1000), width)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["node", "hashes"])

    ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= MOST_IDS else ids
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
    made = rows.mapInArrow(sets, "node binary, hashes array<long>")
    return written(made.join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "shingle_sets")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(band, bucket, node): a row for each band."""
    keys = [F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("signature", 4 * ROWS * b + 1, 4 * ROWS)).alias("bucket")) for b in range(BANDS)]
    return nodes.select("node", "n_shingles", F.explode(F.array(*keys)).alias("k")).select("k.band", "k.bucket", "node", "n_shingles")


def _promising(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """The pairs (u, v) whose signatures agree well enough."""
    least = (similarity / 100 - SLACK) * HASHES

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, HASHES) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array((one == two).sum(axis=1) >= least))

    one = nodes.select(F.col("node").alias("u"), F.col("signature").alias("s"))
    two = nodes.select(F.col("node").alias("v"), F.col("signature").alias("t"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "s", "t").mapInArrow(agree, "u binary, v binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    two = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    joined = pairs.join(one, "u").join(two, "v").withColumn("both", F.size(F.array_intersect("a", "b")).cast("long"))
    return joined.where(100 * F.col("both") >= similarity * (F.size("a") + F.size("b") - F.col("both"))).select("u", "v")


def _unit_pairs(one: pd.DataFrame, two: pd.DataFrame, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of two blocks' nodes that may link their components: the
    signatures agree well enough, and in no band before this bucket's. The
    best agreement comes first."""
    s, t = (np.frombuffer(b"".join(x.signature), "<u4").reshape(-1, HASHES) for x in (one, two))
    same = np.zeros((len(one), len(two)), np.int16)
    for k in range(HASHES):
        same += s[:, k, None] == t[None, :, k]
    apart = one.component.to_numpy()[:, None] != two.component.to_numpy()[None]
    x, y = np.nonzero(apart & (same >= (similarity / 100 - SLACK) * HASHES))
    first = np.concatenate([np.zeros(0, np.int64)] + [
        (s[x[i : i + 10_000]] == t[y[i : i + 10_000]]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) for i in range(0, len(x), 10_000)
    ])
    own = first == one.band.iat[0]
    x, y = x[own], y[own]
    order = np.argsort(-same[x, y], kind="stable")
    return x[order], y[order]


def _unit_links(one: pd.DataFrame, two: pd.DataFrame, similarity: int) -> list[tuple[bytes, bytes]]:
    """Links that join the components of two blocks' nodes."""
    parent: dict[bytes, bytes] = {}

    def top(n: bytes) -> bytes:
        while (up := parent.get(n, n)) != n:
            parent[n] = n = parent.get(up, up)
        return n

    links = []
    c, d = one.component.to_numpy(), two.component.to_numpy()
    a, b = one.hashes.to_numpy(), two.hashes.to_numpy()
    for x, y in zip(*(i.tolist() for i in _unit_pairs(one, two, similarity))):
        u, v = top(c[x]), top(d[y])
        if u != v:
            both = np.intersect1d(a[x], b[y], assume_unique=True).size
            if 100 * both >= similarity * (a[x].size + b[y].size - both):
                parent[u] = v
                links.append((one.node.iat[x], two.node.iat[y]))
    return links


UNIT = ["band", "bucket", "i", "j"]


def _by_unit(units: DataFrame, bins: int, what, schema: str) -> DataFrame:
    """``what(left rows, right rows)`` for each unit, many units in a group."""

    def each(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, unit in group.groupby(UNIT, sort=False):
            side = unit.left.to_numpy()
            if side.any() and not side.all():
                found += what(unit[side], unit[~side])
        return pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])

    return units.groupBy(F.pmod(F.xxhash64(*UNIT), F.lit(bins))).applyInPandas(each, schema)


def _rest(labelled: DataFrame, sets_of, nodes: DataFrame, similarity: int) -> DataFrame:
    """Links between the components that share a bucket, but for those known.
    ``labelled``: band, bucket, node, component; ``sets_of`` gives nodes' sets."""
    counted = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    mixed = counted.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("m"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("parts"))
    # in a bucket of two nodes one is the pivot
    mixed = mixed.where("parts > 1 and n > 2").select("bucket", F.col("m.component").alias("main"), "n", (F.col("n") - F.col("m.k")).alias("n_minor"))
    members = written(labelled.join(written(mixed, "mixed_buckets"), "bucket").withColumn("minor", F.col("component") != F.col("main")), "mixed_members")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    what = ["band", "bucket", "node", "component"]
    left = members.where("minor").select(*what, place("n_minor").alias("i"), upto("n").alias("j"), F.lit(True).alias("left"))
    right = members.select(*what, place("n").alias("j"), upto("n_minor").alias("i"), F.lit(False).alias("left"))
    units = left.unionByName(right)
    bins = max(1, -(-units.count() // UNIT_ROWS))
    columns = "band int, bucket long, i int, j int, left boolean, node binary, component binary"

    def promising(one: pd.DataFrame, two: pd.DataFrame) -> list[tuple]:
        x, y = _unit_pairs(one, two, similarity)
        key = tuple(one[UNIT].iloc[0])
        return [(*key, left, n, c) for side, at, left in ((one, x, True), (two, y, False)) for n, c in side[["node", "component"]].iloc[np.unique(at)].itertuples(index=False)]

    signed = units.join(nodes.select("node", "signature"), "node")
    close = written(_by_unit(signed, bins, promising, columns), "close_nodes")
    own = written(nodes.join(close.select("node").distinct(), "node", "left_semi").select("doc_id", "node", "signature"), "close_sets")
    full = own.select("node", "signature").join(sets_of(own), "node")
    bins = max(1, -(-close.count() * 4 // UNIT_ROWS))
    return _by_unit(close.join(full, "node"), bins, lambda one, two: _unit_links(one, two, similarity), "u binary, v binary")


def near_duplicate_components(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, width: int, similarity: int) -> DataFrame:
    """(node, component) for the nodes (doc_id, node, n_shingles, signature) that are linked."""

    def sets_of(some: DataFrame) -> DataFrame:
        return _sets(docs, some.select("doc_id", "node"), doc_id, text, width)

    buckets = _buckets(nodes)
    order = F.struct(F.xxhash64("node").alias("h"), "node", "n_shingles")
    pivots = buckets.groupBy("bucket").agg(F.min(order).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(buckets.join(written(pivots.select("bucket", F.col("p.node").alias("pivot"), F.col("p.n_shingles").alias("pivot_size")), "pivots"), "bucket"), "bucket_members")

    # sets whose sizes differ too much cannot be similar enough
    smaller, larger = F.least("n_shingles", "pivot_size"), F.greatest("n_shingles", "pivot_size")
    pairs = members.where((F.col("node") != F.col("pivot")) & (100 * smaller >= similarity * larger)).select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    pairs = written(_promising(pairs, nodes, similarity), "promising_pairs")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    links = written(_confirmed(pairs, sets_of(nodes.join(ends, "node", "left_semi")), similarity), "links")
    known = written(connected_components(links), "components_so_far")
    labelled = members.select("band", "bucket", "node").join(known, "node", "left").select("band", "bucket", "node", F.coalesce("component", "node").alias("component"))
    more = _rest(written(labelled, "labelled_members"), sets_of, nodes, similarity)
    # the stars so far stand for the links so far
    stars = known.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return connected_components(stars.union(more))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest doc_id reachable over links, its own included) and kept (doc_id =
    component_id).

    Sets are linked if 100 * intersection >= ``similarity`` * union; words are
    runs without white space, with A-Z in lower case. Null, empty and blank
    texts have no shingles and are linked with nothing. A null doc_id counts
    as larger than every other. Repeated rows are equal sets and so one group;
    rows that share the smallest doc_id are all kept. Further columns are
    ignored; an empty table gives an empty result.
    """
    if not 80 <= similarity <= 100:
        raise ValueError("the bands are made for similarities of 80 to 100")
    rows = written(sketches(docs, doc_id, text, width), "sketches")
    grouped = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("n"))
    nodes = written(grouped, "nodes")
    components = written(near_duplicate_components(docs, nodes.drop("n"), doc_id, text, width, similarity), "components")
    own = nodes.drop("signature").join(components, "node", "left").select("node", "doc_id", "n", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("linked"))
    own = written(own.where("linked or n > 1"), "shared_nodes")
    least = written(own.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component_ids")
    labels = written(own.join(least, "component").select("node", "component_id"), "node_labels")
    label = F.coalesce("component_id", "doc_id")
    return rows.join(labels, "node", "left").select("doc_id", "n_shingles", label.alias("component_id"), label.eqNullSafe(F.col("doc_id")).alias("kept"))
