"""Near-duplicate documents by b-bit MinHash.

One pass turns each text into its set of distinct five-word shingles, its minima under ``HASHES``
hash functions, the low bits of those minima packed in bit planes, and one key per band of the first ones. Equal sets
are one node from then on. Nodes that share a band key are candidates; the packed signatures
estimate their similarity by bit counts, corrected for chance collisions, and pairs that may reach the
limit are confirmed on their full sets.

Pairs are never emitted for a whole bucket. In a few rounds each member meets only the bucket's
hub, the member that shares buckets with most others, and linked ones become one component; buckets of one component
are done. Only in buckets that still hold several components, pairs across components that pass the
estimate leave the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pataspark.llm.common import WordHashes, mix64, shared_table

SHINGLE = 5
# A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
# A pair at the limit meets in no band with probability (1 - 0.75 ** 4) ** 48 = 1.2e-8.
BANDS, ROWS = 48, 4
HASHES, BITS = 512, 4
# About 3.7 standard deviations of the estimate from 512 minima at a similarity of 0.75.
MARGIN = 0.075
# Rounds in which a bucket's members meet one member only, before the pairs that are still open.
HUB_ROUNDS = 3

_PLANE_LONGS = HASHES // 64
_PLANES = [f"p{i}" for i in range(BITS * _PLANE_LONGS)]
_SIGNATURES = "doc_id long, n_shingles long, s1 long, s2 long, planes array<long>, keys array<long>"


def _odd_numbers(n: int, seed: int, kind: type) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, np.iinfo(kind).max, n, dtype=kind) | kind(1)


_FACTORS = _odd_numbers(SHINGLE, 11, np.uint64)
_A = _odd_numbers(HASHES, 12, np.uint32)
_B = np.random.default_rng(13).integers(0, 2**32, HASHES, dtype=np.uint32)
_KEY_FACTORS = _odd_numbers(ROWS, 14, np.uint64)
# Shingles hashed at a time: the table of hashes stays in the processor's cache.
_BLOCK = 64


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = hashes.array(words, n)
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            whole = np.uint64(n)
            for i in range(n):
                whole = mix64(np.atleast_1d(whole * _FACTORS[i] + h[i]))[0]
            return np.array([whole], np.uint64)
        s = h[: n - SHINGLE + 1] * _FACTORS[0]
        for i in range(1, SHINGLE):
            s += h[i: n - SHINGLE + 1 + i] * _FACTORS[i]
        return np.unique(mix64(s))


def _minima(s: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    hashed = np.empty((_BLOCK, HASHES), np.uint32)
    for i in range(0, len(low), _BLOCK):
        some = hashed[: len(low) - i]
        np.multiply(low[i: i + _BLOCK], _A, out=some)
        np.add(some, _B, out=some)
        np.minimum(best, some.min(axis=0), out=best)
    return best


def _signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the minima's low bits, and one key per band."""
    mixed = mix64(_minima(s).astype(np.uint64))
    planes = [np.packbits(((mixed >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)).view(np.int64) for b in range(BITS)]
    keys = mix64((mixed[: BANDS * ROWS].reshape(BANDS, ROWS) * _KEY_FACTORS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return np.concatenate(planes), keys.view(np.int64)


def _told_apart(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    with np.errstate(over="ignore"):
        return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    none = np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        for batch in batches:
            sizes, first, second, planes, keys = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, hashes)
                sizes.append(len(s))
                one, two = _told_apart(s)
                first.append(one)
                second.append(two)
                p, k = _signature(s) if len(s) else (none, none)
                planes.append(p)
                keys.append(k)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                pa.array(planes, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "s1", "s2", "planes", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(t, hashes) for t in batch.column("text").to_pylist()]
        told = [_told_apart(s) for s in sets]
        yield pa.RecordBatch.from_arrays([
            batch.column("node"), pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told], pa.int64()),
            pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "s1", "s2", "shingles"])


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, number and two hashes of the shingle set, packed signature, band keys; one row per row."""
    return _documents(docs).mapInArrow(_sign, _SIGNATURES)


def estimated_similarity(a: str, b: str) -> Column:
    """Share of equal minima, from bit counts over the planes, corrected for b-bit collisions."""
    unequal = F.lit(0)
    for word in range(_PLANE_LONGS):
        differ = None
        for plane in range(BITS):
            name = _PLANES[plane * _PLANE_LONGS + word]
            x = F.col(f"{a}.{name}").bitwiseXOR(F.col(f"{b}.{name}"))
            differ = x if differ is None else differ.bitwiseOR(x)
        unequal = unequal + F.bit_count(differ)
    equal, chance = 1 - unequal / float(HASHES), 2.0 ** -BITS
    return (equal - chance) / (1 - chance)


def _may_link(a: str, b: str, percent: int) -> Column:
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (100 * small >= percent * large) & (estimated_similarity(a, b) >= percent / 100 - MARGIN)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (u, v, more) whose full shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b")).cast("long")
    return (pairs.join(left, "u").join(right, "v")
            .filter(100 * both >= percent * (F.size("a") + F.size("b") - both)).select(*pairs.columns))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node that has an edge (node, component).

    Every round joins each node's neighbours to the smallest one, on both sides; the rows stay
    as many as the edges. A node with very many neighbours is a skewed join key, which adaptive execution splits.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())

    stars = shared_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                         .filter("u <> v").distinct())
    before = state(stars)
    while True:
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v"), F.col("m"))
                 .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least)).distinct()
        stars = shared_table(small)
        after = state(stars)
        if after == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after


def _relabelled(df: DataFrame, changes: list[DataFrame]) -> DataFrame:
    """The column ``component`` after each of the changes (node, component), which hold only what has changed."""
    for change in changes:
        new = change.select(F.col("node").alias("component"), F.col("component").alias("_new"))
        df = df.join(new, "component", "left").withColumn("component", F.coalesce("_new", "component")).drop("_new")
    return df


def _open(held: DataFrame) -> DataFrame:
    """Members of buckets with several components: also rows in all, rows of their own component, and the largest component."""
    own = held.groupBy("key", "component").agg(F.count("*").alias("own"))
    several = (own.groupBy("key").agg(F.sum("own").alias("total"), F.max_by("component", F.struct("own", "component")).alias("largest"), F.count("*").alias("n"))
               .filter("n > 1").drop("n"))
    return held.join(several, "key").join(own, ["key", "component"])


def _hubs(met: DataFrame) -> DataFrame:
    """For each bucket the member that shares buckets with most nodes of other components (key, hub).

    The common origin of a group shares more buckets with its copies than these with each other, whatever the ids. Members that were
    hubs of the bucket before, and those of its largest component, stand back.
    """
    mates = met.groupBy("node").agg(F.sum(F.col("total") - F.col("own")).alias("mates"))
    rest = met.filter(~F.col("used") & (F.col("largest").isNull() | (F.col("component") != F.col("largest"))))
    return rest.join(mates, "node").groupBy("key").agg(F.max_by(F.struct("node", "component"), F.struct("mates", F.xxhash64("node"))).alias("hub"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Component of near-duplicate documents for every row: doc_id, n_shingles, component_id, kept.

    ``n_shingles`` is the size of the set. Texts that are null, empty or white space have an
    empty set and are linked with nothing. Equal sets are linked, whatever the texts. Rows with the same doc_id are one
    document with the links of all its texts. A row without doc_id is linked with nothing: its component is null and it
    is kept. Other columns are not read. An empty table gives no rows.
    """
    signed = shared_table(signatures(docs))
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    nodes = shared_table(signed.filter(~alone).groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("node")))
    unique = (signed.join(nodes.withColumnRenamed("node", "doc_id"), ["s1", "s2", "n_shingles", "doc_id"])
              .dropDuplicates(["s1", "s2", "doc_id"]).withColumnRenamed("doc_id", "node"))
    unique = shared_table(unique.select("node", F.col("n_shingles").alias("n"), "keys", *[
        F.get("planes", F.lit(i)).alias(p) for i, p in enumerate(_PLANES)]))
    planes = unique.select("node", "n", *_PLANES)

    entries = unique.select("node", F.posexplode("keys").alias("band", "key"))
    shared_keys = entries.groupBy("key").agg(F.count("*").alias("total")).filter("total > 1")
    members = shared_table(entries.join(shared_keys, "key"))

    sought = shared_table(members.select("node").distinct())
    text_rows = _documents(docs).withColumnRenamed("doc_id", "node").join(sought, "node", "left_semi")
    # One set per node and text, however often its row is repeated.
    sets = shared_table(text_rows.mapInArrow(_sets, "node long, s1 long, s2 long, shingles array<long>").dropDuplicates(["node", "s1", "s2"]))

    met = members.withColumns({"own": F.lit(1), "largest": F.lit(None).cast("long"), "component": F.col("node"), "used": F.lit(False)})
    merged = []
    for _ in range(HUB_ROUNDS):
        hubs = _hubs(met)
        held = shared_table(met.join(hubs, "key", "left").select(
            "key", "band", "node", "component", (F.col("used") | F.coalesce(F.col("node") == F.col("hub.node"), F.lit(False))).alias("used"), "hub"))
        stars = (held.filter(F.col("component") != F.col("hub.component"))
                 .groupBy(F.col("node").alias("u"), F.col("hub.node").alias("v")).agg(F.first("component").alias("cu"), F.first("hub.component").alias("cv")))
        stars = (stars.join(planes.alias("a"), F.col("u") == F.col("a.node")).join(planes.alias("b"), F.col("v") == F.col("b.node"))
                 .filter(_may_link("a", "b", percent)).select("u", "v", "cu", "cv").distinct())
        merged.append(components(confirmed(stars, sets, percent).select(F.col("cu").alias("u"), F.col("cv").alias("v"))))
        held = _relabelled(held.drop("hub"), merged[-1:])
        met = shared_table(_open(held))

    open_buckets = shared_table(met.select("key", "band", "node", "component", "largest").join(unique, "node"))
    a, b = open_buckets.alias("a"), open_buckets.alias("b")
    across = (F.col("a.component") != F.col("b.component")) & (F.col("a.component") != F.col("a.largest"))
    once = (F.col("b.component") == F.col("b.largest")) | (F.col("a.node") < F.col("b.node"))
    # A pair counts in the first band it shares, where all its buckets are open.
    earlier = F.arrays_overlap(F.slice("a.keys", F.lit(1), F.col("a.band")), F.slice("b.keys", F.lit(1), F.col("b.band")))
    pairs = (a.join(b, (F.col("a.key") == F.col("b.key")) & across & once & _may_link("a", "b", percent) & ~earlier)
             .groupBy(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v"))
             .agg(F.min(F.least("a.component", "b.component")).alias("cu"), F.max(F.greatest("a.component", "b.component")).alias("cv")))
    merged.append(components(confirmed(pairs, sets, percent).select(F.col("cu").alias("u"), F.col("cv").alias("v"))))
    # A doc_id with several texts ties their nodes together.
    placed = shared_table(_relabelled(signed.filter(~alone).select("doc_id", "s1", "s2", "n_shingles")
                                      .join(nodes, ["s1", "s2", "n_shingles"]).select("doc_id", "n_shingles", F.col("node").alias("component")), merged))
    again = placed.groupBy("doc_id").agg(F.min("component").alias("v"), F.max("component").alias("last")).filter("v < last")
    ties = components(placed.join(again, "doc_id").select(F.col("component").alias("u"), "v"))

    of_rows = _relabelled(placed, [ties]).select("doc_id", "n_shingles", "component")
    rest = signed.filter(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return of_rows.union(rest).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
