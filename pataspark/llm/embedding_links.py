"""Near-duplicate embeddings: an exact metric range join on unit vectors.

A cosine of at least ``COSINE`` is a distance of at most ``RADIUS`` between unit vectors. Vectors of one label are dealt to the cells
of their nearest pivots. By the triangle inequality a vector can only have a partner in another cell if that cell's pivot is at most two radii
farther than its own, and not farther than the cell's own reach plus one radius; only there is it copied to. Of two
cells one takes the other's visitors, so each pair is compared once, and the cells join independently. A
cell of very many vectors, such as a hot group of close copies, is dealt to blocks that are compared pairwise.

Equal vectors are one class, compared once. A block emits counts and, per vector, one link into the block's groups, never
all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pataspark.llm.common import shared_table
from pataspark.llm.minhash import components

COSINE = 0.93
RADIUS = math.sqrt(2 - 2 * COSINE)
# Cells per label: one for every CELL classes, up to PIVOTS; their choice decides the cost, not the result.
CELL, PIVOTS = 256, 32
# A label's vectors are dealt to their cells, and a cell's vectors compared, this many per task at most (about).
DEAL, BLOCK = 50_000, 4_096
# Visitors compared with a block at a time.
_BATCH = 1_024
# Distances are worked out in double precision and kept in single; no bound may lose a pair to rounding.
_SLACK = 1e-4


def _unit(column: pa.Array) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal keys of sorted rows, batch by batch; a run may come in several pieces, one after the other."""
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(batch), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for lo, hi in zip(starts, starts[1:]):
            yield tuple(c[lo] for c in columns), batch.slice(lo, hi - lo)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Home cell and distances to all pivots; within a group the pivots come first."""
    key = None
    for found, rows in _groups(batches, ["group", "part", "role"]):
        if key != found[:2]:
            key, pivots = found[:2], []
        units = _unit(rows.column("v"))
        if found[2] == 0:
            pivots.append(units)
            continue
        at = np.concatenate(pivots)
        distances = np.sqrt(np.maximum(0.0, 2 - 2 * (units @ at.T)))
        flat = pa.array(distances.astype(np.float32).ravel())
        yield pa.RecordBatch.from_arrays([
            rows.column("class"), rows.column("group"), rows.column("copies"), rows.column("v"), pa.array(distances.argmin(axis=1).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(at), dtype=np.int32)), flat)],
            names=["class", "group", "copies", "v", "cell", "distances"])


class _Block:
    """The residents of one block: link counts, and groups that only ever merge."""

    def __init__(self) -> None:
        self.ids, self.copies, self.units = [], [], []
        self.closed = False

    def add(self, rows: pa.RecordBatch) -> None:
        self.ids.append(rows.column("class").to_numpy())
        self.copies.append(rows.column("copies").to_numpy())
        self.units.append(_unit(rows.column("v")))

    def close(self) -> None:
        """Compare the residents with one another, once all have come."""
        self.closed = True
        if not self.ids:
            self.ids, self.copies, self.units = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((0, 1))]
        self.ids, self.copies, self.units = map(np.concatenate, (self.ids, self.copies, self.units))
        n = len(self.ids)
        self.groups, self.counts = np.arange(n), np.zeros(n, np.int64)
        for lo in range(0, n, _BATCH):
            hits = self.units @ self.units[lo: lo + _BATCH].T >= COSINE
            hits[np.arange(lo, min(n, lo + _BATCH)), np.arange(hits.shape[1])] = False
            rows, columns = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
            self.counts[rows] += hits[np.ix_(rows, columns)] @ self.copies[lo + columns]
            # These visitors are residents too: their own group is one of those they tie together.
            hits[lo + columns, columns] = True
            self._merge(hits)

    def meet(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Compare the residents with visitors."""
        if not len(self.ids):
            return
        ids, copies, units = rows.column("class").to_numpy(), rows.column("copies").to_numpy(), _unit(rows.column("v"))
        for lo in range(0, len(ids), _BATCH):
            hits = self.units @ units[lo: lo + _BATCH].T >= COSINE
            residents, some = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
            if len(some):
                found = hits[np.ix_(residents, some)]
                self.counts[residents] += found @ copies[lo + some]
                self._merge(hits)
                yield _found(ids[lo + some], self.copies[residents] @ found, self.ids[residents[found.argmax(axis=0)]])

    def _merge(self, hits: np.ndarray) -> None:
        """Put the groups that a column of hits ties together under their least number."""
        rows = np.flatnonzero(hits.any(axis=1))
        hits = hits[rows][:, hits.any(axis=0)]
        n = len(self.groups)
        while len(rows):
            mine = self.groups[rows][:, None]
            least = np.where(hits, mine, n).min(axis=0)
            lower = np.where(hits, least[None, :], n).min(axis=1)
            under = np.arange(n)
            np.minimum.at(under, self.groups[rows], lower)
            if (under == np.arange(n)).all():
                break
            while (under[under] != under).any():
                under = under[under]
            self.groups = under[self.groups]

    def finish(self) -> Iterator[pa.RecordBatch]:
        if not self.closed:
            self.close()
        some = (self.counts > 0) | (self.groups != np.arange(len(self.ids)))
        yield _found(self.ids[some], self.counts[some], self.ids[self.groups[some]])


def _found(ids: np.ndarray, links: np.ndarray, partners: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(partners, pa.int64())], names=["class", "links", "partner"])


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links found in each block; its residents come first, then visitors as a stream."""
    key, block = None, None
    for found, rows in _groups(batches, ["group", "cell", "block", "role"]):
        if key != found[:3]:
            if block:
                yield from block.finish()
            key, block = found[:3], _Block()
        if found[3] == 0:
            block.add(rows)
        else:
            if not block.closed:
                block.close()
            yield from block.meet(rows)
    if block:
        yield from block.finish()


def _in_key_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key in one task, those of the lesser role first.

    A row is few bytes and much work, so the number of tasks is the session's, not one made from the bytes.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, "role")


def _classes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the hash of their label and vector (null where it links with nothing), and one class per distinct vector."""
    number = F.col("embedding").cast("array<double>")
    sound = F.forall(number, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)) & F.exists(number, lambda c: c != 0)
    sound = F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    told = [F.xxhash64(F.lit(seed), "label", "embedding") for seed in (1, 2)]
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, told[0]).alias("h1"), F.when(sound, told[1]).alias("h2"),
        F.when(sound, F.struct(F.col("label").cast("string").alias("label"), F.size("embedding").alias("length"))).alias("kind"), F.when(sound, F.col("embedding")).alias("v"))
    classes = rows.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("node"), F.first("kind").alias("kind"), F.first("v").alias("v"))
    return rows.select("vec_id", "h1", "h2"), classes


def linked_vectors(embeddings: DataFrame) -> DataFrame:
    """Direct links and component of every vector: vec_id, n_links, component_id, kept; one row per row.

    Vectors are linked where labels are equal and not null and their cosine, in double precision, is at least ``COSINE``.
    ``n_links`` counts the other rows linked directly; repeated rows count each. Vectors that are null, empty, zero, or hold null or
    non-finite entries link with nothing, and so do those of different lengths. Rows with the same vec_id are one vector with
    the links of all when components are found. A row without vec_id is linked with nothing: its component is null and it is kept. Other columns are
    not read. An empty table gives no rows.
    """
    rows, classes = _classes(embeddings)
    # Classes are told apart by 128 bits and named by 64 of them.
    classes = shared_table(classes.withColumn("class", F.col("h1")))
    kinds = shared_table(classes.groupBy("kind").agg(F.count("*").alias("size")).withColumn("group", F.xxhash64("kind")))
    numbered = classes.join(kinds, "kind").select("class", "group", "copies", "size", "v")

    order = Window.partitionBy("group").orderBy("class")
    cells = F.least(F.lit(PIVOTS), F.ceil(F.col("size") / CELL))
    parts = F.ceil(F.col("size") / DEAL)
    pivots = numbered.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS).filter(F.col("place") <= cells)
    role = F.lit(0).alias("role")
    dealt = pivots.select("class", "group", "copies", "v", role, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")).union(
        numbered.select("class", "group", "copies", "v", F.lit(1), F.pmod(F.col("class"), parts)))
    placed = shared_table(_in_key_order(dealt, ["group", "part"]).mapInArrow(
        _deal, "class long, group long, copies long, v " + classes.schema["v"].dataType.simpleString() + ", cell int, distances array<float>"))

    reach = placed.groupBy("group", "cell").agg(F.count("*").alias("size"), F.max(F.get("distances", "cell")).alias("reach"))
    held = shared_table(reach.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("cell"), F.struct("reach", F.ceil(F.col("size") / BLOCK).alias("blocks"))))).alias("cells")))
    bounded = placed.join(held, "group")
    own = F.get("distances", "cell")

    def visited(cell):
        there = F.try_element_at("cells", cell)
        away = F.get("distances", cell)
        # Of two cells, an even sum of numbers makes the larger one host, an odd one the smaller.
        host = F.when((cell + F.col("cell")) % 2 == 0, cell > F.col("cell")).otherwise(cell < F.col("cell"))
        return host & there.isNotNull() & (away <= own + 2 * RADIUS + _SLACK) & (away <= there["reach"] + RADIUS + _SLACK)
    others = F.filter(F.sequence(F.lit(0), F.size("distances") - 1), visited)
    home_blocks = F.try_element_at("cells", F.col("cell"))["blocks"]
    home = F.pmod(F.xxhash64("class", F.lit(3)), home_blocks)
    # A visitor meets every block of the cell; residents also visit the later blocks of their own cell.
    places = F.concat(
        F.array(F.struct(F.col("cell").alias("cell"), home.alias("block"), F.lit(0).alias("role"))),
        F.transform(F.filter(F.sequence(F.lit(0).cast("long"), home_blocks - 1), lambda b: b > home), lambda b: F.struct(F.col("cell").alias("cell"), b.alias("block"), F.lit(1).alias("role"))),
        F.flatten(F.transform(others, lambda c: F.transform(F.sequence(F.lit(0).cast("long"), F.try_element_at("cells", c)["blocks"] - 1), lambda b: F.struct(c.alias("cell"), b.alias("block"), F.lit(1).alias("role"))))))
    sent = bounded.select("class", "group", "copies", "v", F.explode(places).alias("to")).select("class", "group", "copies", "v", "to.*")
    found = shared_table(_in_key_order(sent, ["group", "cell", "block"]).mapInArrow(_join_blocks, "class long, links long, partner long"))

    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    owners = classes.select("class", "h1", "h2", "node", "copies")
    ends = found.filter("class <> partner").select("class", "partner").distinct()
    nodes = owners.select(F.col("class"), F.col("node"))
    edges = ends.join(nodes, "class").withColumnRenamed("node", "u").join(nodes.select(F.col("class").alias("partner"), F.col("node").alias("v")), "partner").select("u", "v")
    # Rows of one vec_id tie the classes of their vectors together.
    with_class = shared_table(rows.join(owners.join(links, "class", "left").drop("class"), ["h1", "h2"], "left"))
    again = with_class.filter("node IS NOT NULL AND vec_id <> node").select(F.col("vec_id").alias("u"), F.col("node").alias("v"))
    several = with_class.filter("node IS NOT NULL").groupBy("vec_id").agg(F.min("node").alias("least"), F.max("node").alias("last")).filter("least < last").select(F.col("vec_id").alias("u"))
    labels = components(edges.union(again.join(several, "u", "left_semi")))
    named = with_class.withColumn("at", F.coalesce("node", "vec_id")).join(labels.withColumnRenamed("node", "at"), "at", "left")
    component = F.coalesce("component", "at")
    return named.select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
