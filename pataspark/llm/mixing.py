"""Mixing sources to target weights by systematic sampling. Only DataFrame functions.

Within a source, each document's expected copies are summed up in a fixed order, one random offset
is added, and a copy is emitted for every whole number the running sum crosses.

The order is by size class and hash, so the words taken follow the target closely. The running sum is taken in two levels: cells of
(source, size class, hash) are added up first, and only rows of one cell meet in a window; a source with a
third of all rows is spread over all its cells. Everything is counted in whole units, so reruns agree exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pataspark.llm.common import md5_number, packed, shared_table, words_of

# Weights by the order of the sources' names, repeating; no source is taken more than MAX_REPEAT times.
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
# One expected copy in whole units.
UNIT_BITS = 20
# Hash cells per source and size class.
CELL_BITS = 8
SEED = "mix-1"


def size_class(size: Column) -> Column:
    """Sizes in steps of an eighth of a power of two: number of binary digits and the next three digits."""
    digits = F.bin(size)
    return F.concat(F.lpad(F.length(digits).cast("string"), 3, "0"), F.substring(digits, 2, 3))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Words to take from each source (_source, source_size, target).

    ``sizes`` has one row per source (_source, source_size). Shares follow the weights; a source stops at ``max_repeat`` times its size, and the
    excess goes to the others by weight. Sorted by capacity per weight, the sources that stop are a
    prefix, so one running sum solves it. The windows hold one row per source.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    table = F.array(*[F.lit(w) for w in weights])
    df = sizes.withColumn("weight", F.get(table, (F.row_number().over(by_name) - 1) % len(weights)).cast("long"))
    df = df.withColumn("limit", F.lit(max_repeat) * F.col("source_size"))
    by_room = Window.orderBy(F.col("limit") / F.col("weight"), F.col("_source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    df = df.withColumn("level", left / F.sum("weight").over(after))
    df = df.withColumn("stops", F.col("level") * F.col("weight") >= F.col("limit"))
    free = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(everything)
    return df.select("_source", "source_size", F.when(F.col("stops"), F.col("limit").cast("double"))
                     .otherwise(free * F.col("weight")).alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("_text"), F.lit(""))
    df = packed(docs, "doc_id", "text", "source").withColumn("_size", F.size(words_of(text)).cast("long"))
    name = F.concat_ws(":", F.coalesce(F.col("_doc_id").cast("string"), F.lit("")), F.md5(text))
    return (df.withColumn("_hash", F.md5(name)).withColumn("_class", size_class(F.col("_size")))
            .withColumn("_cell", F.substring("_hash", 1, CELL_BITS // 4))
            .withColumns({"_name": F.coalesce("_source", F.lit("")), "_unnamed": F.col("_source").isNull()}).drop("_text", "_doc_id"))


def planned_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """Rows as ``_row`` with ``_size`` (words), ``source_size``, ``target`` (both of the source) and ``copies``.

    A null source is a source of its own, the last one. Null or empty texts have size 0 and are sampled like others, which takes no words. Equal rows
    are separate documents whose results may be swapped among them. An empty table gives no rows.
    """
    sized = _sized(docs)
    cells = shared_table(sized.groupBy("_source", "_class", "_cell").agg(F.count("*").alias("rows"), F.sum("_size").alias("words")))
    targets = source_targets(cells.groupBy("_source").agg(F.sum("words").alias("source_size")), weights, max_repeat)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("units", F.floor(rate * F.lit(float(2**UNIT_BITS)) + F.lit(0.5)).cast("long"))
    earlier = Window.partitionBy("_source").orderBy("_class", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("earlier", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).alias("c").join(
        targets.alias("t"), F.col("c._source").eqNullSafe(F.col("t._source"))).select(
        F.coalesce("c._source", F.lit("")).alias("_name"), F.col("c._source").isNull().alias("_unnamed"), "_class", "_cell", "source_size", "target", "units",
        (offset_of("c._source", seed) + F.col("earlier") * F.col("units")).alias("start"))
    # The window and the join have the same keys, none of them null, so whole rows are shuffled once.
    keys = ["_name", "_unnamed", "_class", "_cell"]
    inside = Window.partitionBy(*keys).orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.select("_row", "_size", *keys, F.count("*").over(inside).alias("_place"))
    df = placed.join(shared_table(cells), keys)
    reached = F.col("start") + F.col("units") * F.col("_place")
    df = df.withColumn("_reached", reached)
    return df.select("_row", "_size", "source_size", "target", (
        F.shiftright("_reached", UNIT_BITS) - F.shiftright(F.col("_reached") - F.col("units"), UNIT_BITS)).alias("copies"))


def offset_of(source: str, seed: str) -> Column:
    """Random start of a source, below one expected copy."""
    return md5_number(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(source), F.lit(""))), UNIT_BITS)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of the input."""
    plan = planned_copies(docs, weights, max_repeat, seed).filter("copies > 0")
    rows = plan.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
