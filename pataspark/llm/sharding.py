"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are first dealt to logical parts by hash. How many rows each part sends to each shard is drawn
from the exact law of a uniform shuffle (a multivariate hypergeometric draw without replacement). Each part
then permutes its rows and cuts them at those counts, rows move to their shards, and
each shard permutes again. Shards differ by one row at most.

Only one count per part and the matrix (parts x shards numbers) pass through the driver; both are
fixed in size. Every step depends on hashes of the rows, not on how Spark split
the input, so a repeated task or a rerun gives the same shards.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from pataspark.llm.common import packed, shared_table, unpacked

SHARDS = 24
# Logical parts on the sending side, and per shard on the receiving side.
PARTS, SLOT_PARTS = 1024, 256
SEED = 20240


def hypergeometric(good: int, bad: int, drawn: int, u: float) -> int:
    """Number of good ones among ``drawn`` without replacement: the quantile at ``u``.

    The law is summed from ratios of neighbouring terms over 12 standard deviations about its mode, which
    holds for populations of any size.
    """
    total = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    share = good / total
    spread = math.ceil(12 * math.sqrt(drawn * share * (1 - share) * max(1, total - drawn) / max(1, total - 1))) + 20
    low, high = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    law = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(law, u * law[-1], side="right")), high - low)


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each part sends to each shard; shard sizes differ by one at most."""
    total, rng = sum(rows), np.random.default_rng(seed)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in rows:
        line, free = [], sum(room)
        for s in range(shards):
            take = hypergeometric(room[s], free - room[s], n, float(rng.random()))
            free -= room[s]
            n -= take
            line.append(take)
        room = [r - t for r, t in zip(room, line, strict=True)]
        matrix.append(line)
    return matrix


def shuffled_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, parts: int = PARTS) -> DataFrame:
    """Every row with ``shard`` (from 0) and ``slot`` (its place in the shard, from 0 without gaps).

    Rows are told apart by doc_id and text; both may be null. Equal rows are separate rows, whose
    slots may be swapped among them. With fewer rows than shards some shards stay empty; an empty table gives no rows. Columns named
    shard or slot are replaced.
    """
    text = F.coalesce(F.col("_text").cast("string"), F.lit(""))
    hashed = packed(docs, "doc_id", "text").select("_row", *[
        F.xxhash64(F.lit(seed), F.lit(k), F.col("_doc_id"), F.col("_text").isNull(), text).alias(f"_h{k}") for k in range(3)])
    hashed = hashed.withColumn("_part", F.pmod("_h0", F.lit(parts)).cast("int"))
    counts = dict(tuple(r) for r in hashed.groupBy("_part").agg(F.count("*")).collect())  # one number per part
    filled = sorted(counts)
    matrix = communication_matrix([counts[p] for p in filled], shards, seed)
    ends = [(p, np.cumsum(line).tolist()) for p, line in zip(filled, matrix, strict=True)]
    ends = docs.sparkSession.createDataFrame(ends, "_of int, _ends array<long>")

    # Permute inside the part and cut at the drawn counts. ``ends`` has one row per part.
    mine = Window.partitionBy("_part").orderBy("_h1", "_h2")
    sent = (hashed.withColumn("_rank", F.row_number().over(mine))
            .join(F.broadcast(ends), F.col("_part") == F.col("_of"))
            .select("_row", "_h1", "_h2", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).alias("_shard"))
            .withColumn("_slot_part", F.pmod("_h2", F.lit(SLOT_PARTS)).cast("int")))

    # Permute inside the shard: slot parts in order, then by hash inside each.
    sent = shared_table(sent)
    earlier = Window.partitionBy("_shard").orderBy("_slot_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sent.groupBy("_shard", "_slot_part").agg(F.count("*").alias("_n"))
              .select("_shard", "_slot_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("_shard", "_slot_part").orderBy("_h2", "_h1")
    df = (sent.withColumn("_at", F.row_number().over(inside)).join(F.broadcast(starts), ["_shard", "_slot_part"])
          .withColumn("_slot", F.col("_start") + F.col("_at") - 1))
    return unpacked(df, docs.columns, shard=F.col("_shard"), slot=F.col("_slot"))
