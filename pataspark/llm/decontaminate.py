"""Benchmark decontamination by spaced seeds.

Fixed masks over the words choose which positions are hashed; the others may differ. Hashes of all
documents and of all benchmark items meet in a join, and around each hit the overlap of document and item is verified
on the same diagonal, with substituted words counted against it.

A Bloom filter of fixed size over the benchmark's hashes keeps document positions that cannot hit out of
the shuffle. It only saves work: what passes is joined and verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pataspark.llm.common import WordHashes, mix64, packed, shared_table, unpacked, word_bytes

# 1: the word counts, 0: it may differ. Eight words count in each mask.
MASKS = ("11101101011", "11010111011", "10111011101")
# Around a hit: a match counts 1, a substitution costs 2; the best stretch must reach both limits.
SUBSTITUTION, MIN_MATCHES, MIN_SHARE = 2, 10, 0.7
# Words beside a stretch of hits that are compared as well.
CONTEXT = 64
BLOOM_BITS = 24

_SPAN = len(MASKS[0])
_FACTORS = np.random.default_rng(21).integers(0, 2**63, (len(MASKS), _SPAN), dtype=np.uint64) | np.uint64(1)
_SEEDS = "item long, place int, seed long"
_ITEMS = "item long, words array<long>"
_RUNS = "id long, content long, run int, first int, words array<long>, places array<int>, seeds array<long>"


def spaced_seeds(h: np.ndarray) -> np.ndarray:
    """Seed per mask and position (masks x positions) from word hashes."""
    n = len(h) - _SPAN + 1
    if n <= 0:
        return np.empty((len(MASKS), 0), np.uint64)
    seeds = np.zeros((len(MASKS), n), np.uint64)
    for m, mask in enumerate(MASKS):
        for i, used in enumerate(mask):
            if used == "1":
                seeds[m] += h[i: i + n] * _FACTORS[m, i]
    return mix64(seeds)


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """(matches, length) of the stretch with the best score; of equal scores, the one that ends first."""
    score = best = begin = 0
    found = (0, 0)
    for i, e in enumerate(equal):
        if score <= 0:
            score, begin = 0, i
        score += 1 if e else -SUBSTITUTION
        if score > best:
            best, found = score, (begin, i + 1)
    a, b = found
    return int(equal[a:b].sum()), b - a


def overlap(words: np.ndarray, first: int, item: np.ndarray, diagonal: int) -> tuple[int, int]:
    """Best stretch between an item and document words from place ``first`` on, item word j at place diagonal + j."""
    a, b = max(first, diagonal), min(first + len(words), diagonal + len(item))
    return best_stretch(words[a - first: b - first] == item[a - diagonal: b - diagonal]) if a < b else (0, 0)


def _bloom_places(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << BLOOM_BITS) - 1)
    return (seeds & low).astype(np.int64), ((seeds >> np.uint64(32)) & low).astype(np.int64)


def _benchmark_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for item, words in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist(), strict=True):
                s = spaced_seeds(np.array(words, np.int64).view(np.uint64))
                n = s.shape[1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(s.size, item, np.int64)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(MASKS))),
                    pa.array(s.reshape(-1).view(np.int64))], names=["item", "place", "seed"])


def _benchmark_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        lists = [word_bytes(t or "") for t in batch.column("text").to_pylist()]
        words = [hashes.array(w, len(w)).view(np.int64) for w in lists]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(words, pa.list_(pa.int64()))], names=["item", "words"])


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Items with the hashes of their words; equal items count once, under the smallest id.

    Items without an id and items of fewer than 11 words, the span of a mask, are not searched.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text")).filter("item is not null")
    words = rows.mapInArrow(_benchmark_words, _ITEMS).filter(F.size("words") >= _SPAN)
    return words.groupBy("words").agg(F.min("item").alias("item"))


def _bloom(seeds: DataFrame) -> np.ndarray:
    """Bits of all seeds. The driver gets at most 2 ** (BLOOM_BITS - 6) numbers, however many the seeds are."""
    mask = (1 << BLOOM_BITS) - 1
    places = F.array(F.col("seed").bitwiseAND(mask), F.shiftrightunsigned("seed", 32).bitwiseAND(mask))
    rows = (seeds.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")).collect())
    words = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    for r in rows:
        words[r["word"]] = r["bits"]
    return words.view(np.uint8)


def _runs(docs: DataFrame, bloom: np.ndarray) -> DataFrame:
    """Stretches of each document around positions whose seeds may be in the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = np.unpackbits(shared.value, bitorder="little"), WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                out: dict[str, list] = {k: [] for k in ("id", "content", "run", "first", "words", "places", "seeds")}
                for i, text in enumerate(batch.column("text").to_pylist()):
                    words = word_bytes(text) if text else []
                    if len(words) < _SPAN:
                        continue
                    h = hashes.array(words, len(words))
                    seeds = spaced_seeds(h)
                    a, b = _bloom_places(seeds)
                    mask, place = np.nonzero(bits[a] & bits[b])
                    if not len(place):
                        continue
                    order = np.argsort(place, kind="stable")
                    mask, place = mask[order], place[order]
                    cuts = np.flatnonzero(np.diff(place) > CONTEXT) + 1
                    for run, (m, p) in enumerate(zip(np.split(mask, cuts), np.split(place, cuts), strict=True)):
                        first = max(0, int(p[0]) - CONTEXT)
                        out["id"].append(batch.column("doc_id")[i].as_py())
                        out["content"].append(batch.column("content")[i].as_py())
                        out["run"].append(run)
                        out["first"].append(first)
                        out["words"].append(h[first: int(p[-1]) + _SPAN + CONTEXT].view(np.int64))
                        out["places"].append(p.astype(np.int32))
                        out["seeds"].append(seeds[m, p].view(np.int64))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _content("text").alias("content"))
    return rows.mapInArrow(find, _RUNS)


def _content(name: str):
    return F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [overlap(np.array(w, np.int64), f, np.array(i, np.int64), d) for w, f, i, d in zip(
            *(batch.column(c).to_pylist() for c in ("words", "first", "item_words", "diagonal")), strict=True)]
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in ("id", "content", "item")), pa.array([m for m, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())],
            names=["id", "content", "item", "matches", "length"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: id, content (hash of the text), item, matches, length of the stretch; best per item."""
    items = shared_table(benchmark_items(benchmark))
    seeds = shared_table(items.mapInArrow(_benchmark_seeds, _SEEDS))
    runs = shared_table(_runs(docs, _bloom(seeds)))
    hits = (runs.select("id", "content", "run", F.explode(F.arrays_zip("places", "seeds")).alias("s"))
            .select("id", "content", "run", F.col("s.places").alias("at"), F.col("s.seeds").alias("seed")))
    lines = (hits.join(seeds, "seed").select("id", "content", "run", "item", (F.col("at") - F.col("place")).alias("diagonal")).distinct())
    r, x = runs.select("id", "content", "run", "first", "words").dropDuplicates(["id", "content", "run"]).alias("r"), lines.alias("x")
    pairs = (x.join(r, F.col("x.id").eqNullSafe(F.col("r.id")) & (F.col("x.content") == F.col("r.content")) & (F.col("x.run") == F.col("r.run")))
             .join(items.select("item", F.col("words").alias("item_words")), "item")
             .select("x.id", "x.content", "item", "diagonal", "first", "r.words", "item_words"))
    found = pairs.mapInArrow(_verify, "id long, content long, item long, matches long, length long")
    good = (F.col("matches") >= MIN_MATCHES) & (F.col("matches") >= MIN_SHARE * F.col("length"))
    return found.filter(good).groupBy("id", "content", "item").agg(F.max(F.struct("matches", "length")).alias("b")).select(
        "id", "content", "item", "b.matches", "b.length")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row with ``contaminated``, ``n_items``, ``items`` (ids, ascending) and ``matched_words`` (best overlap).

    Null, empty and short texts are clean. Rows are told apart by doc_id and text, both may be null; equal rows get
    equal results. An empty benchmark leaves all clean; an empty table gives no rows. Columns named as results are replaced.
    """
    found = shared_table(overlaps(docs, benchmark).groupBy("id", "content").agg(
        F.array_sort(F.collect_set("item")).alias("_items"), F.max("matches").alias("_matched"))).alias("f")
    df = packed(docs, "doc_id", "text").withColumn("_content", _content("_text")).alias("d")
    df = df.join(found, F.col("_doc_id").cast("long").eqNullSafe(F.col("f.id")) & (F.col("_content") == F.col("f.content")), "left")
    none = F.array().cast("array<bigint>")
    items = F.coalesce("_items", none)
    return unpacked(df, docs.columns, contaminated=F.col("_items").isNotNull(), n_items=F.size(items).cast("long"), items=items,
                    matched_words=F.coalesce("_matched", F.lit(0).cast("long")))
