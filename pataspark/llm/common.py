"""What the operators of this folder share: tables in the shared folder, words, lines, hashes."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pataspark.operators.common import shared_folder

# White space between words: space and U+0009 to U+000D.
SPACES = "[ \t-\r]+"
# A worker forgets its words beyond this many, so that its memory stays bounded.
CACHED_WORDS = 400_000


def shared_table(df: DataFrame) -> DataFrame:
    """Write a frame once into the shared folder and read it back.

    It cuts the lineage, survives lost executors, and gives the planner real sizes, so that it
    broadcasts a small table and shuffles a large one.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the whole row as ``_row``, so that no other column can clash."""
    return docs.select(F.struct("*").alias("_row"), *[F.col(f"`{n}`").alias(f"_{n}") for n in names])


def unpacked(df: DataFrame, columns: Sequence[str], **more: Column) -> DataFrame:
    """The row again, with columns added; an added column replaces one of the same name."""
    kept = [F.col("_row").getField(c).alias(c) for c in columns if c.lower() not in {m.lower() for m in more}]
    return df.select(*kept, *[c.alias(n) for n, c in more.items()])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row, also where a lambda inside uses it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_positions(items: Column, positions: Column) -> Column:
    """An array without the given positions (from 0, ascending), in time linear in both."""
    def cut(row: Column) -> Column:
        bounds, all_items = row["bounds"], row["items"]
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda k: F.slice(
            all_items, F.get(bounds, k - 1) + 2, F.get(bounds, k) - F.get(bounds, k - 1) - 1)))
    bounded = let(items, lambda x: F.struct(x.alias("items"), F.concat(F.array(F.lit(-1)), positions, F.array(F.size(x))).alias("bounds")))
    return let(bounded, cut)


def md5_number(text: Column, bits: int) -> Column:
    """Whole number from the first ``bits`` bits (a multiple of 4, up to 60) of the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long")


_LOWER = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else (c + 32 if 65 <= c <= 90 else 32) for c in range(256))


def word_bytes(text: str) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def kept_in_worker(name: str, make: Callable[[], object]) -> object:
    """An object of the Python worker that outlives its task, so that what one task has learned serves the next."""
    held = sys.modules.setdefault("_pataspark_worker", types.ModuleType("_pataspark_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


class WordHashes(dict):
    """64-bit hash by word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: Iterable[bytes], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=n)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a public finalizer of multiply and shift steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
