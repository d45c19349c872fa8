"""Token ids as binary blocks with Elias-Fano boundaries.

A file is a Parquet table in the shared folder; each row is one block of the format below, so that Spark's
writers place, commit and retry it on any store. Blocks follow each other in ascending doc_id order.

Block, little-endian: magic ``EFT1``, id width in bytes (u32), documents n (u64), ids u (u64), low bits l (u64),
then the document ends (n ascending numbers up to u) in Elias-Fano form, then the ids. An end is split into
its l low bits, packed, and the rest, which is written in unary: the i-th end sets bit (end >> l) + i of the
high bits. The place of every ``SAMPLE``-th set bit is kept, so that select starts near its goal. That takes about 2 + log2(u / n)
bits a document instead of 64.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pataspark.llm.common import kept_in_worker, shared_table

END_ID = 1
# A block is closed once it holds this many ids; a longer document has a block of its own size.
BLOCK_IDS = 1 << 20
SAMPLE = 64
# Pieces remembered per round by a worker.
PIECES = 700_000
_MARKS = "!\"#$%&()*+,-./:;=?@[]^_`{}~"
_HEAD = "<4sIQQQ"
_BLOCKS = "part int, block int, n_docs long, n_ids long, doc_ids array<long>, data binary"
_ROWS = "part int, block int, place int, doc_id long, start_in_block long, n_tokens long, ids_crc32 long"


def _words64(bits: np.ndarray) -> np.ndarray:
    """Bits, lowest first, as 64-bit words."""
    padded = np.zeros(-(-len(bits) // 64) * 64, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view("<u8")


def write_block(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One block from the documents' numbers of ids and all their ids."""
    ends = np.cumsum(lengths, dtype=np.uint64)
    n, u = len(ends), int(ends[-1]) if len(ends) else 0
    low = max(0, (u // n).bit_length() - 1) if n else 0
    lows = (ends[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    ones = (ends >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return b"".join([
        struct.pack(_HEAD, b"EFT1", width, n, u, low), struct.pack("<Q", len(high)), _words64(lows.reshape(-1).astype(np.uint8)).tobytes(), _words64(high).tobytes(),
        ones[::SAMPLE].astype("<u4").tobytes(), ids.astype("<u2" if width == 2 else "<u4").tobytes()])


class Block:
    """Read access to a block without unpacking its boundaries."""

    def __init__(self, data: bytes) -> None:
        magic, width, self.n, self.u, self.low = struct.unpack_from(_HEAD, data)
        if magic != b"EFT1":
            raise ValueError("not a token block")
        (n_high,) = struct.unpack_from("<Q", data, struct.calcsize(_HEAD))
        at = struct.calcsize(_HEAD) + 8

        def part(count: int, kind: str) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found
        self.lows, self.highs = part(-(-self.n * self.low // 64), "<u8"), part(-(-n_high // 64), "<u8")
        self.samples = part(-(-self.n // SAMPLE), "<u4")
        self.ids = part(self.u, "<u2" if width == 2 else "<u4")

    def end(self, i: int) -> int:
        """Select: where document i ends, from the sample before it and bit counts of whole words."""
        place = int(self.samples[i // SAMPLE])
        word, skip = place // 64, i % SAMPLE
        bits = int(self.highs[word]) >> (place % 64) << (place % 64)
        while (ones := bits.bit_count()) <= skip:
            skip, word = skip - ones, word + 1
            bits = int(self.highs[word])
        for _ in range(skip):
            bits &= bits - 1
        high = word * 64 + (bits & -bits).bit_length() - 1 - i
        return high << self.low | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low:
            return 0
        first, shift = divmod(i * self.low, 64)
        value = int(self.lows[first]) >> shift
        if shift + self.low > 64:
            value |= int(self.lows[first + 1]) << (64 - shift)
        return value & ((1 << self.low) - 1)

    def ends(self) -> np.ndarray:
        """All document ends at once."""
        ones = np.flatnonzero(np.unpackbits(self.highs.view(np.uint8), bitorder="little"))[: self.n]
        value = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if self.low and self.n:
            bits = np.unpackbits(self.lows.view(np.uint8), bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
            value |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return value.astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.end(i - 1) if i else 0: self.end(i)]


class _Pieces(dict):
    """Ids of a piece of text between blanks.

    The tokenizer lowers the case and never joins across white space or between a letter and a mark, so a
    piece is put together from its word in lower case and the marks behind it, and these are encoded alone. Pieces of the latest and of the
    previous round are remembered; a round is bounded.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._previous: dict[str, bytes] = {}
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @staticmethod
    def _parts(piece: str) -> tuple[str, str]:
        """Word and the marks behind it; the word is in lower case where that is plain ASCII and no special token."""
        word = piece.rstrip(_MARKS)
        if not word or not word[-1].lower().isalpha():
            word = piece
        return (word.lower() if word.isascii() and "<" not in word else word), piece[len(word):]

    def learn(self, pieces: set[str]) -> None:
        if len(self) >= PIECES:
            self._previous = dict(self)
            self.clear()
        old, new = self._previous, []
        for p in pieces:
            if p not in self:
                if p in old:
                    self[p] = old[p]
                else:
                    new.append((p, *self._parts(p)))
        words = [w for w in {x for _, word, mark in new for x in (word, mark)} if w not in self]
        self._encode([w for w in words if not w.isalpha()])
        self._encode_letters([w for w in words if w.isalpha()])
        for p, word, mark in new:
            self[p] = self[word] + self[mark]

    def _encode(self, words: list[str]) -> None:
        for word, found in zip(words, self._tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self[word] = np.array(found.ids, np.uint32).tobytes()

    def _encode_letters(self, words: list[str]) -> None:
        """Many words at a time: of letters alone, each ends in the one token that closes a word."""
        for i in range(0, len(words), 1000):
            some = words[i: i + 1000]
            ids = np.array(self._tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            ends = (4 * (np.flatnonzero(self._ends_word[ids]) + 1)).tolist()
            if len(ends) != len(some):
                self._encode(some)
                continue
            data = ids.tobytes()
            for word, a, b in zip(some, [0, *ends], ends):
                self[word] = data[a:b]


def encoder(path: str) -> Callable[[list[str | None]], list[bytes]]:
    """Function from texts to their ids, as little-endian unsigned 32-bit integers."""
    known = kept_in_worker(f"pieces of {path}", lambda: _Pieces(path))

    def encode(texts: list[str | None]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        known.learn(set().union(*split))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]
    return encode


def token_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of all documents in ascending doc_id order (part, block, n_docs, n_ids, doc_ids, data).

    A null text is empty and holds the end id alone. Null doc_ids come first; rows with the same doc_id follow
    each other by text. An empty table gives no blocks.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        part, block = TaskContext.get().partitionId(), 0
        doc_ids, texts, held = [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(texts), "<u4")
            lengths = np.array([len(t) // 4 for t in texts], np.uint64)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(texts)], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())), pa.array([write_block(lengths, ids)], pa.binary())],
                names=["part", "block", "n_docs", "n_ids", "doc_ids", "data"])
        for batch in batches:
            names, contents = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i in range(0, len(names), 256):
                for name, found in zip(names[i: i + 256], encode(contents[i: i + 256]), strict=True):
                    doc_ids.append(name)
                    texts.append(found + end)
                    held += len(texts[-1]) // 4
                    if held >= block_ids:
                        yield closed()
                        block, doc_ids, texts, held = block + 1, [], [], 0
        if texts:
            yield closed()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, _BLOCKS)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the blocks into the shared folder; the result reads them."""
    return shared_table(token_blocks(docs, tokenizer_path, end_id, block_ids))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, number, doc_ids, data in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "doc_ids", "data")), strict=True):
            block = Block(data)
            ends = block.ends()
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            ids = block.ids.astype("<u4")
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(doc_ids, pa.int64()),
                pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                names=["part", "block", "place", "doc_id", "start_in_block", "n_tokens", "ids_crc32"])


def read_tokens(blocks: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The starts of blocks are running sums in two levels: over a part's blocks, and over one row per part.
    """
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("of_part"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("of_block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    return (blocks.select("part", "block", "doc_ids", "data").mapInArrow(_read, _ROWS)
            .join(starts.select("part", "block", (F.col("of_part") + F.col("of_block")).alias("before")), ["part", "block"])
            .select("doc_id", (F.col("before") + F.col("start_in_block")).alias("start"), "n_tokens", "ids_crc32"))
