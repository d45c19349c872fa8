"""Toxicity by multiple-instance learning.

Only documents are labelled, sentences are not. Each sentence gets a logistic score from its words and parts of
words; a document is toxic if any sentence is (noisy-or): 1 - product of (1 - sentence score). The weights are
trained through that product from document labels, so the scores of single sentences follow, and
the offending sentences can be located.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from pataspark.llm.common import CACHED_WORDS, md5_number, shared_table

# Labelled documents that the model is fitted on, at most about so many (a sample by hash of doc_id).
TRAIN_DOCUMENTS = 8_000
# Features kept: words and parts of words whose share among toxic documents is higher by so many standard
# errors, which hardly any of a million features reaches by chance; the clearest ones if they are very many.
FEATURES, MIN_ERRORS = 4_096, 6.0
PARTS = (4, 5)
LIMIT = 0.5
STEPS, RATE, DECAY = 300, 0.1, 1e-4

_END = b".!?\n\r"
_TABLE = bytes(10 if c in _END else c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SENTENCE = re.compile(r"[^.!?\n\r]+")


def sentences(text: str | None) -> list[list[bytes]]:
    """Words of each sentence that has any."""
    lines = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b"\n")
    return [w for x in lines if (w := x.split())]


def word_features(word: bytes) -> set[int]:
    """Hashes of the word and of its parts of four and five bytes."""
    parts = {b"=" + word}
    for n in PARTS:
        parts.update(word[i: i + n] for i in range(len(word) - n + 1))
    return {xxhash.xxh32_intdigest(p) for p in parts}


class _Features(dict):
    """Features of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> np.ndarray:
        if len(self) >= CACHED_WORDS // 8:
            self.clear()
        self[word] = value = np.array(sorted(word_features(word)), np.int64)
        return value


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float]


class _Scores(dict):
    """Weight of each word, remembered up to a bound."""

    def __init__(self, model: Model) -> None:
        self._weights = model.weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        get = self._weights.get
        self[word] = value = sum(get(f, 0.0) for f in sorted(word_features(word)))
        return value


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def noisy_or(logits: np.ndarray) -> float:
    return float(-np.expm1(-_softplus(logits).sum())) if len(logits) else 0.0


def count_features(texts: Iterable[str | None], features: _Features) -> tuple[np.ndarray, np.ndarray]:
    """Features of the texts and the number of texts that have each."""
    seen = [np.empty(0, np.int64)]
    for text in texts:
        words = {w for s in sentences(text) for w in s}
        if words:
            seen.append(np.unique(np.concatenate([features[w] for w in words])))
    return np.unique(np.concatenate(seen), return_counts=True)


def kept_features(text: str | None, column: dict[int, int], features: _Features) -> tuple[int, list[list[int]]]:
    """Number of sentences without any kept feature, and the kept features of each other sentence."""
    plain, held = 0, []
    for s in sentences(text):
        found = [column[f] for w in sorted(set(s)) for f in features[w].tolist() if f in column]
        if found:
            held.append(found)
        else:
            plain += 1
    return plain, held


def fit_weights(rows: list[tuple[int, int, list[list[int]]]], column: dict[int, int]) -> Model:
    """Weights from (label, plain sentences, features of the others) by gradient steps through the noisy-or.

    With one class only, the model gives that class to all texts that have a sentence.
    """
    toxic = sum(y for y, _, _ in rows)
    if not toxic or toxic == len(rows):
        return Model(20.0 if toxic else -20.0, {})
    labels, plain = np.array([y for y, _, _ in rows], float), np.array([n for _, n, _ in rows], float)
    document = np.array([d for d, (_, _, held) in enumerate(rows) for _ in held], int)
    every = [h for _, _, held in rows for h in held]
    at = np.repeat(np.arange(len(every)), [len(h) for h in every]).astype(int)
    which = np.array(list(chain.from_iterable(every)), int)
    size = len(column) + 1
    w = np.zeros(size)
    w[-1] = -4.0
    first, second = np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        z = np.bincount(at, w[which], len(document)) + w[-1]
        total = np.bincount(document, _softplus(z), len(rows)) + plain * _softplus(w[-1:])[0]
        slope = np.where(labels == 1, -1 / np.expm1(np.clip(total, 1e-6, 700)), 1.0) / len(rows)
        dz = slope[document] / (1 + np.exp(-z))
        g = np.zeros(size)
        g[:-1] = np.bincount(which, dz[at], size - 1) + DECAY * w[:-1]
        g[-1] = dz.sum() + (slope * plain).sum() / (1 + np.exp(-w[-1]))
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(float(w[-1]), {f: float(w[i]) for f, i in column.items()})


def _logits(found: list[list[bytes]], model: Model, scores: _Scores) -> np.ndarray:
    get = scores.__getitem__
    return np.array([sum(map(get, set(s))) for s in found]) + model.bias if found else np.empty(0)


def offending(text: str, model: Model, limit: float = LIMIT, scores: _Scores | None = None) -> list[tuple[int, int, float]]:
    """(start, end, score) of sentences at or above the limit, in code points."""
    scores = scores if scores is not None else _Scores(model)
    out = []
    for m in _SENTENCE.finditer(text):
        for z in _logits(sentences(m[0]), model, scores):
            p = float(1 / (1 + np.exp(-z)))
            if p >= limit:
                out.append((m.start(), m.end(), p))
    return out


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text divisible by 5; no id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = _Features()
    for batch in batches:
        rows = list(zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True))
        for y in (0, 1):
            found, n = count_features((t for t, label in rows if label == y), features)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), y, np.int32)), pa.array(n.astype(np.int64))],
                                             names=["feature", "toxic", "documents"])


def train(docs: DataFrame, labels: DataFrame, max_documents: int = TRAIN_DOCUMENTS) -> Model:
    """Fit on a sample of about ``max_documents`` labelled rows at most, never on held-out ones.

    Labels without id or value are left out; of several labels of one id the highest counts. Features are
    counted and chosen by Spark; the driver gets the chosen ones and, of each sampled document, which of them its sentences have.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic"))
             .filter("doc_id is not null and toxic is not null")
             .filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = min(1.0, max_documents / max(1, known.count()))
    sample = known.filter(md5_number(F.col("doc_id").cast("string"), 32) < int(share * 2**32))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = shared_table(texts.join(sample, "doc_id").select("doc_id", "text", "toxic"))
    number = dict(tuple(r) for r in rows.groupBy("toxic").agg(F.count("*")).collect())
    toxic, clean = number.get(1, 0), number.get(0, 0)
    if not toxic or not clean:
        return Model(20.0 if toxic else -20.0, {})

    counts = rows.select("text", "toxic").mapInArrow(_count, "feature long, toxic int, documents long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("documents")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("documents")).otherwise(0)).alias("b"))
    share = (F.col("a") + F.col("b") + 1) / float(toxic + clean + 2)
    apart = ((F.col("a") + 0.5) / float(toxic + 1) - (F.col("b") + 0.5) / float(clean + 1)) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean))
    chosen = counts.select("feature", apart.alias("apart")).filter(F.col("apart") >= MIN_ERRORS).orderBy(F.desc("apart"), "feature").limit(FEATURES).collect()
    column = {r["feature"]: i for i, r in enumerate(chosen)}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features()
        for batch in batches:
            found = [kept_features(t, column, features) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("toxic"), pa.array([n for n, _ in found], pa.int32()),
                pa.array([h for _, h in found], pa.list_(pa.list_(pa.int32())))], names=["doc_id", "toxic", "plain", "held"])
    held = rows.mapInArrow(keep, "doc_id long, toxic int, plain int, held array<array<int>>").orderBy("doc_id", "plain").collect()  # bounded by max_documents
    return fit_weights([(r["toxic"], r["plain"], r["held"]) for r in held], column)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every row with ``score``, ``predicted`` (1 at 0.5 or more) and ``offending`` sentences of documents that are.

    A null or empty text has no sentence and scores 0. Rows are independent; only the text is read. Columns named as results are replaced.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(model)
        at = names.index("text") if "text" in names else 0
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).to_pylist()
            values = [noisy_or(_logits(sentences(t), model, scores)) for t in texts]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in offending(t or "", model, LIMIT, scores)] if v >= LIMIT else []
                     for t, v in zip(texts, values, strict=True)]
            added = {"score": pa.array(values, pa.float64()), "predicted": pa.array([int(v >= LIMIT) for v in values], pa.int32()), "offending": pa.array(spans, _SPANS)}
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in stay] + list(added.values()), names=[names[i] for i in stay] + list(added))
    names = docs.columns
    new = ("score", "predicted", "offending")
    stay = [i for i, c in enumerate(names) if c.lower() not in new]
    span = T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("score", T.DoubleType())
    schema = T.StructType([docs.schema.fields[i] for i in stay]).add("score", T.DoubleType()).add("predicted", T.IntegerType()).add("offending", T.ArrayType(span))
    return docs.mapInArrow(score, schema)
