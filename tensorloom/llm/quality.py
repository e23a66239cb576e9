"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is read as two sequences of words: the lower-cased words themselves, and
their shapes (letters of either case, digits and other signs, runs as one). The
n-grams of either sequence are hashed to coordinates. A text's value at a
coordinate is the share of that family's n-grams that fall on it, so the score
is a sparse dot product that does not grow with length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import LOWER, chunks, mix, spans_hash, texts, words
from .common import checkpointed, every, fresh, table

#: Coordinates: two to this power.
BITS = 18
#: Largest number of labelled rows that are learnt from; those with the smallest hashes of their ids.
TRAIN_ROWS = 6000
_U = np.uint64

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")

#: (sequence, words in a gram) of each family.
FAMILIES = (("shape", 1), ("shape", 2), ("shape", 3), ("word", 1), ("word", 2))


def grams(codes: np.ndarray, offsets: np.ndarray, bits: int = BITS):
    """For each family: coordinates of all n-grams, and where each text's begin and end among them."""
    starts, ends, first = words(codes, offsets)
    if not len(starts):
        zero = np.zeros(len(offsets) - 1, np.int64)
        return [(np.zeros(0, np.int64), zero, zero) for _ in FAMILIES]
    hashes = {"word": spans_hash(LOWER[codes], starts, ends)}
    kinds = _CLASS[codes]
    turn = np.ones(len(kinds), bool)
    turn[1:] = kinds[1:] != kinds[:-1]
    turn[starts] = True
    place = np.zeros(len(kinds) + 1, np.int64)
    np.cumsum(turn, out=place[1:])
    hashes["shape"] = spans_hash(kinds[turn], place[starts], place[ends])
    out = []
    for k, (name, n) in enumerate(FAMILIES):
        h = hashes[name] + _U(k * 0x51ED270B)
        count = max(len(h) - n + 1, 0)
        g = h[:count].copy()
        for i in range(1, n):
            g = mix(g * _U(0x9E3779B97F4A7C15) + h[i : i + count])
        low, high = first[:-1], np.maximum(first[1:] - (n - 1), first[:-1])
        out.append(((mix(g) >> _U(64 - bits)).astype(np.int64), np.minimum(low, count), np.minimum(high, count)))
    return out


def sparse(codes: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Coordinates and values of each text, coordinates without repeats."""
    families, out = grams(codes, offsets, bits), []
    for i in range(len(offsets) - 1):
        at = [g[low[i] : high[i]] for g, low, high in families]
        value = np.concatenate([np.full(len(a), 1 / max(len(a), 1)) for a in at])
        unique, back = np.unique(np.concatenate(at), return_inverse=True)
        out.append((unique, np.bincount(back, value, len(unique))))
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def margins(self, column: pa.Array) -> np.ndarray:
        codes, offsets = texts(column)
        out = np.full(len(offsets) - 1, self.bias)
        for a, b in chunks(offsets):
            for g, low, high in grams(codes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], self.bits):
                total = np.zeros(len(g) + 1)
                np.cumsum(self.weights[g], out=total[1:])
                out[a:b] += (total[high] - total[low]) / np.maximum(high - low, 1)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(column), -500, 500)))


class Leader:
    """Follow-the-regularised-leader (proximal) for logistic loss; each coordinate has a rate of its own."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -50, 50))) - label) * value
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = grown


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = 4, alpha: float = 2.0, beta: float = 0.1, l1: float = 0.002, l2: float = 0.01) -> Model:
    """The model after ``epochs`` passes over ``rows`` of coordinates, values and label. Without rows it scores 0.5."""
    leader, bias = Leader((1 << bits) + 1, alpha, beta, l1, l2), 1 << bits
    for _ in range(epochs):
        for at, value, label in rows:
            leader.learn(np.append(at, bias), np.append(value, 1.0), label)
    w = leader.weights()
    return Model(w[:-1].astype(np.float32), float(w[-1]), bits)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, bits: int = BITS) -> Model:
    """Learn from at most ``rows`` labelled documents whose id is not held out.

    Null labels and ids are left out; of several labels of one id the smallest
    counts. One task trains, on the bounded sample; only the weights come back.
    """
    wanted = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label")).where("label_id IS NOT NULL AND label IS NOT NULL")
    wanted = wanted.where(~held_out("label_id")).groupBy("label_id").agg(F.min("label").alias("label"))
    wanted = wanted.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    wanted = F.broadcast(checkpointed(wanted))  # at most ``rows`` rows
    sample = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text")

    def featured(batches):
        for batch in batches:
            codes, offsets = texts(batch.column(2))
            for a, b in chunks(offsets):
                got = sparse(codes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                at = pa.array([x[0].astype(np.uint32).tobytes() for x in got], pa.binary())
                value = pa.array([x[1].astype(np.float32).tobytes() for x in got], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], at, value], ["doc_id", "label", "at", "value"])

    def learned(batches):
        got = [x for batch in batches for x in zip(*(batch.column(i).to_pylist() for i in range(4)))]
        if len(got) > rows:
            raise ValueError("more rows than the sample's bound")
        got.sort(key=lambda x: (int(mix(np.array([x[0]], np.int64).view(_U))[0]), x[0]))
        model = fit([(np.frombuffer(at, np.uint32).astype(np.int64), np.frombuffer(value, np.float32).astype(float), y) for _, y, at, value in got], bits)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])

    features = sample.mapInArrow(featured, "doc_id bigint, label int, at binary, value binary")
    # of rows that share an id one counts, so an id that repeats without end stays one row
    features = features.groupBy("doc_id").agg(F.min(F.struct("label", "at", "value")).alias("f")).select("doc_id", "f.*").repartition(1)
    row = features.mapInArrow(learned, "weights binary, bias double").first()
    if row is None:
        return fit([], bits)
    return Model(np.frombuffer(row[0], np.float32), row[1], bits)


def held_out(doc_id: str) -> Column:
    """Whether an id is kept from training: CRC-32 of its decimal text, modulo 3, is 1. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of the whole text, 0 to 1; null and empty texts get the score of the bias alone."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.scores(column))

    return docs.withColumn(name, score(F.col("text")))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    (name,) = fresh(docs, "quality_score")
    return scored(docs, train(docs, labels), name).where(F.col(name) >= 0.5).select(*every(docs))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
