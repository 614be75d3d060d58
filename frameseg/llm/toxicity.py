"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained with FTRL-proximal: per-coordinate
rates, L1 sparsity, and a compact set of weights to broadcast.

Features of a text: its distinct words, word pairs and pairs with one word between, lower-cased (A-Z), punctuation at their ends
stripped, hashed to 2**20 coordinates, each present or not. A null or empty text has the bias alone. Labels: of rows that repeat
a doc_id the largest not-null toxic counts. Without labels of both classes every score is the share of label 1 (0 without labels).
The sample that is fitted is bounded: the SAMPLE labelled documents with the smallest hash of their id, whole texts. Of document rows that
repeat a doc_id the largest text (by code points) is learnt from; each of the rows is scored by its own text. A null doc_id is scored and
never learnt from or held out. No documents: no rows. The stage passes every other column through, whatever its name.

The texts never reach the driver: tasks turn them into coordinates, and one task reads those epoch after epoch in an order by
hash, so that it holds a batch and the model (two numbers for each of 2**20 coordinates). The driver gets the sparse weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, WordHash, aside, kept, restored, slices, table, tidy

BITS, SAMPLE, EPOCHS = 20, 12_000, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 0.1
STRIP = b".,;:!?\"'()[]*%$&#|"
#: Hash seeds: words, pairs, pairs with one word between.
SEEDS = (1, 2, 3)


def coordinates(text: str | None, words: WordHash, bits: int = BITS) -> np.ndarray:
    """Coordinates of all n-grams and skip-grams, repeats included."""
    w = words.of(text.encode().lower().split()) if text else np.empty(0, np.uint64)
    m, s = np.uint64(0x9E3779B97F4A7C15), [np.uint64(2 * x + 0xD1B54A32D192ED03) for x in SEEDS]
    grams = (w * s[0], (w[:-1] * m + w[1:]) * s[1], (w[:-2] * m + w[2:]) * s[2])
    x = np.concatenate(grams)
    return ((x ^ (x >> np.uint64(32))) * m >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal (McMahan et al. 2013) over binary features; the last coordinate is the bias, which has no L1."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2, self.size = alpha, beta, l1, l2, size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.size, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, y: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = weight * (sigmoid(w.sum()) - y)
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def distinct(text: str | None, words: WordHash, bits: int = BITS) -> np.ndarray:
    return np.unique(coordinates(text, words, bits)).astype(np.int32)


Model = tuple[np.ndarray, np.ndarray, float]


def constant(share: float) -> Model:
    """The model of labels that are all alike."""
    return np.empty(0, np.int64), np.empty(0), 40.0 if share else -40.0


def train(rows: Iterable[tuple[np.ndarray, int]], bits: int = BITS) -> Model:
    """Coordinates, weights and bias after one step for each of the rows (distinct coordinates, label), in their order."""
    size = 1 << bits
    model = Ftrl(size)
    for at, y in rows:
        model.step(np.append(at, size), y)
    w = model.weights(np.arange(size + 1))
    at = np.flatnonzero(w[:size])
    return at, w[at], float(w[size])


def in_fold(doc_id: Column) -> Column:
    """Held out: never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _features(bits: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept("toxicity", lambda: WordHash(strip=STRIP))
        for b in slices(batches, "text"):
            at = [distinct(t, words, bits) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(at, pa.list_(pa.int32()))], ["id", "y", "at"])

    return run


def _fit(bits: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                at, y = b.column("at"), b.column("y").to_numpy()
                ends, values = at.offsets.to_numpy(), at.values.to_numpy()
                for i in range(len(y)):
                    yield values[ends[i] : ends[i + 1]], y[i]

        at, w, bias = train(rows(), bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << bits)), pa.array(np.append(w, bias))], ["at", "w"])

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """Fits on a bounded sample of the labelled rows outside the held-out fold; of the documents only its texts move."""
    tmp = Scratch(docs.sparkSession, "toxicity")
    y = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("y"))
    y = tmp.save(y.where(~in_fold(F.col("id"))).select("id", (F.col("y") > 0).cast("int").alias("y"), F.xxhash64("id", F.lit(11)).alias("h")), "labels")
    n = y.count()
    if n > 2 * sample:  # the smallest hashes lie below this, so that tasks don't each send a whole sample
        y = y.where(F.col("h") < int(-(2.0**63) + 2.0**64 * 2 * sample / n))
    y = tmp.save(y.orderBy("h", "id").limit(sample).select("id", "y"), "sample")
    # no more than `sample` rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(y), "id")
    rows = rows.groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    rows = tmp.only(rows.mapInArrow(_features(bits), "id long, y int, at array<int>"), "rows")
    seen = rows.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    if not seen.n or seen.y in (0, seen.n):
        return constant(seen.y / seen.n if seen.n else 0.0)
    steps = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("turn", F.xxhash64("id", "epoch", F.lit(7)))
    found = steps.repartition(1).sortWithinPartitions("epoch", "turn", "id").select("y", "at").mapInArrow(_fit(bits), "at long, w double").toArrow()
    tmp.drop("rows")
    at, w = found.column("at").to_numpy(), found.column("w").to_numpy()
    return at[:-1], w[:-1], float(w[-1])


def _scores(sent: Broadcast, bits: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = sent.value
        dense = np.zeros(1 << bits, np.float64)
        dense[at] = w
        words = kept("toxicity", lambda: WordHash(strip=STRIP))
        for b in slices(batches, "text"):
            out = np.empty(b.num_rows)
            for i, t in enumerate(b.column("text").to_pylist()):
                x = coordinates(t, words, bits)
                x = x[dense[x] != 0]
                out[i] = bias + dense[np.unique(x)].sum()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigmoid(out))], [*b.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """docs with a column score. The model holds no more than 2**bits numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scores(sent, bits), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(in_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that the model rejects go."""
    model, used = learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")), ("doc_id", "text")
    return restored(score(aside(docs, *used), model).where("score < 0.5"), docs, *used)
