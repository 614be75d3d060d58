"""Overlapped chunks, scorers and overlap-add."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import KEY


def chunk_starts(recordings: DataFrame, n: str, size: int, overlap: int) -> DataFrame:
    """recordings with chunk_id, start, stop: starts every size - overlap, none after the first chunk that reaches the end. Positions are long, as
    samples of a long recording outgrow 32 bits."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.col(n) - size) / F.lit(step))).cast("int")
    x = recordings.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_id")).where(F.col(n) > 0)
    return x.withColumn("start", F.col("chunk_id").cast("long") * step).withColumn("stop", F.least(F.col("start") + size, F.col(n)).cast("long"))


def sample_chunks(recordings: DataFrame, n: str, size: int, overlap: int, per_frame: float, least: int = 0) -> DataFrame:
    """recordings with chunk_id, start, stop in samples and first_frame: the output frame that a chunk's scores begin at, its start in frames cut to
    a whole number. A chunk shorter than `least` samples isn't scored."""
    x = chunk_starts(recordings, n, size, overlap).where(F.col("stop") - F.col("start") >= least)
    return x.withColumn("first_frame", (F.col("start") / F.lit(float(per_frame))).cast("int"))


def placed(scores: DataFrame, chunks: DataFrame, frames: DataFrame) -> DataFrame:
    """vod_id, frame_idx, prob of scores(vod_id, chunk_id, i, prob) at their chunks' first frames; those beyond a recording's frames(vod_id, n) go."""
    x = scores.join(chunks.select(KEY, "chunk_id", "first_frame"), [KEY, "chunk_id"]).join(frames.select(KEY, "n"), KEY)
    return x.select(KEY, "chunk_id", (F.col("first_frame") + F.col("i")).cast("int").alias("frame_idx"), "prob", "n").where(F.col("frame_idx") < F.col("n")).drop("n")


def trimmed(chunks: DataFrame, lead: int) -> DataFrame:
    """Frames (vod_id, chunk_id, frame_idx) of chunks (start, stop) without the first `lead` of each, which only lead in; at a recording's start there are fewer."""
    x = chunks.select(KEY, "chunk_id", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stop") - F.col("start") - 1)).alias("k"))
    return x.where(F.col("k") >= F.least(F.col("start"), F.lit(lead))).select(KEY, "chunk_id", (F.col("start") + F.col("k")).alias("frame_idx"))


def tiles(recordings: DataFrame, n: str, window: int) -> DataFrame:
    """recordings with start: windows side by side, a tail dropped; a short recording has one."""
    return recordings.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(n).cast("int") - window), F.lit(window))).alias("start"))


def in_chunks(frames: DataFrame, recordings: DataFrame, size: int, overlap: int) -> DataFrame:
    """Frames of each chunk: a frame lies in chunks by arithmetic, so there is no range join."""
    step = size - overlap
    x = frames.join(recordings.select(KEY, F.col("n")), KEY)
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / F.lit(step)))
    lo = F.greatest(F.lit(0), F.ceil((F.col("frame_idx") - size + 1) / F.lit(step)))
    hi = F.least(last, F.floor(F.col("frame_idx") / F.lit(step)))
    return x.withColumn("chunk_id", F.explode(F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))))).drop("n")


def overlap_add(chunks: DataFrame, grid: DataFrame, score: str = "prob") -> DataFrame:
    """Mean of the scores of a frame; 0 where no chunk covers it."""
    x = chunks.groupBy(KEY, "frame_idx").agg((F.sum(score) / F.count(score)).alias(score))
    return grid.select(KEY, "frame_idx").join(x, [KEY, "frame_idx"], "left").withColumn(score, F.coalesce(score, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax_class(logits: str, k: int) -> Column:
    """Probability of class k (from 0) of an array of logits, shifted by the largest."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - top))
    return F.get(e, F.lit(k)) / F.aggregate(e, F.lit(0.0), lambda a, v: a + v)


class LinearScorer:
    """The scorer that comes with the library: a weight for each feature, applied to batches of frames (numpy)."""

    def __init__(self, weights: list[float], bias: float = 0.0):
        self.weights, self.bias = list(weights), bias

    def __call__(self, x):
        import numpy as np

        return 1.0 / (1.0 + np.exp(-(np.asarray(x, np.float64) @ np.array(self.weights) + self.bias)))


#: Scorers by name; neural ones are added by whoever has their runtime.
SCORERS: dict[str, Callable[..., Callable]] = {"linear": LinearScorer}


def build_scorer(name: str, **arguments) -> Callable:
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name}; known: {sorted(SCORERS)}")
    return SCORERS[name](**arguments)


def score(frames: DataFrame, scorer: Callable, features: str, name: str = "prob") -> DataFrame:
    """frames with the scorer's number for each row's array of features, in Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(scorer(np.stack(x.to_numpy())) if len(x) else np.empty(0))

    return frames.withColumn(name, run(F.col(features)))
