"""Audio files (PCM WAV by the standard library; other decoders are hooks), chunk tables and WAV sinks."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dsp import resample, to_pcm16
from ..schemas import AUDIO_CHUNKS
from .files import write_files

#: Decoders of bytes to (samples [n, channels], rate), tried in turn after the WAV reader.
DECODERS: list[Callable[[bytes], tuple[np.ndarray, int]]] = []


def read_wav(content: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(content)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels), rate


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono, samples clamped to [-1, 1]."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(to_pcm16(samples).tobytes())
    return out.getvalue()


def load(content: bytes, rate: int = 16_000) -> np.ndarray:
    """Mono samples at this rate."""
    error = None
    for decode in (read_wav, *DECODERS):
        try:
            x, own = decode(content)
            return resample(x.mean(axis=1), own, rate)
        except Exception as e:  # the next decoder may read it
            error = error or e
    raise ValueError(f"no decoder reads this file: {error}")


def audio_chunks(files: DataFrame, rate: int = 16_000, seconds: float = 30.0) -> DataFrame:
    """Chunks of files (path, content) as binaryFile reads them; the stem is the recording."""
    size = int(rate * seconds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                x = load(content, rate)
                stem = path.rpartition("/")[2].rpartition(".")[0]
                for k, s in enumerate(range(0, len(x), size)):
                    yield pd.DataFrame({"vod_id": [stem], "chunk_id": [k], "start_sample": [s], "sample_rate": [rate], "samples": [x[s : s + size]]})

    return files.select("path", "content").mapInPandas(run, AUDIO_CHUNKS)


def read_span(chunks: DataFrame, start: int, count: int) -> DataFrame:
    """Samples [start, start + count) of each recording of a chunk table; other chunks are not read."""
    size = F.size("samples")
    x = chunks.where((F.col("start_sample") < start + count) & (F.col("start_sample") + size > start))
    lo = F.greatest(F.lit(0), F.lit(start) - F.col("start_sample")).cast("int")
    hi = F.least(size, F.lit(start + count) - F.col("start_sample")).cast("int")
    x = x.select("vod_id", F.struct("chunk_id", F.slice("samples", lo + 1, hi - lo).alias("s")).alias("c"))
    x = x.groupBy("vod_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return x.select("vod_id", F.flatten(F.transform("c", lambda c: c["s"])).alias("samples"))


def overlapping_chunks(samples: DataFrame, body: int, overlap: int, value: str = "prob") -> DataFrame:
    """Chunks (vod_id, chunk_id, samples) of body + overlap values that begin every `body`, from one row a value (vod_id, frame_idx); a chunk shorter
    than the overlap is left out, as the tail before it covers it."""
    i = F.col("frame_idx")
    own = F.floor(i / body).cast("int")
    at = F.when((i % body < overlap) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    x = samples.select("vod_id", "frame_idx", value, F.explode(at).alias("chunk_id"))
    x = x.groupBy("vod_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", value))).alias("c"))
    return x.select("vod_id", "chunk_id", F.transform("c", lambda c: c[value]).alias("samples")).where(F.size("samples") >= overlap)


def crossfade(chunks: DataFrame, body: int, overlap: int) -> DataFrame:
    """Chunks (vod_id, chunk_id, samples) of which each overlaps the next by up to `overlap` values, as parts that follow one another: a chunk gives up
    what it has beyond `body`; the next one's head fades in over that tail, by a ramp from 0 to 1. The last chunk keeps its tail."""
    from pyspark.sql import Window as W

    w = W.partitionBy("vod_id").orderBy("chunk_id")
    x = chunks.withColumn("_tail", F.lag(F.slice("samples", body + 1, overlap)).over(w)).withColumn("_last", F.lead("chunk_id").over(w).isNull())
    n = F.least(F.lit(overlap), F.size("samples"))
    ramp = lambda i: F.when(n > 1, i / F.greatest(n - 1, F.lit(1))).otherwise(0.0)
    faded = F.transform("samples", lambda v, i: F.when((i < n) & F.get("_tail", i).isNotNull(), v * ramp(i) + F.get("_tail", i) * (1 - ramp(i))).otherwise(v))
    return x.withColumn("samples", F.when(F.col("_last"), faded).otherwise(F.slice(faded, 1, body))).drop("_tail", "_last")


def save_wavs(recordings: DataFrame, folder: str, rate: int) -> int:
    """Writes recordings (vod_id, samples) as 16-bit WAV files <vod_id>.wav below a folder; their number."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for vod, x in zip(b.vod_id, b.samples, strict=True):
                yield pd.DataFrame({"name": [f"{vod}.wav"], "content": [write_wav(x, rate)]})

    return write_files(recordings.select("vod_id", "samples").mapInPandas(encode, "name string, content binary"), folder)


def cut_plan(segments: DataFrame) -> DataFrame:
    """What a cutter has to do: name, start and length of each clip."""
    name = F.format_string("%s_song%02d.mp4", "vod_id", "seg_no")
    return segments.select("vod_id", "seg_no", name.alias("clip"), F.format_string("%.2f", F.col("cut_start")).alias("ss"), F.format_string("%.2f", F.col("cut_end") - F.col("cut_start")).alias("t"))


def cut(plan: DataFrame, cutter: Callable[[dict], None]) -> None:
    """Runs a cutter (an executor-side hook) for each row of a plan."""
    plan.foreachPartition(lambda rows: [cutter(r.asDict()) for r in rows] and None)
