"""Sequences derived from the driver's tables, as DataFrames. plans/sqltext.py has the same derivations as SQL.

The partition column is renamed before the first window, so that one exchange by it serves every window and aggregate after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FPS = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _triangle(idx: Column, per: Column) -> Column:
    half = (per / 2).cast("int")
    return F.abs(idx % per - half).cast("double") / half


def _indexed(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col(key).cast("string").alias("vod_id"), "ts", "event_id", "value", "props")
    return e.withColumn("frame_idx", F.row_number().over(W.partitionBy("vod_id").orderBy("ts", "event_id")) - 1)


def _level() -> Column:
    return F.col("value") / (F.col("value") + 34.59)


def frames(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """vod_id, frame_idx, prob: five recordings at 0.5 Hz."""
    per = F.when(F.col("vod_id").isin("click", "error", "view"), 100).otherwise(200)
    prob = 0.7 * _triangle(F.col("frame_idx") + shift, per) + 0.3 * _level()
    return _indexed(spark, sf_dir, "event_type").select("vod_id", "frame_idx", prob.alias("prob"))


def user_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short recordings at 0.1 Hz."""
    prob = 0.7 * _triangle(F.col("frame_idx"), F.lit(20)) + 0.3 * _level()
    return _indexed(spark, sf_dir, "user_id").select("vod_id", "frame_idx", prob.alias("prob"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vod_id, frame_idx, label in 1, 0, -1."""
    p = frames(spark, sf_dir, 3)
    return p.select("vod_id", "frame_idx", F.when(F.col("prob") >= 0.52, 1).when(F.col("prob") >= 0.48, -1).otherwise(0).alias("label"))


def feature_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    tri, k = _triangle(F.col("frame_idx"), F.lit(100)), F.get_json_object("props", "$.k").cast("double")
    return _indexed(spark, sf_dir, "event_type").select(
        "vod_id", "frame_idx", (-60.0 + 40.0 * tri + 10.0 * _level()).alias("voc_db"), (-60.0 + 30.0 * tri + k / 10.0).alias("acc_db"), (k / 50.0).alias("roll_std"), (k / 100.0 * 0.4 * tri).alias("sustained")
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("vod_id"), "vec_id", "embedding")
    e = e.withColumn("frame_idx", F.row_number().over(W.partitionBy("vod_id").orderBy("vec_id")) - 1)
    return e.select("vod_id", "frame_idx", F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("logits"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """streamer, stem, n_frames of the short recordings."""
    n = user_frames(spark, sf_dir).groupBy("vod_id").agg(F.count("*").alias("n_frames"))
    u = F.col("vod_id").cast("long")
    return n.select("vod_id", (u % 4).cast("string").alias("streamer"), F.lpad("vod_id", 6, "0").alias("stem"), "n_frames")
