"""Pseudo labels from feature frames, class labels with precedence, pooling of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import PseudoLabelConfig
from .sequence import KEY, at_least, islands, merge_runs, vote


def voiced(cfg: PseudoLabelConfig):
    return F.col("voc_db") > cfg.voc_on_db


def candidate(cfg: PseudoLabelConfig):
    return voiced(cfg) & (F.col("acc_db") > cfg.acc_on_db)


def candidate_runs(features: DataFrame, cfg: PseudoLabelConfig = PseudoLabelConfig()) -> DataFrame:
    x = vote(features.withColumn("cand", candidate(cfg)), cfg.vote_frames, "cand")
    return at_least(merge_runs(islands(x, F.col("cand")), cfg.gap_fill_s, cfg.frame_rate), cfg.segment_min_s, cfg.frame_rate)


def pseudo_segments(features: DataFrame, cfg: PseudoLabelConfig = PseudoLabelConfig()) -> DataFrame:
    """Candidate runs with density, sustained share, median level and whether they pass; those that don't stay.

    The sustained share is summed in the order of frames: at a threshold, a sum in the order of partitions decides one way or the other.
    """
    at = candidate_runs(features, cfg).select(KEY, "a", "b", F.explode(F.sequence("a", F.col("b") - 1)).alias("frame_idx"))
    x = at.join(features, [KEY, "frame_idx"]).withColumn("_s", F.when(voiced(cfg), F.col("sustained")))
    x = x.withColumn("_sum", F.sum("_s").over(W.partitionBy(KEY, "a").orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0)))
    sustained = F.max_by("_sum", "frame_idx") / F.nullif(F.count("_s"), F.lit(0))
    x = x.groupBy(KEY, "a", "b").agg(F.avg(voiced(cfg).cast("double")).alias("vocal_density"), F.coalesce(sustained, F.lit(0.0)).alias("sustained_frac"), F.median("acc_db").alias("acc_db"))
    ok = (F.col("vocal_density") >= cfg.min_density) & (F.col("sustained_frac") >= cfg.min_sustained) & (F.col("acc_db") >= cfg.min_acc_db)
    return x.select(KEY, F.round(F.col("a") / F.lit(cfg.frame_rate), 2).alias("start"), F.round(F.col("b") / F.lit(cfg.frame_rate), 2).alias("end"), "vocal_density", "sustained_frac", "acc_db", ok.alias("positive"))


def paint(grid: DataFrame, layers: list[tuple[DataFrame, int]], base: str = "label") -> DataFrame:
    """grid(vod_id, frame_idx, base) with label: of the layers (runs(vod_id, a, b), value) that cover a frame the last one holds."""
    x = None
    for k, (runs, value) in enumerate(layers):
        r = runs.select(KEY, F.greatest(F.lit(0), F.col("a")).cast("int").alias("a"), F.col("b").cast("int").alias("b")).where("a < b")
        r = r.select(KEY, F.explode(F.sequence("a", F.col("b") - 1)).alias("frame_idx"), F.lit(k).alias("priority"), F.lit(value).alias("value"))
        x = r if x is None else x.unionByName(r)
    top = x.groupBy(KEY, "frame_idx").agg(F.max_by("value", "priority").alias("value"))
    return grid.join(top, [KEY, "frame_idx"], "left").withColumn("label", F.coalesce("value", base)).drop("value")


def span_frames(spans: DataFrame, rate: float, before: int = 0, after: int = 0) -> DataFrame:
    """Runs of spans in seconds, ends truncated to frames and moved."""
    return spans.select(KEY, ((F.col("start") * rate).cast("int") + before).alias("a"), ((F.col("end") * rate).cast("int") + after).alias("b"))


def pseudo_labels(grid: DataFrame, spans: DataFrame, cfg: PseudoLabelConfig = PseudoLabelConfig()) -> DataFrame:
    """0; -1 around accepted segments; 1 inside."""
    ok, e = spans.where("positive"), cfg.edge_frames
    return paint(grid.withColumn("label", F.lit(0)), [(span_frames(ok, cfg.frame_rate, -e, e), -1), (span_frames(ok, cfg.frame_rate, e, -e), 1)])


def base_class(cfg: PseudoLabelConfig, both: int):
    """3 for music without voice, `both` for voice over music, else 0."""
    v, a = voiced(cfg), F.col("acc_db") > cfg.acc_on_db
    return F.when(v & a, both).when(a, 3).otherwise(0)


def target_classes(grid: DataFrame, features: DataFrame, songs: DataFrame, cfg: PseudoLabelConfig = PseudoLabelConfig()) -> DataFrame:
    """Of grid(vod_id, frame_idx): songs 1; elsewhere by features (voice over music ignored); 4 for recordings without features."""
    has = features.select(KEY).distinct().withColumn("_has", F.lit(True))
    x = grid.join(features.select(KEY, "frame_idx", base_class(cfg, -1).alias("_b")), [KEY, "frame_idx"], "left").join(has, KEY, "left")
    x = x.select(KEY, "frame_idx", F.coalesce("_b", F.when(F.col("_has"), 0).otherwise(4)).alias("label"))
    return paint(x, [(span_frames(songs, cfg.frame_rate), 1)])


def other_classes(grid: DataFrame, features: DataFrame, spans: DataFrame, cfg: PseudoLabelConfig = PseudoLabelConfig()) -> DataFrame:
    """Recordings of others: accepted segments 2, their edges -1; elsewhere by features (voice over music 4). Recordings without features go."""
    e, ok = cfg.edge_frames, spans.where("positive")
    has = features.select(KEY).distinct()
    x = grid.join(has, KEY, "left_semi").join(features.select(KEY, "frame_idx", base_class(cfg, 4).alias("_b")), [KEY, "frame_idx"], "left")
    x = x.select(KEY, "frame_idx", F.coalesce("_b", F.lit(0)).alias("label"))
    return paint(x, [(span_frames(ok, cfg.frame_rate, -e, e), -1), (span_frames(ok, cfg.frame_rate, e, -e), 2)])


def pool_mean(frames: DataFrame, k: int, *values: str) -> DataFrame:
    """Means of k frames each; a tail of fewer goes."""
    x = frames.groupBy(KEY, F.floor(F.col("frame_idx") / k).cast("int").alias("frame_idx")).agg(F.count("*").alias("_n"), *[F.avg(v).alias(v) for v in values])
    return x.where(F.col("_n") == k).drop("_n")


def pool_labels(labels: DataFrame, k: int = 2) -> DataFrame:
    """1 if any is 1, else -1 if any is -1, else 0; a tail of fewer goes."""
    x = labels.groupBy(KEY, F.floor(F.col("frame_idx") / k).cast("int").alias("frame_idx")).agg(F.count("*").alias("_n"), F.max(F.col("label") == 1).alias("_p"), F.max(F.col("label") == -1).alias("_i"))
    return x.where(F.col("_n") == k).select(KEY, "frame_idx", F.when(F.col("_p"), 1).when(F.col("_i"), -1).otherwise(0).alias("label"))
