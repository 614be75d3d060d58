"""What users call: whole tasks, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import labelling, manifests, metrics, scoring, sequence, synthesis
from .operators.sequence import KEY
from .schemas import PostProcessConfig, PseudoLabelConfig

segment = sequence.probs_to_segments
tune = manifests.grid_search
synthesize = synthesis.synthesize


def score(frames: DataFrame, scorer, features: str, size: int = 2048, overlap: int = 128) -> DataFrame:
    """vod_id, frame_idx, prob: chunks are scored by themselves and their scores averaged where they overlap."""
    n = frames.groupBy(KEY).agg(F.count("*").alias("n"))
    x = scoring.score(scoring.in_chunks(frames, n, size, overlap), scorer, features)
    return scoring.overlap_add(x, frames)


def evaluate(frames: DataFrame, labels: DataFrame, cfg: PostProcessConfig | None = None, iou: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Scores over all recordings and by recording: frames at one half (ignored labels count as negative) and events after post-processing.
    Off is 0.3 unless cfg says otherwise."""
    cfg = cfg or PostProcessConfig(off_threshold=0.3)
    pred, true = sequence.probs_to_segments(frames, cfg), metrics.truth_segments(labels, cfg.frame_rate, cfg.merge_gap_s)
    of_frames = metrics.frame_scores(metrics.scored(frames, labels, mask_ignored=False).groupBy().agg(*metrics.confusion()))
    pooled = of_frames.crossJoin(metrics.event_scores(pred, true, iou))  # one row each
    counts = metrics.event_scores(pred, true, iou, [KEY]).select(KEY, (F.col("event_tp") + F.col("event_fn")).alias("n_true"), (F.col("event_tp") + F.col("event_fp")).alias("n_pred"), "event_f1")
    return pooled, counts


def pseudo_label(features: DataFrame, cfg: PseudoLabelConfig = PseudoLabelConfig()) -> tuple[DataFrame, DataFrame]:
    """Candidate segments with their qualities, and a label for each frame."""
    spans = labelling.pseudo_segments(features, cfg)
    return spans, labelling.pseudo_labels(features.select(KEY, "frame_idx"), spans, cfg)


def build_manifest(items: DataFrame, target: str, spans: DataFrame, val_stems: list[str] | None = None) -> DataFrame:
    """items(streamer, stem, vod_id, pos_seconds) with split and focus: of the target's recordings these stems or, without, ranks 1 and 3 by positive
    seconds are for validation; of every other streamer the largest one. Others' labels are 0 throughout and their accepted spans the focus."""
    own, rest = items.where(F.col("streamer") == target), items.where(F.col("streamer") != target)
    own = manifests.ranked_split(own, "pos_seconds") if not val_stems else own.withColumn("split", F.when(F.col("stem").isin(*val_stems), "val").otherwise("train"))
    rest = manifests.largest_per_group_split(rest, "streamer", "pos_seconds").withColumn("pos_seconds", F.lit(0.0))
    return own.unionByName(manifests.with_focus(rest, spans), allowMissingColumns=True)


def multiclass_labels(grid: DataFrame, features: DataFrame, songs: DataFrame, spans: DataFrame, targets: DataFrame, cfg: PseudoLabelConfig = PseudoLabelConfig()) -> DataFrame:
    """A class for each frame of grid(vod_id, frame_idx): recordings in targets(vod_id) by their songs (vod_id, start, end), all others by accepted spans."""
    own = grid.join(F.broadcast(targets.select(KEY).distinct()) if targets.count() <= 100_000 else targets.select(KEY).distinct(), KEY, "left_semi")
    rest = grid.join(targets.select(KEY).distinct(), KEY, "left_anti")
    return labelling.target_classes(own, features, songs, cfg).unionByName(labelling.other_classes(rest, features, spans, cfg))
