"""Frame and event metrics, pooled and by recording; matching of predicted and true segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequence import KEY, islands, merge_runs


def ratio(num: Column, den: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(den > 0, num / den).otherwise(0.0)


def scored(frames: DataFrame, labels: DataFrame, threshold: float = 0.5, mask_ignored: bool = True) -> DataFrame:
    """One row a frame: predicted p, true t. Ignored frames (label < 0) go, or count as negative."""
    x = frames.join(labels, [KEY, "frame_idx"])
    x = x.where("label >= 0") if mask_ignored else x
    return x.select(KEY, "frame_idx", (F.col("prob") >= threshold).alias("p"), (F.col("label") >= 0.5).alias("t"))


def confusion() -> list[Column]:
    p, t = F.col("p"), F.col("t")
    return [F.count_if(c).alias(n) for n, c in (("tp", p & t), ("fp", p & ~t), ("fn", ~p & t), ("tn", ~p & ~t))]


def frame_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy from tp, fp, fn, tn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    x = counts.withColumn("frame_precision", p).withColumn("frame_recall", r)
    p, r = F.col("frame_precision"), F.col("frame_recall")
    return x.withColumn("frame_f1", ratio(2 * p * r, p + r)).withColumn("frame_acc", (F.col("tp") + F.col("tn")) / F.greatest(F.lit(1), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def truth_segments(labels: DataFrame, rate: float, merge_gap_s: float) -> DataFrame:
    """Positive runs in seconds, merged."""
    runs = islands(labels, F.col("label") >= 0.5)
    s = runs.select(KEY, (F.col("a") / F.lit(rate)).alias("a"), (F.col("b") / F.lit(rate)).alias("b"))
    return merge_runs(s, merge_gap_s).select(KEY, F.col("a").alias("start"), F.col("b").alias("end"))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap by the hull of both; 0 for empty hulls."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / hull).otherwise(0.0)


#: Seconds of a cell: segments are joined by recording and cell, so that a long recording isn't all pairs of its segments.
CELL = 3600.0


def match_join(pred: DataFrame, true: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Matches of segments(vod_id, start, end), both sides apart: from 0.5 on a segment has one partner at most, so a join is enough.
    by: columns of pred that tell sets of predictions apart."""
    if threshold < 0.5:
        raise ValueError("below 0.5 a segment may have several partners: match_greedy")

    def cells(s: DataFrame, a: str, b: str, *more: str) -> DataFrame:
        x = s.select(KEY, F.col("start").alias(a), F.col("end").alias(b), *more)
        return x.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor(F.greatest(F.col(a), F.col(b)) / CELL))))

    x = cells(pred, "ps", "pe", *(by or [])).join(cells(true, "ts", "te"), [KEY, "_cell"]).where((F.col("ps") < F.col("te")) & (F.col("ts") < F.col("pe")))
    # a pair meets in all cells that both cover; it counts in the one where the later begins
    x = x.where(F.col("_cell") == F.floor(F.greatest("ps", "ts") / CELL)).drop("_cell")
    return x.withColumn("iou", iou(F.col("ps"), F.col("pe"), F.col("ts"), F.col("te"))).where(F.col("iou") >= threshold)


def match_greedy(pred: DataFrame, true: DataFrame, threshold: float) -> DataFrame:
    """Predictions by (start, end) each take the best truth still free. State runs across a recording's segments, so recordings are groups."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")

    def run(key, p, t):
        import pandas as pd

        free, out = list(zip(t["start"], t["end"], strict=True)), []
        free.sort()
        taken = [False] * len(free)
        for s, e in sorted(zip(p["start"], p["end"], strict=True)):
            best, at = 0.0, -1
            for j, (ts, te) in enumerate(free):
                if not taken[j]:
                    hull = max(e, te) - min(s, ts)
                    v = max(0.0, min(e, te) - max(s, ts)) / hull if hull > 0 else 0.0
                    best, at = (v, j) if v > best else (best, at)
            if best >= threshold:
                taken[at] = True
                out.append((key[0], s, e, *free[at], best))
        return pd.DataFrame(out, columns=[KEY, "ps", "pe", "ts", "te", "iou"]).astype({c: "float64" for c in ("ps", "pe", "ts", "te", "iou")})

    p, t = pred.select(KEY, "start", "end"), true.select(KEY, "start", "end")
    return p.groupBy(KEY).cogroup(t.groupBy(KEY)).applyInPandas(run, f"{KEY} string, ps double, pe double, ts double, te double, iou double")


def match(pred: DataFrame, true: DataFrame, threshold: float = 0.5) -> DataFrame:
    return match_join(pred, true, threshold) if threshold >= 0.5 else match_greedy(pred, true, threshold)


def event_scores(pred: DataFrame, true: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Event counts, precision, recall, F1 and boundary errors; over all recordings, or by some columns."""
    by = by or []
    m = match(pred, true, threshold).select(KEY, F.lit(0).alias("np"), F.lit(0).alias("nt"), F.lit(1).alias("m"), F.abs(F.col("ps") - F.col("ts")).alias("on_err"), F.abs(F.col("pe") - F.col("te")).alias("off_err"))
    none = [F.lit(None).cast("double").alias(c) for c in ("on_err", "off_err")]
    p = pred.select(KEY, F.lit(1).alias("np"), F.lit(0).alias("nt"), F.lit(0).alias("m"), *none)
    t = true.select(KEY, F.lit(0).alias("np"), F.lit(1).alias("nt"), F.lit(0).alias("m"), *none)
    x = m.unionByName(p).unionByName(t)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("np", "nt", "m")]
    x = x.groupBy(*by).agg(*sums, F.avg("on_err").alias("onset_mae_s"), F.avg("off_err").alias("offset_mae_s"))
    x = x.withColumn("event_precision", ratio(F.col("m"), F.col("np"))).withColumn("event_recall", ratio(F.col("m"), F.col("nt")))
    p, r = F.col("event_precision"), F.col("event_recall")
    x = x.withColumn("event_f1", ratio(2 * p * r, p + r))
    return x.select(*by, "event_precision", "event_recall", "event_f1", F.col("m").alias("event_tp"), (F.col("np") - F.col("m")).alias("event_fp"), (F.col("nt") - F.col("m")).alias("event_fn"), "onset_mae_s", "offset_mae_s")


def best_so_far(history: DataFrame, order: str, score: str) -> DataFrame:
    """history with is_best: a score above all before it."""
    before = F.max(score).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return history.withColumn("is_best", F.coalesce(F.col(score) > before, F.lit(True)))
