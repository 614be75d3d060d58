"""Sequence algebra over (vod_id, frame_idx): smoothing, hysteresis, runs, gaps, durations, boundary refinement.

Every window and aggregate is partitioned by vod_id, so that a chain of these operators has one exchange. Frames without a value
(null or NaN) are below every threshold. Frames are numbered from 0 without gaps in each recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import PostProcessConfig

KEY = "vod_id"


def over(order: str = "frame_idx"):
    return W.partitionBy(KEY).orderBy(order)


def sane(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def pad_reflect(frames: DataFrame, h: int) -> DataFrame:
    """frames with column j: the position, and h mirrored copies beyond either end (d c b a | a b c d | d c b a), however short the series."""
    n, i = F.count("*").over(W.partitionBy(KEY)), F.col("frame_idx")
    x = frames.withColumn("n", n)
    t = F.sequence(-F.ceil(F.lit(h) / (2 * F.col("n"))).cast("int") - 1, F.ceil(F.lit(h) / (2 * F.col("n"))).cast("int") + 1)
    every = F.flatten(F.transform(t, lambda k: F.array(i + 2 * F.col("n") * k, -1 - i + 2 * F.col("n") * k)))
    inside = F.filter(every, lambda j: (j >= -h) & (j < F.col("n") + h))
    at = F.when((i >= h) & (i < F.col("n") - h), F.array(i.cast("long"))).otherwise(inside)
    return x.withColumn("j", F.explode(at))


def pad_edge(frames: DataFrame, left: int, right: int) -> DataFrame:
    """frames with column j: the first and last rows repeat beyond the ends."""
    n, i = F.count("*").over(W.partitionBy(KEY)), F.col("frame_idx")
    x = frames.withColumn("n", n)
    first = F.when((i == 0) & (left > 0), F.sequence(F.lit(-left), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    last = F.when((i == F.col("n") - 1) & (right > 0), F.sequence(F.col("n").cast("int"), F.col("n").cast("int") + right - 1)).otherwise(F.array().cast("array<int>"))
    return x.withColumn("j", F.explode(F.concat(F.array(i.cast("int")), first, last)))


def medians(frames: DataFrame, ks: list[int], value: str = "prob") -> DataFrame:
    """frames with a column median_k for each k (odd): the median over k frames, mirrored at the ends. Missing values are below all others;
    where they are the median it is null. All windows share one sort."""
    h = max(ks) // 2
    low = F.lit(float("-inf"))
    x = pad_reflect(frames.withColumn("_v", F.coalesce(sane(F.col(value)), low)), h)
    for k in ks:
        frame = W.partitionBy(KEY).orderBy("j").rowsBetween(-(k // 2), k // 2)
        x = x.withColumn(f"median_{k}", F.get(F.array_sort(F.collect_list("_v").over(frame)), F.lit(k // 2)) if k > 1 else F.col("_v"))
    x = x.where((F.col("j") >= 0) & (F.col("j") < F.col("n"))).drop("j", "n", "_v")
    return x.withColumns({f"median_{k}": F.nullif(f"median_{k}", low) for k in ks})


def smooth(frames: DataFrame, k: int, value: str = "prob") -> DataFrame:
    """Median over k (odd) frames, mirrored at the ends; the value column is replaced. Missing values are below all others."""
    if k == 1:
        return frames
    return medians(frames, [k], value).withColumn(value, F.col(f"median_{k}")).drop(f"median_{k}")


def vote(frames: DataFrame, k: int, flag: str) -> DataFrame:
    """Majority of a boolean column over k frames, mirrored at the ends; null votes against."""
    h = k // 2
    frame = W.partitionBy(KEY).orderBy("j").rowsBetween(-h, h)
    x = pad_reflect(frames, h).withColumn("_v", F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int")).over(frame) >= h + 1)
    return x.where((F.col("j") >= 0) & (F.col("j") < F.col("n"))).withColumn(flag, F.col("_v")).drop("_v", "j", "n")


def rolling_std(frames: DataFrame, value: str, k: int = 15) -> DataFrame:
    """Population standard deviation over k frames, ends repeated; in column roll_std."""
    left, right = k // 2, k - 1 - k // 2
    frame = W.partitionBy(KEY).orderBy("j").rowsBetween(-left, right)
    x = pad_edge(frames, left, right).withColumn("roll_std", F.stddev_pop(value).over(frame))
    return x.where((F.col("j") >= 0) & (F.col("j") < F.col("n"))).drop("j", "n")


def islands(frames: DataFrame, keep: Column, *aggregates: Column) -> DataFrame:
    """Runs [a, b) of frames where keep holds."""
    k = F.coalesce(keep, F.lit(False))
    x = frames.withColumn("_k", k).withColumn("_s", F.col("_k") & ~F.lag("_k", 1, False).over(over()))
    x = x.withColumn("_i", F.sum(F.col("_s").cast("int")).over(over().rowsBetween(W.unboundedPreceding, 0)))
    return x.where("_k").groupBy(KEY, "_i").agg(F.min("frame_idx").alias("a"), (F.max("frame_idx") + 1).alias("b"), *aggregates).drop("_i")


def hysteresis_runs(frames: DataFrame, on: float, off: float, value: str = "prob") -> DataFrame:
    """Runs between crossings: islands of value >= off that somewhere reach on."""
    if on < off:
        raise ValueError("on below off")
    v = sane(F.col(value))
    return islands(frames, v >= off, F.max(v).alias("_top")).where(F.col("_top") >= on).drop("_top")


def hysteresis_mask(frames: DataFrame, on: float, off: float, value: str = "prob") -> DataFrame:
    """frames with a boolean column active."""
    v = sane(F.col(value))
    k = F.coalesce(v >= off, F.lit(False))
    x = frames.withColumn("_k", k).withColumn("_i", F.sum((F.col("_k") & ~F.lag("_k", 1, False).over(over())).cast("int")).over(over().rowsBetween(W.unboundedPreceding, 0)))
    top = F.max(F.when(F.col("_k"), v)).over(W.partitionBy(KEY, "_i"))
    return x.withColumn("active", F.col("_k") & F.coalesce(top >= on, F.lit(False))).drop("_k", "_i")


def merge_runs(runs: DataFrame, gap: float, rate: float = 1.0) -> DataFrame:
    """Runs no further apart than gap (seconds at this rate) become one. Runs are disjoint."""
    far = (F.col("a") - F.lag("b").over(over("a"))) / F.lit(float(rate)) > gap
    x = runs.withColumn("_g", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(over("a").rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(KEY, "_g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_g")


def at_least(runs: DataFrame, seconds: float, rate: float) -> DataFrame:
    return runs.where((F.col("b") - F.col("a")) / F.lit(float(rate)) >= seconds)


def refine(frames: DataFrame, runs: DataFrame, cfg: PostProcessConfig, value: str = "prob") -> DataFrame:
    """Outer boundaries move in to the first and last core run and out again while value >= edge_threshold; kept as they are without a
    core run or if less than min_song_s would be left."""
    r = runs.withColumn("_n", F.row_number().over(over("a")))
    at = r.select(KEY, "_n", "a", "b", F.explode(F.sequence("a", F.col("b") - 1)).alias("frame_idx"))
    x = at.join(frames.select(KEY, "frame_idx", sane(F.col(value)).alias("_v")), [KEY, "frame_idx"])
    w = W.partitionBy(KEY, "_n").orderBy("frame_idx")
    x = x.withColumn("_c", F.coalesce(F.col("_v") >= cfg.core_threshold, F.lit(False)))
    x = x.withColumn("_i", F.sum((F.col("_c") & ~F.lag("_c", 1, False).over(w)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    core = x.where("_c").groupBy(KEY, "_n", "_i").agg(F.min("frame_idx").alias("ca"), (F.max("frame_idx") + 1).alias("cb"))
    core = core.where(F.col("cb") - F.col("ca") >= cfg.core_frames).groupBy(KEY, "_n").agg(F.min("ca").alias("ca"), F.max("cb").alias("cb"))
    low = x.join(core, [KEY, "_n"]).where(F.coalesce(F.col("_v") < cfg.edge_threshold, F.lit(True)))
    edge = low.groupBy(KEY, "_n").agg((F.max(F.when(F.col("frame_idx") < F.col("ca"), F.col("frame_idx"))) + 1).alias("na"), F.min(F.when(F.col("frame_idx") >= F.col("cb"), F.col("frame_idx"))).alias("nb"))
    out = r.join(core, [KEY, "_n"], "left").join(edge, [KEY, "_n"], "left")
    na, nb = F.coalesce("na", "a"), F.coalesce("nb", "b")
    ok = F.col("ca").isNotNull() & ((nb - na) / F.lit(cfg.frame_rate) >= cfg.min_song_s)
    return out.select(KEY, F.when(ok, na).otherwise(F.col("a")).alias("a"), F.when(ok, nb).otherwise(F.col("b")).alias("b"))


def segments(runs: DataFrame, cfg: PostProcessConfig, durations: DataFrame | None = None) -> DataFrame:
    """Numbered seconds with padded cuts; a recording with a duration (vod_id, total_s) has its cuts clipped to it."""
    x = runs if durations is None else runs.join(durations, KEY, "left")
    s, e = F.col("a") / F.lit(cfg.frame_rate), F.col("b") / F.lit(cfg.frame_rate)
    end = e + cfg.pad_after_s
    end = end if durations is None else F.least(end, F.col("total_s"))  # least passes over null
    return x.select(KEY, F.row_number().over(over("a")).alias("seg_no"), F.round(s, 2).alias("start"), F.round(e, 2).alias("end"), F.round(F.greatest(F.lit(0.0), s - cfg.pad_before_s), 2).alias("cut_start"), F.round(end, 2).alias("cut_end"))


def song_runs(frames: DataFrame, cfg: PostProcessConfig = PostProcessConfig(), smoothed: bool = False) -> DataFrame:
    """Frames to merged runs. Two merges with no filter between are one at the larger gap."""
    p = frames if smoothed else smooth(frames, cfg.median_frames)
    runs = at_least(hysteresis_runs(p, cfg.on_threshold, cfg.off_threshold), cfg.min_blip_s, cfg.frame_rate)
    runs = at_least(merge_runs(runs, max(cfg.max_gap_s, cfg.merge_gap_s), cfg.frame_rate), cfg.min_song_s, cfg.frame_rate)
    return refine(p, runs, cfg) if cfg.refine_edges else runs


def probs_to_segments(frames: DataFrame, cfg: PostProcessConfig = PostProcessConfig(), durations: DataFrame | None = None) -> DataFrame:
    return segments(song_runs(frames, cfg), cfg, durations)


def rasterise(grid: DataFrame, spans: DataFrame, rate: float, half_even: bool = False) -> DataFrame:
    """grid(vod_id, frame_idx) with inside 0/1: whether a span (vod_id, start, end in seconds) covers the frame. Ends are truncated, or rounded half to even."""
    to = (lambda c: F.rint(c * rate)) if half_even else (lambda c: c * rate)
    s, e = to(F.col("start")).cast("int"), to(F.col("end")).cast("int")
    at = spans.select(KEY, F.greatest(F.lit(0), s).alias("a"), e.alias("b")).where("a < b")
    covered = at.select(KEY, F.explode(F.sequence("a", F.col("b") - 1)).alias("frame_idx")).distinct().withColumn("inside", F.lit(1))
    return grid.join(covered, [KEY, "frame_idx"], "left").withColumn("inside", F.coalesce("inside", F.lit(0)))


def standardise(frames: DataFrame, size: int, value: str = "prob", tiny: float = 1e-8) -> DataFrame:
    """frames with mean, scale (sample deviation and a little) and z of each piece of `size` frames; z * scale + mean is the value again."""
    w = W.partitionBy(KEY, F.floor(F.col("frame_idx") / size))
    x = frames.withColumn("mean", F.avg(value).over(w)).withColumn("scale", F.stddev_samp(value).over(w) + tiny)
    return x.withColumn("z", (F.col(value) - F.col("mean")) / F.col("scale"))


def timeline_offsets(frames: DataFrame, rate: float, apart: float = 3600.0) -> DataFrame:
    """vod_id, t_off: where each recording begins on one timeline, in the order of vod_id, so that none meet. A row for each recording."""
    n = frames.groupBy(KEY).agg((F.count("*") / F.lit(float(rate)) + apart).alias("_len"))
    return n.select(KEY, F.coalesce(F.sum("_len").over(W.orderBy(KEY).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("t_off"))


def short_pool(frames: DataFrame, value: str = "prob") -> DataFrame:
    """frames with pooled: the largest of three neighbours plus the mean of three, of which those beyond the ends count as 0."""
    w = over().rowsBetween(-1, 1)
    return frames.withColumn("pooled", F.max(value).over(w) + F.sum(value).over(w) / 3)


def padded_tiles(frames: DataFrame, size: int, **fill) -> DataFrame:
    """frames with tile (from 0): tiles of `size` frames side by side, the last one filled up with frames that have these values."""
    n = frames.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") % size > 0)
    more = n.select(KEY, F.explode(F.sequence(F.col("n"), F.ceil(F.col("n") / size) * size - 1)).alias("frame_idx")).withColumns({c: F.lit(v) for c, v in fill.items()})
    x = frames.select(KEY, F.col("frame_idx").cast("long").alias("frame_idx"), *fill).unionByName(more)
    return x.withColumn("tile", F.floor(F.col("frame_idx") / size))
