"""Splits, unions, sampling and parameter search over manifests of recordings. Draws are hashes of a seed and the draw's number: replayable."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import PostProcessConfig
from . import metrics as M
from .sequence import KEY, medians

#: Points of a parameter search at most, as they are broadcast.
GRID = 100_000


def ranked_split(items: DataFrame, amount: str, ranks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """items with split: val for these ranks (from 0) by amount, ties by stem."""
    return items.withColumn("split", F.when((F.row_number().over(W.orderBy(F.desc(amount), "stem")) - 1).isin(*ranks), "val").otherwise("train"))


def largest_per_group_split(items: DataFrame, group: str, amount: str) -> DataFrame:
    """items with split: val for the largest of each group."""
    return items.withColumn("split", F.when(F.row_number().over(W.partitionBy(group).orderBy(F.desc(amount), "stem")) == 1, "val").otherwise("train"))


def with_focus(items: DataFrame, spans: DataFrame) -> DataFrame:
    """items with focus: their positive spans in order, null without any."""
    f = spans.where("positive").groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("focus"))
    return items.join(f, KEY, "left")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a hash of the seed and whole numbers or texts; null counts as 'null'."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def weighted_choice(items: DataFrame, draws: DataFrame, weight: str, seed: int) -> DataFrame:
    """draws(i) with the item (a recording's row) each takes by weight; a weight of 0 or null counts as 1. Items' shares of [0, 1) are cut into
    equal cells, so that the join has a key."""
    w = F.coalesce(F.nullif(F.col(weight).cast("double"), F.lit(0.0)), F.lit(1.0))
    upto = W.orderBy(KEY).rowsBetween(W.unboundedPreceding, 0)
    x = items.withColumn("_w", w).withColumn("_all", F.sum("_w").over(W.partitionBy())).withColumn("_sum", F.sum("_w").over(upto))
    x = x.withColumn("_hi", F.col("_sum") / F.col("_all")).withColumn("_lo", (F.col("_sum") - F.col("_w")) / F.col("_all"))
    cells = 1024
    x = x.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * cells), F.least(F.floor(F.col("_hi") * cells), F.lit(cells - 1)))))
    d = draws.withColumn("_u", uniform(seed, F.col("i"))).withColumn("_cell", F.floor(F.col("_u") * cells))
    return d.join(x, "_cell").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).drop("_u", "_cell", "_lo", "_hi", "_w", "_sum", "_all")


def crop_start(n: Column, window: int, seed: int, *parts) -> Column:
    """A uniform start below n - window, 0 for a window as long as the recording."""
    return F.floor(uniform(seed, *parts) * F.greatest(F.lit(1), n - window)).cast("int")


def clip_start(start: Column, n: Column, window: int) -> Column:
    return F.least(F.greatest(F.lit(0), start), F.greatest(F.lit(0), n - window))


def parameter_grid(**values) -> list[dict]:
    return [dict(zip(values, v, strict=True)) for v in itertools.product(*values.values())]


def grid_search(frames: DataFrame, labels: DataFrame, grid: list[dict], base: PostProcessConfig, iou: float = 0.5) -> DataFrame:
    """Event scores of each point of a grid.

    Frames are read and sorted once: all medians are windows over one sort, and a frame is copied for each (median, off) pair it reaches, for
    which runs are cut in the same partitions. From there on rows are runs. Points that differ in nothing but a gap that another
    covers are computed once. The grid is broadcast; it is a list of the caller's, of at most GRID points.
    """
    if len(grid) > GRID:
        raise ValueError(f"more than {GRID} points")
    spark = frames.sparkSession
    points = [PostProcessConfig(**{**base.__dict__, **g}) for g in grid]
    keys = [(c.median_frames, float(c.on_threshold), float(c.off_threshold), float(max(c.max_gap_s, c.merge_gap_s)), float(c.min_song_s)) for c in points]
    point = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    p = F.broadcast(spark.createDataFrame([(i, *k) for k, i in point.items()], "point int, k int, on double, off double, gap double, min_song_s double"))
    pairs = sorted({(k, off) for k, _, off, *_ in point})
    ks = sorted({k for k, _ in pairs})
    x = medians(frames, ks).select(KEY, "frame_idx", *(f"median_{k}" for k in ks))
    reached = F.array(*(F.when(F.col(f"median_{k}") >= off, F.struct(F.lit(k).alias("k"), F.lit(off).alias("off"), F.col(f"median_{k}").alias("v"))) for k, off in pairs))
    x = x.select(KEY, "frame_idx", F.explode(F.filter(reached, lambda r: r.isNotNull())).alias("r")).select(KEY, "frame_idx", "r.k", "r.off", "r.v")
    w = W.partitionBy(KEY, "k", "off").orderBy("frame_idx")
    x = x.withColumn("_s", F.coalesce(F.lag("frame_idx").over(w) < F.col("frame_idx") - 1, F.lit(True)))
    x = x.withColumn("_i", F.sum(F.col("_s").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = x.groupBy(KEY, "k", "off", "_i").agg(F.min("frame_idx").alias("a"), (F.max("frame_idx") + 1).alias("b"), F.max("v").alias("top"))
    rate = F.lit(base.frame_rate)
    x = runs.where((F.col("b") - F.col("a")) / rate >= base.min_blip_s).join(p, ["k", "off"]).where(F.col("top") >= F.col("on"))
    w = W.partitionBy(KEY, "point").orderBy("a")
    far = (F.col("a") - F.lag("b").over(w)) / rate > F.col("gap")
    x = x.withColumn("_g", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    x = x.groupBy(KEY, "point", "_g", "min_song_s").agg(F.min("a").alias("a"), F.max("b").alias("b")).where((F.col("b") - F.col("a")) / rate >= F.col("min_song_s"))
    pred = x.select("point", KEY, F.round(F.col("a") / rate, 2).alias("start"), F.round(F.col("b") / rate, 2).alias("end"))
    true = M.truth_segments(labels, base.frame_rate, base.merge_gap_s)
    if iou >= 0.5:
        m = M.match_join(pred, true, iou, ["point"]).select("point", F.lit(0).alias("np"), F.lit(1).alias("m"))
    else:  # the greedy matcher's groups: a point's part of a recording
        named = lambda d: d.withColumn(KEY, F.concat_ws("|", "point", KEY))
        m = M.match_greedy(named(pred), named(true.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(len(point) - 1))))), iou)
        m = m.select(F.split(KEY, r"\|")[0].cast("int").alias("point"), F.lit(0).alias("np"), F.lit(1).alias("m"))
    n = m.unionByName(pred.select("point", F.lit(1).alias("np"), F.lit(0).alias("m"))).groupBy("point").agg(F.sum("np").alias("_p"), F.sum("m").alias("event_tp"))
    rows = [(i, point[k], float(c.on_threshold), float(c.off_threshold), float(c.median_s), float(c.max_gap_s), float(c.min_song_s)) for i, (k, c) in enumerate(zip(keys, points, strict=True))]
    g = F.broadcast(spark.createDataFrame(rows, "grid_idx int, point int, on_threshold double, off_threshold double, median_s double, max_gap_s double, min_song_s double"))
    out = n.join(g, "point", "right").crossJoin(true.agg(F.count("*").alias("_t"))).fillna(0, ["_p", "event_tp"])  # one row with the number of true segments
    out = out.withColumn("event_precision", M.ratio(F.col("event_tp"), F.col("_p"))).withColumn("event_recall", M.ratio(F.col("event_tp"), F.col("_t")))
    p, r = F.col("event_precision"), F.col("event_recall")
    out = out.withColumn("event_f1", M.ratio(2 * p * r, p + r))
    return out.select("grid_idx", "on_threshold", "off_threshold", "median_s", "max_gap_s", "min_song_s", "event_precision", "event_recall", "event_f1", "event_tp", (F.col("_p") - F.col("event_tp")).alias("event_fp"), (F.col("_t") - F.col("event_tp")).alias("event_fn"))


def top_configurations(results: DataFrame, n: int = 20) -> DataFrame:
    return results.orderBy(F.desc("event_f1"), "grid_idx").limit(n)
