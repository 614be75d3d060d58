"""Training clips made of recordings' stems. Draws are hashes of a seed and the clip's number: replayable, and the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .manifests import uniform
from .sequence import KEY

#: Kinds of clips with their labels: another's voice over the target's music, that music alone, the target's voice over another's music.
KINDS = {"remix_other": 0, "accomp_only": 0, "voc_mismatch": 1}


def rms_db(samples: Column) -> Column:
    return 20 * F.log10(F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, v: a + v * v) / F.size(samples)) + 1e-8)


def remix_pairs(targets: DataFrame, others: DataFrame, per_kind: int, seed: int = 7) -> DataFrame:
    """clip, kind, label, target, other, gain_db for per_kind clips of each kind; targets and others have vod_id. Recordings are numbered (a row each,
    without their samples) and a clip draws numbers; without targets or others there are no clips."""
    spark = targets.sparkSession
    numbered = lambda d, name: d.select(F.col(KEY).alias(name), (F.row_number().over(W.orderBy(KEY)) - 1).alias(f"{name}_n"))
    t, o = numbered(targets, "target"), numbered(others, "other")
    counts = t.agg(F.count("*").alias("nt")).crossJoin(o.agg(F.count("*").alias("no")))  # one row
    x = spark.range(per_kind).select(F.col("id").alias("i"), F.explode(F.array(*map(F.lit, KINDS))).alias("kind")).crossJoin(counts).where("nt > 0 and no > 0")
    u = lambda k: uniform(seed, F.col("kind"), F.col("i"), F.lit(k))
    x = x.withColumn("target_n", F.floor(u(1) * F.col("nt"))).withColumn("other_n", F.when(F.col("kind") != "accomp_only", F.floor(u(2) * F.col("no"))))
    gain = F.when(F.col("kind") == "remix_other", u(3) * 6 - 2).when(F.col("kind") == "voc_mismatch", -(u(3) * 6 + 2))
    label = F.element_at(F.create_map(*(F.lit(v) for kv in KINDS.items() for v in kv)), F.col("kind"))
    x = x.join(t, "target_n").join(o, "other_n", "left")
    return x.select(F.format_string("%s_%03d", "kind", "i").alias("clip"), "kind", label.alias("label"), "target", "other", gain.alias("gain_db"))


def mix(pairs: DataFrame, stems: DataFrame) -> DataFrame:
    """pairs with samples, of stems(vod_id, voice, music): what is added is first brought to the other's level and gain_db more. Lengths go by the shorter one,
    sums are clamped to [-1, 1]."""
    a = stems.select(F.col(KEY).alias("target"), F.col("voice").alias("_tv"), F.col("music").alias("_tm"))
    b = stems.select(F.col(KEY).alias("other"), F.col("voice").alias("_ov"), F.col("music").alias("_om"))
    x = pairs.join(a, "target").join(b, "other", "left")
    remix = F.col("kind") == "remix_other"
    base, more = F.when(F.col("kind") == "voc_mismatch", F.col("_tv")).otherwise(F.col("_tm")), F.when(remix, F.col("_ov")).otherwise(F.col("_om"))
    n = F.least(F.size(base), F.size(more))
    x = x.select(*pairs.columns, F.when(F.col("other").isNull(), base).otherwise(F.slice(base, 1, n)).alias("_base"), F.slice(more, 1, n).alias("_more"))
    x = x.withColumn("_gain", F.pow(F.lit(10.0), (rms_db(F.col("_base")) - rms_db(F.col("_more")) + F.col("gain_db")) / 20))
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v))
    both = F.zip_with("_base", "_more", lambda p, q: clamp(p + q * F.col("_gain")))
    return x.select(*pairs.columns, F.when(F.col("_more").isNull(), F.transform("_base", clamp)).otherwise(both).alias("samples"))


def synthesize(targets: DataFrame, others: DataFrame, stems: DataFrame, per_kind: int = 40, seed: int = 7) -> DataFrame:
    return mix(remix_pairs(targets, others, per_kind, seed), stems)


def balanced_crops(labels: DataFrame, window: int, draws: int, pos_fraction: float = 0.5, seed: int = 7) -> DataFrame:
    """vod_id, i, start of `draws` windows a recording: with pos_fraction centred in a run of label 1 drawn evenly, else anywhere."""
    from .manifests import clip_start, crop_start
    from .sequence import islands

    runs = islands(labels, F.col("label") == 1).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))
    x = labels.groupBy(KEY).agg(F.count("*").alias("n")).join(runs, KEY, "left").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = lambda k: uniform(seed, F.col(KEY), F.col("i"), F.lit(k))
    run = F.get("runs", F.floor(u(2) * F.size("runs")).cast("int"))
    centre = run["a"] + F.floor(u(3) * F.greatest(run["b"] - run["a"], F.lit(1)))
    start = F.when((u(1) < pos_fraction) & F.col("runs").isNotNull(), centre - window // 2).otherwise(crop_start(F.col("n"), window, seed, F.col(KEY), F.col("i"), F.lit(4)))
    return x.select(KEY, "i", clip_start(start, F.col("n"), window).cast("long").alias("start"))


def span_samples(spans: DataFrame, seconds: float, seed: int = 7) -> DataFrame:
    """vod_id, start, length of one sample of each span (vod_id, start, end): the whole of a short one, else a part that begins anywhere."""
    n = F.col("end") - F.col("start")
    u = uniform(seed, F.col(KEY), F.round(F.col("start") * 1000).cast("long"))
    return spans.select(KEY, F.when(n <= seconds, F.col("start")).otherwise(F.col("start") + u * (n - seconds)).alias("start"), F.least(n, F.lit(float(seconds))).alias("length"))
