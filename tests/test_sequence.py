"""Sequence operators against small numpy versions of their definitions."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameseg.operators import sequence as S
from frameseg.schemas import PostProcessConfig

SCHEMA = "vod_id string, frame_idx int, prob double"


def frame_table(spark, series: dict[str, list]):
    rows = [(k, i, None if v is None else float(v)) for k, s in series.items() for i, v in enumerate(s)]
    return spark.createDataFrame(rows, SCHEMA)


def mirrored(x, h):
    n = len(x)
    at = [j % (2 * n) for j in range(-h, n + h)]
    return np.array([x[m] if m < n else x[2 * n - 1 - m] for m in at])


def np_smooth(x, k):
    p = mirrored(np.asarray(x, float), k // 2)
    return np.array([np.median(p[i : i + k]) for i in range(len(x))])


def np_hysteresis(p, on, off):
    def one(q):
        state, out = False, []
        for v in q:
            state = v >= on if not state else v >= off
            out.append(state)
        return np.array(out, bool)

    return one(p) | one(p[::-1])[::-1]


def np_runs(mask):
    d = np.flatnonzero(np.diff(np.r_[0, np.asarray(mask, int), 0]))
    return list(zip(d[::2].tolist(), d[1::2].tolist(), strict=True))


def np_merge(runs, gap, rate):
    out = []
    for a, b in runs:
        if out and (a - out[-1][1]) / rate <= gap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def np_songs(x, cfg):
    p = np_smooth(x, cfg.median_frames) if len(x) else np.array([])
    runs = [(a, b) for a, b in np_runs(np_hysteresis(p, cfg.on_threshold, cfg.off_threshold)) if (b - a) / cfg.frame_rate >= cfg.min_blip_s]
    runs = np_merge(np_merge(runs, cfg.max_gap_s, cfg.frame_rate), cfg.merge_gap_s, cfg.frame_rate)
    return [(a, b) for a, b in runs if (b - a) / cfg.frame_rate >= cfg.min_song_s]


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(1)
    out = {"one": [0.7], "two": [0.7, 0.1], "low": [0.1] * 30, "high": [0.9] * 30, "edges": [0.6, 0.4, 0.39, 0.4, 0.6, 0.61, 0.4]}
    for k in range(20):
        n = int(rng.integers(3, 90))
        out[f"r{k}"] = np.round(np.clip(np.cumsum(rng.normal(0, 0.2, n)) % 2 - 0.5, 0, 1), 3).tolist()
    return out


def collected(df, *cols):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.vod_id, []).append(tuple(r[c] for c in cols))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("k", [1, 3, 9, 21])
def test_smooth(spark, series, k):
    got = collected(S.smooth(frame_table(spark, series), k), "frame_idx", "prob")
    for name, x in series.items():
        assert [v for _, v in got[name]] == np_smooth(x, k).tolist(), name


def test_hysteresis_and_mask(spark, series):
    f = frame_table(spark, series)
    runs, mask = collected(S.hysteresis_runs(f, 0.6, 0.4), "a", "b"), collected(S.hysteresis_mask(f, 0.6, 0.4), "frame_idx", "active")
    for name, x in series.items():
        want = np_hysteresis(np.array(x), 0.6, 0.4)
        assert [m for _, m in mask[name]] == want.tolist()
        assert runs.get(name, []) == np_runs(want)


@pytest.mark.parametrize("cfg", [PostProcessConfig(frame_rate=1.0, min_blip_s=2, merge_gap_s=4, max_gap_s=2, min_song_s=6), PostProcessConfig(frame_rate=0.5, min_blip_s=2, max_gap_s=12, merge_gap_s=6, min_song_s=8)])
def test_songs(spark, series, cfg):
    got = collected(S.song_runs(frame_table(spark, series), cfg), "a", "b")
    for name, x in series.items():
        assert got.get(name, []) == np_songs(x, cfg), name


def test_merge_is_inclusive_and_idempotent(spark):
    runs = spark.createDataFrame([("v", 0, 10), ("v", 20, 30), ("v", 41, 50)], "vod_id string, a int, b int")
    once = S.merge_runs(runs, 10, 1.0)
    assert collected(once, "a", "b") == {"v": [(0, 30), (41, 50)]}
    assert collected(S.merge_runs(once, 10, 1.0), "a", "b") == collected(once, "a", "b")


def test_lengths_at_the_limit_stay(spark):
    runs = spark.createDataFrame([("v", 0, 50), ("v", 100, 149)], "vod_id string, a int, b int")
    assert collected(S.at_least(runs, 50, 1.0), "a", "b") == {"v": [(0, 50)]}


def np_refine(p, a, b, cfg):
    runs = [(x, y) for x, y in np_runs(p[a:b] >= cfg.core_threshold) if y - x >= cfg.core_frames]
    if not runs:
        return a, b
    na, nb = a + runs[0][0], a + runs[-1][1]
    while na > a and p[na - 1] >= cfg.edge_threshold:
        na -= 1
    while nb < b and p[nb] >= cfg.edge_threshold:
        nb += 1
    return (a, b) if (nb - na) / cfg.frame_rate < cfg.min_song_s else (na, nb)


def test_refine(spark, series):
    cfg = PostProcessConfig(frame_rate=1.0, min_blip_s=1, merge_gap_s=3, max_gap_s=2, min_song_s=4, core_min_s=2, refine_edges=True, core_threshold=0.7, edge_threshold=0.55)
    f = frame_table(spark, series)
    runs = S.song_runs(f, replace(cfg, refine_edges=False))
    got = collected(S.refine(S.smooth(f, cfg.median_frames), runs, cfg), "a", "b")
    for name, x in series.items():
        p = np_smooth(x, cfg.median_frames)
        assert got.get(name, []) == [np_refine(p, a, b, cfg) for a, b in np_songs(x, cfg)], name


def test_vote_and_rolling_std(spark, series):
    f = frame_table(spark, series).withColumn("c", F.col("prob") > 0.5)
    got, std = collected(S.vote(f, 9, "c"), "frame_idx", "c"), collected(S.rolling_std(f, "prob", 15), "frame_idx", "roll_std")
    for name, x in series.items():
        assert [v for _, v in got[name]] == (np_smooth(np.array(x) > 0.5, 9) > 0.5).tolist()
        p = np.pad(np.array(x), (7, 7), mode="edge")
        np.testing.assert_allclose([v for _, v in std[name]], [p[i : i + 15].std() for i in range(len(x))], atol=1e-9)


def test_nan_and_null_are_below(spark):
    f = frame_table(spark, {"v": [0.9, float("nan"), 0.9, None, 0.9]})
    assert collected(S.hysteresis_runs(f, 0.6, 0.4), "a", "b") == {"v": [(0, 1), (2, 3), (4, 5)]}


def test_thresholds_in_wrong_order_are_rejected():
    with pytest.raises(ValueError):
        PostProcessConfig(on_threshold=0.3, off_threshold=0.4)


def test_empty(spark):
    f = spark.createDataFrame([], SCHEMA)
    assert S.probs_to_segments(f, PostProcessConfig()).count() == 0


def test_segment_invariants(spark, series):
    cfg = PostProcessConfig(frame_rate=1.0, min_blip_s=2, merge_gap_s=4, max_gap_s=2, min_song_s=6)
    for rows in collected(S.probs_to_segments(frame_table(spark, series), cfg), "seg_no", "start", "end", "cut_start", "cut_end").values():
        for k, (n, s, e, cs, ce) in enumerate(rows):
            assert n == k + 1 and cs <= s < e <= ce and e - s >= 6
            assert k == 0 or s - rows[k - 1][2] > 4


def test_rounding_trap(spark):
    """Frames to rounded seconds and back loses a frame at some indices."""
    grid = spark.range(0, 130).select(F.lit("v").alias("vod_id"), F.col("id").cast("int").alias("frame_idx"))
    back = lambda i: int(round(i / 3.125, 2) * 3.125)
    assert [i for i in range(120) if back(i) != i][:4] == [29, 57, 58, 113]
    spans = spark.createDataFrame([("v", round(29 / 3.125, 2), round(58 / 3.125, 2))], "vod_id string, start double, end double")
    got = [r.frame_idx for r in S.rasterise(grid, spans, 3.125).where("inside = 1").collect()]
    assert (min(got), max(got) + 1) == (28, 57)
    got = [r.frame_idx for r in S.rasterise(grid, spans, 3.125, half_even=True).where("inside = 1").collect()]
    assert (min(got), max(got) + 1) == (29, 58)


def test_one_exchange(spark, tmp_path):
    p = str(tmp_path / "f")
    frame_table(spark, {"v": [0.5] * 10}).write.parquet(p)
    x = S.probs_to_segments(spark.read.parquet(p), PostProcessConfig())
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_missing_frames_are_below_all_others_when_smoothed(spark):
    """Of three frames with a missing middle one the median is the lower of the two others; where most are missing it is missing."""
    rows = [("a", i, p) for i, p in enumerate([0.1, float("nan"), 0.9, 0.2, None, 0.8, 0.7])] + [("b", 0, None), ("b", 1, None), ("b", 2, 0.9)]
    got = S.smooth(spark.createDataFrame(rows, "vod_id string, frame_idx int, prob double"), 3)
    got = {(r.vod_id, r.frame_idx): r.prob for r in got.collect()}
    assert [got["a", i] for i in range(7)] == [0.1, 0.1, 0.2, 0.2, 0.2, 0.7, 0.7]
    assert [got["b", i] for i in range(3)] == [None, None, 0.9]
    runs = S.hysteresis_runs(S.smooth(spark.createDataFrame([("c", i, p) for i, p in enumerate([0.1, None, 0.9, None, 0.1])], "vod_id string, frame_idx int, prob double"), 3), 0.6, 0.4)
    assert runs.count() == 0


def test_votes_without_a_value_are_against(spark):
    rows = [("a", i, v) for i, v in enumerate([True, None, True, None, None, True])]
    got = S.vote(spark.createDataFrame(rows, "vod_id string, frame_idx int, c boolean"), 3, "c").orderBy("frame_idx").collect()
    assert [r.c for r in got] == [True, True, False, False, False, True]
