from __future__ import annotations

import numpy as np
import pytest

from frameseg.operators import metrics as M

SEG = "vod_id string, start double, end double"


def greedy(pred, true, threshold):
    taken, out = set(), []
    for s, e in sorted(pred):
        best, at = 0.0, None
        for j, (ts, te) in enumerate(true):
            hull = max(e, te) - min(s, ts)
            v = max(0.0, min(e, te) - max(s, ts)) / hull if hull > 0 else 0.0
            if j not in taken and v > best:
                best, at = v, j
        if at is not None and best >= threshold:
            taken.add(at)
            out.append((s, e, *true[at]))
    return sorted(out)


def apart(rng, n):
    x = np.sort(rng.choice(400, 2 * n, replace=False)).astype(float)
    return [(float(a), float(b) - 0.5) for a, b in zip(x[::2], x[1::2], strict=True)]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.3, 0.05])
def test_matching(spark, threshold):
    rng = np.random.default_rng(int(threshold * 100))
    data = {f"v{k}": (apart(rng, int(rng.integers(1, 12))), apart(rng, int(rng.integers(1, 12)))) for k in range(25)}
    p = spark.createDataFrame([(v, *s) for v, (a, _) in data.items() for s in a], SEG)
    t = spark.createDataFrame([(v, *s) for v, (_, b) in data.items() for s in b], SEG)
    got: dict = {v: [] for v in data}
    for r in M.match(p, t, threshold).collect():
        got[r.vod_id].append((r.ps, r.pe, r.ts, r.te))
    for v, (a, b) in data.items():
        assert sorted(got[v]) == greedy(a, b, threshold), v


def test_scores_without_segments(spark):
    none = spark.createDataFrame([], SEG)
    one = spark.createDataFrame([("v", 0.0, 10.0)], SEG)
    for p, t, want in ((none, none, (0, 0, 0)), (one, none, (0, 1, 0)), (none, one, (0, 0, 1)), (one, one, (1, 0, 0))):
        r = M.event_scores(p, t).collect()[0]
        assert (r.event_tp, r.event_fp, r.event_fn) == want
        assert (r.onset_mae_s is None) == (want[0] == 0)
        assert r.event_f1 == (1.0 if want[0] else 0.0)


def test_threshold_must_be_positive(spark):
    one = spark.createDataFrame([("v", 0.0, 10.0)], SEG)
    with pytest.raises(ValueError):
        M.match(one, one, 0.0)
    with pytest.raises(ValueError):
        M.match_join(one, one, 0.4)


def test_ignored_frames(spark):
    f = spark.createDataFrame([("v", i, p) for i, p in enumerate([0.9, 0.9, 0.1, 0.1, 0.9])], "vod_id string, frame_idx int, prob double")
    y = spark.createDataFrame([("v", i, v) for i, v in enumerate([1, 0, 1, 0, -1])], "vod_id string, frame_idx int, label int")
    for mask, fp in ((True, 1), (False, 2)):
        r = M.frame_scores(M.scored(f, y, mask_ignored=mask).agg(*M.confusion())).collect()[0]
        assert (r.tp, r.fp, r.fn, r.tn) == (1, fp, 1, 1)
    r = M.frame_scores(M.scored(f, y).where("false").agg(*M.confusion())).collect()[0]
    assert (r.frame_precision, r.frame_recall, r.frame_f1, r.frame_acc) == (0, 0, 0, 0)


def test_match_plan_has_no_nested_loop(spark, tmp_path):
    p = str(tmp_path / "s")
    spark.createDataFrame([("v", 0.0, 10.0)], SEG).write.parquet(p)
    x = spark.read.parquet(p)
    plan = M.match_join(x, x.select("vod_id", "start", "end"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
