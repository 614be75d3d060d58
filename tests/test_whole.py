"""Queries run over all rows."""

from __future__ import annotations

import re

import pytest

from frameseg import registry
from frameseg.operators import labelling as L
from frameseg.plans.base import PCFG

#: Limits that are the feature: a slice of frames, a span of samples, the best configurations.
FEATURES = {"s3_frame_slice", "s7_span_read", "t1_top_configurations"}


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - FEATURES))
def test_sql_has_no_cuts(name):
    """No id subset, prefix or row cap; o2_split_partition's and p15_shard's remainders are what these queries compute."""
    sql = registry.oracle_sql()[name]
    assert not re.search(r"\blimit\b|frame_idx < \d|frame_idx between|event_id <|seg_no <|where vod_id = ", sql)


def test_alignment_ends_with_the_shorter_side(spark, monkeypatch):
    from frameseg.plans import core

    monkeypatch.setattr(core.X, "frames", lambda *a: spark.range(300).selectExpr("'v' vod_id", "id frame_idx", "0.5D prob"))
    monkeypatch.setattr(core.X, "labels", lambda *a: spark.range(200).selectExpr("'v' vod_id", "id frame_idx", "1 label"))
    assert sorted(r.frame_idx for r in core.p16(spark, "").collect()) == list(range(200))


def test_target_classes_without_features(spark):
    grid = spark.createDataFrame([(v, i) for v in "ab" for i in range(4)], "vod_id string, frame_idx long")
    x = spark.createDataFrame([("a", i, -20.0, -20.0) for i in range(2)], "vod_id string, frame_idx long, voc_db double, acc_db double")
    none = spark.createDataFrame([], "vod_id string, start double, end double")
    got = sorted((r.vod_id, r.frame_idx, r.label) for r in L.target_classes(grid, x, none, PCFG).collect())
    assert [r[2] for r in got] == [-1, -1, 0, 0, 4, 4, 4, 4]


def test_numbers_beyond_99(spark, monkeypatch):
    from frameseg.plans import core

    monkeypatch.setattr(core.X, "frames", lambda *a: None)
    monkeypatch.setattr(core.S, "probs_to_segments", lambda *a: spark.range(1, 106).selectExpr("'v' vod_id", "id seg_no"))
    assert sorted(r.clip for r in core.w12(spark, "").collect()) == sorted(f"v_song{i:02d}" for i in range(1, 106))
