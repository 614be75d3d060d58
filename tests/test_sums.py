"""Pseudo labels at their thresholds: sums in the order of frames, as the SQL has them, whatever the partitions."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest

from frameseg import registry

#: Draws for which the exact sustained share of a segment is the threshold, 0.16, and its sum in the order of frames comes out on one side.
DRAWS = (10045, 6040, 7740, 6235, 6470, 10083, 1430, 1326, 9303)


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    at, n = tmp_path_factory.mktemp("events"), 150
    rows = [(f"{r}-{copy}", f'{{"k": {10 * k}}}') for copy in range(6) for r in DRAWS for k in random.Random(r).choices(range(3, 9), k=n)]
    x = pd.DataFrame(rows, columns=["event_type", "props"])
    x = x.assign(event_id=range(len(x)), ts=pd.to_datetime(range(len(x)), unit="s").astype("datetime64[us]"), user_id=0, value=34.59)
    x.to_parquet(at / "events.parquet")
    return str(at)


@pytest.fixture
def shuffled(spark):
    """Joins as on large tables: frames of a segment come from many partitions."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def equal_to_sql(spark, at, name):
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view events as select * from '{at}/events.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, at).toPandas()[list(want.columns)]
    plain = lambda x: sorted(repr([float(v) if isinstance(v, (int, float)) else v for v in r]) for r in x.astype(object).itertuples(index=False, name=None))
    assert len(want) and plain(got) == plain(want)


@pytest.mark.parametrize("name", ["j5_focus_list", "m3_focus_frames", "p7_segment_quality", "j6_other_classes", "s6_segment_scan"])
def test_threshold(spark, events, shuffled, name):
    equal_to_sql(spark, events, name)


def test_ties_of_rounding(spark):
    from frameseg.plans.core import _millionths

    ties = [(2 * i + 1) / 2e6 for i in range(126_000, 127_000)]
    got = [r.x for r in spark.createDataFrame([(x,) for x in ties], "x double").coalesce(1).select(_millionths("x").alias("x")).collect()]
    assert got == [x for (x,) in duckdb.connect().execute("select round(x, 6) from (select unnest(?::double[]) as x)", [ties]).fetchall()]
