from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from frameseg.llm import multiindex as X


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        s = [(-float((x[j].astype(float) * x[ids.index(q)].astype(float)).sum()), i) for j, i in enumerate(ids) if i != q]
        out[q] = sorted(s)[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    ids = list(range(1500))
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, i string")
    want = brute(ids, x, [i for i in ids if i % 20 == 0])
    hit = n = 0
    got: dict = {}
    for r in X.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == want.keys()
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        for _, i, s in rows:
            assert i != q and abs(s - float((x[i].astype(float) * x[q].astype(float)).sum())) < 1e-12
        hit += len({r[1] for r in rows} & {i for _, i in want[q]})
        n += 20
    assert hit / n >= 0.9


def test_ties_few_rows_and_odd_vectors(spark):
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (20, [2.0, 0.0]), (7, [1.0, 1.0]), (5, [1.0, 1.0]), (9, None), (40, [0.0, 0.0]), (60, [None, 1.0]), (11, [float("nan"), 1.0]), (12, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    got = X.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 5, 2.0), (0, 2, 7, 2.0), (0, 3, 20, 2.0), (20, 1, 0, 2.0), (20, 2, 5, 2.0), (20, 3, 7, 2.0)]


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(X, "ENTRIES", 40)
    monkeypatch.setattr(X, "QUERIES", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in X.search(df, F.col("vec_id") % 20 == 0, recall=1.0).collect()}
    want = brute(list(range(300)), x, range(0, 300, 20))
    assert np.mean([got[q, k + 1] == i for q, rows in want.items() for k, (_, i) in enumerate(rows)]) > 0.9


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3 + i % 2).astype(np.float32).tolist()) for i in range(90)]
    got = X.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 < 2, k=4, recall=1.0).collect()
    assert {r.query_id for r in got} == {0, 1, 20, 21, 40, 41, 60, 61, 80, 81} and len(got) == 40
    assert all(r.query_id % 2 == r.vec_id % 2 for r in got)


def shares(spark, tmp_path, n, near):
    """Share of entries that a query reaches and share of neighbours found outside the audit; near: vectors of a cluster, 1 for none."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n // near, 64))[np.arange(n) % (n // near)] + (near > 1) * rng.normal(0, 0.3, (n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))})
    pq.write_table(table, f"{tmp_path}/{n}-{near}.parquet")
    index = X.build(X.Scratch(spark, "test"), spark.read.parquet(f"{tmp_path}/{n}-{near}.parquet"), 64, n, F.col("vec_id") % 20 == 0)
    return index.reach / n, index.found


def test_work_is_sublinear_where_vectors_cluster(spark, tmp_path):
    found = {n: shares(spark, tmp_path, n, 40) for n in (10_000, 100_000)}
    print(found)
    assert all(f >= 0.9 for _, f in found.values())
    assert found[100_000][0] < 0.75 * found[10_000][0] < 0.01


def test_vectors_without_structure_need_many_entries(spark, tmp_path):
    share, found = shares(spark, tmp_path, 20_000, 1)
    print(share, found)
    assert found >= 0.9 and 0.2 < share < 0.8


def test_empty(spark):
    e = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert X.search(e, F.col("vec_id") % 20 == 0).count() == 0


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(2)
    a, b, counts = rng.random(7), rng.random(9), rng.integers(0, 3, (7, 9))
    cells = list(X.traverse(a, b, counts, 10**9))
    assert sorted(cells) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(counts)), strict=True))
    d = [a[i] + b[j] for i, j in cells]
    assert d == sorted(d)
    few = list(X.traverse(a, b, counts, 5))
    assert few == cells[: len(few)] and sum(counts[c] for c in few) >= 5
