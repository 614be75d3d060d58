from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from frameseg.llm import common
from frameseg.llm import toxicity as X


def made(n, seed):
    rng = np.random.default_rng(seed)
    stock = [f"word{k}" for k in range(400)]
    rows = []
    for i in range(n):
        w, y = list(rng.choice(stock, int(rng.integers(5, 60)))), int(rng.random() < 0.3)
        if y:
            for bad in rng.choice(["vile", "rotten", "awful"], 2):
                w.insert(int(rng.integers(len(w))), str(bad) + ",")
        rows.append((i, " ".join(w), y))
    return rows


def test_ftrl_learns_and_is_sparse():
    rows, held, words = made(900, 0), made(300, 1), X.WordHash(strip=X.STRIP)
    data = [(X.distinct(t, words), y) for _, t, y in rows]
    order = [i for e in range(4) for i in np.random.default_rng(e).permutation(len(data))]
    at, w, bias = X.train(data[i] for i in order)
    dense = np.zeros(1 << X.BITS)
    dense[at] = w
    p = [X.sigmoid(bias + dense[np.unique(X.coordinates(t, words))].sum()) >= 0.5 for _, t, _ in held]
    assert np.mean(np.array(p) == np.array([y for *_, y in held])) > 0.97
    assert len(at) < 2000


def test_query_and_odd_rows(spark):
    rows = made(500, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "vile " * 30_000), (None, "vile"), (3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (6, 0)], "doc_id long, toxic int")
    got = X.score(docs, X.learn(docs, labels)).collect()
    assert len(got) == 505 and all(0 <= r.score <= 1 for r in got)
    s = {r.doc_id: r.score for r in got if r.doc_id != 3}
    assert s[900] == s[901] < 0.5 < s[902]
    held = [(s[i] >= 0.5) == bool(y) for i, _, y in rows if i != 3 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) > 0.95


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows = made(200, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    a = X.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = X.learn(docs, spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 1)], 1.0)):
        got = X.score(docs, X.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
        assert all(abs(r.score - want) < 1e-9 for r in got)


def test_of_repeated_rows_the_largest_text_is_learnt(spark):
    rows = made(200, 4)
    once = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    more = once.unionByName(once).unionByName(spark.createDataFrame([(i, None if i % 2 else "") for i, *_ in rows], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = X.learn(once, labels), X.learn(more, labels)
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_the_sample_is_bounded(spark):
    rows = made(300, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    some = labels.where(~X.in_fold(labels.doc_id)).orderBy(X.F.xxhash64("doc_id", X.F.lit(11)), "doc_id").limit(50)
    a, b = X.learn(docs, labels, sample=50), X.learn(docs, some)
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert X.score(none.drop("score"), X.learn(none, labels)).count() == 0
    assert X.stage(spark, none, str(tmp_path)).columns == ["doc_id", "text", "score"]
    assert X.stage(spark, none, str(tmp_path)).count() == 0


def test_workers_give_their_caches_back():
    class Sent:
        value = (np.array([3]), np.array([1.0]), 0.0)

    batch = pa.RecordBatch.from_pydict({"id": pa.array([1, 2], pa.int64()), "y": pa.array([0, 1], pa.int32()), "text": ["a b c", None]})
    for make in (X._features, lambda bits: X._scores(Sent, bits)):
        seen = [common._kept[0] for _ in make(20)(iter([batch]))]
        assert seen == ["toxicity"] and common._kept == [None, None]
