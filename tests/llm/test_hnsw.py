from __future__ import annotations

import numpy as np

from frameseg.llm import hnsw as H


def clustered(n=500, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 5, dim))
    x = base[rng.integers(0, len(base), n)] + rng.normal(0, 0.05, (n, dim))
    return x.astype(np.float32)


def brute(rows, least=0.98):
    part = {}
    for i, v, label in rows:
        if v is not None and label is not None and all(c is not None and np.isfinite(c) for c in v) and any(v):
            part[i] = (np.array(v, np.float32).astype(float), label)
    ids = sorted(part)
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            (x, lx), (y, ly) = part[ids[a]], part[ids[b]]
            if lx == ly and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[ids[a]] += 1
                links[ids[b]] += 1
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in root}


def test_against_brute_force(spark):
    x = clustered()
    rows = [(i * 3, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(5000, rows[0][1], 0), (5001, rows[0][1], 0), (5002, rows[0][1], None), (5003, None, 0), (5004, [0.0] * 16, 0), (5005, [float("nan")] + [1.0] * 15, 0), (5006, [None] + [1.0] * 15, 0), (5007, [1.0, 2.0], 0), (5008, [2.0, 4.0], 0), (5009, [float("inf")] * 16, 1), (5010, [1e38] * 16, 1), (5011, [1e-44] * 16, 1), (5012, [], 1)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, id int")
    want = brute(rows)
    for shard, block in ((65_536, 16_384), (100, 60)):
        got = H.embedding_dedup(df, shard=shard, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_links, r.component_id) == want[r.vec_id], r
            assert r.kept == (r.vec_id == r.component_id)


def test_repeated_rows_and_null_ids(spark):
    v = [1.0, 0.0, 0.5]
    df = spark.createDataFrame([(1, v, 1), (1, v, 1), (2, v, 1), (None, v, 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or 99, r.n_links, r.component_id, r.kept) for r in H.embedding_dedup(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (99, 0, None, True)]


def test_empty(spark):
    assert H.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_graph_recall():
    x = H.unit(np.random.default_rng(2).normal(size=(2000, 24)).astype(np.float32))
    g = H.Hnsw.build(x)
    assert all((a < len(x)).all() for a in g.links)
    same = H.Hnsw.unpacked(g.packed())
    q = x[:100]
    ids, _, _ = same._beam(q, np.zeros((100, 1), np.int64), 0, 100, len(x))
    truth = np.argsort(-(q @ same.x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, truth, strict=True)]) > 0.9


def pairs_of(g, q, own):
    return {p for a, b in H.near_pairs(g, q, own, 0.98) for p in zip(a.tolist(), b.tolist(), strict=True)}


def test_union():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (10, 4), (300, 200), (300, 5000)):
        a, b, u = rng.integers(0, n, m), rng.integers(0, n, m), H.Union(n)
        root = list(range(n))
        for k in range(0, m, 50):
            u.add(a[k : k + 50], b[k : k + 50])
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                root[x] = root[y] = min(root[x], root[y])
            if all(root[x] == root[y] for x, y in zip(a, b, strict=True)):
                break
        assert u.root.tolist() == root


def test_many_near_copies_cost_little_memory():
    """A shard of 20,000 near copies of one vector in a process of its own: 400 million links, under 1 GB."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np, pandas as pd
from frameseg.llm import hnsw as H
rng = np.random.default_rng(0)
x = (np.ones(64) + rng.normal(0, 0.05, (20_000, 64))).astype(np.float32)
q = x[:: 40]
ids = np.arange(len(x), dtype=np.int64)
n, levels = len(x), np.zeros(len(x), int)
g = H.Hnsw(H.unit(x), levels, [np.full((n, 24), -1, np.int32)], np.arange(n))
row = pd.DataFrame({"graph": [g.packed()], "ids": [ids.tobytes()], "copies": [np.ones(n, np.int64).tobytes()], "raw": [x.tobytes()]})
out = H._query(0.98)(None, row, pd.DataFrame({"id": ids, "embedding": list(x)}))
s = (q.astype(float) @ x.T.astype(float)) / (np.linalg.norm(q.astype(float), axis=1)[:, None] * np.linalg.norm(x.astype(float), axis=1))
got = out.set_index("id").loc[ids[:: 40]]
assert ((s >= 0.98).sum(1) - 1 == got.links).all() and (got.other == 0).all() and got.links.min() > 15_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 1000


def test_beam_widens_until_the_audit_passes(monkeypatch):
    x = H.unit(clustered(600))
    g = H.Hnsw.build(x)
    asked = []
    near = g.near
    monkeypatch.setattr(g, "near", lambda q, least, ef, own: (asked.append(ef), near(q, least, ef, own))[1] if ef > 32 else (asked.append(ef), (np.empty(0, int), np.empty(0, int)))[1])
    monkeypatch.setattr(H, "DENSE", 1)
    found = pairs_of(g, x, np.full(len(x), -1))
    assert asked[:3] == [16, 32, 64]
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(x @ g.x.T >= 0.98)), strict=True))


def test_audit_sees_a_poor_graph_where_links_are_rare():
    rng, n, pairs = np.random.default_rng(3), 3000, 150
    x = rng.normal(size=(n, 64))
    at = rng.choice(n, 2 * pairs, replace=False)
    x[at[:pairs]] = x[at[pairs:]] + rng.normal(0, 0.147, (pairs, 64))
    x = H.unit(x.astype(np.float32))
    g = H.Hnsw.build(x, 4, 8)
    own = np.empty(n, int)
    own[g.order] = np.arange(n)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(x @ g.x.T >= 0.98)), strict=True))
    assert len(want) > n + pairs
    for q, mine in ((x, own), (x, np.full(n, -1))):
        assert pairs_of(g, q, mine) == want
