"""Near duplicates against brute force on full sets."""

from __future__ import annotations

import numpy as np
import pytest

from frameseg.llm import minhash as M


def words(text):
    return (text or "").encode().lower().split()


def sets_of(text, k=5):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows):
    s = [(i, sets_of(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            both = len(s[a][1] & s[b][1])
            if both and 100 * both >= 75 * (len(s[a][1]) + len(s[b][1]) - both):
                x, y = find(s[a][0]), find(s[b][0])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def corpus(seed=0, base=12, copies=9):
    rng = np.random.default_rng(seed)
    stock = [f"w{k}" for k in range(3000)]
    rows, i = [], 0
    for b in range(base):
        w = list(rng.choice(stock, int(rng.integers(3, 120))))
        for _ in range(int(rng.integers(1, copies))):
            v = list(w)
            for _ in range(int(rng.integers(0, max(1, len(w) // 20)))):
                v[int(rng.integers(len(v)))] = str(rng.choice(stock))
            rows.append((i * 7 % 1009, " ".join(v).upper() if rng.random() < 0.2 else "\n".join(v)))
            i += 1
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rows = corpus(seed) + [(2001, None), (2002, ""), (2003, " \t\n"), (2004, "a b"), (2005, "A  b"), (2006, "a b c"), (2007, "x " * 20_000), (None, "a b"), (2004, "a b")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, component_id int, sig string")
    want = brute(rows)
    got = M.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    n = {r.doc_id: r.n_shingles for r in got}
    assert n[2001] == n[2002] == n[2003] == 0 and n[2004] == n[2006] == 1 and n[2007] == 1
    assert {r.component_id for r in got if r.doc_id in (2004, 2005)} == {2004}


def test_rows_of_one_id_are_one_vertex(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (9, b), (7, a), (7, b)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {5}


def test_empty(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_follows_similarity():
    rng = np.random.default_rng(3)
    for j in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(30):
            common = rng.integers(0, 1 << 63, int(600 * j), np.uint64)
            rest = rng.integers(0, 1 << 63, 600 - len(common), np.uint64)
            half = len(rest) // 2
            a, b = np.unique(np.r_[common, rest[:half]]), np.unique(np.r_[common, rest[half:]])
            m = M.minima([a, b])
            low = m & np.uint64(3)
            p = (low[0] == low[1]).mean()
            errors.append((p - 0.25) / 0.75 - len(common) / 600)
        assert abs(np.mean(errors)) < 0.04


def test_stage_keeps_one_row_of_each_group(spark):
    t = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, t, "en"), (2, t, "en"), (2, t, "en"), (1, t, "en"), (3, "other words", "en"), (None, t, "en")], "doc_id long, text string, lang string")
    got = M.stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 3]


def template(seed, n=110):
    """Documents of one template with more or less text of their own, near copies of some, and a shingle that all have."""
    rng = np.random.default_rng(seed)
    base, rows = [f"t{k}" for k in range(120)], []
    for i in range(n):
        if rows and rng.random() < 0.3:
            w = rows[int(rng.integers(len(rows)))][1].split(" ")
            w[int(rng.integers(len(w)))] = f"x{i}"
        else:
            w = base + [f"d{i}w{k}" for k in range(int(120 * rng.choice([0.1, 0.18, 0.2, 0.3, 0.5])))]
        rows.append((1000 - i * 3, " ".join(w)))
    return rows


@pytest.mark.parametrize("part", [1024, 7])
def test_a_template_of_many_documents(spark, monkeypatch, part):
    monkeypatch.setattr(M, "PART", part)
    rows = template(part) + [(5, template(part)[0][1] + " z z")]
    want = brute(rows)
    assert len(set(want.values())) > 20
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_shingles_are_combined_before_the_shuffle():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    s = np.sort(np.concatenate([np.repeat(7, 500), rng.integers(8, 60, 300), np.repeat(90, M.RARE), np.repeat(91, M.RARE + 1)]))
    x = np.stack([np.arange(len(s)), s, s, s])

    def batches(size):
        for i in range(0, len(s), size):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in x], M.NAMES)

    n = {int(k): int((s == k).sum()) for k in np.unique(s)}
    for size in (1, 5, 64, 10_000):
        sent = np.concatenate([b.column("s").to_numpy() for b in M._combined(batches(size))])
        assert {int(k): int((sent == k).sum()) for k in np.unique(sent)} == {k: min(v, M.RARE + 1) for k, v in n.items()}
        few = [(a, b) for f in M._scarce(batches(size)) for a, b in zip(f.column("s").to_pylist(), f.column("df").to_pylist(), strict=True)]
        assert sorted(few) == sorted((k, v) for k, v in n.items() if v <= M.RARE for _ in range(v))


def test_stage_with_clashing_columns_and_different_texts_of_one_id(spark):
    t = " ".join(f"t{i}" for i in range(30))
    rows = [(1, t, "b", 1), (1, "zz other", "a", 2), (2, t, None, 3), (7, None, "q", 4), (7, "", "r", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, again string, gone int")
    got = M.stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, t, "b", 1), (7, "", "r", 5)]


def test_workers_give_back_their_caches():
    import pyarrow as pa

    from frameseg.llm import common

    b = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b c d e f"]})
    assert [x.num_rows for x in M._signatures(iter([b]))] == [1]
    assert common._kept == [None, None]


def test_a_task_lists_and_combines_in_one_function(monkeypatch):
    """Shingles of many documents are cut, however often what is held is combined; all rows of the others are sent."""
    import pyarrow as pa

    texts = [f"a b c d e f own{i} words{i} of{i}" for i in range(60)]
    b = pa.RecordBatch.from_pydict({"id": list(range(60)), "c": list(range(60)), "most": [9] * 60, "text": texts})
    n: dict[int, int] = {}
    for t in texts:
        for s in M.shingles(t, M.WordHash()).view(np.int64).tolist():
            n[s] = n.get(s, 0) + 1
    assert max(n.values()) == 60
    for held in (1 << 19, 700, 100):
        monkeypatch.setattr(M, "HELD", held)
        out = pa.Table.from_batches(M._listed(b.slice(i, 5) for i in range(0, 60, 5)))
        sent = dict(zip(*np.unique(out.column("s").to_numpy(), return_counts=True), strict=True))
        assert sent.keys() == n.keys() and all(v == n[s] for s, v in sent.items() if n[s] <= M.RARE)
        bound = 1 if held > 300 else 2 * out.num_rows // held + 1
        assert all(M.RARE < v <= bound * (M.RARE + 1) for s, v in sent.items() if n[s] > M.RARE)


def test_no_task_runs_two_python_functions(spark, monkeypatch):
    from frameseg.llm import common

    most, save = [], common.Scratch.save

    def python(node):
        """The most Python functions below a node in its own tasks."""
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return python(node.initialPlan())
        below = [python(node.children().apply(i)) for i in range(node.children().size())]
        most.append(max([0, *below]) + (name == "MapInArrow"))
        return 0 if "Exchange" in name else most[-1]

    def seen(self, df, *args):
        plan = df._jdf.queryExecution().executedPlan()
        if "MapInArrow" in plan.toString():
            python(plan)
        return save(self, df, *args)

    monkeypatch.setattr(common.Scratch, "save", seen)
    docs = spark.createDataFrame(template(3, 40), "doc_id long, text string")
    assert M.near_duplicates(docs).count() == 40
    assert max(most) == 1
