from __future__ import annotations

from frameseg.llm import mixing as M


def water(sizes, weights, cap=3):
    """Shares by rounds: what capped sources can't take is shared anew."""
    total, full, t = sum(sizes), set(), [0.0] * len(sizes)
    while True:
        left = total - sum(cap * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        t = [cap * s if i in full else left * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in full and t[i] > cap * sizes[i] + 1e-9}
        if not over:
            return t
        full |= over


def rows_of(sizes):
    out = []
    for k, n in enumerate(sizes):
        out += [(len(out) + j, f"s{k}", "w " * 10) for j in range(n)]
    return out


def test_targets_by_rounds(spark):
    for sizes in ([10, 200, 3, 90, 1, 1, 500], [5], [1, 1000], [100, 100, 100]):
        docs = spark.createDataFrame(rows_of(sizes), "doc_id long, source string, text string").select("source", M.n_words().alias("size"))
        got = {r.source: r.target for r in M.targets(docs).collect()}
        want = water([10 * n for n in sizes], [(5, 2, 1)[k % 3] for k in range(len(sizes))])
        for k, t in enumerate(want):
            assert abs(got[f"s{k}"] - t) < 1e-6 * max(1, t)


def test_many_sources_are_dealt_by_ranges(spark, monkeypatch):
    from frameseg.llm import common

    rng = __import__("random").Random(3)
    sizes = [rng.choice([0, 1, 1, 5, 5, 300, 2000]) for _ in range(200)]
    rows = [(f"s{k:03d}" if k else None, n) for k, n in enumerate(sizes)]
    want = water([n for _, n in rows[1:]] + [sizes[0]], [(5, 2, 1)[k % 3] for k in range(200)])
    monkeypatch.setattr(common.running, "__defaults__", (7,))
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    for name, t in zip([n for n, _ in rows[1:]] + [None], want, strict=True):
        assert abs(got[name] - t) < 1e-6 * max(1, t)


def test_odd_rows(spark):
    rows = [(1, None, "a b"), (2, "x", None), (3, "x", ""), (None, "x", "   "), (4, "y", "é\tü\nz"), (4, "y", "é\tü\nz")]
    docs = spark.createDataFrame([(i, s, t, 0.5) for i, s, t in rows], "doc_id long, source string, text string, rate double")
    sized = docs.select("doc_id", "source", M.n_words().alias("size"))
    got = {(r.doc_id, r.source): r["size"] for r in sized.collect()}
    assert got == {(1, None): 2, (2, "x"): 0, (3, "x"): 0, (None, "x"): 2, (4, "y"): 3}
    t = {r.source: r for r in M.targets(sized).collect()}
    assert sum(r.target for r in t.values()) == 10 and all(r.target <= 3 * r.source_size for r in t.values())
    out = M.stage(spark, docs, "")
    assert out.columns == docs.columns and all(r.rate == 0.5 for r in out.collect())
    n = [r.doc_id for r in out.collect()]
    assert n.count(4) % 2 == 0 and n.count(2) <= 3


def test_nothing(spark):
    assert M.stage(spark, spark.createDataFrame([], "doc_id long, source string, text string"), "").count() == 0
    none = spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")
    assert M.stage(spark, none, "").count() == 0


def test_taken_is_near_the_target(spark):
    docs = spark.createDataFrame(rows_of([3000, 4000, 500]), "doc_id long, source string, text string")
    sized = docs.select("doc_id", "source", M.n_words().alias("size"))
    x = M._with_targets(sized, M.targets(sized))
    x = x.withColumn("taken", x["size"] * M.copies(x.rate, x.doc_id))
    for r in x.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) < 0.05 * r["max(target)"]


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a", "w " * 2_000_000), (2, "b", "w")], "doc_id long, source string, text string")
    sized = docs.select("doc_id", "source", M.n_words().alias("size"))
    assert {r.doc_id: r["size"] for r in sized.collect()} == {1: 2_000_000, 2: 1}
    assert {r.source: r.target for r in M.targets(sized).collect()} == {"a": 1999998.0, "b": 3.0}
