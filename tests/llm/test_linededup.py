from __future__ import annotations

import random

from frameseg.llm import linededup as L


def brute(rows):
    """Kept texts: windows of three lines, first by (doc_id, position)."""
    seen, out = set(), {}
    for i, t in sorted(r for r in rows if r[1] is not None):
        ls = t.split("\n")
        gone = set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i] = ("\n".join(x for k, x in enumerate(ls) if k not in gone) if gone else t, sorted(k + 1 for k in gone))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abcdef") if rng.random() < 0.7 else f"u{i}{k}" for k in range(rng.randint(0, 14)))) for i in range(60)]
    rows += [(100, ""), (101, "one"), (102, "x\ny"), (103, "\n" * 6), (104, "\n" * 6), (105, "q\n" * 5000)]
    docs = spark.createDataFrame([(i, t, 3, "x", i, 4) for i, t in rows] + [(106, None, 3, "x", 106, 4)], "doc_id long, text string, removed int, _removed string, starts long, _id int")
    want = brute(rows)
    out = L.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "__removed"]
    for r in out.collect():
        assert (r.removed, r["_removed"], r.starts, r["_id"]) == (3, "x", r.doc_id, 4)
        if r.doc_id == 106:
            assert r.text is None and r.n_lines == 0 and r["__removed"] == []
        else:
            assert (r.text, r["__removed"]) == want[r.doc_id], r.doc_id
            assert r.n_lines == dict(rows)[r.doc_id].count("\n") + 1


def test_repeated_rows_share_their_fate(spark):
    t = "a\nb\nc\nd"
    got = L.line_dedup(spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 9, r.text) for r in got) == [(1, t), (1, t), (2, ""), (9, "")]


def test_stage(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 5), (2, "a\nb\nc\nz", 7), (3, "a\nb\nc", 5), (4, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in L.stage(spark, docs, "").collect()}
    assert got == {1: ("a\nb\nc", 5), 2: ("z", 1), 4: (None, None)}


def test_empty(spark):
    assert L.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
