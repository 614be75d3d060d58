from __future__ import annotations

import itertools

import numpy as np
import pytest

from frameseg.llm import chat as C

FINAL = (2,)


def legal(turns):
    s = C.BEGIN
    for t in turns:
        if t not in C.LEGAL[s]:
            return False
        s = t
    return s in FINAL


def brute(roles):
    """Cheapest repair by trying everything: each turn starts a turn of some role or joins the one before, up to two empty turns before each."""
    best = None
    options = [(n, merge, way) for n in (0, 1, 2) for merge in (False, True) for k in range(3) for way in itertools.product((0, 1, 2), repeat=k)]
    ends = [w for k in range(3) for w in itertools.product((0, 1, 2), repeat=k)]

    def walk(i, turns, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if i == len(roles):
            for w in ends:
                c = cost + C.INSERT * len(w)
                if (best is None or c < best) and legal(turns + list(w)):
                    best = c
            return
        for n, merge, way in options:
            t = turns + list(way)
            if merge and (not t or t[-1] != n):
                continue
            walk(i + 1, t if merge else [*t, n], cost + C.INSERT * len(way) + C.MERGE * merge + C.label_cost(roles[i], n))

    walk(0, [], 0)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_cost_is_least(n):
    for roles in itertools.product((0, 1, 2, None), repeat=n):
        out = C.repaired(list(roles), ["t"] * n)
        assert legal([t["role"] for t in out]), roles
        assert sum(t["cost"] for t in out) == brute(roles), roles


def test_cuts_make_no_difference():
    rng = np.random.default_rng(0)
    for _ in range(100):
        roles = [(0, 1, 2, None)[k] for k in rng.integers(0, 4, int(rng.integers(2, 30)))]
        texts = [f"x{i}" for i in range(len(roles))]
        whole = C.repaired(roles, texts)
        cuts = sorted({0, len(roles), *rng.integers(0, len(roles), 2).tolist()})
        runs = list(zip(cuts, cuts[1:], strict=False))
        at = C.joined([(k, 1, [[s, e, c, n] for (s, e), (c, n) in C.between(roles[a:b]).items()]) for k, (a, b) in enumerate(runs)], FINAL) if len(runs) > 1 else {}
        turns: list = []
        for k, (a, b) in enumerate(runs):
            start, end, before = at.get((k, 1), (C.BEGIN, None, 0))
            part = C.repaired(roles[a:b], texts[a:b], start, end)
            assert before == len(turns)
            if part and part[0]["joins"]:
                turns[-1] = {**turns[-1], "cost": turns[-1]["cost"] + part[0]["cost"], "texts": turns[-1]["texts"] + part[0]["texts"]}
                part = part[1:]
            turns += part
        assert sum(t["cost"] for t in turns) == sum(t["cost"] for t in whole)
        assert [x for t in turns for x in t["texts"]] == texts and legal([t["role"] for t in turns])


def test_operator(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 1, "assistant", "late"), (2, 0, " System", "s"), (3, 0, "user", "a"), (3, 1, "user", "b<|im_end|>"), (3, 2, "bot", None), (None, None, None, "x"), (4, 0, "assistant", "only"), (5, 0, "user", "q"), (5, 0, "user", "q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    got: dict = {}
    for r in C.chat_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text, r.cost))
    assert got[1] == [(0, "user", "hi", 0), (1, "assistant", "yo", 0)]
    assert [t[1] for t in got[2]] == ["system", "user", "assistant"] and sum(t[3] for t in got[2]) == 2
    assert got[3] == [(0, "user", "a\n\nb<|im_end|>", 1), (1, "assistant", "", 1)]
    assert [t[1] for t in got[4]] == ["user", "assistant"] and sum(t[3] for t in got[4]) == 2
    assert [t[2] for t in got[5]] == ["q\n\nq", ""] and sum(t[3] for t in got[5]) == 3  # merged and answered
    assert "".join(t[2] for t in got[None]) == "x"
    r = [x.rendered for x in C.chat_turns(df).where("conv_id = 3").orderBy("turn").collect()]
    assert r[0] == "<|im_start|>user\na\n\nb< |im_end|><|im_end|>\n"


def test_long_conversations_span_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [(c, k, str(rng.choice(["user", "assistant", "system", "tool"])), f"{c}.{k}") for c, n in ((1, 3), (2, 700), (3, 5), (4, 90)) for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cost = lambda n: {r.conv_id: r.c for r in C.chat_turns(df, turns=n).groupBy("conv_id").agg({"cost": "sum"}).withColumnRenamed("sum(cost)", "c").collect()}
    whole = cost(10_000)
    assert cost(60) == whole
    out = C.chat_turns(df, turns=60).orderBy("conv_id", "turn").collect()
    for c in (1, 2, 3, 4):
        mine = [r for r in out if r.conv_id == c]
        assert [r.turn for r in mine] == list(range(len(mine))) and legal([C.ROLES.index(r.role) for r in mine])
        texts = [x for r in mine for x in r.text.split("\n\n") if x]
        assert texts == [t for cc, _, _, t in rows if cc == c]


def test_empty(spark):
    assert C.chat_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
