from __future__ import annotations

import numpy as np
import pytest

from frameseg.llm import htmltext as X
from tests.llm.handpages import FRESH, PAGES


@pytest.fixture(scope="module")
def model():
    return X.trained()


def test_blocks():
    h = "<html><head><title>t</title></head><body><p>a <b>b</b>c<br>d &amp; &#233;&nbsp;e<p>x<!-- no --><script>if (1<2) '</p>'</script>y<ul><li>1<li>2</ul><select><option>o</select></body>"
    assert [b[0] for b in X.blocks(h)] == ["a bc d & é e", "xy", "1", "2"]
    assert X.blocks("") == [] and X.blocks("<p>") == [] and [b[0] for b in X.blocks("a < b <p>c")] == ["a < b", "c"]
    assert [b[0] for b in X.blocks("<div title='a>b'>x</div><p class=\"un>y")] == ["x", "y"]
    assert X.blocks("<script>never ends") == [] and X.blocks("<!-- never ends") == []
    assert [b[0] for b in X.blocks("<table><tr><td>1<td>2<tr><th>3</table></b></p>4")] == ["1", "2", "3", "4"]


M = 1_000_000
HOSTILE = {
    "end tags that close nothing": "<b>" * (M // 7) + "</i>" * (M // 7),
    "open quotes": '<a b="' * (M // 6),
    "quotes that hide the end": '<i ">"' * (M // 6),
    "either quote": ("<a \"" + "'>") * (M // 7),
    "no end of a tag": "<" * M,
    "declarations": "<!" * (M // 2),
    "items in blocks": "<div>" * (M // 10) + "<li></li>" * (M // 18),
    "inline tags across a block": "<b><div>" + "<i>" * (M // 7) + "</b>" * (M // 8),
    "paragraphs": "<p>" * (M // 3),
    "cells": "<table><tr><td>" + "<p><div>" * (M // 16) + "<td>" * (M // 8),
    "references": "&#x" * (M // 3),
    "attributes": "<p " + 'class="' * (M // 7) + ">",
    "depth": "<div>" * (M // 5) + "x",
    "raw text": "<textarea></textarea>" * (M // 20),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_is_linear(name):
    import time

    began = time.process_time()
    X.blocks(HOSTILE[name])
    assert time.process_time() - began < 2


def test_pages_by_hand(model):
    for name, html, want in PAGES + FRESH:
        assert X.main_texts([html], model) == [want], name


def test_pages_of_the_tables(model):
    """The text of every page of the test tables is that of its article element."""
    import re

    import pyarrow.parquet as pq

    htmls = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()
    found = [re.search(r"<article>(.*?)</article>", h or "", re.S) for h in htmls]
    assert X.main_texts(htmls, model) == [" ".join(b[0] for b in X.blocks(m[1])) if m else "" for m in found]


def test_weights_are_kept(spark, model, monkeypatch):
    first = X.weights(spark)
    monkeypatch.setattr(X, "trained", None)
    again = X.weights(spark)
    assert first.keys() == again.keys() == model.w.keys() and all(np.array_equal(first[k], again[k]) and np.array_equal(first[k], model.w[k]) for k in first)


def test_deep_and_long_pages():
    assert [b[0] for b in X.blocks("<div>" * 5000 + "x" + "</div>" * 5000)] == ["x"]
    assert len(X.blocks("<p>w</p>" * 20_000)) == 20_000


def test_held_out_pages(model):
    rng = np.random.default_rng(123)
    right = blocks = 0
    for _ in range(150):
        html, good, bad = X.sample_page(rng)
        found = X.blocks(html)
        keep = model.label([found])[0]
        want = np.array([t in set(good) for t, *_ in found])
        right += int((keep == want).sum())
        blocks += len(found)
    assert right / blocks > 0.98


def test_page_shapes(model):
    words = "Ouer aned thin. " * 20
    nav = "<nav><ul>" + "<li><a href=/x>ab cd</a></li>" * 6 + "</ul></nav>"
    pages = [
        f"<body>{nav}<div class=ad>{words}</div><article><h1>Head</h1><p><b>One.<br><p>Two {words}</p></article><footer>&copy; x &middot; y</footer>",
        f"<body><header><a href=/>site</a></header>{nav}<main><h1>Head</h1><p>One.</p><p>Two {words}</p></main><aside><h3>related</h3><ul><li><a>x y</a></li></ul></aside><footer>z</footer></body>",
        f"<body>{nav}<div class='post-content'><h1>Head</h1><p>One.</p><p>Two {words}</p></div><div id=comments><h3>3 ab</h3><div class=comment><p>{words}</p></div></div><div class=footer>z</div></body>",
    ]
    want = " ".join(f"Head One. Two {words}".split())
    assert X.main_texts(pages, model) == [want] * 3
    assert X.main_texts([None, "", nav], model) == ["", "", ""]


def test_gradients():
    rng = np.random.default_rng(0)
    m = X.Labeller.fresh(rng)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    d = X.DIM_PATH + X.DIM_WORD + X.SHAPE
    x, mask = rng.normal(size=(5, 3, d)), np.ones((5, 3))
    mask[3:, 1] = 0
    x[mask == 0] = 0
    y = (rng.random((5, 3)) < 0.5).astype(float)
    grads, dx, _ = m.gradients(x, mask, y)
    for name in ("xf", "hb", "bf", "out", "skip"):
        at = tuple(rng.integers(0, s) for s in m.w[name].shape)
        old, e = m.w[name][at], 1e-4
        loss = []
        for v in (old + e, old - e):
            m.w[name][at] = v
            loss.append(m.gradients(x, mask, y)[2])
        m.w[name][at] = old
        assert abs((loss[0] - loss[1]) / (2 * e) - grads[name][at]) < 2e-3


def test_operator(spark):
    rows = [(1, "u", "<body><article><p>Some text of it, here. And more of it.</p></article>"), (1, "u", None), (2, None, ""), (None, "v", "<nav>a</nav>")]
    got = X.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (1, 38), (2, 0)]
    assert X.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
