"""HTML extraction by a recurrent block labeller: a bidirectional LSTM (numpy) reads a vector for each block of text, of its tag path,
its hashed words and its shape, and tells article from the rest with the whole page as context.

The model is trained here, on pages that `sample_page` makes up with their labels: many layouts, semantic tags or classes, broken
markup, pseudo-words. Nothing of the pages to be read is learnt. A page is cut into blocks at block-level tags; scripts, styles,
head, controls and comments of the markup never become text. Character references are decoded, white space (Unicode's) in a block
becomes one space, blocks are trimmed and joined in page order by one space.

Null or empty html, or a page without article: text '' and n_chars 0. Rows that repeat a page are read each by itself. A block's path is
described by its outermost and innermost DEPTH elements; text is never cut. Reading takes time in proportion to a page's length, whatever
its markup. Other columns of pages are ignored. No pages: no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, table

DEPTH, PATHS, WORDS, DIM_PATH, DIM_WORD, SHAPE, HIDDEN = 24, 1024, 1024, 16, 6, 6, 16
PAGES, EPOCHS, BATCH, RATE, DECAY, SEED = 1500, 8, 32, 0.01, 0.3, 17

#: Fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNREAD = frozenset("head script style noscript template svg math object canvas select button textarea iframe audio video title option datalist".split())
ALIKE = {t: group for group in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for t in group}
CLOSES_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist")}

#: A tag whose quoted attributes are closed, and one that ends at the next '>' whatever quotes are open.
STRICT = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


#: Characters that failed attempts at tags with open quotes may scan, in lengths of the page; beyond, quotes are no longer trusted.
PATIENCE = 16


def marks(tag: str, attributes: str) -> tuple[int, ...]:
    """Places in the path table of an element: its tag, and the words of its class, id and role."""
    return _marks(tag, attributes) if len(attributes) <= 400 else _marks.__wrapped__(tag, attributes)


@lru_cache(maxsize=20_000)
def _marks(tag: str, attributes: str) -> tuple[int, ...]:
    words = {f"<{tag}"}
    for m in ATTRIBUTE.finditer(attributes):
        words.update(re.findall(r"[a-z]{2,}", (m[2] or m[3] or m[4] or "").lower()))
    return tuple(sorted(zlib.crc32(w.encode()) % PATHS for w in words))


def tokens(html: str) -> Iterator[tuple[str, bool, str, int]]:
    """Text pieces as ("", False, text, 0), tags as (name, whether it ends, attributes, where it is over); send() a place to go on from there.

    Time is linear in the page's length: a '<' after the last '>' is text without a try, and tries that run to the page's end over open
    quotes are counted.
    """
    at, last, patience = 0, html.rfind(">"), PATIENCE * len(html)
    while at < len(html):
        lt = html.find("<", at)
        if lt != at:
            yield "", False, html[at:] if lt < 0 else html[at:lt], 0
            if lt < 0:
                return
            at = lt
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = len(html) if end < 0 else end + 3
        elif at > last:
            yield "", False, html[at:], 0
            return
        elif html[at + 1] in "!?":
            at = html.index(">", at) + 1
        else:
            m = STRICT.match(html, at) if patience > 0 else None
            if not m and (m := LOOSE.match(html, at)):
                patience -= len(html) - at
            if not m:
                yield "", False, "<", 0
                at += 1
                continue
            at = m.end()
            to = yield m[2].lower(), bool(m[1]), m[3], at
            if to is not None:
                at = to
                yield "", False, "", 0


class Open:
    """The open elements, with the places of each name and of blocks, so that no tag makes a walk over all of them."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.unread = self.links = 0

    def push(self, tag: str, attributes: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, marks(tag, attributes)))
        self.unread += tag in UNREAD
        self.links += tag == "a"

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag = self.stack.pop()[0]
            self.at[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.unread -= tag in UNREAD
            self.links -= tag == "a"

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def end(self, tag: str) -> None:
        k = self.last(tag)
        # an inline end tag doesn't leave its block
        if k >= 0 and (tag in BLOCKS or tag in UNREAD or not self.blocks or k > self.blocks[-1]):
            self.pop(k)

    def start(self, tag: str) -> None:
        """What a block's start tag closes."""
        if tag not in CLOSES_ITSELF:
            if self.blocks and self.stack[self.blocks[-1]][0] == "p":
                self.pop(self.blocks[-1])
            return
        limit, same = self.last(*CLOSES_ITSELF[tag]), self.last(*ALIKE[tag])
        if same > limit:
            self.pop(same)
        else:
            ps = self.at.get("p", [])
            if (k := bisect_right(ps, limit)) < len(ps):
                self.pop(ps[k])

    def path(self) -> list[int]:
        near = self.stack if len(self.stack) <= 2 * DEPTH else self.stack[:DEPTH] + self.stack[-DEPTH:]
        return [i for _, found in near for i in found]


def blocks(html: str) -> list[tuple[str, list[int], float]]:
    """Text, path and share of linked characters of each block, in page order."""
    out: list[tuple[str, list[int], float]] = []
    parts, linked, path, inside = [], 0, None, Open()

    def cut():
        nonlocal parts, linked, path
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, path, linked / max(1, sum(map(len, parts)))))
            parts, linked, path = [], 0, None

    found = tokens(html)
    for tag, end, rest, at in found:
        if not tag:
            if rest and not inside.unread:
                if path is None and not rest.isspace():
                    path = inside.path()
                rest = unescape(rest) if "&" in rest else rest
                parts.append(rest)
                linked += len(rest) if inside.links else 0
            continue
        if tag in BLOCKS or tag == "head":
            cut()
        if end:
            inside.end(tag)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            inside.start(tag)
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            found.send(close.end() if close else len(html))
            continue
        inside.push(tag, rest)
    cut()
    return out


def features(pages: list[list[tuple[str, list[int], float]]]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of all blocks of pages, one after the other: places in the path table, places in the word table, shape."""
    paths, words, shape = [], [], []
    for page in pages:
        for k, (text, path, linked) in enumerate(page):
            paths.append(np.array(path or [0], np.int64))
            w = text.lower().split()
            words.append(np.fromiter((_place(x) for x in w), np.int64, len(w)))
            stops = sum(map(text.count, ".,;:!?"))
            shape.append((np.log1p(len(text)) / 8, np.log1p(len(w)) / 6, linked, min(1.0, stops / len(w)), k / len(page), 1.0))
    return paths, words, np.array(shape, np.float32).reshape(-1, SHAPE)


_places: dict[str, int] = {}


def _place(word: str) -> int:
    if (p := _places.get(word)) is None:
        if len(_places) >= 200_000:
            _places.clear()
        p = _places[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
    return p


def _means(rows: list[np.ndarray], embedding: np.ndarray, share: bool) -> np.ndarray:
    n = np.array([len(r) for r in rows])
    out = np.add.reduceat(embedding[np.concatenate(rows)], np.cumsum([0, *n[:-1]]), axis=0)
    return out / n[:, None] if share else out / np.sqrt(n)[:, None]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, an LSTM in each direction and a logistic output."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Labeller:
        d = DIM_PATH + DIM_WORD + SHAPE
        w = {"path": rng.normal(0, 0.3, (PATHS, DIM_PATH)), "word": rng.normal(0, 0.1, (WORDS, DIM_WORD)), "out": rng.normal(0, 0.2, (2 * HIDDEN, 1)), "bias": np.zeros(1), "skip": np.zeros((d, 1))}
        for side in "fb":
            w[f"x{side}"] = rng.normal(0, d**-0.5, (d, 4 * HIDDEN))
            w[f"h{side}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            w[f"b{side}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]  # input, forget, output, cell
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def inputs(self, paths, words, shape) -> np.ndarray:
        return np.concatenate([_means(paths, self.w["path"], False), _means(words, self.w["word"], True), shape], 1).astype(np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, trace: list | None = None) -> np.ndarray:
        """Hidden states [time, page, HIDDEN]; states stand still where the mask is 0."""
        steps, n = x.shape[:2]
        gx = x @ self.w[f"x{side}"] + self.w[f"b{side}"]
        h = c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = gx[t] + h @ self.w[f"h{side}"]
            g, u = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            m = mask[t][:, None]
            c2 = f * c + i * u
            tc = np.tanh(c2)
            if trace is not None:
                trace.append((t, h, c, i, f, o, u, tc, m))
            c, h = m * c2 + (1 - m) * c, m * (o * tc) + (1 - m) * h
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, traces: dict | None = None) -> np.ndarray:
        hs = [self._run(x, mask, s, None if traces is None else traces.setdefault(s, [])) for s in "fb"]
        h = np.concatenate(hs, 2)
        if traces is not None:
            traces["h"] = h
        return (h @ self.w["out"] + x @ self.w["skip"])[:, :, 0] + self.w["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, float]:
        traces: dict = {}
        p = _sigmoid(self.logits(x, mask, traces))
        total = mask.sum()
        d = ((p - y) * mask / total).astype(np.float32)
        g = {"out": np.einsum("tnh,tn->h", traces["h"], d)[:, None], "bias": d.sum(keepdims=True)[0], "skip": np.einsum("tnd,tn->d", x, d)[:, None]}
        dx = d[:, :, None] * self.w["skip"][:, 0]
        for s, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            back = d[:, :, None] * self.w["out"][part, 0]
            dz_all, wh = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), self.w[f"h{s}"]
            gh, dh, dc = np.zeros_like(wh), 0.0, 0.0
            for t, h, c, i, f, o, u, tc, m in reversed(traces[s]):
                dh = dh + back[t]
                do, dct = m * dh * tc, m * (dc + dh * o * (1 - tc * tc))
                dz = np.concatenate([dct * u * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - u * u)], 1)
                dz_all[t] = dz
                gh += h.T @ dz
                dh = dz @ wh.T + (1 - m) * dh
                dc = dct * f + (1 - m) * dc
            g[f"h{s}"], g[f"b{s}"] = gh, dz_all.sum((0, 1))
            g[f"x{s}"] = np.einsum("tnd,tnz->dz", x, dz_all)
            dx = dx + dz_all @ self.w[f"x{s}"].T
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total
        return g, dx, float(loss)

    def label(self, pages: list[list[tuple[str, list[int], float]]]) -> list[np.ndarray]:
        """Whether each block belongs to the article."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        some = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(some):  # pages of like length together, so many that the states fit
            end = at + 1
            while end < len(some) and end - at < 128 and (end - at + 1) * len(pages[some[end]]) <= 40_000:
                end += 1
            group = some[at:end]
            x, mask = _padded(self.inputs(*features([pages[i] for i in group])), [len(pages[i]) for i in group])
            z = self.logits(x, mask)
            for n, i in enumerate(group):
                out[i] = z[: len(pages[i]), n] >= 0
            at = end
        return out


def _padded(rows: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    x, mask, at = np.zeros((max(lengths), len(lengths), rows.shape[1]), np.float32), np.zeros((max(lengths), len(lengths)), np.float32), 0
    for n, k in enumerate(lengths):
        x[:k, n], mask[:k, n] = rows[at : at + k], 1.0
        at += k
    return x, mask


#: Words that sites use for their parts; fixed values.
ARTICLE = "article content post entry story main body text news page blog detail".split()
AROUND = "page wrapper container layout site row grid columns col inner outer wrap root app"
PARTS = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs topbar links",
    "header": "header masthead branding logo site top",
    "ad": "ad ads advert advertisement banner sponsored promo promotion adbox",
    "aside": "sidebar aside widget related recommended popular trending rail",
    "notice": "cookie consent notice gdpr alert banner message popup modal subscribe newsletter signup paywall",
    "form": "form search login contact newsletter",
    "share": "share social tags meta byline author toolbar",
    "comments": "comments comment discussion replies reply responses disqus respond",
    "footer": "footer copyright legal bottom colophon foot",
}


def sample_page(rng: np.random.Generator) -> tuple[str, list[str], list[str]]:
    """A made-up page, the texts of its article's blocks and those of the others."""
    letters = [list("etaoinshrdlu"), list("enirstadhulcgmobwfkzäöüß"), list("esaitnrulodcmpéèêàçv"), list("eaosrnidlctumpbgvyqóíáñ"), list("оеаинтсрвлкмдпу")][rng.integers(5)]
    stock = ["".join(rng.choice(letters, rng.integers(1, 11))) for _ in range(rng.integers(30, 150))]
    wrong, good, bad, out = rng.random(), [], [], []

    def words(low: int, high: int) -> str:
        return " ".join(rng.choice(stock, rng.integers(low, high)))

    def sentences(n: int) -> str:
        return " ".join(words(1, 16).capitalize() + rng.choice([".", ".", ".", "!", "?", ","]) for _ in range(n))

    def attributes(part: str, plain: float) -> str:
        if rng.random() < plain:
            return ""
        names = rng.choice(PARTS[part].split() if part in PARTS else ARTICLE, rng.integers(1, 3))
        name = rng.choice(["-", "_", " "]).join(names)
        return rng.choice([f' class="{name}"', f" id='{name}'", f' class="{name} {words(1, 2)}" data-x="1>0"'])

    def text(into: list[str], value: str) -> str:
        value = " ".join(value.split())
        if value:
            into.append(value)
        shown = value.replace("&", "&amp;")
        if len(shown) > 20 and rng.random() < 0.2:
            k = shown.find(" ", len(shown) // 2)
            tag = rng.choice(["b", "i", "em", "strong", "span"])
            shown = shown if k < 0 else f"<{tag}>{shown[:k]}</{tag}>{shown[k:]}"
        return shown

    def items(into: list[str], n: int) -> str:
        tag = rng.choice(["ul", "ol"])
        return f"<{tag}>" + "".join(f'<li><a href="/{rng.integers(99)}">{text(into, words(1, 4))}</a></li>' for _ in range(n)) + f"</{tag}>"

    def part(kind: str) -> str:
        own = {"nav": "nav", "header": "header", "aside": "aside", "form": "form", "footer": "footer"}.get(kind)
        semantic = own is not None and rng.random() < 0.6
        tag = own if semantic else rng.choice(["div", "section", "div"])
        inner = "".join(
            {
                0: lambda: text(bad, sentences(rng.integers(1, 4))),
                1: lambda: f"<p>{text(bad, sentences(rng.integers(1, 5)))}</p>",
                2: lambda: items(bad, rng.integers(2, 9)),
                3: lambda: f"<h3>{text(bad, words(1, 5))}</h3>",
                4: lambda: f"<div>{text(bad, words(1, 8))}</div>",
            }[int(k)]()
            for k in (rng.choice([2, 2, 4], rng.integers(1, 3)) if kind == "nav" else rng.choice([0, 1, 1, 2, 3, 4], rng.integers(1, 4)))
        )
        if kind == "comments":
            inner = f"<h3>{text(bad, words(1, 3))}</h3>" + "".join(f'<div class="{rng.choice(["comment", "reply", "item"])}"><p>{text(bad, sentences(rng.integers(1, 5)))}</p></div>' for _ in range(rng.integers(1, 8)))
        if kind == "form":
            inner = f"<label>{text(bad, words(1, 4))}</label><input name=q><button>go</button>"
        if kind == "footer" and rng.random() < 0.6:
            inner = text(bad, "© " + words(1, 3) + " · " + sentences(1)).replace("©", "&copy;").replace("·", "&middot;")
        return f"<{tag}{attributes(kind, 0.5 if semantic else 0.0)}>{inner}</{tag}>"

    def paragraph() -> str:
        k = rng.random()
        if k < 0.68:
            body = text(good, sentences(rng.integers(1, 10)))
            return f"<p>{body}" + ("</p>" if rng.random() > 0.3 * (wrong < 0.4) else "")
        if k < 0.76:
            return f"<p><b>{text(good, sentences(rng.integers(1, 5)))}<br><p>{text(good, sentences(rng.integers(1, 5)))}</p>"
        if k < 0.84:
            return f"<h2>{text(good, words(2, 9))}</h2>"
        if k < 0.92:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{text(good, sentences(1))}</li>" for _ in range(rng.integers(2, 6))) + f"</{tag}>"
        if k < 0.95:
            return f"<blockquote>{text(good, sentences(rng.integers(1, 4)))}</blockquote>"
        if k < 0.965:
            return f"<pre>{text(good, words(2, 12))}</pre>"
        if k < 0.98:
            return "<dl>" + "".join(f"<dt>{text(good, words(1, 4))}</dt><dd>{text(good, sentences(1))}</dd>" for _ in range(rng.integers(1, 5))) + "</dl>"
        head = f"<tr><th>{text(good, words(1, 3))}</th><th>{text(good, words(1, 3))}</th></tr>" if rng.random() < 0.5 else ""
        return f"<table>{head}" + "".join(f"<tr><td>{text(good, words(1, 5))}</td><td>{text(good, words(1, 5))}</td></tr>" for _ in range(rng.integers(1, 5))) + "</table>"

    out.append(f'<!DOCTYPE html><html><head><title>{words(2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
    def around() -> str:
        """Elements that hold article and other parts alike."""
        k = rng.random()
        return "" if k < 0.6 else "".join(f'<div {rng.choice(["class", "id"])}="{name}">' for name in rng.choice(AROUND.split(), 1 if k < 0.85 else 2))

    before = [k for k in ("notice", "header", "nav", "nav", "ad", "form", "aside", "share") if rng.random() < 0.4]
    rng.shuffle(before)
    outer = around()
    place = int(rng.integers(0, len(before) + 1))
    out += ["<!-- x -->" + part(k) for k in before[:place]] + [outer] + [part(k) for k in before[place:]]
    tag = rng.choice(["article", "article", "main", "div", "section"])
    wrap = around()
    out.append(wrap + f"<{tag}{attributes('article', 0.7 if tag in ('article', 'main') else 0.0)}>")
    if rng.random() < 0.8:
        out.append(f"<h1>{text(good, words(2, 12))}</h1>")
    for _ in range(rng.integers(1, 15)):
        out.append(paragraph())
        if rng.random() < 0.12:
            out.append(part(rng.choice(["ad", "ad", "share", "aside", "notice"])))
    if rng.random() < 0.15:
        out.append(part("comments"))
    out.append(f"</{tag}>")
    out += [part(k) for k in ("share", "comments", "aside", "ad", "form", "nav", "notice", "footer") if rng.random() < 0.35]
    out.append("</div>" * (wrap + outer).count("<div"))
    if wrong > 0.2:
        out.append("</body></html>")
    return "".join(out), good, bad


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, epochs: int = EPOCHS) -> Labeller:
    """The labeller, fitted by Adam on made-up pages; the same each time."""
    rng = np.random.default_rng(SEED)
    data = []
    for _ in range(pages):
        html, good, bad = sample_page(rng)
        found = blocks(html)
        left = {True: list(good), False: list(bad)}
        y = []
        for t, _, _ in found:
            kind = t in left[True]
            if t in left[kind]:
                left[kind].remove(t)
            y.append(kind)
        if found:
            data.append((found, np.array(y, np.float32)))
    model = Labeller.fresh(rng)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            group = [data[i] for i in order[at : at + BATCH]]
            paths, words, shape = features([g[0] for g in group])
            x, mask = _padded(model.inputs(paths, words, shape), [len(g[0]) for g in group])
            y = np.zeros(mask.shape, np.float32)
            for n, g in enumerate(group):
                y[: len(g[1]), n] = g[1]
            grads, dx, _ = model.gradients(x, mask, y)
            flat = np.concatenate([dx[: len(g[0]), n] for n, g in enumerate(group)])
            grads["path"], grads["word"] = np.zeros_like(model.w["path"]), np.zeros_like(model.w["word"])
            for name, rows, part, power in (("path", paths, slice(0, DIM_PATH), 0.5), ("word", words, slice(DIM_PATH, DIM_PATH + DIM_WORD), 1.0)):
                n = np.array([len(r) for r in rows])
                np.add.at(grads[name], np.concatenate(rows), np.repeat(flat[:, part] / (n[:, None] ** power), n, axis=0))
            step += 1
            rate = RATE * (1 - epoch / epochs) + 1e-4
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model.w[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + rate * DECAY * model.w[k]).astype(np.float32)
    return model


def main_texts(htmls: list[str | None], model: Labeller) -> list[str]:
    pages = [blocks(h) if h else [] for h in htmls]
    return [" ".join(b[0] for b, ok in zip(page, keep, strict=True) if ok) for page, keep in zip(pages, model.label(pages), strict=True)]


def weights(spark: SparkSession) -> dict[str, np.ndarray]:
    """Of the trained labeller; kept in the shared folder under a name made of this file's content, so that other drivers needn't train."""
    with open(__file__, "rb") as f:
        name = f"{shared_dir(spark)}/htmltext-{hashlib.sha1(f.read()).hexdigest()[:16]}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(name).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path(name)):
        whole, draft = io.BytesIO(), f"{name}-{uuid.uuid4().hex}"
        np.savez(whole, **trained().w)
        spark.createDataFrame([(bytearray(whole.getvalue()),)], "weights binary").coalesce(1).write.parquet(draft)
        if not store.rename(path(draft), path(name)) or store.exists(path(f"{name}/{draft.rpartition('/')[2]}")):
            store.delete(path(draft), True)  # another driver was first
    stored = spark.read.schema("weights binary").parquet(name).first()
    with np.load(io.BytesIO(stored.weights)) as z:
        return {k: z[k] for k in z.files}


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages(page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(weights(pages.sparkSession))  # some 150 KB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(sent.value)
        for b in slices(batches, "html", 1 << 20):
            texts = main_texts(b.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
