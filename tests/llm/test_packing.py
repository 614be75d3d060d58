from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frameseg.llm import packing as P


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(P.vocabulary())


def check(rows, pieces, bpe, window):
    """Every id in one piece, CRCs, gapless offsets, no overfull sequence. Returns the padded share."""
    want = sorted((i is None, i or 0, len(x := np.array(bpe.encode(t or "", add_special_tokens=False).ids + [1], "<u4")), x.tobytes()) for i, t in rows)
    spans: dict = {}
    for r in pieces:
        spans.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for key, group in spans.items():
        same = [w for w in want if (None if w[0] else w[1], w[2]) == key]
        crcs = {w[3] for w in same}
        assert sum(n for _, n, _ in group) == sum(w[2] for w in same)
        for s, n, c in group:
            assert any(zlib.crc32(x[4 * s : 4 * (s + n)]) == c for x in crcs)
    assert sum(r.length for r in pieces) == sum(w[2] for w in want)
    seqs: dict = {}
    for r in pieces:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for o, n in sorted(s):
            assert o == end and n > 0
            end += n
        assert end <= window
    return 1 - sum(w[2] for w in want) / (window * len(seqs))


@pytest.mark.parametrize("window", [256, 2048])
def test_pieces(spark, bpe, window):
    rng = np.random.default_rng(5)
    stock = ["the", "Of,", "réaux.", "naïve's", "<|endoftext|>", "<|EndOfText|>", "x9y.z", "don't,", "日本語", "a b", "Éte", "İ.", "ﬁne", "…", "A.B.", "12,345", "'s", "​", "CAFÉ,"]
    rows = [(i, rng.choice([" ", "\n", "  ", "\x0b", "\x1c"]).join(rng.choice(stock, int(rng.integers(0, 200))))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "word " * 9000), (None, "no id"), (7, rows[7][1]), (7, "another text")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rest int").repartition(3)
    assert check(rows, P.pack(docs, window=window).collect(), bpe, window) < 0.2


def test_padding_is_small(spark, bpe):
    rng = np.random.default_rng(6)
    rows = [(i, "it " * int(min(3000, rng.gamma(1.2, 120)))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert check(rows, P.pack(docs, window=256).collect(), bpe, 256) < 0.04


def test_one_length_only(spark, bpe):
    rows = [(i, "it " * 149) for i in range(200)]
    assert check(rows, P.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=256).collect(), bpe, 256) < 0.1


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_least_squares():
    combos = P.combinations(32)
    assert (combos.sum(1) == 32).all() and len(np.unique(combos, axis=0)) == len(combos)
    x = np.zeros(len(combos))
    x[[5, 40, 60]] = [30, 12, 7]
    counts = np.zeros(33, np.int64)
    for j in (5, 40, 60):
        for v in combos[j]:
            counts[v] += int(x[j]) if v else 0
    s = P.solve(counts, combos)
    a = np.zeros(33)
    for j, n in enumerate(s):
        for v in combos[j]:
            a[v] += n if v else 0
    np.testing.assert_allclose(a, counts, atol=1e-4)
    assert (s >= 0).all()


def test_joined_crc():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"some text", bytes(range(200)))):
        assert P.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_pieces_are_tokenized_alone(bpe, monkeypatch):
    """Generations turn over, ids stay those of the tokenizer."""
    monkeypatch.setattr(P.Tokens, "LIMIT", 5)
    t = P.Tokens(P.vocabulary())
    texts = ["One two, three. ONE", "two three\tfour.", None, "One. <|endoftext|>, x.y, é., É.", "five six seven eight nine ten", "one two"]
    for _ in range(3):
        for x in texts:
            got = np.frombuffer(next(t.of(pa.array([x], pa.string()))), "<u4").tolist()
            assert got == bpe.encode(x or "", add_special_tokens=False).ids + [1]


def test_long_texts_and_many_pieces(bpe, monkeypatch):
    """Pieces put together in parts, and pieces around special strings, give the tokenizer's ids."""
    monkeypatch.setattr(P, "WORDS", 3)
    rng = np.random.default_rng(9)
    stock = ["a", "Bee,", "c's", "<|startoftext|>", "<|x", "x<|endoftext|>y", "日本", "é.", "\x1c", "12", "…"]
    texts = ["", None, " \n", *(rng.choice([" ", "\t", "  "]).join(rng.choice(stock, int(rng.integers(1, 40)))) for _ in range(200)), " ends with space "]
    t = P.Tokens(P.vocabulary())
    got = [np.frombuffer(x, "<u4").tolist() for x in t.of(pa.array(texts, pa.string()))]
    assert got == [bpe.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]
    some = [f"w{i}é" for i in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in t.ids([p.encode() for p in some])] == [bpe.encode(p, add_special_tokens=False).ids for p in some]


def test_small_tables_start_no_python_workers(spark, monkeypatch):
    """A table made of tuples is an RDD that Python workers copy; one sent as Arrow is part of the plan."""
    from frameseg.llm.common import Scratch, local, running

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "ExistingRDD" not in plan(running(Scratch(spark, "t"), spark.range(10), "r", [F.col("id")], n=F.lit(1)))
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, *args: (saved.append((args[0], plan(df))), save(self, df, *args))[1])
    P.pack(spark.range(50).select(F.col("id").alias("doc_id"), F.repeat(F.lit("it "), F.lit(149)).alias("text")), window=256)
    assert [name for name, _ in saved] == ["plan", "placed"] and not any("ExistingRDD" in x for _, x in saved)
    some = local(spark, [(1, 1 << 40), (2, None)], "a int, b long")
    assert "LocalTableScan" in plan(some) and [tuple(r) for r in some.collect()] == [(1, 1 << 40), (2, None)]
    assert local(spark, [], "a int, b long").collect() == [] and some.schema.simpleString() == "struct<a:int,b:bigint>"


def test_capitals_before_marks(bpe):
    """Some small letters are one character with a mark, where the capital isn't: the tokenizer composes first and lowers then."""
    texts = [f"{c}{m}{end}" for c in "HhTtWwYyJjAaÜüI" for m in ("̱", "̈", "̊", "̌", "̄", "̣̱") for end in ("", ",", "x.", "É,")]
    got = [np.frombuffer(x, "<u4").tolist() for x in P.Tokens(P.vocabulary()).of(pa.array(texts, pa.string()))]
    assert got == [bpe.encode(x, add_special_tokens=False).ids + [1] for x in texts]


def test_each_word_is_tokenized_once(bpe, monkeypatch):
    """Whatever its capitals and the punctuation after it; the tokenizer's patterns are only needed for what isn't a plain word."""
    t, seen = P.Tokens(P.vocabulary()), []
    encode = t.encode
    t.encode = lambda texts, **kw: (seen.extend(texts), encode(texts, **kw))[1]
    texts = ["One, ONE. one; (one) Été ÉTÉ, été... oNE,", None, "été!! one's"]
    want = [bpe.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in t.of(pa.array(texts, pa.string()))] == want
    assert {p.decode() for p in t.new} == {"one", "été", ",", ".", ";", "(one", ")", "...", "!!", "'s"}
    assert seen and not any("été" in x for x in seen)
    texts = ["one " * 9 + "日本語テキスト" * 50, "ONE, Été"] * 4
    for name, value in (("SIMPLE", 8), ("WORDS", 2)):  # as they are; long pieces
        monkeypatch.setattr(P, name, value)
        got = [np.frombuffer(x, "<u4").tolist() for x in t.of(pa.array(texts, pa.string()).slice(1, 5))]
        assert got == [bpe.encode(x, add_special_tokens=False).ids + [1] for x in texts[1:6]]
