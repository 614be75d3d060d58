from __future__ import annotations

import hashlib

import pytest
import zstandard

from frameseg.llm import warc as W


def make(records, dictionary=None):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    c = zstandard.ZstdCompressor(dict_data=d) if d else zstandard.ZstdCompressor()
    return (W.skippable(dictionary) if dictionary else b"") + b"".join(c.compress(r) for r in records)


def record(payload=b"<p>hello</p>", page=1, url="http://x.example/", refers=None):
    return W.record(page, url, payload, hashlib.sha1(payload).digest(), refers)


@pytest.fixture(scope="module")
def dictionary():
    return zstandard.train_dictionary(4096, [record(b"<html><body>%d some words and more %d</body></html>" % (i, i * 7)) for i in range(400)]).as_bytes()


def test_frames_with_and_without_dictionary(dictionary):
    rs = [record(b"x" * n, n) for n in (0, 1, 1000, 200_000)]
    for d in (None, dictionary):
        assert list(W.frames(make(rs, d))) == rs
        assert list(W.frames(make(rs, d), step=7)) == rs
    raw = W.struct.pack("<II", W.SKIPPABLE, len(dictionary)) + dictionary
    body = make(rs, dictionary)[len(W.skippable(dictionary)) :]
    assert list(W.frames(raw + body)) == rs


def test_damage_is_found(dictionary):
    good = make([record()], dictionary)
    for bad in (good[:-3], good + b"junk", W.skippable(dictionary)[:-5], W.struct.pack("<II", W.SKIPPABLE, 4) + b"abcd"):
        with pytest.raises(W.WarcError):
            list(W.frames(bad))
    with pytest.raises(W.WarcError):  # decoded without its dictionary
        list(W.frames(good[len(W.skippable(dictionary)) :]))


@pytest.mark.parametrize("old,new", [(b"WARC/1.1", b"WARC/1.0"), (b"WARC-Date", b"WARC-Data"), (b"hello", b"hellO"), (b"Content-Length: 12\r\n\r\n", b"Content-Length: 13\r\n\r\n"), (b"sha1:", b"md5:x")])
def test_invalid_records(old, new):
    r = record()
    assert old in r
    with pytest.raises(W.WarcError):
        W.parse(r.replace(old, new, 1))


def test_truncated_block():
    with pytest.raises(W.WarcError):
        W.parse(record()[:-1])


def test_ids():
    for i in (0, 1, -5, 2**63 - 1, -(2**63)):
        assert W.page_of(W.record_id(i, "")) == i
    assert W.page_of(W.record_id(None, "a")) is None


def test_round_trip(spark):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "http://a/", big), (5, "http://b/ c\n", big), (3, None, big), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (None, "n", big), (11, "u", other), (11, "u", other), (12, "w", "<p>\r\n\r\n</p>"), (13, "long", "q" * 500_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = W.archive(pages).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == big and i != 5 else "response", 5 if h == big and i != 5 else None) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
    assert {r.url for r in got if r.page_id == 5} == {"http://b/%20c%0A"}


def test_empty(spark):
    assert W.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_are_of_bounded_size(spark, tmp_path):
    import os

    rows = [(i % 3 or None, "u", os.urandom(2000).hex(), None) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to long")
    paths = W.write(pages.coalesce(1), f"file://{tmp_path}", None, limit=10_000)
    assert len(paths) >= 10 and len(set(paths)) == len(paths)
    assert all(os.path.getsize(p[7:]) < 15_000 for p in paths)
    (tmp_path / "part-999999-0000.warc.zst").write_bytes(b"left by a task that was lost")
    got = W.read(spark.read.format("binaryFile").load(paths)).collect()
    assert sorted(bytes(r.payload).decode() for r in got) == sorted(r[2] for r in rows)
