"""Scoring, labelling, manifests, text functions, signal processing, sources, connectors, streaming."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameseg.functions import dsp
from frameseg.functions import text as TX
from frameseg.operators import labelling as L
from frameseg.operators import manifests as MF
from frameseg.operators import scoring as C
from frameseg.schemas import FeatureConfig, PostProcessConfig, PseudoLabelConfig
from frameseg.sources import archives, audio, connectors, tables
from frameseg.streaming import segmenter


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


# scoring
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 112, 113, 500])
def test_chunks_cover_every_frame(spark, n):
    r = spark.createDataFrame([("v", n)], "vod_id string, n int")
    got = [(x.start, x.stop) for x in C.chunk_starts(r, "n", 64, 16).orderBy("chunk_id").collect()]
    want, s = [], 0
    while n:
        want.append((s, min(n, s + 64)))
        if s + 64 >= n:
            break
        s += 48
    assert got == want
    f = spark.range(n).select(F.lit("v").alias("vod_id"), F.col("id").cast("int").alias("frame_idx"), F.lit(1.0).alias("prob"))
    pairs = {(x.chunk_id, x.frame_idx) for x in C.in_chunks(f, r, 64, 16).collect()}
    assert pairs == {(k, i) for k, (a, b) in enumerate(want) for i in range(a, b)}


def test_sample_chunks_of_a_long_recording(spark):
    n = (1 << 31) + 5_000_000  # more samples than 32 bits count
    r = spark.createDataFrame([("v", n)], "vod_id string, n long")
    x = C.sample_chunks(r, "n", 600_000, 30_000, 5120)
    got = [(c.start, c.stop, c.first_frame) for c in x.orderBy("chunk_id").collect()]
    want = [(s, min(n, s + 600_000), s // 5120) for s in range(0, n - 30_000, 570_000)]
    assert got == want and got[-1][1] == n
    last = C.trimmed(x.where(F.col("stop") == n), 30_000).agg(F.count("*").alias("k"), F.max("frame_idx").alias("top")).collect()[0]
    assert (last.k, last.top) == (n - got[-1][0] - 30_000, n - 1)


def test_overlap_add_leaves_uncovered_frames_at_zero(spark):
    grid = spark.createDataFrame([("v", i) for i in range(3)], "vod_id string, frame_idx int")
    c = spark.createDataFrame([("v", 0, 0.2), ("v", 0, 0.4), ("v", 1, 0.5)], "vod_id string, frame_idx int, prob double")
    assert [round(r.prob, 9) for r in C.overlap_add(c, grid).orderBy("frame_idx").collect()] == [0.3, 0.5, 0.0]


def test_softmax_and_scorers(spark):
    x = spark.createDataFrame([([1000.0, 1001.0],), ([0.0, 0.0],)], "l array<double>")
    got = [r.p for r in x.select(C.softmax_class("l", 1).alias("p")).collect()]
    np.testing.assert_allclose(got, [1 / (1 + np.exp(-1)), 0.5])
    with pytest.raises(ValueError):
        C.build_scorer("none")


def test_tiles(spark):
    r = spark.createDataFrame([("a", 100), ("b", 10), ("c", 48)], "vod_id string, n int")
    got: dict = {}
    for x in C.tiles(r, "n", 48).collect():
        got.setdefault(x.vod_id, []).append(x.start)
    assert got == {"a": [0, 48], "b": [0], "c": [0]}


# labels
def test_pseudo_labels_paint_in_order(spark):
    cfg = PseudoLabelConfig(frame_rate=1.0)
    grid = spark.range(100).select(F.lit("v").alias("vod_id"), F.col("id").cast("int").alias("frame_idx"))
    spans = spark.createDataFrame([("v", 20.0, 60.0, True), ("v", 70.0, 90.0, False)], "vod_id string, start double, end double, positive boolean")
    y = [r.label for r in L.pseudo_labels(grid, spans, cfg).orderBy("frame_idx").collect()]
    want = np.zeros(100, int)
    want[12:68] = -1
    want[28:52] = 1
    assert y == want.tolist()


def test_pool_labels(spark):
    y = spark.createDataFrame([("v", i, v) for i, v in enumerate([1, -1, 0, -1, 0, 0, 3, 0, 1])], "vod_id string, frame_idx int, label int")
    assert [r.label for r in L.pool_labels(y).orderBy("frame_idx").collect()] == [1, -1, 0, 0]


# manifests
def test_splits(spark):
    m = spark.createDataFrame([("a", "1", 5), ("b", "1", 9), ("c", "2", 9), ("d", "2", 1), ("e", "3", 7)], "stem string, streamer string, n int")
    assert {r.stem for r in MF.ranked_split(m, "n").where("split = 'val'").collect()} == {"c", "a"}
    assert {r.stem for r in MF.largest_per_group_split(m, "streamer", "n").where("split = 'val'").collect()} == {"b", "c", "e"}


def test_weighted_choice(spark):
    m = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0), ("d", None)], "vod_id string, w double")
    draws = spark.range(6000).withColumnRenamed("id", "i")
    a = MF.weighted_choice(m, draws, "w", 3).groupBy("vod_id").count().collect()
    n = {r.vod_id: r["count"] for r in a}
    assert sum(n.values()) == 6000 and abs(n["b"] / 6000 - 0.5) < 0.03 and abs(n["c"] / 6000 - 1 / 6) < 0.03
    assert sorted(map(tuple, a)) == sorted(map(tuple, MF.weighted_choice(m, draws, "w", 3).groupBy("vod_id").count().collect()))


# text
@pytest.mark.parametrize("text,seconds", [("1:02.500", 62.5), ("1:00:00.250", 3600.25), (" 7 ", 7.0)])
def test_clock(spark, text, seconds):
    assert one(spark, TX.clock_seconds(F.lit(text))) == seconds


def test_clock_there_and_back(spark):
    for s in (0.0, 59.999, 60.0, 3599.5, 3600.0, 36000.125):
        assert one(spark, TX.clock_seconds(TX.clock_text(F.lit(s)))) == s


def test_ids_and_names(spark):
    assert one(spark, TX.recording_id(F.lit("https://a/video/BV1xx411c7mD?p=3"))) == "BV1xx411c7mD"
    assert one(spark, TX.recording_id(F.lit("AV170001"))) == "av170001" and one(spark, TX.recording_id(F.lit("x"))) is None
    assert one(spark, TX.page_number(F.lit("u?a=1&p=12"))) == 12 and one(spark, TX.page_number(F.lit("u"))) == 1
    assert one(spark, TX.safe_name(F.lit('  a/b:  c*"?'))) == "a_b_c" and one(spark, TX.safe_name(F.lit("///"))) == "video"
    assert one(spark, F.length(TX.safe_name(F.lit("é" * 200)))) == 80
    assert one(spark, TX.stem_of(F.lit("/x/streamer/v.1.wav"))) == "v.1" and one(spark, TX.streamer_of(F.lit("/x/streamer/v.wav"))) == "streamer"


# signal processing
def test_yin_finds_tones():
    t = np.arange(16_000) / 16_000
    for f in (110.0, 220.5, 440.0, 900.0):
        y = dsp.yin(np.sin(2 * np.pi * f * t))
        assert abs(np.median(y) - f) < 0.01 * f
    assert len(dsp.yin(np.zeros(10))) == 0


def test_log_mel():
    cfg = FeatureConfig()
    t = np.arange(16_000) / 16_000
    m = dsp.log_mel(np.sin(2 * np.pi * 1000 * t), cfg)
    assert m.shape == (51, 80) and len(dsp.log_mel(np.empty(0))) == 0
    peak = np.argmax(dsp.mel_filters(cfg)[64])  # bin 64 is 1000 Hz
    assert abs(int(m[25].argmax()) - int(peak)) <= 1
    assert np.allclose(dsp.log_mel(np.zeros(16_000)), np.log(1e-5))


def test_levels():
    assert abs(dsp.rms_db(np.full(100, 0.1)) + 20) < 1e-5 and dsp.rms_db([]) == pytest.approx(-160)
    assert dsp.frame_db(np.ones(1024 + 320)).shape == (2,)


# sources
def test_wav_round_trip(spark):
    x = np.sin(np.arange(5000) / 7).astype(np.float32)
    files = spark.createDataFrame([("/a/one.wav", bytearray(audio.write_wav(x, 16_000)))], "path string, content binary")
    chunks = audio.audio_chunks(files, 16_000, 0.1)
    assert [(r.chunk_id, r.start_sample, len(r.samples)) for r in chunks.orderBy("chunk_id").collect()] == [(0, 0, 1600), (1, 1600, 1600), (2, 3200, 1600), (3, 4800, 200)]
    got = audio.read_span(chunks, 1500, 250).collect()[0].samples
    np.testing.assert_allclose(got, x[1500:1750], atol=1e-4)
    assert len(audio.load(audio.write_wav(x, 8000), 16_000)) == 10_000
    with pytest.raises(ValueError):
        audio.load(b"not audio")


def zipped(names, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for n, b in names:
            z.writestr(n, b)
    return out.getvalue()


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_partial_archives(spark, tmp_path, method):
    members = [("a.txt", b"hello" * 100), ("b/", b""), ("b/c.bin", bytes(range(256)) * 50), ("d", b"")]
    data = zipped(members, method)
    want = [(n, b) for n, b in members if not n.endswith("/")]
    assert list(archives.partial(data)) == list(archives.whole(data)) == want
    cut = data.index(b"PK", 4) + 60  # inside the second member's header, or its data
    assert list(archives.partial(data[:cut])) == want[:1] and list(archives.partial(b"")) == []
    path = tmp_path / "x.zip"
    path.write_bytes(data)
    archives.register(spark)
    rows = spark.read.format("partialzip").option("path", str(path)).load().collect()
    assert [(r.name, bytes(r.content)) for r in rows] == want
    rows = spark.read.format("partialzip").option("path", str(path)).option("done", "a.txt").load().collect()
    assert [r.name for r in rows] == ["b/c.bin", "d"]


def test_names_in_archives():
    assert archives.repaired_name("歌回".encode("gbk"), False) == "歌回" and archives.repaired_name("é".encode(), True) == "é"


def test_marker_files(spark, tmp_path):
    (tmp_path / "v1.csv").write_bytes("﻿Name\tStart\tDuration\nM 1\t1:00.500\t0:10.000\nM 2\t0:05.000\t0:00.000\n".encode())
    assert [tuple(r) for r in tables.read_markers(spark, str(tmp_path)).collect()] == [("v1", 60.5, 70.5)]


def test_json_files_and_listing(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "v.json").write_text('[{"start": 1, "end": 2.5, "positive": true}, {"start": 3, "end": 4, "positive": false}]')
    assert [tuple(r) for r in tables.read_segments(spark, str(tmp_path / "s")).collect()] == [("v", 1.0, 2.5)]
    (tmp_path / "m.json").write_text('[{"mel": "a", "label": "b", "vod": "c", "focus": [{"s": 1, "e": 2}]}, {"vod": "d"}]')
    got = tables.read_manifest(spark, str(tmp_path / "m.json")).collect()
    assert [(r.vod, r.weight, r.focus and tuple(r.focus[0])) for r in got] == [("c", None, (1.0, 2.0)), ("d", None, None)]
    x = tables.listing(spark, str(tmp_path), "*.json")
    assert {(r.streamer, r.stem) for r in x.collect()} == {("s", "v"), (tmp_path.name, "m")}
    assert [r.stem for r in tables.missing(x, x.where("stem = 'v'"), "stem").collect()] == ["m"]


def test_connector_retries(tmp_path):
    calls, slept = [], []

    def flaky(url, params):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("no")
        return {"code": 0, "data": {"x": 1}}

    assert connectors.call(flaky, "u", {}, sleep=slept.append) == {"x": 1} and slept == [2.0, 4.0]
    with pytest.raises(RuntimeError):
        connectors.call(lambda u, p: {"code": -404, "message": "gone"}, "u", {}, sleep=slept.append)
    body, tries = bytes(range(100)), []

    def fetch(url, start):
        tries.append((url, start))

        def pieces():
            yield body[start : start + 30]
            if len(tries) < 3:
                raise OSError("cut")
            yield body[start + 30 :]

        return True, pieces()

    assert connectors.download(fetch, ["a", "b"], tmp_path / "f").read_bytes() == body and tries == [("a", 0), ("b", 30), ("a", 60)]


def test_best_streams(spark):
    s = spark.createDataFrame([([(1, 5, "avc"), (2, 9, "hevc"), (2, 9, "av1"), (2, 9, "vp9")],)], "s array<struct<id:int,bandwidth:int,codecs:string>>")
    assert tuple(s.select(connectors.best_audio("s"), connectors.best_video("s")).collect()[0]) == (1, 2)


# streaming
def test_stream_state_equals_batch():
    from tests.test_sequence import np_hysteresis, np_merge, np_runs

    rng = np.random.default_rng(0)
    cfg = PostProcessConfig(frame_rate=1.0, min_blip_s=2, merge_gap_s=6, max_gap_s=3, min_song_s=5)
    for _ in range(200):
        x = np.clip(np.cumsum(rng.normal(0, 0.3, int(rng.integers(1, 80)))) % 2 - 0.5, 0, 1)
        runs = [(a, b) for a, b in np_runs(np_hysteresis(x, 0.6, 0.4)) if b - a >= 2]
        want = [(a, b) for a, b in np_merge(runs, 6, 1.0) if b - a >= 5]
        state, got, at = (0, -1, 0.0, -1, -1), [], 0
        while at < len(x):
            n = int(rng.integers(1, 12))
            state, done = segmenter._advance(state, list(enumerate(x[at : at + n], at)), cfg)
            got, at = got + done, at + n
        assert got + segmenter._end(state, cfg) == want


def test_stream(spark, tmp_path):
    cfg = PostProcessConfig(frame_rate=1.0, min_blip_s=2, merge_gap_s=6, max_gap_s=3, min_song_s=5)
    rows = [("v", i, 0.9 if i < 20 else 0.1) for i in range(60)]
    spark.createDataFrame(rows, "vod_id string, frame_idx long, prob double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("vod_id string, frame_idx long, prob double").parquet(str(tmp_path / "in"))
    q = segmenter.stream_songs(s, cfg).writeStream.format("memory").queryName("songs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("select * from songs").collect()] == [("v", 0, 20)]
