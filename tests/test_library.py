"""Library functions that queries on the tables don't reach in all their cases."""

from __future__ import annotations

import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameseg import entry_points as E
from frameseg.functions import dsp
from frameseg.operators import losses
from frameseg.operators import scoring as C
from frameseg.operators import sequence as S
from frameseg.schemas import PostProcessConfig, WindowConfig
from frameseg.sources import archives, audio, connectors, files, tables


def level(x):
    return float(np.sqrt(np.mean(np.square(x))))


def test_resampling_removes_what_the_new_rate_cannot_hold():
    t = np.arange(44_100) / 44_100
    inner = slice(1000, 15_000)
    for hz, want in ((440, 1.0), (3000, 1.0), (6000, 1.0), (10_000, 0.0), (12_000, 0.0), (20_000, 0.0)):
        y = dsp.resample(np.sin(2 * np.pi * hz * t), 44_100, 16_000)
        assert len(y) == 16_000
        if want:
            assert np.abs(y - np.sin(2 * np.pi * hz * np.arange(16_000) / 16_000))[inner].max() < 0.02
        else:
            assert level(y[inner]) < 0.02


@pytest.mark.parametrize("rates", [(8000, 16_000), (48_000, 16_000), (22_050, 16_000), (16_000, 11_025)])
def test_resampling_keeps_length_and_constants(rates):
    a, b = rates
    for n in (1, 7, 500, 5000):
        assert len(dsp.resample(np.ones(n), a, b)) == math.ceil(n * b / a)
    assert np.abs(dsp.resample(np.ones(5000), a, b)[200:-200] - 1).max() < 0.01
    assert len(dsp.resample(np.empty(0), a, b)) == 0


def test_augmentation_draws():
    """By a second reading of the same draws."""
    cfg = WindowConfig(freq_mask=3, time_mask=5, n_masks=2, bandlimit_prob=1.0, min_band=4)
    mel = np.random.default_rng(0).normal(size=(40, 10))
    got, rng, want = dsp.augment(mel, np.random.default_rng(5), cfg), np.random.default_rng(5), mel.T.copy()
    want += rng.uniform(-4, 4) * math.log(10) / 20
    rng.random()
    cut = int(rng.integers(4, 10))
    want[cut:, :] = want.min()
    for _ in range(2):
        f0 = int(rng.integers(0, 7))
        f1 = f0 + int(rng.integers(1, 4))
        want[f0:f1, :] = want.mean()
        t0 = int(rng.integers(0, 35))
        t1 = t0 + int(rng.integers(1, 6))
        want[:, t0:t1] = want.mean()
    np.testing.assert_allclose(got, want.T)
    assert dsp.augment(np.zeros((3, 2)), np.random.default_rng(1)).shape == (3, 2)


def test_pcm_rounds_halves_to_even_and_clamps():
    x = np.array([0.5 / 32767, 1.5 / 32767, -2.5 / 32767, 3.0, -3.0])
    assert dsp.to_pcm16(x).tolist() == [0, 2, -2, 32767, -32767]
    back, rate = audio.read_wav(audio.write_wav(x, 8000))
    assert rate == 8000 and np.rint(back[:, 0] * 32768).tolist() == [0, 2, -2, 32767, -32767]


def faded(x, body, overlap):
    """Chunk by chunk, as one would on paper."""
    out, tail, s = [], None, 0
    while s < len(x):
        c = np.array(x[s : s + body + overlap], float) + s
        if len(c) < overlap:
            break
        if tail is not None:
            n = min(overlap, len(c))
            r = np.linspace(0, 1, n)
            c[:n] = c[:n] * r + tail[:n] * (1 - r)
        out.append(c[:body])
        tail = c[body:]
        s += body
    return np.concatenate([*out, tail]) if out else np.empty(0)


def test_crossfade(spark):
    rng = np.random.default_rng(2)
    series = {f"v{n}": rng.normal(size=n) for n in (4, 5, 11, 12, 13, 16, 17, 24, 40)}
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "vod_id string, frame_idx int, prob double")
    x = audio.overlapping_chunks(rows, 8, 4).withColumn("samples", F.transform("samples", lambda v: v + 8 * F.col("chunk_id")))
    got: dict = {}
    for r in audio.crossfade(x, 8, 4).orderBy("vod_id", "chunk_id").collect():
        got.setdefault(r.vod_id, []).extend(r.samples)
    for k, v in series.items():
        np.testing.assert_allclose(got[k], faded(v, 8, 4), err_msg=k)


def test_class_losses(spark):
    rows = [([0.3, -1.0, 2.0], y) for y in (0, 1, 2, 3, -1)]
    got = spark.createDataFrame(rows, "l array<double>, y int").agg(losses.class_loss("l", F.col("y"), 3).alias("c"), losses.binary_loss(F.col("l")[0], F.col("y")).alias("b")).first()
    p = np.exp(rows[0][0]) / np.exp(rows[0][0]).sum()
    assert abs(got.c - np.mean([-math.log(p[0]), -math.log(p[1]), -math.log(p[2]), -math.log(1 - p[1])])) < 1e-9
    s = 1 / (1 + math.exp(-0.3))
    assert abs(got.b - np.mean([-math.log(1 - s)] + 3 * [-math.log(s)])) < 1e-9
    none = spark.createDataFrame([([800.0, -800.0, 0.0], -1)], "l array<double>, y int").agg(losses.class_loss("l", F.col("y"), 3).alias("c")).first()
    assert none.c == 0


def archive(names, flag8=False):
    out = io.BytesIO()
    if flag8:
        raw, out.seekable = out, lambda: False  # sizes follow the data
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, c in names:
            z.writestr(n, c)
    return out.getvalue()


@pytest.mark.parametrize("flag8", [False, True])
def test_incomplete_archives_are_read_in_pieces(flag8, monkeypatch):
    body = [("a.txt", b"one"), ("dir/b.bin", bytes(range(256)) * 400), ("c.txt", b""), ("d.txt", b"two " * 999)]
    data = archive(body, flag8)
    for size in (1, 7, 100, 1 << 20):
        whole = io.BytesIO(data)
        monkeypatch.setattr(archives.Pieces.__init__, "__defaults__", (size,))
        got = list(archives.partial(whole))
        assert got == body
    ends, seen = range(0, len(data), 97), 0
    for end in ends:
        got = list(archives.partial(data[:end]))
        assert got == body[: len(got)] and len(got) >= seen
        seen = len(got)


def test_names():
    assert archives.repaired_name("歌回.wav".encode("gbk"), False) == "歌回.wav"
    assert archives.repaired_name("é.wav".encode(), True) == "é.wav"


def test_files_of_markers_segments_and_manifests(spark):
    at = files.shared_folder(spark, "test")
    spans = spark.createDataFrame([("b", 3600.5, 3700.0), ("a", 1.25, 9.0), ("a", 20.0, 20.0)], "vod_id string, start double, end double")
    assert tables.write_markers(spans, f"{at}/m") == 2
    assert sorted(map(tuple, tables.read_markers(spark, f"{at}/m").collect())) == [("a", 1.25, 9.0), ("b", 3600.5, 3700.0)]
    assert tables.write_segments(spans.withColumn("positive", F.col("end") > F.col("start")), f"{at}/s") == 2
    assert sorted(map(tuple, tables.read_segments(spark, f"{at}/s").collect())) == [("a", 1.25, 9.0), ("b", 3600.5, 3700.0)]
    items = spark.createDataFrame([("x/1", None, [(1.0, 2.0)]), ("x/2", 0.5, None)], "vod string, weight double, focus array<struct<s:double,e:double>>")
    tables.write_manifest(items, f"{at}/f")
    assert sorted((r.vod, r.weight, r.focus and [tuple(f) for f in r.focus]) for r in tables.read_manifest(spark, f"{at}/f").collect()) == [("x/1", None, [(1.0, 2.0)]), ("x/2", 0.5, None)]


def test_a_cache_computes_what_it_lacks(spark):
    at, asked = files.shared_folder(spark, "cache"), []

    def compute(x):
        asked.append(sorted(r.k for r in x.collect()))
        return x.withColumn("v", F.col("k") * 2)

    for n, want in ((3, [0, 1, 2]), (5, [3, 4]), (5, [])):
        got = tables.cache_missing(spark.range(n).withColumnRenamed("id", "k"), compute, at, "k")
        assert asked[-1] == want and sorted((r.k, r.v) for r in got.collect()) == [(k, 2 * k) for k in range(max(n, 3))]


def test_a_page_is_fetched(tmp_path):
    streams = {"audio": [{"id": 1, "bandwidth": 5, "baseUrl": "a0"}, {"id": 2, "bandwidth": 9, "baseUrl": "a1", "backupUrl": ["a2"]}, {"id": 3, "bandwidth": 9, "baseUrl": "a3"}], "video": [{"id": 64, "codecs": "avc1.64", "baseUrl": "v0"}, {"id": 64, "codecs": "hev1", "baseUrl": "v1"}]}
    pages = [{"cid": 10, "part": "one"}, {"cid": 20, "part": "t/wo"}]
    asked, joined = [], []

    def ask(url, params):
        asked.append((url, params))
        if "aid" in params:
            return {"code": 0, "data": {"bvid": "BV0123456789"}}
        return {"code": 0, "data": {"title": "A  title?", "pages": pages} if url == "view" else {"dash": streams if params["cid"] == 20 else None}}

    def get(url, start):
        return True, [url.encode()]

    def mux(parts, out):
        joined.append([p.read_bytes() for p in parts])
        out.write_bytes(b"".join(p.read_bytes() for p in parts))

    fetch = lambda text, **k: connectors.fetch_recording(ask, get, mux, text, tmp_path, "view", "play", **k)
    out = fetch("https://x/av77?p=2", video=True)
    assert out.name == "A_title__p2_t_wo.mp4" and joined == [[b"v1", b"a1"]] and [p.name for p in tmp_path.iterdir()] == [out.name]
    assert fetch("BV0123456789", page=2).name == "A_title__p2_t_wo.m4a"
    assert fetch("b23.tv/x", follow=lambda a: "https://x/BV0123456789?p=2" if a == "https://b23.tv/x" else "").suffix == ".m4a"
    with pytest.raises(ValueError):
        fetch("BV0123456789", page=3)
    with pytest.raises(RuntimeError):
        fetch("BV0123456789", page=1)
    with pytest.raises(ValueError):
        fetch("no id")


def test_scores_lie_at_first_frames_cut_to_whole_numbers(spark):
    vods = spark.createDataFrame([("a", 9000, 30)], "vod_id string, samples long, n int")
    chunks = C.sample_chunks(vods, "samples", 1000, 110, 300)
    first = [r.first_frame for r in chunks.orderBy("chunk_id").collect()]
    assert first == [int(890 * k / 300) for k in range(len(first))] and len(first) == 10
    scores = chunks.select("vod_id", "chunk_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).withColumn("prob", F.col("chunk_id") + 0.0)
    want: dict = {}
    for k, f in enumerate(first):
        for i in range(4):
            want.setdefault(f + i, []).append(k)
    grid = spark.range(30).select(F.lit("a").alias("vod_id"), F.col("id").cast("int").alias("frame_idx"))
    got = {r.frame_idx: r.prob for r in C.overlap_add(C.placed(scores, chunks, vods), grid).collect()}
    assert got == {f: (sum(want[f]) / len(want[f]) if f in want else 0.0) for f in range(30)}


def test_short_label_series_align(spark):
    """The shorter of two series decides how many frames count."""
    f = spark.createDataFrame([("a", i, 0.9) for i in range(5)] + [("b", i, 0.1) for i in range(3)], "vod_id string, frame_idx int, prob double")
    y = spark.createDataFrame([("a", i, 1) for i in range(3)] + [("b", i, 0) for i in range(9)], "vod_id string, frame_idx int, label int")
    pooled, each = E.evaluate(f, y, PostProcessConfig(frame_rate=0.1, min_song_s=10, off_threshold=0.3))
    r = pooled.first()
    assert (r.tp, r.fp, r.fn, r.tn) == (3, 0, 0, 3) and r.frame_f1 == 1
    assert {x.vod_id: (x.n_true, x.n_pred) for x in each.collect()} == {"a": (1, 1)}


def test_classes_without_features(spark):
    """A recording without features is 4 outside its songs; one whose features end early is 0 from there on."""
    grid = spark.createDataFrame([(v, i) for v in "ab" for i in range(6)], "vod_id string, frame_idx int")
    feats = spark.createDataFrame([("a", i, -30.0, -30.0, 0.0, 0.0) for i in range(3)], "vod_id string, frame_idx int, voc_db double, acc_db double, roll_std double, sustained double")
    songs = spark.createDataFrame([("a", 1.0, 2.0), ("b", 4.0, 6.0)], "vod_id string, start double, end double")
    none = spark.createDataFrame([], "vod_id string, start double, end double, positive boolean")
    from frameseg.schemas import PseudoLabelConfig

    got = E.multiclass_labels(grid, feats, songs, none, grid, PseudoLabelConfig(frame_rate=1.0)).collect()
    got = {(r.vod_id, r.frame_idx): r.label for r in got}
    assert [got["a", i] for i in range(6)] == [-1, 1, -1, 0, 0, 0]
    assert [got["b", i] for i in range(6)] == [4, 4, 4, 4, 1, 1]


def test_manifest_splits(spark):
    items = spark.createDataFrame([("t", f"t{i}", f"t/t{i}", 10.0 * i) for i in range(5)] + [("o", f"o{i}", f"o/o{i}", 5.0 * i) for i in range(3)], "streamer string, stem string, vod_id string, pos_seconds double")
    spans = spark.createDataFrame([("o/o1", 1.0, 2.0, True), ("o/o1", 5.0, 6.0, False)], "vod_id string, start double, end double, positive boolean")
    got = {r.stem: r for r in E.build_manifest(items, "t", spans).collect()}
    assert {s for s, r in got.items() if r.split == "val"} == {"t3", "t1", "o2"}
    assert [tuple(f) for f in got["o1"].focus] == [(1.0, 2.0)] and got["o2"].focus is None and got["o1"].pos_seconds == 0
    assert {s for s, r in ((r.stem, r) for r in E.build_manifest(items, "t", spans, ["t0"]).collect()) if r.split == "val"} == {"t0", "o2"}


def test_matches_do_not_depend_on_cells(spark, monkeypatch):
    from frameseg.operators import metrics as M

    rng = np.random.default_rng(3)
    edges = np.sort(rng.choice(40_000, 200, replace=False)).astype(float)
    p = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)], "vod_id string, start double, end double")
    t = p.select("vod_id", (F.col("start") + 3).alias("start"), (F.col("end") + 5).alias("end"))
    want = None
    for cell in (1.0, 100.0, 3600.0, 1e9):
        monkeypatch.setattr(M, "CELL", cell)
        got = sorted(map(tuple, M.match_join(p, t).collect()))
        want = want or got
        assert got == want and len(got) > 50


def test_tiles_are_filled_up(spark):
    x = spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", i, float(i)) for i in range(4)], "vod_id string, frame_idx int, prob double")
    got = sorted(map(tuple, S.padded_tiles(x, 4, prob=-9.0).select("vod_id", "frame_idx", "prob", "tile").collect()))
    assert got == [("a", i, float(i) if i < 5 else -9.0, i // 4) for i in range(8)] + [("b", i, float(i), 0) for i in range(4)]
