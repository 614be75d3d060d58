"""Queries of sources, sinks, scalar functions, set operations, sampling and plug points."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import dsp
from ..functions import text as TX
from ..operators import labelling as L
from ..operators import losses
from ..operators import manifests as MF
from ..operators import metrics as M
from ..operators import scoring as C
from ..operators import sequence as S
from ..operators import synthesis as Y
from ..schemas import FeatureConfig, WindowConfig
from ..sources import archives, audio, connectors, files, tables
from . import sqltext as T
from .base import CFG, PCFG, RATE, query
from .core import EVENTS, HISTORY, NAMES, _history, _pred_true

CLOCK = """case when ms >= 3600000 then (ms // 3600000)::varchar || ':' || lpad((ms // 60000 % 60)::varchar, 2, '0') else (ms // 60000)::varchar end || ':' || lpad((ms // 1000 % 60)::varchar, 2, '0') || '.' || lpad((ms % 1000)::varchar, 3, '0')"""


def _markers(spark, d):
    t = M.truth_segments(X.labels(spark, d), RATE, 90)
    return t.select("vod_id", F.lit("m").alias("Name"), TX.clock_text(F.col("start") + 0.25).alias("Start"), TX.clock_text(F.col("end") - F.col("start")).alias("Duration"))


MARKS = ("marks", f"""select vod_id, {CLOCK.replace('ms', 'a')} as "Start", {CLOCK.replace('ms', 'b')} as "Duration" from (select vod_id, floor((start + 0.25) * 1000 + 0.5)::bigint as a, floor(("end" - start) * 1000 + 0.5)::bigint as b from truth)""")
SECONDS = "list_reduce(list_prepend(0::double, list_transform(string_split(trim({c}), ':'), lambda z: z::double)), lambda a, z: a * 60 + z)"


@query("s3_frame_slice", T.sql("select vod_id, frame_idx, prob from frames where frame_idx between 40 and 59", T.FRAMES))
def s3(spark, d):
    return X.frames(spark, d).where("frame_idx between 40 and 59")


@query("s2_feature_cache", T.sql("select vod_id, frame_idx, round(prob * prob, 6) as power from frames", T.FRAMES))
def s2(spark, d):
    """The cache is made in two steps, the second of which computes only what the first lacks."""
    f, at = X.frames(spark, d), files.shared_folder(spark, "cache")
    power = lambda x: x.select("vod_id", "frame_idx", F.round(F.col("prob") * F.col("prob"), 6).alias("power"))
    tables.cache_missing(f.where("vod_id < 'f'"), power, at, "vod_id")
    return tables.cache_missing(f, power, at, "vod_id")


@query("s4_marker_scan", T.sql(f'select vod_id, s as start, s + d as "end" from (select vod_id, {SECONDS.format(c=chr(34) + "Start" + chr(34))} as s, {SECONDS.format(c=chr(34) + "Duration" + chr(34))} as d from marks) where d > 0', T.LABELS, T.truth(), MARKS))
def s4(spark, d):
    at = files.shared_folder(spark, "markers")
    t = M.truth_segments(X.labels(spark, d), RATE, 90)
    empty = t.groupBy("vod_id").agg(F.min("start").alias("start")).select("vod_id", "start", F.col("start").alias("end"))  # a marker without length
    tables.write_markers(t.unionByName(empty).select("vod_id", (F.col("start") + 0.25).alias("start"), (F.col("end") + 0.25).alias("end")), at)
    return tables.read_markers(spark, at)


@query("s5_manifest_scan", T.sql("select streamer || '/' || stem as vod, n_frames::double as pos_seconds, case when streamer = '0' then 12.0::double end as weight from items", T.USER_FRAMES, T.MANIFEST))
def s5(spark, d):
    at, weight = files.shared_folder(spark, "manifest"), F.when(F.col("streamer") == "0", 12.0)
    tables.write_manifest(X.manifest(spark, d).select(F.concat_ws("/", "streamer", "stem").alias("vod"), F.col("n_frames").cast("double").alias("pos_seconds"), weight.alias("weight")), at)
    return tables.read_manifest(spark, at).select("vod", "pos_seconds", "weight")


@query("s6_segment_scan", T.sql('select vod_id, start, "end" from pseudo where positive', T.FEATURES, T.CANDIDATES, T.PSEUDO))
def s6(spark, d):
    at = files.shared_folder(spark, "segments")
    tables.write_segments(L.pseudo_segments(X.feature_frames(spark, d), PCFG), at)
    return tables.read_segments(spark, at)


def _wavs(spark, d):
    """A folder with a WAV file of each event type's values."""
    at = files.shared_folder(spark, "wav")
    x = X.frames(spark, d).groupBy("vod_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "prob"))).alias("c"))
    audio.save_wavs(x.select("vod_id", F.transform("c", lambda c: c["prob"] - 0.5).alias("samples")), at, 8000)
    return at


def _audio(spark, d):
    return spark.read.format("binaryFile").load(_wavs(spark, d))


N = "(select vod_id, count(*) as n from frames group by vod_id)"


@query("s1_audio_load", T.sql(f"select vod_id, c as chunk_id, c * 160 as start_sample, least(160, n - c * 160) as n from (select vod_id, n, unnest(range(0, (n + 159) // 160)) as c from {N})", T.FRAMES))
def s1(spark, d):
    x = audio.audio_chunks(_audio(spark, d), 8000, 0.02)
    return x.select("vod_id", F.col("chunk_id").cast("long").alias("chunk_id"), "start_sample", F.size("samples").cast("long").alias("n"))


@query("s7_span_read", T.sql("select vod_id, count(*) as n, sum(round_even((prob - 0.5) * 32767, 0))::bigint as total from frames where frame_idx between 100 and 239 group by vod_id", T.FRAMES))
def s7(spark, d):
    chunks = audio.audio_chunks(_audio(spark, d), 8000, 0.02)
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, v: a + F.round(v * 32768).cast("long"))
    return audio.read_span(chunks, 100, 140).select("vod_id", F.size("samples").cast("long").alias("n"), total.alias("total"))


@query("s8_listing", T.sql(f"select 'wav' as streamer, vod_id as stem, 44 + 2 * n as length from {N}", T.FRAMES))
def s8(spark, d):
    at = f"{_wavs(spark, d)}/"
    x = tables.listing(spark, at)
    return x.select(F.regexp_extract("streamer", "^[a-z]+", 0).alias("streamer"), "stem", "length")


def _zips(spark, d, complete):
    """A folder with the WAV files as archives of two members each; incomplete ones lack their second half."""

    def pack(batches):
        import io
        import zipfile

        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                out, name = io.BytesIO(), path.rpartition("/")[2]
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("a/info.txt", name)
                    z.writestr("a/audio.wav", content)
                data = out.getvalue()
                yield pd.DataFrame({"name": [name + ".zip"], "content": [data if complete else data[: len(data) // 2]]})

    at = files.shared_folder(spark, "zip")
    files.write_files(_audio(spark, d).select("path", "content").mapInPandas(pack, "name string, content binary"), at)
    return at


INFO = f"select vod_id || '.wav.zip' as archive, 'a/info.txt' as name, length(vod_id) + 4 as size from {N}"


@query("s9_zip_members", T.sql(f"{INFO} union all select vod_id || '.wav.zip', 'a/audio.wav', 44 + 2 * n from {N}", T.FRAMES))
def s9(spark, d):
    return archives.members(spark.read.format("binaryFile").load(_zips(spark, d, True))).select("archive", "name", "size")


@query("s10_partial_zip", T.sql(INFO, T.FRAMES))
def s10(spark, d):
    """Of archives cut in half the members before the cut."""
    archives.register(spark)
    found = spark.read.format("binaryFile").load(_zips(spark, d, False)).select("path").collect()  # one name a recording
    return spark.read.format("partialzip").option("path", ",".join(r.path for r in found)).load().select("archive", "name", "size")


@query("k1_segment_json", T.sql("""select vod_id, '[' || string_agg('{"start":' || start::varchar || ',"end":' || "end"::varchar || '}', ',' order by start) || ']' as segments from pred group by vod_id""", T.FRAMES, T.songs(), T.pred()))
def k1(spark, d):
    """The text of the files that are written."""
    at = files.shared_folder(spark, "result")
    tables.write_segments(S.probs_to_segments(X.frames(spark, d), CFG).select("vod_id", "start", "end"), at)
    x = spark.read.option("wholetext", True).text(at).withColumn("vod_id", TX.stem_of(F.input_file_name()))
    return x.select("vod_id", F.col("value").alias("segments"))


@query("k2_cut_plan", T.sql("select vod_id, seg_no, vod_id || '_song' || lpad(seg_no::varchar, greatest(2, length(seg_no::varchar))::int, '0') || '.mp4' as clip, printf('%.2f', greatest(0, s - 5)) as ss, printf('%.2f', e + 5 - greatest(0, s - 5)) as t from pred", T.FRAMES, T.songs(), T.pred()))
def k2(spark, d):
    return audio.cut_plan(S.probs_to_segments(X.frames(spark, d), CFG))


@query("k3_pcm16", T.sql("select vod_id, frame_idx, round_even(least(1, greatest(-1, prob * 3 - 1.5)) * 32767, 0)::int as pcm from frames", T.FRAMES))
def k3(spark, d):
    """The integers in the WAV files that are written."""
    at = files.shared_folder(spark, "pcm")
    x = X.frames(spark, d).groupBy("vod_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "prob"))).alias("c"))
    audio.save_wavs(x.select("vod_id", F.transform("c", lambda c: c["prob"] * 3 - 1.5).alias("samples")), at, 16_000)

    def integers(batches):
        import numpy as np

        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                pcm = np.rint(audio.read_wav(content)[0][:, 0].astype(np.float64) * 32768).astype("int32")
                yield pd.DataFrame({"vod_id": path.rpartition("/")[2].removesuffix(".wav"), "frame_idx": np.arange(len(pcm), dtype="int32"), "pcm": pcm})

    return spark.read.format("binaryFile").load(at).select("path", "content").mapInPandas(integers, "vod_id string, frame_idx int, pcm int")


@query("k4_best_checkpoint", f"select max(score) as score, min(step) filter (score = top) as step from (select *, max(score) over () as top from ({HISTORY}))")
def k4(spark, d):
    best = _history(spark, d).agg(F.max(F.struct("score", (-F.col("step")).alias("s"))).alias("b"))
    return best.select("b.score", (-F.col("b.s")).alias("step"))


PICKS = [
    ("tn", "select stem as vod_id, row_number() over (order by stem) - 1 as k from items where streamer = '0'"),
    ("ot", "select stem as vod_id, row_number() over (order by stem) - 1 as k from items where streamer <> '0'"),
    ("drawn", f"select i, kind, {T.uniform(7, 'kind', 'i', '1')} as u1, {T.uniform(7, 'kind', 'i', '2')} as u2, {T.uniform(7, 'kind', 'i', '3')} as u3 from range(0, 40) r(i), (values ('remix_other'), ('accomp_only'), ('voc_mismatch')) v(kind)"),
    ("picks", "select kind || '_' || lpad(i::varchar, 3, '0') as clip, kind, case when kind = 'voc_mismatch' then 1 else 0 end as label, tn.vod_id as target, ot.vod_id as other, case kind when 'remix_other' then u3 * 6 - 2 when 'voc_mismatch' then -(u3 * 6 + 2) end as gain_db from drawn join tn on tn.k = floor(u1 * (select count(*) from tn)) left join ot on kind <> 'accomp_only' and ot.k = floor(u2 * (select count(*) from ot))"),
]


def _singers(spark, d):
    x = X.manifest(spark, d).select("streamer", F.col("stem").alias("vod_id"))
    return x.where("streamer = '0'"), x.where("streamer <> '0'")


@query("j9_remix_pairs", T.sql("select clip, kind, label, target, other, round(gain_db, 9) as gain_db from picks", T.USER_FRAMES, T.MANIFEST, PICKS))
def j9(spark, d):
    return Y.remix_pairs(*_singers(spark, d), 40).withColumn("gain_db", F.round("gain_db", 9))


#: From what the operator must give: a chunk is 48 frames and up to 16 more; over these it goes from 1 to 0 by a ramp that ends at 0 and 1, while the next goes
#: from 0 to 1; a last piece of under 16 frames has no chunk of its own.
FADE = """
select vod_id, frame_idx, round(case when c > 0 and i < l then v * r + (v - 0.25) * (1 - r) else v end, 9) as s from (
  select *, prob + 0.25::double * c as v, case when l > 1 then i / (l - 1)::double else 0 end as r from (
    select vod_id, frame_idx, prob, c, frame_idx - c * 48 as i, least(16, n - c * 48) as l from (
      select vod_id, frame_idx, prob, n, case when n - (frame_idx // 48) * 48 >= 16 then frame_idx // 48 else frame_idx // 48 - 1 end as c from frames join (select vod_id, count(*) as n from frames group by vod_id) using (vod_id))))
"""


@query("j10_crossfade", T.sql(FADE, T.FRAMES))
def j10(spark, d):
    """Chunks that differ by a constant, so that the fade shows, as one series again."""
    x = audio.overlapping_chunks(X.frames(spark, d), 48, 16)
    x = x.withColumn("samples", F.transform("samples", lambda v: v + 0.25 * F.col("chunk_id")))
    out = audio.crossfade(x, 48, 16).select("vod_id", "chunk_id", F.posexplode("samples").alias("i", "s"))
    return out.select("vod_id", (F.col("chunk_id") * 48 + F.col("i")).cast("long").alias("frame_idx"), F.round("s", 9).alias("s"))


# set operations and sorts
@query("o1_union_sources", T.sql("select vod, weight, focus from (select streamer || '/' || stem as vod, 12.0::double as weight, null::varchar as focus from items where streamer = '0' union all select streamer || '/' || stem, null, 'x' from items where streamer <> '0' union all select name, 0.25::double, null from synth)", T.USER_FRAMES, T.MANIFEST, ("synth", f"select name from ({NAMES})")))
def o1(spark, d):
    m = X.manifest(spark, d).withColumn("vod", F.concat_ws("/", "streamer", "stem"))
    gold = m.where("streamer = '0'").select("vod", F.lit(12.0).alias("weight"))
    others = m.where("streamer <> '0'").select("vod", F.lit("x").alias("focus"))
    kind = F.element_at(F.array(*map(F.lit, ("voc_mismatch_", "remix_other_", "accomp_only_", "plain_"))), (F.col("event_id") % 4 + 1).cast("int"))
    synth = X.table(spark, d, "events").select(F.concat(kind, F.col("event_id").cast("string")).alias("vod"), F.lit(0.25).alias("weight"))
    return gold.unionByName(others, allowMissingColumns=True).unionByName(synth, allowMissingColumns=True).select("vod", "weight", "focus")


@query("o2_split_partition", T.sql("select stem from items where stem not in (select stem from items where n_frames % 7 = 0)", T.USER_FRAMES, T.MANIFEST))
def o2(spark, d):
    m = X.manifest(spark, d)
    return m.select("stem").join(m.where("n_frames % 7 = 0").select("stem"), "stem", "left_anti")


@query("o3_negative_reuse", f"select name from (select event_id, name, event_id % 3 <> 0 as has_focus from ({NAMES})) where has_focus and name not like 'voc%' and name not like '%plain_1%'")
def o3(spark, d):
    """Items whose JSON has the key focus, null or not, of no synthetic and no target name."""
    kind = F.element_at(F.array(*map(F.lit, ("voc_mismatch_", "remix_other_", "accomp_only_", "plain_"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = X.table(spark, d, "events").select("event_id", F.concat(kind, F.col("event_id").cast("string")).alias("name"))
    j = e.select("name", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit('{"vod":"'), "name", F.lit('","focus":null}'))).otherwise(F.concat(F.lit('{"vod":"'), "name", F.lit('"}'))).alias("j"))
    return j.where(F.array_contains(F.json_object_keys("j"), "focus") & ~F.col("name").startswith("voc") & ~F.col("name").contains("plain_1")).select("name")


@query("o4_chunk_concat", T.sql("select vod_id, string_agg(round(prob * 100)::int::varchar, ',' order by frame_idx) as series from frames group by vod_id", T.FRAMES))
def o4(spark, d):
    """Chunks of a series, each an array, one after the other again."""
    x = X.frames(spark, d).withColumn("chunk_id", F.floor(F.col("frame_idx") / 64))
    c = x.groupBy("vod_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "prob"))).alias("c"))
    c = c.select("vod_id", F.struct("chunk_id", F.transform("c", lambda v: v["prob"]).alias("s")).alias("c"))
    c = c.groupBy("vod_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    flat = F.flatten(F.transform("c", lambda v: v["s"]))
    return c.select("vod_id", F.array_join(F.transform(flat, lambda v: F.round(v * 100).cast("int").cast("string")), ",").alias("series"))


@query("t2_best_streams", "select o_custkey, min(i) filter (b = tb) as audio, min(i) filter (r = tr) as video from (select *, max(b) over w as tb, max(r) over w as tr from (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i, o_orderkey % 5 as b, (o_orderkey % 3) * 100 - length(o_orderpriority) as r from orders) window w as (partition by o_custkey)) group by o_custkey")
def t2(spark, d):
    s = F.struct("o_orderkey", (F.col("o_orderkey") % 5).alias("bandwidth"), (F.col("o_orderkey") % 3).alias("id"), F.col("o_orderpriority").alias("codecs"))
    x = X.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(s)).alias("streams"))
    return x.select("o_custkey", connectors.best_audio("streams").alias("audio"), connectors.best_video("streams").alias("video"))


@query("t3_sorted_marks", T.sql('select row_number() over (order by vod_id, start, "end") as n, vod_id, start, "end" from truth', T.LABELS, T.truth()))
def t3(spark, d):
    t = M.truth_segments(X.labels(spark, d), RATE, 90)
    return t.withColumn("n", F.row_number().over(W.orderBy("vod_id", "start", "end"))).orderBy("n")


@query("t5_file_order", T.sql("select row_number() over (order by stem) as n, stem from items", T.USER_FRAMES, T.MANIFEST))
def t5(spark, d):
    return X.manifest(spark, d).select(F.row_number().over(W.orderBy("stem")).alias("n"), "stem")


# scalar functions
@query("f1_clock", T.sql(f'select vod_id, "Start" as clock, {SECONDS.format(c=chr(34) + "Start" + chr(34))} as seconds from marks', T.LABELS, T.truth(), MARKS))
def f1(spark, d):
    return _markers(spark, d).select("vod_id", F.col("Start").alias("clock"), TX.clock_seconds(F.col("Start")).alias("seconds"))


@query("f2_sigmoid", T.sql("select vod_id, frame_idx, round(1 / (1 + exp(-l1 * 10)), 6) as p from logits", T.LOGITS))
def f2(spark, d):
    return X.logits(spark, d).select("vod_id", "frame_idx", F.round(C.sigmoid(F.col("logits")[0] * 10), 6).alias("p"))


@query("f3_softmax", T.sql("select vod_id, frame_idx, round(exp(l2 - m) / (exp(l1 - m) + exp(l2 - m) + exp(l3 - m) + exp(l4 - m)), 6) as p from (select *, greatest(l1, l2, l3, l4) as m from logits)", T.LOGITS))
def f3(spark, d):
    return X.logits(spark, d).select("vod_id", "frame_idx", F.round(C.softmax_class("logits", 1), 6).alias("p"))


@query("f4_semitones", T.sql("select vod_id, frame_idx, round(12 * log2(greatest(prob * 400, 1) / 55), 6) as st from frames", T.FRAMES))
def f4(spark, d):
    return X.frames(spark, d).select("vod_id", "frame_idx", F.round(12 * F.log2(F.greatest(F.col("prob") * 400, F.lit(1.0)) / 55), 6).alias("st"))


@query("f5_decibels", T.sql("select vod_id, frame_idx, round(20 * log10(prob + 1e-8::double), 6) as db, round(pow(10, (prob - 0.5) / 20), 6) as gain from frames", T.FRAMES))
def f5(spark, d):
    p = F.col("prob")
    return X.frames(spark, d).select("vod_id", "frame_idx", F.round(20 * F.log10(p + 1e-8), 6).alias("db"), F.round(F.pow(F.lit(10.0), (p - 0.5) / 20), 6).alias("gain"))


@query("f6_iou", T.sql('select p.vod_id, p.seg_no, t.start as ts, case when greatest(p."end", t."end") - least(p.start, t.start) > 0 then greatest(0, least(p."end", t."end") - greatest(p.start, t.start)) / (greatest(p."end", t."end") - least(p.start, t.start)) else 0 end as iou from pred p join truth t on p.vod_id = t.vod_id', *EVENTS))
def f6(spark, d):
    p, t = _pred_true(spark, d)
    x = p.select("vod_id", "seg_no", "start", "end").join(t.select("vod_id", F.col("start").alias("ts"), F.col("end").alias("te")), "vod_id")
    return x.select("vod_id", "seg_no", "ts", M.iou(F.col("start"), F.col("end"), F.col("ts"), F.col("te")).alias("iou"))


@query("f7_truncate", T.sql("select vod_id, frame_idx, trunc(round(frame_idx / 3.125::double, 2) * 3.125::double)::int as back from frames", T.FRAMES))
def f7(spark, d):
    return X.frames(spark, d).select("vod_id", "frame_idx", (F.round(F.col("frame_idx") / F.lit(3.125), 2) * 3.125).cast("int").alias("back"))


@query("f8_round_half_even", T.sql("select vod_id, frame_idx, round_even(frame_idx * 0.5::double, 0)::int as near from frames", T.FRAMES))
def f8(spark, d):
    return X.frames(spark, d).select("vod_id", "frame_idx", F.rint(F.col("frame_idx") * 0.5).cast("int").alias("near"))


@query("f9_clamp", T.sql("select vod_id, frame_idx, least(150, greatest(0, frame_idx - 20)) as at from frames", T.FRAMES))
def f9(spark, d):
    return X.frames(spark, d).select("vod_id", "frame_idx", F.least(F.lit(150), F.greatest(F.lit(0), F.col("frame_idx") - 20)).alias("at"))


URLS = "select page_id, case page_id % 3 when 0 then 'https://x.example/video/BV' || lpad(page_id::varchar, 10, '0') || '?' || replace(url, 'page=', 'p=') when 1 then 'AV' || page_id || '?p=' || (page_id % 9 + 1) else url end as address from pages"


def _urls(spark, d):
    p, u = F.col("page_id"), F.replace(F.col("url"), F.lit("page="), F.lit("p="))
    bv = F.concat(F.lit("https://x.example/video/BV"), F.lpad(p.cast("string"), 10, "0"), F.lit("?"), u)
    av = F.concat(F.lit("AV"), p.cast("string"), F.lit("?p="), (p % 9 + 1).cast("string"))
    return X.table(spark, d, "pages").select("page_id", F.when(p % 3 == 0, bv).when(p % 3 == 1, av).otherwise(F.col("url")).alias("address"))


@query("f10_recording_id", f"select page_id, coalesce(nullif(regexp_extract(address, '(BV[0-9A-Za-z]{{10}})', 1), ''), 'av' || nullif(regexp_extract(address, '(?i)av(\\d+)', 1), '')) as id, coalesce(nullif(regexp_extract(address, '[?&]p=(\\d+)', 1), '')::int, 1) as page from ({URLS})")
def f10(spark, d):
    a = F.col("address")
    return _urls(spark, d).select("page_id", TX.recording_id(a).alias("id"), TX.page_number(a).alias("page"))


@query("f11_input_kind", f"select page_id, regexp_matches(address, '^BV[0-9A-Za-z]{{10}}$') or regexp_matches(address, '(?i)^av\\d+$') or contains(address, 'bilibili.com') or contains(address, 'b23.tv') as known from (select page_id, case page_id % 4 when 0 then 'av' || page_id when 1 then 'BV' || lpad(page_id::varchar, 10, '0') when 2 then 'https://www.bilibili.com/video/' || page_id else url end as address from pages)")
def f11(spark, d):
    p = F.col("page_id")
    a = F.when(p % 4 == 0, F.concat(F.lit("av"), p.cast("string"))).when(p % 4 == 1, F.concat(F.lit("BV"), F.lpad(p.cast("string"), 10, "0"))).when(p % 4 == 2, F.concat(F.lit("https://www.bilibili.com/video/"), p.cast("string"))).otherwise(F.col("url"))
    return X.table(spark, d, "pages").select("page_id", TX.is_address(a).alias("known"))


@query("f12_safe_name", r"""select doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(text, '[\\/:*?"<>|\s]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80), ''), 'video') as name from documents""")
def f12(spark, d):
    return X.table(spark, d, "documents").select("doc_id", TX.safe_name(F.col("text")).alias("name"))


@query("f13_clip_name", T.sql("select vod_id, seg_no, vod_id || '_song' || lpad(seg_no::varchar, greatest(2, length(seg_no::varchar))::int, '0') || '.mp4' as clip, printf('%.2f', start) as ss from pred", T.FRAMES, T.songs(), T.pred()))
def f13(spark, d):
    return S.probs_to_segments(X.frames(spark, d), CFG).select("vod_id", "seg_no", TX.clip_name(F.col("vod_id"), F.col("seg_no")).alias("clip"), F.format_string("%.2f", "start").alias("ss"))


@query("f14_path_parts", T.sql("select streamer, stem from items", T.USER_FRAMES, T.MANIFEST))
def f14(spark, d):
    path = F.concat(F.lit("/data/raw/"), F.col("streamer"), F.lit("/"), F.col("stem"), F.lit(".wav"))
    return X.manifest(spark, d).select(path.alias("path")).select(TX.streamer_of(F.col("path")).alias("streamer"), TX.stem_of(F.col("path")).alias("stem"))


@query("f15_zip_name", "select c_custkey, translate(c_name, '0123456789', '零一二三四五六七八九') as name from customer")
def f15(spark, d):
    """Names written as GBK and read as cp437."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def misread(x: pd.Series) -> pd.Series:
        return x.map(lambda s: s.encode("gbk").decode("cp437"))

    name = F.translate("c_name", "0123456789", "零一二三四五六七八九")
    return X.table(spark, d, "customer").select("c_custkey", archives.repaired_names(misread(name)).alias("name"))


@query("f16_json_fields", "select event_id, json_extract_string(props, '$.k')::int as k from events")
def f16(spark, d):
    return X.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("f17_defaults", T.sql("select stem, coalesce(nullif(case when n_frames % 3 = 0 then 0 when n_frames % 3 = 1 then null else n_frames end, 0), 1)::double as weight from items", T.USER_FRAMES, T.MANIFEST))
def f17(spark, d):
    n = F.col("n_frames")
    w = F.when(n % 3 == 0, 0.0).when(n % 3 == 2, n.cast("double"))
    return X.manifest(spark, d).select("stem", F.coalesce(F.nullif(w, F.lit(0.0)), F.lit(1.0)).alias("weight"))


#: Labels -1 to 4 by turns.
LOSS = """
select vod_id,
  round(coalesce(sum(case when y >= 0 then greatest(x, 0) - x * least(1, y) + ln(1 + exp(-abs(x))) end), 0) / greatest(count(*) filter (y >= 0), 1), 6) as binary_loss,
  round(coalesce(sum(case when y = 4 then -ln(1 - p1) when y >= 0 then -ln(case y when 0 then p0 when 1 then p1 when 2 then p2 else p3 end) end), 0) / greatest(count(*) filter (y >= 0), 1), 6) as class_loss
from (select *, exp(l1) / z as p0, exp(l2) / z as p1, exp(l3) / z as p2, exp(l4) / z as p3 from (select vod_id, frame_idx % 6 - 1 as y, l2 * 10 as x, l1, l2, l3, l4, exp(l1) + exp(l2) + exp(l3) + exp(l4) as z from logits)) group by vod_id
"""


@query("f18_loss", T.sql(LOSS, T.LOGITS))
def f18(spark, d):
    x, y = X.logits(spark, d).withColumn("label", F.col("frame_idx") % 6 - 1), F.col("label")
    return x.groupBy("vod_id").agg(F.round(losses.binary_loss(F.col("logits")[1] * 10, y), 6).alias("binary_loss"), F.round(losses.class_loss("logits", y, 4), 6).alias("class_loss"))


@query("f19_learning_rate", "select step, round(3e-4::double * least(1, (step + 1) / 500::double) * 0.5 * (1 + cos(pi() * step / 12000)), 10) as lr from range(0, 12000, 100) t(step)")
def f19(spark, d):
    return spark.range(0, 12000, 100).select(F.col("id").alias("step"), F.round(losses.learning_rate(F.col("id")), 10).alias("lr"))


@query("f20_augment")
def f20(spark, d):
    """Masks, a band limit and gain on windows of embeddings, drawn from a seed and the window's name."""
    import numpy as np

    cfg = WindowConfig(freq_mask=2, time_mask=8, bandlimit_prob=0.5, min_band=1)

    def run(key, pdf):
        out = dsp.augment(np.stack(pdf.sort_values("frame_idx").logits.to_numpy()), np.random.default_rng(int(key[0])), cfg)
        return pd.DataFrame({"vod_id": [key[0]], "n": [out.shape[0]], "mean": [float(out.mean())]})

    return X.logits(spark, d).groupBy("vod_id").applyInPandas(run, "vod_id string, n long, mean double")


@query("f21_pad", T.sql(f"select v.vod_id, i as frame_idx, i // 80 as tile, round(coalesce(f.prob, ln(1e-5::double)), 9) as value, coalesce(l.label, 0) as label from (select vod_id, unnest(range(0, (n + 79) // 80 * 80)) as i from {N}) v left join frames f on f.vod_id = v.vod_id and f.frame_idx = i left join labs l on l.vod_id = v.vod_id and l.frame_idx = i", T.FRAMES, T.LABELS))
def f21(spark, d):
    x = X.frames(spark, d).join(X.labels(spark, d), ["vod_id", "frame_idx"])
    x = S.padded_tiles(x, 80, prob=math.log(1e-5), label=0)
    return x.select("vod_id", "frame_idx", "tile", F.round("prob", 9).alias("value"), "label")


# sampling
@query("m1_weighted_choice", T.sql(f"select i, vod_id from (select i, {T.uniform(7, 'i')} as u from range(0, 2000) r(i)) join (select vod_id, (s - n_frames) / a as lo, s / a as hi from (select vod_id, n_frames::double as n_frames, sum(n_frames::double) over (order by vod_id rows unbounded preceding) as s, sum(n_frames::double) over () as a from items)) on u >= lo and u < hi", T.USER_FRAMES, T.MANIFEST))
def m1(spark, d):
    return MF.weighted_choice(X.manifest(spark, d), spark.range(2000).withColumnRenamed("id", "i"), "n_frames", 7).select("i", "vod_id")


CROPS = f"""
select vod_id, i, least(greatest(0, case when u1 < 0.5 and rs is not null then r.a + floor(u3 * greatest(r.b - r.a, 1))::bigint - 24 else floor(u4 * greatest(1, n - 48))::bigint end), greatest(0, n - 48)) as start
from (select *, rs[floor(u2 * len(rs))::int + 1] as r from (select vod_id, i, n, rs, {T.uniform(7, 'vod_id', 'i', '1')} as u1, {T.uniform(7, 'vod_id', 'i', '2')} as u2, {T.uniform(7, 'vod_id', 'i', '3')} as u3, {T.uniform(7, 'vod_id', 'i', '4')} as u4
  from (select vod_id, count(*) as n from labs group by vod_id) left join (select vod_id, list({{'a': a, 'b': b}} order by a) as rs from r group by vod_id) using (vod_id), range(0, 50) t(i)))
"""


@query("m2_balanced_crop", T.sql(CROPS, T.LABELS, T.islands("r", "labs", "label = 1")))
def m2(spark, d):
    return Y.balanced_crops(X.labels(spark, d), 48, 50).withColumn("i", F.col("i").cast("long"))


@query("m3_focus_frames", T.sql('select vod_id, trunc(start * 0.5::double)::int as a, greatest(trunc(start * 0.5::double)::int + 1, trunc("end" * 0.5::double)::int) as b from pseudo where positive', T.FEATURES, T.CANDIDATES, T.PSEUDO))
def m3(spark, d):
    x = L.pseudo_segments(X.feature_frames(spark, d), PCFG).where("positive")
    a = (F.col("start") * RATE).cast("int")
    return x.select("vod_id", a.alias("a"), F.greatest(a + 1, (F.col("end") * RATE).cast("int")).alias("b"))


@query("m4_span_sample", T.sql(f"""select vod_id, round(case when n <= 60 then start else start + u * (n - 60) end, 6) as start, least(n, 60) as length from (select vod_id, start, "end" - start as n, {T.uniform(7, 'vod_id', 'round(start * 1000)::bigint')} as u from truth)""", T.LABELS, T.truth()))
def m4(spark, d):
    return Y.span_samples(M.truth_segments(X.labels(spark, d), RATE, 90), 60).withColumn("start", F.round("start", 6))


@query("m5_crop_clip", T.sql("select vod_id, i, least(greatest(0, i * 37 - 24), greatest(0, n - 48)) as start from (select vod_id, count(*) as n from user_frames group by vod_id) cross join range(0, 4) t(i)", T.USER_FRAMES))
def m5(spark, d):
    n = X.user_frames(spark, d).groupBy("vod_id").agg(F.count("*").alias("n"))
    x = n.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("i"))
    return x.select("vod_id", "i", MF.clip_start(F.col("i") * 37 - 24, F.col("n"), 48).alias("start"))


#: Voices are the short recordings' values, music what they lack to 1.
MIX = """
select clip, label, count(*) as n, round(sum(least(1, greatest(-1, base + coalesce(more * pow(10, (db(lb) - db(lm) + gain_db) / 20), 0)))), 6) as total from (
  select *, sqrt(avg(base * base) over (partition by clip)) as lb, sqrt(avg(more * more) over (partition by clip)) as lm from (
    select clip, kind, label, gain_db, t.frame_idx, case when kind = 'voc_mismatch' then t.prob else 1 - t.prob end as base, case when kind = 'remix_other' then o.prob when kind = 'voc_mismatch' then 1 - o.prob end as more
    from picks join uf t on t.stem = target left join uf o on o.stem = other and o.frame_idx = t.frame_idx where other is null or o.stem is not null)) group by clip, label
""".replace("db(lb)", "20 * log10(lb + 1e-8::double)").replace("db(lm)", "20 * log10(lm + 1e-8::double)")


@query("m6_synthesis", T.sql(MIX, T.USER_FRAMES, T.MANIFEST, PICKS, ("uf", "select stem, frame_idx, prob from user_frames join items using (vod_id)")))
def m6(spark, d):
    x = X.user_frames(spark, d).groupBy(F.lpad("vod_id", 6, "0").alias("vod_id")).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "prob"))).alias("c"))
    stems = x.select("vod_id", F.transform("c", lambda c: c["prob"]).alias("voice"), F.transform("c", lambda c: 1 - c["prob"]).alias("music"))
    out = Y.synthesize(*_singers(spark, d), stems, 40)
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return out.select("clip", "label", F.size("samples").cast("long").alias("n"), F.round(total, 6).alias("total"))


# plug points
@query("u2_scorer", T.sql("select vod_id, frame_idx, round(1 / (1 + exp(-(l1 - 0.5 * l2 + 0.25 * l3 + 2 * l4 + 0.1))), 6) as prob from logits", T.LOGITS))
def u2(spark, d):
    scorer = C.build_scorer("linear", weights=[1.0, -0.5, 0.25, 2.0], bias=0.1)
    return C.score(X.logits(spark, d), scorer, "logits").select("vod_id", "frame_idx", F.round("prob", 6).alias("prob"))


def _signal(spark, d, f, schema):
    def run(key, pdf):
        return f(key[0], pdf.sort_values("frame_idx").prob.to_numpy() - 0.5)

    return X.frames(spark, d).groupBy("vod_id").applyInPandas(run, schema)


@query("u7_log_mel")
def u7(spark, d):

    cfg = FeatureConfig(sample_rate=800, n_fft=64, hop=16, n_mels=8, f_max=400.0)

    def f(vod, x):
        m = dsp.log_mel(x, cfg)
        return pd.DataFrame({"vod_id": vod, "mel_idx": range(len(m)), "mel": list(m)})

    return _signal(spark, d, f, "vod_id string, mel_idx int, mel array<double>")


@query("u8_yin")
def u8(spark, d):

    def f(vod, x):
        y = dsp.yin(x, 800, 5.0, 200.0, 128, 32)
        return pd.DataFrame({"vod_id": vod, "frame_idx": range(len(y)), "f0": y})

    return _signal(spark, d, f, "vod_id string, frame_idx int, f0 double")


@query("w17_framed_rms", T.sql("select vod_id, frame_idx // 16 as frame_idx, round(20 * log10(sqrt(e) + 1e-8::double), 6) as db from (select vod_id, frame_idx, avg((prob - 0.5) * (prob - 0.5)) over w as e, count(*) over w as n from frames window w as (partition by vod_id order by frame_idx rows between current row and 63 following)) where frame_idx % 16 = 0 and n = 64", T.FRAMES))
def w17(spark, d):

    def f(vod, x):
        y = dsp.frame_db(x, 64, 16)
        return pd.DataFrame({"vod_id": vod, "frame_idx": range(len(y)), "db": y})

    return _signal(spark, d, f, "vod_id string, frame_idx long, db double").withColumn("db", F.round("db", 6))
