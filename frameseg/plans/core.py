"""Queries of the segmentation algebra: predicates, sequence operators, segments, metrics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import labelling as L
from ..operators import manifests as MF
from ..operators import metrics as M
from ..operators import scoring as C
from ..operators import sequence as S
from . import sqltext as T
from .base import CFG, PCFG, RATE, query

SEGS = 'select vod_id, seg_no, start, "end", round(greatest(0, s - 5), 2) as cut_start, round(e + 5, 2) as cut_end from pred'


@query("probs_to_segments", T.sql(SEGS, T.FRAMES, T.songs(), T.pred()))
def probs_to_segments(spark, d):
    return S.probs_to_segments(X.frames(spark, d), CFG)


@query("probs_to_segments_user", T.sql('select vod_id, seg_no, start, "end" from pred', T.USER_FRAMES, T.songs("user_frames", 1, 0.1), T.pred(0.1)))
def probs_to_segments_user(spark, d):
    return S.probs_to_segments(X.user_frames(spark, d), replace(CFG, frame_rate=0.1)).select("vod_id", "seg_no", "start", "end")


# predicates and projections
@query("p1_threshold", T.sql("select vod_id, frame_idx from frames where prob >= 0.5::double", T.FRAMES))
def p1(spark, d):
    return X.frames(spark, d).where("prob >= 0.5D").select("vod_id", "frame_idx")


@query("p2_ignore_filter", T.sql("select vod_id, label, count(*) as n from labs where label >= 0 group by vod_id, label", T.LABELS))
def p2(spark, d):
    return X.labels(spark, d).where("label >= 0").groupBy("vod_id", "label").agg(F.count("*").alias("n"))


def _classes(spark, d):
    return X.frames(spark, d).select("vod_id", "frame_idx", (F.col("frame_idx") % 6 - 1).cast("double").alias("label"))


@query("p3_positive_class", T.sql("select vod_id, count(*) as n from (select vod_id, (frame_idx % 6 - 1)::double as label from frames) where abs(label - 1) < 0.25 group by vod_id", T.FRAMES))
def p3(spark, d):
    return _classes(spark, d).where(F.abs(F.col("label") - 1) < 0.25).groupBy("vod_id").agg(F.count("*").alias("n"))


@query("p4_candidate", T.sql("select vod_id, frame_idx from feats where voc_db > -38 and acc_db > -45", T.FEATURES))
def p4(spark, d):
    return X.feature_frames(spark, d).where(L.candidate(PCFG)).select("vod_id", "frame_idx")


@query("p5_min_blip", T.sql("select * from blips", T.FRAMES, T.songs()))
def p5(spark, d):
    return S.at_least(S.hysteresis_runs(S.smooth(X.frames(spark, d), 3), 0.6, 0.4), 8, RATE)


@query("p6_min_song", T.sql("select * from songs", T.FRAMES, T.songs()))
def p6(spark, d):
    return S.song_runs(X.frames(spark, d), CFG)


def _millionths(c: str):
    """As DuckDB rounds to six places: the product with a million, where F.round takes the shortest decimal."""
    return F.round(F.col(c) * 1e6) / 1e6


@query("p7_segment_quality", T.sql('select vod_id, start, "end", round(vocal_density, 6) as vocal_density, round(sustained_frac, 6) as sustained_frac, acc_db, positive from pseudo', T.FEATURES, T.CANDIDATES, T.PSEUDO))
def p7(spark, d):
    return L.pseudo_segments(X.feature_frames(spark, d), PCFG).withColumns({c: _millionths(c) for c in ("vocal_density", "sustained_frac")})


@query("p8_holdout", T.sql("select stem, streamer, case when stem in (select stem from items where vod_id::bigint % 5 = 0) then 'val' else 'train' end as split from items where stem not in ('000003', '000004')", T.USER_FRAMES, T.MANIFEST))
def p8(spark, d):
    items = X.manifest(spark, d).where(~F.col("stem").isin("000003", "000004"))
    val = items.where(F.col("vod_id").cast("long") % 5 == 0).select("stem", F.lit(True).alias("v"))
    return items.join(val, "stem", "left").select("stem", "streamer", F.when(F.col("v"), "val").otherwise("train").alias("split"))


@query("p9_existence", T.sql("select i.stem from items i where exists (select 1 from items l where l.stem = i.stem and l.n_frames % 2 = 0) and not exists (select 1 from items o where o.stem = i.stem and o.n_frames % 3 = 0)", T.USER_FRAMES, T.MANIFEST))
def p9(spark, d):
    items = X.manifest(spark, d)
    have, done = items.where("n_frames % 2 = 0").select("stem"), items.where("n_frames % 3 = 0").select("stem")
    return items.join(have, "stem", "left_semi").join(done, "stem", "left_anti").select("stem")


@query("p10_time_projection", T.sql('select vod_id, start, "end" from pred', T.FRAMES, T.songs(), T.pred()))
def p10(spark, d):
    return S.probs_to_segments(X.frames(spark, d), CFG).select("vod_id", "start", "end")


@query("p11_cut_padding", T.sql("select vod_id, seg_no, round(greatest(0, s - 5), 2) as cut_start, round(case when total is null then e + 5 else least(e + 5, total) end, 2) as cut_end from pred left join (select vod_id, count(*) / 0.5::double as total from frames where vod_id <> 'view' group by vod_id) using (vod_id)", T.FRAMES, T.songs(), T.pred()))
def p11(spark, d):
    f = X.frames(spark, d)
    total = f.where("vod_id <> 'view'").groupBy("vod_id").agg((F.count("*") / F.lit(RATE)).alias("total_s"))
    return S.probs_to_segments(f, CFG, total).select("vod_id", "seg_no", "cut_start", "cut_end")


@query("p12_class_conditional", T.sql("select vod_id, frame_idx, case when voc_db > -38 and acc_db > -45 then -1 when acc_db > -45 then 3 else 0 end as label from feats", T.FEATURES))
def p12(spark, d):
    return X.feature_frames(spark, d).select("vod_id", "frame_idx", L.base_class(PCFG, -1).alias("label"))


@query("p13_constant_label", T.sql("select vod_id, frame_idx, 0::double as label from frames", T.FRAMES))
def p13(spark, d):
    return X.frames(spark, d).select("vod_id", "frame_idx", F.lit(0.0).alias("label"))


NAMES = "select event_id, case event_id % 4 when 0 then 'voc_mismatch_' when 1 then 'remix_other_' when 2 then 'accomp_only_' else 'plain_' end || event_id as name from events"


@query("p14_synthetic_remap", f"select name, case when name like 'voc_mismatch%' or name like 'remix_other%' then 2.0::double when name like 'accomp_only%' then 3.0::double end as label from ({NAMES}) where name not like 'plain%'")
def p14(spark, d):
    e = X.table(spark, d, "events").select("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("voc_mismatch_", "remix_other_", "accomp_only_", "plain_"))), (F.col("event_id") % 4 + 1).cast("int"))
    x = e.select(F.concat(kind, F.col("event_id").cast("string")).alias("name"))
    n = F.col("name")
    label = F.when(n.startswith("voc_mismatch") | n.startswith("remix_other"), 2.0).when(n.startswith("accomp_only"), 3.0)
    return x.select("name", label.alias("label")).where("label is not null")


@query("p15_shard", T.sql("select stem from (select stem, row_number() over (order by stem) - 1 as i from items) where i % 4 = 1", T.USER_FRAMES, T.MANIFEST))
def p15(spark, d):
    x = X.manifest(spark, d).select("stem").withColumn("i", F.row_number().over(W.orderBy("stem")) - 1)
    return x.where("i % 4 = 1").select("stem")


@query("p16_alignment", T.sql("select vod_id, frame_idx, prob, label from frames join labs using (vod_id, frame_idx)", T.FRAMES, T.LABELS))
def p16(spark, d):
    return X.frames(spark, d).join(X.labels(spark, d), ["vod_id", "frame_idx"])


@query("p17_standardise", T.sql("select vod_id, frame_idx, round((prob - m) / (s + 1e-8::double), 6) as z, round((prob - m) / (s + 1e-8::double) * (s + 1e-8::double) + m, 6) as back from (select *, avg(prob) over w as m, stddev_samp(prob) over w as s from frames window w as (partition by vod_id, frame_idx // 64))", T.FRAMES))
def p17(spark, d):
    x = S.standardise(X.frames(spark, d), 64)
    return x.select("vod_id", "frame_idx", F.round("z", 6).alias("z"), F.round(F.col("z") * F.col("scale") + F.col("mean"), 6).alias("back"))


# sequence operators
@query("w1_median_smooth", T.sql("select * from smooth", T.FRAMES, T.smooth("smooth", "frames", 9)))
def w1(spark, d):
    return S.smooth(X.frames(spark, d), 9)


@query("w2_boolean_vote", T.sql("select vod_id, frame_idx, cand from voted", T.FEATURES, T.VOTED))
def w2(spark, d):
    x = X.feature_frames(spark, d).withColumn("cand", L.candidate(PCFG))
    return S.vote(x, 9, "cand").select("vod_id", "frame_idx", "cand")


@query("w3_hysteresis_mask", T.sql("select f.vod_id, f.frame_idx, h.a is not null as active from frames f left join hyst h on f.vod_id = h.vod_id and f.frame_idx >= h.a and f.frame_idx < h.b", T.FRAMES, T.hysteresis("hyst", "frames", 0.6, 0.4)))
def w3(spark, d):
    return S.hysteresis_mask(X.frames(spark, d), 0.6, 0.4).select("vod_id", "frame_idx", "active")


@query("w4_mask_runs", T.sql("select vod_id, a, b from r", T.LABELS, T.islands("r", "labs", "label = 1")))
def w4(spark, d):
    return S.islands(X.labels(spark, d), F.col("label") == 1)


@query("w5_gap_fill", T.sql("select * from g", T.FRAMES, T.songs(), T.merge("g", "blips", 45, 0.5)))
def w5(spark, d):
    return S.merge_runs(p5(spark, d), 45, RATE)


@query("w6_song_merge", T.sql("select * from merged", T.FRAMES, T.songs()))
def w6(spark, d):
    return S.merge_runs(p5(spark, d), 90, RATE)


@query("w7_truth_merge", T.sql('select vod_id, start, "end" from truth', T.LABELS, T.truth()))
def w7(spark, d):
    return M.truth_segments(X.labels(spark, d), RATE, 90)


REFINE = """
select vod_id, case when ok then na else a end as a, case when ok then nb else b end as b from (
  select *, ca is not null and (nb - na)::double / 0.5::double >= 50 as ok from (
    select s.vod_id, s.a, s.b, ca,
      coalesce((select max(f.frame_idx) + 1 from smooth f where f.vod_id = s.vod_id and f.frame_idx >= s.a and f.frame_idx < ca and f.prob < 0.55::double), s.a) as na,
      coalesce((select min(f.frame_idx) from smooth f where f.vod_id = s.vod_id and f.frame_idx >= cb and f.frame_idx < s.b and f.prob < 0.55::double), s.b) as nb
    from songs s left join (
      select s.vod_id, s.a, min(greatest(c.a, s.a)) as ca, max(least(c.b, s.b)) as cb from songs s join cores c on c.vod_id = s.vod_id and c.a < s.b and s.a < c.b where least(c.b, s.b) - greatest(c.a, s.a) >= 2 group by s.vod_id, s.a
    ) c using (vod_id, a)))
"""


@query("w8_refine_edges", T.sql(REFINE, T.FRAMES, T.songs(), T.islands("cores", "smooth", "prob >= 0.7::double")))
def w8(spark, d):
    return S.song_runs(X.frames(spark, d), replace(CFG, refine_edges=True, core_threshold=0.7, edge_threshold=0.55))


EDGE = ("edge", "select n.vod_id, j, f.voc_db from (select vod_id, n, unnest(range(-7, n + 7)) as j from (select vod_id, count(*) as n from feats group by vod_id)) n join feats f on f.vod_id = n.vod_id and f.frame_idx = least(greatest(j, 0), n - 1)")


@query("w9_rolling_std", T.sql("select vod_id, j as frame_idx, round(s, 6) as roll_std from (select vod_id, j, stddev_pop(voc_db) over (partition by vod_id order by j rows between 7 preceding and 7 following) as s, count(*) over (partition by vod_id) - 14 as n from edge) where j >= 0 and j < n", T.FEATURES, EDGE))
def w9(spark, d):
    return S.rolling_std(X.feature_frames(spark, d).drop("roll_std"), "voc_db").select("vod_id", "frame_idx", F.round("roll_std", 6).alias("roll_std"))


@query("w10_ranking_split", T.sql("select stem, case when row_number() over (order by n_frames desc, stem) - 1 in (1, 3) then 'val' else 'train' end as split from items", T.USER_FRAMES, T.MANIFEST))
def w10(spark, d):
    return MF.ranked_split(X.manifest(spark, d), "n_frames").select("stem", "split")


@query("w11_top_per_group", T.sql("select stem, streamer, case when row_number() over (partition by streamer order by n_frames desc, stem) = 1 then 'val' else 'train' end as split from items", T.USER_FRAMES, T.MANIFEST))
def w11(spark, d):
    return MF.largest_per_group_split(X.manifest(spark, d), "streamer", "n_frames").select("stem", "streamer", "split")


@query("w12_segment_numbering", T.sql("select vod_id, vod_id || '_song' || lpad(seg_no::varchar, greatest(2, length(seg_no::varchar))::int, '0') as clip from pred", T.FRAMES, T.songs(), T.pred()))
def w12(spark, d):
    x = S.probs_to_segments(X.frames(spark, d), CFG)
    return x.select("vod_id", F.format_string("%s_song%02d", "vod_id", "seg_no").alias("clip"))


@query("w13_timeline_offset", T.sql("select vod_id, coalesce(sum(n / 0.5::double + 3600) over (order by vod_id rows between unbounded preceding and 1 preceding), 0) as t_off from (select vod_id, count(*) as n from frames group by vod_id)", T.FRAMES))
def w13(spark, d):
    return S.timeline_offsets(X.frames(spark, d), RATE)


HISTORY = "select orderkey as step, round(score, 4) as score from (select o_custkey as orderkey, max(o_totalprice) / 100000 as score from orders group by o_custkey)"


def _history(spark, d):
    return X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("step")).agg(F.round(F.max("o_totalprice") / 100000, 4).alias("score"))


@query("w14_best_checkpoint", f"select step, score from (select *, max(score) over (order by step rows between unbounded preceding and 1 preceding) as m from ({HISTORY})) where m is null or score > m")
def w14(spark, d):
    return M.best_so_far(_history(spark, d), "step", "score").where("is_best").select("step", "score")


@query("w15_tiling", T.sql("select vod_id, unnest(range(0, greatest(0, n - 48) + 1, 48)) as start from (select vod_id, count(*) as n from user_frames group by vod_id)", T.USER_FRAMES))
def w15(spark, d):
    n = X.user_frames(spark, d).groupBy("vod_id").agg(F.count("*").alias("n"))
    return C.tiles(n, "n", 48).select("vod_id", "start")


CHUNKS = ("chunks", "select vod_id, c * 48 as start, least(c * 48 + 64, n) as stop, c as chunk_id from (select vod_id, n, unnest(range(0, greatest(0, ceil((n - 64) / 48::double))::int + 1)) as c from (select vod_id, count(*) as n from frames group by vod_id))")


@query("w16_overlapped_chunks", T.sql("select vod_id, chunk_id, start, stop from chunks", T.FRAMES, CHUNKS))
def w16(spark, d):
    n = X.frames(spark, d).groupBy("vod_id").agg(F.count("*").alias("n"))
    return C.chunk_starts(n, "n", 64, 16).select("vod_id", "chunk_id", "start", "stop")


@query("w18_short_pooling", T.sql("select vod_id, frame_idx, round(max(prob) over w + coalesce(sum(prob) over w, 0) / 3, 6) as pooled from frames window w as (partition by vod_id order by frame_idx rows between 1 preceding and 1 following)", T.FRAMES))
def w18(spark, d):
    return S.short_pool(X.frames(spark, d)).select("vod_id", "frame_idx", F.round("pooled", 6).alias("pooled"))


@query("w19_overlap_trim", T.sql("select vod_id, chunk_id, start + k as frame_idx from (select vod_id, chunk_id, start, stop, unnest(range(0, stop - start)) as k from chunks) where k >= least(start, 16)", T.FRAMES, CHUNKS))
def w19(spark, d):
    return C.trimmed(w16(spark, d), 16)


@query("w16_sample_chunks", T.sql("select vod_id, c as chunk_id, c * 5700 as start, trunc(c * 5700 / 320::double / 16)::int as first_frame from (select vod_id, unnest(range(0, greatest(0, ceil((n * 16 * 320 - 6000) / 5700::double))::int + 1)) as c, n * 16 * 320 as n from (select vod_id, count(*) as n from frames group by vod_id)) where least(c * 5700 + 6000, n) - c * 5700 >= 1024", T.FRAMES))
def w16_samples(spark, d):
    """Chunks in samples: their first output frames are cut to whole numbers."""
    n = X.frames(spark, d).groupBy("vod_id").agg((F.count("*") * 16 * 320).alias("n"))
    return C.sample_chunks(n, "n", 6000, 300, 16 * 320, 1024).select("vod_id", "chunk_id", F.col("start").cast("long").alias("start"), "first_frame")


# joins
@query("j1_position_join", T.sql("select vod_id, count(*) as n, count(*) filter (prob >= 0.5::double and label = 1) as both from frames join labs using (vod_id, frame_idx) group by vod_id", T.FRAMES, T.LABELS))
def j1(spark, d):
    x = X.frames(spark, d).join(X.labels(spark, d), ["vod_id", "frame_idx"])
    return x.groupBy("vod_id").agg(F.count("*").alias("n"), F.count_if((F.col("prob") >= 0.5) & (F.col("label") == 1)).alias("both"))


EVENTS = (T.FRAMES, T.LABELS, T.songs(), T.pred(), T.truth(), T.MATCHED)


def _pred_true(spark, d):
    return S.probs_to_segments(X.frames(spark, d), CFG), M.truth_segments(X.labels(spark, d), RATE, 90)


@query("j2_overlap_match", T.sql("select vod_id, ps, pe, ts, te, iou from matched", *EVENTS))
def j2(spark, d):
    return M.match_join(*_pred_true(spark, d))


@query("j3_rasterise", T.sql('select f.vod_id, f.frame_idx, max(case when t.start is null then 0 else 1 end) as inside from frames f left join truth t on t.vod_id = f.vod_id and f.frame_idx >= greatest(0, trunc(t.start * 0.5::double)::int) and f.frame_idx < trunc(t."end" * 0.5::double)::int group by f.vod_id, f.frame_idx', T.FRAMES, T.LABELS, T.truth()))
def j3(spark, d):
    return S.rasterise(X.frames(spark, d).select("vod_id", "frame_idx"), M.truth_segments(X.labels(spark, d), RATE, 90), RATE)


@query("j3_rasterise_half_even", T.sql("""select f.vod_id, f.frame_idx, max(case when t.start is null then 0 else 1 end) as inside from frames f left join truth t on t.vod_id = f.vod_id and f.frame_idx >= greatest(0, round_even((t.start + 1) * 0.5::double, 0)::int) and f.frame_idx < round_even((t."end" + 1) * 0.5::double, 0)::int group by f.vod_id, f.frame_idx""", T.FRAMES, T.LABELS, T.truth()))
def j3_half_even(spark, d):
    t = M.truth_segments(X.labels(spark, d), RATE, 90).select("vod_id", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"))
    return S.rasterise(X.frames(spark, d).select("vod_id", "frame_idx"), t, RATE, half_even=True)


@query("j4_stem_join", T.sql("select a.streamer, a.stem, a.n_frames, b.n_frames as n_label from items a join (select * from items where n_frames % 2 = 0) b on a.streamer = b.streamer and a.stem = b.stem", T.USER_FRAMES, T.MANIFEST))
def j4(spark, d):
    m = X.manifest(spark, d).drop("vod_id")
    return m.join(m.where("n_frames % 2 = 0").withColumnRenamed("n_frames", "n_label"), ["streamer", "stem"])


@query("j5_focus_list", T.sql("""select vod_id, f as focus from (select vod_id from frames group by vod_id) left join (select vod_id, string_agg(start::bigint || '-' || "end"::bigint, ',' order by start) as f from pseudo where positive group by vod_id) using (vod_id)""", T.FRAMES, T.FEATURES, T.CANDIDATES, T.PSEUDO))
def j5(spark, d):
    x = MF.with_focus(X.frames(spark, d).select("vod_id").distinct(), L.pseudo_segments(X.feature_frames(spark, d), PCFG))
    text = F.transform("focus", lambda s: F.concat(s["s"].cast("long").cast("string"), F.lit("-"), s["e"].cast("long").cast("string")))
    return x.select("vod_id", F.array_join(text, ",").alias("focus"))


TARGETS = """select f.vod_id, f.frame_idx, case when exists (select 1 from truth t where t.vod_id = f.vod_id and f.frame_idx >= trunc(t.start * 0.5::double)::int and f.frame_idx < trunc(t."end" * 0.5::double)::int) then 1
  when x.vod_id is null then 0 when voc_db > -38 and acc_db > -45 then -1 when acc_db > -45 then 3 else 0 end as label
  from frames f left join feats x using (vod_id, frame_idx)"""


@query("j6_target_classes", T.sql(TARGETS, T.FRAMES, T.LABELS, T.FEATURES, T.truth()))
def j6(spark, d):
    return L.target_classes(X.frames(spark, d).select("vod_id", "frame_idx"), X.feature_frames(spark, d), M.truth_segments(X.labels(spark, d), RATE, 90), PCFG).select("vod_id", "frame_idx", "label")


OTHERS = """select f.vod_id, f.frame_idx, coalesce((select max(case when f.frame_idx >= a + 4 and f.frame_idx < b - 4 then 2 end) from p where p.vod_id = f.vod_id), (select max(case when f.frame_idx >= a - 4 and f.frame_idx < b + 4 then -1 end) from p where p.vod_id = f.vod_id),
  case when voc_db > -38 and acc_db > -45 then 4 when acc_db > -45 then 3 else 0 end) as label from frames f join feats using (vod_id, frame_idx)"""


@query("j6_other_classes", T.sql(OTHERS, T.FRAMES, T.FEATURES, T.CANDIDATES, T.PSEUDO, ("p", 'select vod_id, trunc(start * 0.5::double)::int as a, trunc("end" * 0.5::double)::int as b from pseudo where positive')))
def j6_other(spark, d):
    x = X.feature_frames(spark, d)
    return L.other_classes(X.frames(spark, d).select("vod_id", "frame_idx"), x, L.pseudo_segments(x, PCFG), PCFG).select("vod_id", "frame_idx", "label")


@query("j7_domain_cross", T.sql("select stem, dom from items cross join (values ('8k'), ('fb')) t(dom) where dom = '8k' or n_frames % 2 = 0", T.USER_FRAMES, T.MANIFEST))
def j7(spark, d):
    items = X.manifest(spark, d)
    cached = items.select("stem", F.lit("8k").alias("dom")).unionByName(items.where("n_frames % 2 = 0").select("stem", F.lit("fb").alias("dom")))
    both = items.select("stem", F.explode(F.array(F.lit("8k"), F.lit("fb"))).alias("dom"))
    return both.join(cached, ["stem", "dom"], "left_semi")


GRID = MF.parameter_grid(on_threshold=[0.5, 0.6, 0.7], off_threshold=[0.3, 0.4], median_s=[6.0, 18.0], max_gap_s=[30.0, 45.0, 60.0], min_song_s=[40.0, 60.0])


def _grid_sql() -> tuple[list, str]:
    ctes, rows = [T.FRAMES, T.LABELS, T.truth(), T.smooth("sm6", "frames", 3), T.smooth("sm18", "frames", 9)], []
    for k, g in enumerate(GRID):
        p = f"g{g['median_s']:.0f}_{g['on_threshold'] * 10:.0f}_{g['off_threshold'] * 10:.0f}_{g['min_song_s']:.0f}"
        ctes.append([*T.hysteresis(f"{p}h", f"sm{g['median_s']:.0f}", g["on_threshold"], g["off_threshold"]), T.keep_long(f"{p}b", f"{p}h", 8, 0.5), T.merge(f"{p}m", f"{p}b", 90, 0.5), T.keep_long(f"{p}s", f"{p}m", g["min_song_s"], 0.5)])
        rows.append(f"select {k} as grid_idx, {g['on_threshold']}::double as on_threshold, {g['off_threshold']}::double as off_threshold, {g['median_s']}::double as median_s, {g['max_gap_s']}::double as max_gap_s, {g['min_song_s']}::double as min_song_s, (select count(*) from {p}s) as np, (select count(*) from (select round(a / 0.5::double, 2) as ps, round(b / 0.5::double, 2) as pe, vod_id from {p}s) p join truth t on t.vod_id = p.vod_id and ps < t.\"end\" and t.start < pe where (least(pe, t.\"end\") - greatest(ps, t.start)) / (greatest(pe, t.\"end\") - least(ps, t.start)) >= 0.5::double) as tp")
    ctes.append(("points", " union all ".join(rows)))
    ctes.append(("res", "select *, case when np > 0 then tp::double / np else 0 end as event_precision, case when nt > 0 then tp::double / nt else 0 end as event_recall from points, (select count(*) as nt from truth)"))
    out = "select grid_idx, on_threshold, off_threshold, median_s, max_gap_s, min_song_s, event_precision, event_recall, case when event_precision + event_recall > 0 then 2 * event_precision * event_recall / (event_precision + event_recall) else 0 end as event_f1, tp as event_tp, np - tp as event_fp, nt - tp as event_fn from res"
    return ctes, out


_CTES, _OUT = _grid_sql()


@query("j8_grid_search", T.sql(_OUT, *_CTES))
def j8(spark, d):
    return MF.grid_search(X.frames(spark, d), X.labels(spark, d), GRID, CFG)


@query("t1_top_configurations", T.sql(f"select * from ({_OUT}) order by event_f1 desc, grid_idx limit 20", *_CTES))
def t1(spark, d):
    return MF.top_configurations(j8(spark, d))


# aggregates
@query("a1_overlap_add", T.sql("select vod_id, frame_idx, round(coalesce(p, 0), 6) as prob from frames left join (select vod_id, frame_idx, sum(s) / count(s) as p from (select f.vod_id, f.frame_idx, prob + 0.001::double * chunk_id as s from frames f join chunks c on c.vod_id = f.vod_id and f.frame_idx >= c.start and f.frame_idx < c.stop) group by vod_id, frame_idx) using (vod_id, frame_idx)", T.FRAMES, CHUNKS))
def a1(spark, d):
    f = X.frames(spark, d)
    n = f.groupBy("vod_id").agg(F.count("*").alias("n"))
    x = C.in_chunks(f, n, 64, 16).select("vod_id", "frame_idx", (F.col("prob") + 0.001 * F.col("chunk_id")).alias("prob"))
    return C.overlap_add(x, f).select("vod_id", "frame_idx", F.round("prob", 6).alias("prob"))


def _scored(spark, d, mask=True):
    return M.scored(X.frames(spark, d), X.labels(spark, d), mask_ignored=mask)


@query("a2_confusion", T.sql(f"select {T.COUNTS} from scored", T.FRAMES, T.LABELS, T.SCORED))
def a2(spark, d):
    return _scored(spark, d).agg(*M.confusion())


@query("a3_frame_scores", T.sql(f"select *, case when frame_precision + frame_recall > 0 then 2 * frame_precision * frame_recall / (frame_precision + frame_recall) else 0 end as frame_f1, (tp + tn)::double / greatest(1, tp + fp + fn + tn) as frame_acc from (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 0 end as frame_precision, case when tp + fn > 0 then tp::double / (tp + fn) else 0 end as frame_recall from (select vod_id, {T.COUNTS} from scored group by vod_id))", T.FRAMES, T.LABELS, T.SCORED))
def a3(spark, d):
    return M.frame_scores(_scored(spark, d).groupBy("vod_id").agg(*M.confusion()))


@query("a4_test_scores", T.sql(f"select round(p, 4) as frame_precision, round(r, 4) as frame_recall, round(2 * p * r / greatest(1e-9::double, p + r), 4) as frame_f1 from (select tp::double / greatest(1, tp + fp) as p, tp::double / greatest(1, tp + fn) as r from (select {T.COUNTS} from (select prob >= 0.5::double as p, label >= 0.5 as t from frames join labs using (vod_id, frame_idx))))", T.FRAMES, T.LABELS))
def a4(spark, d):
    c = _scored(spark, d, False).agg(*M.confusion())
    x = c.select((F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).alias("p"), (F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))).alias("r"))
    return x.select(F.round("p", 4).alias("frame_precision"), F.round("r", 4).alias("frame_recall"), F.round(2 * F.col("p") * F.col("r") / F.greatest(F.lit(1e-9), F.col("p") + F.col("r")), 4).alias("frame_f1"))


EVENT_COLUMNS = "case when np > 0 then m::double / np else 0 end as event_precision, case when nt > 0 then m::double / nt else 0 end as event_recall, m as event_tp, np - m as event_fp, nt - m as event_fn"
F1 = "case when event_precision + event_recall > 0 then 2 * event_precision * event_recall / (event_precision + event_recall) else 0 end as event_f1"


@query("a5_event_scores", T.sql(f"select *, {F1} from (select {EVENT_COLUMNS}, round(onset, 6) as onset_mae_s, round(offs, 6) as offset_mae_s from (select (select count(*) from pred) as np, (select count(*) from truth) as nt, (select count(*) from matched) as m, (select avg(abs(ps - ts)) from matched) as onset, (select avg(abs(pe - te)) from matched) as offs))", *EVENTS))
def a5(spark, d):
    return M.event_scores(*_pred_true(spark, d)).withColumns({c: F.round(c, 6) for c in ("onset_mae_s", "offset_mae_s")})


A7 = f"select vod_id, event_precision, event_recall, event_tp, event_fp, event_fn, {F1} from (select vod_id, {EVENT_COLUMNS} from (select vod_id, coalesce(np, 0) as np, coalesce(nt, 0) as nt, coalesce(m, 0) as m from (select vod_id, count(*) as np from pred group by vod_id) full join (select vod_id, count(*) as nt from truth group by vod_id) using (vod_id) left join (select vod_id, count(*) as m from matched group by vod_id) using (vod_id)))"
MICRO = "select sum(event_tp)::bigint as event_tp, sum(event_fp)::bigint as event_fp, sum(event_fn)::bigint as event_fn from a7"


@query("a6_micro_pooling", T.sql(MICRO, *EVENTS, ("a7", A7)))
def a6(spark, d):
    return M.event_scores(*_pred_true(spark, d)).select("event_tp", "event_fp", "event_fn")


@query("a7_per_recording", T.sql("select * from a7", *EVENTS, ("a7", A7)))
def a7(spark, d):
    return M.event_scores(*_pred_true(spark, d), by=["vod_id"]).drop("onset_mae_s", "offset_mae_s")


@query("a8_model_score", T.sql(f"select 0.5::double * (2 * tp::double / (2 * tp + fp + fn)) + 0.5::double * (2 * et::double / (2 * et + ef + en)) as score from (select {T.COUNTS} from scored), (select event_tp as et, event_fp as ef, event_fn as en from micro)", *EVENTS, T.SCORED, ("a7", A7), ("micro", MICRO)))
def a8(spark, d):
    f = a2(spark, d).select((2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("ff"))
    e = a6(spark, d).select((2 * F.col("event_tp") / (2 * F.col("event_tp") + F.col("event_fp") + F.col("event_fn"))).alias("ef"))
    return f.join(e).select((0.5 * F.col("ff") + 0.5 * F.col("ef")).alias("score"))  # one row each


@query("a9_segment_density", T.sql('select vod_id, start, "end", round(vocal_density, 6) as vocal_density from pseudo', T.FEATURES, T.CANDIDATES, T.PSEUDO))
def a9(spark, d):
    return p7(spark, d).select("vod_id", "start", "end", "vocal_density")


@query("a10_conditional_mean", T.sql('select vod_id, start, "end", round(sustained_frac, 6) as sustained_frac from pseudo', T.FEATURES, T.CANDIDATES, T.PSEUDO))
def a10(spark, d):
    return p7(spark, d).select("vod_id", "start", "end", "sustained_frac")


@query("a11_segment_median", T.sql('select vod_id, start, "end", acc_db from pseudo', T.FEATURES, T.CANDIDATES, T.PSEUDO))
def a11(spark, d):
    return p7(spark, d).select("vod_id", "start", "end", "acc_db")


@query("a12_pool_mean", T.sql("select vod_id, frame_idx // 16 as frame_idx, round(avg(voc_db), 6) as voc_db, round(avg(sustained), 6) as sustained from feats group by vod_id, frame_idx // 16 having count(*) = 16", T.FEATURES))
def a12(spark, d):
    return L.pool_mean(X.feature_frames(spark, d), 16, "voc_db", "sustained").withColumns({c: F.round(c, 6) for c in ("voc_db", "sustained")})


@query("a13_label_pool", T.sql("select vod_id, frame_idx // 2 as frame_idx, case when bool_or(label = 1) then 1 when bool_or(label = -1) then -1 else 0 end as label from labs group by vod_id, frame_idx // 2 having count(*) = 2", T.LABELS))
def a13(spark, d):
    return L.pool_labels(X.labels(spark, d))


@query("a14_positive_seconds", T.sql("select vod_id, round(count(*) filter (label > 0.5) / 0.5::double, 1) as pos_seconds, round(avg(label::double), 6) as pos_frac from labs group by vod_id", T.LABELS))
def a14(spark, d):
    return X.labels(spark, d).groupBy("vod_id").agg(F.round(F.count_if(F.col("label") > 0.5) / F.lit(RATE), 1).alias("pos_seconds"), F.round(F.avg(F.col("label").cast("double")), 6).alias("pos_frac"))


@query("a15_rms_db", T.sql("select vod_id, round(20 * log10(sqrt(avg(prob * prob)) + 1e-8::double), 6) as rms_db from frames group by vod_id", T.FRAMES))
def a15(spark, d):
    return X.frames(spark, d).groupBy("vod_id").agg(F.round(20 * F.log10(F.sqrt(F.avg(F.col("prob") * F.col("prob"))) + 1e-8), 6).alias("rms_db"))


@query("a16_count_by_prefix", T.sql("select streamer, count(*) as n from items group by streamer", T.USER_FRAMES, T.MANIFEST))
def a16(spark, d):
    vod = F.concat_ws("/", "streamer", "stem")
    return X.manifest(spark, d).groupBy(F.split(vod, "/")[0].alias("streamer")).agg(F.count("*").alias("n"))


@query("a17_island_bounds", T.sql("select vod_id, min(a) as first, max(b) as last, count(*) as runs from r group by vod_id", T.LABELS, T.islands("r", "labs", "label = 1")))
def a17(spark, d):
    return w4(spark, d).groupBy("vod_id").agg(F.min("a").alias("first"), F.max("b").alias("last"), F.count("*").alias("runs"))


@query("a18_totals", T.sql("select count(distinct vod_id) as n_vods, count(*) as n_frames, round(count(*) / 0.1::double / 3600, 6) as hours from user_frames", T.USER_FRAMES))
def a18(spark, d):
    x = X.user_frames(spark, d).groupBy("vod_id").agg(F.count("*").alias("n"))
    return x.agg(F.count("*").alias("n_vods"), F.sum("n").alias("n_frames"), F.round(F.sum("n") / F.lit(0.1) / 3600, 6).alias("hours"))


@query("a20_run_timings", "select o_orderkey, floor((o_totalprice / 1000 + o_custkey) / greatest(1, o_custkey::double) * 10000 + 0.5) / 10000 as rtf from orders")
def a20(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", (F.floor((F.col("o_totalprice") / 1000 + F.col("o_custkey")) / F.greatest(F.lit(1.0), F.col("o_custkey").cast("double")) * 10000 + 0.5) / 10000).alias("rtf"))


GREEDY = """
with recursive {ctes},
p as (select vod_id, start as ps, "end" as pe, row_number() over (partition by vod_id order by start, "end") as n from pred),
t as (select vod_id, start as ts, "end" as te, row_number() over (partition by vod_id order by start, "end") as k from truth),
pairs as (select p.vod_id, n, k, ps, pe, ts, te, (least(pe, te) - greatest(ps, ts)) / (greatest(pe, te) - least(ps, ts)) as iou from p join t on p.vod_id = t.vod_id and ps < te and ts < pe),
offers as (select p.vod_id, p.n, list({{'iou': iou, 'k': k}} order by iou desc, k) filter (iou is not null) as l from p left join pairs on p.vod_id = pairs.vod_id and p.n = pairs.n group by p.vod_id, p.n),
walk as (
  select vod_id, 0::bigint as n, []::bigint[] as taken, null::bigint as won from (select distinct vod_id from p)
  union all
  select vod_id, n, case when won is null then taken else list_append(taken, won) end, won from (
    select w.vod_id, o.n, w.taken, case when list_filter(o.l, lambda x: not list_contains(w.taken, x.k))[1].iou >= 0.3::double then list_filter(o.l, lambda x: not list_contains(w.taken, x.k))[1].k end as won
    from walk w join offers o on o.vod_id = w.vod_id and o.n = w.n + 1)
)
select vod_id, ps, pe, ts, te, iou from walk join pairs using (vod_id, n) where k = won
"""


@query("u6_greedy_match", GREEDY.format(ctes=T.sql("", *EVENTS).removeprefix("with ").rstrip()))
def u6(spark, d):
    return M.match(*_pred_true(spark, d), threshold=0.3)


@query("u10_full_evaluation", T.sql("select event_tp, event_fp, event_fn from (select (select count(*) from matched) as event_tp, (select count(*) from pred) - (select count(*) from matched) as event_fp, (select count(*) from truth) - (select count(*) from matched) as event_fn)", *EVENTS))
def u10(spark, d):
    """Chunks, a score for each frame of each, overlap-add, segments, event scores."""
    f = X.frames(spark, d)
    n = f.groupBy("vod_id").agg(F.count("*").alias("n"))
    whole = C.overlap_add(C.in_chunks(f, n, 64, 16), f)
    return M.event_scores(S.probs_to_segments(whole.withColumn("prob", F.round("prob", 12)), CFG), M.truth_segments(X.labels(spark, d), RATE, 90)).select("event_tp", "event_fp", "event_fn")
