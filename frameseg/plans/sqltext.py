"""SQL (DuckDB) of the fixtures and of the operators' shared steps, as common table expressions."""

from __future__ import annotations


def tri(idx: str, per: str) -> str:
    return f"(abs({idx} % {per} - {per} // 2)::double / ({per} // 2))"


LEVEL = "(value / (value + 34.59::double))"


def indexed(key: str) -> str:
    return f"(select {key}::varchar as vod_id, row_number() over (partition by {key} order by ts, event_id) - 1 as frame_idx, value, props from events)"


def _prob(shift: int) -> str:
    return f"select vod_id, frame_idx, 0.7::double * {tri(f'(frame_idx + {shift})', 'per')} + 0.3::double * {LEVEL} as prob from (select *, case when vod_id in ('click', 'error', 'view') then 100 else 200 end as per from {indexed('event_type')})"


FRAMES = ("frames", _prob(0))
LABELS = ("labs", f"select vod_id, frame_idx, case when prob >= 0.52::double then 1 when prob >= 0.48::double then -1 else 0 end as label from ({_prob(3)})")
USER_FRAMES = ("user_frames", f"select vod_id, frame_idx, 0.7::double * {tri('frame_idx', '20')} + 0.3::double * {LEVEL} as prob from {indexed('user_id')}")
FEATURES = ("feats", f"select vod_id, frame_idx, -60::double + 40::double * tri + 10::double * {LEVEL} as voc_db, -60::double + 30::double * tri + k / 10::double as acc_db, k / 50::double as roll_std, k / 100::double * 0.4::double * tri as sustained from (select *, {tri('frame_idx', '100')} as tri, json_extract_string(props, '$.k')::double as k from {indexed('event_type')})")
LOGITS = ("logits", "select label::varchar as vod_id, row_number() over (partition by label order by vec_id) - 1 as frame_idx, embedding[1]::double as l1, embedding[2]::double as l2, embedding[3]::double as l3, embedding[4]::double as l4 from embeddings")
MANIFEST = ("items", "select vod_id, (vod_id::bigint % 4)::varchar as streamer, lpad(vod_id, 6, '0') as stem, count(*) as n_frames from user_frames group by vod_id")


def uniform(seed: int, *parts: str) -> str:
    """operators.manifests.uniform."""
    text = " || ':' || ".join([f"'{seed}'", *(f"coalesce(({p})::varchar, 'null')" for p in parts)])
    return f"(('0x' || md5({text})[1:13])::bigint::double / {1 << 52}::double)"


def reflect(name: str, source: str, h: int) -> tuple[str, str]:
    """Rows j from -h to n + h - 1 by mirrored index."""
    return name, f"""select n.vod_id, j, f.* exclude (vod_id) from (select vod_id, n, unnest(range(-{h}, n + {h})) as j from (select vod_id, count(*) as n from {source} group by vod_id)) n
      join {source} f on f.vod_id = n.vod_id and f.frame_idx = case when ((j % (2 * n)) + 2 * n) % (2 * n) < n then ((j % (2 * n)) + 2 * n) % (2 * n) else 2 * n - 1 - ((j % (2 * n)) + 2 * n) % (2 * n) end"""


def smooth(name: str, source: str, k: int) -> list[tuple[str, str]]:
    h = k // 2
    return [reflect(f"{name}_pad", source, h), (name, f"select vod_id, j as frame_idx, m as prob from (select vod_id, j, median(prob) over (partition by vod_id order by j rows between {h} preceding and {h} following) as m, count(*) over (partition by vod_id) - {2 * h} as n from {name}_pad) where j >= 0 and j < n")]


def islands(name: str, source: str, keep: str, extra: str = "") -> tuple[str, str]:
    return name, f"""select vod_id, min(frame_idx) as a, max(frame_idx) + 1 as b{extra} from (select *, sum(case when k and not pk then 1 else 0 end) over (partition by vod_id order by frame_idx rows unbounded preceding) as i
      from (select *, k, coalesce(lag(k) over (partition by vod_id order by frame_idx), false) as pk from (select *, {keep} as k from {source}))) where k group by vod_id, i"""


def hysteresis(name: str, source: str, on: float, off: float) -> list[tuple[str, str]]:
    return [islands(f"{name}_all", source, f"prob >= {off}::double", ", max(prob) as top"), (name, f"select vod_id, a, b from {name}_all where top >= {on}::double")]


def keep_long(name: str, source: str, seconds: float, rate: float) -> tuple[str, str]:
    return name, f"select vod_id, a, b from {source} where (b - a)::double / {rate}::double >= {seconds}::double"


def merge(name: str, source: str, gap: float, rate: float) -> tuple[str, str]:
    return name, f"""select vod_id, min(a) as a, max(b) as b from (select *, sum(case when pb is null or (a - pb)::double / {rate}::double > {gap}::double then 1 else 0 end) over (partition by vod_id order by a rows unbounded preceding) as g
      from (select *, lag(b) over (partition by vod_id order by a) as pb from {source})) group by vod_id, g"""


def songs(source: str = "frames", k: int = 3, rate: float = 0.5, on: float = 0.6, off: float = 0.4, gap: float = 90, shortest: float = 50, p: str = "") -> list[tuple[str, str]]:
    """Steps from frames to runs: {p}smooth, {p}hyst, {p}blips, {p}merged, {p}songs."""
    first = smooth(f"{p}smooth", source, k) if k > 1 else [(f"{p}smooth", f"select * from {source}")]
    return [*first, *hysteresis(f"{p}hyst", f"{p}smooth", on, off), keep_long(f"{p}blips", f"{p}hyst", 8, rate), merge(f"{p}merged", f"{p}blips", gap, rate), keep_long(f"{p}songs", f"{p}merged", shortest, rate)]


def pred(rate: float = 0.5, source: str = "songs", name: str = "pred") -> tuple[str, str]:
    return name, f"select vod_id, row_number() over (partition by vod_id order by a) as seg_no, round(a / {rate}::double, 2) as start, round(b / {rate}::double, 2) as \"end\", a / {rate}::double as s, b / {rate}::double as e from {source}"


def truth(rate: float = 0.5, gap: float = 90) -> list[tuple[str, str]]:
    return [islands("truth_runs", "labs", "label >= 0.5"), ("truth_s", f"select vod_id, a / {rate}::double as a, b / {rate}::double as b from truth_runs"), merge("truth_m", "truth_s", gap, 1.0), ("truth", 'select vod_id, a as start, b as "end" from truth_m')]


MATCHED = ("matched", """select *, (least(pe, te) - greatest(ps, ts)) / (greatest(pe, te) - least(ps, ts)) as iou from (select p.vod_id, p.start as ps, p."end" as pe, t.start as ts, t."end" as te from pred p join truth t on p.vod_id = t.vod_id and p.start < t."end" and t.start < p."end")
      where (least(pe, te) - greatest(ps, ts)) / (greatest(pe, te) - least(ps, ts)) >= 0.5::double""")

SCORED = ("scored", "select vod_id, frame_idx, prob >= 0.5::double as p, label >= 0.5 as t from frames join labs using (vod_id, frame_idx) where label >= 0")
COUNTS = "count(*) filter (p and t) as tp, count(*) filter (p and not t) as fp, count(*) filter (not p and t) as fn, count(*) filter (not p and not t) as tn"
#: Candidate chain of pseudo labels at 0.5 Hz with the fixture's thresholds.
VOTED = [reflect("feats_pad", "(select *, voc_db > -38 and acc_db > -45 as cand from feats)", 4), ("voted", "select vod_id, j as frame_idx, v as cand from (select vod_id, j, sum(cand::int) over (partition by vod_id order by j rows between 4 preceding and 4 following) >= 5 as v, count(*) over (partition by vod_id) - 8 as n from feats_pad) where j >= 0 and j < n")]
CANDIDATES = [*VOTED, islands("cand_runs", "voted", "cand"), merge("cand_merged", "cand_runs", 20, 0.5), keep_long("cands", "cand_merged", 45, 0.5)]
PSEUDO = ("pseudo", """select vod_id, round(a / 0.5::double, 2) as start, round(b / 0.5::double, 2) as "end", d as vocal_density, s as sustained_frac, m as acc_db, d >= 0.4::double and s >= 0.16::double and m >= -48 as positive
      from (select c.vod_id, a, b, avg((voc_db > -38)::int::double) as d, coalesce(avg(sustained) filter (voc_db > -38), 0) as s, median(acc_db) as m from cands c join feats f on f.vod_id = c.vod_id and f.frame_idx >= a and f.frame_idx < b group by c.vod_id, a, b)""")


def sql(select: str, *ctes) -> str:
    flat: dict[str, str] = {}
    for c in ctes:
        for name, text in c if isinstance(c, list) else [c]:
            flat[name] = text
    return ("with " + ",\n".join(f"{n} as ({t})" for n, t in flat.items()) + "\n" if flat else "") + select
