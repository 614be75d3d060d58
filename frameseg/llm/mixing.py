"""Mixing sources to target weights: tokens are summed by source, repetition rates derived, and each document is taken
floor(rate) times plus one hash-seeded Bernoulli copy with the fraction as its probability.

Sources by code point, null last as a source of its own, weigh 5, 2, 1 in turn. A target stops at CAP times its source's
size and the excess is shared anew by weight: target = min(cap, level * weight) at the one level where targets sum to the
total. Null, empty and wordless texts have size 0; if all are, every target is 0. Rows that repeat a doc_id draw alike.
A null doc_id draws as the text 'null'. No documents: no rows. The query reads doc_id, source and text alone; the stage passes
every other column through, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, aside, restored, running, table

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"
#: Up to so many sources the targets (some 50 bytes each) are broadcast; beyond, the join is left to the planner.
BROADCAST_SOURCES = 20_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target, rate from rows (source, size). A row for each source; sources too are dealt to tasks, by ranges."""
    tmp, source = Scratch(sized.sparkSession, "targets"), F.col("source").asc_nulls_last()
    s = tmp.save(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    s = running(tmp, s, "named", [source], rank=F.lit(1))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")).withColumn("cap", CAP * F.col("source_size"))
    # sources fill up in the order of cap / weight; a level is what is left to share when those before are full
    s = running(tmp, s, "filled", [F.col("cap") / F.col("w"), source], full=F.col("cap"), filled_w=F.col("w"))
    every = s.agg(F.sum("source_size").alias("total"), F.sum("w").alias("all_w")).first()
    s = s.withColumn("here", (F.lit(every.total) - F.col("full")) / (F.lit(every.all_w) - F.col("filled_w")))
    level = s.where(F.col("here") * F.col("w") <= F.col("cap")).agg(F.min(F.struct("full", "here"))["here"].alias("here")).first().here
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(level).cast("double") * F.col("w")))
    return tmp.only(s.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")), "targets")


def copies(rate: Column, doc_id: Column) -> Column:
    """floor(rate), and one more where the document's hash, seen as a number in [0, 1), is below the fraction."""
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{SEED}"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _with_targets(docs: DataFrame, t: DataFrame) -> DataFrame:
    t = t.withColumnRenamed("source", "_source")
    t = F.broadcast(t) if t.count() <= BROADCAST_SOURCES else t
    return docs.join(t, docs.source.eqNullSafe(t["_source"]), "left").drop("_source")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "mix")
    sized = tmp.save(table(spark, sf_dir, "documents").select("doc_id", "source", n_words().alias("size")), "sized")
    x = _with_targets(sized, targets(sized))
    return x.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("doc_id"))).alias("taken"))


SQL = rf"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from d group by source
), t as (
  select *, {CAP} * source_size as cap, sum(source_size) over () as total from s
), f as (
  select *, coalesce(sum(cap) over (order by cap::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as filled,
         sum(w) over (order by cap::double / w, source nulls last rows between current row and unbounded following) as open_w from t
), h as (
  select *, (total - filled)::double / open_w as here from f
), l as (
  select *, (select arg_min(here, filled) from h where here * w <= cap) as level from h
), r as (
  select source, source_size, least(cap::double, level * w) as target from l
)
select doc_id, size, source_size, target,
       size * (floor(rate) + case when ('0x' || md5(coalesce(doc_id::varchar, 'null') || ':{SEED}')[1:13])::bigint::double / {1 << 52}::double < rate - floor(rate) then 1 else 0 end)::bigint as taken
from (select d.doc_id, d.size, r.source_size, r.target, case when r.source_size > 0 then r.target / r.source_size else 0.0 end as rate
      from d join r on d.source is not distinct from r.source)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: each document as many times as the mix takes it."""
    used = ("doc_id", "source", "text")
    sized = docs.select("source", n_words().alias("size"))
    x = _with_targets(aside(docs, *used), targets(sized))
    n = copies(F.col("rate"), F.col("doc_id"))
    return restored(x.where(n > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), n))), docs, *used)
