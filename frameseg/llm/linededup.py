"""Line dedup by overlapping three-line windows: consecutive lines are hashed together, windows that repeat anywhere are
found, and later occurrences go, covered positions merged.

Occurrences are ordered by doc_id (null last), then by the text's hash, then by position; the first one stays. Rows that
repeat both doc_id and text count as one document and share their fate. Texts of fewer than three lines have no window.
Windows of blank lines only are left alone. Null text stays null with 0 lines; an empty text is one blank line. No documents:
no rows. Other columns pass through whatever their names; where docs has a column n_lines or removed, the operator's own gets
underscores in front until it is free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, aside, restored, table

LINES = 3
#: Parts into which the occurrences of a window are dealt, as one window may have a third of all.
SALTS = 8


def _keyed(docs: DataFrame) -> DataFrame:
    """The document's key: doc_id and a hash of the text."""
    return docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_th", F.xxhash64("text"))


def windows(keyed: DataFrame, size: int = LINES) -> DataFrame:
    """_id, _th, pos, h1, h2: a row for each window of so many consecutive lines, by two 64-bit hashes."""
    ls = keyed.where("text is not null").select("_id", "_th", F.split("text", "\n", -1).alias("ls"))
    ls = ls.where(F.size("ls") >= size)

    def one(i):
        part = [F.get("ls", i - 1 + k) for k in range(size)]
        blank = F.length(F.trim(F.concat(*part))) == 0
        return F.when(~blank, F.struct(i.alias("pos"), F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit(7), *part).alias("h2")))

    w = ls.select("_id", "_th", F.explode(F.transform(F.sequence(F.lit(1), F.size("ls") - (size - 1)), one)).alias("w"))
    return w.where("w is not null").select("_id", "_th", "w.pos", "w.h1", "w.h2")


def covered(docs: DataFrame, size: int = LINES) -> DataFrame:
    """_id, _th, starts: for each document key the 1-based starts of windows that occurred before."""
    tmp = Scratch(docs.sparkSession, "lines")
    w = tmp.save(windows(_keyed(docs.select("doc_id", "text")), size), "windows")
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_th").alias("t"), F.col("pos").alias("p"))
    first = w.groupBy("h1", "h2").agg(F.min(order).alias("f"), F.max(order).alias("l")).where("f < l").select("h1", "h2", "f")
    # only repeated windows are copied for the salt; the occurrences stay one row each
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    later = w.withColumn("salt", F.pmod(F.xxhash64("_id", "_th", "pos"), F.lit(SALTS)).cast("int")).join(first, ["h1", "h2", "salt"]).where(~order.eqNullSafe(F.col("f")))
    return tmp.only(later.groupBy("_id", "_th").agg(F.collect_set("pos").alias("starts")), "starts")


def line_dedup(docs: DataFrame, size: int = LINES) -> DataFrame:
    """docs with text cut, and with n_lines, removed (sorted 1-based positions of the lines that went)."""
    # the same join at every size: the starts grow with the input
    starts, used = covered(docs, size).withColumnRenamed("_id", "_ci").withColumnRenamed("_th", "_ct").hint("merge"), ("doc_id", "text")
    k = _keyed(aside(docs, *used))
    x = k.join(starts, k._id.eqNullSafe(F.col("_ci")) & (k._th == F.col("_ct")), "left")
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (size - 1))))))
    x = x.withColumn("_gone", F.coalesce(gone, F.expr("array()").cast("array<int>")))
    ls = F.split("text", "\n", -1)
    # lines that stay, by their positions; texts without repeats are not split
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(ls)), F.col("_gone")), lambda i: F.get(ls, i - 1)), "\n")
    x = x.withColumn("_n", F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)))
    x = x.withColumn("text", F.when(F.size("_gone") > 0, kept).otherwise(F.col("text")))
    own = [F.col(c if c in used else f"_user{i}").alias(c) for i, c in enumerate(docs.columns)]
    return x.select(*own, F.col("_n").alias(free(docs, "n_lines")), F.col("_gone").alias(free(docs, "removed")))


def free(docs: DataFrame, name: str) -> str:
    """The name, with underscores in front until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (positions as text, for comparison), text."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), "text")


SQL = """
with l as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos
  from documents where text is not null
), w as (
  select doc_id, pos, line as a, lead(line, 1) over d as b, lead(line, 2) over d as c from l window d as (partition by doc_id order by pos)
), o as (
  select doc_id, pos, row_number() over (partition by a, b, c order by doc_id, pos) as nth
  from w where c is not null and length(trim(a || b || c)) > 0
), gone as (
  select distinct doc_id, pos + k as pos from o, (values (0), (1), (2)) t(k) where nth > 1
), r as (
  select l.doc_id, count(*) as n_lines, count(gone.pos) as n_removed,
         coalesce(string_agg(l.pos, ',' order by l.pos) filter (gone.pos is not null), '') as removed,
         coalesce(string_agg(l.line, chr(10) order by l.pos) filter (gone.pos is null), '') as text
  from l left join gone on l.doc_id = gone.doc_id and l.pos = gone.pos group by l.doc_id
)
select d.doc_id, coalesce(r.n_lines, 0) as n_lines, coalesce(r.n_removed, 0) as n_removed, coalesce(r.removed, '') as removed, r.text
from documents d left join r on d.doc_id = r.doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: texts lose repeated windows; n_chars, if there is such a column, follows. A document of which nothing is left goes."""
    used = ("doc_id", "text", "n_chars")
    out = line_dedup(aside(docs, *used))
    out = out.where((F.size("removed") == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return restored(out, docs, *used)
