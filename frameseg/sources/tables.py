"""Marker lists, manifests and segment files as DataFrames and as files, and caches of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clock_seconds, clock_text, stem_of, streamer_of
from ..schemas import MANIFEST
from .files import write_files


def markers(raw: DataFrame) -> DataFrame:
    """Spans in seconds of markers(vod_id, Name, Start, Duration); those without length go."""
    s, d = clock_seconds(F.col("Start")), clock_seconds(F.col("Duration"))
    return raw.select("vod_id", s.alias("start"), (s + d).alias("end"), d.alias("_d")).where("_d > 0").drop("_d")


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated marker files; the file's stem is the recording."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    return markers(raw.withColumn("vod_id", stem_of(F.input_file_name())))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Accepted spans of segment files."""
    x = spark.read.schema("start double, end double, positive boolean").option("multiLine", True).json(path)
    return x.where("positive").select(stem_of(F.input_file_name()).alias("vod_id"), "start", "end")


def listing(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """streamer, stem, path of files below a folder, without their contents."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return x.select(streamer_of(F.col("path")).alias("streamer"), stem_of(F.col("path")).alias("stem"), "path", "length")


def missing(wanted: DataFrame, cache: DataFrame, *key: str) -> DataFrame:
    return wanted.join(cache.select(*key).distinct(), list(key), "left_anti")


def write_markers(spans: DataFrame, folder: str) -> int:
    """A marker file <vod_id>.csv for each recording of spans (vod_id, start, end): tab-separated, with a byte order mark."""
    row = F.concat_ws("\t", F.format_string("Marker %02d", F.col("n")), clock_text(F.col("start")), clock_text(F.col("end") - F.col("start")))
    numbered = spans.groupBy("vod_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s")).select("vod_id", F.posexplode("s").alias("n", "s"))
    rows = numbered.select("vod_id", (F.col("n") + 1).alias("n"), "s.start", "s.end").select("vod_id", F.struct("n", row.alias("row")).alias("r"))
    text = F.concat(F.lit("\ufeffName\tStart\tDuration\n"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]), "\n"), F.lit("\n"))
    return write_files(rows.groupBy("vod_id").agg(text.alias("content")).select(F.concat("vod_id", F.lit(".csv")).alias("name"), "content"), folder)


def write_manifest(items: DataFrame, folder: str, name: str = "manifest") -> int:
    """Items as JSON lists, a file for each partition; null fields are left out."""
    listed = items.select(F.to_json(F.struct(*items.columns)).alias("j"), F.spark_partition_id().alias("p")).groupBy("p").agg(F.array_join(F.array_sort(F.collect_list("j")), ",\n").alias("j"))
    return write_files(listed.select(F.format_string(f"{name}-%05d.json", "p").alias("name"), F.concat(F.lit("["), "j", F.lit("]")).alias("content")), folder)


def write_segments(spans: DataFrame, folder: str) -> int:
    """A segment file <vod_id>.json for each recording: a list of its rows, by start."""
    fields = F.struct("start", *(c for c in spans.columns if c not in ("vod_id", "start")))
    listed = spans.groupBy("vod_id").agg(F.to_json(F.array_sort(F.collect_list(fields))).alias("content"))
    return write_files(listed.select(F.concat("vod_id", F.lit(".json")).alias("name"), "content"), folder)


def cache_missing(wanted: DataFrame, compute, path: str, *key: str) -> DataFrame:
    """Adds to the Parquet cache at `path` what compute() makes of the wanted rows whose key it lacks, and returns the cache."""
    spark = wanted.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    todo = missing(wanted, spark.read.parquet(path), *key) if there else wanted
    compute(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)
