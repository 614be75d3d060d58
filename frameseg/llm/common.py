"""What the operators of this package share: the scratch folder, words and their hashes, graph components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

T = TypeVar("T")
#: ASCII white space as the contracts define it; bytes.split() without an argument cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where it is unset a local session, which is one machine, gets a folder
    of its own; on a cluster that is an error, as machines don't share any folder that could be made up here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir isn't set; on {master} it must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="frameseg-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_rm_local, found[7:])
    return found


def _rm_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


#: Narrow rows of a file, about.
FILE = 50_000


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's rows, sent as Arrow: from a list of tuples Spark would start Python workers that only copy them, and
    a daemon of their own on each executor."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], fields), schema)


class Scratch:
    """Written tables below the shared folder. They cut lineage and outlive executors; drop() removes them early, and what is left goes
    when the process ends. An operator whose result is small saves it and drops all else (only())."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base, self.names = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}", set()
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """rows: how many narrow rows the table has at most; they make as few files as these need, without another shuffle."""
        self.names.add(name)
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE)))
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def only(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Saves a table and drops all others."""
        out = self.save(df, name, rows)
        self.drop(*(self.names - {name}))
        return out

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)
        self.names -= set(names)

    def _end(self) -> None:
        if not self.names or self.spark.sparkContext._jsc is None:  # the session has ended
            return
        try:
            self.drop(*self.names)
        except (OSError, Py4JError):  # its JVM has
            pass


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """docs with every column but those of `used` under a name that no operator uses, in the same order."""
    return docs.toDF(*(c if c in used else f"_user{i}" for i, c in enumerate(docs.columns)))


def restored(out: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of docs, under their names, of what has been made from aside(docs, *used)."""
    return out.select(*(F.col(c if c in used else f"_user{i}").alias(c) for i, c in enumerate(docs.columns)))


_kept: list = [None, None]


def kept(name: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task under this name. A worker serves all stages in turn, and keeps the last one's alone."""
    if _kept[0] != name:
        _forget()
        _kept[:] = [name, make()]
    return _kept[1]


def _forget() -> None:
    _kept[:] = [None, None]
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)  # freed memory goes back, where the C library knows how


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a Python worker gives its caches and Arrow's memory back: a stage with two such functions has twice the workers, and idle
    ones count for their executor for another minute."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _forget()
        pa.default_memory_pool().release_unused()

    return tidied


class WordHash(dict):
    """64-bit hashes of words (bytes), kept while there is room."""

    def __init__(self, limit: int = 150_000, strip: bytes = b""):
        super().__init__()
        self.limit, self.strip = limit, strip

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.strip(self.strip) or word if self.strip else word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about so many bytes of one column: Python's memory stays bounded whatever the rows' length."""
    for b in batches:
        if not b.num_rows:
            continue
        per_row = max(1, b.column(column).nbytes // b.num_rows)
        step = max(1, chars // per_row)
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


#: Rows of a part of running(), about.
RUN = 200_000


def running(scratch: Scratch, df: DataFrame, name: str, order: list[Column], part: int = RUN, **sums: Column) -> DataFrame:
    """df with a column for each of the sums (of whole numbers): its total over all rows before this one, null-free, in an order without ties.

    Rows are dealt by ranges of the order and written; the driver adds up a row a range, and windows stay inside ranges.
    """
    values = {f"_{k}": v for k, v in sums.items()}
    parts = max(1, -(-df.count() // part))
    dealt = scratch.save(df.withColumns(values).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)
    offsets, at = [], dict.fromkeys(values, 0)
    for r in sorted(dealt.groupBy("_part").agg(*(F.sum(v).alias(v) for v in values)).collect()):
        offsets.append((r["_part"], *at.values()))
        at = {v: n + r[v] for v, n in at.items()}
    before = local(dealt.sparkSession, offsets, "_part int" + "".join(f", {v}_before long" for v in values))
    w = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(before), "_part")  # a row a range
    return out.withColumns({k: F.col(f"_{k}_before") + F.coalesce(F.sum(f"_{k}").over(w), F.lit(0)) for k in sums}).select(*df.columns, *sums)


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component_id) of every vertex of edges(a, b): the smallest id that links reach.

    Each round hooks every vertex to its smallest neighbour and contracts the edges, so that what is left at
    least halves; a vertex follows the chain of hooks by one join a round. Rounds are written tables.
    """
    e = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-e0")
    label, k, left = None, 0, e.count()
    vertices = 2 * left
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        if label is None:
            new = hook.select(F.col("v").alias("id"), F.col("p").alias("label"))
        else:
            new = label.join(hook, label.label == hook.v, "left").select("id", F.coalesce("p", "label").alias("label"))
        new = scratch.save(new, f"{name}-m{k + 1}", vertices)
        hook = new.select(F.col("id").alias("v"), F.col("label").alias("p")) if label is None else hook
        ha, hb = hook.select(F.col("v").alias("a"), F.col("p").alias("pa")), hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        rest = e.join(ha, "a").join(hb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        rest = scratch.save(rest, f"{name}-e{k + 1}", left)
        scratch.drop(f"{name}-e{k}", *([f"{name}-m{k}"] if k else []))
        label, e, k, left = new, rest, k + 1, rest.count()
        if not left:
            return label.select("id", F.col("label").alias("component_id"))
