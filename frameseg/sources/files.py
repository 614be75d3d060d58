"""Files of any kind in a folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset a local session, which is one machine, gets one of its own; a cluster is told."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir isn't set; on {master} it must name a folder that all machines share")
        made = tempfile.mkdtemp(prefix="frameseg-")
        atexit.register(shutil.rmtree, made, True)
        root = f"file://{made}"
    return f"{root}/{what}-{uuid.uuid4().hex}"


def write_files(files: DataFrame, folder: str) -> int:
    """Writes files(name, content) below a folder and returns their number. A file appears under its name when it is complete, so that a
    repeated task leaves what the first one would have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                at = f"{root}/{name}"
                store.create_dir(at.rpartition("/")[0], recursive=True)
                draft = f"{at.rpartition('/')[0]}/_{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                store.move(draft, at)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    return files.selectExpr("name", "cast(content as binary) as content").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
