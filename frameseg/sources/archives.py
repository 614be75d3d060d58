"""ZIP archives: whole ones by the standard library, incomplete ones by walking local headers, as a Spark data source."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, name string, size long, content binary"
LOCAL, SIZE64 = b"PK\x03\x04", 0xFFFFFFFF
#: Bytes that are read at a time.
PIECE = 4 << 20


def repaired_name(raw: bytes, utf8: bool) -> str:
    """Names without the UTF-8 flag are GBK in these archives, or else what the format says, cp437."""
    if utf8:
        return raw.decode("utf-8", "replace")
    try:
        return raw.decode("gbk")
    except UnicodeDecodeError:
        return raw.decode("cp437")


def repaired_names(names):
    """Column: names that were read as cp437, put right in Arrow batches; Spark's decode has no GBK."""
    from pyspark.sql.functions import pandas_udf

    def one(s: str | None) -> str | None:
        try:
            return None if s is None else repaired_name(s.encode("cp437"), False)
        except UnicodeEncodeError:  # it wasn't
            return s

    @pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(one)

    return run(names)


def whole(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Members of a complete archive; raises if one is damaged."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if (bad := z.testzip()) is not None:
            raise zipfile.BadZipFile(f"damaged member {bad}")
        for i in z.infolist():
            if not i.is_dir():
                utf8 = bool(i.flag_bits & 0x800)
                yield (i.filename if utf8 else repaired_name(i.filename.encode("cp437"), False)), z.read(i)


class Pieces:
    """A stream that is read in pieces, of which what was read too far can be given back."""

    def __init__(self, read, size: int = PIECE):
        self.read, self.size, self.left = read, size, b""

    def more(self) -> bytes:
        out, self.left = self.left or self.read(self.size), b""
        return out

    def take(self, n: int) -> bytes | None:
        """Exactly n bytes, or None if there are fewer."""
        got, out = 0, []
        while got < n:
            piece = self.more()
            if not piece:
                return None
            out.append(piece)
            got += len(piece)
        whole = b"".join(out)
        self.left = whole[n:] + self.left
        return whole[:n]


def partial(stream) -> Iterator[tuple[str, bytes]]:
    """Members from the start up to the first one that isn't all there, of bytes or a stream with read(n). Stored and deflated members, ZIP64 sizes.
    Beyond a member's own bytes a piece is held."""
    s = Pieces((io.BytesIO(stream) if isinstance(stream, (bytes, bytearray, memoryview)) else stream).read)
    while (head := s.take(30)) and head[:4] == LOCAL:
        flags, method, _, _, crc, packed, size, n_name, n_extra = struct.unpack_from("<6xHHHHIIIHH", head)
        name, extra = s.take(n_name), s.take(n_extra)
        if name is None or extra is None:
            return
        k, long_sizes = 0, False
        while k + 4 <= len(extra):
            tag, length = struct.unpack_from("<HH", extra, k)
            if tag == 1:
                values, long_sizes = list(struct.unpack_from(f"<{length // 8}Q", extra, k + 4)), True
                size = values.pop(0) if size == SIZE64 and values else size
                packed = values.pop(0) if packed == SIZE64 and values else packed
            k += 4 + length
        if flags & 8 and not packed:  # sizes follow the data: deflate tells where it ends
            if method != 8:
                return
            d, out = zlib.decompressobj(-15), []
            while not d.eof:
                if not (piece := s.more()):
                    return
                out.append(d.decompress(piece))
            s.left, body = d.unused_data, b"".join(out)
            mark = s.take(4)
            if mark is None or s.take((20 if long_sizes else 12) - (0 if mark == b"PK\x07\x08" else 4)) is None:
                return
        else:
            raw = s.take(packed)
            body = None if raw is None else raw if method == 0 else zlib.decompress(raw, -15) if method == 8 else None
            if body is None or zlib.crc32(body) != crc or len(body) != size:
                return
        if not name.endswith(b"/"):
            yield repaired_name(name, bool(flags & 0x800)), body


class PartialZip(DataSource):
    """spark.read.format("partialzip").option("path", ...): paths or addresses of files, separated by commas; one partition each, read in pieces.
    option("done", ...) names members to pass over, so that a growing archive is read on."""

    @classmethod
    def name(cls) -> str:
        return "partialzip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.done = set(filter(None, options.get("done", "").split(",")))

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        from pyarrow import fs

        uri = partition.value
        store, path = fs.FileSystem.from_uri(uri) if ":" in uri.partition("/")[0] else (fs.LocalFileSystem(), uri)
        with store.open_input_stream(path) as f:
            for name, body in partial(f):
                if name not in self.done:
                    yield path.rpartition("/")[2], name, len(body), body


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PartialZip)


def members(files: DataFrame, complete: bool = True) -> DataFrame:
    """Members of archives (path, content) as binaryFile reads them: any store that Spark reads."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                rows, held = [], 0
                for name, body in whole(content) if complete else partial(content):
                    rows.append((path.rpartition("/")[2], name, len(body), body))
                    held += len(body)
                    if held >= PIECE:
                        yield pd.DataFrame(rows, columns=["archive", "name", "size", "content"])
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "name", "size", "content"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)
