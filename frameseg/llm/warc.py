"""WARC 1.1 archives compressed by Zstandard: a dictionary in the leading skippable frame, one frame for each record.

The reader takes files as spark.read.format("binaryFile") gives them, loads the dictionary, decodes frame by frame and validates
version, required headers, lengths and digests. The writer makes archives of bounded size in the shared folder. Of records with
equal payloads of at least REVISIT bytes the one with the largest page_id is a response, others are revisits that refer to it and
carry its headers but no payload; payload length and digest are of the full payload in both.

Null html is an empty payload, a null url leaves WARC-Target-URI out, a null page_id counts as smaller than any other (if all
are null, all are responses). Rows that repeat the largest page_id are responses too. White space and control characters of a url are
percent-encoded. No pages: no archives, no rows. Other columns are ignored.

The dictionary is trained on the first PREFIX characters of SAMPLE pages, which decides how well records are compressed and nothing else; records
hold whole pages.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table

#: Payloads from this size on are stored once; dictionary size and the bounded sample it is trained on.
REVISIT, DICTIONARY, SAMPLE, PREFIX, LEVEL = 1000, 32_768, 400, 8192, 3
#: Bytes of payloads that a task writes, about, and compressed bytes from which on it begins another archive.
PART, ARCHIVE = 48 << 20, 64 << 20
#: Parts into which pages of a digest are dealt for the join, as one digest may have a third of all.
SALTS = 8
#: Fixed values of the formats.
SKIPPABLE, DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x37\xa4\x30\xec", b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Upper half of the record ids of pages; the page_id is the lower half.
SPACE = 0x6672616D65736567
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def record_id(page_id: int | None, salt: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{salt}") if page_id is None else uuid.UUID(int=SPACE << 64 | page_id & (1 << 64) - 1))


def page_of(record: str) -> int | None:
    n = uuid.UUID(record).int
    low = n & (1 << 64) - 1
    return (low - (1 << 64) if low >> 63 else low) if n >> 64 == SPACE else None


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    digest = base64.b32encode(sha1).decode()
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{record_id(page_id, f'{url}:{digest}')}>",
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = "".join(quote(c) if c.isspace() or ord(c) < 33 or ord(c) == 127 else c for c in url)
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:uuid:{record_id(refers_to, '')}>", "WARC-Profile": PROFILE}
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def skippable(dictionary: bytes) -> bytes:
    """The leading frame: the dictionary, itself compressed."""
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def dictionary_of(archive: bytes | memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, raw or compressed, and where records begin."""
    if len(archive) < 8 or struct.unpack_from("<I", archive)[0] != SKIPPABLE:
        return None, 0
    size = struct.unpack_from("<I", archive, 4)[0]
    body = bytes(archive[8 : 8 + size])
    if len(body) < size:
        raise WarcError("the dictionary frame is cut short")
    if body[:4] == FRAME_MAGIC:
        body = zstandard.ZstdDecompressor().decompress(body)
    if body[:4] != DICTIONARY_MAGIC:
        raise WarcError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(body), 8 + size


def frames(archive: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of each frame."""
    view = memoryview(archive)
    dictionary, at = dictionary_of(view)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        one, out = reader.decompressobj(), []
        while not one.eof:
            chunk = view[at : at + step]
            if not len(chunk):
                raise WarcError("the last frame is cut short")
            try:
                out.append(one.decompress(chunk))
            except zstandard.ZstdError as e:
                raise WarcError(f"a frame that can't be decoded: {e}") from e
            at += len(chunk) - (len(one.unused_data) if one.eof else 0)
        yield b"".join(out)


def parse(frame: bytes) -> dict:
    """Headers, block and payload of a record; WarcError if anything is amiss."""
    head, sep, rest = frame.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != VERSION:
        raise WarcError(f"no WARC 1.1 header: {frame[:20]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"a header line without name: {line[:40]!r}")
        fields[name] = value.strip()
    if missing := [x for x in REQUIRED if x not in fields]:
        raise WarcError(f"headers missing: {missing}")
    if not fields["Content-Length"].isdigit():
        raise WarcError("Content-Length is no number")
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {size}, but the block has {len(rest) - 4} bytes")
    out = {"type": fields["WARC-Type"], "fields": fields, "payload": None, "payload_bytes": None, "digest": None}
    if fields["WARC-Type"] in ("response", "revisit"):
        http, sep, payload = rest[:size].partition(b"\r\n\r\n")
        length = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
        if not sep or length is None or not length.isdigit():
            raise WarcError("no HTTP header with a length")
        algorithm, _, digest = fields.get("WARC-Payload-Digest", "").partition(":")
        if algorithm != "sha1" or len(digest) != 32:
            raise WarcError("no SHA-1 payload digest")
        out |= {"payload_bytes": int(length), "digest": base64.b32decode(digest).hex()}
        if fields["WARC-Type"] == "response":
            if len(payload) != int(length) or hashlib.sha1(payload).hexdigest() != out["digest"]:
                raise WarcError("payload and its length or digest differ")
            out["payload"] = payload
        elif payload or "WARC-Refers-To" not in fields:
            raise WarcError("a revisit with a payload or without reference")
    return out


def write(pages: DataFrame, folder: str, dictionary: bytes | None, limit: int = ARCHIVE) -> list[str]:
    """Archives of pages(page_id, url, html, refers_to) in a shared folder; their paths.

    A task writes files under draft names and moves each to a name of its partition when it is complete. Only files that the task which
    counted has named are returned, so that lost and repeated tasks leave each record in one archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        names, out, size, draft = [], None, 0, ""

        def close():
            nonlocal out
            out.close()
            names.append(f"part-{TaskContext.get().partitionId():06d}-{len(names):04d}.warc.zst")
            store.move(draft, f"{root}/{names[-1]}")
            out = None

        for b in slices(batches, "html"):
            for page_id, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    draft, size = f"{root}/_draft-{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(draft)
                    out.write(skippable(dictionary) if dictionary else b"")
                payload = (html or "").encode()
                frame = packer.compress(record(page_id, url, payload, hashlib.sha1(payload).digest(), refers_to))
                out.write(frame)
                size += len(frame)
                if size >= limit:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    found = pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "name string").toArrow()
    return [f"{folder}/{name}" for name in found.column("name").to_pylist()]


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The response and revisit records of archives (path, content); others (warcinfo, request) are validated and passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for content in b.column("content"):
                rows, held = [], 0
                for frame in frames(content.as_py()):
                    r = parse(frame)
                    if r["payload_bytes"] is None:
                        continue
                    f = r["fields"]
                    own, other = (page_of(f[k][len("<urn:uuid:") : -1]) if k in f else None for k in ("WARC-Record-ID", "WARC-Refers-To"))
                    rows.append((own, f.get("WARC-Target-URI"), r["payload_bytes"], r["digest"], r["type"], other, r["payload"] if payloads else None))
                    held += len(frame) if payloads else 64
                    if held > 1 << 22:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.select("content").mapInArrow(run, RECORDS)


def _sample(p: DataFrame, tmp: Scratch) -> list[bytes]:
    """The starts of SAMPLE pages with the smallest hashes of their ids: ids are chosen first, then these pages' starts alone are fetched."""
    h = F.xxhash64("page_id")
    ids = p.where("page_id is not null and html <> ''").select("page_id", h.alias("h"))
    n = ids.count()
    if n > 4 * SAMPLE:
        ids = ids.where(F.col("h") < int(-(2.0**63) + 2.0**64 * 4 * SAMPLE / n))
    ids = tmp.save(ids.distinct().orderBy("h", "page_id").limit(SAMPLE).select("page_id"), "sample")
    starts = p.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.max(F.substring("html", 1, PREFIX)).alias("start"))  # SAMPLE ids of 8 bytes
    return [r.start.encode() for r in sorted(starts.collect()) if r.start]


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages(page_id, url, html) and reads the archives back: RECORDS."""
    spark = pages.sparkSession
    tmp = Scratch(spark, "warc")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    large = F.octet_length("html") >= REVISIT
    digest = F.when(large, F.sha1(F.encode("html", "UTF-8")))
    # digests of payloads that occur more than once, of which one is kept
    kept = p.select("page_id", digest.alias("digest")).where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")
    kept = tmp.save(kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "kept")
    # pages too small for a digest meet nothing: a key of their own spreads them
    row = F.xxhash64("page_id", "url", "html")
    p = p.withColumn("digest", F.coalesce(digest, F.concat(F.lit("-"), row.cast("string")))).withColumn("salt", F.pmod(row, F.lit(SALTS)).cast("int")).join(kept, ["digest", "salt"], "left")
    p = p.withColumn("refers_to", F.when(F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))).select("page_id", "url", "html", "refers_to")
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY, [record(0, "http://www.example.com/", s, b"\0" * 20, None) for s in _sample(plain, tmp)]).as_bytes()
    except zstandard.ZstdError:  # too few pages to train on
        dictionary = None
    held = plain.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("size")).first()
    # dealt in turn, after a sort that makes repeats of a task deal alike: neither a page id nor a payload can fill a task
    paths = write(p.repartition(1 + held["size"] // PART), tmp.path("archives"), dictionary)
    tmp.names.add("archives")
    if not paths:
        return spark.createDataFrame([], RECORDS)
    return read(spark.read.format("binaryFile").load(paths))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
with p as (
  select page_id, coalesce(html, '') as html from pages
), d as (
  select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as payload_digest from p
), k as (
  select payload_digest, max(page_id) as kept from d where payload_bytes >= {REVISIT} group by payload_digest
)
select d.page_id, d.payload_bytes::bigint as payload_bytes, d.payload_digest,
       case when k.kept is null or k.kept = d.page_id then 'response' else 'revisit' end as record_type,
       case when k.kept <> d.page_id then k.kept end as refers_to
from d left join k on d.payload_digest = k.payload_digest and d.payload_bytes >= {REVISIT}
"""
