"""Packing by non-negative least squares: combinations of up to three lengths that fill a window are enumerated, their repeat
counts solved against the histogram of lengths, rounded down, and the rest is packed greedily.

A document is its token ids and one separator. Full windows are cut off its front, each a sequence of its own; the rest of
it (under a window) is what the histogram counts, in steps of GRID tokens. What no combination takes is cut at multiples of CHUNK
tokens and fills sequences one after the other, in groups of bounded size. Pass one reads and tokenizes each text once and keeps
a CRC of each window, rest and CHUNK of the rest; CRCs of pieces are combined from those, so no ids are stored or computed twice.

Null and empty texts are a document of the separator alone. Rows that repeat a doc_id are packed each by itself; a null doc_id
stays null. No documents: no pieces. Only doc_id and text are used.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, kept, local, slices, table

WINDOW, GRID, CHUNK, SEPARATOR = 2048, 8, 32, 1
#: Pieces of a text that are put together at a time.
WORDS = 1 << 18
#: Bytes of texts that are simplified at a time, at most.
SIMPLE = 1 << 24
#: Documents of a group that is packed greedily in one task, about.
GROUP = 1_000
#: Rows of one length that one window function ranks, about.
RANKED = 20_000
VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def bytes_of(strings: pa.StringArray) -> list[bytes]:
    """The strings' UTF-8, without a Python string for each."""
    _, ends, data = strings.buffers()
    if not len(strings):
        return []
    ends = np.frombuffer(ends, np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist()
    data = data.to_pybytes() if data else b""
    return [data[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


#: Each byte in ASCII's lower case; which bytes are ASCII letters, second bytes of Latin-1's letters (U+00C0 to U+00FF, after C3) and ASCII punctuation.
SMALL = np.arange(256, dtype=np.uint8)
SMALL[ord("A") : ord("Z") + 1] += 32
LETTER, LATIN, PUNCTUATION = (np.zeros(256, bool) for _ in range(3))
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
LATIN[[i for i in range(0x80, 0xC0) if i not in (0x97, 0xB7)]] = True
PUNCTUATION[[i for i in range(0x21, 0x7F) if not chr(i).isalnum()]] = True
#: Pieces that are one word to the tokenizer, unchanged by its normalizer.
PLAIN = "^[a-zß-öø-ÿ]+$"


def simplified(texts: pa.StringArray) -> pa.StringArray:
    """Texts with the same ids, whose pieces recur more often: letters of ASCII and Latin-1 in lower case, and a space between such a letter
    and ASCII punctuation, where the tokenizer cuts too. Before a character that may be a combining mark letters stay: H and U+0331 aren't one
    character, h and U+0331 are, and the tokenizer composes before it lowers. Texts with what may be a special string stay as they are, and so do more than SIMPLE bytes, which bounds memory."""
    _, ends, data = texts.buffers()
    if not len(texts) or not data:
        return texts
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not 0 < (size := int(ends[-1] - ends[0])) <= SIMPLE:
        return texts
    old, ends = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    following = np.zeros(size, np.uint8)
    following[:-1] = old[1:]
    alone = (following < 0x80) | (following == 0xC3)
    latin = np.zeros(size, bool)
    latin[1:] = LATIN[old[1:]] & (old[:-1] == 0xC3)
    cut = (LETTER[old] | latin) & PUNCTUATION[following]
    cut[ends[1:][ends[1:] > 0] - 1] = False
    special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
    if special.any():
        stays = np.repeat(special, np.diff(ends))
        alone &= ~stays
        cut &= ~stays
    new = np.where(alone, SMALL[old], old)
    new[latin & alone & (old < 0x9F)] += 32
    at = np.flatnonzero(cut) + 1
    new, ends = np.insert(new, at, 32), (ends + np.searchsorted(at, ends)).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(new))


class Tokens:
    """Ids (little-endian unsigned 32-bit bytes) of pieces of text between ASCII white space.

    The tokenizer splits at white space before anything else, so that pieces can be tokenized one by one; simplified() makes fewer of
    them. Plain words skip the tokenizer's normalizer and patterns, which leave them as they are. Pieces are kept in two generations:
    when the new one is full it becomes the old one, from which pieces that recur return. So frequent pieces stay, and memory is
    bounded (some 200 bytes each).
    """

    LIMIT = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        bpe = Tokenizer.from_file(path)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.encode = getattr(bpe, "encode_batch_fast", bpe.encode_batch)
        # a special token cuts a text before anything else happens to it, so that pieces between such tokens are tokenized one by one
        plain = [(i, t.content) for i, t in sorted(bpe.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark = plain[0] if plain else None
        # the model alone, on words between spaces; a word ends where a token has the model's suffix
        words = Tokenizer(bpe.model)
        words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encode_words = getattr(words, "encode_batch_fast", words.encode_batch)
        suffix, known = bpe.model.end_of_word_suffix, bpe.get_vocab()
        self.last = np.zeros(max(known.values()) + 1, bool)
        self.last[[i for t, i in known.items() if suffix and t.endswith(suffix)]] = True
        self.new, self.old = {}, {}
        self.end = array("I", [SEPARATOR]).tobytes()

    def words(self, pieces: list[str], some: int = 512) -> list[bytes]:
        """Ids of each of the plain words, which go to the tokenizer by the hundreds."""
        out: list[bytes] = []
        for e in self.encode_words([" ".join(pieces[i : i + some]) for i in range(0, len(pieces), some)], add_special_tokens=False):
            found = np.array(e.ids, np.uint32)
            every, ends = found.tobytes(), (4 * np.flatnonzero(self.last[found]) + 4).tolist()
            out += [every[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        assert len(out) == len(pieces)
        return out

    def ids(self, pieces: list[bytes], some: int = 512) -> list[bytes]:
        """Of each piece by itself. Pieces without special strings go to the tokenizer by the hundreds, a special token between them."""
        odd = [i for i, p in enumerate(pieces) if not self.mark or b"<|" in p]
        out: list[bytes] = [b""] * len(pieces)
        for i, e in zip(odd, self.encode([pieces[i].decode() for i in odd], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
        if len(odd) == len(pieces):
            return out
        skip = set(odd)
        rest, (mark, text) = [i for i in range(len(pieces)) if i not in skip], self.mark
        groups = [rest[i : i + some] for i in range(0, len(rest), some)]
        for group, e in zip(groups, self.encode([text.join(pieces[i].decode() for i in g) for g in groups], add_special_tokens=False), strict=True):
            found = np.array(e.ids, np.uint32)
            every, start = found.tobytes(), 0
            for i, end in zip(group, [*(4 * np.flatnonzero(found == mark)).tolist(), len(every)], strict=True):
                out[i], start = every[start:end], end + 4
        return out

    def learn(self, pieces: list[bytes]) -> None:
        """Pieces that aren't in the new generation come into it."""
        found = list(map(self.old.get, pieces))
        self.new.update((p, v) for p, v in zip(pieces, found, strict=True) if v is not None)
        unknown = [p for p, v in zip(pieces, found, strict=True) if v is None]
        plain = pc.match_substring_regex(pa.array(unknown, pa.binary()).cast(pa.string()), PLAIN).to_pylist() if self.last.any() else [False] * len(unknown)
        some = [p for p, x in zip(unknown, plain, strict=True) if x]
        self.new.update(zip(some, self.words([p.decode() for p in some]), strict=True))
        some = [p for p, x in zip(unknown, plain, strict=True) if not x]
        self.new.update(zip(some, self.ids(some), strict=True))

    def of(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text and the separator. A piece that occurs more than once in these texts is looked up once."""
        if len(self.new) > self.LIMIT:
            self.old, self.new = self.new, {}
        cut = pc.ascii_split_whitespace(simplified(pc.fill_null(texts, "")))
        code = cut.values.dictionary_encode()
        pieces = bytes_of(code.dictionary)  # one may be empty: white space at a text's ends
        found = list(map(self.new.get, pieces))
        gaps = [i for i, v in enumerate(found) if v is None]
        self.learn([p for i in gaps if (p := pieces[i])])
        for i in gaps:
            found[i] = self.new[p] if (p := pieces[i]) else b""
        # ids of the distinct pieces one after the other, and of each text's pieces from there
        size, flat = np.fromiter(map(len, found), np.int64, len(found)) // 4, np.frombuffer(b"".join(found), np.uint32)
        start, at, ends = np.cumsum(size) - size, code.indices.to_numpy(), cut.offsets.to_numpy()
        parts, long, total = [], np.zeros(len(at) + 1, np.int64), 0
        for i in range(0, len(at), WORDS):
            some = at[i : i + WORDS]
            n = size[some]
            to = np.cumsum(n)
            if to[-1] > 16 * WORDS:  # long pieces need no index of each id
                parts.append(b"".join(map(found.__getitem__, some.tolist())))
            else:
                parts.append(flat[np.repeat(start[some] - to + n, n) + np.arange(to[-1])].tobytes())
            long[i + 1 : i + 1 + len(some)] = total + to
            total += int(to[-1])
        every, ends = memoryview(b"".join(parts)), (4 * long[ends]).tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield b"".join((every[a:b], self.end))


PLAN = "uid long, doc_id long, doc_tokens long, rest int, first_full long, crcs array<long>, rest_crc long, chunks array<long>"


def _measure(path: str, window: int):
    """Pass one: lengths and CRCs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, uid = kept(f"tokens:{path}", lambda: Tokens(path)), TaskContext.get().partitionId() << 33
        full, size, step = uid, 4 * window, 4 * CHUNK
        for b in slices(batches, "text"):
            rows: list[tuple] = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), tokens.of(b.column("text")), strict=True):
                n, view = len(ids) // 4, memoryview(ids)
                k = n // window
                rest = view[k * size :]
                rows.append((uid, doc_id, n, len(rest) // 4, full, [zlib.crc32(view[i * size : (i + 1) * size]) for i in range(k)], zlib.crc32(rest), [zlib.crc32(rest[i : i + step]) for i in range(0, len(rest), step)]))
                uid, full = uid + 1, full + k
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()))
            names = [x.split()[0] for x in PLAN.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def combinations(units: int) -> np.ndarray:
    """Rows of up to three lengths (in steps, 0 for none, largest first) that sum to the window."""
    return np.array([(a, b, units - a - b) for a in range(-(-units // 3), units + 1) for b in range(-(-(units - a) // 2), min(a, units - a) + 1)], np.int64)


def solve(counts: np.ndarray, combos: np.ndarray, rounds: int = 20_000) -> np.ndarray:
    """Non-negative least squares min |A x - counts|: A's column for a combination counts its lengths. Active set (Lawson and Hanson
    1974): the column of steepest descent enters, columns whose solution is negative leave, until no column descends by more than
    1e-9 of the longest bar. That takes some 500 rounds; the bound on them only guards against cycling."""
    h, n = counts.astype(float), len(combos)
    every = np.zeros((len(h), n))
    for slot in combos.T:
        some = np.flatnonzero(slot)
        np.add.at(every, (slot[some], some), 1.0)
    x, active, scale = np.zeros(n), [], max(1.0, h.max())
    for _ in range(rounds):
        gain = (h - every[:, active] @ x[active]) @ every
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-9 * scale:
            break
        active.append(j)
        while active:
            a = every[:, active]
            s = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(active)), a.T @ h)
            if (s > 0).all():
                break
            old, bad = x[active], s <= 0
            t = (old[bad] / (old[bad] - s[bad])).min()
            moved = old + t * (s - old)
            x[active] = 0.0
            stay = moved > 1e-9 * scale
            active = [c for c, k in zip(active, stay, strict=True) if k]
            x[active] = moved[stay]
        x[active] = s[: len(active)]
    return x


def assign(counts: np.ndarray, units: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, end rank, place in the sequence, first sequence) for counts by length, and the number of sequences."""
    combos = combinations(units)
    x, left, used, slots, sequence = np.floor(solve(counts, combos) + 1e-6).astype(np.int64), counts.copy(), np.zeros_like(counts), [], 0
    for j in np.argsort(-x, kind="stable"):
        if x[j] <= 0:
            break
        lengths = [int(v) for v in combos[j] if v]
        n = min([int(x[j]), *(int(left[v]) // lengths.count(v) for v in lengths)])
        if n <= 0:
            continue
        for place, v in enumerate(lengths):
            slots.append((v, int(used[v]), int(used[v]) + n, place, sequence))
            used[v] += n
            left[v] -= n
        sequence += n
    return slots, sequence


@lru_cache(maxsize=4096)
def _shift(size: int) -> tuple[int, ...]:
    """The GF(2) matrix that moves a CRC past so many zero bytes, by columns."""
    op = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit

    def times(m, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v, i = v >> 1, i + 1
        return out

    total, bits = [1 << i for i in range(32)], 8 * size
    while bits:
        if bits & 1:
            total = [times(op, c) for c in total]
        op, bits = [times(op, c) for c in op], bits >> 1
    return tuple(total)


def joined_crc(a: int, b: int, size_b: int) -> int:
    """CRC-32 of two strings of bytes one after the other from theirs."""
    m, out, i = _shift(size_b), 0, 0
    while a:
        if a & 1:
            out ^= m[i]
        a, i = a >> 1, i + 1
    return out ^ b


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _greedy(window: int, base: int):
    """Fills sequences one after the other with the documents' rests, longest first, cut at multiples of CHUNK."""

    def run(key, pdf):
        import pandas as pd

        pdf, rows = pdf.sort_values(["rest", "uid"], ascending=[False, True]), []
        sequence, used = base + (int(key[0]) << 24), 0
        for doc_id, n, rest, crcs in zip(pdf.doc_id, pdf.doc_tokens, pdf.rest, pdf.chunks, strict=True):
            at = 0
            while at < rest:
                room = window - used
                length = rest - at if rest - at <= room else room // CHUNK * CHUNK
                if length:
                    crc = 0
                    for c in range(at // CHUNK, -(-(at + length) // CHUNK)):
                        size = 4 * min(CHUNK, rest - c * CHUNK)
                        crc = joined_crc(crc, int(crcs[c]), size) if c > at // CHUNK else int(crcs[c])
                    rows.append((doc_id, n - rest + at, length, crc, n, sequence, used))
                    at, used = at + length, used + length
                if at < rest:
                    sequence, used = sequence + 1, 0
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])
        return out.astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """The pieces of docs(doc_id, text)."""
    assert window % GRID == 0 and window % CHUNK == 0
    spark, units = docs.sparkSession, window // GRID
    tmp = Scratch(spark, "pack")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plan = tmp.save(texts.mapInArrow(_measure(path or vocabulary(), window), PLAN), "plan")
    whole = plan.where("doc_tokens >= %d" % window).select("doc_id", "doc_tokens", "first_full", F.posexplode("crcs").alias("k", "crc"))
    whole = whole.select("doc_id", (F.col("k") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.lit(1 << 62) + F.col("first_full") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # the histogram has at most `units` bars, whatever the input
    rests = plan.where("rest > 0").withColumn("unit", F.ceil(F.col("rest") / GRID).cast("int"))
    bars = {r.unit: r.n for r in rests.groupBy("unit").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(units + 1, np.int64)
    for u, n in bars.items():
        counts[u] = n
    slots, sequences = assign(counts, units)

    # ranks within a length: by salted groups, so that a length of many rows is no single task
    salts = max(1, sum(bars.values()) // RANKED)
    rests = rests.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    sums = rests.groupBy("unit", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("unit").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("unit", "salt", "before")
    ranked = rests.withColumn("rn", F.row_number().over(W.partitionBy("unit", "salt").orderBy("uid")) - 1).join(sums, ["unit", "salt"]).withColumn("rank", F.col("before") + F.col("rn"))
    # no more slots than three for each bar: the solution is basic
    slot = F.broadcast(local(spark, slots, "slot_unit int, lo long, hi long, place int, first long"))
    placed = ranked.join(slot, (ranked.unit == slot.slot_unit) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    placed = tmp.save(placed.select("uid", "doc_id", "doc_tokens", "rest", "rest_crc", "place", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.when(F.col("place").isNull(), F.col("chunks")).alias("chunks")), "placed")
    before = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    matched = placed.where("place is not null").select("doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", F.coalesce(F.sum("rest").over(before), F.lit(0)).cast("long").alias("offset"))

    loose = placed.where("place is null")
    groups = max(1, loose.count() // GROUP)
    loose = loose.select(F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(groups)).alias("g"), "uid", "doc_id", "doc_tokens", "rest", "chunks")
    loose = loose.groupBy("g").applyInPandas(_greedy(window, 1 << 61), PIECES)
    return whole.unionByName(matched).unionByName(loose)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline, last: the pieces of the documents that remain, each copy by itself."""
    return pack(docs)
