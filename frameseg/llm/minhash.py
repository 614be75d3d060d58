"""MinHash near-dedup by b-bit MinHash: low bits of the minima are packed into signatures; bands give candidates,
bit counts a collision-corrected similarity, and full shingle sets the decision.

Defined results: a null or wordless text has an empty set (0 shingles) and is linked with nothing. Fewer words than
a shingle has: the whole sequence is the one shingle. Rows that repeat a doc_id stand for one vertex. A null doc_id takes no part
(component_id null, kept true). Equal sets are linked. No documents: no rows. near_duplicates() reads doc_id and text alone; the stage passes
every other column through, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, WordHash, aside, components, kept, mix, restored, slices, table, tidy

WORDS, BANDS, ROWS, BITS = 5, 32, 3, 2
LEAST = 75  # per cent of the union
#: A pair at the threshold is estimated 0.75 with a deviation of 0.053. By the binomial it comes out lower than this once in 6e7, and escapes all
#: bands once in 4e7; more similar pairs less often.
PLAUSIBLE = 0.42


def shingles(text: str | None, words: WordHash, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    w = words.of(text.encode().lower().split()) if text else np.empty(0, np.uint64)
    if not len(w):
        return w
    n, size = (1, len(w)) if len(w) < k else (len(w) - k + 1, k)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    return np.unique(h)


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def minima(sets: list[np.ndarray], n: int = BANDS * ROWS) -> np.ndarray:
    """32-bit minima, a row for each of the sets, none of which is empty."""
    mult, add = _factors(n)
    x, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), n), np.uint64)
    for j in range(n):
        out[:, j] = np.minimum.reduceat((x * mult[j] + add[j]) >> np.uint64(32), starts)
    return out


def packed(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of each minimum, in 64-bit words."""
    low, per = mins & np.uint64((1 << bits) - 1), 64 // bits
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % per)))
    shift = (np.arange(per, dtype=np.uint64) * np.uint64(bits))[None, None, :]
    return (low.reshape(len(low), -1, per) << shift).sum(2, dtype=np.uint64).view(np.int64)


def band_keys(mins: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    m, key = mins.reshape(len(mins), bands, rows), np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(mins), bands))
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
    return key.view(np.int64)


SIGNATURE = "doc_id long, n_shingles long, digest binary, sig array<long>, bands array<long>"


@tidy
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = kept("minhash", WordHash)
    for b in slices(batches, "text"):
        sets = [shingles(t, words) for t in b.column("text").to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        sig, keys = [None] * len(sets), [None] * len(sets)
        if full:
            mins = minima([sets[i] for i in full])
            for i, s, k in zip(full, packed(mins), band_keys(mins), strict=True):
                sig[i], keys[i] = s, k
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "digest", "sig", "bands"],
        )


NAMES = ["id", "c", "most", "s"]


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows sorted by s those of whole shingles, and how many there are of each one; of a shingle with more than RARE rows, RARE + 1."""
    held = np.empty((4, 0), np.int64)
    for b in batches:
        x = np.concatenate([held, np.stack([b.column(c).to_numpy() for c in NAMES])], axis=1)
        if not x.shape[1]:
            continue
        ends = np.flatnonzero(np.diff(x[3])) + 1
        nth = np.arange(x.shape[1]) - np.repeat(np.r_[0, ends], np.diff(np.r_[0, ends, x.shape[1]]))
        last = x.shape[1] - (ends[-1] if len(ends) else 0)
        whole = nth <= RARE
        whole[x.shape[1] - last :] = False
        if len(ends):
            yield x[:, whole], np.minimum(np.diff(ends, prepend=0), RARE + 1)
        held = x[:, x.shape[1] - last :][:, : RARE + 1]
    if held.shape[1]:
        yield held, np.array([held.shape[1]])


def _combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: RARE + 1 rows of a shingle at most, however many documents have it."""
    for x, _ in _runs(batches):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], NAMES)


#: Rows that a task lists before it combines them, about.
HELD = 1 << 19


@tidy
def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each document, the document's other columns beside it, combined: of a shingle a task sends RARE + 1 rows
    at most for each HELD / 2 rows that it sends.

    One function lists and combines, as each Python function of a task takes a worker of its own. Spark gives an executor's idle workers work
    in turn, so that with more of them than tasks every one fills with the caches of the stages that follow.
    """
    words, held = kept("minhash", WordHash), []
    for b in slices(batches, "text", 1 << 19):
        sets = [shingles(t, words) for t in b.column("text").to_pylist()]
        n = [len(s) for s in sets]
        held.append(pa.RecordBatch.from_arrays([*[pa.array(np.repeat(b.column(c).to_numpy(), n)) for c in NAMES[:3]], pa.array(np.concatenate(sets).view(np.int64))], NAMES))
        if _n_rows(held) >= HELD:
            held = _fewer(held)
            if _n_rows(held) > HELD // 2:
                yield from held
                held = []
    if held:
        yield from _fewer(held)


def _n_rows(held: list[pa.RecordBatch]) -> int:
    return sum(b.num_rows for b in held)


def _fewer(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return list(_combined(pa.Table.from_batches(held).sort_by("s").to_batches()))


@tidy
def _scarce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by s those of shingles with RARE rows at most, and that number as df."""
    for x, n in _runs(batches):
        df = np.repeat(n, n)
        ok = df <= RARE
        yield pa.RecordBatch.from_arrays([*[pa.array(c[ok]) for c in x], pa.array(df[ok])], [*NAMES, "df"])


@tidy
def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a document fall into each of TALLIES parts."""
    words = kept("minhash", WordHash)
    for b in slices(batches, "text", 1 << 19):
        counts = [np.bincount((shingles(t, words) % np.uint64(TALLIES)).astype(np.int64), minlength=TALLIES) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(counts, pa.list_(pa.int64()))], ["id", "tally"])


def similarity(a: str, b: str, n_words: int = BANDS * ROWS, bits: int = BITS):
    """Column: the similarity estimated from two signatures by the count of equal groups of bits, less chance collisions."""
    differ = F.lit(0)
    for i in range(-(-n_words * bits // 64)):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for s in range(1, bits):
            x = x.bitwiseOR(F.shiftright(F.col(a)[i].bitwiseXOR(F.col(b)[i]), s))
        mask = sum(1 << k for k in range(0, 63, bits))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(mask)))
    chance = 2.0**-bits
    return ((1 - differ / F.lit(float(n_words))) - chance) / (1 - chance)


@tidy
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, last, left = kept("minhash", WordHash), None, None
    for b in slices(batches, "text_a"):
        a, c, keep = b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), []
        for s, t in zip(a, c, strict=True):
            if s != last:
                last, left = s, shingles(s, words)
            right = shingles(t, words)
            both = len(np.intersect1d(left, right, assume_unique=True))
            keep.append(100 * both >= LEAST * (len(left) + len(right) - both) > 0)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))


#: Members of a bucket from which on rare shingles are looked at, and documents of a rare shingle at most.
LARGE, RARE = 32, 16
#: Members of a bucket that one task compares with the others, about.
PART = 1024
#: Parts into which the other shingles are counted: two documents have no more in common than the smaller counts' sum.
TALLIES = 64
#: Bits of the filter that keeps texts of candidates; its size bounds what is sent to each machine (16 MB).
FILTER = 1 << 27


def _candidates(tmp: Scratch, texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose doc_id is in ids, saved: most others stop at a filter of fixed size before the shuffle."""
    spark = texts.sparkSession
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER))
    maps = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    found = np.zeros(FILTER // 8, np.uint8)
    for r in maps.toLocalIterator():
        found[(r.k - 1) * len(r.bits) : r.k * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    sent = spark.sparkContext.broadcast(found)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column("p").to_numpy()
            yield b.select(["doc_id", "text"]).filter(pa.array((sent.value[p >> 3] >> (p & 7) & 1).astype(bool)))

    some = texts.where("doc_id is not null").select("doc_id", "text", place.alias("p")).mapInArrow(run, "doc_id long, text string")
    out = tmp.save(some.join(ids.hint("merge"), "doc_id").distinct(), "own")
    sent.destroy()
    return out


def _merged(tmp: Scratch, known: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """(id, component_id) after more links: components that are known already are one vertex each."""
    if known is None:
        return components(tmp, links, name)
    for x in ("a", "b"):
        links = links.join(known.select(F.col("id").alias(x), F.col("component_id").alias(f"c{x}")), x, "left").withColumn(x, F.coalesce(f"c{x}", x)).drop(f"c{x}")
    more = components(tmp, links.where("a <> b").select("a", "b"), name)
    moved = known.join(more.select(F.col("id").alias("was"), F.col("component_id").alias("now")), F.col("component_id") == F.col("was"), "left")
    alone = more.join(known.select("id"), "id", "left_anti")
    return tmp.save(moved.select("id", F.coalesce("now", "component_id").alias("component_id")).unionByName(alone), f"{name}-known", known.count() + more.count())


def _large(at: DataFrame, own: DataFrame) -> DataFrame:
    """Members of large buckets: id, component c, how many documents a rare shingle has at most, text."""
    large = at.groupBy("id").agg(F.max("size").alias("size"), F.first("c").alias("c")).where(F.col("size") >= LARGE)
    once = own.groupBy("doc_id").agg(F.count("*").alias("k"), F.first("text").alias("text")).where("k = 1")
    return once.join(large, once.doc_id == large.id).select("id", "c", F.floor(F.col("size") / 4).alias("most"), "text")


def near_duplicates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs(doc_id, text).

    Equal sets collapse to one representative first. Every bucket has two leaders, drawn by hash, so that a group of copies has many.
    Round one compares each document with the two most similar of its buckets' first leaders, round two those whose bucket still
    spans components with all its buckets' leaders, round three with every member of another component. Candidates have a plausible
    estimate; links are confirmed on the texts' full sets. In buckets of LARGE or more members a pair without a common rare shingle is
    passed over if their other shingles, counted by parts, can't overlap enough for a link; pairs with a common rare shingle are found by it, and
    such a shingle has few documents. No other plausible pair of a bucket that could join two components is left out.
    """
    assert least == LEAST, "bands are laid out for this threshold"
    tmp = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = tmp.save(texts.mapInArrow(_signatures, SIGNATURE), "sets")
    some = sets.where("doc_id is not null and digest is not null")
    reps = tmp.save(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "reps")
    n_rows, n_reps = sets.count(), reps.count()
    bands = reps.select(F.explode("bands").alias("key"), F.col("rep").alias("id"))
    draw = [F.struct(F.xxhash64("key", "id", F.lit(i)), F.col("id").alias("id")) for i in (1, 2)]
    lead = bands.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("last"), F.count("*").alias("size"), *[F.min(d)["id"].alias(f"lead{i}") for i, d in enumerate(draw, 1)])
    held = tmp.save(bands.join(lead.where("least < last").drop("least", "last"), "key"), "held", BANDS * n_reps)
    n_held = held.count()
    facts = reps.select(F.col("rep").alias("id"), "sig", "n", F.lit(None).cast("array<long>").alias("tally"))
    own = _candidates(tmp, texts, held.select(F.col("id").alias("doc_id")).distinct())

    def both(facts: DataFrame, i: str, x: str) -> DataFrame:
        return facts.select(F.col("id").alias(i), *[F.col(c).alias(c + x) for c in ("sig", "n", "tally")])

    def total(tally: Column) -> Column:
        return F.aggregate(tally, F.lit(0).cast("long"), lambda t, v: t + v)

    def possible():
        """By the estimate, and by the number of shingles that both can have."""
        overlap = total(F.zip_with("tally_a", "tally_b", lambda p, q: F.least(p, q)))
        most = F.when(F.col("tally_a").isNotNull() & F.col("tally_b").isNotNull(), overlap).otherwise(F.least("n_a", "n_b"))
        return (similarity("sig_a", "sig_b") >= PLAUSIBLE) & (100 * most >= LEAST * (F.col("n_a") + F.col("n_b") - most))

    def estimated(pairs: DataFrame, facts: DataFrame) -> DataFrame:
        """Of pairs (id, other) the possible ones, smaller id first."""
        x = pairs.join(both(facts, "id", "_a"), "id").join(both(facts, "other", "_b"), "other").where(possible())
        return x.select("id", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), similarity("sig_a", "sig_b").alias("est"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = pairs.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        x = x.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return x.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long").distinct()

    best = W.partitionBy("id").orderBy(F.desc("est"), "a", "b")
    first = estimated(held.where("id <> lead1").select("id", F.col("lead1").alias("other")).distinct(), facts)
    first = tmp.save(first.withColumn("nth", F.row_number().over(best)).where("nth <= 2").select("a", "b").distinct(), "pairs1", 2 * n_reps)
    # rows that share a doc_id are one vertex
    copies = some.join(reps.select("digest", "rep"), "digest").where("doc_id <> rep").select("doc_id", F.col("rep").alias("a"))
    several = copies.groupBy("doc_id").agg(F.min("a").alias("a"), F.max("a").alias("z"), F.collect_set("a").alias("reps")).where("a < z").select("a", F.explode("reps").alias("b")).where("a <> b")
    itself = copies.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select("a", F.col("doc_id").alias("b"))
    known = _merged(tmp, None, tmp.save(confirmed(first).unionByName(several).unionByName(itself).distinct(), "links1", 2 * n_reps + n_rows), "cc1")

    def spanning() -> DataFrame:
        """Members of buckets that span components, with their component c and the bucket's most frequent one, main."""
        at = held.join(known, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id")
        per = at.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "c"))["c"].alias("main"), F.count("*").alias("parts"))
        return at.join(per.where("parts > 1").select("key", "main"), "key")

    at = tmp.save(spanning(), "at", n_held)
    inside = tmp.save(_large(at, own), "inside")
    # a shingle is rare for a document if it has few documents, and far fewer than the document's largest bucket
    rows = "id long, c long, most long, s long"
    listed = inside.mapInArrow(_listed, rows).repartition("s").sortWithinPartitions("s")
    few = tmp.save(listed.mapInArrow(_scarce, rows + ", df long"), "few")
    rare = few.where("df <= most")
    part = F.pmod(F.col("s"), F.lit(TALLIES)).cast("int")  # the hash's low bits, signed or not
    less = rare.groupBy("id", part.alias("p")).agg(F.count("*").alias("k")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("p", "k"))).alias("less"))
    tally = inside.mapInArrow(_tallied, "id long, tally array<long>").join(less, "id", "left")
    tally = tally.select("id", F.transform("tally", lambda v, i: v - F.coalesce(F.try_element_at("less", i), F.lit(0))).alias("tally"))
    plain, facts = facts, tmp.save(facts.drop("tally").join(tally, "id", "left"), "facts", 4 * n_reps)
    by_rare = rare.where("df > 1").select("s", "id", "c").join(few.select("s", F.col("id").alias("other"), F.col("c").alias("co")), "s").where("c <> co")
    by_rare = tmp.save(estimated(by_rare.select("id", "other").distinct(), plain).select("a", "b").distinct(), "rare", n_held * RARE)
    tmp.drop("inside", "few")
    second = at.select("id", "c", F.explode(F.array("lead1", "lead2")).alias("other")).where("id <> other").distinct()
    label = known.select(F.col("id").alias("other"), F.col("component_id").alias("co"))
    second = second.join(label, "other", "left").where("c <> coalesce(co, other)").select("id", "other")
    second = tmp.save(estimated(second, facts).select("a", "b").distinct().join(first, ["a", "b"], "left_anti"), "pairs2", 2 * n_held)
    if n := second.count():
        known = _merged(tmp, known, tmp.save(confirmed(second), "links2", n), "cc2")

    # pairs of a bucket's members from different components, but for those inside its main one. Where all members are tallied, one
    # whose tallied shingles are under LEAST per cent can only be linked by a rare shingle
    at = tmp.save(spanning().select("key", "id", "c", "main").join(facts, "id"), "spanning", 4 * n_held)
    per = at.groupBy("key").agg(F.bool_and(F.col("tally").isNotNull()).alias("all"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    at = at.join(per, "key").where(~(F.col("all") & (100 * total(F.col("tally")) < LEAST * F.col("n"))))
    side = lambda i, x: [F.col(c).alias(c + x) for c in ("c", "sig", "n", "tally")] + [F.col("id").alias(i)]
    x = at.where("c <> main").select("key", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), *side("i", "_a"))
    y = at.select("key", "main", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *side("j", "_b"))
    third = x.join(y, (x.key == y.key) & (x.part == y.part) & (x.c_a != y.c_b) & ((y.c_b == y.main) | (x.i < y.j)) & possible())
    third = third.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).unionByName(by_rare).distinct()
    third = tmp.save(third.join(first.unionByName(second), ["a", "b"], "left_anti"), "pairs3")
    if n := third.count():
        known = _merged(tmp, known, tmp.save(confirmed(third), "links3", n), "cc3")
    rep = reps.select("digest", "rep").join(known.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    out = sets.join(rep, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return tmp.only(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "result", n_rows)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group stays, and one row of it. If rows of its doc_id differ, that of the smallest text (by code points,
    null last) stays and, among equal texts, that of the smallest hash of its columns; other texts under that doc_id are lost."""
    found, used = near_duplicates(docs), ("doc_id", "text")
    named = aside(docs, *used)
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rest = named.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    repeated = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
    if not repeated.isEmpty():
        rest = rest.join(repeated, F.col("doc_id") == F.col("_again"), "left")
        row = F.struct(*named.columns)
        order = F.struct(F.col("text").isNull(), F.col("text"), F.xxhash64(F.to_json(row)))
        one = rest.where("_again is not null").groupBy("_again").agg(F.min_by(row, order).alias("_row")).select("_row.*")
        rest = rest.where("_again is null").select(*named.columns).unionByName(one)
    return restored(rest, docs, *used)
