"""Approximate nearest neighbours by an inverted multi-index: the vectors' two halves are quantised separately, cells (pairs of
centroids) are traversed by summed distance with a heap, and the entries of the cells reached are reranked on the original vectors.

Nearness is the inner product, so a half's distance to a centroid is minus their product. Codebooks are fitted on a bounded sample
(SAMPLE vectors with the smallest hash of their id) and grow with the number of vectors; every vector is indexed. How many entries a query
reaches is the smallest number at which AUDIT queries, searched by brute force over all vectors, find RECALL of their true
neighbours; as many other queries then measure it, and where they find less than LEAST it is set by both.

Entries are dealt to lists once, by their first centroids; a query goes to the lists of which it has reached a cell. A task holds
a list's entries (ENTRIES, about) and reranks queries as they stream by.

Vectors that are null, zero or hold null or non-finite components take no part; nor does a null vec_id. Vectors of each length are an
index of their own, as products exist among them only. Rows that repeat a vec_id and its vector count once. Equal vectors tie and go by
vec_id. Fewer candidates than k: all are returned. Other columns are ignored. No vectors: no rows.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, slices, table
from .hnsw import usable

K, EVERY = 20, 20
#: Vectors that the codebooks are fitted on; queries of an audit, the share of neighbours it must find, and what others must find at least.
SAMPLE, AUDIT, RECALL, LEAST = 32_768, 64, 0.97, 0.93
#: Vectors of a cell if all were alike, about, and centroids of a half at most; cells are counted in the driver and sent to tasks (8 MB).
CELL, CENTROIDS = 10, 1024
#: Entries of a list, about, and queries scored at a time.
ENTRIES, QUERIES = 16_384, 256
log = logging.getLogger(__name__)


def centroids_for(n: int, cell: int = CELL, most: int = CENTROIDS) -> int:
    """Centroids of each half for n vectors: a power of two, so that cells hold `cell` to 4 * `cell` on average."""
    k = 1
    while 4 * k * k * cell <= n and 2 * k <= most:
        k *= 2
    return k


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of x (Lloyd); k or as many as there are different rows."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, c)
        order, n = np.argsort(near, kind="stable"), np.bincount(near, minlength=k)
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some], axis=0) / n[some, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = (c * c).sum(1)[None, :]
    return np.concatenate([np.argmin(size - 2.0 * (x[i : i + 4096] @ c.T), axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def traverse(da: np.ndarray, db: np.ndarray, counts: np.ndarray, reach: int) -> Iterator[tuple[int, int]]:
    """Cells (i, j) with entries by da[i] + db[j], until so many entries have been reached (Babenko and Lempitsky 2012). The heap holds
    the next cell of each row of the sorted table that has been begun; a row's first cell brings in the next row."""
    a, b = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
    sa, sb = da[a].tolist(), db[b].tolist()
    heap, got = [(sa[0] + sb[0], 0, 0)], 0
    while heap and got < reach:
        _, u, v = heap[0]
        if v + 1 < len(b):
            heapq.heapreplace(heap, (sa[u] + sb[v + 1], u, v + 1))
        else:
            heapq.heappop(heap)
        if v == 0 and u + 1 < len(a):
            heapq.heappush(heap, (sa[u + 1] + sb[0], u + 1, 0))
        i, j = a[u], b[v]
        if n := counts[i, j]:
            got += n
            yield i, j


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties at the edge included."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    return np.flatnonzero(scores >= edge - 1e-9 * max(1.0, abs(edge)))


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of q with rows, each summed in the same order whatever the rows beside it."""
    return (x * q[None, :]).sum(1)


def ranked(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, k: int):
    """(query id, id, score) of each query's k best rows of x; mask says which rows a query has reached."""
    out_q, out_i, out_s = [], [], []
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ x.T
        if mask is not None:
            s[~mask[i : i + 256]] = -np.inf
        s[q_ids[i : i + 256, None] == ids[None, :]] = -np.inf
        for j, row in enumerate(s):
            at = np.flatnonzero(row > -np.inf)
            at = at[top(row[at], ids[at], k)]
            exact = product(q[i + j], x[at])
            best = np.lexsort((ids[at], -exact))[:k]
            out_q.append(np.full(len(best), q_ids[i + j]))
            out_i.append(ids[at][best])
            out_s.append(exact[best])
    join = lambda a, t: np.concatenate(a).astype(t) if a else np.empty(0, t)
    return join(out_q, np.int64), join(out_i, np.int64), join(out_s, np.float64)


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, (pa.Array, pa.ChunkedArray)):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return np.stack(column.to_numpy()).astype(np.float64)


RESULT = "query_id long, vec_id long, score double"


@dataclass
class Index:
    """What searching needs besides the entries (vec_id, embedding, i, j)."""

    entries: DataFrame
    dim: int
    a: np.ndarray
    b: np.ndarray
    counts: np.ndarray  # entries of each cell
    reach: int = 0
    found: float = 1.0  # share of their neighbours that queries outside the audit find

    @property
    def half(self) -> int:
        return (self.dim + 1) // 2

    @property
    def total(self) -> int:
        return int(self.counts.sum())

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each first centroid its list and its place there, and of each list the blocks that its entries are dealt to. Small neighbours share a list."""
        sizes, lists, place, filled = self.counts.sum(1), np.zeros(len(self.a), int), np.zeros(len(self.a), int), []
        for i, n in enumerate(sizes.tolist()):
            if not filled or filled[-1] + n > ENTRIES:
                filled.append(0)
            lists[i], place[i] = len(filled) - 1, i and (place[i - 1] + 1) * (lists[i - 1] == len(filled) - 1)
            filled[-1] += n
        return lists, place, np.maximum(1, -(-np.array(filled) // ENTRIES))


def _some(v: DataFrame, n: int, total: int, seed: int) -> DataFrame:
    """The n rows of the smallest hashes of their ids; a bound on the hash spares tasks sending n rows each."""
    h = F.xxhash64("vec_id", F.lit(seed))
    if total > 2 * n:
        v = v.where(h < int(-(2.0**63) + 2.0**64 * 2 * n / total))
    return v.orderBy(h, "vec_id").limit(n)


def build(tmp: Scratch, v: DataFrame, dim: int, total: int, is_query, k: int = K, recall: float = RECALL, centroids: int | None = None) -> Index:
    """The index of vectors (vec_id, embedding) of one length."""
    half, centroids = (dim + 1) // 2, centroids or centroids_for(total)
    sample = _matrix(_some(v, SAMPLE, total, 1).select("embedding").toArrow().column("embedding").combine_chunks(), dim)
    a, b = kmeans(sample[:, :half], centroids), kmeans(sample[:, half:], centroids) if dim > 1 else np.zeros((1, 0))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "embedding", 1 << 23):
                x = _matrix(batch.column("embedding"), dim)
                i, j = nearest(x[:, :half], a), nearest(x[:, half:], b) if dim > 1 else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["vec_id", "embedding", "i", "j"])

    entries = tmp.save(v.select("vec_id", "embedding").mapInArrow(quantise, "vec_id long, embedding array<float>, i int, j int"), f"entries{dim}")
    counts, cells = np.zeros((len(a), len(b)), np.int64), entries.groupBy("i", "j").count().toArrow()  # a number for each cell
    counts[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("count").to_numpy()
    index = Index(entries, dim, a, b, counts, total)
    _audit(index, is_query, k, recall)
    log.info("%d vectors of length %d, %d x %d centroids: a query reaches %.1f %% of entries and finds %.1f %% of its neighbours", index.total, dim, len(a), len(b), 100 * index.reach / index.total, 100 * index.found)
    return index


def neighbours(index: Index, is_query, k: int) -> DataFrame:
    """query_id, vec_id, score of the best entries found in each list."""
    spark = index.entries.sparkSession
    lists, place, blocks = index.lists()
    dim, half, width = index.dim, index.half, len(index.b)
    sent = spark.sparkContext.broadcast((index.a, index.b, index.counts, lists, place))  # bounded by CENTROIDS
    heights = np.bincount(lists)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and list of which it reaches a cell, with these cells as bits."""
        a, b, counts, lists, place = sent.value
        for batch in batches:
            rows: list[tuple[int, int, bytes]] = []
            x = _matrix(batch.column("embedding"), dim) if batch.num_rows else np.empty((0, dim))
            for n, q in enumerate(x):
                cells = np.array(list(traverse(-(a @ q[:half]), -(b @ q[half:]), counts, index_reach)), np.int64).reshape(-1, 2)
                at = lists[cells[:, 0]]
                for one in np.unique(at):
                    mine, bits = cells[at == one], np.zeros(heights[one] * width, bool)
                    bits[place[mine[:, 0]] * width + mine[:, 1]] = True
                    rows.append((n, int(one), np.packbits(bits).tobytes()))
            n, one, bits = zip(*rows, strict=True) if rows else ((), (), ())
            at = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("embedding").take(at), pa.array(one, pa.int32()), pa.array(bits, pa.binary())], ["vec_id", "embedding", "list", "bits"])

    index_reach = index.reach
    number = lambda values: F.element_at(F.array(*(F.lit(int(x)) for x in values)), F.col("i") + 1)
    split = lambda c: F.element_at(F.array(*(F.lit(int(x)) for x in blocks)), c + 1)
    e = index.entries.select("vec_id", "embedding", number(lists).alias("list"), (number(place) * width + F.col("j")).alias("cell"))
    e = e.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), split(F.col("list"))).cast("int"))
    q = index.entries.where(is_query).select("vec_id", "embedding").mapInArrow(route, "vec_id long, embedding array<float>, list int, bits binary")
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0), split(F.col("list")) - 1)))
    # an entry goes to one task, a query to those it needs
    both = e.select("list", "block", "vec_id", "embedding", "cell", F.lit(None).cast("binary").alias("bits")).unionByName(q.select("list", "block", "vec_id", "embedding", F.lit(None).cast("int").alias("cell"), "bits"))
    both = both.repartition(int(min(20_000, 2 * blocks.sum())), "list", "block").sortWithinPartitions("list", "block", F.col("cell").isNull(), "vec_id")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, x, ids, cells, held = None, None, None, None, []
        for batch in batches:
            at = batch.column("list").to_numpy().astype(np.int64) << 32 | batch.column("block").to_numpy()
            edges = np.flatnonzero(np.diff(at)) + 1
            for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(at)], strict=True) if len(at) else ():
                if key != at[lo]:
                    key, held, x = at[lo], [], None
                part = batch.slice(lo, hi - lo)
                n = len(part) - part.column("cell").null_count  # entries come first
                if n:
                    held.append(part.slice(0, n))
                if n == len(part) or not held:  # no queries, or a list whose block has no entries
                    continue
                if x is None:
                    x = np.concatenate([_matrix(p.column("embedding"), dim) for p in held])
                    ids, cells = (np.concatenate([p.column(c).to_numpy() for p in held]) for c in ("vec_id", "cell"))
                for i in range(n, len(part), QUERIES):
                    q = part.slice(i, QUERIES)
                    bits = np.stack([np.unpackbits(np.frombuffer(b.as_py(), np.uint8)) for b in q.column("bits")]).astype(bool)
                    found = ranked(_matrix(q.column("embedding"), dim), q.column("vec_id").to_numpy(), x, ids, bits[:, cells], k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    return both.mapInArrow(rerank, RESULT)


def search(vectors: DataFrame, is_query, k: int = K, recall: float = RECALL, centroids: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of vectors(vec_id, embedding) other than the query's own id."""
    spark = vectors.sparkSession
    tmp = Scratch(spark, "imi")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    v = tmp.save(v.where(usable() & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "embedding"]).withColumn("dim", F.size("embedding")), "vectors")
    found = None
    for r in sorted(v.groupBy("dim").count().collect()):  # a row for each length
        index = build(tmp, v.where(F.col("dim") == r["dim"]), r["dim"], r["count"], is_query, k, recall, centroids)
        one = neighbours(index, is_query, k)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return tmp.only(out, "result")


def _audit(index: Index, is_query, k: int, recall: float) -> None:
    """Sets how many entries a query must reach, by AUDIT queries, and measures on others what that finds."""
    few = index.entries.where(is_query).orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(2 * AUDIT).select("vec_id", "embedding").toArrow()
    q, ids, dim = _matrix(few.column("embedding").combine_chunks(), index.dim), few.column("vec_id").to_numpy(), index.dim
    if not len(q):
        return

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = []
        for b in batches:
            if not b.num_rows:
                continue
            found = ranked(q, ids, _matrix(b.column("embedding"), dim), b.column("vec_id").to_numpy(), None, k)
            i, j = b.column("i").to_numpy(), b.column("j").to_numpy()
            place = {v: n for n, v in enumerate(b.column("vec_id").to_pylist())}
            at = [place[v] for v in found[1].tolist()]
            best = _best([*best, *zip(*(f.tolist() for f in found), i[at].tolist(), j[at].tolist(), strict=True)], k)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*best, strict=True)], schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("i", pa.int64()), ("j", pa.int64())]))

    truth = index.entries.mapInArrow(scan, RESULT + ", i long, j long")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = truth.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("query_id", "i", "j").toArrow()  # 2 * AUDIT * k rows
    of, i, j = (truth.column(c).to_numpy() for c in ("query_id", "i", "j"))
    needed = []  # entries to reach until the cell of each true neighbour is taken in, by query
    for n, x in zip(ids, q, strict=True):
        cost = -(index.a @ x[: index.half])[:, None] - (index.b @ x[index.half :])[None, :]
        order = np.argsort(cost, axis=None, kind="stable")
        before = np.empty(order.size, np.int64)
        sizes = index.counts.ravel()[order]
        before[order] = np.cumsum(sizes) - sizes
        needed.append(before.reshape(cost.shape)[i[of == n], j[of == n]] + 1)

    def enough(some: list[np.ndarray]) -> int:
        every = np.sort(np.concatenate(some))
        return int(every[min(len(every) - 1, int(np.ceil(recall * len(every))))]) if len(every) else index.total

    chosen, others = needed[:AUDIT], needed[AUDIT:] or needed
    index.reach = enough(chosen)
    share = lambda: float((np.concatenate(others) <= index.reach).mean()) if sum(map(len, others)) else 1.0
    if share() < LEAST:
        index.reach = max(index.reach, enough(others))
    index.found = share()


def _best(rows: list[tuple], k: int) -> list[tuple]:
    rows.sort(key=lambda r: (r[0], -r[2], r[1]))
    out, last, n = [], None, 0
    for r in rows:
        last, n = r[0], n + 1 if r[0] == last else 1
        if n <= k:
            out.append(r)
    return out


def op5_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
