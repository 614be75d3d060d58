"""Embedding near-dedup by hierarchical navigable small-world graphs, one per shard; every shard is queried, beams widen until an
audit against brute force passes, cosines are verified in double precision, links are united to components.

Only rows with the same not-null label and the same length are compared. A vector that is null, zero or holds a null or non-finite
component is linked with nothing, as is one without a label: n_links 0, its own component. Equal vectors collapse to the smallest
vec_id before the graphs are built and count as links of one another; rows that repeat a vec_id and its vector count once.
Extra columns are ignored. A null vec_id is a vector of its own with a null component, kept. No vectors: no rows.

A task holds a shard's graph and a block of queries, and takes the queries slice by slice: pairs of a slice turn into counts and
into a union-find over the task's vectors and are dropped, so that a group of near copies costs time but no memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, table

LEAST = 0.98
#: Links of a node (twice as many on the ground level), beam while building, first beam of a query.
M, EF_BUILD, EF_QUERY, EF_MOST = 12, 32, 16, 512
#: Vectors in a shard, queries in a block (both about) and queries in a slice at most; they bound a task's memory.
SHARD, BLOCK, SLICE = 16_384, 4_096, 128
#: Tasks that a stage is dealt to at most.
MOST_TASKS = 20_000
#: Queries of each task that are audited, the share of their neighbours that must be found, and how many neighbours each has at least.
AUDIT, RECALL, NEAREST = 128, 0.9999, 10
#: A beam costs about as much as a scan of this many nodes for each unit of its width.
SCAN = 1000
#: With links and neighbours of more than one in so many of a shard's nodes, it is scanned.
DENSE = 50
#: Cosines in single precision are taken for candidates from this much below the threshold.
SLACK = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class Hnsw:
    """Malkov and Yashunin 2018, with nodes inserted and queried in batches. Nodes are numbered from the top level down, so that a level's
    nodes are the first ones."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, links: list[np.ndarray], order: np.ndarray):
        self.x, self.levels, self.links, self.order = x, levels, links, order

    @classmethod
    def build(cls, x: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 5) -> Hnsw:
        n = len(x)
        height = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(m)).astype(int)
        order = np.argsort(-height, kind="stable")
        g = cls(x[order], height[order], [], order)
        for level in range(int(height.max()) + 1):
            g.links.append(np.full((int((height >= level).sum()), 2 * m if level == 0 else m), -1, np.int32))
        done = 1
        while done < n:
            new = np.arange(done, min(n, done + min(256, done)))
            g._insert(new, done, m, ef)
            done += len(new)
        return g

    def _insert(self, new: np.ndarray, done: int, m: int, ef: int) -> None:
        q = self.x[new]
        at = np.zeros((len(new), 1), np.int64)
        for level in range(int(self.levels[0]), -1, -1):
            links = self.links[level]
            known = min(done, len(links))
            low = new[new < len(links)]  # those that live on this level; the others only pass through
            if not known:
                continue
            wide = ef if len(low) else 1
            ids, _, _ = self._beam(q, at, level, wide, known)
            at = np.where(ids[:, : max(1, m)] >= 0, ids[:, : max(1, m)], ids[:, :1])
            if len(low):
                inside = low[None, :] + np.zeros((len(low), 1), np.int64)
                inside = np.where(inside == low[:, None], -1, inside)
                if len(low) > 2 * m:  # the nearest of the batch
                    s = self.x[low] @ self.x[low].T
                    np.fill_diagonal(s, -2)
                    inside = low[np.argpartition(-s, 2 * m - 1, axis=1)[:, : 2 * m]]
                cand = np.concatenate([ids[: len(low)], inside], axis=1)
                chosen = self._select(low, cand, m)
                links[low, : chosen.shape[1]] = chosen
                self._back(low, chosen, links)

    def _back(self, new: np.ndarray, chosen: np.ndarray, links: np.ndarray) -> None:
        """Links in the other direction; full lists are chosen anew."""
        src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        nth = np.arange(len(dst)) - np.repeat(first, count)
        src, dst, nth = src[nth < 32], dst[nth < 32], nth[nth < 32]
        row = np.searchsorted(to, dst)
        more = np.full((len(to), int(nth.max()) + 1), -1, np.int64)
        more[row, nth] = src
        cap = links.shape[1]
        for i in range(0, len(to), 1024):
            t = to[i : i + 1024]
            cand = np.concatenate([links[t], more[i : i + 1024]], axis=1)
            cand = np.where(cand == t[:, None], -1, cand)
            s = np.sort(cand, axis=1)  # a link may be there from either side
            s[:, 1:][s[:, 1:] == s[:, :-1]] = -1
            got = self._select(t, s, cap)
            links[t, : got.shape[1]] = got
            links[t, got.shape[1] :] = -1

    def _select(self, base: np.ndarray, cand: np.ndarray, m: int) -> np.ndarray:
        """Up to m of the candidates: first those nearer to the base than to any chosen before, then the nearest of the rest."""
        v = self.x[np.maximum(cand, 0)]
        s = np.where(cand >= 0, np.einsum("bd,bcd->bc", self.x[base], v), -2.0)
        order = np.argsort(-s, axis=1, kind="stable")
        cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        among = v @ v.transpose(0, 2, 1)
        keep, nearest = np.zeros(s.shape, bool), np.full(s.shape, -2.0)
        for c in range(s.shape[1]):
            keep[:, c] = (s[:, c] > nearest[:, c]) & (s[:, c] > -2) & (keep.sum(1) < m)
            nearest = np.where(keep[:, c : c + 1], np.maximum(nearest, among[:, c]), nearest)
        rank = np.argsort(np.where(keep, 0, 1) + np.where(s > -2, 0, 2), axis=1, kind="stable")[:, :m]
        return np.where(np.take_along_axis(s, rank, 1) > -2, np.take_along_axis(cand, rank, 1), -1)

    def _beam(self, q: np.ndarray, at: np.ndarray, level: int, ef: int, known: int, least: float | np.ndarray = 2.0):
        """Ids and similarities of up to ef found nodes of a level, best first, and (query, node) pairs of all evaluated ones from `least` (one, or one a query) on."""
        n, links = len(q), self.links[level]
        least = np.broadcast_to(np.asarray(least, np.float32), n)
        seen = np.zeros((n, known), bool)
        ids = np.full((n, max(ef, at.shape[1])), -1, np.int64)
        ids[:, : at.shape[1]] = at
        dup = np.zeros(ids.shape, bool)  # the same entry given twice
        for c in range(1, at.shape[1]):
            dup[:, c] = (ids[:, :c] == ids[:, c : c + 1]).any(1)
        ids[dup] = -1
        sims = np.where(ids >= 0, np.einsum("qd,qcd->qc", q, self.x[np.maximum(ids, 0)]), -2.0).astype(np.float32)
        r, c = np.nonzero(ids >= 0)
        seen[r, ids[r, c]] = True
        hits = [(r[h], ids[r, c][h]) for h in [sims[r, c] >= least[r]]]
        open_ = ids >= 0
        live = np.arange(n)
        while len(live):
            best = np.where(open_[live], sims[live], -3.0).argmax(1)
            ok = open_[live, best]
            live, best = live[ok], best[ok]
            if not len(live):
                break
            open_[live, best] = False
            nb = links[ids[live, best]].astype(np.int64)
            fresh = (nb >= 0) & (nb < known) & ~seen[live[:, None], np.maximum(np.minimum(nb, known - 1), 0)]
            some = fresh.any(1)
            if not some.any():
                continue
            rows, nb, fresh = live[some], nb[some], fresh[some]
            r, c = np.nonzero(fresh)
            seen[rows[r], nb[r, c]] = True
            s = np.full(nb.shape, -2.0, np.float32)
            s[r, c] = np.einsum("pd,pd->p", q[rows[r]], self.x[nb[r, c]])
            h = s[r, c] >= least[rows[r]]
            if h.any():
                hits.append((rows[r][h], nb[r, c][h]))
            alls = np.concatenate([sims[rows], s], 1)
            alli = np.concatenate([ids[rows], np.where(fresh, nb, -1)], 1)
            allo = np.concatenate([open_[rows], fresh], 1)
            top = np.argpartition(-alls, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
            sims[rows], ids[rows], open_[rows] = (np.take_along_axis(x, top, 1) for x in (alls, alli, allo))
        order = np.argsort(-sims, axis=1, kind="stable")
        found = (np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]))
        return np.take_along_axis(ids, order, 1), seen, found

    def near(self, q: np.ndarray, least: float | np.ndarray, ef: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of similarity from `least` on: by beam, then from hit to hit. own: queries' own nodes, -1 if not here."""
        least = np.broadcast_to(np.asarray(least, np.float32), len(q))
        at = np.zeros((len(q), 1), np.int64)
        for level in range(len(self.links) - 1, 0, -1):
            at = self._beam(q, at, level, 1, len(self.links[level]))[0][:, :1]
        if own is not None:
            at = np.concatenate([at, np.where(own >= 0, own, at[:, 0])[:, None]], 1)
        _, seen, (qi, node) = self._beam(q, at, 0, ef, len(self.x), least)
        out, fq, fn = [(qi, node)], qi, node
        while len(fq):
            nq, nn = [], []
            for i in range(0, len(fq), 20_000):
                a = np.repeat(fq[i : i + 20_000], self.links[0].shape[1])
                b = self.links[0][fn[i : i + 20_000]].ravel().astype(np.int64)
                ok = b >= 0
                a, b = a[ok], b[ok]
                ok = ~seen[a, b]
                pair = np.unique(a[ok] * len(self.x) + b[ok])
                a, b = pair // len(self.x), pair % len(self.x)
                seen[a, b] = True
                s = np.concatenate([np.einsum("pd,pd->p", q[a[j : j + 20_000]], self.x[b[j : j + 20_000]]) for j in range(0, len(a), 20_000)] or [np.empty(0)])
                nq.append(a[s >= least[a]])
                nn.append(b[s >= least[a]])
            fq, fn = np.concatenate(nq), np.concatenate(nn)
            out.append((fq, fn))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def packed(self) -> bytes:
        import io

        f = io.BytesIO()
        np.savez(f, x=self.x, levels=self.levels, order=self.order, **{f"l{i}": a for i, a in enumerate(self.links)})
        return f.getvalue()

    @classmethod
    def unpacked(cls, blob: bytes) -> Hnsw:
        import io

        z = np.load(io.BytesIO(blob))
        return cls(z["x"], z["levels"], [z[f"l{i}"] for i in range(len(z.files) - 3)], z["order"])


def beam_for(g: Hnsw, q: np.ndarray, own: np.ndarray, least: float, audit: int = AUDIT, recall: float = RECALL) -> int:
    """The beam at which the audit passes, doubled until it does; 0 if the shard is better scanned as a whole: no beam suffices, the one that
    does was widened and costs more, or links are so many that a scan is cheaper than to follow them.

    Audited are a query's links and, as most have none, its NEAREST nodes whatever their cosine; its own node, an entry of the beam, is no evidence.
    """
    n, ef = len(g.x), EF_QUERY
    tried = np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int)
    s = q[tried] @ g.x.T
    here = own[tried] >= 0
    s[here, own[tried][here]] = -2
    k = min(NEAREST, n - 1)
    low = np.minimum(np.partition(s, n - k, axis=1)[:, n - k], np.float32(least)) if k else np.full(len(tried), least, np.float32)
    truth = set(zip(*map(np.ndarray.tolist, np.nonzero(s >= low[:, None])), strict=True))
    if len(truth) * DENSE >= n * len(tried):
        return 0
    while truth and ef <= min(n, EF_MOST):
        a, b = g.near(q[tried], low - np.float32(SLACK), ef, own[tried])  # cosines differ in the last digits by how they are summed
        if len(truth & set(zip(a.tolist(), b.tolist(), strict=True))) >= recall * len(truth):
            return 0 if ef > EF_QUERY and ef * SCAN >= n else ef
        ef *= 2
    return 0


def near_pairs(g: Hnsw, q: np.ndarray, own: np.ndarray, least: float, step: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) from `least` on, slice by slice of the queries."""
    ef = beam_for(g, q, own, least)
    for i in range(0, len(q), step):
        part = slice(i, i + step)
        a, b = g.near(q[part], least, ef, own[part]) if ef else np.nonzero(q[part] @ g.x.T >= least)
        yield a + i, b


class Union:
    """Components of 0 .. n-1, each known by its smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        while (differ := a != b).any():
            pair = np.unique(np.minimum(a[differ], b[differ]) * len(self.root) + np.maximum(a[differ], b[differ]))
            low, high = pair // len(self.root), pair % len(self.root)
            np.minimum.at(self.root, high, low)
            while (further := self.root[self.root] != self.root).any():
                self.root[further] = self.root[self.root[further]]
            a, b = self.root[low], self.root[high]


def cosines(x: np.ndarray, norm_x: np.ndarray, y: np.ndarray, norm_y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of x[a] and y[b] in double precision; by one product of matrices where a slice's pairs are dense."""
    out = np.empty(len(a))
    if len(a):
        low, high = a.min(), a.max() + 1
        if 10 * len(a) >= (high - low) * len(y):
            return (x[low:high] @ y.T)[a - low, b] / (norm_x[a] * norm_y[b])
    for i in range(0, len(a), 50_000):
        s, t = a[i : i + 50_000], b[i : i + 50_000]
        out[i : i + 50_000] = (x[s] * y[t]).sum(1) / (norm_x[s] * norm_y[t])
    return out


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy())


def _build(key, pdf):
    import pandas as pd

    pdf = pdf.sort_values("id")
    x = _stack(pdf.embedding)
    g = Hnsw.build(unit(x))
    return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "graph": [g.packed()], "ids": [pdf.id.to_numpy(np.int64).tobytes()], "copies": [pdf.copies.to_numpy(np.int64).tobytes()], "raw": [x.tobytes()]})


FOUND = "id long, links long, other long"


def _query(least: float):
    """Per query: the vectors linked with it here, and the smallest id that links of this task reach from it."""

    def run(key, graphs, queries):
        import pandas as pd

        if not len(graphs) or not len(queries):
            return pd.DataFrame({"id": [], "links": [], "other": []}).astype("int64")
        row = graphs.iloc[0]
        g, ids, copies = Hnsw.unpacked(row.graph), np.frombuffer(row.ids, np.int64), np.frombuffer(row.copies, np.int64)
        raw = np.frombuffer(row.raw, np.float32).reshape(len(ids), -1).astype(np.float64)
        q, x = queries.id.to_numpy(np.int64), _stack(queries.embedding).astype(np.float64)
        node = np.empty(len(ids), np.int64)
        node[g.order] = np.arange(len(ids))
        place = np.minimum(np.searchsorted(ids, q), len(ids) - 1)
        own = np.where(ids[place] == q, node[place], -1)
        every = np.union1d(q, ids)
        at_q, at_ids, united, links = np.searchsorted(every, q), np.searchsorted(every, ids), Union(len(every)), np.zeros(len(q), np.int64)
        norm_x, norm_raw = np.linalg.norm(x, axis=1), np.linalg.norm(raw, axis=1)
        # single precision errs by far less than SLACK, or by so much for so many components
        slack = max(SLACK, 2.5e-7 * x.shape[1])
        for a, b in near_pairs(g, unit(x), own, least - slack):
            b = g.order[b]
            ok = ids[b] != q[a]
            a, b = a[ok], b[ok]
            ok = cosines(x, norm_x, raw, norm_raw, a, b) >= least
            a, b = a[ok], b[ok]
            links += np.bincount(a, copies[b], len(q)).astype(np.int64)
            united.add(at_q[a], at_ids[b])
        out = pd.DataFrame({"id": q, "links": links, "other": every[united.root[at_q]]})
        only = np.setdiff1d(np.flatnonzero(united.root != np.arange(len(every))), at_q)
        return pd.concat([out, pd.DataFrame({"id": every[only], "links": 0, "other": every[united.root[only]]})])

    return run


def usable(c: str = "embedding") -> Column:
    """Not null, not zero, all components there and finite."""
    x = F.col(c)
    return F.coalesce(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))


def embedding_dedup(vectors: DataFrame, least: float = LEAST, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors(vec_id, embedding, label)."""
    tmp = Scratch(vectors.sparkSession, "hnsw")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label"))
    part = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    once = v.where(part).dropDuplicates(["vec_id", "label", "embedding"])
    nodes = tmp.save(once.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.max("vec_id").alias("last")), "nodes")
    nodes = nodes.withColumn("dim", F.size("embedding"))
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = tmp.save(sizes, "sizes")
    # a task for each pair of shard and block, or nearly
    tasks = sizes.agg(F.sum(F.col("shards") * F.col("blocks")).alias("pairs"), F.sum("shards").alias("shards")).first()
    spread = lambda n: int(min(MOST_TASKS, max(1, 2 * (n or 0))))
    nodes = nodes.join(sizes, ["label", "dim"])
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    graphs = tmp.save(dealt.repartition(spread(tasks.shards), "label", "dim", "shard").groupBy("label", "dim", "shard").applyInPandas(_build, f"label {vectors.schema['label'].dataType.simpleString()}, dim int, shard int, graph binary, ids binary, copies binary, raw binary"), "graphs")
    graphs = graphs.join(sizes, ["label", "dim"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    queries = nodes.withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    key = ["label", "dim", "shard", "block"]
    n = spread(tasks.pairs)
    found = graphs.select(*key, "graph", "ids", "copies", "raw").repartition(n, *key).groupBy(*key).cogroup(queries.select(*key, "id", "embedding").repartition(n, *key).groupBy(*key)).applyInPandas(_query(least), FOUND)
    found = tmp.save(found, "found")
    tmp.drop("graphs")
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    united = components(tmp, found.where("other <> id").select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = nodes.select("label", "embedding", "id", "copies").join(degree, "id", "left").join(united, "id", "left")
    known = known.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "id").alias("c"))
    out = v.withColumn("_part", part)
    out = out.join(known, F.col("_part") & (out.label == known["_l"]) & (out.embedding == known["_e"]), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return tmp.only(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "result")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
