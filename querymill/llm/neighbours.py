"""The most similar vectors of every vector, by an inverted multi-index.

Each vector is cut into two halves and each half is quantised by centroids of its own, so K centroids a
half give K * K cells. A query goes through pairs of centroids in the order of summed distance, with a heap, until the cells passed
hold enough entries; their exact cosines give a lower bound of the k-th similarity. A second pass compares the query with all
cells that can hold an entry of that similarity by their distance and radii, so no neighbour is lost however dense its surroundings.

Centroids are fitted to a bounded sample of the vectors; every vector is indexed. Equal vectors are one
entry with a list of nodes. A cell with many entries is split into blocks of entries and of queries, each
block pair being one group, so no task holds more than two blocks.
"""

from __future__ import annotations

import heapq
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querymill.runtime import cut, hashed_sample


#: Similarities are rounded to this many digits before they are ranked, so that vectors of one direction tie.
DIGITS = 9


def vectors_of(nodes: DataFrame, *, id_col: str = "node_id", vec_col: str = "embedding", dim: int = 64) -> DataFrame:
    """``node, vec, key``: one row per node with a usable vector; ``key`` names the vector by 128 bits.

    Null, empty and all-zero embeddings, other lengths than ``dim``, and non-finite values are no vectors and have no
    neighbours. A node id that is repeated counts once, with its largest vector if they differ.
    """
    ok = F.col("v").isNotNull() & (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(3e38))) & F.exists("v", lambda x: x != 0)
    rows = nodes.select(F.col(id_col).cast("string").alias("node"), F.col(vec_col).cast("array<float>").alias("v")).where(F.col("node").isNotNull() & ok)

    def pack(batches):
        for b in batches:
            values = b.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f4") + np.float32(0)
            raw = values.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([raw[i : i + 4 * dim] for i in range(0, len(raw), 4 * dim)], pa.binary())], names=["node", "vec"])

    one = rows.mapInArrow(pack, "node string, vec binary").groupBy("node").agg(F.max("vec").alias("vec"))
    return one.select("node", "vec", F.struct(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), "vec").alias("b")).alias("key"))


def entries_of(vectors: DataFrame, *, heads: int, query_share: int = 1) -> DataFrame:
    """``key, entry, vec, head, asked``: the distinct vectors.

    ``head`` holds the first ``heads`` of the vector's nodes in the order of their ids (no list grows with the number of
    copies), ``entry`` is the first of them, and ``asked`` says whether any of the nodes is a query.
    """
    asked = is_query(F.col("node"), query_share)
    order = Window.partitionBy("key").orderBy("node")
    first = vectors.select("key", "node", "vec", F.row_number().over(order).alias("r")).where(F.col("r") <= heads)
    head = first.groupBy("key").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("node")).alias("head"))
    out = head.select("key", F.element_at("head", 1).alias("entry"), "vec", "head")
    if query_share == 1:
        return out.withColumn("asked", F.lit(True))
    return out.join(vectors.where(asked).select("key").distinct().withColumn("q", F.lit(True)), "key", "left").select("key", "entry", "vec", "head", F.coalesce("q", F.lit(False)).alias("asked"))


def unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of ``x``; the start is spread over the sample and an empty cell takes the worst point."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        at = d.argmin(1)
        for j in range(k):
            mine = x[at == j]
            c[j] = mine.mean(0) if len(mine) else x[d.min(1).argmax()]
    return c


class MultiIndex:
    """Two sets of centroids and the cells' numbers of entries. Its size is bounded by ``K`` alone."""

    def __init__(self, sample: np.ndarray, k: int):
        half = sample.shape[1] // 2
        self.k, self.half = k, half
        self.centroids = [kmeans(sample[:, :half], k), kmeans(sample[:, half:], k)]
        self.counts = np.zeros(k * k, np.int64)
        #: the largest distance of a cell's entries from its centroid in either half
        self.radii = np.zeros((2, k * k))

    def distances(self, x: np.ndarray):
        parts = x[:, : self.half], x[:, self.half :]
        return [(p * p).sum(1)[:, None] + (c * c).sum(1) - 2 * p @ c.T for p, c in zip(parts, self.centroids)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.k + b.argmin(1)

    def spreads(self, x: np.ndarray, cell: np.ndarray) -> list[np.ndarray]:
        """The distance of each row of ``x`` from the centroid of its cell in either half."""
        parts = (x[:, : self.half], cell // self.k), (x[:, self.half :], cell % self.k)
        return [np.linalg.norm(p - c[at], axis=1) for (p, at), c in zip(parts, self.centroids)]

    def least_distances(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For each row of ``x`` and each of ``cells`` a squared distance that no entry of the cell comes below.

        In either half an entry is within its cell's radius and not beyond the plane between its centroid and the row's nearest.
        """
        out = np.zeros((len(x), len(cells)))
        for d, c, radius, at in zip(self.distances(x), self.centroids, self.radii, (cells // self.k, cells % self.k)):
            d = np.maximum(d, 0)
            near = d.argmin(1)
            apart = np.linalg.norm(c[near][:, None, :] - c[None, :, :], axis=2)
            plane = (d - d.min(1)[:, None]) / np.maximum(2 * apart, 1e-12)
            out += np.maximum(np.sqrt(d)[:, at] - radius[cells], plane[:, at]).clip(0) ** 2
        return out

    def visits(self, x: np.ndarray, wanted: int):
        """For each row of ``x`` the cells in the order of summed distance until they hold ``wanted`` entries: (row, cell)."""
        (da, db), rows, found = self.distances(x), [], []
        oa, ob = da.argsort(1), db.argsort(1)
        sa, sb = np.take_along_axis(da, oa, 1), np.take_along_axis(db, ob, 1)
        counts, k = self.counts.tolist(), self.k
        for r in range(len(x)):
            a, b, na, nb = sa[r].tolist(), sb[r].tolist(), oa[r].tolist(), ob[r].tolist()
            heap, have = [(a[0] + b[0], 0, 0)], 0
            while heap and have < wanted:
                _, i, j = heapq.heappop(heap)
                cell = na[i] * k + nb[j]
                if counts[cell]:
                    have += counts[cell]
                    rows.append(r)
                    found.append(cell)
                # each pair is pushed once: along j from any pair, along i from the first of a line
                if j + 1 < k:
                    heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
                if j == 0 and i + 1 < k:
                    heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return np.array(rows, np.int64), np.array(found, np.int64)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, dim)


def nearest_entries(entries: DataFrame, queries: DataFrame, *, k: int = 5, dim: int = 64, visit_cells: int = 6, min_visits: int = 128, entries_a_cell: int = 64,
                    sample_rows: int = 16_384, max_half: int = 1_024, block: int = 4_096, min_similarity: float = -1.0) -> DataFrame:
    """``query, entry, similarity, rank``: the ``k`` entries nearest to each query entry, itself left out.

    ``visit_cells`` times the mean cell is the number of entries that a query is compared with first (``min_visits`` at least); that sets how
    many cells the second pass can leave out, and no pair is lost by it. Pairs below ``min_similarity`` are left out, which changes no rank of the others. Ties go to the
    smaller entry id.
    """
    spark = entries.sparkSession
    n = entries.count()
    schema = "query string, entry string, similarity double, rank int"
    if n < 2:
        return spark.createDataFrame([], schema)
    sample = hashed_sample(entries.select("vec"), "vec", sample_rows).toPandas()["vec"]
    half_k = int(np.clip(2 ** round(np.log2(max(1.0, np.sqrt(n / entries_a_cell)))), 1, min(max_half, len(sample))))
    index = MultiIndex(unit(_matrix(pa.array(sample), dim)), half_k)
    fitted = spark.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            x = unit(_matrix(b.column("vec"), dim)) if b.num_rows else np.zeros((0, dim))
            cell = fitted.value.cells(x)
            yield pa.RecordBatch.from_arrays([b.column("entry"), b.column("vec"), pa.array(cell, pa.int32()), *map(pa.array, fitted.value.spreads(x, cell))], names=["entry", "vec", "cell", "ra", "rb"])

    assigned = entries.select("entry", "vec").mapInArrow(assign, "entry string, vec binary, cell int, ra double, rb double")
    for r in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("ra").alias("ra"), F.max("rb").alias("rb")).collect():  # at most K * K rows
        index.counts[r["cell"]] = r["n"]
        index.radii[:, r["cell"]] = r["ra"], r["rb"]
    placed = assigned.select("entry", "vec", "cell")
    wanted = int(max(min_visits, visit_cells * n / max(1, (index.counts > 0).sum())))
    fitted_counts = spark.sparkContext.broadcast(index)
    parts = np.maximum(1, -(-index.counts // block))

    def probe(batches):
        own = fitted_counts.value
        for b in batches:
            if not b.num_rows:
                continue
            row, cell = own.visits(unit(_matrix(b.column("vec"), dim)), wanted)
            lanes = parts[cell]
            row, cell, eb = np.repeat(row, lanes), np.repeat(cell, lanes), np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            mine = np.array([hash_(x) for x in b.column("entry").to_pylist()], np.int64)
            take = pa.array(row)
            for at in range(0, len(row), 20_000):
                s = slice(at, at + 20_000)
                yield pa.RecordBatch.from_arrays([b.column("entry").take(take[s]), b.column("vec").take(take[s]), pa.array(cell[s], pa.int32()), pa.array(eb[s], pa.int32()), pa.array(mine[row[s]] % parts[cell[s]], pa.int32()), pa.array(np.ones(len(row[s]), bool))], names=["entry", "vec", "cell", "eb", "qb", "is_query"])

    layout = "entry string, vec binary, cell int, eb int, qb int, is_query boolean"
    asked = queries.select("entry", "vec").mapInArrow(probe, layout)

    def hold(batches):
        for b in batches:
            cell = b.column("cell").to_numpy()
            lanes = parts[cell]
            row = np.repeat(np.arange(len(cell)), lanes)
            qb = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            mine = np.array([hash_(x) if n > 1 else 0 for x, n in zip(b.column("entry").to_pylist(), lanes)], np.int64)
            eb = mine[row] // 7 % lanes[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("entry").take(take), b.column("vec").take(take), pa.array(cell[row], pa.int32()), pa.array(eb, pa.int32()), pa.array(qb, pa.int32()), pa.array(np.zeros(len(row), bool))], names=["entry", "vec", "cell", "eb", "qb", "is_query"])

    held = placed.mapInArrow(hold, layout)

    def rerank(key, group):
        is_query = group.column("is_query").to_numpy()
        q, e = group.filter(pa.array(is_query)), group.filter(pa.array(~is_query))
        empty = pa.table({"query": pa.array([], pa.string()), "entry": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        if not q.num_rows or not e.num_rows:
            return empty
        raw, ex = _matrix(q.column("vec"), dim), unit(_matrix(e.column("vec"), dim))
        qid, eid = np.array(q.column("entry").to_pylist(), object), np.array(e.column("entry").to_pylist(), object)
        e32, out = ex.astype(np.float32), []
        for at in range(0, len(raw), 1_024):
            qx = unit(raw[at : at + 1_024])
            s = qx.astype(np.float32) @ e32.T
            s[qid[at : at + 1_024, None] == eid[None, :]] = -2.0
            # single precision only shortlists: ties of the last place stay in
            low = np.full(len(s), -1.5, np.float32) if s.shape[1] <= k else np.partition(s, -k, axis=1)[:, -k] - np.float32(1e-5)
            i, j = np.nonzero(s >= np.maximum(low, np.float32(max(min_similarity, -1.2) - 1e-5))[:, None])
            if len(i):
                exact = np.round(np.einsum("ij,ij->i", qx[i], ex[j]), DIGITS)
                good = exact >= min_similarity
                out.append((qid[at + i[good]], eid[j[good]], exact[good]))
        if not out:
            return empty
        return pa.table({"query": pa.array(np.concatenate([o[0] for o in out]), pa.string()), "entry": pa.array(np.concatenate([o[1] for o in out]), pa.string()), "similarity": pa.array(np.concatenate([o[2] for o in out]))})

    first = held.unionByName(asked).groupBy("cell", "eb", "qb").applyInArrow(rerank, "query string, entry string, similarity double")
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "entry")
    ranked = lambda found: found.select("query", "entry", "similarity", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    bounds = ranked(first).where(F.col("rank") == k).select(F.col("query").alias("entry"), F.col("similarity").alias("bound"))
    bounded = queries.select("entry", "vec").join(bounds, "entry", "left").select("entry", "vec", F.coalesce("bound", F.lit(float(min_similarity))).alias("bound"))
    return ranked(_all_within(placed, bounded, fitted_counts, n_queries=queries.count(), k=k, dim=dim, block=block))


def _all_within(placed: DataFrame, queries: DataFrame, fitted, *, n_queries: int, k: int, dim: int, block: int) -> DataFrame:
    """``query, entry, similarity``: of each query all entries of at least its ``bound``, those below the ``k`` best of a bin left out.

    Bins are neighbouring cells of about ``block`` entries together, larger cells are spread over several; a query goes to the bins with
    a cell near enough. A task holds one bin and one of the lanes of queries.
    """
    index = fitted.value
    cells = np.flatnonzero(index.counts)
    # a cell of many entries has bins of its own
    parts = np.maximum(1, -(-index.counts[cells] // block))
    starts, have = [], block
    for i, count in enumerate(index.counts[cells]):
        if have + count > block:
            starts.append(i)
            have = 0
        have += count
    starts = np.array(starts)
    first_bin = np.cumsum(parts[starts]) - parts[starts]
    of_cell = np.searchsorted(starts, np.arange(len(cells)), "right") - 1
    base, split = np.zeros(len(index.counts), np.int64), np.ones(len(index.counts), np.int64)
    base[cells], split[cells] = first_bin[of_cell], parts
    lanes = max(1, -(-n_queries // (4 * block)))
    at_once = max(1, 2_000_000 // len(cells))
    layout = "entry string, vec binary, bin int, lane int, bound double"
    names = ["entry", "vec", "bin", "lane", "bound"]

    def ask(batches):
        for b in batches:
            for at in range(0, b.num_rows, at_once):
                part = b.slice(at, at_once)
                bound = part.column("bound").to_numpy()
                least = np.minimum.reduceat(fitted.value.least_distances(unit(_matrix(part.column("vec"), dim)), cells), starts, axis=1)
                # of unit vectors the squared distance is 2 - 2 * cosine
                row, group = np.nonzero(least <= (2 - 2 * bound + 1e-6)[:, None])
                more = parts[starts][group]
                row, group = np.repeat(row, more), np.repeat(first_bin[group], more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                lane = np.array([hash_(x) % lanes for x in part.column("entry").to_pylist()], np.int64)
                for s in range(0, len(row), 20_000):
                    r = row[s : s + 20_000]
                    take = pa.array(r)
                    yield pa.RecordBatch.from_arrays([part.column("entry").take(take), part.column("vec").take(take), pa.array(group[s : s + 20_000], pa.int32()), pa.array(lane[r], pa.int32()), part.column("bound").take(take)], names=names)

    def hold(batches):
        for b in batches:
            cell = b.column("cell").to_numpy()
            mine = np.array([hash_(x) if n > 1 else 0 for x, n in zip(b.column("entry").to_pylist(), split[cell])], np.int64)
            group = base[cell] + mine % split[cell]
            for lane in range(lanes):
                yield pa.RecordBatch.from_arrays([b.column("entry"), b.column("vec"), pa.array(group, pa.int32()), pa.array(np.full(len(cell), lane), pa.int32()), pa.nulls(len(cell), pa.float64())], names=names)

    def compare(key, group):
        is_query = group.column("bound").is_valid().to_numpy()
        q, e = group.filter(pa.array(is_query)), group.filter(pa.array(~is_query))
        found = [(np.zeros(0, object), np.zeros(0, object), np.zeros(0))]
        if q.num_rows and e.num_rows:
            raw, ex, bound = _matrix(q.column("vec"), dim), unit(_matrix(e.column("vec"), dim)), q.column("bound").to_numpy()
            qid, eid = np.array(q.column("entry").to_pylist(), object), np.array(e.column("entry").to_pylist(), object)
            place, e32 = {x: i for i, x in enumerate(eid)}, ex.astype(np.float32)
            for at in range(0, len(raw), 1_024):
                qx, low = unit(raw[at : at + 1_024]), (bound[at : at + 1_024] - 1e-5).astype(np.float32)
                s = qx.astype(np.float32) @ e32.T
                own = [(i, j) for i, x in enumerate(qid[at : at + 1_024]) if (j := place.get(x)) is not None]
                for i, j in own:
                    s[i, j] = -2.0
                # single precision only shortlists: ties of the last place stay in
                many = np.flatnonzero((s >= low[:, None]).sum(1) > 4 * k)
                if len(many):
                    low[many] = np.maximum(low[many], np.partition(s[many], -k, axis=1)[:, -k] - np.float32(1e-5))
                i, j = np.nonzero(s >= np.maximum(low, np.float32(-1.5))[:, None])
                exact = np.round(np.einsum("ij,ij->i", qx[i], ex[j]), DIGITS)
                good = exact >= bound[at + i]
                found.append((qid[at + i[good]], eid[j[good]], exact[good]))
        a, b, c = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query": pa.array(a, pa.string()), "entry": pa.array(b, pa.string()), "similarity": pa.array(c)})

    both = placed.mapInArrow(hold, layout).unionByName(queries.mapInArrow(ask, layout))
    return both.groupBy("bin", "lane").applyInArrow(compare, "query string, entry string, similarity double")


def hash_(text: str) -> int:
    """A small stable hash that spreads the rows of a split cell over its lanes."""
    return crc32(text.encode("utf-8", "surrogatepass"))


def is_query(node, share: int):
    """Whether a node is one of the stated queries: those whose id's md5, its first 32 bits read as a number, is divisible by ``share``."""
    return F.pmod(F.conv(F.substring(F.md5(node), 1, 8), 16, 10).cast("long"), F.lit(share)) == 0


def nearest_nodes(nodes: DataFrame, *, k: int = 5, id_col: str = "node_id", vec_col: str = "embedding", query_share: int = 1, dim: int = 64, **options) -> DataFrame:
    """``node, neighbour, similarity, rank``: the ``k`` nodes most similar to each query node, by cosine.

    With ``query_share`` m > 1 the queries are the nodes whose hashed id is divisible by m (:func:`is_query`), against all nodes. Nodes
    with equal vectors are each other's nearest, in the order of their ids, then come the nodes
    of other entries; ``k`` per node in all. Nodes without a usable vector have no rows.
    """
    vectors = cut(vectors_of(nodes, id_col=id_col, vec_col=vec_col, dim=dim))
    entries = cut(entries_of(vectors, heads=k + 1, query_share=query_share))
    near = nearest_entries(entries, entries.where("asked"), k=k, dim=dim, **options)
    # at most k neighbours with at most k + 1 nodes each
    lists = near.join(entries.select("entry", "head"), "entry").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "similarity", "head"))).alias("near"))
    flat = F.flatten(F.transform("near", lambda x: F.transform(x["head"], lambda m: F.struct(m.alias("node"), x["similarity"].alias("s")))))
    found = entries.where("asked").select("key", "entry", "head").join(lists.select(F.col("query").alias("entry"), flat.alias("outer")), "entry", "left").select("key", "head", F.coalesce("outer", F.array().cast("array<struct<node:string,s:double>>")).alias("outer"))
    rows = vectors.select("node", "key")
    if query_share > 1:
        rows = rows.where(is_query(F.col("node"), query_share))
    own = F.transform(F.filter("head", lambda m: m != F.col("node")), lambda m: F.struct(m.alias("node"), F.lit(1.0).alias("s")))
    # equal similarities are in the order of the node ids, whatever entries they are of
    best = F.slice(F.array_sort(F.transform(F.concat(own, "outer"), lambda x: F.struct((-x["s"]).alias("less"), x["node"].alias("node")))), 1, k)
    return rows.join(found, "key").select("node", F.posexplode(best).alias("i", "x")).select("node", F.col("x.node").alias("neighbour"), (-F.col("x.less")).alias("similarity"), (F.col("i") + 1).alias("rank"))


def similar_pairs(near: DataFrame, *, min_similarity: float) -> DataFrame:
    """``node_a, node_b``: pairs (node_a < node_b) of at least ``min_similarity``, one being in the other's list."""
    return near.where(F.col("similarity") >= min_similarity).select(F.least("node", "neighbour").alias("node_a"), F.greatest("node", "neighbour").alias("node_b")).distinct()


#: A wider first pass, for data where the nearest vectors aren't close at all: the second pass then has closer bounds.
HIGH_RECALL = {"visit_cells": 80, "min_visits": 1_024}
