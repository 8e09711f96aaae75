"""Approximate nearest neighbours with a forest of random-projection trees (operator 8).

A tree splits by the direction between two sample vectors, at the median of the sample. Trees are
fitted on at most ``sample`` vectors, the first by a hash of their id; every vector is indexed. A query goes
through all trees at once: one priority queue holds the branches not taken, the least certain split first, until the
leaves taken hold about ``share`` of all rows (if what trees hold overlaps by chance) and ``at_least`` rows. The vectors of
these leaves are then ranked by exact distance: rows with the leaves they are in, and queries with the leaves they took, are
packed into blocks, written once, and each pair of blocks is read in place; only the nearest of a block leave it. A row so
travels once, not once for each tree, and a task holds one block of ``block`` rows and one of ``asked`` queries (fewer of long vectors).

Vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part. Ties go to the smaller id. Fewer candidates than asked for: all of them. An empty table
gives no rows. Rows with equal ids are candidates each, but never of a query with that id; of
these the nearest counts. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.shipping import ship
from holdfast.storage import spread, written


class Tree:
    """A full binary tree in arrays: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        self.normals = np.zeros((2 ** depth - 1, sample.shape[1]))
        self.cuts = np.zeros(2 ** depth - 1)
        groups = [np.arange(len(sample))]
        for level in range(depth):
            below = []
            for k, own in enumerate(groups):
                node = 2 ** level - 1 + k
                pair = sample[rng.choice(own, 2)] if len(own) else np.zeros((2, sample.shape[1]))
                normal = pair[0] - pair[1]
                if not normal.any():  # equal vectors: any direction
                    normal = rng.normal(size=sample.shape[1])
                self.normals[node] = normal / np.linalg.norm(normal)
                along = sample[own] @ self.normals[node]
                self.cuts[node] = np.median(along) if len(own) else 0.0
                below += [own[along <= self.cuts[node]], own[along > self.cuts[node]]]
            groups = below

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            side = (vectors * self.normals[node]).sum(axis=1) > self.cuts[node]
            node = 2 * node + 1 + side
        return node - (2 ** self.depth - 1)

    def margins(self, vector: np.ndarray) -> np.ndarray:
        return self.normals @ vector - self.cuts


def probe(vector: np.ndarray, trees: list[Tree], sizes: list[np.ndarray], share: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one priority queue over all trees, until about ``share`` of the rows are held."""
    margins = [t.margins(vector) for t in trees]
    queue, taken, left, total = [(-np.inf, k, 0) for k in range(len(trees))], [], [1.0] * len(trees), sizes[0].sum()
    heapq.heapify(queue)
    while queue and np.prod(left) > 1 - share:
        doubt, k, node = heapq.heappop(queue)
        inner = len(margins[k])
        while node < inner:
            m = margins[k][node]
            near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (max(doubt, abs(m)), k, far))
            node = near
        taken.append((k, node - inner))
        left[k] -= sizes[k][node - inner] / total
    return taken


def usable(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


#: Numbers in a packed block, and of distances worked out at once.
BLOCK_CELLS, EXACT_CELLS = 1 << 19, 1 << 21


def _packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows as Arrow streams of at most so many rows each."""
    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema) as out:
            for batch in held:
                out.write_batch(batch)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["payload"])

    held: list[pa.RecordBatch] = []
    many = 0
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            if many + part.num_rows > rows:
                yield block(held)
                held, many = [], 0
            held.append(part)
            many += part.num_rows
    if held:
        yield block(held)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(rows, -1)


def _ranked(asked: pa.Table, own: pa.Table, leaves: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, distance): the ``k`` nearest ids of a block that each query reaches, by exact distance."""
    q, v = _matrix(asked["q"], len(asked)), _matrix(own["v"], len(own))
    q_ids, ids, at = asked["query_id"].to_numpy(), own["vec_id"].to_numpy(), _matrix(own["leaves"], len(own))
    reached = np.zeros((len(q), len(v)), bool)
    taken = np.zeros((len(q), at.shape[1], leaves), bool)
    lists = asked["taken"].combine_chunks()
    taken.reshape(len(q), -1)[np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
    for tree in range(at.shape[1]):
        reached |= taken[:, tree][:, at[:, tree]]
    reached &= q_ids[:, None] != ids
    with np.errstate(over="ignore", invalid="ignore"):
        far = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1) - 2 * (q @ v.T)
        if np.isfinite(far).all():
            slack = 1e-9 * ((q * q).sum(axis=1) + (v * v).sum(axis=1).max())
        else:  # squares beyond the range of doubles
            far, slack = np.stack([((v - x) ** 2).sum(axis=1) for x in q]), np.zeros(len(q))
        far[~reached] = np.inf
        # Rows of one id count once: as many more are looked at as ids are repeated.
        last = min(len(v), k + len(v) - len(np.unique(ids))) - 1
        i, j = np.nonzero(reached & (far <= (np.partition(far, last, axis=1)[:, last] + slack)[:, None]))
        step = max(1, EXACT_CELLS // v.shape[1])
        d = np.concatenate([np.zeros(0), *[np.sqrt(((v[j[n:n + step]] - q[i[n:n + step]]) ** 2).sum(axis=1)) for n in range(0, len(i), step)]])
    order = np.lexsort((d, ids[j], i))
    order = order[np.r_[True, (i[order][1:] != i[order][:-1]) | (ids[j][order][1:] != ids[j][order][:-1])][:len(order)]]
    order = order[np.lexsort((ids[j][order], d[order], i[order]))]
    first = np.searchsorted(i[order], i[order])
    order = order[np.arange(len(order)) - first < k]
    return q_ids[i[order]], ids[j[order]], d[order]


def nearest(vectors: DataFrame, queries: Column, k: int = 10, trees: int = 16, leaf: int = 256, share: float = 0.6, at_least: int = 2048,
            sample: int = 32_768, block: int = 4096, asked: int = 256, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query (rows of ``vectors`` where ``queries`` holds) its ``k`` nearest others: query_id, rank, vec_id, score."""
    ship(vectors.sparkSession)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"),
                          F.coalesce(queries, F.lit(False)).alias("asks")).where("vec_id is not null")
    usual = rows.where("size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(usable(F.col("v"), usual["d"]))
    total = rows.count()
    drawn = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not drawn:
        return vectors.sparkSession.createDataFrame([], schema)
    points = np.array([r["v"] for r in drawn])
    depth = max(0, min(int(np.ceil(np.log2(max(1, total / leaf)))), int(np.log2(max(1, len(points) / 8)))))
    rng = np.random.default_rng(seed)
    forest = [Tree(points, depth, rng) for _ in range(trees if depth else 1)]
    spread_rows = spread(rows)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            at = np.stack([t.leaves(v) for t in forest], axis=1) if batch.num_rows else np.zeros((0, len(forest)), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(forest)), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["vec_id", "v", "asks", "leaves"])

    indexed = written(spread_rows.mapInArrow(index, "vec_id long, v array<double>, asks boolean, leaves array<long>"), "forest")
    sizes = [np.zeros(2 ** depth, np.int64) for _ in forest]
    for r in indexed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():  # one row per leaf, as many as the trees have
        sizes[r["tree"]][r["leaf"]] = r["count"]
    reach = min(1 - 1e-9, max(share, at_least / total))

    rows_in, asked_in = (max(1, min(n, BLOCK_CELLS // usual["d"])) for n in (block, asked))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, asked_in):
                own = batch.slice(start, asked_in)
                q = own.column(1).flatten().to_numpy().reshape(own.num_rows, -1)
                taken = [np.array([tree << depth | at for tree, at in probe(x, forest, sizes, reach)], np.int32) for x in q]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(taken, pa.list_(pa.int32()))], ["query_id", "q", "taken"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                found = _ranked(*(pa.ipc.open_stream(x.as_buffer()).read_all() for x in (left, right)), 1 << depth, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    asking = written(indexed.where("asks").select("vec_id", "v").mapInArrow(
        lambda batches: _packed(search(batches), asked_in), "payload binary"), "asking", rows_per_file=1)
    members = written(indexed.select("vec_id", "v", "leaves").mapInArrow(
        lambda batches: _packed(batches, rows_in), "payload binary"), "members", rows_per_file=1)
    met = asking.select(F.col("payload").alias("asked")).crossJoin(members.select(F.col("payload").alias("own")))
    found = met.mapInArrow(rank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
