"""Embedding whitening by spectrum slicing (operator 13).

Entries become whole numbers (``scale`` times the entry, rounded down); equal vectors then count once. Sums per dimension
are exact; the covariance is summed up from centred vectors, part by part, in a tree. It is one matrix of
dimensions by dimensions, and its leading eigenpairs are found on the driver:

- LDLᵀ factors of covariance - s have as many positive pivots as eigenvalues lie above s (Sylvester). Bisection
  on that count isolates the k-th eigenvalue between two slices.
- Rayleigh quotient iteration from a slice's middle converges cubically. It stays if its value is within the slices,
  else the slices are narrowed and it starts again.
- Counts just above and just below the value, by what its residual allows, certify that it is the k-th.

Eigenvalues that cannot be told apart at double precision share a slice; their vectors are made orthogonal to those found before.
Components without variance (eigenvalue 0 to double precision) are left out, since nothing whitens them.

Rows whose vector is null, or holds null, NaN or infinite entries, take no part. Of vectors of several
lengths the commonest counts (the greatest on ties); the others take no part either, nor do empty vectors.
Whole numbers beyond 64 bits stop at its ends. ``deviation`` is null where 64 bits cannot hold it. Rows of equal ids are rows
of their own. An empty table, or one with a single distinct vector, gives no rows. Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.storage import small_batches, spread, written

LONG = (-(1 << 63), (1 << 63) - 1)
#: Partial sums of one matrix row that meet in one task.
FAN_IN = 64


# ------------------------------------------------------------------ eigenpairs of one matrix

def positive_pivots(matrix: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix, from its LDLᵀ factors with Bunch-Kaufman pivots."""
    a = np.array(matrix, dtype=float)
    n, at, positive = len(a), 0, 0
    limit = (1 + 17 ** 0.5) / 8
    while at < n:
        size, pivot = 1, abs(a[at, at])
        if at < n - 1:
            below = np.abs(a[at + 1:, at])
            r = int(below.argmax()) + at + 1
            largest = below.max()
            if max(pivot, largest) > 0 and pivot < limit * largest:
                row = np.abs(a[r, at:])
                row[r - at] = 0
                other = row.max()
                if pivot * other >= limit * largest ** 2:
                    pass
                elif abs(a[r, r]) >= limit * other:
                    a[[at, r]] = a[[r, at]]
                    a[:, [at, r]] = a[:, [r, at]]
                else:
                    size = 2
                    a[[at + 1, r]] = a[[r, at + 1]]
                    a[:, [at + 1, r]] = a[:, [r, at + 1]]
        if size == 1:
            d = a[at, at]
            positive += d > 0
            if d:
                column = a[at + 1:, at].copy()
                a[at + 1:, at + 1:] -= np.outer(column / d, column)
        else:
            positive += 1  # a two by two pivot has one eigenvalue of either sign
            block, columns = a[at:at + 2, at:at + 2], a[at + 2:, at:at + 2].copy()
            a[at + 2:, at + 2:] -= columns @ np.linalg.solve(block, columns.T)
        at += size
    return int(positive)


def _polished(matrix: np.ndarray, value: float, found: list[np.ndarray], rng: np.random.Generator) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration from ``value``: eigenvalue, unit vector, norm of the residual."""
    basis = np.array(found).reshape(-1, len(matrix))

    def unit(v):
        for _ in range(2):
            v = v - basis.T @ (basis @ v)
        return v / np.linalg.norm(v)

    tiny = np.finfo(float).eps * np.linalg.norm(matrix)
    best, shift = (value, unit(rng.normal(size=len(matrix))), np.inf), value
    for step in range(30):
        for nudge in (0.0, tiny, 4 * tiny):  # a shift that is an eigenvalue to the last bit cannot be solved for
            try:
                grown = np.linalg.solve(matrix - (shift + nudge) * np.eye(len(matrix)), best[1])
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(grown).all() and grown.any():
                break
        else:
            break
        v = unit(grown / np.abs(grown).max())
        quotient = float(v @ matrix @ v)
        residual = float(np.linalg.norm(matrix @ v - quotient * v))
        better = residual < best[2]
        if better:
            best = (quotient, v, residual)
        if step >= 2:  # the first steps stay at the slice's middle, so that its own eigenvector comes to lead
            shift = quotient
            if not better or residual <= tiny:
                break
    return best


@dataclass(frozen=True)
class Component:
    value: float
    vector: np.ndarray
    residual: float


def leading(matrix: np.ndarray, many: int) -> list[Component]:
    """The eigenpairs of the ``many`` largest positive eigenvalues, falling; each certified by counts."""
    n = len(matrix)
    reach = float(np.abs(matrix).sum(axis=1).max(initial=0))  # no eigenvalue is larger
    least = reach * n * np.finfo(float).eps
    out: list[Component] = []
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = positive_pivots(matrix - shift * np.eye(n))
        return counts[shift]

    rng = np.random.default_rng(0)
    for k in range(1, min(many, n) + 1):
        if not reach or above(least) < k:
            break
        # the k-th eigenvalue lies in (low, high]
        low = max([s for s, c in counts.items() if c >= k], default=0.0)
        high = min([s for s, c in counts.items() if c < k], default=reach + least)
        while True:
            alone = above(low) == k and above(high) == k - 1
            close = high - low <= 4 * least
            if alone or close:
                value, vector, residual = _polished(matrix, (low + high) / 2, [c.vector for c in out], rng)
                room = residual + least
                if low - room <= value <= high + room and above(value + room) < k <= above(value - room):
                    out.append(Component(value, vector, residual))
                    break
                if close:
                    raise ArithmeticError(f"eigenvalue {k} cannot be certified between {low} and {high}")
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= k else (low, middle)
    return out


# ------------------------------------------------------------------ sums over rows

def _entries(batch: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list array: which rows are sound, all entries, and where each row's start."""
    lists = batch.cast(pa.large_list(pa.float64()))
    null = np.asarray(lists.is_null())
    offsets = np.asarray(lists.offsets)
    values = lists.values.to_numpy(zero_copy_only=False)  # null entries come as NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    sound = ~null & (bad[offsets[1:]] == bad[offsets[:-1]])
    return sound, values, offsets


def _rounded(values: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(scale * values)
    out = np.clip(x, -2.0 ** 63, 2.0 ** 63 - 1024).astype(np.int64)
    out[x >= 2.0 ** 63] = LONG[1]
    return out


def vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Rows with sound vectors: id, size (entries), x (whole numbers, 8 bytes each)."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = rows.select("id", F.lit(0).alias("size"), F.lit(b"").alias("x")).schema

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sound, values, offsets = _entries(batch.column(1))
            at = np.flatnonzero(sound & (np.diff(offsets) > 0))
            x = _rounded(values, scale)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at)), pa.array(np.diff(offsets)[at].astype(np.int32)),
                pa.array([x[offsets[i]:offsets[i + 1]].tobytes() for i in at], pa.binary())], names=["id", "size", "x"])

    return spread(rows).mapInArrow(convert, schema)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dims)


def summed(parts: DataFrame) -> DataFrame:
    """(row, part, values) added up by row: in a first step the parts of one remainder, then all."""
    schema = "row int, part long, values array<double>"

    def add(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("part")
        rows = ordered["values"].combine_chunks()
        total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
        return pa.table({"row": table["row"][:1].cast(pa.int32()), "part": pa.array([0], pa.int64()),
                         "values": pa.array([total.tolist()], pa.list_(pa.float64()))})

    folded = parts.withColumn("part", F.col("part") % FAN_IN)
    first = folded.groupBy("row", "part").applyInArrow(lambda key, t: add(t).set_column(1, "part", pa.array([key[1].as_py()], pa.int64())), schema)
    return first.groupBy("row").applyInArrow(add, schema)


def moments(fit: DataFrame, dims: int, centre: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Sum of zzᵀ over the fit list, z = x - centre, or its projections; a last row holds the sum of z."""
    width = dims if project is None else project.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, one = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            z = _matrix(batch.column(0), dims) - centre
            z = z if project is None else z @ project
            total += z.T @ z
            one += z.sum(axis=0)
        number = TaskContext.get().partitionId()
        rows = np.vstack([total, one])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(width + 1), pa.int32()), pa.array([number] * (width + 1), pa.int64()),
            pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["row", "part", "values"])

    got = summed(fit.select("x").mapInArrow(part, "row int, part long, values array<double>"))
    out = np.zeros((width + 1, width))
    for r in got.collect():  # one row per dimension
        out[r["row"]] = r["values"]
    return out


def totals(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Exact: vectors, sums per dimension, and the largest magnitude of an entry."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, high, low = 0, 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n += len(x)
            most = max(most, int(x.max(initial=0)), -int(x.min(initial=0)))
            high += (x >> 32).sum(axis=0)  # halves: their sums stay within 64 bits
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([str(most)] * dims),
            pa.array(high), pa.array(low)], names=["row", "n", "most", "high", "low"])

    parts = fit.select("x").mapInArrow(part, "row int, n long, most string, high long, low long")
    got = parts.groupBy("row").agg(
        F.sum("n").alias("n"), F.max(F.col("most").cast("decimal(20,0)")).alias("most"),
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    sums = {r["row"]: (int(r["high"]) << 32) + int(r["low"]) for r in got}
    return int(got[0]["n"]), [sums[i] for i in range(dims)], int(max(r["most"] for r in got))


# ------------------------------------------------------------------ whitening

@dataclass(frozen=True)
class Whitening:
    """What is learned: one matrix's worth of numbers."""

    dims: int
    n: int
    sums: list[int]
    most: int
    variances: float
    components: list[Component]
    identity_error: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)², in whole numbers; None beyond 64 bits."""
        furthest = self.n * self.most + max(abs(s) for s in self.sums)
        if self.dims * furthest ** 2 <= LONG[1]:
            gap = self.n * x - np.array(self.sums, np.int64)
            return (gap * gap).sum(axis=1).tolist()
        gap = self.n * x.astype(object) - np.array(self.sums, object)
        return [int(d) if d <= LONG[1] else None for d in (gap * gap).sum(axis=1)]


def _directions(components: list[Component]) -> np.ndarray:
    return np.array([c.vector / np.sqrt(c.value) for c in components]).T


def fit(rows: DataFrame, many: int) -> Whitening | None:
    """Learned from the distinct vectors of ``rows`` (see vectors); None where there is nothing to learn."""
    lengths = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return None
    dims = lengths["size"]
    distinct = written(rows.where(F.col("size") == dims).select("x").distinct(), "fit-list")
    n, sums, most = totals(distinct, dims)
    centre = np.array([s / n for s in sums])
    covariance = moments(distinct, dims, centre)[:dims] / n
    covariance = (covariance + covariance.T) / 2
    components = leading(covariance, many)
    if not components:
        return None
    white = moments(distinct, dims, centre, _directions(components)) / n
    error = np.abs(white[:-1] - np.outer(white[-1], white[-1]) - np.eye(len(components))).max()
    return Whitening(dims, n, sums, most, float(np.trace(covariance)), components, float(error))


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", many: int = 4, scale: float = 256.0) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    small_batches(table.sparkSession)
    rows = vectors(table, id_col, vector_col, scale)
    learned = fit(rows, many)
    kinds = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = T.StructType([T.StructField("vec_id", rows.schema["id"].dataType), *T.StructType.fromDDL(kinds)])
    if learned is None:
        return table.sparkSession.createDataFrame([], schema)
    centre, directions = learned.centre, _directions(learned.components)
    explained = [c.value / learned.variances for c in learned.components]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(explained)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), learned.dims)
            white = (x - centre) @ directions
            each = np.repeat(np.arange(len(x)), width)
            deviation = pa.array(learned.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, width + 1), len(x)), pa.int32()),
                pa.array(np.full(len(each), learned.n)), deviation.take(pa.array(each)), pa.array(white.ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), learned.identity_error))], schema.names)

    return rows.where(F.col("size") == learned.dims).select("id", "x").mapInArrow(project, schema)
