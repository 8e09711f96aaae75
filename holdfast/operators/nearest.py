"""Exact nearest-neighbour similarity join on unit vectors.

For every query row: the base row with the highest cosine, or the highest one at or
above a floor. Nothing is sampled and no candidate is dropped, yet no task ever holds
more than one block of each side and pairs are never written out:

1. A bounded sample of base rows become pivots. Every base row belongs to the cell of
   its closest pivot.
2. Each query row is first compared with its own cell, which gives it a good bound.
3. It then visits only those other cells that can still hold something better. A cell
   is ruled out by geometry: a base row at angle <= a from the query cannot lie beyond
   the plane half-way between two pivots by more than sin(a), nor farther from its
   pivot than the cell's own radius.
4. Neighbouring cells are put together in groups of about a block, and a query travels once
   to a group, with the cells it visits there. A hot cell is cut into blocks by row hash, so it
   is spread over many tasks. A task works on slices of its block pair, each one matrix product;
   only the best base row per query leaves it.
5. Long rows do not travel once per block pair: beyond some bytes of copies both sides are packed into blocks, written once,
   and the pairs of blocks that may hold something read them in place.

Short sparse rows under a floor go through an inverted index of their rarest terms instead, where a count of its
postings says that this is cheaper (see prefixes).

Long sparse rows (text n-grams) are first compared by a short sketch: the norm of the
row within each of ``SKETCH_WIDTH`` term buckets. By Cauchy-Schwarz the product of two
sketches is never below the true cosine, so it can rule pairs and cells out; survivors
are compared on all terms. A coarser sketch of ``COARSE_WIDTH`` buckets goes first: where little of a
row's weight is text, it is enough.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.storage import small_batches, written

SKETCH_WIDTH, COARSE_WIDTH = 2048, 64
#: Rows of either side in one matrix product, and terms of a side's rows in it.
SLICE, SLICE_TERMS = 2048, 1_500_000
#: Terms of the rows whose sketches are made at once.
SKETCH_TERMS = 500_000
#: Blocks of up to so many rows, of so many terms each or more, are sketched once; of a task's base blocks so many rows stay.
SKETCHED_ROWS, LONG_TERMS, HELD_ROWS = 4096, 100, 8192
#: Term numbers below this travel as 16-bit numbers.
SHORT_TERMS = 1 << 15
SIM_DECIMALS = 6
PARTS = ("dense", "terms", "weights", "scale")
# Similarities closer than this may round to the same value; bounds allow for it.
SLACK = 2e-6


@dataclass(frozen=True)
class BlockPlan:
    """Size limits. They steer cost only; the result is the same for any of them."""

    one_cell_rows: int = 2048        # base sides up to this size are a single cell
    max_pivots: int = 1024
    pivot_bytes: int = 64 << 20      # pivots travel to every task
    block_bytes: int = 64 << 20      # of rows as they travel
    max_block_rows: int = 65_536

    def pivots(self, rows: int, width: int) -> int:
        if rows <= self.one_cell_rows:
            return 1
        fits = max(1, self.pivot_bytes // (4 * max(width, 1)))
        return int(min(self.max_pivots, fits, math.isqrt(rows)))

    least_block_rows: int = 256
    long_row_bytes: int = 2_000      # rows from this size on are long: smaller blocks, and few copies
    long_block_bytes: int = 16 << 20
    copied_bytes: int = 128 << 20    # of long rows that travel for a search; beyond that blocks are read in place
    # The prefix index is taken when its postings meet in at most this share of all pairs.
    index_share: float = 0.02

    def block_rows(self, row_bytes: float, q_rows: int, b_rows: int, cores: int) -> int:
        """Rows per block: as many as fit, since every row travels to each block of the other side;
        fewer when that leaves cores without work."""
        fits = max(1, min(self.max_block_rows, self.block_bytes // max(row_bytes, 1)))
        share = max(self.least_block_rows, math.isqrt(q_rows * b_rows // (4 * cores)))
        return int(min(fits, share))


# --------------------------------------------------------------- Arrow helpers

def _ragged(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return offsets - offsets[0], values[offsets[0]:offsets[-1]]


def _step(cells: int, rows: int, terms: int) -> int:
    """Rows with about so many terms."""
    return int(max(1, min(rows, cells * rows // max(terms, 1))))


class _Vectors:
    """Rows of one Arrow block: a dense part and a ragged sparse part.

    With an ``idf`` the ragged values are term counts; they become weights here, so that
    rows travel with small integers.
    """

    def __init__(self, dense, terms, weights, scale=None, idf: np.ndarray | None = None):
        offsets, flat = _ragged(dense)
        n = len(offsets) - 1
        at, ids = _ragged(terms)
        self._set(flat.reshape(n, -1) if n and len(flat) else np.zeros((n, 0)), at, ids, _ragged(weights)[1],
                  None if scale is None else np.asarray(scale), idf)

    def _set(self, dense, offsets, terms, weights, scale, idf) -> None:
        self.n, self.dense, self.offsets, self.terms, self.weights = len(dense), dense, offsets, terms, weights
        self.sparse = len(self.terms) > 0
        if idf is not None:
            row = np.repeat(np.arange(self.n), np.diff(self.offsets))
            w = idf[self.terms] * self.weights
            norm = np.sqrt(np.bincount(row, weights=w * w, minlength=self.n))
            self.weights = w / norm[row] * scale[row]

    def rows(self, lo: int, hi: int) -> "_Vectors":
        part = object.__new__(_Vectors)
        at = self.offsets[lo:hi + 1]
        part._set(self.dense[lo:hi], at - at[0], self.terms[at[0]:at[-1]], self.weights[at[0]:at[-1]], None, None)
        return part

    def filter_matrix(self, sparse: bool, width: int = SKETCH_WIDTH) -> np.ndarray:
        """Rows whose products are never below the true cosines (equal to them if dense)."""
        if not sparse:
            return self.dense
        out = np.empty((self.n, self.dense.shape[1] + width), np.float32)
        out[:, :self.dense.shape[1]] = self.dense
        step = _step(SKETCH_TERMS, self.n, len(self.terms))
        for lo in range(0, self.n, step):
            at = self.offsets[lo:lo + step + 1]
            n, mine = len(at) - 1, slice(at[0], at[-1])
            row = np.repeat(np.arange(n) * width, np.diff(at))
            mass = np.bincount(row + self.terms[mine] % width, weights=self.weights[mine] ** 2, minlength=n * width)
            np.sqrt(mass.reshape(n, width), out=out[lo:lo + step, self.dense.shape[1]:])
        return out

    @cached_property
    def coarse(self) -> np.ndarray:
        return self.filter_matrix(True, COARSE_WIDTH)

    @cached_property
    def fine(self) -> np.ndarray:
        return self.filter_matrix(True)

    @property
    def width(self) -> int:
        return int(self.terms.max(initial=-1)) + 1

    @property
    def terms_per_row(self) -> float:
        return len(self.terms) / max(self.n, 1)

    def weighed(self, at: np.ndarray) -> tuple["_Vectors", np.ndarray]:
        """Weighed rows and where among them the rows ``at`` are."""
        return self, at


class _Rows:
    """Rows of a block as they travelled; only those taken are unpacked and weighed."""

    def __init__(self, table: pa.Table, idf: np.ndarray | None):
        offsets, flat = _ragged(table["dense"])
        self.n, self.idf = table.num_rows, idf
        self.dense = flat.reshape(self.n, -1) if self.n and len(flat) else np.zeros((self.n, 0))
        self.packed = table[PACKED].combine_chunks() if PACKED in table.column_names else None
        if self.packed is not None:
            self.offsets = np.r_[0, np.cumsum(self.packed.field("many").to_numpy(zero_copy_only=False), dtype=np.int64)]
        else:
            self.offsets, self.terms = _ragged(table["terms"])
            self.weights = _ragged(table["weights"])[1]
        self.scale = table["scale"].to_numpy()

    def take(self, at: np.ndarray) -> _Vectors:
        out = object.__new__(_Vectors)
        if self.packed is not None:
            out._set(self.dense[at], *_unpacked(self.packed.take(pa.array(at, pa.int64()))), self.scale[at], self.idf)
            return out
        many = np.diff(self.offsets)[at]
        offsets = np.r_[0, np.cumsum(many)]
        cells = np.repeat(self.offsets[at] - offsets[:-1], many) + np.arange(offsets[-1])
        out._set(self.dense[at], offsets, self.terms[cells], self.weights[cells], self.scale[at], self.idf)
        return out

    def part(self, at: np.ndarray) -> "_Vectors | _Part":
        """These rows; of a block of long rows their sketches only."""
        long = self.idf is not None and self.n <= SKETCHED_ROWS and self.offsets[-1] >= LONG_TERMS * self.n
        return _Part(self, at) if long and self.n else self.take(at)

    @cached_property
    def fine(self) -> np.ndarray:
        out = np.empty((self.n, self.dense.shape[1] + SKETCH_WIDTH), np.float32)
        step = _step(SKETCH_TERMS, self.n, self.offsets[-1])
        for lo in range(0, self.n, step):
            out[lo:lo + step] = self.take(np.arange(lo, min(self.n, lo + step))).filter_matrix(True)
        return out

    @cached_property
    def coarse(self) -> np.ndarray:
        """A coarse bucket is every COARSE_WIDTH-th of the fine ones."""
        dims = self.dense.shape[1]
        mass = np.square(self.fine[:, dims:]).reshape(self.n, -1, COARSE_WIDTH).sum(axis=1)
        return np.hstack([self.fine[:, :dims], np.sqrt(mass)])


class _Part:
    """Rows of a block that are known by their sketches, made once for the block, until they are weighed."""

    def __init__(self, rows: _Rows, at: np.ndarray):
        self.rows, self.at, self.n, self.dense = rows, at, len(at), rows.dense[at]
        self.sparse, self.width, self.terms_per_row = True, len(rows.idf), rows.offsets[-1] / rows.n

    @cached_property
    def coarse(self) -> np.ndarray:
        return self.rows.coarse[self.at]

    @cached_property
    def fine(self) -> np.ndarray:
        return self.rows.fine[self.at]

    def weighed(self, at: np.ndarray) -> tuple[_Vectors, np.ndarray]:
        used, where = np.unique(at, return_inverse=True)
        return self.rows.take(self.at[used]), where


def _width(q: _Vectors, b: _Vectors) -> int:
    return max(q.width, b.width)


def _cosines_of(q: _Vectors | _Part, b: _Vectors | _Part, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """See _pair_cosines."""
    mine, i = q.weighed(i)
    theirs, j = b.weighed(j)
    return _pair_cosines(mine, theirs, i, j)


def _pair_cosines(q: _Vectors, b: _Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact cosines of the pairs (i[k], j[k]); i must be sorted."""
    out = np.einsum("kd,kd->k", q.dense[i], b.dense[j]) if q.dense.shape[1] else np.zeros(len(i))
    if not (q.sparse and b.sparse and len(i)):
        return out
    room = np.zeros(_width(q, b))
    ends = np.flatnonzero(np.r_[i[1:] != i[:-1], True]) + 1
    many = np.diff(b.offsets)
    lo = 0
    for hi in ends:
        mine = slice(q.offsets[i[lo]], q.offsets[i[lo] + 1])
        room[q.terms[mine]] = q.weights[mine]
        terms = many[j[lo:hi]]
        if hi - lo > 8 and 0 < terms.sum() < 300 * (hi - lo):  # short rows: all of the query's together
            ends_at = np.cumsum(terms)
            at = np.repeat(b.offsets[j[lo:hi]] - ends_at + terms, terms) + np.arange(ends_at[-1])
            owner = np.repeat(np.arange(hi - lo), terms)
            out[lo:hi] += np.bincount(owner, weights=room[b.terms[at]] * b.weights[at], minlength=hi - lo)
            room[q.terms[mine]] = 0.0
            lo = hi
            continue
        for k in range(lo, hi):
            theirs = slice(b.offsets[j[k]], b.offsets[j[k] + 1])
            out[k] += room[b.terms[theirs]] @ b.weights[theirs]
        room[q.terms[mine]] = 0.0
        lo = hi
    return out


def _all_cosines(q: _Vectors, b: _Vectors, columns: int = 4096) -> np.ndarray:
    """Cosine of every pair of the block in single precision, a slice of terms at a time."""
    out = (q.dense @ b.dense.T).astype(np.float32)
    for lo in range(0, _width(q, b), columns):
        sides = []
        for v in (q, b):
            at = np.flatnonzero((v.terms >= lo) & (v.terms < lo + columns))
            m = np.zeros((v.n, columns), np.float32)
            m[np.searchsorted(v.offsets, at, side="right") - 1, v.terms[at] - lo] = v.weights[at]
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _one_by_one(pairs: int, b: _Vectors | _Part) -> float:
    """Nanoseconds of so many single comparisons, as measured; only the time depends on these figures."""
    return pairs * (3_000 + 3 * b.terms_per_row)


def _best_pairs(q: _Vectors | _Part, b: _Vectors | _Part, bound: np.ndarray, one: bool = False):
    """Per query row with a partner at or above its bound: (row, base row, cosine).

    Base rows come in tie-break order, so the lowest index wins among equal cosines. With ``one``, only
    rows that may hold the best pair of all are wanted: what any row has reached is a bound for the others.
    """
    sparse = q.sparse and b.sparse
    slack = SLACK + (1e-5 if sparse else 0.0)
    need = bound

    def raised(reached: np.ndarray) -> np.ndarray:
        return np.maximum(need, reached.max() if one else reached)

    def possible(upper: np.ndarray) -> np.ndarray:
        return upper >= (need - slack)[:, None]

    def first(upper: np.ndarray) -> np.ndarray:
        """The partner with the highest upper bound gives each row that may still have one a real cosine to beat."""
        partner, reached = upper.argmax(axis=1), np.full(q.n, -np.inf)
        open_ = np.flatnonzero(upper[np.arange(q.n), partner] >= need - slack)
        reached[open_] = _cosines_of(q, b, open_, partner[open_])
        return reached

    if sparse:
        upper = q.coarse @ b.coarse.T
        if isinstance(q, _Vectors) and isinstance(b, _Vectors):  # else rows are better weighed after the fine sketch
            need = raised(first(upper))
        if _one_by_one(np.count_nonzero(possible(upper)), b) > q.n * b.n * SKETCH_WIDTH * 0.06:
            upper = q.fine @ b.fine.T
            need = raised(first(upper))
            together = q.n * b.n * _width(q, b) * 0.04 + 60 * (q.n * q.terms_per_row + b.n * b.terms_per_row)
            if _one_by_one(np.count_nonzero(possible(upper)), b) > together:
                upper = _all_cosines(q.weighed(np.arange(q.n))[0], b.weighed(np.arange(b.n))[0])
                need = raised(upper.max(axis=1) - slack)
    else:
        upper = q.filter_matrix(False) @ b.filter_matrix(False).T
        need = raised(upper.max(axis=1))
    i, j = np.nonzero(possible(upper))
    cosine = np.round(_cosines_of(q, b, i, j) if sparse else upper[i, j], SIM_DECIMALS)
    order = np.lexsort((j, -cosine, i))
    i, j, cosine = i[order], j[order], cosine[order]
    lead = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, int)
    keep = lead[cosine[lead] >= bound[i[lead]]]
    return i[keep], j[keep], cosine[keep]


class _Found:
    """The best partner of every query row so far; equal cosines go to the base row that comes first."""

    def __init__(self, bound: np.ndarray, one: bool = False):
        self.bound, self.one = bound.astype(float), one
        self.partner, self.cosine = np.full(len(bound), -1), np.full(len(bound), -np.inf)

    def add(self, i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> None:
        """i: each query row once at most; j: places of base rows in tie-break order."""
        better = (cosine > self.cosine[i]) | ((cosine == self.cosine[i]) & (j < self.partner[i]))
        i, j, cosine = i[better], j[better], cosine[better]
        self.partner[i], self.cosine[i] = j, cosine
        self.bound[i] = np.maximum(self.bound[i], cosine)
        if self.one and len(cosine):
            self.bound = np.maximum(self.bound, cosine.max())


def _search_cells(left: pa.Table, right: pa.Table, q: _Rows, b: _Rows, order: np.ndarray, found: _Found) -> None:
    """Query rows against the cells they visit, slice by slice; small cells that lie next to each other are visited
    together. ``order``: base rows in tie-break order."""
    at, visited = _ragged(left["cells"])
    owner = np.repeat(np.arange(q.n), np.diff(at))
    cells, cell, many = np.unique(right["cell"].to_numpy()[order], return_inverse=True, return_counts=True)
    held = np.isin(visited, cells)
    unit = _grouped(many, SLICE)
    visit, row = np.divmod(np.unique(unit[np.searchsorted(cells, visited[held])] * q.n + owner[held]), q.n)
    for u in np.unique(visit):
        rows, places = row[visit == u], np.flatnonzero(unit[cell] == u)
        many_q, many_b = (min(SLICE, _step(SLICE_TERMS, v.n, int(v.offsets[-1]))) for v in (q, b))
        for lo in range(0, len(rows), many_q):
            some = rows[lo:lo + many_q]
            mine = q.part(some)
            for start in range(0, len(places), many_b):
                theirs = places[start:start + many_b]
                i, j, cosine = _best_pairs(mine, b.part(order[theirs]), found.bound[some], found.one)
                found.add(some[i], theirs[j], cosine)


# --------------------------------------------------------------- pivots and cells

@dataclass
class _Cells:
    """The pivots and, per cell, how many base rows it has and how wide it is."""

    pivots: np.ndarray
    sparse: bool
    idf: np.ndarray | None = None
    rows: np.ndarray | None = None
    radius: np.ndarray | None = None
    groups: np.ndarray | None = None  # of cells that travel together

    @cached_property
    def between(self) -> np.ndarray:
        return np.clip(self.pivots.astype(float) @ self.pivots.T.astype(float), -1, 1)

    def closeness(self, v: _Vectors) -> np.ndarray:
        return np.clip(v.filter_matrix(self.sparse) @ self.pivots.T, -1.0, 1.0)

    def home(self, v: _Vectors):
        close = self.closeness(v)
        cell = close.argmax(axis=1)
        return cell, close[np.arange(v.n), cell].astype(float)

    def best_possible(self, v: _Vectors) -> np.ndarray:
        """Per row and cell, a cosine that no base row of that cell exceeds; -2 for home and empty cells."""
        close = self.closeness(v).astype(float)
        home = close.argmax(axis=1)
        margin = 1e-4  # single-precision products, both sides
        gap = np.maximum(0.0, close[np.arange(v.n), home][:, None] - close - margin)
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * self.between))[home]
        past = np.arcsin(np.clip(np.divide(gap, apart, out=np.zeros_like(gap), where=apart > 0), 0, 1))
        outside = np.arccos(np.clip(close, -1, 1)) - self.radius - math.sqrt(2 * margin)
        out = np.cos(np.maximum(past, np.clip(outside, 0, math.pi)))
        out[:, self.rows == 0] = -2.0
        out[np.arange(v.n), home] = -2.0
        return out

    def to_visit(self, v: _Vectors, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): cells other than home that can hold a base row at or above the row's bound."""
        close = self.closeness(v).astype(float)
        home = close.argmax(axis=1)
        gap = close[np.arange(v.n), home][:, None] - close
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * self.between))[home]
        reach = np.arccos(np.clip(bound, -1.0, 1.0))[:, None]
        wide = reach >= math.pi / 2
        margin = 1e-4  # single-precision products, both sides
        near = wide | (gap <= np.sin(np.minimum(reach, math.pi / 2)) * apart + margin)
        inside = np.arccos(np.clip(close, -1, 1)) <= self.radius + reach + math.sqrt(2 * margin)
        ok = near & inside & (self.rows > 0)
        ok[np.arange(v.n), home] = False
        return np.nonzero(ok)


def _home_of(cells: _Cells):
    kind = "struct<cell:int,closeness:double>"

    @F.arrow_udf(kind)
    def home(dense: pa.Array, terms: pa.Array, weights: pa.Array, scale: pa.Array) -> pa.Array:
        cell, close = cells.home(_Vectors(dense, terms, weights, scale, cells.idf))
        return pa.StructArray.from_arrays(
            [pa.array(cell, pa.int32()), pa.array(close, pa.float64())], ["cell", "closeness"])

    return home(*PARTS)


def _visits_of(cells: _Cells):
    """Per row the cells to visit, by group: array of (group, cells)."""
    @F.arrow_udf("array<struct<group:int,cells:array<int>>>")
    def visits(dense: pa.Array, terms: pa.Array, weights: pa.Array, scale: pa.Array, bound: pa.Array) -> pa.Array:
        v = _Vectors(dense, terms, weights, scale, cells.idf)
        row, cell = cells.to_visit(v, bound.to_numpy(zero_copy_only=False))
        group = cells.groups[cell]  # rising with the cell
        lead = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])]) if len(row) else np.empty(0, int)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[lead, len(row)], pa.int32()), pa.array(cell, pa.int32()))
        each = pa.StructArray.from_arrays([pa.array(group[lead], pa.int32()), lists], ["group", "cells"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[lead], np.arange(v.n + 1)), pa.int32()), each)

    return visits(*PARTS, "bound")


def _possible_of(cells: _Cells):
    """Per row the cells and what they may hold at most: array of (group, cell, most), for those that may beat ``bound``."""
    @F.arrow_udf("array<struct<group:int,cell:int,most:double>>")
    def possible(dense: pa.Array, terms: pa.Array, weights: pa.Array, scale: pa.Array, bound: pa.Array) -> pa.Array:
        most = cells.best_possible(_Vectors(dense, terms, weights, scale, cells.idf))
        row, cell = np.nonzero(most >= bound.to_numpy(zero_copy_only=False)[:, None] - SLACK)
        pairs = pa.StructArray.from_arrays(
            [pa.array(cells.groups[cell], pa.int32()), pa.array(cell, pa.int32()), pa.array(most[row, cell])], ["group", "cell", "most"])
        offsets = np.searchsorted(row, np.arange(len(most) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)

    return possible(*PARTS, "bound")


def _choose_pivots(base: DataFrame, plan: BlockPlan, rows: int, width: int, sparse: bool,
                   idf: np.ndarray | None) -> _Cells:
    k = plan.pivots(rows, width)
    if k == 1:
        picked = base.limit(1)
    else:
        # rank by hash; the pre-filter keeps each task's share of the ranking small
        share = min(1.0, 8 * k / rows)
        mark = F.xxhash64("key")
        picked = base.where(F.pmod(mark, F.lit(1 << 20)) < math.ceil(share * (1 << 20))) \
            .orderBy(mark, "key").limit(k)
    block = picked.select(*PARTS).toArrow()  # at most max_pivots rows
    pivots = _Vectors(*[block[c] for c in PARTS], idf).filter_matrix(sparse)
    return _Cells(pivots[_chain(pivots)], sparse, idf)


def _chain(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order that keeps close ones together: each followed by the closest one left."""
    out, left = [0], np.arange(len(pivots)) > 0
    while left.any():
        close = np.where(left, pivots @ pivots[out[-1]], -np.inf)
        out.append(int(close.argmax()))
        left[out[-1]] = False
    return np.array(out)


def _grouped(rows: np.ndarray, block: int) -> np.ndarray:
    """The group of every cell: neighbours together while they fit into a block, larger cells alone."""
    out, held, group = np.zeros(len(rows), np.int64), 0, 0
    for c, n in enumerate(rows):
        if held and held + n > block:
            held, group = 0, group + 1
        out[c], held = group, held + n
    return out


def _per_group(df: DataFrame, size: int) -> np.ndarray:
    """Rows per group; at most max_pivots numbers."""
    out = np.zeros(size, dtype=np.int64)
    for r in df.groupBy("group").agg(F.count("*").alias("n")).collect():
        out[r["group"]] = r["n"]
    return out


# --------------------------------------------------------------- rows packed into blocks

PACKED = "packed"


def _packed_of():
    """Terms and counts of a row in few bytes: steps between rising term numbers and counts, byte plane by byte plane."""
    @F.arrow_udf("struct<many:int,bytes:binary>")
    def pack(terms: pa.Array, counts: pa.Array) -> pa.Array:
        codec = pa.Codec("zstd", 1)
        at, ids = _ragged(terms)
        times = _ragged(counts)[1]
        steps = np.diff(ids.astype("<u4"), prepend=np.uint32(0))
        first = at[:-1][np.diff(at) > 0]
        steps[first] = ids[first]
        planes = np.vstack([x.astype("<u4").view(np.uint8).reshape(-1, 4).T for x in (steps, times)])
        each = [codec.compress(planes[:, lo:hi].tobytes(), asbytes=True) for lo, hi in zip(at[:-1], at[1:])]
        return pa.StructArray.from_arrays([pa.array(np.diff(at), pa.int32()), pa.array(each, pa.binary())], ["many", "bytes"])

    return pack("terms", "weights")


def _unpacked(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, terms and counts of packed rows."""
    codec = pa.Codec("zstd", 1)
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    many = rows.field("many").to_numpy(zero_copy_only=False)
    offsets = np.r_[0, np.cumsum(many, dtype=np.int64)]
    terms, counts = (np.empty(offsets[-1], np.int32) for _ in range(2))
    for n, lo, packed in zip(many.tolist(), offsets.tolist(), rows.field("bytes")):
        if not n:
            continue
        plane = np.frombuffer(codec.decompress(packed.as_buffer(), 8 * n), np.uint8).reshape(8, n)
        for out, four in ((terms, plane[:4]), (counts, plane[4:])):
            out[lo:lo + n] = np.ascontiguousarray(four.T).view("<u4").ravel()
        np.cumsum(terms[lo:lo + n], out=terms[lo:lo + n])
    return offsets, terms, counts


def _blocks(rows: DataFrame, cuts: np.ndarray, names: list[str], name: str) -> DataFrame:
    """Rows with a ``group``, packed into a written table of blocks: group, groups (those its rows visit), payload.

    A group goes into so many blocks, by hash.
    """
    rows = rows.withColumn(PACKED, _packed_of())
    cut = F.get(F.array(*[F.lit(int(c)) for c in np.maximum(cuts, 1)]), F.col("group"))
    rows = rows.select("group", F.pmod(F.xxhash64("key"), cut).cast("int").alias("cut"), "dense", PACKED, "scale", *names)

    def pack(block: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        some = block.drop_columns(["group", "cut"]).combine_chunks()
        with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(some)
        groups = pc.unique(pc.list_flatten(block["groups"])) if "groups" in names else block["group"].combine_chunks()[:1]
        return pa.table({
            "group": block["group"].combine_chunks()[:1], "groups": pa.array([groups.to_pylist()], pa.list_(pa.int32())),
            "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    packed = rows.groupBy("group", "cut").applyInArrow(pack, "group int, groups array<int>, payload binary")
    return written(packed, name, rows_per_file=8)


def _pair_schema(base: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_key", T.StringType()), T.StructField("base_key", T.StringType()),
        T.StructField("ref", base.schema["ref"].dataType), T.StructField("similarity", T.DoubleType())])


def _compared(left: pa.Table, right: pa.Table, idf: np.ndarray | None, search: Callable[..., None], one: bool,
              rows: tuple[_Rows, _Rows] | None = None) -> pa.Table:
    """The best base row per query of a block pair. ``rows``: both sides, where they are at hand."""
    order = np.empty(0, int)
    found = _Found(left["bound"].to_numpy(), one)
    if left.num_rows and right.num_rows:
        order = pc.sort_indices(right.select(["ref", "key"]), sort_keys=[("ref", "ascending"), ("key", "ascending")]).to_numpy()
        search(left, right, *(rows or (_Rows(left, idf), _Rows(right, idf))), order, found)
    i = np.flatnonzero(found.partner >= 0)
    j = pa.array(order[found.partner[i]] if len(i) else i, pa.int64())
    return pa.table({
        "query_key": left["key"].take(pa.array(i, pa.int64())),
        "base_key": right["key"].take(j),
        "ref": right["ref"].take(j),
        "similarity": pa.array(found.cosine[i], pa.float64()),
    })


def _in_place(q_blocks: DataFrame, b_blocks: DataFrame, out: T.StructType, idf: np.ndarray | None, one: bool) -> DataFrame:
    """The best base row per query and pair of written blocks; a block is read for each block of the other side, none is shuffled."""
    kinds = {f.name: f.dataType.simpleString() for f in out}
    strings = [n for n, kind in kinds.items() if kind == "string"]

    def block(payload, held: dict, room: int) -> tuple[pa.Table, _Rows]:
        """A block and its rows, kept with their sketches in ``held`` while there is room."""
        name = hashlib.blake2b(payload.as_buffer(), digest_size=16).digest()
        if name not in held:
            table = pa.ipc.open_stream(payload.as_buffer()).read_all()
            if held and sum(rows.n for _, rows in held.values()) + table.num_rows > room:
                if room:
                    return table, _Rows(table, idf)
                held.clear()
            held[name] = table, _Rows(table, idf)
        return held[name]

    def compare(batches):
        mine, theirs = {}, {}  # a task meets its base blocks once for each query block
        for batch in batches:
            for q_payload, b_payload in zip(batch["q_payload"], batch["b_payload"]):
                (left, q_rows), (right, b_rows) = block(q_payload, mine, 0), block(b_payload, theirs, HELD_ROWS)
                found = _compared(left, right, idf, _search_cells, one, (q_rows, b_rows))
                for name in strings:
                    found = found.set_column(found.schema.get_field_index(name), name, found[name].cast(pa.string()))
                yield from found.to_batches()

    q = q_blocks.select(F.col("groups").alias("q_groups"), F.col("payload").alias("q_payload"))
    b = b_blocks.select(F.col("group").alias("b_group"), F.col("payload").alias("b_payload"))
    met = q.join(b, F.array_contains("q_groups", F.col("b_group")))
    return met.select("q_payload", "b_payload").mapInArrow(compare, out)


# --------------------------------------------------------------- the join

def block_join(queries: DataFrame, base: DataFrame, q_rows: np.ndarray, b_rows: np.ndarray, block: int,
               idf: np.ndarray | None, search: Callable[..., None], one: bool = False) -> DataFrame:
    """Compare queries and base rows of a group, block pair by block pair: the best base row per query and pair.

    Both sides have a ``group``, queries a ``bound`` and ``cells``, base rows a ``cell`` and ``ref``. ``search`` is what
    a task does with its block pair (see _search_cells); ``one``: see _best_pairs.
    """
    spark = base.sparkSession
    q_cuts, b_cuts = -(-q_rows // block), -(-b_rows // block)
    used = np.flatnonzero((q_cuts > 0) & (b_cuts > 0))
    cuts = spark.createDataFrame(
        [(int(c), int(q_cuts[c]), int(b_cuts[c])) for c in used],
        "group int, q_cuts int, b_cuts int")

    def cut(side: str) -> F.Column:
        return F.pmod(F.xxhash64("key"), F.col(f"{side}_cuts")).cast("int")

    def every(side: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(f"{side}_cuts") - 1))

    # cuts has one row per group, so at most max_pivots rows
    q = queries.join(F.broadcast(cuts), "group").withColumn("q_cut", cut("q")).withColumn("b_cut", every("b"))
    b = base.join(F.broadcast(cuts), "group").withColumn("b_cut", cut("b")).withColumn("q_cut", every("q"))
    work = ["group", "q_cut", "b_cut"]
    # both sides may come from one table: aliases keep their columns apart
    q = q.select(*[F.col(c).alias(c) for c in (*work, "key", "cells", "bound", *PARTS)])
    b = b.select(*[F.col(c).alias(c) for c in (*work, "key", "cell", "ref", *PARTS)])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return _compared(left, right, idf, search, one)

    # by cost, not by bytes: small blocks are long work too
    tasks = int(min(2 * (q_cuts[used] @ b_cuts[used]), 8 * spark.sparkContext.defaultParallelism)) or 1
    q, b = q.repartition(tasks, *work), b.repartition(tasks, *work)
    return q.groupBy(*work).cogroup(b.groupBy(*work)).applyInArrow(compare, _pair_schema(base))


def _best(pairs: DataFrame) -> DataFrame:
    """The best pair per query; equal similarities go to the smallest ref."""
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "ref", "base_key")).alias("best")
    return pairs.groupBy("query_key").agg(best).select(
        "query_key", F.col("best.base_key").alias("base_key"), F.col("best.ref").alias("ref"),
        (-F.col("best.s")).alias("similarity"))


@dataclass
class _Search:
    """Both sides placed in cells: what the two searches start from."""

    queries: DataFrame
    placed: DataFrame
    cells: _Cells
    block: int
    idf: np.ndarray | None
    plan: BlockPlan
    row_bytes: float

    def at_home(self, df: DataFrame) -> DataFrame:
        if len(self.cells.pivots) == 1:
            return df.withColumn("cell", F.lit(0)).withColumn("closeness", F.lit(-1.0))
        return df.withColumn("_home", _home_of(self.cells)) \
            .withColumns({"cell": F.col("_home.cell"), "closeness": F.col("_home.closeness")}).drop("_home")

    def with_group(self, df: DataFrame) -> DataFrame:
        """The group of ``cell``; at most max_pivots cells."""
        group = F.array(*[F.lit(int(g)) for g in self.cells.groups])
        return df.withColumn("group", F.get(group, F.col("cell")))

    def visiting_home(self, bound: F.Column) -> DataFrame:
        return self.with_group(self.at_home(self.queries)).withColumns({
            "visits": F.array(F.struct("group", F.array("cell").alias("cells"))), "bound": bound}).drop("group", "cell", "closeness")

    def join(self, visiting: DataFrame, one: bool = False) -> DataFrame | None:
        """Best pairs of queries with the cells they visit, given by group in ``visits``; None when nobody visits."""
        rows = _per_group(visiting.select(F.explode("visits.group").alias("group")), len(self.cells.pivots))
        if not rows.any():
            return None
        held = self.held
        copies = rows @ -(-held // self.block) + held @ -(-rows // self.block)
        if self.idf is not None and self.row_bytes >= self.plan.long_row_bytes and copies * self.row_bytes > self.plan.copied_bytes:
            return _best(self._read_in_place(visiting, one))
        apart = visiting.select("*", F.inline("visits")).drop("visits")
        return _best(block_join(apart, self.placed, rows, held, self.block, self.idf, _search_cells, one))

    @cached_property
    def held(self) -> np.ndarray:
        """Base rows per group."""
        return np.bincount(self.cells.groups, weights=self.cells.rows, minlength=len(self.cells.pivots)).astype(np.int64)

    @cached_property
    def base_blocks(self) -> DataFrame:
        return _blocks(self.placed, -(-self.held // self.block), ["key", "cell", "ref"], "base-blocks")

    def _read_in_place(self, visiting: DataFrame, one: bool) -> DataFrame:
        """Query blocks are of one home group each, so that their rows visit much the same."""
        rows = self.with_group(self.at_home(visiting.where(F.size("visits") > 0)).drop("closeness"))
        at_home = _per_group(rows.select("group"), len(self.cells.pivots))
        rows = rows.withColumns({
            "groups": F.col("visits.group"),
            "cells": F.flatten("visits.cells").cast("array<smallint>" if len(self.cells.pivots) < SHORT_TERMS else "array<int>")})
        q_blocks = _blocks(rows, -(-at_home // self.block), ["key", "bound", "cells", "groups"], "query-blocks")
        return _in_place(q_blocks, self.base_blocks, _pair_schema(self.placed), self.idf, one)


def travelling(queries: DataFrame, base: DataFrame, idf: np.ndarray | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with every part, term numbers as short as they can be."""
    if idf is None:
        return tuple(df.withColumn("scale", F.lit(1.0)) for df in (queries, base))
    if len(idf) <= SHORT_TERMS:
        return tuple(df.withColumn("terms", F.col("terms").cast("array<smallint>")) for df in (queries, base))
    return queries, base


def rows_and_block(queries: DataFrame, base: DataFrame, plan: BlockPlan) -> tuple:
    """What the base rows measure, and rows per block."""
    size = base.agg(
        F.count("*").alias("rows"), F.max(F.size("dense")).alias("dense"),
        F.avg(F.size("terms")).alias("terms"), F.max(F.size("terms")).alias("most"),
    ).first()
    if not size["rows"]:
        return size, 0, 0
    per_term = 6 if dict(base.dtypes)["terms"] == "array<smallint>" else 12
    row_bytes = 100 + 8 * size["dense"] + per_term * size["terms"]
    block = plan.block_rows(row_bytes, queries.count(), size["rows"], base.sparkSession.sparkContext.defaultParallelism)
    if row_bytes >= plan.long_row_bytes:
        block = max(1, min(block, int(plan.long_block_bytes // row_bytes)))
    return size, block, row_bytes


def _placed(queries: DataFrame, base: DataFrame, plan: BlockPlan | None, idf: np.ndarray | None) -> _Search | None:
    """None without base rows."""
    plan = plan or BlockPlan()
    queries, base = travelling(queries, base, idf)
    size, block, row_bytes = rows_and_block(queries, base, plan)
    if not size["rows"]:
        return None
    sparse = size["most"] > 0
    width = size["dense"] + (SKETCH_WIDTH if sparse else 0)
    cells = _choose_pivots(base, plan, size["rows"], width, sparse, idf)
    count = len(cells.pivots)
    search = _Search(queries, base, cells, block, idf, plan, row_bytes)
    placed = search.at_home(base)
    cells.rows, cells.radius = np.zeros(count, np.int64), np.full(count, math.pi)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("closeness").alias("c")).collect():
        cells.rows[r["cell"]] = r["n"]
        cells.radius[r["cell"]] = math.acos(max(-1.0, min(1.0, r["c"])))
    cells.groups = _grouped(cells.rows, block)
    search.placed = search.with_group(placed)
    return search


def _no_pairs(base: DataFrame) -> DataFrame:
    return base.sparkSession.createDataFrame([], _pair_schema(base))


def nearest_neighbours(queries: DataFrame, base: DataFrame, floor: float | None = None,
                       plan: BlockPlan | None = None, idf: np.ndarray | None = None) -> DataFrame:
    """Per query row its most similar base row: query_key, base_key, ref, similarity.

    Both sides: ``key`` (unique text), ``dense`` array<double>, ``terms`` array<int> and
    ``weights`` array<double>; together a unit vector. ``base`` also has ``ref``, which
    breaks ties. Give tables that are cheap to read again, such as written ones. Queries
    with no base row at or above ``floor`` are absent; without a floor all are present.

    With ``idf``, ``weights`` holds term counts and ``scale`` the norm of the sparse part.
    """
    plan = plan or BlockPlan()
    small_batches(base.sparkSession)
    if floor is not None and plan.index_share > 0:
        from holdfast.operators.prefixes import indexed_neighbours

        found = indexed_neighbours(queries, base, floor, plan.index_share, idf, plan)
        if found is not None:
            return _best(found)
    search = _placed(queries, base, plan, idf)
    if search is None:
        return _no_pairs(base)
    lowest = F.lit(-1.0 if floor is None else float(floor))
    home = search.join(search.visiting_home(lowest))
    if home is None:
        return _no_pairs(base)
    if len(search.cells.pivots) == 1:
        return home

    # What each query found at home is the least it must beat elsewhere.
    first = written(home, "nearest-home")
    known = search.queries.join(first.select(F.col("query_key").alias("key"), "similarity"), "key", "left") \
        .withColumn("bound", F.coalesce("similarity", lowest))
    away = search.join(known.withColumn("visits", _visits_of(search.cells)))
    return first if away is None else _best(first.unionByName(away))


#: Visits of the first wave of closest_pair, per query, and how many times as many each wave has as the one before.
FIRST_WAVE, WAVE_GROWTH = 1, 8


def closest_pair(queries: DataFrame, base: DataFrame, plan: BlockPlan | None = None,
                 idf: np.ndarray | None = None) -> DataFrame:
    """The most similar pair of all, best first: rows as those of nearest_neighbours, all pairs that tie (to six
    decimals) with the best, one per query.

    The best pair inside the home cells is the floor. Visits to other cells are then made in order of the most they can
    hold, in growing waves; each raises the floor, and visits below it are never made. When none is left,
    no pair can be better.
    """
    small_batches(base.sparkSession)
    search = _placed(queries, base, plan, idf)
    home = search and search.join(search.visiting_home(F.lit(-1.0)), one=True)
    if home is None:
        return _no_pairs(base)
    found = written(home, "closest-home")

    def best() -> float:
        return found.agg(F.max("similarity")).first()[0]

    if len(search.cells.pivots) > 1:
        floor = best()
        visits = search.queries.withColumn("bound", F.lit(floor)).select("key", F.inline(_possible_of(search.cells)))
        visits = written(visits, "closest-visits")  # three narrow columns for each cell that can still beat the floor
        wave, made = max(1, FIRST_WAVE * search.queries.count()), math.inf
        while True:
            left = visits.where((F.col("most") < made) & (F.col("most") >= floor - SLACK))
            many = left.count()
            if not many:
                break
            # visits down to this bound; those that share it all come along
            cut = floor - 1.0 if many <= wave else left.agg(
                F.percentile_approx("most", 1 - wave / many, 10_000)).first()[0]
            now = left.where(F.col("most") >= cut)
            now = now.groupBy("key", "group").agg(F.collect_set("cell").alias("cells")) \
                .groupBy("key").agg(F.collect_list(F.struct("group", "cells")).alias("visits"))
            away = search.join(search.queries.join(now, "key").withColumn("bound", F.lit(floor)), one=True)
            if away is not None:
                found = written(found.unionByName(away), "closest-wave")
                floor = best()
            made, wave = cut, WAVE_GROWTH * wave
    return _best(found.where(F.col("similarity") >= best()))
