"""Similarity search by an inverted index of rare terms (Bayardo, Ma and Srikant, "Scaling up all pairs similarity search").

Terms are ordered by rising frequency, the same on both sides. Of a unit vector, the prefix is its rarest terms, as many as it
takes for the rest (dense part included) to have a norm below the floor. Of two rows whose cosine reaches the floor, the first
term they share lies in both prefixes: all from there on belongs to what they share, and a rest below the floor could not make it up.
So rows meet only where prefixes share a term, and every candidate is then compared on all its terms.

Both sides are dealt out in blocks, each row once for every block of the other side; postings meet inside the task of a block
pair, some queries at a time, and only the best row per query leaves it. How often postings meet is
counted before anything is joined: where that is much of all pairs (long texts of few words, whose prefixes hold
hundreds of terms), the caller's other search is cheaper and this one steps back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.nearest import (
    PARTS, SIM_DECIMALS, SLACK, BlockPlan, _Found, _pair_cosines, _Rows, _Vectors, block_join, rows_and_block, travelling,
)
from holdfast.storage import written

#: Postings that meet at a time in a task, unless one row meets more; rows whose prefixes are worked out at a time.
MEETINGS, PREFIX_ROWS = 1_000_000, 1024


def prefix_of(v: _Vectors, floor: float, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms in the prefix per row, these terms, and the rows whose dense part alone reaches the floor.
    ``order``: rank of each term, rarest first."""
    least = (floor - 10 * SLACK) ** 2
    row = np.repeat(np.arange(v.n), np.diff(v.offsets))
    by_rank = np.lexsort((order[v.terms], row))
    mass = v.weights[by_rank] ** 2
    total = np.bincount(row, weights=mass, minlength=v.n) + (v.dense ** 2).sum(axis=1)
    upto = np.cumsum(mass)
    start = np.r_[0.0, upto][v.offsets[:-1]]
    ahead = upto - mass - start[row]  # mass of rarer terms of the row
    inside = total[row] - ahead >= least
    taken = np.bincount(row, weights=inside, minlength=v.n).astype(np.int64)
    whole = np.bincount(row, weights=mass, minlength=v.n)
    return taken, v.terms[by_rank][inside], total - whole >= least


def prefixes_of(floor: float, order: np.ndarray, idf: np.ndarray | None):
    """UDF: the prefix of every row; only -1 where the dense part alone reaches the floor."""
    @F.arrow_udf("array<int>")
    def prefix(dense: pa.Array, terms: pa.Array, weights: pa.Array, scale: pa.Array) -> pa.Array:
        taken, flat, unsure = prefix_of(_Vectors(dense, terms, weights, scale, idf), floor, order)
        if unsure.any():
            flat = np.r_[flat[~np.repeat(unsure, taken)], np.full(unsure.sum(), -1)]
            taken = np.where(unsure, 0, taken)
            taken[-1] += unsure.sum()  # what counts is that there are some
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(taken)], pa.int32()), pa.array(flat, pa.int32()))

    return prefix(*PARTS)


def _frequency(rows: DataFrame) -> np.ndarray | None:
    """Rows per prefix term, at most a vocabulary of numbers; None where the dense part of some row reaches the floor."""
    got = rows.select(F.explode("prefix").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
    if any(r["t"] < 0 for r in got):
        return None
    out = np.zeros(max((r["t"] for r in got), default=-1) + 1, np.int64)
    for r in got:
        out[r["t"]] = r["n"]
    return out


def _meetings(q: np.ndarray, b: np.ndarray) -> int:
    both = min(len(q), len(b))
    return int((q[:both].astype(object) * b[:both]).sum()) if both else 0


def _postings(rows: _Rows, at: np.ndarray, floor: float, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, row) of all prefixes, rows numbered as in ``at``."""
    terms, owners = [], []
    for lo in range(0, len(at), PREFIX_ROWS):
        some = at[lo:lo + PREFIX_ROWS]
        taken, flat, _ = prefix_of(rows.take(some), floor, order)
        terms.append(flat)
        owners.append(np.repeat(np.arange(lo, lo + len(some), dtype=np.int32), taken))
    return np.concatenate(terms), np.concatenate(owners)


def searching(floor: float, rank: np.ndarray):
    """The search of a block pair by its prefixes (see block_join)."""

    def search(left: pa.Table, right: pa.Table, q: _Rows, b: _Rows, order: np.ndarray, found: _Found) -> None:
        terms, rows = _postings(b, order, floor, rank)
        by_term = np.argsort(terms, kind="stable")
        terms, rows = terms[by_term], rows[by_term]
        starts = np.searchsorted(terms, np.arange(len(rank) + 1))
        wanted, owner = _postings(q, np.arange(q.n), floor, rank)
        many = starts[wanted + 1] - starts[wanted]
        upto = np.r_[0, np.cumsum(np.bincount(owner, weights=many, minlength=q.n).astype(np.int64))]
        ends = np.searchsorted(owner, np.arange(q.n + 1))
        lo = 0
        while lo < q.n:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + MEETINGS, side="right")) - 1)
            mine = slice(ends[lo], ends[hi])
            each = many[mine]
            met = np.repeat(starts[wanted[mine]] - np.cumsum(each) + each, each) + np.arange(each.sum())
            pair = np.unique(np.repeat(owner[mine].astype(np.int64) - lo, each) * b.n + rows[met])
            if len(pair):
                i, j = np.divmod(pair, b.n)
                used, j_used = np.unique(j, return_inverse=True)
                cosine = np.round(_pair_cosines(q.take(np.arange(lo, hi)), b.take(order[used]), i, j_used), SIM_DECIMALS)
                best = np.lexsort((j, -cosine, i))
                best = best[np.flatnonzero(np.r_[True, i[best][1:] != i[best][:-1]])]
                best = best[cosine[best] >= floor]
                found.add(i[best] + lo, j[best], cosine[best])
            lo = hi

    return search


def indexed_neighbours(queries: DataFrame, base: DataFrame, floor: float, share: float,
                       idf: np.ndarray | None, plan: BlockPlan | None = None) -> DataFrame | None:
    """Pairs at or above the floor, the best of every query among them: query_key, base_key, ref, similarity;
    None where the index does not fit or costs more."""
    if idf is None or not len(idf) or floor <= 10 * SLACK:
        return None
    order = np.empty(len(idf), np.int64)
    order[np.lexsort((np.arange(len(idf)), -idf))] = np.arange(len(idf))  # the higher its weight, the rarer the term
    queries, base = travelling(queries, base, idf)
    often = []
    for side in (queries, base):
        often.append(_frequency(side.withColumn("prefix", prefixes_of(floor, order, idf))))
        if often[-1] is None:
            return None
    rows = queries.count(), base.count()
    if _meetings(*often) > share * rows[0] * rows[1]:
        return None
    _, block, _ = rows_and_block(queries, base, plan or BlockPlan())
    whole = F.lit(0)
    q = queries.withColumns({"group": whole, "cells": F.array(whole), "bound": F.lit(float(floor))})
    b = base.withColumns({"group": whole, "cell": whole})
    met = block_join(q, b, np.array(rows[:1]), np.array(rows[1:]), block, idf, searching(floor, order))
    return written(met, "indexed-pairs")
