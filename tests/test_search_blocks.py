"""What bounds the searches: batches, slices, groups of cells, postings met at a time."""

import numpy as np
import pyarrow as pa
import pytest

from holdfast.operators import nearest, prefixes
from holdfast.operators.nearest import BlockPlan, _best_pairs, _Found, _grouped, _Rows, _search_cells, _Vectors
from holdfast.operators.ngrams import _some_rows
from holdfast.storage import written


def _table(dense, counts, idf, **more):
    kept = [np.flatnonzero(r) for r in counts]
    part = {
        "dense": pa.array([r.tolist() for r in dense], pa.list_(pa.float64())),
        "terms": pa.array([k.tolist() for k in kept], pa.list_(pa.int16())),
        "weights": pa.array([r[k].tolist() for r, k in zip(counts, kept)], pa.list_(pa.int32())),
        "scale": pa.array(np.full(len(counts), np.sqrt(1 - (dense[0] ** 2).sum()) if dense.shape[1] else 1.0))}
    w = counts * idf
    text = w / np.linalg.norm(w, axis=1, keepdims=True) * part["scale"].to_numpy()[:, None]
    return pa.table(part | more), np.hstack([dense, text])


def _sides(rng, n=70, width=150, dims=0):
    counts = (rng.random((2 * n, width)) < 0.08) * rng.integers(1, 4, (2 * n, width))
    counts[:, 0] = 1
    counts[n:n + n // 2] = counts[:n // 2]
    counts[n:n + n // 2, 5:9] += rng.integers(0, 2, (n // 2, 4))
    idf = np.log((1 + 2 * n) / (1 + (counts > 0).sum(axis=0))) + 1
    dense = rng.normal(size=(2 * n, dims))
    dense *= np.sqrt(0.8) / np.linalg.norm(dense, axis=1, keepdims=True) if dims else 1
    refs = rng.permutation(n)
    left, q = _table(dense[:n], counts[:n], idf, bound=pa.array(np.full(n, 0.7)), cells=pa.array([[0, 1, 3]] * n, pa.list_(pa.int32())))
    right, b = _table(dense[n:], counts[n:], idf, cell=pa.array(rng.integers(0, 4, n), pa.int32()), ref=pa.array(refs))
    return left, right, q, b, idf, np.argsort(refs)


def _check(found, sims, order, floor):
    sims = np.round(sims[:, order], 6)
    for i, row in enumerate(sims):
        if row.max() >= floor:
            assert found.partner[i] == row.argmax() and found.cosine[i] == row.max()
        else:
            assert found.partner[i] == -1


def test_postings_meet_some_at_a_time(monkeypatch):
    left, right, q, b, idf, order = _sides(np.random.default_rng(3))
    rank = np.empty(len(idf), np.int64)
    rank[np.argsort(-idf, kind="stable")] = np.arange(len(idf))
    for at_once in (1, 40, 1_000_000):
        monkeypatch.setattr(prefixes, "MEETINGS", at_once)
        found = _Found(left["bound"].to_numpy())
        prefixes.searching(0.7, rank)(left, right, _Rows(left, idf), _Rows(right, idf), order, found)
        _check(found, q @ b.T, order, 0.7)


@pytest.mark.parametrize("size", [7, 2048])
@pytest.mark.parametrize("dims", [0, 12])
def test_cells_are_searched_slice_by_slice(monkeypatch, dims, size):
    monkeypatch.setattr(nearest, "SLICE", size)
    left, right, q, b, idf, order = _sides(np.random.default_rng(4), dims=dims)
    found = _Found(left["bound"].to_numpy())
    _search_cells(left, right, _Rows(left, idf), _Rows(right, idf), order, found)
    sims = q @ b.T
    if size < 10:  # larger than a slice, cells are apart
        sims[:, right["cell"].to_numpy() == 2] = -1  # nobody visits that cell
    _check(found, sims, order, 0.7)


def test_coarse_sketch_is_enough_where_text_weighs_little():
    rng = np.random.default_rng(5)
    left, right, q, b, idf, order = _sides(rng, n=400, dims=20)
    mine, theirs = _Rows(left, idf).take(np.arange(400)), _Rows(right, idf).take(order)
    i, j, cosine = _best_pairs(mine, theirs, np.full(400, 0.7))
    want = np.round((q @ b.T)[:, order], 6)
    assert "fine" not in mine.__dict__ and {x: (y, c) for x, y, c in zip(i, j, cosine)} == \
        {x: (r.argmax(), r.max()) for x, r in enumerate(want) if r.max() >= 0.7}


def test_neighbouring_cells_share_a_block():
    assert _grouped(np.array([3, 3, 3, 0, 9, 20, 1]), 10).tolist() == [0, 0, 0, 0, 1, 2, 3]


def test_blocks_grow_with_both_sides():
    plan = BlockPlan()
    assert plan.block_rows(1000, 10_000_000, 40_000_000, 12) == 65_536
    assert plan.block_rows(8000, 10_000_000, 40_000_000, 12) == (64 << 20) // 8000
    assert plan.block_rows(1000, 10_000, 40_000, 12) == 2886


def test_words_are_cut_some_rows_at_a_time():
    at = np.array([0, 5, 5, 300, 302, 304])
    assert list(_some_rows(at, 100)) == [(0, 2), (2, 3), (3, 5)]
    assert list(_some_rows(np.array([0]), 100)) == []


@pytest.mark.parametrize("at_once", [1, 7, 200_000])
def test_counts_do_not_depend_on_the_rows_at_a_time(spark, at_once):
    from pyspark.sql import functions as F

    from holdfast.operators.ngrams import term_counter

    rows = spark.createDataFrame([(["some", "words", "some"],), ([],), (["word"] * 20,), (["none", ""],)], "w array<string>").coalesce(1)
    terms = [" so", "word", "words", "ne "]
    got = [(r[0]["terms"], r[0]["counts"]) for r in rows.select(term_counter(terms, at_once)(F.col("w"))).collect()]
    assert got == [([0, 1, 2], [2, 1, 1]), ([], []), ([1], [20]), ([3], [1])]


def test_arrow_batches_are_bounded(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    written(spark.range(3), "few")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20


def _text_rows(spark, rng, n, extra=()):
    counts = (rng.random((n, 120)) < 0.1) * rng.integers(1, 4, (n, 120))
    counts[:, 0] = 1 + np.arange(n) % 3
    counts[n // 2:n // 2 + n // 4] = counts[:n // 4]
    counts[:, 7] += rng.integers(0, 2, n)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1
    unit = counts * idf / np.linalg.norm(counts * idf, axis=1, keepdims=True)
    kept = [np.flatnonzero(r) for r in counts]
    rows = [(f"k{i:03}", [], k.tolist(), r[k].tolist(), 1.0, int(i)) for i, (k, r) in enumerate(zip(kept, counts))]
    df = written(spark.createDataFrame(
        rows, "key string, dense array<double>, terms array<int>, weights array<int>, scale double, ref bigint"), "rows")
    return df.where(f"ref >= {n // 2}").drop("ref"), df.where(f"ref < {n // 2}"), unit[n // 2:] @ unit[:n // 2].T, idf


@pytest.mark.parametrize("floor", [None, 0.8])
def test_long_rows_are_read_in_place(spark, monkeypatch, floor):
    queries, base, sims, idf = _text_rows(spark, np.random.default_rng(6), 200)
    made = []
    monkeypatch.setattr(nearest, "_in_place", lambda *a, f=nearest._in_place: made.append(a) or f(*a))
    monkeypatch.setattr(nearest, "block_join", None)
    plan = BlockPlan(one_cell_rows=10, max_pivots=6, long_row_bytes=0, long_block_bytes=1_500, copied_bytes=0, index_share=0)
    got = {r["query_key"]: (r["ref"], r["similarity"]) for r in nearest.nearest_neighbours(queries, base, floor, plan, idf).collect()}
    sims = np.round(sims, 6)
    want = {f"k{100 + i:03}": (int(s.argmax()), s.max()) for i, s in enumerate(sims) if s.max() >= (floor or -1)}
    assert got == want and len(made) == 2
    best = [(r["query_key"], r["ref"]) for r in nearest.closest_pair(queries, base, plan, idf).collect()]
    assert sorted(best) == [(f"k{100 + i:03}", int(s.argmax())) for i, s in enumerate(sims) if s.max() == sims.max()]
    q_blocks, b_blocks = made[0][:2]
    assert b_blocks.count() > 6 and q_blocks.count() > 6
    assert "Exchange hash" not in nearest._in_place(*made[0])._jdf.queryExecution().executedPlan().toString()


def test_packed_rows_come_back(spark):
    rows = [([], []), ([3, 40_000, 70_001], [1, 70_000, 2]), ([0], [5]), ([], []), ([7, 8], [300, 1])]
    df = spark.createDataFrame(rows, "terms array<int>, weights array<int>").coalesce(1)
    offsets, terms, counts = nearest._unpacked(df.select(nearest._packed_of().alias("p")).toArrow()["p"])
    assert [(terms[lo:hi].tolist(), counts[lo:hi].tolist()) for lo, hi in zip(offsets, offsets[1:])] == rows


def test_blocks_of_long_rows_are_small(spark):
    queries, base, _, _ = _text_rows(spark, np.random.default_rng(7), 40)
    _, block, row_bytes = nearest.rows_and_block(queries, base, BlockPlan(long_row_bytes=50, long_block_bytes=1_000))
    assert block == int(1_000 // row_bytes) and 50 <= row_bytes <= 1_000


def test_sketches_are_made_some_rows_at_a_time(monkeypatch):
    left, _, _, _, idf, _ = _sides(np.random.default_rng(8), dims=3)
    rows = _Rows(left, idf).take(np.arange(70))
    whole = rows.filter_matrix(True, 16)
    monkeypatch.setattr(nearest, "SKETCH_TERMS", 50)
    assert np.array_equal(whole, rows.filter_matrix(True, 16))


def test_shuffle_files_go_when_a_table_is_written(spark):
    from pyspark.sql import functions as F

    tracker = spark._jsparkSession.sparkContext().env().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    rows = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sevenths")
    assert rows.count() == 7 and tracker.shuffleStatuses().size() <= before + 1


@pytest.mark.parametrize("dims", [0, 12])
def test_blocks_of_long_rows_are_sketched_once(monkeypatch, dims):
    """Each row of a block is weighed once for its sketch, however many slices it meets, and again only where it is compared."""
    left, right, q, b, idf, order = _sides(np.random.default_rng(9), dims=dims)
    right = right.set_column(right.schema.get_field_index("cell"), "cell", pa.array(np.zeros(right.num_rows), pa.int32()))
    left = left.set_column(left.schema.get_field_index("cells"), "cells", pa.array([[0]] * left.num_rows, pa.list_(pa.int32())))
    monkeypatch.setattr(nearest, "SLICE", 20)
    weighed = {}
    for terms in (0, 10_000):  # long rows, short ones
        monkeypatch.setattr(nearest, "LONG_TERMS", terms)
        taken, found = [], _Found(np.full(left.num_rows, 0.98))
        sides = _Rows(left, idf), _Rows(right, idf)
        monkeypatch.setattr(_Rows, "take", lambda self, at, f=_Rows.__dict__["take"]: taken.append(len(at)) or f(self, at))
        _search_cells(left, right, *sides, order, found)
        monkeypatch.undo()
        monkeypatch.setattr(nearest, "SLICE", 20)
        _check(found, q @ b.T, order, 0.98)
        weighed[terms] = sum(taken)
    pairs = int(((q @ b.T) >= 0.98).sum())
    assert weighed[0] < weighed[10_000] and weighed[0] <= left.num_rows + right.num_rows + 20 * (pairs + left.num_rows)


def test_base_blocks_stay_while_there_is_room(spark, monkeypatch):
    """The same pairs with room for all blocks of a task, for some and for none."""
    queries, base, sims, idf = _text_rows(spark, np.random.default_rng(6), 200)
    plan = BlockPlan(one_cell_rows=10, max_pivots=6, long_row_bytes=0, long_block_bytes=1_500, copied_bytes=0, index_share=0)
    monkeypatch.setattr(nearest, "LONG_TERMS", 0)
    want = [(f"k{100 + i:03}", int(s.argmax()), s.max()) for i, s in enumerate(np.round(sims, 6)) if s.max() >= 0.8]
    for room in (8192, 20, 0):
        monkeypatch.setattr(nearest, "HELD_ROWS", room)
        got = nearest.nearest_neighbours(queries, base, 0.8, plan, idf).collect()
        assert sorted((r["query_key"], r["ref"], r["similarity"]) for r in got) == want
