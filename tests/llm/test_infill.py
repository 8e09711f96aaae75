"""Fill-in-middle against a regex, and the learned index against the offsets it stands for."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import ROWS
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.llm import infill

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
MORE = [(20, "has <P> inside", "s"), (21, "ends <S", "s"), (22, "<M", "s"), (23, "x" * 70_000, "s"), (24, "é" * 300 + "abc日本 𝒳𝒴", "s"),
        (None, "no id", "s"), (25, "a\nb\r\nc", "s")] + [(100 + i, f"Some words, number {i}! <{'PSM'[i % 3]} > é", "s") for i in range(200)]


def wanted(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_a_regex(spark, none):
    rows = ROWS + MORE
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t, _ in rows], "doc_id long, text string, n int, form string, a int")
    found = infill.transform(docs).withColumn("again", infill.restore(F.col("output"), F.col("form"))).collect()
    key = str
    assert sorted((tuple(r)[:6] for r in found), key=key) == sorted((wanted(i, t) for i, t, _ in rows), key=key)
    assert sorted(r.again for r in found) == sorted(t or "" for _, t, _ in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert infill.transform(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ09 <é日𝒳\n"), max_size=30), max_size=8), st.integers(1, 17))
def test_boundaries_at_any_scan_size(texts, scan):
    index = infill.RankIndex(error=2)
    ranks, points = infill.boundaries(pa.array(texts, pa.string()), index, scan=scan)
    starts = np.cumsum([0, *map(len, texts)])
    offsets = [start + m.start() for start, t in zip(starts, texts) for m in TOKEN.finditer(t)] + [int(starts[-1])]
    assert index.offset(np.arange(index.size)).tolist() == offsets
    assert ranks.tolist() == [*np.cumsum([0, *(len(TOKEN.findall(t)) for t in texts)])] and points.tolist() == starts.tolist()


@pytest.mark.parametrize("error", [1, 8, 120])
def test_segments_keep_their_bound(error):
    rng = np.random.default_rng(error)
    offsets = np.cumsum(rng.choice([1, 2, 9, 4000], 50_000, p=[0.6, 0.3, 0.0999, 0.0001]))
    index = infill.RankIndex(error)
    for lo in range(0, len(offsets), 7001):
        index.add(offsets[lo:lo + 7001])
    index.freeze()
    assert (index.offset(np.arange(len(offsets))) == offsets).all()
    assert np.abs(index._lack.astype(int)).max() <= error + 1
    assert len(index._first) < len(offsets) / (2 * error)


def test_a_sliced_array_is_read_from_its_own_start():
    index = infill.RankIndex()
    ranks, points = infill.boundaries(pa.array(["skip me", "two words", "", "é"]).slice(1), index)
    assert ranks.tolist() == [0, 3, 3, 4] and points.tolist() == [0, 9, 9, 10] and index.size == 5
