"""Links of crowded buckets join what brute force joins, in few rows."""

import numpy as np
import pytest

from holdfast.llm import simhash
from holdfast.llm.components import components


def prints_of(seed, n=260):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-(1 << 62), 1 << 62, 5)
    out = []
    for _ in range(n):
        x = int(centres[rng.integers(0, 5)])
        for bit in rng.integers(0, 63, rng.integers(0, 5)):
            x ^= 1 << int(bit)
        out.append(x)
    return sorted(set(out))


def near(prints, radius):
    mask = (1 << 64) - 1
    return [(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if bin((a ^ b) & mask).count("1") <= radius]


@pytest.mark.parametrize("radius, block", [(3, 16), (3, 1024), (6, 40)])
def test_components_do_not_depend_on_chunks(spark, radius, block):
    prints = prints_of(radius)
    table = spark.createDataFrame([(p,) for p in prints], "f long").repartition(3)
    found = simhash.links(table, radius, block=block)
    got = {r.node: r.root for r in components(found, "a", "b").collect()}
    want = {p: p for p in prints}
    for a, b in near(prints, radius):
        x, y = want[a], want[b]
        if x != y:
            want = {p: min(x, y) if r in (x, y) else r for p, r in want.items()}
    linked = {p for pair in near(prints, radius) for p in pair}
    assert got == {p: want[p] for p in linked if want[p] != p}
