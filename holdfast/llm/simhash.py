"""Near-duplicates by SimHash fingerprints compared in bit slices (operator 6).

Every text gets a 64-bit fingerprint of its word shingles. Equal fingerprints are collapsed.
Fingerprints that differ in at most ``radius`` bits agree on some ``agree`` of ``agree + radius`` bit
bands, so those equal on a choice of bands form a bucket; no link is missed. Small buckets are packed
into blocks of some hundred fingerprints; a block stores its fingerprints vertically, one bit string per bit position, and
counts the differing bits of all its pairs with carry-save counter bits and an overflow
bit, stopping once every pair has overflowed. Only a spanning forest of the links of a block
leaves it, so a group of n needs n - 1 rows. Crowded buckets are split into chunks that meet pairwise.

Null and empty texts: fingerprint 0, linked like any other. Fewer words than a shingle: the whole
sequence is the one shingle. Repeats count as often as they occur. Texts are taken whole. Rows
with equal ids and equal fingerprints stay separate rows of the result; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import components
from holdfast.llm.rows import scalar, text_of
from holdfast.storage import spread, written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLOCK = 1024
FILL = 256
FAR = 255


def shingles(text: bytes, words: int) -> list[bytes]:
    parts = text.translate(LOWER).split()  # at U+0020 and U+0009 to U+000D
    if not parts:
        return []
    if len(parts) <= words:
        return [b" ".join(parts)]
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    return [joined[a:b] for a, b in zip(starts, stops[words - 1:])]


def majority(hashes: np.ndarray) -> np.uint64:
    """A bit is 1 if it is set in over half the hashes."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(words: int, seed: int = 42) -> Callable:
    """Column function: text -> 64-bit fingerprint as a signed long; repeated shingles count as often as they occur."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            out = np.zeros(len(batch), np.uint64)
            for row, value in enumerate(batch):
                found = shingles((value.as_py() or "").encode(), words)
                if found:
                    out[row] = majority(np.fromiter((xxh64_intdigest(s, seed) for s in found), np.uint64, len(found)))
            yield pa.array(out.view(np.int64))

    return scalar(run, "long")


def distances(prints: np.ndarray, radius: int) -> np.ndarray | None:
    """Matrix of differing bits, FAR where they are more than ``radius`` (at most 7); None if all pairs are."""
    n = len(prints)
    bits = np.unpackbits(prints.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")  # n x 64
    width = -(-n // 64)
    planes = np.zeros((64, width * 8), np.uint8)
    planes[:, :-(-n // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
    planes = planes.view(np.uint64)  # bit k of planes[p] is bit p of fingerprint k
    query = np.where(bits.T == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    # Places behind the last fingerprint, and each one's own, count as out.
    spare = np.packbits((np.arange(width * 64) >= n) | np.eye(n, width * 64, dtype=bool), axis=1, bitorder="little").view(np.uint64)
    counters = [np.zeros((n, width), np.uint64) for _ in range(2 if radius <= 3 else 3)]
    over = spare.copy()
    for p in range(64):
        carry = planes[p][None, :] ^ query[p][:, None]
        for counter in counters:
            held = counter & carry
            counter ^= carry
            carry = held
        over |= carry
        if p in (15, 23, 31, 39, 47) and not (~over).any():
            return None
    if not (~over).any():
        return None
    out = np.zeros((n, n), np.uint8)
    for k, counter in enumerate(counters):
        out += np.unpackbits(counter.view(np.uint8), axis=1, bitorder="little")[:, :n] << k
    out[np.unpackbits(over.view(np.uint8), axis=1, bitorder="little")[:, :n] == 1] = FAR
    out[out > radius] = FAR
    return out


def forest(far: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shortest links that join the groups as far as links do: every group takes its closest link, until none is left."""
    group = np.unique(group, return_inverse=True)[1]
    left, right = [], []
    while True:
        apart = np.where(group[:, None] == group[None, :], FAR, far)
        best = apart.argmin(axis=1)
        cost = apart[np.arange(len(far)), best].astype(np.int64)
        if (cost == FAR).all():
            break
        order = np.lexsort((np.arange(len(far)), cost, group))
        own = order[np.r_[True, np.diff(group[order]) != 0]]  # the first of each group
        own = own[cost[own] < FAR]
        a, b = own, best[own]
        # Two groups may choose each other, or choose in a ring of equal links: joined one by one.
        root = np.arange(group.max() + 1)

        def top(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        for i, j in zip(a.tolist(), b.tolist()):
            x, y = top(group[i]), top(group[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                left.append(i)
                right.append(j)
        group = np.array([top(x) for x in range(len(root))])[group]
    return np.array(left, np.int64), np.array(right, np.int64)


def _joined(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Group of each of n nodes after joining the given links."""
    group = np.arange(n)

    def top(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i, j in zip(left.tolist(), right.tolist()):
        x, y = top(i), top(j)
        group[max(x, y)] = min(x, y)
    return np.array([top(x) for x in range(n)])


def links(prints: DataFrame, radius: int = 3, agree: int = 2, block: int = BLOCK) -> DataFrame:
    """Direct links (a, b) between fingerprints ``f`` within ``radius`` bits, as many as join all that are linked.

    A bucket of more than ``block`` is cut into chunks that meet in pairs. A chunk's own links come from one of its
    meetings; the others add only what joins its groups with those of the chunk they meet.
    """
    bands = radius + agree
    edges = [64 * i // bands for i in range(bands + 1)]

    def band(i: int):
        mask = ((1 << (edges[i + 1] - edges[i])) - 1) << edges[i]
        return F.col("f").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))

    # Buckets of equal hash share one list: more is compared, no link is lost.
    keys = [F.xxhash64(F.lit(k), _either([band(i) for i in chosen])) for k, chosen in enumerate(combinations(range(bands), agree))]
    rows = prints.select("f", F.explode(F.array(*keys)).alias("key"))
    crowded = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "crowded")
    dealt = rows.join(crowded, "key", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("n") / block).cast("int"), F.lit(1))) \
        .withColumn("chunk", F.pmod(F.xxhash64("f"), F.col("chunks")).cast("int"))
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != F.col("chunk")))
    marked = F.struct("f", F.col("chunk").cast("long").alias("chunk")).alias("e")
    met = dealt.select(marked, "key", "chunk", F.explode(other).alias("j")).groupBy(
        "key", F.least("chunk", "j").alias("i"), F.greatest("chunk", "j").alias("j")).agg(F.collect_list("e").alias("es")).where(F.size("es") > 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done():
            prints = np.unique(np.concatenate(held)[:, 0])
            far = distances(prints.view(np.uint64), radius)
            left, right = (np.zeros(0, np.int64),) * 2 if far is None else forest(far, prints)
            return pa.RecordBatch.from_arrays([pa.array(prints[left]), pa.array(prints[right])], ["a", "b"])

        def meeting(both):
            """Two chunks of one bucket. Chunk 0 gives its own links where it meets 1, all others where they meet 0."""
            both = both[np.unique(both[:, 0], return_index=True)[1]]
            prints, chunk = np.ascontiguousarray(both[:, 0]), both[:, 1]
            first, second = chunk.min(), chunk.max()
            far = distances(prints.view(np.uint64), radius)
            left = right = np.zeros(0, np.int64)
            if far is not None:
                inside = chunk[:, None] == chunk[None, :]
                own, other = forest(np.where(inside, far, FAR), prints)
                across = forest(np.where(inside, FAR, far), _joined(len(prints), own, other))
                told = (chunk[own] == second) | (second == 1) if first == 0 else np.zeros(len(own), bool)
                left, right = np.r_[own[told], across[0]], np.r_[other[told], across[1]]
            return pa.RecordBatch.from_arrays([pa.array(prints[left]), pa.array(prints[right])], ["a", "b"])

        for batch in batches:
            lists = batch.column(0)
            values = np.stack([x.to_numpy() for x in lists.flatten().flatten()], axis=1)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for a, b in zip(offsets[:-1], offsets[1:]):
                if (values[a:b, 1] != values[a, 1]).any():
                    yield meeting(values[a:b])
                    continue
                if held and size + b - a > FILL:
                    yield done()
                    held, size = [], 0
                held.append(values[a:b])
                size += b - a
        if held:
            yield done()

    return met.select("es").mapInArrow(compare, "a long, b long").distinct()


def _either(parts: list):
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.bitwiseOR(p)
    return whole


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (long), component_id, the smallest id reachable over links."""
    print_of = fingerprints(words)
    rows = written(spread(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")))
                   .select("doc_id", print_of("text").alias("f")), "fingerprints")
    least = written(rows.groupBy("f").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    joined = components(links(least.select("f"), radius), "a", "b")
    rooted = least.join(joined, least["f"] == joined["node"], "left") \
        .select("f", "least", F.coalesce("root", "f").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("f", "component_id")
    return rows.join(named, "f").select("doc_id", F.col("f").alias("fingerprint"), "component_id")
