"""Fill-in-middle transformation with a learned rank index over token boundaries (operator 12).

A text is cut into tokens (a run of ASCII letters, or one other code point). Its document's hash says after how
many tokens the prefix and the middle end; where those tokens end in code points is looked up in an index of all
boundary offsets of an Arrow batch. The index is learned, not stored: the map from rank to offset is cut into
straight segments, each grown as long as one line stays within ``ERROR`` of every offset it covers (the cone of
slopes that do is narrowed point by point), and what a prediction lacks is kept as one signed byte per boundary.
A cut is predicted from its segment and set right with its byte, so it is exact; the index takes a ninth of the
memory of the offsets, and texts are scanned 4 MB at a time, however long they are.

Texts and digests are put together by Spark's own functions. ``restore`` gives the text back from output and form.

Null and empty texts have no tokens and stay plain, as do texts that hold a sentinel. A null id hashes as the empty
text. Repeated rows are transformed alike, and an empty table gives an empty one. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.rows import text_of
from holdfast.storage import spread

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 120           # of a line, in code points; what is left of it fits a signed byte
SCAN_BYTES = 4 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class RankIndex:
    """Offsets by rank: lines over ranges of ranks, and what each prediction lacks."""

    def __init__(self, error: int = ERROR):
        self.error, self.size = error, 0
        self._lines: list[tuple[int, int, float]] = []  # first rank, its offset, slope
        self._lacks: list[np.ndarray] = []

    def add(self, offsets: np.ndarray) -> None:
        """More offsets, all at or above those before."""
        at, window = 0, 4096
        while at < len(offsets):
            took, slope = self._grow(offsets, at, window)
            line = offsets[at] + np.rint(slope * np.arange(took)).astype(np.int64)
            self._lines.append((self.size + at, int(offsets[at]), slope))
            self._lacks.append((offsets[at:at + took] - line).astype(np.int8))
            at += took
            window = max(256, 2 * took)
        self.size += len(offsets)

    def _grow(self, offsets: np.ndarray, at: int, window: int) -> tuple[int, float]:
        """How many offsets from ``at`` on one line through the first can cover, and its slope."""
        low, high, covered = -np.inf, np.inf, 1
        while at + covered < len(offsets):
            steps = np.arange(covered, min(covered + window, len(offsets) - at))
            rise = offsets[at + steps] - offsets[at]
            lows = np.maximum.accumulate(np.maximum((rise - self.error) / steps, low))
            highs = np.minimum.accumulate(np.minimum((rise + self.error) / steps, high))
            fails = lows > highs
            end = int(fails.argmax()) if fails.any() else len(steps)
            if end:
                low, high, covered = lows[end - 1], highs[end - 1], covered + end
            if end < len(steps):
                break
        return covered, (low + high) / 2 if covered > 1 else 0.0

    def freeze(self) -> None:
        self._first = np.array([x[0] for x in self._lines], np.int64)
        self._base = np.array([x[1] for x in self._lines], np.int64)
        self._slope = np.array([x[2] for x in self._lines])
        self._lack = np.concatenate(self._lacks) if self._lacks else np.empty(0, np.int8)

    def offset(self, ranks: np.ndarray) -> np.ndarray:
        line = np.searchsorted(self._first, ranks, side="right") - 1
        predicted = self._base[line] + np.rint(self._slope[line] * (ranks - self._first[line])).astype(np.int64)
        return predicted + self._lack[ranks]


def boundaries(texts: pa.Array, index: RankIndex, scan: int = SCAN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Put the offsets of all token starts, and of the end, in the index; return per text the rank of its first
    boundary and the offset it starts at, and those of the end. Offsets run on from text to text, in code points."""
    offset_type = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    starts = np.frombuffer(texts.buffers()[1], offset_type)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    ranks, points = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    passed = 0  # code points before the chunk
    for lo in range(int(starts[0]), int(starts[-1]), scan):
        hi = min(lo + scan, int(starts[-1]))
        chunk = data[lo:hi]
        letter = _LETTER[chunk]
        before = np.empty_like(letter)
        before[0] = lo > starts[0] and _LETTER[data[lo - 1]]
        before[1:] = letter[:-1]
        a, z = np.searchsorted(starts, [lo, hi])  # texts that start in this chunk
        first = starts[a:z] - lo
        before[first] = False
        lead = (chunk & 0xC0) != 0x80
        count = np.cumsum(lead, dtype=np.int32)
        token = np.flatnonzero(lead & ~(letter & before))
        ranks[a:z] = index.size + np.searchsorted(token, first)
        points[a:z] = passed + count[first] - lead[first]
        index.add(passed + count[token].astype(np.int64) - 1)
        passed += int(count[-1])
    tail = np.searchsorted(starts, starts[-1])  # empty texts at the end start where all ends
    ranks[tail:], points[tail:] = index.size, passed
    index.add(np.array([passed]))
    index.freeze()
    return ranks, points


def _cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Tokens of every text, and the ends of prefix and middle, which the draws choose."""
    index = RankIndex()
    ranks, points = boundaries(text, index)
    n = np.diff(ranks)
    draws = [np.asarray(x.to_numpy(zero_copy_only=False), np.int64) % (n + 1) for x in (one, two)]
    cut = [index.offset(ranks[:-1] + f(*draws)) - points[:-1] for f in (np.minimum, np.maximum)]
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, *cut)], ["n", "first", "second"])


def _draw(number: int) -> Column:
    group = F.substring("_hash", 8 * number - 7, 8)
    return F.conv(group, 16, 10).cast("long")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain: int = 90, spm: int = 20) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, output. Of 100 texts ``plain`` are cut, ``spm`` of
    100 of these in the order suffix, prefix, middle."""
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))) \
        .withColumn("_hash", F.sha2(F.concat(F.lit("1:"), text_of("doc_id")).cast("binary"), 256))
    cuts = F.arrow_udf(_cuts, "struct<n:long,first:long,second:long>")
    cut = rows.withColumn("_c", cuts("text", _draw(1), _draw(2)))
    holds = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        holds = holds | F.contains("text", F.lit(sentinel))
    stays = (F.col("text") == "") | holds | (_draw(3) % 100 >= plain)
    form = F.when(stays, "plain").when(_draw(4) % 100 < spm, "spm").otherwise("psm")
    parts = cut.select(
        "doc_id", "text", F.col("_c.n").alias("n"), form.alias("form"),
        F.col("_c.first").alias("a"), F.col("_c.second").alias("b"))
    a, b, text = F.col("a").cast("int"), F.col("b").cast("int"), F.col("text")
    prefix, middle, suffix = F.substr(text, F.lit(1), a), F.substr(text, a + 1, b - a), F.substr(text, b + 1)
    output = F.when(F.col("form") == "plain", text) \
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)) \
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    chars = F.col("form") != "plain"
    return parts.select("doc_id", "n", "form", F.when(chars, F.col("a")).alias("prefix_chars"),
                        F.when(chars, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text. A cut text holds no sentinel, and none can arise where a part meets one, as only its first
    character is ``<``: the first of each kind is the one that was put in."""
    first = F.when(form == "psm", F.substring_index(output, SUFFIX, 1)).otherwise(F.substring_index(output, PREFIX, 1))
    head = F.substr(first, F.lit(len(PREFIX) + 1))
    rest = F.substr(output, F.length(head) + 1 + 2 * len(PREFIX))
    tail, middle = F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
