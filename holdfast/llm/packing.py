"""Packing token sequences by cutting stock (operator 1).

Documents become pieces of at most ``size`` ids: full ones from the front and one rest. Rests
fall into length classes of ``grain`` ids, so the histogram is bounded by ``size / grain``
whatever the corpus. Over it a linear program chooses how often each pattern (classes that fill
one sequence together) is used: a revised simplex with one row per class, whose next column
a knapsack dynamic program finds from the prices. The solution is rounded down; what is left, at most
one sequence for each pattern in use, is packed by first fit. The plan, bounded like the
histogram, goes to all tasks; each piece finds its sequence from its rank in its class, and its
offset from a window over its sequence. Ranks come from counts for each class and input part, so a
class that holds most rows is many groups.

No row, an empty text: a document is one end id, hence one piece. Null texts count as empty.
Repeated rows and equal ids are packed one by one; ties in rank go by id, then start. Texts are
taken whole. Pieces carry only the named columns, so other columns of the input can't clash.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.llm.rows import text_of
from holdfast.storage import spread, written

SIZE = 4096


#: Words that are one pre-token; and where such a word ends before a sign, at which the tokenizer cuts as well (not
#: before an apostrophe, which may start a contraction).
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
CUT = r"([A-Za-zß-öø-ÿ])([!-&(-/:-@\[-`{-~])"


class Encoder:
    """Ids of texts for a BPE tokenizer that drops white space and case."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        model, vocabulary = self.library.model, self.library.get_vocab()
        self.words = Tokenizer(model)  # for words that are cut, in lower case and spelled in the vocabulary's signs
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # Whether an id ends a word; without such a sign in the vocabulary, words are encoded one by one.
        suffix = model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        # The signs that stand for the bytes of a word inside the vocabulary.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.signs = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def spelled(self, words: pa.Array) -> str:
        """The words as the vocabulary spells them, with blanks between."""
        text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), pc.utf8_lower(words)), " ")[0].as_py()
        return text if text.isascii() else " ".join(w.encode().decode("latin-1").translate(self.signs) for w in text.split(" "))

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words in one array, and where each word's begin and how many there are."""
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        beyond = pc.binary_length(words).to_numpy() - pc.utf8_length(words).to_numpy()
        held, have, odd = [], 0, [np.flatnonzero(~plain)]
        plain = np.flatnonzero(plain)
        plain = plain[np.argsort(beyond[plain] > 0, kind="stable")]  # words of ASCII letters first
        for at in range(0, len(plain), 4000):  # as one text: the ids tell where words end
            some = plain[at:at + 4000]
            ids = np.array(self.words.encode_batch_fast([self.spelled(words.take(pa.array(some)))], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids])
            if len(ends) != len(some):
                odd.append(some)
                continue
            sizes[some] = np.diff(ends, prepend=-1)
            starts[some] = have + ends + 1 - sizes[some]
            held.append(ids)
            have += len(ids)
        odd = np.concatenate(odd)
        for at in range(0, len(odd), 2000):
            some = odd[at:at + 2000]
            found = [e.ids for e in self.library.encode_batch_fast(words.take(pa.array(some)).to_pylist(), add_special_tokens=False)]
            sizes[some] = [len(ids) for ids in found]
            starts[some] = have + np.cumsum(sizes[some]) - sizes[some]
            held.append(np.array([i for ids in found for i in ids], "<u4"))
            have += len(held[-1])
        return np.concatenate(held) if held else np.zeros(0, "<u4"), starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and the last one's end."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else there may be special tokens, which stay whole
            texts = pc.replace_substring_regex(texts, CUT, r"\1 \2")
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        flat, starts, sizes = self.ids_of(coded.dictionary)
        which = coded.indices.to_numpy()
        own = sizes[which]
        ends = np.concatenate([[0], np.cumsum(own)])
        places = np.repeat(starts[which] - ends[:-1], own) + np.arange(ends[-1])
        return flat[places], ends[words.offsets.to_numpy() - words.offsets[0].as_py()]


_ENCODERS: dict[str, Encoder] = {}


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32 bit).

    The distinct words of some megabytes of text are tokenised once; the tokenizer drops white space, so
    the ids of a text are those of its words in a row.
    """
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        encoder = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, Encoder(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            bytes_before = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < len(texts):  # some megabytes of text at a time
                done = bytes_before[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(bytes_before, done + 8_000_000, side="right")))
                ids, ends = encoder.encode(texts.slice(at, stop - at))
                out = []
                for k in range(at, stop):
                    whole = ids[ends[k - at]:ends[k - at + 1]].tobytes() + end
                    total = len(whole) // 4
                    out += [(doc_ids[k], s, min(size, total - s), total, whole[4 * s:4 * (s + size)]) for s in range(0, total, size)]
                at = stop
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (batch.column(0).type, *[pa.int64()] * 3, pa.binary()))],
                    ["doc_id", "start", "length", "doc_tokens", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of highest price: class i takes i + 1 units, prices[i] each, any number of times."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        # Item i leaves room - i - 1 units.
        sums = prices[:room] + best[room - 1::-1][:len(prices)]
        i = int(sums.argmax())
        best[room], choice[room] = sums[i], i
        if best[room] <= best[room - 1]:
            best[room], choice[room] = best[room - 1], -1
    pattern, room = np.zeros(len(prices), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= choice[room] + 1
    return float(best[capacity]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with pivots. The library's own may wait for its threads for ever in a driver, which has started a JVM."""
    rest, inverse = matrix.astype(float), np.eye(len(matrix))
    for k in range(len(rest)):
        pivot = k + int(np.abs(rest[k:, k]).argmax())
        for side in (rest, inverse):
            side[[k, pivot]] = side[[pivot, k]]
        inverse[k] /= rest[k, k]
        rest[k, k:] /= rest[k, k]
        own = np.flatnonzero(rest[:, k])
        own = own[own != k]
        factors, reach = rest[own, k], np.flatnonzero(inverse[k])
        rest[own, k:] -= np.outer(factors, rest[k, k:])
        inverse[np.ix_(own, reach)] -= np.outer(factors, inverse[k, reach])
    return inverse


def column_generation(demand: np.ndarray, rounds: int = 4000, gap: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per row) and how often each is used, possibly in fractions, to cover ``demand``.

    Class i fills i + 1 of len(demand) units. The basis starts with sequences of a single class.
    ``rounds`` bounds the search for better patterns: an early end still covers the demand.
    """
    units = len(demand)
    classes = np.flatnonzero(demand)
    n = len(classes)
    if not n:
        return np.zeros((0, units), np.int64), np.zeros(0)
    fits = units // (classes + 1)
    patterns = np.zeros((n, units), np.int64)
    patterns[np.arange(n), classes] = fits
    inverse, used = np.diag(1.0 / fits), demand[classes] / fits
    for turn in range(rounds):
        if turn % 200 == 199:  # rounding errors don't build up
            inverse = inverted(patterns[:, classes].T)
            used = np.maximum(inverse @ demand[classes], 0)
        prices = np.zeros(units)
        prices[classes] = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = knapsack(prices, units)
        if value <= 1 + gap:  # then no solution uses fewer than 1 / value of these sequences
            break
        step = inverse @ pattern[classes]
        room = np.full(n, np.inf)
        np.divide(used, step, out=room, where=step > 1e-9)
        out = int(room.argmin())
        if not np.isfinite(room[out]):
            break
        used = np.maximum(used - room[out] * step, 0)
        used[out] = room[out]
        patterns[out] = pattern
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return patterns, used


def plan(histogram: dict[int, int], units: int) -> dict[int, np.ndarray]:
    """For each class, rows (first rank, rank after the last, per sequence, first sequence) by rank.

    A class is its size in units. Sequences are numbered from 0; every rank below the class's
    count is in exactly one row.
    """
    demand = np.zeros(units, np.int64)
    for c, n in histogram.items():
        demand[c - 1] = n
    patterns, used = column_generation(demand)
    left, taken = demand.copy(), []
    for pattern, times in zip(patterns, np.floor(used + 1e-9).astype(np.int64)):
        own = np.flatnonzero(pattern)
        # Patterns may offer more of a class than is there.
        times = min(int(times), int((left[own] // pattern[own]).min())) if len(own) else 0
        if times:
            left -= times * pattern
            taken.append((pattern, times))
    rest = np.repeat(np.arange(units), left)[::-1]
    open_room, open_items = np.zeros(0, np.int64), []
    for c in rest:  # the fullest sequence that still has room, else a new one
        fit = np.flatnonzero(open_room >= c + 1)
        if len(fit):
            k = int(fit[open_room[fit].argmin()])
        else:
            k, open_room = len(open_items), np.append(open_room, units)
            open_items.append(np.zeros(units, np.int64))
        open_items[k][c] += 1
        open_room[k] -= c + 1
    placed: dict[int, list] = {}
    ranks, sequence = np.zeros(units, np.int64), 0
    for pattern, times in [*taken, *((p, 1) for p in open_items)]:
        for c in np.flatnonzero(pattern):
            each = int(pattern[c])
            placed.setdefault(int(c) + 1, []).append((ranks[c], ranks[c] + each * times, each, sequence))
            ranks[c] += each * times
        sequence += times
    return {c: np.array(rows, np.int64) for c, rows in placed.items()}


def pack(pieces: DataFrame, size: int = SIZE, grain: int = 8) -> DataFrame:
    """``pieces`` (doc_id, start, length and others) with sequence_id and offset added."""
    units = size // grain
    cls, part, rank, base = "_class", "_part", "_rank", "_base"
    parts = written(pieces.withColumns({cls: F.ceil(F.col("length") / grain).cast("int"),
                                        part: F.spark_partition_id()}), "pieces")
    counts = written(parts.groupBy(cls, part).agg(F.count("*").alias("_n")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy(cls).agg(F.sum("_n")).collect()}  # at most ``units`` rows
    layout = plan(histogram, units)
    before = W.partitionBy(cls).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(cls, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(base))
    order = [c for c in ("doc_id", "start", "length", "ids_crc32") if c in pieces.columns]
    ranked = parts.withColumn(rank, F.row_number().over(W.partitionBy(cls, part).orderBy(*order)) - 1) \
        .join(bases, [cls, part]).withColumn(rank, F.col(rank) + F.col(base))

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            classes, ranks = batch.field(0).to_numpy(zero_copy_only=False), batch.field(1).to_numpy(zero_copy_only=False)
            at, slot = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)
            for c in np.unique(classes):
                own = np.flatnonzero(classes == c)
                rows = layout[int(c)]
                k = rows[np.searchsorted(rows[:, 0], ranks[own], side="right") - 1]
                at[own] = k[:, 3] + (ranks[own] - k[:, 0]) // k[:, 2]
                slot[own] = (ranks[own] - k[:, 0]) % k[:, 2]
            yield pa.StructArray.from_arrays([pa.array(at), pa.array(slot)], ["sequence", "slot"])

    place.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    find = F.arrow_udf(place, "sequence long, slot long")
    found = ranked.withColumn("_at", find(F.struct(F.col(cls), F.col(rank).cast("long"))))
    inside = W.partitionBy("sequence_id").orderBy(F.desc(cls), "_at.slot").rowsBetween(W.unboundedPreceding, -1)
    return found.withColumn("sequence_id", F.col("_at.sequence")) \
        .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))) \
        .select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (binary, as in the pieces)."""
    rows = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    joined = F.aggregate("_p.ids", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return rows.select("sequence_id", "length", joined.alias("ids"))
