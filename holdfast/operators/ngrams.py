"""Word-bounded character n-grams: vocabulary, counts, and idf weights.

The vocabulary needs corpus totals only, so words are counted first and each distinct
word is cut into n-grams once. Counting the terms of a row is row-local: an Arrow
batch goes in, (term, count) arrays come out, and nothing is exploded or shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.storage import spread, written

WHITE_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WHITE_SPACE), lambda w: w != "")


def grams_of(words: DataFrame) -> DataFrame:
    """(n, word) rows to (n, term): all n-grams of the word with one blank on either side."""
    sizes = F.array(*[F.lit(k) for k in fixed.NGRAM_SIZES])
    padded = words.select("n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("word"), F.explode(sizes).alias("size"))
    places = padded.where(F.length("word") >= F.col("size")) \
        .select("n", "word", "size", F.explode(F.expr("sequence(1, length(word) - size + 1)")).alias("at"))
    return places.select("n", F.substring("word", F.col("at"), F.col("size")).alias("term"))


def gram_totals(rows: DataFrame, text: Column) -> DataFrame:
    """Corpus count of every n-gram. Hot words fold on the map side."""
    words = spread(rows.select(text.alias("text"))).select(F.explode(words_of(F.col("text"))).alias("word")) \
        .groupBy("word").agg(F.count("*").alias("n"))
    return grams_of(words).groupBy("term").agg(F.sum("n").alias("total"))


def vocabulary(rows: DataFrame, text: Column, size: int = fixed.MAX_VOCABULARY) -> DataFrame:
    """The most frequent n-grams (term asc on ties): term, total."""
    totals = written(gram_totals(rows, text), "gram-totals")
    # Rank only terms whose total can be among the best: a histogram by powers of two
    # (at most 64 rows) tells from which power on there are enough of them.
    power = F.floor(F.log2("total")).cast("int")
    least, have = 0, 0
    for r in totals.groupBy(power.alias("p")).agg(F.count("*").alias("n")).orderBy(F.desc("p")).collect():
        have, least = have + r["n"], r["p"]
        if have >= size:
            break
    return totals.where(power >= least).orderBy(F.desc("total"), "term").limit(size)


class GramIndex:
    """The vocabulary by gram size: sorted 64-bit codes of the grams, their characters, and their numbers."""

    def __init__(self, terms: list[str], sizes=fixed.NGRAM_SIZES):
        rng = np.random.default_rng(len(terms))
        self.size, self.tables = len(terms), {}
        lengths = np.array([len(t) for t in terms], np.int64)
        for k in sizes:
            number = np.flatnonzero(lengths == k)
            points = _code_points("".join(terms[i] for i in number)).reshape(-1, k)
            while True:  # until no two grams share a code
                factors = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                codes = (points.astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
                order = np.argsort(codes)
                if (codes[order][1:] != codes[order][:-1]).all():
                    break
            self.tables[k] = factors, codes[order], points[order], number[order]

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per word with a blank on either side its grams in the vocabulary: offsets, and term numbers."""
        blank = pa.scalar(" ", words.type)
        padded = pc.binary_join_element_wise(blank, words, blank, pa.scalar("", words.type))
        lengths = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
        points = _code_points("".join(padded.to_pylist()))
        ends = np.repeat(np.cumsum(lengths), lengths)
        word = np.repeat(np.arange(len(lengths)), lengths)
        owners, found = [], []
        for k, (factors, codes, grams, number) in self.tables.items():
            if not len(codes):
                continue
            at = np.flatnonzero(np.arange(len(points)) + k <= ends)
            code = np.zeros(len(at), np.uint64)
            for j in range(k):
                code += points[at + j].astype(np.uint64) * factors[j]
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = np.flatnonzero(codes[place] == code)
            at, place = at[hit], place[hit]
            same = np.ones(len(at), bool)
            for j in range(k):
                same &= points[at + j] == grams[place, j]
            owners.append(word[at[same]])
            found.append(number[place[same]])
        if not owners:
            return np.zeros(len(lengths) + 1, np.int64), np.empty(0, np.int64)
        owner, term = np.concatenate(owners), np.concatenate(found)
        order = np.argsort(owner, kind="stable")
        return np.searchsorted(owner[order], np.arange(len(lengths) + 1)), term[order]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _row_terms(index: GramIndex, offsets: np.ndarray, word: np.ndarray, grams: tuple[np.ndarray, np.ndarray],
               cells: int = 2_000_000):
    """Rows given as word numbers, to their terms and counts, some rows at a time: (terms per row, terms, counts)."""
    starts, flat = grams
    many = np.diff(starts)
    step = max(1, cells // max(index.size, 1))
    for lo in range(0, len(offsets) - 1, step):
        at = offsets[lo:lo + step + 1]
        rows = len(at) - 1
        row = np.repeat(np.arange(rows), np.diff(at))
        pair, times = np.unique(row * len(many) + word[at[0]:at[-1]], return_counts=True)
        row, own = np.divmod(pair, max(len(many), 1))
        reps = many[own]
        first = np.repeat(starts[own] - np.r_[0, np.cumsum(reps)[:-1]], reps) if len(own) else np.empty(0, np.int64)
        term = flat[first + np.arange(len(first))]
        seen = np.bincount(np.repeat(row, reps) * index.size + term, weights=np.repeat(times, reps),
                           minlength=rows * index.size)
        cell = np.flatnonzero(seen)
        yield np.bincount(cell // max(index.size, 1), minlength=rows), cell % max(index.size, 1), seen[cell]


def _some_rows(offsets: np.ndarray, words: int):
    """Ranges of rows with about so many words, of one row at least."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + words, side="right")) - 1)
        yield lo, hi
        lo = hi


def term_counter(terms: list[str], words_at_once: int = 200_000):
    """UDF: lower-cased words of a text -> terms found and how often. ``terms`` is the vocabulary.

    Some rows of a batch at a time; every distinct word of theirs is cut once, all words side by side.
    """
    built: list[GramIndex] = []

    @F.arrow_udf("struct<terms:array<int>,counts:array<int>>")
    def counter(words: pa.Array) -> pa.Array:
        if not built:
            built.append(GramIndex(terms))
        offsets = words.offsets.to_numpy()
        ends, ids, counts = [np.zeros(1, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for lo, hi in _some_rows(offsets, words_at_once):
            at = offsets[lo:hi + 1]
            known = words.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
            grams = built[0].of_words(known.dictionary)
            number = known.indices.to_numpy(zero_copy_only=False)
            for many, term, times in _row_terms(built[0], at - at[0], number, grams):
                ends.append(many)
                ids.append(term.astype(np.int32))
                counts.append(times.astype(np.int32))
        at = pa.array(np.cumsum(np.concatenate(ends)), pa.int32())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (ids, counts)], ["terms", "counts"])

    return counter


def document_frequency(rows: DataFrame, size: int, copies: Column | None = None) -> np.ndarray:
    """Rows holding each term, from a table with ``terms``; at most ``size`` numbers."""
    out = np.zeros(size, dtype=np.int64)
    spread = rows.select(F.explode("terms").alias("term"), *([copies.alias("c")] if copies is not None else []))
    n = F.sum("c") if copies is not None else F.count("*")
    for r in spread.groupBy("term").agg(n.alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def idf_weights(frequency: np.ndarray, rows: int) -> np.ndarray:
    """ln((1 + rows) / (1 + frequency)) + 1"""
    return np.log((1 + rows) / (1 + frequency)) + 1


def tfidf_weigher(idf: np.ndarray):
    """UDF: (terms, counts, scale) -> weights of norm ``scale``."""

    @F.arrow_udf("array<double>")
    def weigh(terms: pa.Array, counts: pa.Array, scale: pa.Array) -> pa.Array:
        offsets = terms.offsets.to_numpy()
        ids = terms.values.to_numpy()[offsets[0]:offsets[-1]]
        at = counts.offsets.to_numpy()
        times = counts.values.to_numpy()[at[0]:at[-1]]
        w = idf[ids] * times
        length = np.diff(offsets)
        row = np.repeat(np.arange(len(length)), length)
        norm = np.sqrt(np.bincount(row, weights=w * w, minlength=len(length)))
        w = w / norm[row] * scale.to_numpy(zero_copy_only=False)[row]
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(w, pa.float64()))

    return weigh
