"""Quality scores from a factorisation machine (operator 9).

Features of a text: hashed words and hashed word shapes (each block of length 1), and statistics of
its structure with the number of characters the table states, cut into bins. A score is
``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j`` through the logistic function; the pairs cost
linear time, ``((sum v x)^2 - sum v^2 x^2) / 2`` per factor. The model is fitted on at most
``rows`` labelled rows, the first by a hash of their id; features are made on the executors, and
only those of the sample reach the driver. Scoring is row-local.

Null and empty texts have statistics only and get a score like any other. Texts are read whole.
Null labels and ids don't teach; of repeated labels of an id the largest counts. Without two
classes every score is the share of label 1 (a half without labels). A missing number of characters is
taken from the text. Only the named columns are looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.rows import text_of
from holdfast.storage import spread

WORDS, SHAPES, BINS, FACTORS = 1 << 14, 1 << 10, 12, 8
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
UPPER, DIGITS, SPACES = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\x0b\x0c\r"
#: Letters, digits and others to one sign of each kind; runs are then shortened.
KINDS = bytes((65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else 48 if 48 <= b < 58 else b) for b in range(256))
STATISTICS = 14
SIZE = WORDS + SHAPES + STATISTICS * BINS


def without(text: bytes, some: bytes) -> int:
    return len(text) - len(text.translate(None, some))


def statistics(text: bytes, words: list[bytes], counts: Counter, chars: float) -> list[float]:
    """Numbers between 0 and 1 for the structure of a text."""
    size, n = max(1, len(text)), max(1, len(words))
    letters, lines = without(text, LETTERS), [line for line in text.split(b"\n") if line]
    spaces = without(text, SPACES)
    digits, upper = without(text, DIGITS), without(text, UPPER)
    odd = len(text) - letters - digits - spaces
    return [
        np.log1p(chars) / 16, np.log1p(len(words)) / 14, letters / size, min(1, 4 * digits / size), upper / max(1, letters),
        min(1, 4 * odd / size), min(1, (size - spaces) / n / 16), len(counts) / n,
        sum(map(eq, words, words[1:])) / n, min(1, 4 * max(counts.values(), default=0) / n),
        len(set(lines)) / max(1, len(lines)), min(1, len(lines) / n * 4), min(1, np.log1p(size / max(1, len(lines))) / 10),
        min(1, 4 * (text.count(b"|") + text.count(b"!")) / n),
    ]


def features(text: bytes, chars: float | None, known: dict) -> tuple[list[int], list[float]]:
    """Positions and values; ``known`` remembers the buckets of words."""
    words = text.split()
    counts = Counter(words)
    own, shapes = Counter(), Counter()
    for word, n in counts.items():
        at = known.get(word)
        if at is None:
            shape = re.sub(rb"(.)\1+", rb"\1", word.translate(KINDS))
            at = known[word] = (crc32(word.lower()) % WORDS, WORDS + crc32(shape) % SHAPES)
        own[at[0]] += n
        shapes[at[1]] += n
    if len(known) > 100_000:
        known.clear()
    at, values = [*own, *shapes], np.sqrt(np.array([*own.values(), *shapes.values()], float))
    for part in (slice(0, len(own)), slice(len(own), None)):
        values[part] /= max(1e-9, np.sqrt((values[part] ** 2).sum()))
    seen = statistics(text, words, counts, float(chars if chars is not None and chars >= 0 else len(text.decode(errors="replace"))))
    bins = [WORDS + SHAPES + i * BINS + int(min(BINS - 1, max(0, s) * BINS)) for i, s in enumerate(seen)]
    return at + bins, values.tolist() + [0.5] * len(bins)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the rows' sums of v x."""
        vx = self.factors[at] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = (sums ** 2 - np.add.reduceat(vx ** 2, starts, axis=0)).sum(axis=1) / 2
        return self.bias + np.add.reduceat(self.linear[at] * values, starts) + pairs, sums


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, batch: int = 128,
        step: float = 0.08, decay: float = 2e-4, seed: int = 7) -> Model:
    """Gradient steps scaled by the gradients so far, over rows (positions, values, label)."""
    labels = np.array([r[2] for r in rows], float)
    model = Model(0.0, np.zeros(SIZE), np.random.default_rng(seed).normal(0, 0.02, (SIZE, FACTORS)))
    if len(set(labels.tolist())) < 2:
        share = labels.mean() if len(labels) else 0.5
        model.bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        model.factors[:] = 0
        return model
    model.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    seen_w, seen_v, rng = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), batch):
            own = [rows[i] for i in order[begin:begin + batch]]
            sizes = np.array([len(r[0]) for r in own])
            at, values = np.concatenate([r[0] for r in own]).astype(np.int64), np.concatenate([r[1] for r in own]).astype(float)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            raw, sums = model.raw(at, values, starts)
            error = (logistic(raw) - np.array([r[2] for r in own])) / len(own)
            weight = np.repeat(error, sizes) * values
            vx = model.factors[at] * values[:, None]
            each = weight[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            used, where = np.unique(at, return_inverse=True)
            grad = np.bincount(where, weight) + decay * model.linear[used]
            seen_w[used] += grad ** 2
            model.linear[used] -= step * grad / np.sqrt(seen_w[used])
            for f in range(FACTORS):
                grad = np.bincount(where, each[:, f]) + decay * model.factors[used, f]
                seen_v[used, f] += grad ** 2
                model.factors[used, f] -= step / 2 * grad / np.sqrt(seen_v[used, f])
            model.bias -= step / 10 * float(error.sum())
    return model


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        made = [features((t or "").encode(), c, known) for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32())),
             batch.column(2), batch.column(3)], ["at", "values", "label", "place"])


def train(docs: DataFrame, labels: DataFrame, rows: int = 8192, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", chars_col: str = "n_chars") -> Model:
    """Fit on the first ``rows`` labelled documents by hash of the id."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna() \
        .groupBy("id").agg(F.max("label").alias("label")) \
        .withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(rows)  # the bound makes the broadcast safe
    taught = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(chars_col).cast("double").alias("chars")) \
        .join(F.broadcast(marked), "id").select("text", "chars", "label", "place")
    made = taught.mapInArrow(_vectors, "at array<int>, values array<float>, label int, place long").toArrow().combine_chunks()
    # The order must not depend on how the rows were dealt out.
    order = sorted(range(made.num_rows), key=lambda i: (made["place"][i].as_py(), len(made["at"][i])))
    at, values, label = (made[c].combine_chunks() for c in ("at", "values", "label"))
    rows = [(at[i].values.to_numpy(), values[i].values.to_numpy(), label[i].as_py()) for i in order]  # no copies
    return fit(rows)


def scorer(model: Model) -> Callable:
    """Column function: (text, characters stated) -> score between 0 and 1."""
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict = {}
        for texts, chars in batches:
            out = []
            stated = chars.to_pylist()
            for begin in range(0, len(stated), 256):
                made = [features((t.as_py() or "").encode(), c, known)
                        for t, c in zip(texts[begin:begin + 256], stated[begin:begin + 256])]
                starts = np.cumsum([0, *[len(m[0]) for m in made[:-1]]])
                at = np.array([i for m in made for i in m[0]], np.int64)
                values = np.array([v for m in made for v in m[1]])
                out.append(logistic(model.raw(at, values, starts)[0]))
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the ids whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, rows: int = 8192) -> DataFrame:
    """All rows and columns of ``docs`` as struct ``row``, with held_out and score."""
    model = train(docs, labels.where(~held_out()), rows)
    packed = spread(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    return packed.withColumn("held_out", held_out("row.doc_id")).withColumn(
        "score", scorer(model)(F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.col("row.n_chars").cast("double")))
