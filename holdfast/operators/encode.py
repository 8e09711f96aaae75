"""Feature columns to unit vectors, so that a dot product is a cosine.

Numbers are standardised (columns of numbers and columns of vectors alike, dimension by dimension), categories one-hot, text n-gram weighted; each block is
scaled to norm 1 (a zero block stays zero), and the whole row again. What has to be
learned (levels, medians, means, vocabulary, idf) is small and bounded; applying it is
a map over rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import fixed
from holdfast.functions.columns import parsed_number, parsed_number_sql
from holdfast.operators.duplicates import exact_key, is_vector
from holdfast.operators.ngrams import (
    WHITE_SPACE, document_frequency, idf_weights, term_counter, tfidf_weigher, vocabulary,
)
from holdfast.operators.quantiles import exact_quantiles
from holdfast.storage import written
from holdfast.table import AuditTable

NUMERIC, VECTOR, CATEGORICAL, TEXT = "numeric", "vector", "categorical", "text"
_NUMBERS = (T.NumericType,)


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(fixed.MISSING_TEXT))


def column_profile(df: DataFrame, features) -> DataFrame:
    """Per feature column: parsable share, number of levels if few, and its kind.

    Distinct values are estimated for all columns in one pass. An estimate that small
    is sharp, and only columns near the limit are counted exactly, so free text is
    never shuffled.
    """
    spark = df.sparkSession
    probes = [F.count("*").alias("rows")]
    vectors = {c for c in features if is_vector(df.schema[c].dataType)}
    for i, c in enumerate(features):
        probes.append(F.count(F.col(f"`{c}`")).alias(f"p{i}") if c in vectors else F.expr(f"count({parsed_number_sql(df, c)}) AS p{i}"))
        if c not in vectors and not isinstance(df.schema[c].dataType, _NUMBERS):
            probes.append(F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(f"d{i}"))
    seen = df.agg(*probes).first()
    rows = max(seen["rows"], 1)
    kinds, unsure = {}, []
    for i, c in enumerate(features):
        if c in vectors:
            kinds[c] = VECTOR
        elif isinstance(df.schema[c].dataType, _NUMBERS) or seen[f"p{i}"] / rows > fixed.NUMERIC_PARSE_SHARE:
            kinds[c] = NUMERIC
        elif seen[f"d{i}"] > 4 * fixed.MAX_CATEGORY_LEVELS:
            kinds[c] = TEXT
        else:
            unsure.append(c)
    levels = {c: 0 for c in unsure}
    if unsure:
        for r in level_values(df, unsure).groupBy("column").agg(F.count("level").alias("n")).collect():
            levels[r["column"]] = r["n"]
    for c in unsure:
        kinds[c] = CATEGORICAL if levels[c] <= fixed.MAX_CATEGORY_LEVELS else TEXT
    return spark.createDataFrame(
        [(c, kinds[c], seen[f"p{i}"] / rows,
          levels[c] if kinds[c] == CATEGORICAL else None) for i, c in enumerate(features)],
        "column string, kind string, parsed_share double, levels bigint")


def level_values(df: DataFrame, columns) -> DataFrame:
    """The distinct values of low-cardinality columns: column, level (null = missing)."""
    cells = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in columns]))
    return df.select(cells).distinct()


@dataclass(frozen=True)
class Encoding:
    """All that was learned from the compared rows."""

    numeric: list[tuple[str, float, float, float]] = field(default_factory=list)  # name, fill, mean, sd
    categorical: list[tuple[str, list[str]]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    rows: int = 0
    idf: np.ndarray | None = None
    vectors: list[tuple[str, np.ndarray]] = field(default_factory=list)  # name, rows of fill, mean, sd

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(v.shape[1] for _, v in self.vectors) + sum(len(v) for _, v in self.categorical) + len(self.terms)

    @property
    def description(self) -> str:
        parts = [(len(self.numeric), NUMERIC), (len(self.vectors), VECTOR), (len(self.categorical), CATEGORICAL), (len(self.text), TEXT)]
        return ", ".join(f"{n} {kind}" for n, kind in parts if n) or "no usable features"

    # -------------------------------------------------------------- row-local columns

    def standardised(self, df: DataFrame) -> dict[str, Column]:
        return {
            name: F.expr(f"(coalesce({parsed_number_sql(df, name)}, {fill!r}D) - {mean!r}D) / {sd!r}D")
            for name, fill, mean, sd in self.numeric
        }

    def one_hot(self, name: str, levels: list[str]) -> Column:
        value = _text(name)
        return F.array(*[F.when(value == F.lit(level), 1.0).otherwise(0.0) for level in levels])

    def joined_text(self) -> Column:
        return F.concat_ws(" ", *[_text(c) for c in self.text])

    def apply(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """The kept columns and the row's blocks: dense, terms, counts, blocks."""
        empty_ints = F.array().cast("array<int>")
        numbers = [F.array(*self.standardised(df).values()).cast("array<double>")] if self.numeric else []
        numbers += [vector_standardiser(*learned)(F.col(f"`{c}`").cast("array<double>")) for c, learned in self.vectors]
        df = df.select(
            *keep,
            (F.concat(*numbers) if numbers else F.array().cast("array<double>")).alias("_z"),
            (F.concat(*[self.one_hot(c, levels) for c, levels in self.categorical])
             if self.categorical else F.array().cast("array<double>")).alias("_hot"),
            (term_counter(self.terms)(F.split(F.lower(self.joined_text()), WHITE_SPACE))
             if self.terms else F.struct(empty_ints.alias("terms"), empty_ints.alias("counts"))).alias("_t"),
        )
        norm = F.sqrt(F.aggregate("_z", F.lit(0.0), lambda s, x: s + x * x))
        df = df.withColumn("_norm", norm)
        blocks = (F.col("_norm") > 0).cast("int") + F.lit(int(bool(self.categorical))) \
            + (F.size("_t.terms") > 0).cast("int")
        df = df.withColumn("blocks", blocks)
        per_number = 1.0 / (F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(1.0)
                            * F.sqrt(F.greatest("blocks", F.lit(1))))
        per_level = 1.0 / F.sqrt(F.lit(float(max(1, len(self.categorical)))) * F.greatest("blocks", F.lit(1)))
        df = df.withColumns({"_pn": per_number, "_pl": per_level})
        return df.select(
            *keep,
            F.concat(F.transform("_z", lambda x: x * F.col("_pn")),
                     F.transform("_hot", lambda x: x * F.col("_pl"))).alias("dense"),
            F.col("_t.terms").alias("terms"), F.col("_t.counts").alias("counts"), "blocks",
        )

    def weighted(self, encoded: DataFrame) -> DataFrame:
        """``counts`` turned into ``weights``; rows that encode to nothing are dropped,
        since their cosine with every row is 0."""
        weights = F.array().cast("array<double>")
        if self.terms:
            weights = tfidf_weigher(self.idf)("terms", "counts", _text_scale())
        return encoded.where("blocks > 0").withColumn("weights", weights).drop("counts", "blocks")


def fit_numeric(df: DataFrame, columns: list[str],
                holed: list[str] | None = None) -> list[tuple[str, float, float, float]]:
    """Per column: fill value (median, or 0 when all is missing), mean, population sd
    (1 when constant). Medians are looked for only in columns with gaps; ``holed``
    names them when that is known."""
    if not columns:
        return []
    parsed = df.select(*[parsed_number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    if holed is None:
        gaps = parsed.agg(*[F.expr(f"count_if(c{i} IS NULL)") for i in range(len(columns))]).first()
        holed = [c for i, c in enumerate(columns) if gaps[i]]
    where = {c: f"c{i}" for i, c in enumerate(columns)}
    medians = exact_quantiles(parsed, [where[c] for c in holed], 0.5) if holed else {}
    fill = {c: float(medians.get(where[c]) or 0.0) for c in columns}
    filled = parsed.select(*[F.expr(f"coalesce({where[c]}, {fill[c]!r}D)").alias(where[c]) for c in columns])
    stats = filled.agg(*[
        F.expr(f"{f}({where[c]}) AS {f}_{where[c]}") for c in columns for f in ("avg", "stddev_pop", "min", "max")
    ]).first()

    def learned(c: str) -> tuple[str, float, float, float]:
        at = where[c]
        flat = stats[f"min_{at}"] == stats[f"max_{at}"] or not stats[f"stddev_pop_{at}"]
        return c, fill[c], stats[f"avg_{at}"] or 0.0, 1.0 if flat else stats[f"stddev_pop_{at}"]

    return [learned(c) for c in columns]


def vector_standardiser(fill: np.ndarray, mean: np.ndarray, sd: np.ndarray):
    """UDF: a vector with its gaps filled, standardised. Null and short vectors are gaps, null and NaN entries too."""

    @F.arrow_udf("array<double>")
    def standardise(vectors: pa.Array) -> pa.Array:
        offsets = vectors.offsets.to_numpy()
        flat = vectors.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
        known = (place < len(mean)) & ~np.isnan(flat)
        out = np.tile(fill, (len(sizes), 1))
        out[row[known], place[known]] = flat[known]
        at = np.arange(len(sizes) + 1) * len(mean)
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(((out - mean) / sd).ravel()))

    return standardise


def fit_vectors(df: DataFrame, columns: list[str]) -> list[tuple[str, np.ndarray]]:
    """Per vector column, dimension by dimension, what fit_numeric learns per column: rows of fill, mean and sd.

    One aggregate over (column, dimension), folded on the map side. Medians are looked for only in dimensions with gaps.
    """
    if not columns:
        return []
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("array<double>").alias("v")) for i, c in enumerate(columns)])))
    each = cells.select("i", F.posexplode("v").alias("j", "x")).withColumn("x", F.expr("nullif(x, double('NaN'))"))
    seen = each.groupBy("i", "j").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.min("x").alias("least"), F.max("x").alias("most")).collect()
    rows, out = df.count(), []
    for i, c in enumerate(columns):
        own = sorted((r for r in seen if r["i"] == i), key=lambda r: r["j"])
        gaps = [r["j"] for r in own if r["n"] < rows]
        holed = df.select(*[F.expr(f"nullif(CAST(get(`{c}`, {j}) AS DOUBLE), double('NaN'))").alias(f"d{j}") for j in gaps])
        medians = exact_quantiles(holed, [f"d{j}" for j in gaps], 0.5) if gaps else {}
        fill = np.array([medians.get(f"d{r['j']}") or 0.0 for r in own])
        n = np.array([r["n"] for r in own], float)
        mean, var = (np.array([r[f] or 0.0 for r in own]) for f in ("mean", "var"))
        whole = (n * mean + (rows - n) * fill) / rows
        spread = var * n / rows + n * (rows - n) / rows ** 2 * (mean - fill) ** 2
        flat = [r["least"] == r["most"] and (r["n"] == rows or r["least"] == f) for r, f in zip(own, fill)]
        sd = np.sqrt(spread)
        out.append((c, np.array([fill, whole, np.where(np.array(flat, bool) | (sd == 0), 1.0, sd)])))
    return out


def fit(df: DataFrame, features) -> Encoding:
    """Learn the encoding from the rows to compare (all but the idf, see ``encode``)."""
    profile = column_profile(df, features).collect()
    kinds = {r["column"]: r["kind"] for r in profile}
    holed = [r["column"] for r in profile if r["kind"] == NUMERIC and r["parsed_share"] < 1]
    named = {k: [c for c in features if kinds[c] == k] for k in (NUMERIC, VECTOR, CATEGORICAL, TEXT)}
    levels: dict[str, set[str]] = {c: set() for c in named[CATEGORICAL]}
    if levels:
        # at most MAX_CATEGORY_LEVELS and the missing one per column
        for r in level_values(df, list(levels)).collect():
            levels[r["column"]].add(fixed.MISSING_TEXT if r["level"] is None else r["level"])
    terms: list[str] = []
    if named[TEXT]:
        text = F.concat_ws(" ", *[_text(c) for c in named[TEXT]])
        terms = [r["term"] for r in vocabulary(df, text).collect()]
    return Encoding(
        numeric=fit_numeric(df, named[NUMERIC], holed),
        categorical=[(c, sorted(v)) for c, v in levels.items()],
        text=named[TEXT], terms=terms, rows=df.count(), vectors=fit_vectors(df, named[VECTOR]),
    )


def with_idf(encoding: Encoding, frequency: np.ndarray) -> Encoding:
    return replace(encoding, idf=idf_weights(frequency, encoding.rows))


def compared_rows(table: AuditTable, holdout: str) -> DataFrame:
    """Train and hold-out rows: the encoder is fit on both together."""
    return table.df.where(F.col(f"`{table.split}`").isin("train", holdout))


def distinct_rows(table: AuditTable, holdout: str, ref: str) -> DataFrame:
    """One row per distinct feature content with its copies on either side.

    Collapsing copies first means a row content that fills a third of the table is
    encoded and compared once.
    """
    rows = compared_rows(table, holdout)
    train, hold = F.col("_split") == "train", F.col("_split") == holdout
    right = table.key("label") == table.key("prediction") if table.prediction else F.lit(None).cast("boolean")
    keyed = rows.select(
        exact_key(rows, table.features).alias("key"), F.col(f"`{table.split}`").alias("_split"),
        F.col(f"`{ref}`").alias("_ref"), right.alias("_right"),
        F.struct(*[F.col(f"`{c}`") for c in table.features]).alias("_features"),
    )
    grouped = keyed.groupBy("key").agg(
        F.count_if(train).alias("train_rows"), F.count_if(hold).alias("held_rows"),
        F.count_if(hold & F.col("_right")).alias("held_right"),
        F.min(F.when(train, F.col("_ref"))).alias("train_ref"),
        F.min(F.when(hold, F.col("_ref"))).alias("held_ref"),
        F.first("_features").alias("_features"),
    )
    return grouped.select("key", "train_rows", "held_rows", "held_right", "train_ref", "held_ref", "_features.*")


KEEP = ["key", "train_rows", "held_rows", "held_right", "train_ref", "held_ref"]


def _text_scale() -> Column:
    """Norm of the text block within the row."""
    return 1 / F.sqrt(F.greatest("blocks", F.lit(1)))


@dataclass(frozen=True)
class EncodedTable:
    encoding: Encoding
    raw: DataFrame      # KEEP + dense, terms, counts, blocks; a written table

    @property
    def vectors(self) -> DataFrame:
        """KEEP + dense, terms, weights: unit vectors."""
        return self.encoding.weighted(self.raw)

    @property
    def counted(self) -> DataFrame:
        """KEEP + dense, terms, weights, scale, where weights are still term counts."""
        return self.raw.where("blocks > 0").withColumn("scale", _text_scale()) \
            .withColumnRenamed("counts", "weights").drop("blocks")


def encode(table: AuditTable, holdout: str, ref: str, encoding: Encoding | None = None) -> EncodedTable:
    """Fit, encode each distinct row once, write the result, and weigh its terms."""
    encoding = encoding or fit(compared_rows(table, holdout), table.features)
    raw = written(encoding.apply(distinct_rows(table, holdout, ref), KEEP), "encoded")
    if encoding.terms:
        copies = F.col("train_rows") + F.col("held_rows")
        encoding = with_idf(encoding, document_frequency(raw, len(encoding.terms), copies))
    return EncodedTable(encoding, raw)
