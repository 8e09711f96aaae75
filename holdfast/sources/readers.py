"""Scans that end in an AuditTable."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import fixed
from holdfast.sources.csvfile import POSITION, scan
from holdfast.storage import written
from holdfast.table import AuditTable, DatasetError, audit_table


def _typed(raw: DataFrame) -> DataFrame:
    """Give all-text CSV columns a type: whole number, number, boolean, else text.

    One aggregate over all columns decides; the rewrite of missing-value tokens
    comes first, so ``n/a`` in a number column does not turn it into text.
    """
    tokens = fixed.CSV_MISSING
    clean = raw.select(*[
        F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c) for c in raw.columns if c != POSITION
    ], POSITION)
    columns = clean.columns[:-1]
    probes = []
    for i, c in enumerate(columns):
        text, bare = F.col(f"`{c}`"), F.trim(F.col(f"`{c}`"))
        probes += [
            F.count(text).alias(f"n{i}"),
            F.count_if(bare.try_cast("bigint").isNotNull()
                       & bare.rlike(r"^[+-]?\d+$")).alias(f"i{i}"),
            F.count_if(bare.try_cast("double").isNotNull()
                       & ~bare.rlike("[dDfF]$")).alias(f"d{i}"),
            F.count_if(text.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias(f"b{i}"),
        ]
    seen = clean.agg(*probes).first()
    typed = []
    for i, c in enumerate(columns):
        n = seen[f"n{i}"]
        kind = next(
            (k for k, p in (("bigint", "i"), ("double", "d"), ("boolean", "b"))
             if n and seen[f"{p}{i}"] == n),
            "string" if n else "double",
        )
        text = F.col(f"`{c}`")
        typed.append((text if kind == "string" else F.trim(text).cast(kind)).alias(c))
    return clean.select(*typed, POSITION)


def _as(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as the columns of a schema, in order; missing-value tokens and what does not read as the type are null."""
    names = [c for c in raw.columns if c != POSITION]
    if len(names) != len(schema):
        raise DatasetError(f"the schema has {len(schema)} columns, the header {len(names)}")
    fields = []
    for name, field in zip(names, schema):
        text = F.when(~F.col(f"`{name}`").isin(fixed.CSV_MISSING), F.col(f"`{name}`"))
        fields.append((text if isinstance(field.dataType, T.StringType) else F.trim(text).try_cast(field.dataType)).alias(field.name))
    return raw.select(*fields, POSITION)


def load_csv(spark: SparkSession, path: str, *, max_rows: int | None = None,
             schema: T.StructType | None = None, **roles) -> AuditTable:
    """A CSV file or folder. Give ``schema`` on large inputs: it saves the typing pass and nothing else.

    Quoted fields may hold line breaks, and a large file is read by many tasks all the same (see csvfile).
    """
    try:
        raw = scan(spark, path)
    except AnalysisException as problem:
        raise DatasetError(f"cannot read {path} as CSV: {problem}") from problem
    return _capped(_as(raw, schema) if schema else _typed(raw), max_rows, {"position": POSITION, **roles})


def load_parquet(spark: SparkSession, path: str, *, max_rows: int | None = None, **roles) -> AuditTable:
    try:
        df = spark.read.parquet(path)
    except AnalysisException as problem:
        raise DatasetError(f"cannot read {path} as Parquet: {problem}") from problem
    return _capped(df, max_rows, roles)


def load_table(spark: SparkSession, name: str, *, max_rows: int | None = None, **roles) -> AuditTable:
    return _capped(spark.table(name), max_rows, roles)


def _capped(df: DataFrame, max_rows: int | None, roles: dict) -> AuditTable:
    """The row cap is off unless asked for; when it bites, a warning says so."""
    if max_rows is None:
        return audit_table(df, **roles)
    over = df.limit(max_rows + 1).count() > max_rows
    position = roles.get("position")
    first = df.where(F.col(position) < max_rows) if position else df.limit(max_rows)
    table = audit_table(first if over else df, **roles)
    if not over:
        return table
    note = ("row_cap", f"Only the first {max_rows:,} rows were read.")
    return replace(table, warnings=(note, *table.warnings))


def with_row_position(df: DataFrame, name: str = "row_position") -> DataFrame:
    """Consecutive positions from 0 in scan order, without a global sort or one big task.

    Every row gets its place within its partition; the partition sizes, one number
    per partition, are then summed up and added as offsets.
    """
    mark = F.monotonically_increasing_id()
    placed = written(df.withColumn("_mark", mark), "positions")
    part, place = F.shiftright("_mark", 33), F.col("_mark").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per input partition
        .withColumn(name, F.col("_offset") + place)
        .drop("_part", "_mark", "_offset")
    )


def with_file_position(df: DataFrame, name: str = "row_position") -> DataFrame:
    """Consecutive positions from 0 in the order of the files' paths and of the rows in each file.

    Spark deals byte ranges of files to tasks as their sizes fit, so scan order is not file order. Rows of one
    byte range stay together: their count, one number per range, is summed up in the order of path and range. Tables that
    are not plain scans of files have no such order and get that of the scan.
    """
    try:
        marked = df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.file_block_start"),
                                 "_mark": F.monotonically_increasing_id()})
    except AnalysisException:
        return with_row_position(df, name)
    placed = written(marked, "positions")
    ranges = placed.groupBy("_file", "_at").agg(
        F.count("*").alias("_n"), F.min("_mark").alias("_first"), F.max("_mark").alias("_last"))
    if not ranges.where("_last - _first + 1 <> _n").isEmpty():  # rows were dealt anew after the scan
        return with_row_position(df, name)
    before = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), ["_file", "_at"]) \
        .withColumn(name, F.col("_offset") + F.col("_mark") - F.col("_first")) \
        .drop("_file", "_at", "_mark", "_first", "_offset")  # one row per byte range
