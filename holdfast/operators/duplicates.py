"""Exact duplicates across splits, by one digest per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import fixed
from holdfast.operators.summary import several_splits
from holdfast.storage import written
from holdfast.table import AuditTable

_FLOATS = (T.DoubleType, T.FloatType)


def _digest(parts: list[str]) -> Column:
    """256-bit key of a list of texts: JSON keeps nulls and separators apart."""
    return F.expr(f"sha2(to_json(array({', '.join(parts)})), 256)")


def is_vector(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)


_SPACE = "'" + "".join(f"\\u{ord(c):04x}" for c in fixed.WHITE_SPACE) + "'"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fingerprint(df: DataFrame, features, decimals: int = fixed.FINGERPRINT_DECIMALS) -> Column:
    """Key of a row's feature values: floats rounded half-even (and -0 as 0), the rest
    without white space at their ends, missing (NaN too) equal to missing. Grouping by it moves 64 characters per row
    instead of the features."""
    def part(name: str) -> str:
        if isinstance(df.schema[name].dataType, _FLOATS):
            return f"CAST(bround(nullif(CAST({_quoted(name)} AS DOUBLE), double('NaN')), {decimals}) + 0D AS STRING)"
        if is_vector(df.schema[name].dataType):
            each = f"bround(nullif(CAST(x AS DOUBLE), double('NaN')), {decimals}) + 0D"
            return f"CAST(transform({_quoted(name)}, x -> {each}) AS STRING)"
        return f"trim(BOTH {_SPACE} FROM CAST({_quoted(name)} AS STRING))"

    return _digest([part(c) for c in features])


def exact_key(df: DataFrame, features) -> Column:
    """Key of the unrounded feature values: equal keys encode to equal vectors."""
    def part(name: str) -> str:
        text = f"CAST({_quoted(name)} AS STRING)"
        if is_vector(df.schema[name].dataType):
            return f"CAST(transform({_quoted(name)}, x -> nullif(CAST(x AS DOUBLE), double('NaN'))) AS STRING)"
        return f"nullif({text}, 'NaN')" if isinstance(df.schema[name].dataType, _FLOATS) else text

    return _digest([part(c) for c in features])


def row_keys(table: AuditTable, holdout: str | None, ref: str) -> DataFrame:
    """Train and hold-out rows on four narrow columns: ref, key (of the content), split, label.

    Written once. Joins meet on its plain key: the expression over all features, used as a join key, would be
    copied into the filters that Catalyst infers, once for every join.
    """
    split = F.col(f"`{table.split}`")
    rows = table.df.where(split.isin("train", holdout))
    return written(rows.select(
        F.col(f"`{ref}`").alias("ref"), exact_key(rows, table.features).alias("key"),
        split.alias("split"), table.key("label").alias("label")), "row-keys")


def fingerprint_groups(table: AuditTable, holdout: str | None) -> DataFrame:
    """Per distinct row content: hold-out rows, train rows, whether it lies in several splits."""
    s = F.col("split")
    keyed = table.df.select(
        fingerprint(table.df, table.features).alias("fingerprint"),
        F.col(f"`{table.split}`").alias("split"),
    )
    return keyed.groupBy("fingerprint").agg(
        F.count("*").alias("n_rows"),
        F.count_if(s == F.lit(holdout)).alias("held_out_rows"),
        F.count_if(s == "train").alias("train_rows"),
        several_splits().alias("crosses"),
    )


def exact_duplicates(table: AuditTable, holdout: str | None) -> DataFrame:
    """One row: hold-out rows with a twin in any other split, and with one in train."""
    held = F.col("held_out_rows")
    return fingerprint_groups(table, holdout).agg(
        F.coalesce(F.sum(F.when(F.col("crosses"), held)), F.lit(0)).alias("exact_any_split"),
        F.coalesce(F.sum(F.when(F.col("train_rows") > 0, held)), F.lit(0)).alias("exact_in_train"),
    )
