"""Manifest of datasets: which file, which roles, which pasted run scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions.columns import scores_in_text

MANIFEST_SCHEMA = (
    "id string, file string, name string, blurb string, expect string, group_col string, "
    "ignore_cols string, seed_scores string, split_scores string"
)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array (or JSON lines) of dataset descriptions."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)


def manifest_entry(entries: DataFrame, dataset_id: str):
    """The described dataset, or None."""
    return entries.where(F.col("id") == dataset_id).first()


def threshold_column(value: Column) -> Column:
    wanted = F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(fixed.DEFAULT_SIMILARITY))
    return F.least(F.greatest(wanted, F.lit(fixed.LOWEST_SIMILARITY)), F.lit(fixed.HIGHEST_SIMILARITY))


def comma_list(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def manifest_params(entries: DataFrame, threshold: str = "threshold") -> DataFrame:
    """Audit parameters per entry: parsed scores, ignore list and clamped threshold."""
    wanted = F.col(threshold).cast("double") if threshold in entries.columns else F.lit(None).cast("double")
    return entries.select(
        "id",
        F.nullif(F.trim(F.coalesce("group_col", F.lit(""))), F.lit("")).alias("group_col"),
        comma_list(F.col("ignore_cols")).alias("ignore_cols"),
        scores_in_text(F.coalesce("seed_scores", F.lit(""))).alias("seed_scores"),
        scores_in_text(F.coalesce("split_scores", F.lit(""))).alias("split_scores"),
        threshold_column(wanted).alias("threshold"),
    )
