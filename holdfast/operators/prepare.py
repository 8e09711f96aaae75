"""Building audit datasets from model output: classes, splits, projections, regressions."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.operators.joins import JoinPlan, lookup


def eligible_rows(rows: DataFrame, classes: list[str], label: str, splits: DataFrame, key: str,
                  plan: JoinPlan | None = None) -> DataFrame:
    """Rows of the task's classes whose key is in the (key, split) map, with the split."""
    return lookup(rows.where(F.col(label).isin(classes)), splits, key, plan)


def stratified_split(rows: DataFrame, label: str, order: str, train_share: float = 0.6) -> DataFrame:
    """The first ``train_share`` of each class, by ``order``, is train.

    The place within a class comes from range-sorted parts and per-part class counts, so
    a class that holds most rows is never sorted in one task.
    """
    from holdfast.storage import written

    mark = F.monotonically_increasing_id()
    # sorted by class and order, every part holds a run of each of its classes
    sorted_rows = rows.repartitionByRange(F.col(label), F.col(order)).sortWithinPartitions(label, order) \
        .withColumn("_mark", mark)
    placed = written(sorted_rows, "stratified").withColumn("_part", F.shiftright("_mark", 33))
    runs = placed.groupBy(label, "_part").agg(F.count("*").alias("_n"), F.min("_mark").alias("_first"))
    ahead = Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))) \
        .withColumn("_size", F.sum("_n").over(Window.partitionBy(label)))
    # one row per class and part; null classes are a class
    joined = placed.alias("a").join(
        runs.alias("b"), F.col(f"a.{label}").eqNullSafe(F.col(f"b.{label}")) & (F.col("a._part") == F.col("b._part")))
    rank = F.col("_before") + (F.col("a._mark") - F.col("_first"))
    return joined.select(
        *[F.col(f"a.{c}") for c in rows.columns], rank.alias("class_rank"), F.col("_size").alias("class_size"),
        F.when(rank < F.col("_size") * train_share, "train").otherwise("test").alias("split"))


def widen(df: DataFrame, array: str, width: int, prefix: str = "f", decimals: int | None = None) -> DataFrame:
    """An array column as one double column per dimension: f00, f01, ..."""
    def cell(i: int) -> Column:
        v = F.col(array)[i].cast("double")
        return (v if decimals is None else F.bround(v, decimals)).alias(f"{prefix}{i:02d}")

    return df.select(*[c for c in df.columns if c != array], *[cell(i) for i in range(width)])


def pca_projection(df: DataFrame, array: str, k: int = fixed.PROJECTION_WIDTH,
                   decimals: int = fixed.PROJECTION_DECIMALS) -> tuple[DataFrame, float]:
    """Centred rows on their first k principal components, as f00..; and the share of
    variance those keep. Fitted on all rows by distributed aggregation."""
    vectors = df.withColumn("_v", array_to_vector(F.col(array).cast("array<double>")))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(vectors).transform(vectors)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    out = model.transform(centred).withColumn("_p", vector_to_array("_p")).drop("_v", "_c", array)
    return widen(out, "_p", k, decimals=decimals), float(model.explainedVariance.toArray().sum())


def metric_regression(accuracies: DataFrame, expected: DataFrame, key: str,
                      tolerance: float = fixed.REGRESSION_TOLERANCE) -> DataFrame:
    """Measured against published accuracy, and whether they agree."""
    return accuracies.join(expected, key).withColumn(
        "agrees", F.abs(F.col("accuracy") - F.col("expected")) < tolerance)
