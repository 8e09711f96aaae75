"""What the table holds: splits, row counts, classes, hold-out choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.table import AuditTable

KNOWN = tuple(fixed.SPLIT_SPELLINGS)


def one_row(*frames: DataFrame) -> DataFrame:
    """Several one-row results as one row. They are stacked and folded, never joined."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def several_splits():
    """Within a group: do its rows lie in more than one split? Compared by 64-bit hash,
    which keeps the aggregate in fixed-width buffers (a table has a handful of splits)."""
    mark = F.xxhash64("split")
    return F.min(mark) != F.max(mark)


def split_rank(c):
    rank = F.lit(len(KNOWN))
    for i, name in enumerate(KNOWN):
        rank = F.when(c == name, i).otherwise(rank)
    return rank


def split_counts(table: AuditTable, total: bool = False) -> DataFrame:
    """Rows per split; with ``total``, one more row whose split is null."""
    rows = table.keys("split")
    return (rows.rollup("split") if total else rows.groupBy("split")).agg(F.count("*").alias("n_rows"))


def split_order(table: AuditTable) -> DataFrame:
    """Splits present with their place: train, val, test, then others by name."""
    present = table.keys("split").distinct()
    rank = split_rank(F.col("split"))
    return present.select("split", rank.alias("split_rank")).orderBy("split_rank", "split")


def holdout_choice(table: AuditTable) -> DataFrame:
    """One row: the split whose score gets quoted."""
    s = F.col("split")
    other = ~s.isin(*KNOWN, fixed.UNLABELLED)
    return table.keys("split").agg(
        F.coalesce(
            F.max(F.when(s == "test", s)), F.max(F.when(s == "val", s)), F.min(F.when(other, s)),
        ).alias("holdout"),
        F.coalesce(F.bool_or(s == "train"), F.lit(False)).alias("has_train"),
    )


def unknown_splits(table: AuditTable) -> DataFrame:
    s = F.col("split")
    return table.keys("split").where(~s.isin(*KNOWN, fixed.UNLABELLED)).distinct().orderBy("split")


#: Splits that a summary names; a table with more of them has mistaken another column for the split.
SPLITS_NAMED = 1000


def dataset_summary(table: AuditTable) -> DataFrame:
    """One row: size, rows per split, classes (missing is no class here), and the roles.

    The largest splits are named (by name on ties); how many others there are, and their rows, are counts.
    """
    df = table.df.select(F.col(f"`{table.split}`").alias("split"), F.col(f"`{table.label}`").alias("label"))
    per_pair = df.groupBy("split", "label").agg(F.count("*").alias("n"))
    per_split = per_pair.groupBy("split").agg(F.sum("n").alias("n"))
    rows, known = per_split.agg(F.sum("n")).scalar(), per_split.agg(F.count("*")).scalar()
    largest = per_split.orderBy(F.desc("n"), "split").limit(SPLITS_NAMED) \
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("splits"),
             F.sum("n").alias("_rows"), F.count("*").alias("_named"))
    classes = per_pair.select("label").where(F.col("label").isNotNull()).distinct() \
        .agg(F.count("*").alias("n_classes"))
    return largest.select(
        rows.alias("n_rows"), "splits", (known - F.col("_named")).alias("other_splits"),
        (F.coalesce(rows, F.lit(0)) - F.coalesce("_rows", F.lit(0))).alias("other_rows"),
        classes.scalar().alias("n_classes"),
        F.lit(len(table.features)).cast("bigint").alias("n_features"),
        F.lit(table.prediction is not None).alias("has_predictions"),
        F.lit(table.group is not None).alias("has_groups"),
        *[F.lit(getattr(table, r)).cast("string").alias(f"{r}_column") for r in AuditTable.ROLES],
    )


def warnings_of(table: AuditTable) -> DataFrame:
    """The loader's warnings as rows, then one row for every split value nobody recognised."""
    spark = table.df.sparkSession
    said = spark.createDataFrame(list(table.warnings) or [], "code string, message string")
    odd = unknown_splits(table).select(
        F.lit("unknown_splits").alias("code"),
        F.concat(F.lit("Split value kept as a split of its own: "), "split", F.lit(".")).alias("message"))
    return said.unionByName(odd)
