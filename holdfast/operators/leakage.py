"""Are hold-out rows, or near copies of them, already in train?"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions.columns import status_of
from holdfast.operators.background import (
    background_pairs, background_similarity, calibrated_threshold,
)
from holdfast.operators.duplicates import exact_duplicates, row_keys
from holdfast.operators.encode import EncodedTable, Encoding, compared_rows, encode, fit
from holdfast.operators.joins import JoinPlan, lookup
from holdfast.operators.nearest import BlockPlan, nearest_neighbours
from holdfast.operators.nearest import closest_pair as closest_contents
from holdfast.operators.summary import holdout_choice, one_row
from holdfast.sources.csvfile import POSITION
from holdfast.sources.readers import with_file_position
from holdfast.storage import written
from holdfast.table import AuditTable

def with_ref(table: AuditTable) -> tuple[AuditTable, str]:
    """The column that names a row: its id, or its position when there is no id."""
    if table.id or table.position:
        return table, table.id or table.position
    return table.with_df(with_file_position(table.df, POSITION)), POSITION


def display_id(table: AuditTable, value):
    """The id as text, or ``row N``."""
    return value.cast("string") if table.id else F.concat(F.lit("row "), value.cast("string"))


def nearest_train(coded: EncodedTable, floor: float | None, plan: BlockPlan | None = None) -> DataFrame:
    """Per distinct hold-out content its most similar train content (see nearest_neighbours),
    with the copies it stands for."""
    held, train, idf = _sides(coded)
    return _about(coded, nearest_neighbours(held, train, floor, plan, idf))


def _sides(coded: EncodedTable) -> tuple[DataFrame, DataFrame, np.ndarray | None]:
    """Hold-out and train contents as the searches take them, and the idf (None: unit vectors already)."""
    rows = coded.counted
    parts = ["key", "dense", "terms", "weights", "scale"]
    return (rows.where("held_rows > 0").select(*parts),
            rows.where("train_rows > 0").select(*parts, F.col("train_ref").alias("ref")),
            coded.encoding.idf if coded.encoding.terms else None)


def _about(coded: EncodedTable, best: DataFrame) -> DataFrame:
    about = coded.counted.where("held_rows > 0").select(F.col("key").alias("query_key"), "held_rows", "held_right", "held_ref")
    return best.join(about, "query_key").select(
        "query_key", "held_ref", "held_rows", "held_right",
        F.col("ref").alias("train_ref"), "similarity")


def closest_pair(coded: EncodedTable, plan: BlockPlan | None = None) -> DataFrame:
    """One row, the most similar hold-out and train contents (smallest refs on ties), or none: held_ref, train_ref, similarity."""
    held, train, idf = _sides(coded)
    return _about(coded, closest_contents(held, train, plan, idf)) \
        .orderBy(F.desc("similarity"), "held_ref", "train_ref").limit(1).select("held_ref", "train_ref", "similarity")


def highest_similarity(coded: EncodedTable, plan: BlockPlan | None = None) -> float | None:
    """Similarity of the closest pair; null only when a side has no rows. Rows that encode to nothing have 0 with all."""
    seen = coded.raw.agg(*[
        F.count_if((F.col(side) > 0) & (F.col("blocks") > 0 if sound else F.col("blocks") == 0)).alias(f"{side}_{sound}")
        for side in ("held_rows", "train_rows") for sound in (True, False)]).first()
    rows = {side: seen[f"{side}_True"] + seen[f"{side}_False"] for side in ("held_rows", "train_rows")}
    if not all(rows.values()):
        return None
    best = closest_pair(coded, plan).first()
    empty = seen["held_rows_False"] or seen["train_rows_False"]
    return max([s for s in (best and best["similarity"], 0.0 if empty else None) if s is not None])


def nearest_per_row(keys: DataFrame, holdout: str, twins: DataFrame, plan: JoinPlan | None = None) -> DataFrame:
    """The result spread over every hold-out row of ``keys``: holdout_id, train_id, similarity."""
    rows = keys.where(F.col("split") == holdout).select(F.col("ref").alias("holdout_id"), F.col("key").alias("query_key"))
    found = twins.select("query_key", F.col("train_ref").alias("train_id"), "similarity")
    return lookup(rows, found, "query_key", plan).select("holdout_id", "train_id", "similarity")


def near_duplicate_pairs(table: AuditTable, holdout: str, keys: DataFrame, twins: DataFrame,
                         threshold: float, limit: int = fixed.PAIRS_SHOWN) -> DataFrame:
    """The most similar hold-out rows and their train twins, with both labels.

    The shown rows lie within the first ``limit`` flagged contents (by similarity, then
    smallest id), so only that many keys meet the rows.
    """
    top = twins.where(F.col("similarity") >= threshold) \
        .orderBy(F.desc("similarity"), "held_ref", "train_ref").limit(limit) \
        .select("query_key", "train_ref", "similarity")
    rows = keys.where(F.col("split") == holdout).select(
        F.col("ref").alias("_held"), F.col("key").alias("query_key"), F.col("label").alias("holdout_label"),
    ).join(F.broadcast(top), "query_key") \
        .orderBy(F.desc("similarity"), "_held", "train_ref", "holdout_label").limit(limit)
    train = keys.where("split = 'train'").select(F.col("ref").alias("train_ref"), F.col("label").alias("train_label"))
    wanted = rows.select("train_ref").distinct()
    labels = train.join(F.broadcast(wanted), "train_ref") \
        .groupBy("train_ref").agg(F.min("train_label").alias("train_label"))
    return rows.join(F.broadcast(labels), "train_ref").select(
        F.bround("similarity", 4).alias("similarity"),
        display_id(table, F.col("_held")).alias("holdout_id"),
        display_id(table, F.col("train_ref")).alias("train_id"),
        "holdout_label", "train_label",
        F.col("_held"), F.col("similarity").alias("_exact"),
    ).orderBy(F.desc("_exact"), "_held").drop("_held", "_exact")


def leak_measures(table: AuditTable, holdout: str, twins: DataFrame, threshold: float) -> DataFrame:
    """One row: hold-out rows, flagged rows and share, accuracy with and without them."""
    c = F.col
    flagged = twins.where(c("similarity") >= threshold).agg(
        F.coalesce(F.sum("held_rows"), F.lit(0)).alias("flagged"),
        F.coalesce(F.sum("held_right"), F.lit(0)).alias("flagged_right"),
        F.max("similarity").alias("max_similarity"),
    )
    hold = table.rows_of(holdout)
    right = F.count_if(table.key("label") == table.key("prediction")) if table.prediction \
        else F.lit(None).cast("bigint")
    every = hold.agg(F.count("*").alias("holdout_rows"), right.alias("right"))
    clean = c("holdout_rows") - c("flagged")
    out = one_row(flagged, every).select(
        "holdout_rows", "flagged", F.try_divide("flagged", "holdout_rows").alias("flagged_share"),
        "max_similarity", F.lit(float(threshold)).alias("threshold"),
        F.try_divide("right", "holdout_rows").alias("accuracy_all"),
        F.try_divide(c("right") - c("flagged_right"), clean).alias("accuracy_clean"),
    )
    return out.withColumn("drop_pts", (c("accuracy_all") - c("accuracy_clean")) * 100)


@dataclass(frozen=True)
class LeakageResult:
    measures: DataFrame          # one row, with status and reason
    pairs: DataFrame | None      # most similar pairs, when the search ran


_MEASURES = {
    "reason": "string", "width": "bigint", "encoding": "string", "holdout_rows": "bigint",
    "exact_any_split": "bigint", "exact_in_train": "bigint", "background": "double",
    "requested": "double", "threshold": "double", "flagged": "bigint", "flagged_share": "double",
    "max_similarity": "double", "accuracy_all": "double", "accuracy_clean": "double",
    "drop_pts": "double",
}


def _measures(df: DataFrame, **known) -> DataFrame:
    """The fixed one-row shape: columns of ``df``, then known values, else null."""
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(known.get(c))).cast(kind).alias(c)
        for c, kind in _MEASURES.items()
    ])


def leakage_verdict(table: AuditTable, holdout: str | None = None, *,
                    threshold: float = fixed.DEFAULT_SIMILARITY,
                    plan: BlockPlan | None = None, encoding: Encoding | None = None) -> LeakageResult:
    """The whole check: preconditions, exact copies, encoding, calibration, search, verdict."""
    spark = table.df.sparkSession
    nothing = spark.range(1)

    def skip(reason: str, **known) -> LeakageResult:
        row = _measures(nothing, reason=reason, requested=threshold, **known)
        return LeakageResult(row.withColumn("status", F.lit(fixed.SKIP)), None)

    if not table.features:
        return skip("no_features")
    choice = holdout_choice(table).first()
    holdout = holdout or choice["holdout"]
    if holdout is None or not choice["has_train"]:
        return skip("no_sides")

    encoding = encoding or fit(compared_rows(table, holdout), table.features)
    if encoding.width == 0:
        return skip("not_encodable")
    known = {"width": encoding.width, "encoding": encoding.description, "requested": threshold}
    twins_exact = exact_duplicates(table, holdout)
    if encoding.width < fixed.MIN_SIMILARITY_WIDTH:
        rows = table.rows_of(holdout).agg(F.count("*").alias("holdout_rows"))
        low = _measures(one_row(twins_exact, rows), reason="too_narrow", **known)
        status = status_of((F.col("exact_any_split") > 0, fixed.FAIL), otherwise=fixed.SKIP)
        return LeakageResult(low.withColumn("status", status), None)

    table, ref = with_ref(table)
    keys = row_keys(table, holdout, ref)
    coded = encode(table, holdout, ref, encoding)
    background = background_similarity(background_pairs(keys, coded)).first()["background"]
    effective = calibrated_threshold(threshold, background)
    # Nothing below the threshold is asked for, so it is the floor of the search.
    twins = written(nearest_train(coded, effective, plan), "twins")
    found = leak_measures(table, holdout, twins, effective)
    if twins.isEmpty():  # nothing reaches the threshold: how near did the nearest come?
        found = found.withColumn("max_similarity", F.lit(highest_similarity(coded, plan)).cast("double"))
    measured = _measures(one_row(found, twins_exact), reason="searched", background=background, **known)
    none_flagged = (F.col("flagged") == 0) & (F.col("exact_any_split") == 0)
    status = status_of(
        (none_flagged, fixed.PASS),
        ((F.col("flagged_share") >= fixed.LEAK_FAIL_SHARE) | (F.col("exact_any_split") > 0), fixed.FAIL),
        otherwise=fixed.WARN)
    return LeakageResult(
        measured.withColumn("status", status),
        near_duplicate_pairs(table, holdout, keys, twins, effective))
