"""Loading, splits and summary; run scores; manifest; dataset building."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.bindings import (
    DIMS, bound, cust_eval, doc_eval, emb_rows, event_eval, fifth, read, run_lines, spelled_eval,
)
from catalog.registry import query, rounded
from holdfast.operators import prepare, summary, variance
from holdfast.operators.background import hash_sample
from holdfast.fixed import CSV_MISSING
from holdfast.functions.columns import best_class
from holdfast.sources import load_csv, with_file_position, write_dataset
from holdfast.sources.manifest import manifest_params
from holdfast.storage import shared_folder


@query("dataset_summary", using="event", sql="""
SELECT count(*) AS n_rows, count(DISTINCT label) AS n_classes, CAST(1 AS BIGINT) AS n_features,
  true AS has_predictions, true AS has_groups,
  (SELECT string_agg(split || ':' || CAST(n AS VARCHAR), ',' ORDER BY split)
   FROM (SELECT split, count(*) AS n FROM event GROUP BY split)) AS splits,
  'id' AS id_column, 'split' AS split_column FROM event""")
def dataset_summary(spark, sf):
    pairs = F.transform(F.map_entries("splits"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return summary.dataset_summary(event_eval(spark, sf)).select(
        "n_rows", "n_classes", "n_features", "has_predictions", "has_groups",
        F.array_join(F.array_sort(pairs), ",").alias("splits"), "id_column", "split_column")


@query("split_counts", using="event", sql="""
SELECT split, count(*) AS n_rows FROM event GROUP BY ROLLUP (split)""")
def split_counts(spark, sf):
    return summary.split_counts(event_eval(spark, sf), total=True)


@query("split_normalise", using="spelled", sql="SELECT id, split FROM norm")
def split_normalise(spark, sf):
    return spelled_eval(spark, sf).df.select("id", "split")


@query("split_order", using="spelled", sql="""
SELECT DISTINCT split, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 ELSE 3 END AS split_rank
FROM norm""")
def split_order(spark, sf):
    return summary.split_order(spelled_eval(spark, sf))


@query("holdout_choice", using="event", sql="""
SELECT coalesce(max(CASE WHEN split = 'test' THEN split END), max(CASE WHEN split = 'val' THEN split END),
  min(CASE WHEN split NOT IN ('train','val','test','unlabelled') THEN split END)) AS holdout,
  bool_or(split = 'train') AS has_train FROM event""")
def holdout_choice(spark, sf):
    return summary.holdout_choice(event_eval(spark, sf))


@query("unknown_splits", using="spelled", sql="""
SELECT DISTINCT split FROM norm WHERE split NOT IN ('train','val','test','unlabelled')""")
def unknown_splits(spark, sf):
    return summary.unknown_splits(spelled_eval(spark, sf))


@query("loader_warnings", using="spelled", sql="""
SELECT 'unknown_splits' AS code, count(DISTINCT split) AS n FROM norm
WHERE split NOT IN ('train','val','test','unlabelled')
UNION ALL VALUES ('no_group', 1), ('no_prediction', 1)""")
def loader_warnings(spark, sf):
    return summary.warnings_of(spelled_eval(spark, sf)).groupBy("code").agg(F.count("*").alias("n"))


_TOKENS = ", ".join(f"'{t}'" for t in CSV_MISSING)


@query("csv_scan", sql=f"""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id, lang, CASE WHEN text NOT IN ({_TOKENS}) THEN length(text) END AS n_chars,
  CASE WHEN text NOT IN ({_TOKENS}) THEN md5(text) END AS text_md5 FROM documents""")
def csv_scan(spark, sf):
    """All documents written as CSV files and read back: quotes, line breaks, missing tokens, file order."""
    path = f"{shared_folder(spark)}/holdfast-csv-{uuid.uuid4().hex}"
    docs = read(spark, sf, "documents").select("doc_id", fifth("doc_id"), "lang", "text")
    write_dataset(docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id"), path)
    t = load_csv(spark, path, id="doc_id", label="lang")
    return t.df.select(F.col(t.position).alias("position"), "doc_id", "lang", F.length("text").cast("long").alias("n_chars"),
                       F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("row_positions", sql="""
SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 16 = 0 THEN 0 WHEN o_orderkey % 16 < 4 THEN 1 ELSE 2 END, o_orderkey) - 1 AS row_position
FROM orders""")
def row_positions(spark, sf):
    """Orders in three folders of very different sizes, numbered in the order of their files."""
    path = f"{shared_folder(spark)}/holdfast-orders-{uuid.uuid4().hex}"
    orders, rest = read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey") % 16
    for name, some in (("a", rest == 0), ("b", (rest > 0) & (rest < 4)), ("c", rest >= 4)):
        orders.where(some).repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(f"{path}/{name}")
    rows = with_file_position(spark.read.parquet(*[f"{path}/{name}" for name in "cab"]))
    return rows.select("o_orderkey", "row_position")


@query("dataset_summary_many", sql="""
WITH s AS (SELECT 'p' || CAST(l_partkey AS VARCHAR) AS split, count(*) AS n FROM lineitem GROUP BY 1),
t AS (SELECT split, n, row_number() OVER (ORDER BY n DESC, split) AS place FROM s)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (WHERE place > 1000) AS other_splits,
  CAST(coalesce(sum(n) FILTER (WHERE place > 1000), 0) AS BIGINT) AS other_rows,
  string_agg(split || ':' || CAST(n AS VARCHAR), ',' ORDER BY split) FILTER (WHERE place <= 1000) AS splits FROM t""")
def dataset_summary_many(spark, sf):
    """Thousands of split values: the largest by name, the others as a count."""
    t = bound(read(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("split"), F.col("l_returnflag").alias("label"), "l_quantity"))
    pairs = F.transform(F.map_entries("splits"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return summary.dataset_summary(t).select("n_rows", "other_splits", "other_rows", F.array_join(pairs, ",").alias("splits"))


@query("hash_sample", using="event", sql="""
SELECT id, label FROM event ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 100""")
def hash_sample_query(spark, sf):
    rows = event_eval(spark, sf).df
    return hash_sample(rows, "id", 100, rows.count()).select("id", "label")


# ------------------------------------------------------------------ run scores

@query("parse_scores", using="runs", sql="SELECT run_group, event_id, round(score, 6) AS score FROM runs")
def parse_scores(spark, sf):
    return rounded(variance.parse_scores(run_lines(spark, sf), "line", "run_group", "event_id"), "score")


def _scores(spark, sf):
    return variance.parse_scores(run_lines(spark, sf), "line", "run_group")


@query("run_stats", using="runs", sql="""
SELECT run_group, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd,
  round(min(score), 6) AS "min", round(max(score), 6) AS "max", round(max(score) - min(score), 6) AS "range",
  round(stddev_samp(score) / sqrt(count(*)), 6) AS sem FROM runs GROUP BY run_group""")
def run_stats(spark, sf):
    return rounded(variance.run_stats(_scores(spark, sf)), "mean", "sd", "min", "max", "range", "sem")


@query("noise_ratio", using="runs", sql="""
SELECT count(*) FILTER (WHERE run_group = 'seed') AS seed_n, count(*) FILTER (WHERE run_group = 'split') AS split_n,
  round(stddev_samp(score) FILTER (WHERE run_group = 'seed'), 6) AS seed_sd,
  round(stddev_samp(score) FILTER (WHERE run_group = 'split'), 6) AS split_sd,
  round(stddev_samp(score) FILTER (WHERE run_group = 'split')
    / stddev_samp(score) FILTER (WHERE run_group = 'seed'), 6) AS noise_ratio FROM runs""")
def noise_ratio(spark, sf):
    wide = variance.noise_ratio(_scores(spark, sf)).select("seed_n", "split_n", "seed_sd", "split_sd", "noise_ratio")
    return rounded(wide, "seed_sd", "split_sd", "noise_ratio")


@query("variance_verdict", using="runs", sql="""
WITH s AS (SELECT run_group, count(*) AS n, stddev_samp(score) AS sd, max(score) - min(score) AS r
  FROM runs GROUP BY run_group),
w AS (SELECT max(sd) FILTER (WHERE run_group = 'seed') AS seed_sd, max(sd) FILTER (WHERE run_group = 'split') AS split_sd,
  max(n) FILTER (WHERE run_group = 'split') AS n, max(r) FILTER (WHERE run_group = 'split') AS r FROM s)
SELECT n AS main_n, round(r * 100, 6) AS spread_pts, 'split' AS varied,
  CASE WHEN split_sd / seed_sd >= 3 THEN 'fail' WHEN n < 3 THEN 'warn' WHEN round(r * 100, 6) >= 5 THEN 'fail'
    WHEN round(r * 100, 6) >= 2 THEN 'warn' ELSE 'pass' END AS status FROM w""")
def variance_verdict(spark, sf):
    return variance.variance_verdict(_scores(spark, sf)).select("main_n", "spread_pts", "varied", "status")


# ------------------------------------------------------------------ manifest

@query("manifest_params", sql=r"""
SELECT s_name AS id, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE 'doc_type' END AS group_col,
  array_to_string(list_filter(list_transform(string_split('clip, ,' || s_name || ' , x', ','), lambda p: trim(p)),
    lambda p: p <> ''), '|') AS ignore_cols,
  round(CASE WHEN s_acctbal <= 100 THEN (CASE WHEN s_acctbal > 1 THEN s_acctbal / 100 ELSE s_acctbal END) END, 6) AS first_score,
  round(least(greatest(CASE WHEN s_nationkey = 0 THEN 0.95 ELSE s_nationkey / 20.0 END, 0.5), 1.0), 6) AS threshold
FROM supplier""")
def manifest_params_query(spark, sf):
    s = read(spark, sf, "supplier")
    entries = s.select(
        F.col("s_name").alias("id"),
        F.when(F.col("s_nationkey") % 3 == 0, "  ").otherwise(" doc_type ").alias("group_col"),
        F.concat(F.lit("clip, ,"), "s_name", F.lit(" , x")).alias("ignore_cols"),
        F.concat(F.lit("run: "), F.col("s_acctbal").cast("decimal(12,2)").cast("string")).alias("seed_scores"),
        F.lit("").alias("split_scores"), (F.col("s_nationkey") / 20.0).alias("threshold"))
    return rounded(manifest_params(entries).select(
        "id", "group_col", F.array_join("ignore_cols", "|").alias("ignore_cols"),
        F.get("seed_scores", F.lit(0)).alias("first_score"), "threshold"), "first_score", "threshold")


# ------------------------------------------------------------------ dataset building

@query("score_argmax", sql="""
SELECT vec_id AS id, 'c' || CAST(list_position(embedding, list_max(embedding)) - 1 AS VARCHAR) AS predicted
FROM embeddings""")
def score_argmax(spark, sf):
    classes = [f"c{i}" for i in range(64)]
    return emb_rows(spark, sf).select("id", best_class(F.col("embedding"), classes).alias("predicted"))


@query("eligible_rows", sql="""
SELECT doc_id AS id, lang AS label, CASE WHEN source < 'm' THEN 'train' ELSE 'test' END AS map_split
FROM documents WHERE lang IN ('en', 'fr', 'de') AND source IN (SELECT DISTINCT source FROM documents WHERE lang = 'es')""")
def eligible_rows(spark, sf):
    rows = doc_eval(spark, sf).df.select("id", "label", "group")
    # the key -> split map: one row per source that has a Spanish document
    chosen = rows.where("label = 'es'").select("group").distinct() \
        .withColumn("map_split", F.when(F.col("group") < "m", "train").otherwise("test"))
    return prepare.eligible_rows(rows, ["en", "fr", "de"], "label", chosen, "group").select("id", "label", "map_split")


@query("stratified_split", using="cust", sql="""
SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS class_rank,
  count(*) OVER (PARTITION BY label) AS class_size,
  CASE WHEN row_number() OVER (PARTITION BY label ORDER BY id) - 1 < count(*) OVER (PARTITION BY label) * 0.6
    THEN 'train' ELSE 'test' END AS split FROM cust""")
def stratified_split(spark, sf):
    rows = cust_eval(spark, sf).df.select("id", "label")
    return prepare.stratified_split(rows, "label", "id")


@query("metric_regression", using="doc", sql="""
WITH a AS (SELECT label, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FILTER (WHERE split = 'test') AS accuracy,
  avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FILTER (WHERE split = 'train') AS expected FROM doc GROUP BY label)
SELECT label, round(accuracy, 6) AS accuracy, round(expected, 6) AS expected,
  abs(accuracy - expected) < 0.02 AS agrees FROM a""")
def metric_regression(spark, sf):
    t = doc_eval(spark, sf)
    right = F.avg((F.col("label") == F.col("prediction")).cast("int"))
    keys = t.keys("label", "prediction", "split")
    seen = keys.where("split = 'test'").groupBy("label").agg(right.alias("accuracy"))
    told = keys.where("split = 'train'").groupBy("label").agg(right.alias("expected"))
    return rounded(prepare.metric_regression(seen, told, "label"), "accuracy", "expected")


@query("pca_projection")
def pca_projection(spark, sf):
    out, _ = prepare.pca_projection(emb_rows(spark, sf).select("id", "split", "label", "embedding"), "embedding", k=16)
    return out


_CENTRED = """c AS (SELECT id, unnest(v) AS x, unnest(range(1, 65)) AS j FROM emb),
z AS (SELECT id, x - avg(x) OVER (PARTITION BY j) AS z FROM c)"""


@query("pca_row_norms", using="emb", sql=f"""
WITH {_CENTRED} SELECT id, round(sum(z * z), 6) AS norm FROM z GROUP BY id""")
def pca_row_norms(spark, sf):
    """On all 64 components every row is as long as it was: the projection is a rotation of the centred rows."""
    out, _ = prepare.pca_projection(emb_rows(spark, sf).select("id", "embedding"), "embedding", k=DIMS, decimals=None)
    squares = [F.col(f"f{j:02d}") * F.col(f"f{j:02d}") for j in range(DIMS)]
    return rounded(out.select("id", sum(squares[1:], squares[0]).alias("norm")), "norm")


@query("pca_total_variance", using="emb", sql=f"""
WITH {_CENTRED} SELECT 64 AS components, round(sum(z * z) / (SELECT count(*) FROM emb), 6) AS variance, 1.0::DOUBLE AS kept FROM z""")
def pca_total_variance(spark, sf):
    """All components together have the variance of the rows, and keep all of it."""
    out, kept = prepare.pca_projection(emb_rows(spark, sf).select("id", "embedding"), "embedding", k=DIMS, decimals=None)
    spread = [F.var_pop(f"f{j:02d}") for j in range(DIMS)]
    return rounded(out.agg(sum(spread[1:], spread[0]).alias("variance")), "variance").select(
        F.lit(DIMS).alias("components"), "variance", F.lit(round(kept, 6)).alias("kept"))


@query("pca_variance_kept")
def pca_variance_kept(spark, sf):
    _, kept = prepare.pca_projection(emb_rows(spark, sf).select("id", "embedding"), "embedding", k=16)
    return spark.createDataFrame([(16, round(kept, 6))], "components int, variance_kept double")
