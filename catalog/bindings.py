"""Audit datasets over the test tables. The tables have no split or prediction, so
each binding derives them from integers or timestamps, for every row of its table.
``SQL`` holds the same datasets as common table expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.prepare import widen
from holdfast.table import AuditTable, audit_table

DIMS = 64


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fifth(c: str) -> Column:
    return F.when(F.col(c) % 5 == 0, "test").otherwise("train").alias("split")


def bound(df: DataFrame, **ignore) -> AuditTable:
    roles = {r: r for r in ("id", "split", "label", "prediction", "group") if r in df.columns}
    return audit_table(df, detect=False, check_empty=False, **roles, **ignore)


def emb_rows(spark, sf) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), fifth("vec_id"), "label", shifted.cast("int").alias("prediction"), "embedding")


def emb_eval(spark, sf) -> AuditTable:
    return bound(widen(emb_rows(spark, sf), "embedding", DIMS))


def emb_vector(spark, sf) -> AuditTable:
    """emb_eval with the embedding as one column."""
    return bound(emb_rows(spark, sf))


def emb_leaky(spark, sf) -> AuditTable:
    """emb_eval, and train rows once more in test with every dimension slightly stretched."""
    rows = emb_rows(spark, sf)
    stretched = F.transform("embedding", lambda x, j: x.cast("double") * (1 + 0.01 * ((j + F.col("id")) % 3)))
    copies = rows.where((F.col("split") == "train") & (F.col("id") % 50 == 1)).withColumn("embedding", stretched) \
        .withColumn("id", F.col("id") + 1_000_000).withColumn("split", F.lit("test"))
    plain = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return bound(widen(plain.unionByName(copies), "embedding", DIMS))


def emb_wide(spark, sf) -> AuditTable:
    """emb_leaky with the products of each dimension and the next, the one after it and so on: 256 columns."""
    t = emb_leaky(spark, sf)
    products = [(F.col(f"f{j:02d}") * F.col(f"f{(j + k) % DIMS:02d}")).alias(f"p{k}_{j:02d}")
                for k in (1, 2, 3) for j in range(DIMS)]
    return bound(t.df.select("*", *products))


def doc_eval(spark, sf) -> AuditTable:
    return bound(read(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), fifth("doc_id"), F.col("lang").alias("label"),
        F.when(F.col("doc_id") % 11 == 0, "en").otherwise(F.col("lang")).alias("prediction"),
        F.col("source").alias("group"), "text"))


def quality_eval(spark, sf) -> AuditTable:
    return bound(read(spark, sf, "labels").join(read(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"), fifth("doc_id"), F.col("quality").alias("label"),
        (1 - F.col("toxic")).alias("prediction"), F.col("source").alias("group"), "text"))


def line_eval(spark, sf) -> AuditTable:
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return bound(read(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(key % 5 == 0, "test").otherwise("train").alias("split"),
        F.col("l_returnflag").alias("label"),
        F.when(F.col("l_partkey") % 3 == 0, "N").otherwise(F.col("l_returnflag")).alias("prediction"),
        F.col("l_orderkey").alias("group"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"))


def order_eval(spark, sf) -> AuditTable:
    return bound(read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), fifth("o_custkey"), F.col("o_orderstatus").alias("label"),
        F.when(F.col("o_orderkey") % 9 == 0, "F").otherwise(F.col("o_orderstatus")).alias("prediction"),
        F.col("o_custkey").alias("group"), "o_totalprice", "o_orderpriority"))


def event_eval(spark, sf) -> AuditTable:
    ts = F.col("ts")
    split = F.when(F.col("event_id") % 97 == 0, F.lit(None)) \
        .when(ts < F.lit("2024-01-22").cast("timestamp_ntz"), "train") \
        .when(ts < F.lit("2024-01-26").cast("timestamp_ntz"), "val").otherwise("test")
    return bound(read(spark, sf, "events").select(
        F.col("event_id").alias("id"), split.alias("split"), F.col("event_type").alias("label"),
        F.lit("view").alias("prediction"), F.col("user_id").alias("group"), "value"))


# --- raw split spellings given to the rows of spelled_eval, by event_id % 10 ---
SPELLINGS = ["Training", " TEST ", "valid", "HoldOut", "0", "fold_b", None, "2", "dev", "Fold_A"]


def spelled_eval(spark, sf) -> AuditTable:
    raw = reduce(
        lambda tail, s: F.when(F.col("event_id") % 10 == s[0], F.lit(s[1])).otherwise(tail),
        enumerate(SPELLINGS), F.lit(None).cast("string"))
    return bound(read(spark, sf, "events").select(
        F.col("event_id").alias("id"), raw.alias("split"), F.col("event_type").alias("label"), "value"))


def cust_eval(spark, sf) -> AuditTable:
    """Three nations are held out only, three are trained on only."""
    n = F.col("c_nationkey")
    split = F.when(n < 3, "test").when(n > 21, "train") \
        .when(F.col("c_custkey") % 5 == 0, "test").otherwise("train")
    return bound(
        read(spark, sf, "customer").join(F.broadcast(read(spark, sf, "nation")), F.col("n_nationkey") == n).select(
            F.col("c_custkey").alias("id"), split.alias("split"), F.col("n_name").alias("label"),
            F.col("c_mktsegment").alias("group"), "c_acctbal", "c_name"))


def part_eval(spark, sf) -> AuditTable:
    """Numbers with gaps, two categories (one with gaps) and text."""
    return bound(read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), fifth("p_partkey"), F.col("p_brand").alias("label"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("size"),
        F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice")).alias("price"),
        F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")).alias("size_text"),
        F.when(F.col("p_partkey") % 17 != 0, F.col("p_brand")).alias("brand"), F.col("p_type").alias("type"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name")))


def run_lines(spark, sf) -> DataFrame:
    """Log lines of runs: views and clicks vary the seed, all else the split."""
    return read(spark, sf, "events").select(
        F.when(F.col("event_type").isin("view", "click"), "seed").otherwise("split").alias("run_group"),
        "event_id",
        F.concat(F.lit("seed "), (F.col("user_id") + 1000).cast("string"), F.lit(": acc "),
                 F.col("value").cast("decimal(12,2)").cast("string")).alias("line"))


_spelled = " ".join(
    f"WHEN event_id % 10 = {i} THEN " + ("NULL" if s is None else f"'{s}'") for i, s in enumerate(SPELLINGS))

SQL = {
    "emb": """emb AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    CAST(label AS VARCHAR) AS label,
    CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS VARCHAR) AS prediction,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)""",
    "emb_leaky": """emb_plain AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    CAST(label AS VARCHAR) AS label,
    CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS VARCHAR) AS prediction,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
emb AS MATERIALIZED (
  SELECT * FROM emb_plain UNION ALL
  SELECT id + 1000000, 'test', label, prediction,
    list_transform(v, lambda x, j: x * (1 + 0.01 * ((j - 1 + id) % 3)))
  FROM emb_plain WHERE split = 'train' AND id % 50 = 1)""",
    "emb_wide": """emb_plain AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    CAST(label AS VARCHAR) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
emb_narrow AS (
  SELECT * FROM emb_plain UNION ALL
  SELECT id + 1000000, 'test', label, list_transform(v, lambda x, j: x * (1 + 0.01 * ((j - 1 + id) % 3)))
  FROM emb_plain WHERE split = 'train' AND id % 50 = 1),
emb AS MATERIALIZED (SELECT id, split, label, list_concat(v, list_concat(
    list_transform(v, lambda x, j: x * v[j % 64 + 1]), list_concat(list_transform(v, lambda x, j: x * v[(j + 1) % 64 + 1]),
    list_transform(v, lambda x, j: x * v[(j + 2) % 64 + 1])))) AS v FROM emb_narrow)""",
    "doc": """doc AS MATERIALIZED (
  SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, lang AS label,
    CASE WHEN doc_id % 11 = 0 THEN 'en' ELSE lang END AS prediction, source AS grp, text FROM documents)""",
    "quality": """quality_rows AS (
  SELECT l.doc_id AS id, CASE WHEN l.doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    CAST(l.quality AS VARCHAR) AS label, CAST(1 - l.toxic AS VARCHAR) AS prediction, d.source AS grp
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
    "line": """line AS (
  SELECT l_orderkey * 10 + l_linenumber AS id,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    l_returnflag AS label, CASE WHEN l_partkey % 3 = 0 THEN 'N' ELSE l_returnflag END AS prediction,
    CAST(l_orderkey AS VARCHAR) AS grp, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus
  FROM lineitem)""",
    "ordr": """ordr AS (
  SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    o_orderstatus AS label, CASE WHEN o_orderkey % 9 = 0 THEN 'F' ELSE o_orderstatus END AS prediction,
    CAST(o_custkey AS VARCHAR) AS grp, o_totalprice, o_orderpriority FROM orders)""",
    "event": """event AS (
  SELECT event_id AS id, CASE WHEN event_id % 97 = 0 THEN 'unlabelled'
      WHEN ts < TIMESTAMP '2024-01-22' THEN 'train' WHEN ts < TIMESTAMP '2024-01-26' THEN 'val'
      ELSE 'test' END AS split,
    event_type AS label, 'view' AS prediction, CAST(user_id AS VARCHAR) AS grp, value FROM events)""",
    "spelled": f"""spelled AS (
  SELECT event_id AS id, CASE {_spelled} END AS raw FROM events),
norm AS (SELECT id, CASE WHEN raw IS NULL THEN 'unlabelled'
    WHEN lower(trim(raw)) IN ('train','training','tr','fit','0') THEN 'train'
    WHEN lower(trim(raw)) IN ('val','valid','validation','dev','1') THEN 'val'
    WHEN lower(trim(raw)) IN ('test','testing','te','eval','evaluation','holdout','hold-out','2') THEN 'test'
    ELSE lower(trim(raw)) END AS split FROM spelled)""",
    "cust": """cust AS (
  SELECT c_custkey AS id, CASE WHEN c_nationkey < 3 THEN 'test' WHEN c_nationkey > 21 THEN 'train'
      WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    n_name AS label, c_mktsegment AS grp, c_acctbal, c_name
  FROM customer JOIN nation ON n_nationkey = c_nationkey)""",
    "part": """part_rows AS MATERIALIZED (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    CAST(CASE WHEN p_size % 10 <> 0 THEN p_size END AS DOUBLE) AS size,
    CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice END AS price,
    CAST(p_size AS DOUBLE) AS size_text,
    CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS brand, p_type AS type,
    p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name FROM part)""",
    "runs": r"""hits AS (
  SELECT CASE WHEN event_type IN ('view','click') THEN 'seed' ELSE 'split' END AS run_group, event_id,
    CAST(unnest(regexp_extract_all('seed ' || CAST(user_id + 1000 AS VARCHAR) || ': acc '
      || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR), '-?\d+\.?\d*')) AS DOUBLE) AS v FROM events),
runs AS (SELECT run_group, event_id, CASE WHEN v > 1 THEN v / 100 ELSE v END AS score FROM hits WHERE v <= 100)""",
}
