"""Duplicates, encoding, similarity search and the leakage verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.bindings import (
    DIMS, bound, cust_eval, doc_eval, emb_eval, emb_leaky, emb_vector, emb_wide, line_eval, part_eval,
)
from catalog.check_queries import _BASELINE, _ISSUES, stacked
from catalog.registry import named, query, rounded
from holdfast.fixed import WHITE_SPACE as SPACE
from holdfast.operators import duplicates, encode, leakage
from holdfast.operators.background import (
    background_pairs, background_similarity, calibrated_threshold,
)
from holdfast.operators.nearest import BlockPlan
from holdfast.operators.ngrams import document_frequency
from holdfast.plans.report import audit
from holdfast.storage import spread, written

# ------------------------------------------------------------------ SQL parts

WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def tfidf_sql(rows: str, text: str) -> str:
    """Unit tf-idf weights of every row of ``rows`` (with id and a text): unit(id, term, w)."""
    cuts = ", ".join(
        f"list_transform(range(1, greatest(length(w) - {n - 2}, 1)), lambda i: substr(w, i, {n}))" for n in (3, 4, 5))
    return rf"""words AS (SELECT id, ' ' || word || ' ' AS w, count(*) AS n FROM (
    SELECT id, unnest(regexp_split_to_array(lower({text}), '{WHITE}')) AS word FROM {rows}) WHERE word <> '' GROUP BY id, word),
tf AS MATERIALIZED (SELECT id, term, CAST(sum(n) AS BIGINT) AS tf FROM (
    SELECT id, n, unnest(list_concat({cuts})) AS term FROM words) GROUP BY id, term),
vocab AS MATERIALIZED (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df,
    ln((1 + (SELECT count(*) FROM {rows})) / (1 + count(*))) + 1 AS idf
  FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 20000),
unit AS MATERIALIZED (SELECT id, term, tf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w
  FROM tf JOIN vocab USING (term))"""


DOC_UNIT = tfidf_sql("doc", "text")
# the same weights with numbered terms, which join in far less memory
DOC_CELLS = DOC_UNIT + """,
num AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY term) AS no FROM vocab),
cells AS MATERIALIZED (SELECT id, split, id * 32768 + no AS cell, no, w FROM unit JOIN num USING (term) JOIN doc USING (id))"""
DOC_SIMS = DOC_CELLS + """,
sims AS MATERIALIZED (SELECT a.id AS h, b.id AS t, round(sum(a.w * b.w), 6) AS s
  FROM (SELECT id, no, w FROM cells WHERE split = 'test') a
  JOIN (SELECT id, no, w FROM cells WHERE split = 'train') b USING (no) GROUP BY a.id, b.id)"""
EMB_UNIT = """dims AS (SELECT id, split, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS j FROM emb),
stat AS (SELECT j, avg(x) AS m, stddev_pop(x) AS sd FROM dims GROUP BY j),
z AS (SELECT id, split, list((x - m) / sd ORDER BY j) AS z FROM dims JOIN stat USING (j) GROUP BY id, split),
unit AS MATERIALIZED (SELECT id, split, list_transform(z, lambda x: x / sqrt(list_dot_product(z, z))) AS u FROM z)"""
EMB_SIMS = EMB_UNIT + """,
sims AS MATERIALIZED (SELECT a.id AS h, b.id AS t, round(list_dot_product(a.u, b.u), 6) AS s
  FROM unit a JOIN unit b ON a.split = 'test' AND b.split = 'train')"""
NEAREST = """
nearest AS MATERIALIZED (SELECT h, t, s FROM sims QUALIFY row_number() OVER (PARTITION BY h ORDER BY s DESC, t) = 1)"""


def background_sql(rows: str, cosine: str) -> str:
    return f"""picked AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS place FROM {rows}),
steps AS MATERIALIZED (SELECT n, min(7919 + i) FILTER (WHERE gcd(7919 + i, n) = 1) AS p,
    min(104729 + i) FILTER (WHERE gcd(104729 + i, n) = 1) AS q
  FROM (SELECT count(*) AS n FROM picked), range(0, 1000, 2) AS s(i) GROUP BY n),
pairs AS (SELECT k, (k * p + 13) % n AS l, (k * q + (k // n) * 31 + 7) % n AS r FROM range(40000) AS g(k), steps),
rel AS (SELECT a.id AS x, b.id AS y, k FROM pairs JOIN picked a ON a.place = l JOIN picked b ON b.place = r WHERE l <> r),
bg AS MATERIALIZED (SELECT round(quantile_cont(s, 0.995), 6) AS background FROM ({cosine}))"""


EMB_BG = background_sql("emb", "SELECT list_dot_product(a.u, b.u) AS s FROM rel JOIN unit a ON a.id = x JOIN unit b ON b.id = y")
DOC_BG = """lists AS MATERIALIZED (SELECT id, list(no) AS nos, list(w) AS ws FROM cells GROUP BY id),
""" + background_sql("doc", """SELECT coalesce(s, 0.0) AS s FROM rel LEFT JOIN (
    SELECT k, sum(p.w * c.w) AS s FROM (SELECT k, y * 32768 + unnest(nos) AS cell, unnest(ws) AS w
      FROM rel JOIN lists ON id = x) p JOIN cells c ON c.cell = p.cell GROUP BY k) USING (k)""")


# ------------------------------------------------------------------ duplicates

@query("exact_duplicates", using="doc line cust", sql=f"""
WITH f AS (
  SELECT 'doc' AS dataset, split, trim(text, '{SPACE}') AS a, '' AS b, '' AS c, '' AS d, '' AS e FROM doc
  UNION ALL SELECT 'line', split, CAST(round_even(l_quantity, 6) AS VARCHAR), CAST(round_even(l_extendedprice, 6) AS VARCHAR),
    CAST(round_even(l_discount, 6) AS VARCHAR), CAST(round_even(l_tax, 6) AS VARCHAR), trim(l_linestatus, '{SPACE}') FROM line
  UNION ALL SELECT 'cust', split, CAST(round_even(c_acctbal, 6) AS VARCHAR), trim(c_name, '{SPACE}'), '', '', '' FROM cust),
g AS (SELECT dataset, count(*) FILTER (WHERE split = 'test') AS h, count(*) FILTER (WHERE split = 'train') AS t,
  count(DISTINCT split) AS k FROM f GROUP BY dataset, a, b, c, d, e)
SELECT dataset, CAST(coalesce(sum(h) FILTER (WHERE k > 1), 0) AS BIGINT) AS exact_any_split,
  CAST(coalesce(sum(h) FILTER (WHERE t > 0), 0) AS BIGINT) AS exact_in_train FROM g GROUP BY dataset""")
def exact_duplicates(spark, sf):
    sets = {"doc": doc_eval, "line": line_eval, "cust": cust_eval}
    return stacked(named(duplicates.exact_duplicates(f(spark, sf), "test"), n) for n, f in sets.items())


@query("fingerprint_groups", using="line", sql="""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE split = 'test') AS held_out_rows,
  count(*) FILTER (WHERE split = 'train') AS train_rows, count(DISTINCT split) > 1 AS crosses FROM line
GROUP BY l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus""")
def fingerprint_groups(spark, sf):
    return duplicates.fingerprint_groups(line_eval(spark, sf), "test").drop("fingerprint")


# ------------------------------------------------------------------ encoding

@query("column_profile", using="part", sql="""
WITH c AS (
  SELECT 'size' AS "column", size AS v, NULL AS s FROM part_rows UNION ALL SELECT 'price', price, NULL FROM part_rows
  UNION ALL SELECT 'size_text', size_text, CAST(size_text AS VARCHAR) FROM part_rows
  UNION ALL SELECT 'brand', NULL, brand FROM part_rows UNION ALL SELECT 'type', NULL, type FROM part_rows
  UNION ALL SELECT 'name', NULL, name FROM part_rows),
a AS (SELECT "column", count(v) / count(*) AS parsed_share, count(DISTINCT s) AS d FROM c GROUP BY "column")
SELECT "column", CASE WHEN "column" IN ('size', 'price') OR parsed_share > 0.9 THEN 'numeric'
    WHEN d <= 50 THEN 'categorical' ELSE 'text' END AS kind, round(parsed_share, 6) AS parsed_share,
  CASE WHEN NOT ("column" IN ('size', 'price') OR parsed_share > 0.9) AND d <= 50 THEN d END AS levels FROM a""")
def column_profile(spark, sf):
    t = part_eval(spark, sf)
    return rounded(encode.column_profile(t.df, t.features), "parsed_share")


_PART_NUM = """filled AS (SELECT id, split, coalesce(size, (SELECT median(size) FROM part_rows), 0.0) AS size,
    coalesce(price, (SELECT median(price) FROM part_rows), 0.0) AS price, size_text FROM part_rows),
num AS MATERIALIZED (SELECT id, split, (size - (SELECT avg(size) FROM filled)) / (SELECT stddev_pop(size) FROM filled) AS size,
    (price - (SELECT avg(price) FROM filled)) / (SELECT stddev_pop(price) FROM filled) AS price,
    (size_text - (SELECT avg(size_text) FROM filled)) / (SELECT stddev_pop(size_text) FROM filled) AS size_text FROM filled)"""


@query("impute_standardise", using="part", sql=f"""
WITH {_PART_NUM} SELECT id, round(size, 6) AS size, round(price, 6) AS price, round(size_text, 6) AS size_text FROM num""")
def impute_standardise(spark, sf):
    t = part_eval(spark, sf)
    numeric = ["size", "price", "size_text"]
    e = encode.Encoding(numeric=encode.fit_numeric(t.df, numeric))
    z = e.standardised(t.df)
    return rounded(t.df.select("id", *[z[c].alias(c) for c in numeric]), *numeric)


@query("one_hot", using="part", sql="""
WITH c AS (SELECT id, 'brand' AS "column", coalesce(brand, 'nan') AS level FROM part_rows
  UNION ALL SELECT id, 'type', type FROM part_rows),
l AS (SELECT "column", CAST(count(DISTINCT level) AS BIGINT) AS levels FROM c GROUP BY "column")
SELECT id, "column", level, levels, 1.0::DOUBLE AS weight FROM c JOIN l USING ("column")""")
def one_hot(spark, sf):
    t = part_eval(spark, sf)
    e = encode.fit(t.df, ["brand", "type"])
    cells = [
        t.df.select("id", F.lit(c).alias("column"), F.lit(len(levels)).cast("bigint").alias("levels"),
                    F.inline(F.arrays_zip(F.array(*[F.lit(x) for x in levels]).alias("level"),
                                          e.one_hot(c, levels).alias("weight"))))
        for c, levels in e.categorical
    ]
    return stacked(c.where("weight > 0") for c in cells)


@query("ngram_vocabulary", using="doc", sql=f"""
WITH {DOC_UNIT} SELECT term, total, df, round(idf, 6) AS idf FROM vocab""")
def ngram_vocabulary(spark, sf):
    """Totals from the vocabulary, document frequencies from the encoded rows."""
    from holdfast.operators.ngrams import vocabulary

    t = doc_eval(spark, sf)
    coded = encode.encode(t, "test", "id")
    terms = coded.encoding.terms
    place = spark.createDataFrame(list(enumerate(terms)), "number int, term string")
    frequency = coded.vectors.select(F.explode("terms").alias("number"), (F.col("train_rows") + F.col("held_rows")).alias("n")) \
        .groupBy("number").agg(F.sum("n").alias("df"))
    return rounded(
        vocabulary(t.df, F.col("text")).join(place, "term").join(frequency, "number").select(
            "term", "total", "df", (F.log((1 + F.lit(coded.encoding.rows)) / (1 + F.col("df"))) + 1).alias("idf")), "idf")


@query("ngram_tfidf", using="doc", sql=f"""
WITH {DOC_UNIT} SELECT id, count(*) AS n_terms, round(sum(w), 6) AS weight_sum, round(max(w), 6) AS weight_max,
  CAST(sum(tf) AS BIGINT) AS n_grams FROM unit GROUP BY id""")
def ngram_tfidf(spark, sf):
    t = doc_eval(spark, sf)
    e = encode.fit(t.df, t.features)
    counted = written(e.apply(spread(t.df), ["id"]), "counts")
    e = encode.with_idf(e, document_frequency(counted, len(e.terms)))
    grams = counted.select("id", F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_grams"))
    weights = e.weighted(counted).select(
        "id", F.size("terms").cast("bigint").alias("n_terms"),
        F.aggregate("weights", F.lit(0.0), lambda s, x: s + x).alias("weight_sum"),
        F.array_max("weights").alias("weight_max"))
    return rounded(weights.join(grams, "id"), "weight_sum", "weight_max")


_PART_TEXT = tfidf_sql("part_rows", "name")
_PART_UNIT = f"""{_PART_NUM}, {_PART_TEXT},
parts AS MATERIALIZED (
  SELECT id, ':' || c AS term, x / sqrt(size * size + price * price + size_text * size_text) / sqrt(3) AS w
  FROM (SELECT *, unnest(['size', 'price', 'size_text']) AS c, unnest([size, price, size_text]) AS x FROM num)
  UNION ALL SELECT id, ':' || c || '=' || x, 1 / sqrt(2) / sqrt(3) FROM (
    SELECT id, unnest(['brand', 'type']) AS c, unnest([coalesce(brand, 'nan'), type]) AS x FROM part_rows)
  UNION ALL SELECT id, term, w / sqrt(3) FROM unit)"""


PART_SIMS = _PART_UNIT + """, sims AS MATERIALIZED (SELECT a.id AS h, b.id AS t, round(sum(a.w * b.w), 6) AS s
  FROM (SELECT p.* FROM parts p JOIN part_rows USING (id) WHERE split = 'test') a
  JOIN (SELECT p.* FROM parts p JOIN part_rows USING (id) WHERE split = 'train') b USING (term) GROUP BY a.id, b.id)"""


@query("encode_blocks", using="part", sql=f"""
WITH {_PART_UNIT} SELECT id, round(sum(w) FILTER (WHERE term IN (':size', ':price', ':size_text')), 6) AS number_sum,
  round(sum(w) FILTER (WHERE term LIKE ':%=%'), 6) AS level_sum,
  round(sum(w) FILTER (WHERE term NOT LIKE ':%'), 6) AS text_sum, round(sum(w * w), 6) AS norm
FROM parts GROUP BY id""")
def encode_blocks(spark, sf):
    t = part_eval(spark, sf)
    coded = encode.encode(t, "test", "id")
    n = len(coded.encoding.numeric)

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)

    def squares(c):
        return F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)

    return rounded(coded.vectors.select(
        F.coalesce("train_ref", "held_ref").alias("id"), total(F.slice("dense", 1, n)).alias("number_sum"),
        total(F.slice("dense", n + 1, 10_000)).alias("level_sum"), total("weights").alias("text_sum"),
        (squares("dense") + squares("weights")).alias("norm")), "number_sum", "level_sum", "text_sum", "norm")


# ------------------------------------------------------------------ similarity search

def _twins(table, floor: float | None, plan=None) -> tuple[DataFrame, encode.EncodedTable]:
    coded = encode.encode(table, "test", "id")
    return leakage.nearest_train(coded, floor, plan), coded


def _per_row(table, twins) -> DataFrame:
    # written: the rows meet the result in three joins
    return leakage.nearest_per_row(duplicates.row_keys(table, "test", "id"), "test", written(twins, "twins"))


#: Many cells whatever the size of the table, so that small tables take the path of large ones.
CELLS = BlockPlan(one_cell_rows=20, max_pivots=20)
_ROWS = "SELECT h AS holdout_id, t AS train_id, s AS similarity FROM nearest"


@query("nearest_train", using="emb", sql=f"WITH {EMB_SIMS}, {NEAREST} {_ROWS}")
def nearest_train(spark, sf):
    """The closest train row of every hold-out row, however far."""
    t = emb_eval(spark, sf)
    return _per_row(t, _twins(t, None)[0])


@query("nearest_train_vector", using="emb", sql=f"WITH {EMB_SIMS}, {NEAREST} {_ROWS}")
def nearest_train_vector(spark, sf):
    """nearest_train over one column of vectors instead of 64 columns."""
    t = emb_vector(spark, sf)
    return _per_row(t, _twins(t, None)[0])


@query("vector_profile", using="emb", sql="""
SELECT 'embedding' AS "column", 'vector' AS kind, count(v) / count(*) AS parsed_share, CAST(NULL AS BIGINT) AS levels FROM emb""")
def vector_profile(spark, sf):
    t = emb_vector(spark, sf)
    return encode.column_profile(t.df, t.features)


@query("nearest_train_text", using="doc", sql=f"WITH {DOC_SIMS}, {NEAREST} {_ROWS}")
def nearest_train_text(spark, sf):
    t = doc_eval(spark, sf)
    return _per_row(t, _twins(t, None)[0])


@query("nearest_train_mixed", using="part", sql=f"""
WITH {PART_SIMS}, {NEAREST} SELECT h AS holdout_id, t AS train_id, s AS similarity FROM nearest WHERE s >= 0.5""")
def nearest_train_mixed(spark, sf):
    t = part_eval(spark, sf)
    return _per_row(t, _twins(t, 0.5)[0])


@query("nearest_cells_dense", using="emb", sql=f"WITH {EMB_SIMS}, {NEAREST} {_ROWS}")
def nearest_cells_dense(spark, sf):
    """nearest_train in 20 cells."""
    t = emb_eval(spark, sf)
    return _per_row(t, _twins(t, None, CELLS)[0])


@query("nearest_cells_text", using="doc", sql=f"WITH {DOC_SIMS}, {NEAREST} {_ROWS} WHERE s >= 0.95")
def nearest_cells_text(spark, sf):
    """near_dup_rows in 20 cells."""
    t = doc_eval(spark, sf)
    return _per_row(t, _twins(t, 0.95, CELLS)[0])


@query("near_dup_names", using="part", sql=f"""
WITH {_PART_TEXT}, sims AS MATERIALIZED (SELECT a.id AS h, b.id AS t, round(sum(a.w * b.w), 6) AS s
  FROM (SELECT u.* FROM unit u JOIN part_rows USING (id) WHERE split = 'test') a
  JOIN (SELECT u.* FROM unit u JOIN part_rows USING (id) WHERE split = 'train') b USING (term) GROUP BY a.id, b.id), {NEAREST}
{_ROWS} WHERE s >= 0.7""")
def near_dup_names(spark, sf):
    """Short texts: parts whose names are all but the same; the search picks its plan by the size of the index."""
    t = part_eval(spark, sf)
    t = bound(t.df.select("id", "split", "label", "name"))
    return _per_row(t, _twins(t, 0.7)[0])


@query("near_dup_rows", using="doc", sql=f"WITH {DOC_SIMS}, {NEAREST} {_ROWS} WHERE s >= 0.95")
def near_dup_rows(spark, sf):
    """Every hold-out document with a train twin at or above the threshold."""
    t = doc_eval(spark, sf)
    return _per_row(t, _twins(t, 0.95)[0])


@query("near_dup_pairs", using="doc", sql=f"""
WITH {DOC_SIMS}, {NEAREST}
SELECT round_even(s, 4) AS similarity, CAST(h AS VARCHAR) AS holdout_id, CAST(t AS VARCHAR) AS train_id,
  a.label AS holdout_label, b.label AS train_label
FROM nearest JOIN doc a ON a.id = h JOIN doc b ON b.id = t WHERE s >= 0.95 ORDER BY s DESC, h, t LIMIT 25""")
def near_dup_pairs(spark, sf):
    t = doc_eval(spark, sf)
    return leakage.near_duplicate_pairs(t, "test", duplicates.row_keys(t, "test", "id"), _twins(t, 0.95)[0], 0.95)


@query("near_dup_pairs_dense", using="emb_leaky", sql=f"""
WITH {EMB_SIMS}, {NEAREST} {_ROWS} WHERE s >= 0.95""")
def near_dup_pairs_dense(spark, sf):
    t = emb_leaky(spark, sf)
    return _per_row(t, _twins(t, 0.95)[0])


@query("near_dup_pairs_wide", using="emb_wide", sql=f"""
WITH {EMB_SIMS}, {NEAREST}
SELECT round_even(s, 4) AS similarity, CAST(h AS VARCHAR) AS holdout_id, CAST(t AS VARCHAR) AS train_id,
  a.label AS holdout_label, b.label AS train_label
FROM nearest JOIN emb a ON a.id = h JOIN emb b ON b.id = t WHERE s >= 0.95 ORDER BY s DESC, h, t LIMIT 25""")
def near_dup_pairs_wide(spark, sf):
    """The most similar pairs over 256 feature columns."""
    t = emb_wide(spark, sf)
    return leakage.near_duplicate_pairs(t, "test", duplicates.row_keys(t, "test", "id"), _twins(t, 0.95)[0], 0.95)


_CLOSEST = "SELECT h AS holdout_id, t AS train_id, s AS similarity FROM sims ORDER BY s DESC, h, t LIMIT 1"


def _closest(table, plan=None) -> DataFrame:
    found = leakage.closest_pair(encode.encode(table, "test", "id"), plan)
    return found.withColumnsRenamed({"held_ref": "holdout_id", "train_ref": "train_id"})


@query("closest_pair_dense", using="emb", sql=f"WITH {EMB_SIMS} {_CLOSEST}")
def closest_pair_dense(spark, sf):
    """The most similar pair across the split, in 20 cells."""
    return _closest(emb_eval(spark, sf), CELLS)


@query("closest_pair_text", using="doc", sql=f"WITH {DOC_SIMS} {_CLOSEST}")
def closest_pair_text(spark, sf):
    return _closest(doc_eval(spark, sf), CELLS)


@query("closest_pair_mixed", using="part", sql=f"WITH {PART_SIMS} {_CLOSEST}")
def closest_pair_mixed(spark, sf):
    return _closest(part_eval(spark, sf), CELLS)


# ------------------------------------------------------------------ calibration and verdict

@query("background_similarity", using="emb", sql=f"WITH {EMB_UNIT}, {EMB_BG} SELECT background FROM bg")
def background(spark, sf):
    t = emb_eval(spark, sf)
    return background_similarity(background_pairs(duplicates.row_keys(t, "test", "id"), encode.encode(t, "test", "id")))


@query("calibrated_threshold", using="doc", sql=f"""
WITH {DOC_CELLS}, {DOC_BG}
SELECT CAST(asked AS DOUBLE) AS asked, background, greatest(asked, background) AS threshold
FROM bg, (VALUES (0.5), (0.8), (0.95)) a(asked)""")
def calibrated(spark, sf):
    t = doc_eval(spark, sf)
    coded = encode.encode(t, "test", "id")
    bg = background_similarity(background_pairs(duplicates.row_keys(t, "test", "id"), coded)).first()["background"]
    return spark.createDataFrame(
        [(a, bg, calibrated_threshold(a, bg)) for a in (0.5, 0.8, 0.95)],
        "asked double, background double, threshold double")


@query("leak_adjusted_accuracy", using="doc", sql=f"""
WITH {DOC_SIMS}, {NEAREST},
r AS (SELECT id, label = prediction AS ok, coalesce(s >= 0.95, false) AS leaked
  FROM doc LEFT JOIN nearest ON h = id WHERE split = 'test')
SELECT count(*) AS holdout_rows, count(*) FILTER (WHERE leaked) AS flagged,
  round(count(*) FILTER (WHERE leaked) / count(*), 6) AS flagged_share,
  round(avg(CAST(ok AS INT)), 6) AS accuracy_all, round(avg(CAST(ok AS INT)) FILTER (WHERE NOT leaked), 6) AS accuracy_clean,
  round((avg(CAST(ok AS INT)) - avg(CAST(ok AS INT)) FILTER (WHERE NOT leaked)) * 100, 6) AS drop_pts FROM r""")
def leak_adjusted_accuracy(spark, sf):
    t = doc_eval(spark, sf)
    return rounded(leakage.leak_measures(t, "test", _twins(t, 0.95)[0], 0.95).select(
        "holdout_rows", "flagged", "flagged_share", "accuracy_all", "accuracy_clean", "drop_pts"),
        "flagged_share", "accuracy_all", "accuracy_clean", "drop_pts")


_VERDICT = "dataset", "reason", "width", "holdout_rows", "exact_any_split", "flagged", "status"


@query("leakage_verdict", using="emb_leaky", sql=f"""
WITH {EMB_SIMS}, {EMB_BG}, {NEAREST},
m AS (SELECT (SELECT count(*) FROM emb WHERE split = 'test') AS n,
  (SELECT count(*) FROM nearest, bg WHERE s >= greatest(0.95, background)) AS flagged)
SELECT 'emb_leaky' AS dataset, 'searched' AS reason, CAST({DIMS} AS BIGINT) AS width, n AS holdout_rows,
  CAST(0 AS BIGINT) AS exact_any_split, flagged,
  CASE WHEN flagged = 0 THEN 'pass' WHEN flagged / n >= 0.05 THEN 'fail' ELSE 'warn' END AS status FROM m""")
def leakage_verdict(spark, sf):
    return named(leakage.leakage_verdict(emb_leaky(spark, sf)).measures, "emb_leaky").select(*_VERDICT)


@query("leakage_verdict_clean", using="emb", sql=f"""
WITH {EMB_SIMS}, {EMB_BG}
SELECT 'emb' AS dataset, 'pass' AS status, CAST(0 AS BIGINT) AS flagged, max(s) AS max_similarity,
  (SELECT greatest(0.95, background) FROM bg) AS threshold FROM sims""")
def leakage_verdict_clean(spark, sf):
    """Nothing is flagged; the closest pair is told all the same."""
    m = leakage.leakage_verdict(emb_eval(spark, sf)).measures
    return named(m, "emb").select("dataset", "status", "flagged", "max_similarity", "threshold")


@query("leakage_verdict_text", using="doc", sql=f"""
WITH {DOC_SIMS}, {DOC_BG}, {NEAREST},
g AS (SELECT count(*) FILTER (WHERE split = 'test') AS h, count(DISTINCT split) AS k FROM doc GROUP BY trim(text, '{SPACE}')),
m AS (SELECT (SELECT count(*) FROM doc WHERE split = 'test') AS n, (SELECT CAST(sum(h) AS BIGINT) FROM g WHERE k > 1) AS exact_any_split,
  (SELECT count(*) FROM nearest, bg WHERE s >= greatest(0.95, background)) AS flagged)
SELECT 'doc' AS dataset, 'searched' AS reason, (SELECT count(*) FROM vocab) AS width, n AS holdout_rows, exact_any_split, flagged,
  CASE WHEN flagged = 0 AND exact_any_split = 0 THEN 'pass' WHEN flagged / n >= 0.05 OR exact_any_split > 0 THEN 'fail'
    ELSE 'warn' END AS status FROM m""")
def leakage_verdict_text(spark, sf):
    return named(leakage.leakage_verdict(doc_eval(spark, sf)).measures, "doc").select(*_VERDICT)


@query("leakage_verdict_narrow", using="line", sql="""
WITH g AS (SELECT count(*) FILTER (WHERE split = 'test') AS h, count(DISTINCT split) AS k FROM line
  GROUP BY l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus),
m AS (SELECT CAST(coalesce(sum(h) FILTER (WHERE k > 1), 0) AS BIGINT) AS x FROM g)
SELECT 'line' AS dataset, 'too_narrow' AS reason, (SELECT 4 + count(DISTINCT l_linestatus) FROM line) AS width,
  (SELECT count(*) FROM line WHERE split = 'test') AS holdout_rows, x AS exact_any_split, CAST(NULL AS BIGINT) AS flagged,
  CASE WHEN x > 0 THEN 'fail' ELSE 'skip' END AS status FROM m""")
def leakage_verdict_narrow(spark, sf):
    return named(leakage.leakage_verdict(line_eval(spark, sf)).measures, "line").select(*_VERDICT)


@query("audit_report", using="doc", sql=f"""
WITH {DOC_SIMS}, {DOC_BG}, {NEAREST},
g AS (SELECT count(*) FILTER (WHERE split = 'test') AS h, count(DISTINCT split) AS k FROM doc GROUP BY trim(text, '{SPACE}')),
m AS (SELECT (SELECT count(*) FROM doc WHERE split = 'test') AS n, (SELECT coalesce(sum(h), 0) FROM g WHERE k > 1) AS x,
  (SELECT count(*) FROM nearest, bg WHERE s >= greatest(0.95, background)) AS flagged),
r AS (
  SELECT 'leakage' AS key, CASE WHEN flagged = 0 AND x = 0 THEN 'pass' WHEN flagged / n >= 0.05 OR x > 0 THEN 'fail'
    ELSE 'warn' END AS status FROM m
  UNION ALL SELECT 'baseline', status FROM ({_BASELINE.format(name='doc')})
  UNION ALL SELECT 'variance', 'skip'
  UNION ALL SELECT 'integrity', coalesce(CASE max(CASE status WHEN 'fail' THEN 3 ELSE 2 END)
    WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' END, 'pass') FROM ({_ISSUES.format(name='doc')}))
SELECT key, status, CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 WHEN 'pass' THEN 1 ELSE 0 END AS severity FROM r""")
def audit_report(spark, sf):
    """All four checks over the documents."""
    return document_audit(spark, sf).select("key", "status", "severity")


def document_audit(spark, sf) -> DataFrame:
    return audit(doc_eval(spark, sf)).results
