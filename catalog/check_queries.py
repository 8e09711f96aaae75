"""Baseline and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.bindings import (
    cust_eval, doc_eval, event_eval, line_eval, order_eval, quality_eval,
)
from catalog.registry import named, query, rounded
from holdfast.operators import baseline, integrity
from holdfast.plans.report import audit, overall_verdict


def stacked(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ------------------------------------------------------------------ baseline

@query("class_counts", using="quality", sql="""
SELECT label AS class, count(*) AS held_out_count FROM quality_rows WHERE split = 'test' GROUP BY label""")
def class_counts(spark, sf):
    return baseline.class_counts(quality_eval(spark, sf), "test")


@query("majority_baseline", using="event", sql="""
WITH c AS (SELECT label, count(*) AS n FROM event WHERE split = 'test' GROUP BY label)
SELECT CAST(sum(n) AS BIGINT) AS holdout_rows, count(*) AS n_classes,
  (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS majority_class,
  round(max(n) / sum(n), 6) AS majority_accuracy FROM c""")
def majority_baseline(spark, sf):
    return rounded(baseline.baseline_measures(event_eval(spark, sf), "test").select(
        "holdout_rows", "n_classes", "majority_class", "majority_accuracy"), "majority_accuracy")


_ACCURACY = """
SELECT '{name}' AS dataset, count(*) AS holdout_rows,
  CAST(sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM {name} WHERE split = 'test'"""


@query("accuracy", using="line ordr doc", sql=" UNION ALL ".join(
    _ACCURACY.format(name=n) for n in ("line", "ordr", "doc")))
def accuracy(spark, sf):
    sets = {"line": line_eval, "ordr": order_eval, "doc": doc_eval}
    return rounded(stacked(
        named(baseline.baseline_measures(f(spark, sf), "test"), n).select("dataset", "holdout_rows", "correct", "accuracy")
        for n, f in sets.items()), "accuracy")


@query("per_class_report", using="doc", sql="""
WITH h AS (SELECT * FROM doc WHERE split = 'test'),
t AS (SELECT label AS class, count(*) AS n, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS tp FROM h GROUP BY label),
p AS (SELECT prediction AS class, count(*) AS k FROM h GROUP BY prediction)
SELECT t.class, n AS held_out_count, round(n / (SELECT count(*) FROM h), 6) AS share, round(tp / n, 6) AS recall,
  round(CASE WHEN k > 0 THEN tp / k END, 6) AS precision, coalesce(k, 0) AS times_predicted
FROM t LEFT JOIN p ON t.class = p.class""")
def per_class_report(spark, sf):
    return rounded(baseline.per_class_report(doc_eval(spark, sf), "test"), "share", "recall", "precision")


_F1 = """
SELECT '{name}' AS dataset, round(avg(CASE WHEN tp > 0 THEN 2.0 * tp / (n + coalesce(k, 0)) ELSE 0.0 END), 6) AS macro_f1
FROM (SELECT label AS class, count(*) AS n, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS tp
      FROM {name} WHERE split = 'test' GROUP BY label) t
LEFT JOIN (SELECT prediction AS class, count(*) AS k FROM {name} WHERE split = 'test' GROUP BY prediction) p
  ON t.class = p.class"""


@query("macro_f1", using="doc line event", sql=" UNION ALL ".join(_F1.format(name=n) for n in ("doc", "line", "event")))
def macro_f1(spark, sf):
    sets = {"doc": doc_eval, "line": line_eval, "event": event_eval}
    return rounded(stacked(
        named(baseline.baseline_measures(f(spark, sf), "test"), n)
        .select("dataset", F.col("macro_f1_truth_classes").alias("macro_f1"))
        for n, f in sets.items()), "macro_f1")


_WILSON = """
SELECT '{name}' AS dataset,
  round(greatest(0.0, ((p + 1.96*1.96/(2*n)) - 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 6) AS ci_low,
  round(least(1.0, ((p + 1.96*1.96/(2*n)) + 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 6) AS ci_high
FROM (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS p
      FROM {name} WHERE split = 'test')"""


@query("wilson_interval", using="quality ordr", sql=" UNION ALL ".join(
    _WILSON.format(name=n) for n in ("quality_rows", "ordr")))
def wilson_interval(spark, sf):
    sets = {"quality_rows": quality_eval, "ordr": order_eval}
    return rounded(stacked(
        named(baseline.baseline_measures(f(spark, sf), "test"), n).select("dataset", "ci_low", "ci_high")
        for n, f in sets.items()), "ci_low", "ci_high")


@query("pred_collapse", using="event", sql="""
WITH p AS (SELECT prediction, count(*) AS n FROM event WHERE split = 'test' GROUP BY prediction)
SELECT (SELECT prediction FROM p ORDER BY n DESC, prediction LIMIT 1) AS top_predicted_class,
  round(max(n) / sum(n), 6) AS top_predicted_share,
  max(n) / sum(n) >= 0.95 AND (SELECT count(DISTINCT label) FROM event WHERE split = 'test') > 1 AS collapsed FROM p""")
def pred_collapse(spark, sf):
    return rounded(baseline.baseline_verdict(event_eval(spark, sf), "test").select(
        "top_predicted_class", "top_predicted_share", "collapsed"), "top_predicted_share")


_BASELINE = """
SELECT '{name}' AS dataset, round((correct - top) * 100.0 / n, 6) AS gain_pts,
  CASE WHEN (correct - top) * 100.0 / n < 2 OR (pred_top / n >= 0.95 AND classes > 1) THEN 'fail'
    WHEN (correct - top) * 100.0 / n < 10 OR top / n >= 0.80 THEN 'warn' ELSE 'pass' END AS status
FROM (SELECT count(*) AS n, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS correct,
        count(DISTINCT label) AS classes,
        (SELECT max(c) FROM (SELECT count(*) AS c FROM {name} WHERE split = 'test' GROUP BY label)) AS top,
        (SELECT max(c) FROM (SELECT count(*) AS c FROM {name} WHERE split = 'test' GROUP BY prediction)) AS pred_top
      FROM {name} WHERE split = 'test')"""


@query("baseline_verdict", using="quality ordr event line doc", sql=" UNION ALL ".join(
    _BASELINE.format(name=n) for n in ("quality_rows", "ordr", "event", "line", "doc")))
def baseline_verdict(spark, sf):
    sets = {"quality_rows": quality_eval, "ordr": order_eval, "event": event_eval, "line": line_eval, "doc": doc_eval}
    return rounded(stacked(
        named(baseline.baseline_verdict(f(spark, sf), "test"), n).select("dataset", "gain_pts", "status")
        for n, f in sets.items()), "gain_pts")


@query("baseline_no_predictions", using="cust", sql="""
WITH c AS (SELECT label, count(*) AS n FROM cust WHERE split = 'test' GROUP BY label)
SELECT (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS majority_class, round(max(n) / sum(n), 6) AS majority_accuracy,
  CASE WHEN max(n) / sum(n) >= 0.80 THEN 'warn' ELSE 'pass' END AS status FROM c""")
def baseline_no_predictions(spark, sf):
    return rounded(baseline.baseline_verdict(cust_eval(spark, sf), "test").select(
        "majority_class", "majority_accuracy", "status"), "majority_accuracy")


# ------------------------------------------------------------------ integrity

_DRIFT = """
SELECT '{name}' AS dataset, round(sum(abs(q - p)) / 2, 6) AS label_drift FROM (
  SELECT count(*) FILTER (WHERE split = 'train') / (SELECT count(*) FROM {name} WHERE split = 'train') AS p,
    count(*) FILTER (WHERE split = 'test') / (SELECT count(*) FROM {name} WHERE split = 'test') AS q
  FROM {name} WHERE split IN ('train', 'test') GROUP BY label)"""


@query("label_drift", using="line cust event", sql=" UNION ALL ".join(
    _DRIFT.format(name=n) for n in ("line", "cust", "event")))
def label_drift(spark, sf):
    sets = {"line": line_eval, "cust": cust_eval, "event": event_eval}
    return rounded(stacked(named(integrity.label_drift(f(spark, sf), "test"), n) for n, f in sets.items()), "label_drift")


@query("class_balance", using="cust", sql="""
WITH c AS (SELECT label AS class,
  count(*) FILTER (WHERE split = 'train') / (SELECT count(*) FROM cust WHERE split = 'train') AS p,
  count(*) FILTER (WHERE split = 'test') / (SELECT count(*) FROM cust WHERE split = 'test') AS q FROM cust GROUP BY label)
SELECT class, round(p, 6) AS train_share, round(q, 6) AS held_out_share, round((q - p) * 100, 6) AS difference_pts FROM c""")
def class_balance(spark, sf):
    return rounded(integrity.class_balance(cust_eval(spark, sf), "test"), "train_share", "held_out_share", "difference_pts")


@query("unseen_classes", using="cust", sql="""
SELECT label AS class FROM cust WHERE split = 'test' EXCEPT SELECT label FROM cust WHERE split = 'train'""")
def unseen_classes(spark, sf):
    return integrity.unseen_classes(cust_eval(spark, sf), "test")


@query("untested_classes", using="cust", sql="""
SELECT label AS class FROM cust WHERE split = 'train' EXCEPT SELECT label FROM cust WHERE split = 'test'""")
def untested_classes(spark, sf):
    return integrity.untested_classes(cust_eval(spark, sf), "test")


_GROUPS = """SELECT grp, count(*) FILTER (WHERE split = 'train') AS t, count(*) FILTER (WHERE split = 'test') AS h
FROM {name} GROUP BY grp"""


@query("group_overlap", using="event", sql=f"""
SELECT grp AS "group", h AS held_out_rows, t AS train_rows FROM ({_GROUPS.format(name='event')})
WHERE t > 0 AND h > 0 ORDER BY h DESC, grp LIMIT 20""")
def group_overlap(spark, sf):
    return integrity.group_overlap(event_eval(spark, sf), "test")


@query("group_overlap_all", using="line", sql=f"""
SELECT grp AS "group", h AS held_out_rows, t AS train_rows FROM ({_GROUPS.format(name='line')}) WHERE t > 0 AND h > 0""")
def group_overlap_all(spark, sf):
    return integrity.group_overlap(line_eval(spark, sf), "test", limit=None)


@query("group_overlap_summary", using="line event ordr doc", sql=" UNION ALL ".join(f"""
SELECT '{n}' AS dataset, (SELECT count(DISTINCT grp) FROM {n}) AS distinct_groups, count(*) FILTER (WHERE h > 0) AS holdout_groups,
  count(*) FILTER (WHERE h > 0 AND t > 0) AS overlapping_groups,
  round(count(*) FILTER (WHERE h > 0 AND t > 0) / greatest(count(*) FILTER (WHERE h > 0), 1), 6) AS overlap_share
FROM ({_GROUPS.format(name=n)})""" for n in ("line", "event", "ordr", "doc")))
def group_overlap_summary(spark, sf):
    sets = {"line": line_eval, "event": event_eval, "ordr": order_eval, "doc": doc_eval}
    return rounded(stacked(
        named(integrity.group_overlap_summary(f(spark, sf), "test"), n)
        .select("dataset", "distinct_groups", "holdout_groups", "overlapping_groups", "overlap_share")
        for n, f in sets.items()), "overlap_share")


@query("cross_split_ids", using="line", sql="""
WITH k AS (SELECT CAST(id AS VARCHAR) AS id, split, label FROM line)
SELECT id, split, label FROM k WHERE id IN (SELECT id FROM k GROUP BY id HAVING count(DISTINCT split) > 1)
ORDER BY id, split, label LIMIT 20""")
def cross_split_ids(spark, sf):
    return integrity.cross_split_rows(line_eval(spark, sf))


@query("duplicate_ids", using="line event", sql=" UNION ALL ".join(f"""
SELECT '{n}' AS dataset, count(*) - count(DISTINCT id) AS duplicate_ids,
  (SELECT count(*) FROM (SELECT id FROM {n} GROUP BY id HAVING count(DISTINCT split) > 1)) AS cross_split_ids
FROM {n}""" for n in ("line", "event")))
def duplicate_ids(spark, sf):
    sets = {"line": line_eval, "event": event_eval}
    return stacked(named(integrity.duplicate_ids(f(spark, sf)), n) for n, f in sets.items())


@query("holdout_margin", using="quality ordr", sql=" UNION ALL ".join(f"""
SELECT '{n}' AS dataset, count(*) AS holdout_rows, round(0.98 / sqrt(count(*)), 6) AS margin
FROM {n} WHERE split = 'test'""" for n in ("quality_rows", "ordr")))
def holdout_margin(spark, sf):
    sets = {"quality_rows": quality_eval, "ordr": order_eval}
    return rounded(stacked(named(integrity.holdout_margin(f(spark, sf), "test"), n) for n, f in sets.items()), "margin")


@query("unlabelled_rows", using="event", sql="""
SELECT count(*) FILTER (WHERE split = 'unlabelled') AS unlabelled_rows FROM event""")
def unlabelled_rows(spark, sf):
    return integrity.unlabelled_rows(event_eval(spark, sf))


# every rule of the ladder over one dataset; {id} is null where the ids are not looked at
_ISSUES = f"""
SELECT '{{name}}' AS dataset, i.* FROM (
  SELECT *, (SELECT count(*) FROM (SELECT id FROM {{name}} GROUP BY id HAVING count(DISTINCT split) > 1)) AS crossing,
    (SELECT count(*) - count(DISTINCT id) FROM {{name}}) AS dups,
    (SELECT count(*) FROM ({_GROUPS}) WHERE t > 0 AND h > 0) AS overlap,
    (SELECT count(*) FROM (SELECT label FROM {{name}} WHERE split = 'test' EXCEPT SELECT label FROM {{name}} WHERE split = 'train')) AS unseen,
    (SELECT count(*) FROM (SELECT label FROM {{name}} WHERE split = 'train' EXCEPT SELECT label FROM {{name}} WHERE split = 'test')) AS untested,
    (SELECT label_drift FROM ({_DRIFT})) AS drift
  FROM (SELECT count(*) FILTER (WHERE split = 'test') AS n, count(*) FILTER (WHERE split = 'unlabelled') AS loose FROM {{name}})),
LATERAL (
  SELECT 1 AS seq, 'cross_split_ids' AS code, 'fail' AS status, CAST(crossing AS DOUBLE) AS value WHERE crossing > 0
  UNION ALL SELECT 2, 'duplicate_ids', 'warn', dups WHERE crossing = 0 AND dups > 0
  UNION ALL SELECT 3, 'group_overlap', 'fail', overlap WHERE overlap > 0
  UNION ALL SELECT 4, 'unseen_classes', 'fail', unseen WHERE unseen > 0
  UNION ALL SELECT 5, 'untested_classes', 'warn', untested WHERE untested > 0
  UNION ALL SELECT 6, 'label_drift', CASE WHEN drift >= 0.25 THEN 'fail' ELSE 'warn' END, drift WHERE drift >= 0.10
  UNION ALL SELECT 7, 'small_holdout', CASE WHEN n < 50 THEN 'fail' ELSE 'warn' END, n WHERE n < 200
  UNION ALL SELECT 8, 'unlabelled_rows', 'warn', loose WHERE loose > 0) i"""
_ISSUE_SETS = {"line": line_eval, "event": event_eval, "quality_rows": quality_eval, "cust": cust_eval, "ordr": order_eval}


@query("integrity_issues", using="line event quality cust ordr", sql=" UNION ALL ".join(
    _ISSUES.format(name=n) for n in _ISSUE_SETS))
def integrity_issues(spark, sf):
    return rounded(stacked(
        named(integrity.integrity_issues(f(spark, sf), "test"), n).select("dataset", "seq", "code", "status", "value")
        for n, f in _ISSUE_SETS.items()), "value")


@query("integrity_verdict", using="line event quality cust ordr", sql="""
SELECT d.dataset, coalesce(CASE max(CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 END)
    WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' END, 'pass') AS status, count(code) AS n_issues,
  coalesce(arg_min(code, seq), 'none') AS headline_issue
FROM (VALUES ('line'), ('event'), ('quality_rows'), ('cust'), ('ordr')) d(dataset)
LEFT JOIN (""" + " UNION ALL ".join(_ISSUES.format(name=n) for n in _ISSUE_SETS) + """) x ON x.dataset = d.dataset
GROUP BY d.dataset""")
def integrity_verdict(spark, sf):
    return stacked(
        named(integrity.integrity_verdict(f(spark, sf), "test"), n).select(
            "dataset", "status", F.size("issues").cast("bigint").alias("n_issues"),
            F.coalesce(F.get("issues", F.lit(0))["code"], F.lit("none")).alias("headline_issue"))
        for n, f in _ISSUE_SETS.items())


@query("overall_verdict", using="ordr", sql=f"""
WITH s AS (
  SELECT CASE WHEN EXISTS (SELECT 1 FROM ordr GROUP BY round_even(o_totalprice, 6), o_orderpriority
      HAVING count(DISTINCT split) > 1 AND count(*) FILTER (WHERE split = 'test') > 0) THEN 'fail' ELSE 'skip' END AS status
  UNION ALL SELECT status FROM ({_BASELINE.format(name='ordr')})
  UNION ALL SELECT 'skip'
  UNION ALL SELECT coalesce(CASE max(CASE status WHEN 'fail' THEN 3 ELSE 2 END) WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' END, 'pass')
    FROM ({_ISSUES.format(name='ordr')}))
SELECT count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'warn') AS n_warn,
  count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'skip') AS n_skip,
  CASE WHEN count(*) FILTER (WHERE status = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (WHERE status = 'warn') > 0 THEN 'warn'
    WHEN count(*) FILTER (WHERE status = 'pass') > 0 THEN 'pass' ELSE 'skip' END AS verdict FROM s""")
def overall(spark, sf):
    return overall_verdict(audit(order_eval(spark, sf)).results).select(
        "n_pass", "n_warn", "n_fail", "n_skip", "verdict")
