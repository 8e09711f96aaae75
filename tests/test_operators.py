"""Operators against plain computations, and results that must not depend on layout."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import two_classes
from holdfast.functions.columns import key_text, split_name
from holdfast.operators.duplicates import exact_key, fingerprint, row_keys
from holdfast import audit, audit_manifest, audit_table, clamp_threshold
from holdfast.operators.encode import EncodedTable, column_profile, encode, fit_numeric
from holdfast.operators.joins import JoinPlan, lookup
from holdfast.operators.leakage import closest_pair as closest_contents
from holdfast.operators.leakage import highest_similarity, nearest_train
from holdfast.operators.nearest import BlockPlan, closest_pair, nearest_neighbours
from holdfast.operators.quantiles import exact_quantiles
from holdfast.sources import (
    load_csv, load_parquet, manifest, manifest_entry, with_row_position, write_dataset,
    write_manifest, write_report,
)

SMALL = BlockPlan(one_cell_rows=8, max_pivots=12, block_bytes=4096, max_block_rows=9)


# ------------------------------------------------------------------ similarity join

def _unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _side(spark, prefix, dense, sparse=None):
    rows = []
    for i in range(len(dense)):
        terms = np.flatnonzero(sparse[i]) if sparse is not None else []
        rows.append((f"{prefix}{i}", i, [float(x) for x in dense[i]], [int(t) for t in terms],
                     [float(sparse[i][t]) for t in terms]))
    return spark.createDataFrame(
        rows, "key string, ref int, dense array<double>, terms array<int>, weights array<double>").repartition(3)


def _brute(q, b, floor):
    sims = np.round(q @ b.T, 6)
    return {f"q{i}": (int(s.argmax()), float(s.max())) for i, s in enumerate(sims) if floor is None or s.max() >= floor}


def _clusters(rng, n, width, centres=6, noise=0.15):
    c = rng.normal(size=(centres, width))
    return c[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, width))


@pytest.mark.parametrize("floor", [None, 0.5, 0.95])
@pytest.mark.parametrize("kind", ["isotropic", "clustered", "hot", "sparse", "mixed"])
def test_nearest_equals_brute_force(spark, kind, floor):
    rng = np.random.default_rng(len(kind))
    if kind == "isotropic":
        q, b = rng.normal(size=(40, 24)), rng.normal(size=(150, 24))
    elif kind == "clustered":
        both = _clusters(rng, 200, 12)
        q, b = both[:50], both[50:]
    elif kind == "hot":  # most rows are near copies of one
        both = np.vstack([1 + 0.02 * rng.normal(size=(150, 10)), rng.normal(size=(50, 10))])
        both = both[rng.permutation(200)]
        q, b = both[:50], both[50:]
    else:
        both = (rng.random((200, 300)) < 0.06) * rng.random((200, 300))
        both[40:60] = both[60:80] + 0.05 * both[:20]  # near twins on the other side
        q, b = both[:50], both[50:]
    q, b = _unit(q), _unit(b)
    if kind == "mixed":
        qd, bd = _unit(rng.normal(size=(50, 5))), _unit(rng.normal(size=(150, 5)))
        Q, B = np.hstack([qd, q]) / np.sqrt(2), np.hstack([bd, b]) / np.sqrt(2)
        queries, base = _side(spark, "q", Q[:, :5], Q[:, 5:]), _side(spark, "b", B[:, :5], B[:, 5:])
        q, b = Q, B
    elif kind == "sparse":
        none = np.zeros((200, 0))
        queries, base = _side(spark, "q", none[:50], q), _side(spark, "b", none[:150], b)
    else:
        queries, base = _side(spark, "q", q), _side(spark, "b", b)
    got = {r["query_key"]: (r["ref"], r["similarity"])
           for r in nearest_neighbours(queries, base, floor, SMALL).collect()}
    assert got == _brute(q, b, floor)


@pytest.mark.parametrize("kind", ["clustered", "sparse", "far"])
def test_closest_pair_equals_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind) + 3)
    if kind == "sparse":
        both = (rng.random((200, 300)) < 0.06) * rng.random((200, 300))
        both[7] = both[150] + 0.02 * both[9]
    else:
        both = _clusters(rng, 200, 12) if kind == "clustered" else rng.normal(size=(200, 24))
    q, b = _unit(both[:50]), _unit(both[50:])
    if kind == "far":  # no pair is alike, and the best is below zero
        q, b = _unit(np.abs(q)), -_unit(np.abs(b))
    none = np.zeros((200, 0))
    left, right = (_side(spark, "q", none[:50], q), _side(spark, "b", none[:150], b)) if kind == "sparse" \
        else (_side(spark, "q", q), _side(spark, "b", b))
    sims = np.round(q @ b.T, 6)
    for plan in (SMALL,):
        got = closest_pair(left, right, plan).collect()
        assert {(r["query_key"], r["ref"], r["similarity"]) for r in got} == \
            {(f"q{i}", int(sims[i].argmax()), sims.max()) for i in range(50) if sims[i].max() == sims.max()}
    assert closest_pair(left, right.limit(0)).count() == 0 and closest_pair(left.limit(0), right).count() == 0


def test_highest_similarity_of_rows_without_content(spark):
    rows = [("train", "a", "words in train"), ("train", "a", None), ("test", "a", "others quite"), ("test", "b", "zzz")]
    pdf = pd.DataFrame(rows * 30, columns=["split", "label", "note"])
    pdf["note"] = [f"{n} {i}" if n and n != "zzz" else "" for i, n in enumerate(pdf["note"])]
    pdf["id"] = range(len(pdf))
    t = audit_table(spark.createDataFrame(pdf), id="id")
    coded = encode(t, "test", "id")
    best = closest_contents(coded).first()
    assert highest_similarity(coded) == best["similarity"] > 0
    train_only = EncodedTable(coded.encoding, coded.raw.where("held_rows = 0"))
    assert highest_similarity(train_only) is None
    blank = EncodedTable(coded.encoding, coded.raw.where("held_rows = 0 OR blocks = 0").withColumn("blocks", F.lit(0)))
    assert highest_similarity(blank) == 0.0


@pytest.mark.parametrize("dense", [False, True])
def test_prefix_index_equals_brute_force(spark, dense):
    """Counts of terms weighed by idf; every search by the index finds what all pairs show."""
    rng = np.random.default_rng(21)
    n, width, floor = 160, 400, 0.9
    tf = rng.poisson((rng.random((n, 1)) * 30) / np.arange(1, width + 1) ** 0.7)
    tf[:, 0] += 1
    tf[60:100] = tf[:40]
    tf[60:100, 100:110] += rng.integers(0, 2, (40, 10))  # near copies on the other side
    idf = np.log((1 + n) / (1 + (tf > 0).sum(axis=0))) + 1
    w = _unit(tf * idf) * (np.sqrt(0.5) if dense else 1)
    numbers = _unit(1 + 0.3 * rng.normal(size=(n, 4))) * np.sqrt(0.5) if dense else np.zeros((n, 0))
    full = np.hstack([numbers, w])

    def side(prefix, lo, hi):
        rows = [(f"{prefix}{i}", i, numbers[lo + i].tolist(), np.flatnonzero(tf[lo + i]).tolist(),
                 tf[lo + i][tf[lo + i] > 0].tolist(), float(np.sqrt(0.5)) if dense else 1.0) for i in range(hi - lo)]
        return spark.createDataFrame(rows, "key string, ref int, dense array<double>, terms array<int>, weights array<int>, scale double").repartition(3)

    q, b = side("q", 0, 60), side("b", 60, n)
    want = _brute(full[:60], full[60:], floor)
    assert len(want) > 30
    for share in (0.0, float("inf")):
        plan = BlockPlan(one_cell_rows=8, max_pivots=6, index_share=share)
        got = {r["query_key"]: (r["ref"], r["similarity"]) for r in nearest_neighbours(q, b, floor, plan, idf).collect()}
        assert got == want
    from holdfast.operators import prefixes

    assert prefixes.indexed_neighbours(q, b, 0.5 if dense else 1e-6, float("inf"), idf) is None or not dense
    assert prefixes.indexed_neighbours(q, b, floor, 0.0, idf) is None


def test_equal_similarities_go_to_the_smallest_ref(spark):
    b = _unit(np.vstack([np.ones((30, 4)), np.eye(4)]))
    q = _unit(np.ones((5, 4)) * 2)
    got = nearest_neighbours(_side(spark, "q", q), _side(spark, "b", b), 0.9, SMALL).collect()
    assert {r["ref"] for r in got} == {0} and len(got) == 5


def test_no_base_rows(spark):
    q = _side(spark, "q", _unit(np.ones((3, 4))))
    assert nearest_neighbours(q, q.limit(0), None).count() == 0


def test_leakage_does_not_depend_on_layout(spark):
    pdf = two_classes(50, 20)
    pdf["note"] = [f"sample {i % 60} of the {i % 7} th run" for i in range(len(pdf))]

    def twins(rows, plan):
        t = audit_table(spark.createDataFrame(rows).repartition(5), id="id")
        v = encode(t, "test", "id")
        return sorted((r["held_ref"], r["train_ref"], r["similarity"]) for r in nearest_train(v, 0.3, plan).collect())

    assert twins(pdf, None) == twins(pdf.sample(frac=1, random_state=1), SMALL)


# ------------------------------------------------------------------ encoding

def test_encoding_matches_a_plain_computation(spark):
    rng = np.random.default_rng(2)
    n = 70
    pdf = pd.DataFrame({
        "id": range(n), "split": ["train", "test"] * (n // 2), "label": "a",
        "x": rng.normal(size=n), "y": np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n)),
        "flag": rng.random(n) < 0.5, "empty": np.full(n, np.nan),
        "colour": rng.choice(["red", "green", None], n), "name": [f"item{i} no{i * i}" for i in range(n)]})
    t = audit_table(spark.createDataFrame(pdf), id="id")
    kinds = {r["column"]: r["kind"] for r in column_profile(t.df, t.features).collect()}
    assert kinds == {"x": "numeric", "y": "numeric", "flag": "numeric", "empty": "numeric",
                     "colour": "categorical", "name": "text"}
    coded = encode(t, "test", "id")

    num = pdf[["x", "y", "flag", "empty"]].astype(float)
    num = num.fillna(num.median()).fillna(0.0).to_numpy()
    sd = num.std(axis=0)
    sd[sd == 0] = 1
    num = (num - num.mean(axis=0)) / sd
    hot = pd.get_dummies(pdf["colour"].fillna("nan").astype(str), dtype=float).to_numpy()
    docs = []
    for text in pdf["name"]:
        grams = {}
        for w in text.lower().split():
            w = f" {w} "
            for k in (3, 4, 5):
                for i in range(len(w) - k + 1):
                    grams[w[i:i + k]] = grams.get(w[i:i + k], 0) + 1
        docs.append(grams)
    terms = sorted({g for d in docs for g in d})
    tf = np.array([[d.get(g, 0) for g in terms] for d in docs], float)
    w = tf * (np.log((1 + n) / (1 + (tf > 0).sum(axis=0))) + 1)
    full = np.hstack([_unit(num), _unit(hot), _unit(w)]) / np.sqrt(3)
    assert coded.encoding.width == full.shape[1]
    assert coded.encoding.description == "4 numeric, 1 categorical, 1 text"
    best = {r["held_ref"]: (r["train_ref"], r["similarity"]) for r in nearest_train(coded, None).collect()}
    sims = full @ full.T
    train = np.arange(0, n, 2)
    for i in range(1, n, 2):
        assert best[i][1] == pytest.approx(sims[i, train].max(), abs=2e-6)


def test_vectors_are_encoded_like_columns(spark):
    """Null, short, NaN and null-entry vectors; the same numbers as columns give the same twins."""
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(60, 18)), 3)
    x[:, 4] = 1.5
    x[rng.random(x.shape) < 0.05] = np.nan
    x[5, 10:] = np.nan
    x[7] = np.nan
    base = pd.DataFrame({"id": range(60), "split": ["train", "train", "test"] * 20, "label": "a"})
    cells = [[None if np.isnan(v) and j % 2 else float(v) for j, v in enumerate(r)] for r in x]
    cells[5], cells[7] = cells[5][:10], None
    wide = audit_table(spark.createDataFrame(pd.concat([base, pd.DataFrame(x, columns=[f"f{j}" for j in range(18)])], axis=1)), id="id")
    vector = audit_table(spark.createDataFrame(
        [(*r, c) for r, c in zip(base.itertuples(index=False, name=None), cells)],
        "id long, split string, label string, v array<double>"), id="id")
    one, two = encode(wide, "test", "id"), encode(vector, "test", "id")
    assert two.encoding.width == one.encoding.width == 18 and two.encoding.description == "1 vector"
    left, right = ({(r["train_ref"], r["held_ref"]): r["dense"] for r in c.vectors.collect()} for c in (one, two))
    assert left.keys() == right.keys()
    assert all(np.allclose(left[k], right[k], atol=1e-12) for k in left)


def test_vector_keys(spark):
    nan = float("nan")
    rows = spark.createDataFrame([([1.0, nan],), ([1.0, None],), ([1.0, 2.0],), ([1.0000000001, nan],), (None,)], "v array<double>")
    exact, rounded = ([r[0] for r in rows.select(f(rows, ["v"])).collect()] for f in (exact_key, fingerprint))
    assert exact[0] == exact[1] and len(set(exact)) == 4
    assert rounded[0] == rounded[1] == rounded[3] and len(set(rounded)) == 3


def test_thousands_separators_are_not_numbers(spark):
    df = spark.createDataFrame([(f" {i} ", f"1,{i:03d}") for i in range(60)], "a string, b string")
    assert {r["column"]: r["kind"] for r in column_profile(df, ["a", "b"]).collect()} == {"a": "numeric", "b": "text"}


def test_constant_and_missing_numbers(spark):
    df = spark.createDataFrame([(1.1, None)] * 7, "a double, b double")
    assert fit_numeric(df, ["a", "b"]) == [("a", 0.0, pytest.approx(1.1), 1.0), ("b", 0.0, 0.0, 1.0)]


@pytest.mark.parametrize("q", [0.0, 0.5, 0.995, 1.0])
def test_exact_quantiles(spark, q):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.lognormal(sigma=4, size=3001), "b": rng.integers(0, 3, 3001).astype(float),
                        "c": np.where(rng.random(3001) < 0.7, 5.0, rng.normal(size=3001))})
    got = exact_quantiles(spark.createDataFrame(pdf), list("abc"), q, few_values=50, accuracy=100)
    for c in "abc":
        assert got[c] == pytest.approx(np.quantile(pdf[c], q), rel=1e-12)


def test_quantiles_of_a_million_distinct_values(spark):
    """The bracket is never narrowed to few values (one round of a coarse sketch), and still only two return."""
    df = spark.range(1_000_003).select(((F.col("id") * 7919) % 1_000_003).cast("double").alias("a"), F.lit(2.5).alias("b"))
    got = exact_quantiles(df, ["a", "b"], 0.75, few_values=10_000_000)
    assert got == {"a": 750_001.5, "b": 2.5}
    assert exact_quantiles(df, ["a"], 0.5, few_values=10, accuracy=50)["a"] == 500_001.0


# ------------------------------------------------------------------ sources and sinks

def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('id,split,label,n,x,ok,word\n1,train,None,1,1.5,True,"a, ""b"""\n2,test,b,n/a,NaN,False,null\n'
                    "3,test,b, 7 ,2,True,c\n")
    t = load_csv(spark, str(path))
    kinds = dict(t.df.dtypes)
    assert (kinds["n"], kinds["x"], kinds["ok"], kinds["word"]) == ("bigint", "double", "boolean", "string")
    rows = {r["id"]: r for r in t.df.collect()}
    assert rows[1]["label"] is None and rows[1]["word"] == 'a, "b"'
    assert rows[2]["n"] is None and rows[2]["word"] is None and rows[3]["n"] == 7
    capped = load_csv(spark, str(path), max_rows=2)
    assert capped.df.count() == 2 and capped.warnings[0][0] == "row_cap"


def test_parquet_keeps_a_class_called_none(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    write_dataset(spark.createDataFrame([("train", "None"), ("test", "x")], "split string, label string"), path, "parquet")
    assert {r[0] for r in load_parquet(spark, path).keys("label").collect()} == {"None", "x"}


def test_row_positions_are_consecutive(spark):
    df = with_row_position(spark.range(1000).repartition(7))
    got = [r[0] for r in df.select("row_position").orderBy("row_position").collect()]
    assert got == list(range(1000))


def test_thresholds_are_clamped():
    assert [clamp_threshold(v) for v in (None, 0, 0.2, 0.7, 3)] == [0.95, 0.95, 0.5, 0.7, 1.0]


def test_manifest_report_and_datasets(spark, tmp_path):
    pdf = two_classes(40, 18).assign(batch=lambda d: d.index % 9, prediction=lambda d: d.label)
    write_dataset(spark.createDataFrame(pdf).coalesce(1), str(tmp_path / "rows"))
    entries = spark.createDataFrame(
        [("one", "rows", "One", "", "fail", "batch", " f0, f1 ", "0.81 0.82 0.815", "")],
        "id string, file string, name string, blurb string, expect string, group_col string, "
        "ignore_cols string, seed_scores string, split_scores string")
    write_manifest(entries, str(tmp_path / "manifest"))
    read = manifest(spark, str(tmp_path / "manifest"))
    assert manifest_entry(read, "one")["file"] == "rows" and manifest_entry(read, "two") is None
    report = audit_manifest(spark, read, str(tmp_path))["one"]
    results = report.results.collect()
    assert [r["key"] for r in results] == ["leakage", "baseline", "variance", "integrity"]
    assert report.verdict.first()["verdict"] == "fail"
    write_report(report, str(tmp_path / "out"))
    parts = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out" / "report")).collect()]
    assert sorted({p["part"] for p in parts}) == ["check", "dataset", "verdict", "warning"]
    overlap = spark.read.json(str(tmp_path / "out" / "tables" / "integrity" / "group_overlap"))
    assert overlap.count() == 9


def test_report_without_anything_to_judge(spark):
    t = audit_table(spark.createDataFrame(pd.DataFrame({"split": ["train"] * 3, "label": list("abc")})))
    v = audit(t).verdict.first()
    assert v["n_skip"] == 3 and v["verdict"] == "pass"


def test_rows_of_hot_contents_keep_their_twins(spark):
    from holdfast.operators.leakage import nearest_per_row

    text = ["the same words in most rows"] * 30 + [f"another row {i} of {i * i}" for i in range(30)]
    pdf = pd.DataFrame({"id": range(60), "split": ["train", "test"] * 30, "label": "a", "text": text})
    t = audit_table(spark.createDataFrame(pdf), id="id")
    twins = nearest_train(encode(t, "test", "id"), None)

    def rows(plan):
        return sorted(map(tuple, nearest_per_row(row_keys(t, "test", "id"), "test", twins, plan).collect()))

    salted = JoinPlan(broadcast_rows=2, hot_share=0.1)
    assert rows(salted) == rows(None) and len(rows(None)) == 30
    assert rows(None)[0] == (1, 0, 1.0)


@pytest.mark.parametrize("plan", [JoinPlan(), JoinPlan(broadcast_rows=0), JoinPlan(broadcast_bytes=10, hot_share=2.0)])
def test_lookup_whatever_the_strategy(spark, plan):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i}") for i in range(300)], "n int, k string")
    found = spark.createDataFrame([("hot", 1), ("k1", 2), ("k298", 3), ("none", 4)], "k string, v int")
    got = lookup(rows, found, "k", plan)
    assert sorted(map(tuple, got.select("n", "v").collect())) == sorted(
        [(i, 1) for i in range(0, 300, 3)] + [(1, 2), (298, 3)])
    assert got.columns == ["k", "n", "v"]


def test_summary_of_a_hundred_thousand_splits(spark):
    from holdfast.operators.summary import dataset_summary

    df = spark.range(200_000).select(
        F.when(F.col("id") < 70_000, "train").otherwise(F.concat(F.lit("s"), F.col("id") % 100_000)).alias("split"), F.lit("a").alias("label"))
    r = dataset_summary(audit_table(df)).first()
    assert r["n_rows"] == 200_000 and len(r["splits"]) == 1000 and r["splits"]["train"] == 70_000
    assert r["other_splits"] == 100_001 - 1000 and r["other_rows"] == 200_000 - sum(r["splits"].values())


def test_projection_matches_numpy(spark):
    from holdfast.operators.prepare import pca_projection

    x = np.random.default_rng(8).normal(size=(120, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5])
    out, kept = pca_projection(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>"), "v", k=3)
    z = x - x.mean(axis=0)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    got = np.array([list(r)[1:] for r in out.orderBy("id").collect()])
    for j in range(3):
        assert min(np.abs(got[:, j] - z @ v[j]).max(), np.abs(got[:, j] + z @ v[j]).max()) < 6e-5
    assert kept == pytest.approx((s[:3] ** 2).sum() / (s ** 2).sum())


def test_skewed_keys_give_the_same_counts(spark):
    """A third of the rows share one id, one group and one content."""
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"),
        F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"),
        F.lit("a").alias("label"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("group"),
        F.when(F.col("id") % 3 == 0, "same text in all").otherwise(F.concat(F.lit("row "), F.col("id"))).alias("text"))
    t = audit_table(df)
    from holdfast.operators.duplicates import exact_duplicates
    from holdfast.operators.integrity import duplicate_ids, group_overlap

    assert duplicate_ids(t).first().asDict() == {"duplicate_ids": 999, "cross_split_ids": 1}
    assert exact_duplicates(t, "test").first()["exact_in_train"] == 500
    assert [tuple(r) for r in group_overlap(t, "test").collect()] == [("0", 500, 500)]


def test_white_space_missing_and_booleans(spark):
    rows = spark.createDataFrame(
        [("train\t", True, "same words", float("nan")), ("test\n", True, "same words　\n", None), ("test", False, "others", 1.0)],
        "split string, label boolean, text string, x double")
    splits = [r[0] for r in rows.select(split_name(rows, "split")).collect()]
    assert splits == ["train", "test", "test"]
    assert [r[0] for r in rows.select(key_text(rows, "label")).collect()] == ["True", "True", "False"]
    keys = [r[0] for r in rows.select(fingerprint(rows, ["text", "x"])).collect()]
    assert keys[0] == keys[1] != keys[2]
    exact = [r[0] for r in rows.select(exact_key(rows, ["x"])).collect()]
    assert exact[0] == exact[1] != exact[2]
