"""What a loader must not drop: unknown split names, quoted line breaks, fields too many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import audit_table
from holdfast.operators.summary import warnings_of
from holdfast.sources import load_csv, with_file_position
from holdfast.table import DatasetError


def test_every_unknown_split_is_named(spark):
    names = [f"odd{i:02d}" for i in range(60)]
    pdf = pd.DataFrame({"id": range(62), "split": ["train", "test", *names], "label": "a", "f0": 1.0})
    said = [r.message for r in warnings_of(audit_table(spark.createDataFrame(pdf))).collect() if r.code == "unknown_splits"]
    assert len(said) == 60 and all(any(n in m for m in said) for n in names)


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('id,split,label,note\n1,train,a,"one\ntwo"\n2,test,b,plain\n')
    rows = {r["id"]: r["note"] for r in load_csv(spark, str(path)).df.collect()}
    assert rows == {1: "one\ntwo", 2: "plain"}


def _csv_text(rows: int, rng) -> tuple[str, list]:
    """Records with line breaks, quotes, commas and blank lines, and what they must read as."""
    cells = ["plain", "a, b", 'say ""hi""', "one\ntwo", "\n\n", "tab\there", "x\r\ny", "z" * 300, "ends with quote \"\""]
    text, want = "id,split,note,more\r\n\n", []
    for i in range(rows):
        a, b = (cells[k] for k in rng.integers(0, len(cells), 2))
        text += f'{i},{"test" if i % 3 else "train"},"{a}","{b}"\r\n' + ("  \n" if i % 7 == 0 else "")
        want.append((i, a.replace('""', '"'), b.replace('""', '"')))
    return text, want


def test_one_file_is_many_tasks(spark, tmp_path):
    """Byte ranges of 2 KB cut through quoted fields everywhere; nothing is lost, and file order is kept."""
    rng = np.random.default_rng(5)
    text, want = _csv_text(400, rng)
    for name, part in (("b.csv", text), ("a.csv", "id,split,note,more\n-1,train,first,\"" + "long\n" * 2000 + "\"\n")):
        (tmp_path / name).write_bytes(part.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(tmp_path / "b.csv"), lineSep="\n").rdd.getNumPartitions() > 8
        t = load_csv(spark, str(tmp_path), label="more")
        got = t.df.orderBy(t.position).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r[t.position] for r in got] == list(range(401)) and t.features == ("note",) and t.id == "id"
    assert [(r.id, r.note, r.more) for r in got] == [(-1, "first", "long\n" * 2000), *want]


def test_open_quotes_and_other_headers_are_errors(spark, tmp_path):
    (tmp_path / "d.csv").write_text('id,split,label\n1,train,"never closed\n2,test,b\n')
    with pytest.raises(DatasetError, match="never closed"):
        load_csv(spark, str(tmp_path / "d.csv"))
    (tmp_path / "d.csv").write_text("id,split,label\n1,train,a\n")
    (tmp_path / "e.csv").write_text("id,label,split\n1,a,train\n")
    with pytest.raises(DatasetError, match="different headers"):
        load_csv(spark, str(tmp_path))
    (tmp_path / "e.csv").write_text("\n \n")
    with pytest.raises(DatasetError, match="no rows"):
        load_csv(spark, str(tmp_path / "e.csv"))


def test_a_schema_changes_the_types_alone(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('id,split,label,n,n\n1,train,None,n/a, 7\n2,test,"null",3,x\n3,test,"",4\n')
    schema = "key int, part string, label string, n double, m int"
    t = load_csv(spark, str(path), schema=T.StructType.fromDDL(schema), split="part")
    assert [tuple(r)[:5] for r in t.df.orderBy(t.position).collect()] == [
        (1, "train", None, None, 7), (2, "test", None, 3.0, None), (3, "test", None, 4.0, None)]
    assert load_csv(spark, str(path)).df.columns[3:5] == ["n3", "n4"]
    with pytest.raises(DatasetError, match="schema has 1"):
        load_csv(spark, str(path), schema=T.StructType.fromDDL("id int"))


def test_positions_follow_the_files(spark, tmp_path):
    """The largest file is read first by Spark; its rows come last all the same."""
    for name, lo, hi in (("a", 0, 10), ("b", 10, 12), ("c", 12, 60_000)):
        spark.range(lo, hi, numPartitions=1).withColumn("x", F.rand()).write.parquet(str(tmp_path / name))
    df = spark.read.parquet(*[str(tmp_path / n) for n in "cab"])
    rows = with_file_position(df)
    assert rows.where("id <> row_position").count() == 0 and rows.count() == 60_000
    again = with_file_position(df.repartition(5))  # no file order left: any numbering, without gaps
    assert again.agg(F.count_distinct("row_position"), F.max("row_position")).first()[:] == (60_000, 59_999)


@pytest.mark.parametrize("schema", [None, "id long, split string, label string, note string"])
def test_a_field_too_many_is_an_error(spark, tmp_path, schema):
    path = tmp_path / "d.csv"
    path.write_text("id,split,label,note\n1,train,a,x\n2,test,b,y,lost\n3,test,b\n")
    with pytest.raises(DatasetError, match="more fields"):
        load_csv(spark, str(path), schema=schema and T.StructType.fromDDL(schema))
