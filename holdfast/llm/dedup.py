"""Exact deduplication with streaming state (operator 10).

The texts' keys (digest of the text without white space, length, id) are written once, with
the locator of each row: input part and place in it. A stream reads that table in triggers and folds it into
state keyed by digest, kept in RocksDB on local disk with its change log in the shared folder and never expired: a digest holds the
row that stays (most code points, then smallest id), its locator, and how many rows came. A row whose
digest is known is a hit. Hits are checked on full bytes: of every digest that came more than
once the least and the greatest normalised text must be the same. Where they are not,
equal digests are told apart by the text itself.

Ids are whole numbers. Null texts count as empty, and empty or blank texts are equal to each other. Ties go to the smallest id;
rows with equal ids and texts are rows of their group each. Texts are hashed and compared whole.
Only id and text are read, so other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.rows import BLANKS, text_of
from holdfast.storage import shared_folder, spread

#: For one stream: state on disk, with as much memory for all of an executor's stores as is given here.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: no disk is set aside for their logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: str = "text"):
    return F.translate(text_of(text), BLANKS, "")


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    # The place in the written table, part and number of row, is what finds a row's content again.
    return rows.select("doc_id", F.length("text").cast("long").alias("points"),
                       F.sha2(normalised().cast("binary"), 256).alias("digest"))


def fold(keys: DataFrame, path: str, files_per_trigger: int) -> DataFrame:
    """State after all rows of the table in ``path``: digest, kept (points, id, file, row), n."""
    spark = keys.sparkSession.newSession()
    for k, v in STATE.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    best = F.struct("points", (-F.col("doc_id")).alias("minus_id"), "doc_id",
                    F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    state = stream.select("digest", best.alias("best")).groupBy("digest").agg(
        F.max("best").alias("kept"), F.count("*").alias("n"))
    changes = f"{path}-state"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    # Without rows there is no trigger; the table of changes is there all the same.
    keys.sparkSession.createDataFrame([], state.schema).write.parquet(f"{changes}/batch=-1")
    query = state.writeStream.outputMode("update").option("checkpointLocation", f"{path}-progress") \
        .trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    schema = state.schema.add("batch", "integer")
    told = keys.sparkSession.read.schema(schema).parquet(changes)
    # A digest is told again in every trigger that changes it; the last word counts.
    return told.groupBy("digest").agg(F.max_by(F.struct("kept", "n"), "batch").alias("last")) \
        .select("digest", "last.kept", "last.n")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     files_per_trigger: int = 256) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/holdfast-keys-{uuid.uuid4().hex}"
    docs = spread(docs)
    keys = _keys(docs, id_col, text_col)
    keys.write.parquet(path)
    keys = spark.read.schema(keys.schema).parquet(path)
    state = fold(keys, path, files_per_trigger)
    odd = collisions(docs, state, text_col)
    place = keys.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    plain = place.join(state, "digest").select(
        "doc_id", F.col("kept.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("file") == F.col("kept.file")) & (F.col("row") == F.col("kept.row"))).alias("kept"),
        F.col("digest").alias("text_sha256"))
    if odd.isEmpty():
        return plain
    return plain.join(odd, plain["text_sha256"] == odd["digest"], "left_anti") \
        .unionByName(_by_text(docs, odd, id_col, text_col))


def collisions(docs: DataFrame, state: DataFrame, text_col: str = "text") -> DataFrame:
    """Digests that came more than once with texts whose full bytes differ."""
    text = docs.select(F.sha2(normalised(text_col).cast("binary"), 256).alias("digest"), normalised(text_col).alias("t"))
    hits = state.where("n > 1").select("digest")
    return text.join(hits, "digest", "left_semi").groupBy("digest").agg(
        F.min("t").alias("least"), F.max("t").alias("most")).where("least <> most").select("digest")


def _by_text(docs: DataFrame, odd: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of the given digests, grouped by the normalised text itself."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text_of(text_col)).cast("long").alias("points"),
                       normalised(text_col).alias("t"), F.sha2(normalised(text_col).cast("binary"), 256).alias("digest")) \
        .join(odd, "digest", "left_semi")
    best = F.max(F.struct("points", (-F.col("doc_id")).alias("minus_id"), "doc_id")).alias("best")
    groups = rows.groupBy("t").agg(best, F.count("*").alias("group_size"))
    return rows.join(groups, "t").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("doc_id") == F.col("best.doc_id")).alias("kept"), F.col("digest").alias("text_sha256"))
