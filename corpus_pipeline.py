"""A training corpus from raw documents: five stages, each over all that the one before it kept.

The stages take and give the columns of ``documents``; the last gives the packed pieces. Each one's
rows are written as Parquet and read again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.llm import dedup, disclosure, machine, packing, simhash
from holdfast.llm.queries import WORDS
from holdfast.llm.rows import read, text_of
from holdfast.storage import shared_folder, small_batches, written

LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject (operator 9)."""
    found = machine.scored(docs, read(spark, sf_dir, "labels"))
    return found.where(F.col("score") >= LEAST_SCORE).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 10)."""
    result = written(dedup.exact_duplicates(docs), "exact")
    stays = result.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    digest = F.sha2(dedup.normalised().cast("binary"), 256)
    same = (docs["doc_id"].eqNullSafe(F.col("_id"))) & (digest == F.col("_sha"))
    found = docs.join(stays, same, "left_semi")
    # Ids as a rule name one row each. Repeated rows of an id and text have one kept row between them; only then are texts ordered.
    if result.groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        return found
    order = W.partitionBy("doc_id", digest).orderBy(F.length(text_of("text")).desc(), "text")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest id (operator 6: three words, three bits).

    Rows without an id stay. An id is that of one document: where several rows still share one, they stay or go together.
    """
    small_batches(spark)
    found = simhash.near_duplicates(docs, words=3, radius=3)
    gone = written(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct(), "near-copies")
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms replaced by their kind (operator 2)."""
    found = disclosure.find(docs).where(F.size("spans") > 0)
    spans = written(found.dropDuplicates(["key"]).select(F.col("key").alias("_key"), "spans"), "spans")
    text = text_of("text")
    clean = disclosure.sanitised(text, F.col("spans"))
    changed = docs.join(spans, F.md5(text) == F.col("_key"), "left") \
        .withColumn("_clean", F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean))
    own = {"text": F.col("_clean"), "n_chars": F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("_clean"))}
    kinds = dict(docs.dtypes)
    return changed.select(*[own[c].cast(kinds[c]).alias(c) if c in own else F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens, one row per piece (operator 1)."""
    cut = packing.token_pieces(docs, WORDS, end_id=2)
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Fitting, links of fingerprints and packing are not SQL; tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/holdfast-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
