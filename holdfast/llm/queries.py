"""The queries opN_: each operator over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import (
    dedup, disclosure, extraction, forest, infill, licences, machine, mixing, packing, pieces, simhash, spectrum, urlrules,
)
from holdfast.llm.rows import read, text_of
from holdfast.storage import spread

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in sequences of at most 4,096 tokens, one row per piece."""
    cut = packing.token_pieces(read(spark, sf, "documents"), WORDS, end_id=2)
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op2_disclosure(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    found = disclosure.find(read(spark, sf, "documents"))

    def many(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[many(k) for k in disclosure.PATTERNS],
                        F.sha2(disclosure.listed(F.col("base")), 256).alias("base_sha256"),
                        disclosure.listed(F.col("spans")).alias("spans"))


def op3_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract(read(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))


#: Fixed values: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every page's url."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlrules.judge(read(spark, sf, "pages"), rules)


OP4_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(h, p, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict
FROM parts LEFT JOIN LATERAL (
  SELECT h || p AS rule, v FROM rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1
) best ON true
"""


def op5_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text and what they decode to, as digests."""
    docs = spread(read(spark, sf, "documents").select("doc_id", text_of("text").alias("text")))
    encoded = docs.select("doc_id", pieces.encode(PIECES)("text").alias("ids"))
    decoded = encoded.withColumn("decoded", pieces.decode(PIECES)("ids"))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of three-word shingles and the component over links of up to three bits."""
    found = simhash.near_duplicates(read(spark, sf, "documents"), words=3, radius=3)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op7_licences(spark: SparkSession, sf: str) -> DataFrame:
    """Licence notices in all documents."""
    return licences.scan(read(spark, sf, "documents"))


def op8_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return forest.nearest(read(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document, learnt from the labels outside the held-out fifth."""
    docs = read(spark, sf, "documents").select("doc_id", "text", "n_chars")
    found = machine.scored(docs, read(spark, sf, "labels"))
    return found.select("row.doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the row that stays of its equal texts."""
    return dedup.exact_duplicates(read(spark, sf, "documents"))


def op11_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix of all sources takes of every document."""
    return mixing.mix(read(spark, sf, "documents")).taken()


# Positions in a source's stream say what a schedule that takes whole passes and one part of a pass must have taken.
OP11_SQL = r"""
WITH doc AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w
  FROM doc GROUP BY source
), level AS (  -- in order of words per weight: what is left when all sources before are held at 3 times their words
  SELECT *, CAST(sum(n) OVER () - 3 * coalesce(sum(n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    CAST(sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS share FROM src
), best AS (SELECT rest, share FROM level WHERE rest * w <= 3 * n * share ORDER BY n / w, source LIMIT 1
), goal AS (
  SELECT source, n, CASE WHEN w * rest > 3 * n * share THEN 3.0::DOUBLE * n ELSE CAST(w * rest AS DOUBLE) / share END AS target,
    CASE WHEN w * rest > 3 * n * share THEN 3 * n ELSE (2 * w * rest + share) // (2 * share) END AS goal
  FROM (SELECT source, n, w, b.rest, b.share FROM level, best b)
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM doc
)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE size * (goal // n) + greatest(0, least(size, goal % n - start)) END AS BIGINT) AS taken
FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source
"""


def op12_infill(spark: SparkSession, sf: str) -> DataFrame:
    """Every text cut and put in fill-in-middle order, as digests of the output and of the text rebuilt from it."""
    found = infill.transform(read(spark, sf, "documents"))
    again = infill.restore(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                        F.sha2(again.cast("binary"), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), draw AS (
  SELECT *, len(unit) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM doc
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draw
), part AS (
  SELECT doc_id, n, form, text, array_to_string(unit[1:a], '') AS p, array_to_string(unit[a + 1:b], '') AS m, array_to_string(unit[b + 1:], '') AS s FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM part
"""


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector on the four leading components, whitened."""
    return spectrum.whiten(read(spark, sf, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_disclosure": op2_disclosure,
    "op3_main_text": op3_main_text,
    "op4_url_rules": op4_url_rules,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_simhash": op6_simhash,
    "op7_licences": op7_licences,
    "op8_neighbours": op8_neighbours,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_mixing": op11_mixing,
    "op12_infill": op12_infill,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op4_url_rules": OP4_SQL, "op11_mixing": OP11_SQL, "op12_infill": OP12_SQL}
