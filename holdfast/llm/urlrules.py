"""URL rules by a sort-merge range join (operator 4, DataFrame functions only).

The canonical key of a URL puts the labels of its host in reverse, then the path. A rule fits its host and
all subdomains, so a URL gets one key for each suffix of its host; the rules that fit are then
exactly those whose key is a prefix, and a prefix is an interval of sorted keys. Keys and rules
are sorted together by range partition and swept once. A rule carries the stack of rules that are open where it starts
(intervals of prefixes nest), so the last rule before a key is all the sweep has to hold: the rules still
open are those of its stack that are a prefix of the key. What was open at the start of a partition comes
from the partitions before it. Of all suffixes the longest rule wins, on ties the longer host.

Equal host and path are judged once. Null URLs and those without ``://`` have an empty host and
path and fit no rule; no rule fits without a match of its whole path. Of rules stated twice ``block`` counts. An
empty rule table leaves the default verdict. Keys of any length are compared whole. The result has the
id, host, path, rule and verdict; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\x00"  # behind the host, so that no host is a prefix of another


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def canonical(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(END), path)


def nested(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) as key and stack: the rules whose key is a prefix, outermost first, itself last."""
    own = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")) \
        .withColumn("key", canonical(F.col("host"), F.col("path")))
    entry = own.select(F.col("key").alias("open_key"), F.struct(
        F.length("key").alias("n"), "key", F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_n"), "verdict").alias("entry"))
    heads = own.select("key", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("open_key"))
    return heads.join(entry, "open_key").groupBy("key").agg(F.array_sort(F.collect_list("entry")).alias("stack"))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow",
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: the id, host, path, rule (null without one) and verdict."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    pages = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    # One key per suffix of the host.
    keys = pages.where("host <> ''").groupBy("host", "path").agg(F.lit(1).alias("_")) \
        .select("host", "path", F.explode(suffix).alias("end")) \
        .select("host", "path", canonical(F.col("end"), F.col("path")).alias("key"), F.lit(None).alias("stack"))
    stacks = nested(rules)
    events = stacks.select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key", "stack") \
        .unionByName(keys.withColumn("stack", F.col("stack").cast(stacks.schema["stack"].dataType)))
    dealt = events.repartitionByRange("key", "host", "path").withColumn("part", F.spark_partition_id())
    sweep = W.partitionBy("part").orderBy("key", F.col("host").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    swept = written(dealt.withColumn("last", F.last("stack", ignorenulls=True).over(sweep)), "swept")
    ends = swept.where("host is null").groupBy("part").agg(F.max_by("last", "key").alias("end"))
    parts = swept.groupBy("part").agg(F.count("*").alias("_")).join(ends, "part", "left")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    carried = parts.select("part", F.last("end", ignorenulls=True).over(before).alias("carried"))
    open_there = F.filter(F.coalesce("last", "carried"), lambda e: F.startswith(F.col("key"), e["key"]))
    inner = F.element_at(open_there, -1)
    found = swept.where("host is not null").join(carried, "part").where(F.size(open_there) > 0) \
        .select("host", "path", inner.alias("e")) \
        .groupBy("host", "path").agg(F.max(F.struct(F.length("e.rule").alias("n"), "e.host_n", "e.rule", "e.verdict")).alias("best"))
    return pages.join(found, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
