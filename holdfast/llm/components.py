"""Connected components of a link table by alternating large and small stars.

Every round moves each link towards the smallest node near it; all steps are joins and
aggregates on narrow rows, and a round's links are written to the shared folder, so neither the
driver nor a task holds a component. A node with very many links meets only the minimum of its
neighbours, which is pre-aggregated; the join that brings it back is one AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.storage import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: pairs (a, b) with a > b. Large: larger neighbours move to the minimum; small: the rest."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    both = near.join(least, "a")
    if large:
        moved = both.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = both.select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): for every linked node, the smallest node it is connected with. Null nodes have no links."""
    a, b = F.col(left), F.col(right)
    now = written(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    mark = now.agg(F.count("*"), total).first()
    while mark[0]:
        now = written(_star(_star(now, True), False), "links")
        before, mark = mark, now.agg(F.count("*"), total).first()
        if before == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
