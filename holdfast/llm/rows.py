"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.shipping import ship
from holdfast.storage import small_batches

#: White space of the contracts: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(name: str) -> Column:
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def wide(spark: SparkSession) -> int:
    """Partitions for a shuffle whose tasks are long and whose input is one small file."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def scalar(fn: Callable[[Iterator[pa.Array]], Iterator[pa.Array]], kind: str) -> Callable:
    """An Arrow function of one column that keeps state from batch to batch."""
    fn.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(fn, kind)


def slices(batch: pa.Array, chars: int = 4_000_000) -> Iterator[list[str]]:
    """The texts of a batch in order, in lists of about so many characters."""
    held, size = [], 0
    for value in batch:
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


class Recent:
    """What was worked out for recent keys, in two generations of at most ``limit`` entries each."""

    def __init__(self, limit: int = 50_000):
        self.limit, self.now, self.old = limit, {}, {}

    def missing(self, keys: set) -> list:
        """Keys to work out; ``now`` then holds all others. Those of the older generation are carried over."""
        if len(self.now) + len(keys) > self.limit:
            self.now, self.old = {}, self.now
        new = keys.difference(self.now)
        known = new.intersection(self.old)
        for key in known:
            self.now[key] = self.old[key]
        return list(new - known)
