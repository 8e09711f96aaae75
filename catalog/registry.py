"""Registered queries: name -> callable, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.bindings import SQL

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, using: str = ""):
    """``using`` names the dataset expressions put in front of ``sql``."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            parts = [SQL[k] for k in using.split()]
            body = sql.strip()
            if parts and body.upper().startswith("WITH "):
                body = ", " + body[5:]
            ORACLES[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
        return fn
    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def named(df: DataFrame, dataset: str) -> DataFrame:
    return df.withColumn("dataset", F.lit(dataset))
