"""Exact quantiles without sorting a column in one task.

A sketch brackets the wanted rank, counts check the bracket, and the bracket is
narrowed until few distinct values are left. Those are ranked in ranges, however many they are,
and only the values at the wanted ranks return.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.storage import written

SKETCH_ACCURACY = 10_000
FEW_VALUES = 50_000


def exact_quantiles(df: DataFrame, columns: list[str], q: float,
                    few_values: int = FEW_VALUES, accuracy: int = SKETCH_ACCURACY) -> dict[str, float | None]:
    """Per double column its linearly interpolated quantile over non-null values.

    Each round is one aggregate over all columns still open.
    """
    counts = df.agg(*[F.count(f"`{c}`").alias(str(i)) for i, c in enumerate(columns)]).first()
    out: dict[str, float | None] = {c: None for i, c in enumerate(columns) if not counts[i]}
    # column -> (rank of the lower neighbour, fraction, bracket)
    state = {}
    for i, c in enumerate(columns):
        if counts[i]:
            place = q * (counts[i] - 1)
            state[c] = (math.floor(place), place - math.floor(place), (-math.inf, math.inf))

    open_columns = list(state)
    while open_columns:
        probes = []
        for i, c in enumerate(open_columns):
            lo, hi = state[c][2]
            v = F.col(f"`{c}`")
            inside = F.when(v.between(lo, hi), v)
            probes += [F.count_if(v < lo).alias(f"below{i}"), F.count(inside).alias(f"in{i}"),
                       F.approx_count_distinct(inside).alias(f"d{i}")]
        seen = df.agg(*probes).first()
        wide = [(i, c) for i, c in enumerate(open_columns) if seen[f"d{i}"] > few_values]
        if not wide:
            break
        cuts = df.agg(*[
            F.percentile_approx(
                F.when(F.col(f"`{c}`").between(*state[c][2]), F.col(f"`{c}`")),
                [max(0.0, (state[c][0] - seen[f"below{i}"]) / seen[f"in{i}"] - 3 / accuracy),
                 min(1.0, (state[c][0] + 2 - seen[f"below{i}"]) / seen[f"in{i}"] + 3 / accuracy)],
                accuracy,
            ).alias(str(i))
            for i, c in wide
        ]).first()
        held = df.agg(*[
            x for i, c in wide for x in (
                F.count_if(F.col(f"`{c}`") < cuts[str(i)][0]).alias(f"below{i}"),
                F.count_if(F.col(f"`{c}`") <= cuts[str(i)][1]).alias(f"upto{i}"))
        ]).first()
        open_columns = []
        for i, c in wide:
            rank, fraction, bracket = state[c]
            narrower = tuple(cuts[str(i)])
            sure = held[f"below{i}"] <= rank and held[f"upto{i}"] > rank + (fraction > 0)
            if sure and narrower != bracket:
                state[c] = (rank, fraction, narrower)
                open_columns.append(c)

    if state:
        out |= _selected(df, state)
    return out


def _selected(df: DataFrame, state: dict[str, tuple[int, float, tuple[float, float]]]) -> dict[str, float]:
    """The values at the wanted ranks, for columns of any number of distinct values.

    The distinct values within the brackets are counted, cut into ranges by (column, value) and counted
    again per part; running sums over parts, then within the parts that hold a wanted rank, find the rows. Two values per column
    come back.
    """
    columns = list(state)
    cells = F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(F.col(f"`{c}`").between(*state[c][2]), F.col(f"`{c}`")).alias("v"))
        for i, c in enumerate(columns)]))
    below = df.agg(*[F.count_if(F.col(f"`{c}`") < state[c][2][0]).alias(str(i)) for i, c in enumerate(columns)]).first()
    counted = df.select(cells).where("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("n"))
    ranged = written(counted.repartitionByRange("i", "v").sortWithinPartitions("i", "v")
                     .withColumn("part", F.spark_partition_id()), "value-counts")
    ahead = Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("i", "part").agg(F.sum("n").alias("in_part")) \
        .withColumn("before", F.coalesce(F.sum("in_part").over(ahead), F.lit(0)))  # one row per column and part
    wanted = df.sparkSession.createDataFrame(
        [(i, rank + step - below[str(i)], step) for i, c in enumerate(columns)
         for rank, fraction, _ in [state[c]] for step in ((0, 1) if fraction else (0,))],
        "i int, place long, step int")
    # at most two rows per column on either side of these joins
    hit = wanted.join(parts, "i").where("place >= before AND place < before + in_part").select("i", "part", "place", "step", "before")
    upto = Window.partitionBy("i", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.join(F.broadcast(hit.select("i", "part", "before").distinct()), ["i", "part"]) \
        .withColumn("after", F.col("before") + F.sum("n").over(upto))
    rows = inside.join(F.broadcast(hit.select("i", "part", "place", "step")), ["i", "part"]) \
        .where("place < after AND place >= after - n").select("i", "step", "v").collect()
    at = {(r["i"], r["step"]): r["v"] for r in rows}
    return {c: at[i, 0] + state[c][1] * (at[i, 1] - at[i, 0]) if state[c][1] else at[i, 0] for i, c in enumerate(columns)}
