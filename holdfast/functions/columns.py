"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import fixed


def _whole_number_text(c: Column) -> Column:
    """Text of a double, without the ``.0`` when it is a whole number."""
    whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def _plain_text(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), _whole_number_text(c.cast("double")))
    return c.cast("string")


def key_text(df: DataFrame, name: str) -> Column:
    """A label, prediction, group or id as a comparable key.

    A missing value is a key of its own, and ``1`` equals ``1.0``.
    """
    return F.coalesce(_plain_text(df, name), F.lit(fixed.MISSING_TEXT))


def split_name(df: DataFrame, name: str) -> Column:
    """The normalised split: known spellings fold to train, val or test; unknown
    values stay as their own split; a missing value is ``unlabelled``."""
    text = F.lower(F.trim(_plain_text(df, name), F.lit(fixed.WHITE_SPACE)))
    folded = reduce(
        lambda tail, item: F.when(text.isin(item[1]), F.lit(item[0])).otherwise(tail),
        reversed(fixed.SPLIT_SPELLINGS.items()),
        text,
    )
    return F.coalesce(folded, F.lit(fixed.UNLABELLED))


def parsed_number_sql(df: DataFrame, name: str) -> str:
    """The value as a double, or null where it does not read as a number.

    Spelled as SQL text: tables have hundreds of such columns, and one expression per
    column keeps building the plan quick.
    """
    c, kind = "`" + name.replace("`", "``") + "`", df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return f"CAST(CAST({c} AS INT) AS DOUBLE)"
    if isinstance(kind, T.StringType):
        return f"nullif(try_cast(trim({c}) AS DOUBLE), double('NaN'))"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return f"nullif(CAST({c} AS DOUBLE), double('NaN'))"
    return f"try_cast({c} AS DOUBLE)" if isinstance(kind, T.NumericType) else "CAST(NULL AS DOUBLE)"


def parsed_number(df: DataFrame, name: str) -> Column:
    return F.expr(parsed_number_sql(df, name))


def wilson_bounds(successes: Column, total: Column, z: float = fixed.WILSON_Z) -> tuple[Column, Column]:
    """Lower and upper Wilson score bound, clamped to [0, 1]; (0, 0) for no rows."""
    n = total.cast("double")
    share = successes / n
    z2 = z * z
    middle = share + z2 / (2 * n)
    spread = z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    low = F.greatest(F.lit(0.0), (middle - spread) / scale)
    high = F.least(F.lit(1.0), (middle + spread) / scale)
    empty = total == 0
    return F.when(empty, 0.0).otherwise(low), F.when(empty, 0.0).otherwise(high)


def scores_in_text(text: Column) -> Column:
    """All scores written in a log text, as an array of fractions.

    Numbers above 100 are run numbers, not scores; numbers above 1 are percentages.
    """
    numbers = F.transform(
        F.regexp_extract_all(text, F.lit(fixed.SCORE_PATTERN), F.lit(0)),
        lambda hit: hit.cast("double"),
    )
    kept = F.filter(numbers, lambda v: v <= 100)
    return F.transform(kept, lambda v: F.when(v > 1, v / 100).otherwise(v))


def best_class(scores: Column, classes: list[str]) -> Column:
    """The class whose score is highest; the first one on a tie."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))


def status_of(*rules: tuple[Column, str], otherwise: str = fixed.PASS) -> Column:
    """First matching rule wins."""
    return F.coalesce(*[F.when(cond, F.lit(s)) for cond, s in rules], F.lit(otherwise))


def percent(c: Column, decimals: int = 1) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{decimals}f%%", c * 100))


def points(c: Column, decimals: int = 1, signed: bool = True) -> Column:
    """Already in percentage points."""
    text = F.format_string(f"%{'+' if signed else ''}.{decimals}f pts", c.cast("double"))
    return F.when(c.isNotNull(), text)


def counted(c: Column) -> Column:
    return F.format_number(c, 0)


def joined_names(names: Column, total: Column, limit: int = fixed.NAMES_SHOWN) -> Column:
    """The first few names, with an ellipsis when there are more."""
    return F.concat(
        F.array_join(F.slice(names, 1, limit), ", "),
        F.when(total > limit, F.lit("...")).otherwise(F.lit("")),
    )
