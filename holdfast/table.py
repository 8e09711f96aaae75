"""The audited table: a DataFrame plus the roles its columns play."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions.columns import key_text, split_name


class DatasetError(ValueError):
    """The input cannot be audited at all."""


@dataclass(frozen=True)
class AuditTable:
    """Rows to audit. ``df`` keeps its own columns; only the split is normalised."""

    df: DataFrame
    split: str
    label: str
    id: str | None = None
    prediction: str | None = None
    group: str | None = None
    features: tuple[str, ...] = ()
    position: str | None = None     # column with the row's place in its files, if the scan knows it
    warnings: tuple[tuple[str, str], ...] = field(default=())

    ROLES = ("split", "label", "id", "prediction", "group")

    def keys(self, *roles: str) -> DataFrame:
        """The asked roles as text keys under their role names, and no other column."""
        return self.df.select(*[self.key(r).alias(r) for r in roles])

    def key(self, role: str) -> Column:
        name = getattr(self, role)
        if name is None:
            raise DatasetError(f"this table has no {role} column")
        return F.col(f"`{name}`") if role == "split" else key_text(self.df, name)

    def rows_of(self, split: str) -> DataFrame:
        return self.df.where(F.col(f"`{self.split}`") == split)

    def with_df(self, df: DataFrame) -> "AuditTable":
        return replace(self, df=df)

    @property
    def holdout(self) -> str | None:
        """The split whose score gets quoted: test, else val, else the first other one.

        Reads one aggregated row. Rows without a split are never the hold-out.
        """
        from holdfast.operators.summary import holdout_choice

        return holdout_choice(self).first()["holdout"]


def _by_lower(columns: list[str]) -> dict[str, str]:
    return {c.strip().lower(): c for c in columns}


def named_column(columns: list[str], name: str | None) -> str | None:
    """A column the user named, whatever its case or padding."""
    return _by_lower(columns).get(name.strip().lower()) if name and name.strip() else None


def role_column(columns: list[str], role: str) -> str | None:
    present = _by_lower(columns)
    return next((present[a] for a in fixed.ROLE_ALIASES[role] if a in present), None)


def ignore_list(text: str | None) -> list[str]:
    """Column names from comma-separated text."""
    return [p.strip() for p in (text or "").split(",") if p.strip()]


def clamp_threshold(value: float | None) -> float:
    """0 or nothing means the default; anything else is held to the allowed range."""
    wanted = value or fixed.DEFAULT_SIMILARITY
    return min(max(wanted, fixed.LOWEST_SIMILARITY), fixed.HIGHEST_SIMILARITY)


def audit_table(
    df: DataFrame,
    *,
    split: str | None = None,
    label: str | None = None,
    id: str | None = None,
    prediction: str | None = None,
    group: str | None = None,
    ignore: list[str] | str | None = None,
    position: str | None = None,
    detect: bool = True,
    check_empty: bool = True,
) -> AuditTable:
    """Find the roles from the column names (metadata only) and normalise the split.

    Named columns win over detection; ``detect=False`` uses the named ones alone.
    """
    columns = [c for c in df.columns if c != position]
    asked = {"split": split, "label": label, "id": id, "prediction": prediction, "group": group}
    warnings: list[tuple[str, str]] = []
    found: dict[str, str | None] = {}
    for role, name in asked.items():
        found[role] = named_column(columns, name)
        if found[role] is None and (detect or name):
            found[role] = role_column(columns, role) if detect else None
            if name and role in ("split", "label"):
                raise DatasetError(f"the {role} column {name!r} does not exist")
            if name:
                warnings.append((
                    f"{role}_fallback",
                    f"There is no column {name!r} for the {role} role; detection was used instead.",
                ))

    for role in ("split", "label"):
        if found[role] is None:
            raise DatasetError(
                f"no {role} column; name one of: " + ", ".join(fixed.ROLE_ALIASES[role])
            )
    if check_empty and df.isEmpty():
        raise DatasetError("the table has no rows")

    wanted = ignore_list(ignore) if isinstance(ignore, str) else list(ignore or [])
    ignored = [c for c in (named_column(columns, n) for n in wanted) if c]
    reserved = {c for c in found.values() if c} | set(ignored)
    features = tuple(c for c in columns if c not in reserved)

    if ignored:
        warnings.append(("ignored", "Left out of the features: " + ", ".join(sorted(set(ignored))) + "."))
    gaps = {
        "group": "No group column: entities that straddle the split cannot be looked for.",
        "id": "No id column: row positions stand in for ids, and repeated ids cannot be looked for.",
        "prediction": "No prediction column: only the majority-class bar can be reported.",
    }
    warnings += [(f"no_{role}", text) for role, text in gaps.items() if found[role] is None]
    if not features:
        warnings.append(("no_features", "No feature columns: rows cannot be compared for leakage."))

    return AuditTable(
        df=df.withColumn(found["split"], split_name(df, found["split"])),
        features=features, position=position, warnings=tuple(warnings), **found,
    )
