"""Where reports, prepared datasets and manifests go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def write_report(report, folder: str, mode: str = "errorifexists") -> None:
    """The report as one JSON document per row, and each detail table beside it."""
    report.document().write.mode(mode).text(f"{folder}/report")
    for (check, name), table in report.tables.items():
        table.write.mode(mode).json(f"{folder}/tables/{check}/{name}")


def write_dataset(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Every CSV field is quoted, so that blanks at its ends, quotes and line breaks come back as they are."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(header=True, escape='"', quoteAll=True, emptyValue="",
                       ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        writer.format(fmt).save(path)


def write_manifest(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per dataset; null fields are kept out by the JSON writer, so blank them."""
    entries.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in entries.columns]) \
        .write.mode(mode).json(path)
