"""Artifacts on disk: partitioned tables, readable exports and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def save_table(df: DataFrame, folder: str, by: tuple[str, ...] = ("project",)) -> None:
    """Parquet, one folder for each value of ``by``; rows of a value stay together, hot values in several files."""
    df.write.mode("overwrite").option("maxRecordsPerFile", 2_000_000).partitionBy(*by).parquet(folder)


def export_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header; nested columns become JSON text."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(folder)


def preview(df: DataFrame, order: list[str], rows: int, width: int = 200) -> DataFrame:
    """The first ``rows`` rows in a stable order, long texts cut with a flag beside them."""
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    cut = {f"{c}_cut": F.coalesce(F.length(c) > width, F.lit(False)) for c in texts}
    return df.orderBy(*order).limit(rows).withColumns(cut).withColumns({c: F.left(c, F.lit(width)) for c in texts})


def save_report(df: DataFrame, folder: str) -> None:
    """One JSON object per row, columns in the order of their names."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(folder)
