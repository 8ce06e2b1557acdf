"""Sinks: sorted tables, snapshots, reports and metrics, written in full and read back from what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sorted(rows: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Writes rows as Parquet in the order of keys, from file to file and within each."""
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def write_snapshot(parts: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """A canonical snapshot: each part's different rows, sorted by all columns, in a folder of its own."""
    return {name: write_sorted(rows.distinct(), f"{folder}/{name}", rows.columns) for name, rows in parts.items()}


def write_reports(reports: DataFrame, folder: str, required: list[str], most_bytes: int = 64 << 10) -> DataFrame:
    """Writes reports as JSON lines. One without a required field, or longer than most_bytes, is left out."""
    whole = F.lit(True)
    for name in required:
        whole = whole & F.col(name).isNotNull()
    fits = F.octet_length(F.to_json(F.struct(*reports.columns))) <= most_bytes
    reports.filter(whole & fits).write.mode("overwrite").json(folder)
    return reports.sparkSession.read.schema(reports.schema).json(folder)
