"""Sinks: CSV, Parquet, feature statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per task."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet table, optionally partitioned."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """One-row feature statistics as JSON."""
    stats.write.mode("overwrite").json(path)
