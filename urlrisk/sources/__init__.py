"""Readers and writers. Schemas are always explicit."""

from urlrisk.sources.readers import (
    read_batch,
    read_hop_log,
    read_labeled_csv,
    read_labeled_tsv,
    read_pages,
    read_requests,
    read_stats,
    stream_parquet,
)
from urlrisk.sources.writers import write_csv, write_stats, write_table

__all__ = [
    "read_batch", "read_hop_log", "read_labeled_csv", "read_labeled_tsv", "read_pages", "read_requests",
    "read_stats", "stream_parquet", "write_csv", "write_stats", "write_table",
]
