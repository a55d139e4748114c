"""Plan-level building blocks (lineage cuts, skew-safe joins, prefix sums) and the end-to-end scans."""
