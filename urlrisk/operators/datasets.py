"""Dataset preparation: union, dedup, balanced and random samples, splits, statistics, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.plans.skew import row_ranks, running_totals


def hash_order(url: Column, seed: int = 42) -> Column:
    """Deterministic pseudo-random order of URLs."""
    return F.md5(F.concat(F.lit(f"{seed}:"), url))


def union_all(*parts: DataFrame) -> DataFrame:
    """Concatenation of labelled tables."""
    return reduce(DataFrame.unionByName, parts)


def balanced_sample(
    df: DataFrame, sample_size: int, groups: list[str], url: str = "url", seed: int = 42
) -> DataFrame:
    """At most ``sample_size // 2`` rows per group (split and class), in hash order. Runs a job.

    Ranks come from a range-partitioned running count, so a class holding most rows is spread out.
    """
    staged = df.withColumn("_order", hash_order(F.col(url), seed))
    ordered = row_ranks(staged, groups, [F.col("_order"), F.col(url)], "_rank")
    return ordered.where(F.col("_rank") <= sample_size // 2).drop("_order", "_rank")


def keep_first(df: DataFrame, order: list[str], url: str = "url") -> DataFrame:
    """First row per URL in ``order``: a min over structs, combined before the shuffle."""
    rest = [c for c in df.columns if c not in (*order, url)]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(url).agg(first).select(url, "_first.*").select(*df.columns)


def shuffled(df: DataFrame, url: str = "url", seed: int = 42) -> DataFrame:
    """All rows in deterministic pseudo-random order."""
    return df.orderBy(hash_order(F.col(url), seed), url)


def random_sample(
    df: DataFrame, size: int = 10, kind: str = "all", url: str = "url", seed: int = 42
) -> DataFrame:
    """``size`` rows of one class or of all, chosen by hash order.

    Places come from a range partitioning, so that a sample of any size is made by many tasks. Runs a job.
    """
    wanted = {"all": F.lit(True), "benign": F.col("result") == 0, "malicious": F.col("result") == 1}[kind]
    placed = row_ranks(df.where(wanted), [], [hash_order(F.col(url), seed), F.col(url)], "_place")
    return placed.where(F.col("_place") <= size).drop("_place")


def class_stats(df: DataFrame) -> DataFrame:
    """Total, per-class counts, ratio text and percentages, one row."""
    total = F.count(F.lit(1))
    benign, malicious = F.count_if(F.col("result") == 0), F.count_if(F.col("result") == 1)
    counted = df.agg(
        total.alias("total_urls"), benign.alias("benign_count"), malicious.alias("malicious_count")
    )
    share = 100.0 / F.greatest(F.col("total_urls"), F.lit(1))
    return counted.withColumns({
        "balance_ratio": F.concat_ws(
            "/", F.col("benign_count").cast("string"), F.col("malicious_count").cast("string")
        ),
        "benign_pct": F.col("benign_count") * share,
        "malicious_pct": F.col("malicious_count") * share,
    })


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """First n rows in a given order."""
    return df.orderBy(*order).limit(n)


def stratified_split(
    df: DataFrame, label: str = "result", url: str = "url", fractions: tuple[float, float] = (0.70, 0.15),
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` (train, val, test) with the same exact proportions per class. Runs a job.

    ``url`` must be unique. A class is ranked across partitions, so two classes use the whole cluster.
    """
    staged = df.withColumn("_order", hash_order(F.col(url), seed))
    ordered = row_ranks(staged, [label], [F.col("_order"), F.col(url)], "_rank")
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_size"))
    joined = ordered.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    train, val = fractions
    split = (
        F.when(F.col("_rank") <= F.floor(F.col("_size") * train), "train")
        .when(F.col("_rank") <= F.floor(F.col("_size") * (train + val)), "val")
        .otherwise("test")
    )
    return joined.withColumn("split", split).drop("_order", "_rank", "_label", "_size")


def distribution_profile(
    df: DataFrame, value: str, group: list[str], baseline: float = 100.0
) -> DataFrame:
    """Mean, median, population deviation, min, max, p95, p99 (interpolated), count, efficiency per group.

    Percentiles are exact and read off distributed ranks, so a group may be larger than any task; the
    distinct values are ranked with their counts, not one row per occurrence. Runs a job.
    """
    rows = df.where(F.col(value).isNotNull())
    weights = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    cumulative = running_totals(weights, group, [F.col(value)], F.col("_n"), "_upto")
    moments = rows.groupBy(*group).agg(
        F.avg(value).alias("avg_value"), F.stddev_pop(value).alias("std_value"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count(F.lit(1)).alias("samples"),
    )
    sizes = moments.select(*group, "samples")
    placed = cumulative.join(sizes, group)

    picks = []
    for name, q in {"median_value": 0.5, "p95_value": 0.95, "p99_value": 0.99}.items():
        spot = F.lit(q) * (F.col("samples") - 1)
        low, high = F.floor(spot) + 1, F.ceil(spot) + 1
        first = F.col("_upto") - F.col("_n") + 1
        at_low = F.max(F.when((first <= low) & (low <= F.col("_upto")), F.col(value)))
        at_high = F.max(F.when((first <= high) & (high <= F.col("_upto")), F.col(value)))
        weight = F.max(spot - F.floor(spot))
        picks.append((at_low + (at_high - at_low) * weight).alias(name))
    quantiles = placed.groupBy(*group).agg(*picks)
    efficiency = F.when(F.col("avg_value") <= 0, 100).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(100), (100.0 * baseline / F.col("avg_value")).cast("int")))
    )
    throughput = F.when(F.col("avg_value") > 0, 1000.0 / F.col("avg_value")).otherwise(0.0)
    return moments.join(quantiles, group).withColumns({"efficiency": efficiency, "throughput": throughput})
