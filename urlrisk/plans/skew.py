"""Joins and ordered sums that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlrisk.plans.lineage import cut

HOT_KEYS = 1000


def spread(scan: DataFrame) -> DataFrame:
    """Spread a file scan that has fewer splits than there are cores over all of them.

    URL scoring is bound by CPU, so a small file read as one split would keep the other cores idle. A
    scan with enough splits, as any large table has, is returned as it is and not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def lookup_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "left", split_hot: bool = False, hot_keys: int | None = None
) -> DataFrame:
    """Join ``left`` to ``right``, whose ``key`` is unique.

    By default a plain equi-join: adaptive execution broadcasts a right side it has measured as small
    and otherwise splits the oversized partitions of a hot key. ``split_hot`` also keeps hot rows out of
    the shuffle; use it where ``left`` is a table that is cheap to read more than once. The ``hot_keys``
    (default HOT_KEYS) most frequent keys are then found with a map-side-combined count and their right rows
    broadcast: at most that many rows whatever the data size. Every other key holds less than 1/``hot_keys``
    of the rows and goes through the shuffled join. Nothing is dropped; a null key matches nothing.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup_join supports left and inner")
    if not split_hot:
        return left.join(right, key, how)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.orderBy(F.desc("_n"), key).limit(HOT_KEYS if hot_keys is None else hot_keys).select(key, F.lit(True).alias("_hot"))
    hot_right = right.join(F.broadcast(hot.select(key)), key, "left_semi")
    marked = left.join(F.broadcast(hot), key, "left")
    is_hot = F.col("_hot").isNotNull() | F.col(key).isNull()
    hot_rows = marked.where(is_hot).drop("_hot").join(F.broadcast(hot_right), key, how)
    cold_rows = marked.where(~is_hot).drop("_hot").join(right, key, how)
    return hot_rows.unionByName(cold_rows)


def semi_lookup(
    left: DataFrame, keys: DataFrame, key: str, flag: str, split_hot: bool = False
) -> DataFrame:
    """Add the boolean ``flag``: whether ``left[key]`` occurs in ``keys``."""
    right = keys.select(key).distinct().withColumn(flag, F.lit(True))
    joined = lookup_join(left, right, key, split_hot=split_hot)
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def running_totals(
    df: DataFrame, group: list[str], order: list[Column], value: Column, total: str = "running",
) -> DataFrame:
    """Running sum of ``value`` per group in ``order`` (a total order), for groups of any size.

    Rows are range-partitioned on (group, order), so a large group spans many tasks. Each partition's
    sum per group gives the offset at which the next one starts; the offsets table holds at most
    (partitions + groups) rows. The partition layout is written out once, so that both passes see the
    same partitions even if a task is retried. Runs a job.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_v", value)
    ranged = keyed.repartitionByRange(parts, *[F.col(g) for g in group], *order)
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(*group, "_part").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if not group:
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    local = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _null_safe_join(placed, offsets, [*group, "_part"])
    out = joined.withColumn(total, F.col("_before") + F.sum("_v").over(local))
    return out.drop("_v", "_before", "_part")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    )
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])


def row_ranks(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """1-based row number per group in ``order``, for groups of any size. Runs a job."""
    return running_totals(df, group, order, F.lit(1).cast("bigint"), rank)
