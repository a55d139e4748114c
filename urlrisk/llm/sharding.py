"""Sharding by a k-d tree over document metadata, with DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import stored
from urlrisk.plans.skew import row_ranks, running_totals


def metadata(text: Column, lang: Column) -> dict[str, Column]:
    """The default dimensions, each about 0 to 1: length of the text and its language.

    Equal texts of a language stand side by side in both, as ties go by digest, so only a cut that runs through their
    group separates them. Languages are placed by hash; null counts as 1.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0))
    return {
        "length": F.log2(size + 1) / 32.0,
        "lang": F.coalesce(F.crc32(lang.cast("binary")) / float(2**32), F.lit(1.0)),
    }


def kd_shards(
    docs: DataFrame, shards: int = 40, dimensions: dict[str, Column] | None = None, overhead: int = 16
) -> DataFrame:
    """Assign each document to a shard: (doc_id, size, text_crc32, shard, slot).

    A document's size is its UTF-8 bytes plus ``overhead``. All documents form the root, which is due all
    shards. A node that is due several is cut along the dimension that is widest in it, at the point where
    the sizes before it reach the share of the shards on that side (the weighted median for equal sides);
    leaves are due one shard, about total / ``shards`` bytes. Cuts are exact: running sums over a range
    partitioning, never a node in one task. Ties in a dimension are ordered by digest and id, so one
    value may hold any share of the rows. The texts are read once; the levels, log2(shards) of them, work
    on narrow rows.

    Null texts have no bytes, size ``overhead`` and digest 0; null ids come last; repeated rows get slots
    of their own. With fewer documents than shards some shards stay empty; an empty table gives no rows.
    Slots number a shard's documents from 0 by (digest, id).
    """
    dims = dimensions or metadata(F.col("text"), F.col("lang"))
    raw = F.col("text").cast("binary")
    state = stored(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("bigint").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("bigint").alias("text_crc32"),
        *[c.cast("double").alias(f"_d{i}") for i, c in enumerate(dims.values())],
        F.lit(0).alias("_first"), F.lit(int(shards)).alias("_due"),
    ), "shard-level")
    tie = [F.col("text_crc32"), F.col("doc_id").asc_nulls_last()]
    for _ in range(max(0, (shards - 1).bit_length())):
        width = [F.max(f"_d{i}") - F.min(f"_d{i}") for i in range(len(dims))]
        nodes = state.groupBy("_first").agg(
            F.sum("size").alias("_bytes"), *[w.alias(f"_w{i}") for i, w in enumerate(width)])
        widest = F.greatest(*[F.col(f"_w{i}") for i in range(len(dims))]) if len(dims) > 1 else F.col("_w0")
        axis = reduce(lambda rest, i: F.when(F.col(f"_w{i}") == widest, i).otherwise(rest), reversed(range(len(dims))), F.lit(0))
        nodes = nodes.select("_first", "_bytes", axis.alias("_axis"))
        along = reduce(lambda rest, i: F.when(F.col("_axis") == i, F.col(f"_d{i}")).otherwise(rest), range(len(dims)), F.lit(0.0))
        # one row per node, at most ``shards``: a bounded broadcast
        placed = state.join(F.broadcast(nodes), "_first").withColumn("_at", along)
        summed = running_totals(placed, ["_first"], [F.col("_at"), *tie], F.col("size"), "_sum")
        left = F.floor(F.col("_due") / 2).cast("int")
        goes_left = (2 * F.col("_sum") - F.col("size")) * F.col("_due") < 2 * F.col("_bytes") * left
        is_cut = F.col("_due") > 1
        state = stored(summed.select(
            "doc_id", "size", "text_crc32", *[f"_d{i}" for i in range(len(dims))],
            F.when(is_cut & ~goes_left, F.col("_first") + left).otherwise(F.col("_first")).alias("_first"),
            F.when(is_cut, F.when(goes_left, left).otherwise(F.col("_due") - left)).otherwise(F.col("_due")).alias("_due"),
        ), "shard-level")
    leaves = state.select("doc_id", "size", "text_crc32", F.col("_first").cast("int").alias("shard"))
    return row_ranks(leaves, ["shard"], tie, "_rank").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_rank") - 1).alias("slot"))


def op5_sharding(spark, sf_dir):
    shards = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=40)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
