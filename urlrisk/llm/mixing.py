"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlrisk.llm.common import row_key, stored, word_count
from urlrisk.plans.skew import row_ranks, running_totals


def targets(sized: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """(source, source_size, target) with one row per source, null last.

    Sources in code point order get ``weights``, repeating. They share ``share`` (a fraction) of all
    sizes by weight, but no target exceeds ``most`` times its source's size; the excess goes to the
    others by weight until none is above. That end state is a common level: each source gets its weight
    times the level, or its limit. A source is at its limit if the level that the sources from it on
    would have, in order of limit by weight, is no lower than its own. All sums are integers, so the
    result doesn't depend on their order. Works on one row per source; ranks and running sums come from
    range partitions, so there may be any number of sources, and the driver gets four sums.
    """
    num, den = share
    cycle = F.array(*[F.lit(int(w)).cast("bigint") for w in weights])
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = row_ranks(sums, [], [F.col("source").asc_nulls_last()], "_n").select(
        "source", "source_size", F.element_at(cycle, ((F.col("_n") - 1) % len(weights) + 1).cast("int")).alias("weight"))
    named = stored(named.withColumn("limit", F.col("source_size") * most), "mix-sources")
    every = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    order = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    summed = running_totals(running_totals(named, [], order, F.col("limit"), "_limits"), [], order, F.col("weight"), "_weights")
    taken_before = F.col("_limits") - F.col("limit")
    weight_left = F.lit(every["weight"]) - F.col("_weights") + F.col("weight")
    full = (F.lit(every["size"] * num) - taken_before * den) * F.col("weight") >= F.col("limit") * weight_left * den
    marked = stored(summed.select("source", "source_size", "weight", "limit", full.alias("full")), "mix-limits")
    rest = marked.agg(
        F.coalesce(F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))), F.lit(0)).alias("weight"),
        F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))), F.lit(0)).alias("limit")).first()
    rest_size = F.lit(every["size"] * num - rest["limit"] * den)
    level = (F.col("weight") * rest_size).cast("double") / F.lit(float(max(1, rest["weight"]) * den))
    return marked.select(
        "source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(level).alias("target")
    )


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[int] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    seed: int = 7,
    carry: Sequence[str] = (),
) -> DataFrame:
    """How often the mix takes each document: (doc_id, size, source, source_size, target, copies, ``carry``).

    Within a source every document expects target / source_size copies. Documents stand in order of
    (size, doc_id); the running sum of the expected copies plus one random offset (from ``seed``) crosses
    an integer as often as the document is taken. Since neighbours in that order have like sizes, the
    words taken differ from the target by no more than about one document. A source may hold any share
    of the rows: ranks come from a range partitioning with offsets per partition.

    Null texts have size 0; null sources are one source, the last; repeated rows are documents of their
    own and may get different counts; sources without words get no copies; an empty table gives none.
    """
    sized = stored(docs.select(
        "doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size"), *carry), "mix-sizes")
    offset = random.Random(seed).random()
    order = [F.col("size").asc(), F.col("doc_id").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in carry]]
    ranked = row_ranks(sized, ["source"], order, "_rank")
    goal = targets(sized, weights, share, most).withColumnRenamed("source", "_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(F.lit(offset) + F.col("_rank") * expected) - F.floor(F.lit(offset) + (F.col("_rank") - 1) * expected)
    joined = ranked.join(goal, F.col("source").eqNullSafe(F.col("_source")))
    return joined.select("doc_id", "size", "source", "source_size", "target", crossed.cast("bigint").alias("copies"), *carry)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as it is taken.

    Counts are worked out on narrow rows and joined back by a digest of id and text; rows that share it are
    repeats, over which their common count is spread evenly.
    """
    key = "__row_key"
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    taken = mix(keyed, carry=[key], **settings).groupBy(key).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    joined = keyed.join(taken.where("__copies > 0"), key)
    nth = joined.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(key)))
    share = F.floor(F.col("__copies") * F.col("__nth") / F.col("__rows")) - F.floor(F.col("__copies") * (F.col("__nth") - 1) / F.col("__rows"))
    repeated = nth.withColumn("__share", share.cast("int")).where("__share > 0")
    return repeated.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__share")))).select(*docs.columns)


def op3_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def oracle(seed: int = 7) -> str:
    """The query in SQL."""
    u = random.Random(seed).random()
    return rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, 2 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(2 * source_size) OVER w, 0) AS BIGINT) AS taken_before,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS weight_left
  FROM named
  WINDOW w AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, (3 * total - 2 * taken_before) * weight >= cap * weight_left * 2 AS at_cap FROM ranked
), goal AS (
  SELECT source, source_size, CASE WHEN at_cap THEN CAST(cap AS DOUBLE) ELSE
    CAST(weight * (3 * total - 2 * sum(CASE WHEN at_cap THEN cap ELSE 0 END) OVER ()) AS DOUBLE)
      / CAST(2 * sum(CASE WHEN at_cap THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target
  FROM marked
), placed AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e,
    row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id ASC NULLS LAST) AS rn
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  size * CAST(floor({u!r} + rn * e) - floor({u!r} + (rn - 1) * e) AS BIGINT) AS taken
FROM placed"""
