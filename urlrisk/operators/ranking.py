"""Threat rank, top-k, budgeted selection and the character-code baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.functions import scores as S
from urlrisk.functions import text as X
from urlrisk.plans.skew import row_ranks, running_totals


def with_rank(df: DataFrame, keyword_score: bool = False, weights: dict[str, float] | None = None) -> DataFrame:
    """Add ``threat_rank``. The live path passes no keyword score, which then counts as zero.

    ``weights`` (probability, entropy, redirect_depth, keyword_score) replaces the usual ones.
    """
    def optional(name: str) -> Column | None:
        return F.col(name) if name in df.columns else None

    return df.withColumn("threat_rank", S.threat_rank(
        optional("threat_probability"), optional("entropy"), optional("redirect_depth"),
        optional("keyword_score") if keyword_score else None, weights,
    ))


def ranked(df: DataFrame, url: str = "url") -> DataFrame:
    """All rows, highest rank first (a range-partitioned sort)."""
    return df.orderBy(F.desc("threat_rank"), url)


def top_k(df: DataFrame, k: int = 10, url: str = "url") -> DataFrame:
    """The k highest-ranked rows. Each task keeps k rows; only those reach the final merge."""
    return ranked(df, url).limit(k)


def top_per_batch(
    df: DataFrame, batch: str = "batch_id", k: str = "top_k", url: str = "url"
) -> DataFrame:
    """The highest-ranked rows of each batch, as many as its own ``k`` says, with their ``place`` from 1.

    Places come from a range partitioning, so a batch may hold any number of rows. Runs a job.
    """
    placed = row_ranks(df, [batch], [F.desc("threat_rank"), F.col(url)], "place")
    return placed.where(F.col("place") <= F.col(k))


def budgeted_selection(
    df: DataFrame, budget: float, batch: list[str] | None = None, url: str = "url"
) -> DataFrame:
    """Greedy selection by value per cost until the budget of each batch is used up.

    Reads threat_probability, entropy and lookup_cost (missing values: 0.5, 3.0, 1.0). The item that
    overflows the budget is kept with ``partial`` set. Ties order by MD5 of the URL, then the URL, which
    lets a batch of any size be range-partitioned. Runs a job.
    """
    cost = F.coalesce(F.col("lookup_cost"), F.lit(1.0))
    value = F.coalesce(F.col("threat_probability"), F.lit(0.5)) * F.coalesce(F.col("entropy"), F.lit(3.0))
    staged = df.withColumns({
        "_cost": cost, "ratio": F.when(cost > 0, value / cost).otherwise(0.0), "_tie": F.md5(url),
    })
    order = [F.desc("ratio"), F.col("_tie"), F.col(url)]
    total = running_totals(staged, batch or [], order, F.col("_cost"), "_used")
    kept = total.where(F.col("_used") - F.col("_cost") < budget)
    return kept.withColumn("partial", F.col("_used") > budget).drop("_cost", "_tie", "_used")


def char_counts(urls: DataFrame, url: str = "url") -> DataFrame:
    """``(char, count)`` over all URLs; partial counts keep the shuffle at alphabet size per task."""
    return (
        urls.select(F.explode(F.split(F.col(url), "")).alias("char")).where("char != ''")
        .groupBy("char").agg(F.count(F.lit(1)).alias("count"))
    )


def code_length_baseline(urls: DataFrame, url: str = "url") -> DataFrame:
    """Expected prefix-code length over the characters of all URLs, one row ``baseline``.

    Merging the two smallest weights until one is left adds up to the total code length. It runs over
    the character histogram, which is as small as the alphabet whatever the number of URLs. One distinct
    character has length 1, no URLs 0.
    """
    weights = F.sort_array(F.collect_list("count"))
    one = char_counts(urls, url).agg(weights.alias("w"), F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    start = F.struct(F.col("w").alias("w"), F.lit(0).cast("bigint").alias("total"))

    def merge(state: Column, _: Column) -> Column:
        pair = F.element_at(state["w"], 1) + F.element_at(state["w"], 2)
        rest = F.slice(state["w"], 3, F.size(state["w"]))
        return F.struct(
            F.sort_array(F.concat(rest, F.array(pair))).alias("w"), (state["total"] + pair).alias("total")
        )

    folded = F.aggregate(F.sequence(F.lit(1), F.size("w") - 1), start, merge)["total"]
    baseline = (
        F.when(F.size("w") > 1, folded / F.col("n")).when(F.size("w") == 1, 1.0).otherwise(0.0)
    )
    return one.select(baseline.alias("baseline"))


def entropy_anomaly(df: DataFrame, baseline: DataFrame, url: str = "url") -> DataFrame:
    """Add url_entropy, baseline_entropy, deviation and is_anomaly (deviation above 1.5)."""
    staged = df.withColumns({"url_entropy": X.entropy(F.col(url)), "baseline_entropy": baseline.scalar()})
    staged = staged.withColumn("deviation", F.abs(F.col("url_entropy") - F.col("baseline_entropy")))
    return staged.withColumn("is_anomaly", F.col("deviation") > 1.5)


def rank_records(df: DataFrame, baseline: DataFrame, url: str = "url") -> DataFrame:
    """url, threat_rank and the anomaly columns."""
    return entropy_anomaly(with_rank(df), baseline, url).select(
        url, "threat_rank", "url_entropy", "baseline_entropy", "deviation", "is_anomaly"
    )
