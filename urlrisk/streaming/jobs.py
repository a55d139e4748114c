"""Streaming jobs: gate counters, first-seen URLs, learned blacklist.

Everything stateless (parsing, features, keywords, constant-list gate, scoring) runs on a streaming
DataFrame as it is. The jobs here hold state or write tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from urlrisk.functions import text as X
from urlrisk.operators import features, gate, scoring, sketches
from urlrisk.plans.lineage import scratch_path


def stream_scores(stream: DataFrame) -> DataFrame:
    """Streaming scan: features and the profile B prediction per arriving URL."""
    return scoring.predict_b(features.extract_features(stream, "B"))


def decision_counts(stream: DataFrame, ensemble: sketches.Ensemble | None = None) -> DataFrame:
    """Running count per gate decision (three groups, combined before the shuffle)."""
    return gate.gate(stream, ensemble).groupBy("decision").agg(F.count(F.lit(1)).alias("urls"))


def first_seen(stream: DataFrame, ts: str = "ts", delay: str = "1 hour", key: str = "url") -> DataFrame:
    """First arrival of each URL within the watermark delay; state older than that is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def threat_verdicts(
    requests: DataFrame, known: DataFrame | sketches.Learned, shape: sketches.Shape | None = None,
    blacklist: DataFrame | None = None,
) -> DataFrame:
    """Membership verdict per URL of a batch, or of a micro-batch (``append_batches``).

    ``known`` are malicious URLs, or the filter that ``sketches.learn`` prepared from them once.
    ``blacklist``, a table of verified URLs (``current_blacklist``), makes its members possible too.
    """
    probed = sketches.membership(requests, known, shape, blacklist)
    probed = probed.withColumn("entropy", X.entropy(F.col("url")))
    depth = F.col("redirect_depth") if "redirect_depth" in requests.columns else F.lit(0)
    signals = features.pattern_signals(probed)
    met = sketches.constraints_met(
        F.col("url"), F.col("entropy"), depth, F.col("pattern_score"), F.col("has_ip_address")
    )
    verdict = sketches.membership_verdict(F.col("possibly_malicious"), met)
    return signals.withColumn("membership_verdict", verdict).select(
        *requests.columns, "in_filter", "similarity", "membership_verdict"
    )


def learned_entries(verdicts: DataFrame, ts: str = "ts", score: float = 1.0) -> DataFrame:
    """Threat entries ``(url, score, inserted_at, verified)`` of a written verdict table, for verified URLs."""
    return verdicts.where(F.col("membership_verdict") == "malicious").select(
        "url", F.lit(score).alias("score"), F.col(ts).alias("inserted_at"), F.lit(True).alias("verified")
    )


def append_stream(df: DataFrame, table: str, progress: str | None = None) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once, until the input is used up.

    ``progress`` is the folder that records what has been read, by default one beside the table. Start the
    job again with the same folder and it goes on with the rows that are new since.
    """
    return (
        df.writeStream.format("parquet").option("path", table)
        .option("checkpointLocation", progress or f"{table.rstrip('/')}-progress")
        .outputMode("append").trigger(availableNow=True).start()
    )


def append_batches(
    stream: DataFrame, step: Callable[[DataFrame], DataFrame], table: str, progress: str | None = None
) -> StreamingQuery:
    """Append ``step`` of every micro-batch to a Parquet table until the input is used up.

    For steps with joins and aggregations inside a batch. Each batch writes its own ``batch=<number>``
    folder and replaces it when it is run again, so every row is there exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", progress or f"{table.rstrip('/')}-progress")
        .trigger(availableNow=True).start()
    )


def current_blacklist(entries: DataFrame, as_of: Column, threshold: float = 0.1) -> DataFrame:
    """Live view of the learned entries: latest insertion per URL.

    Scored entries expire; a URL that was verified once stays. The table they come from is append-only, so a
    failed batch leaves nothing half-written; folding it is one aggregation that combines before the shuffle.
    """
    newest = F.max(F.struct("inserted_at", "score")).alias("_e")
    verified = F.max("verified") if "verified" in entries.columns else F.lit(False)
    latest = entries.groupBy("url").agg(newest, verified.alias("verified")).select(
        "url", "_e.score", "_e.inserted_at", F.coalesce("verified", F.lit(False)).alias("verified"))
    ageing = sketches.drop_expired(latest.where("not verified"), as_of, threshold)
    return latest.where("verified").unionByName(ageing.select(*latest.columns))


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a streaming aggregation with a small, fixed number of groups to the end; return its result."""
    spark = df.sparkSession
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", scratch_path(spark, f"{name}-progress"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.table(name)


def run_to_table(df: DataFrame, name: str) -> DataFrame:
    """Run an append-only stream to the end into a fresh table below the checkpoint folder."""
    spark = df.sparkSession
    table = scratch_path(spark, name)
    append_stream(df, table).awaitTermination()
    return spark.read.schema(df.schema).parquet(table)


def run_batches(stream: DataFrame, step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run ``append_batches`` to the end into a fresh table below the checkpoint folder."""
    spark = stream.sparkSession
    table = scratch_path(spark, name)
    append_batches(stream, step, table).awaitTermination()
    return spark.read.parquet(table).drop("batch")
