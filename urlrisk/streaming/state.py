"""Streaming jobs whose state is a keyed table: lists that change while a stream runs, the learned blacklist,
remembered expansions.

State is one row per key. Each micro-batch reads the version that the one before left, so nothing is folded over
all batches, and writes its changes under its own number, so a batch that runs again changes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from urlrisk.functions import scores as S
from urlrisk.operators import chains, gate, sketches
from urlrisk.plans.lineage import cut
from urlrisk.plans.versions import KeyedTable
from urlrisk.streaming import jobs

LIST_ENTRIES = "entry string, pattern string, kind string"
COUNTS = "decision string, urls long"
LEARNED = "url string, score double, inserted_at timestamp, verified boolean"
EXPANSIONS = (
    "url string, expanded_at timestamp, expanded_url string, is_shortened boolean, shortener_domain string, "
    "redirect_chain array<struct<hop:int,url:string,status_code:int,is_suspicious:boolean,redirect_type:string>>, "
    "redirect_count int, loop_detected boolean, excessive_redirects boolean, errors array<string>"
)


# -- lists that change -------------------------------------------------------------------------------
class ListTable:
    """Safe and malicious hosts as a table that is edited while jobs read it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.entries = KeyedTable(spark, path, LIST_ENTRIES, "entry")

    def _keyed(self, entries: DataFrame) -> DataFrame:
        return entries.select(F.concat_ws(":", "kind", "pattern").alias("entry"), "pattern", "kind")

    def insert(self, entries: DataFrame) -> None:
        """Add entries (pattern, kind)."""
        self.entries.upsert(self._keyed(entries))

    def delete(self, entries: DataFrame) -> None:
        """Remove entries (pattern, kind)."""
        self.entries.upsert(self._keyed(entries), gone=True)

    def lists(self) -> tuple[DataFrame, DataFrame]:
        """The safe and the malicious patterns of the latest version."""
        now = self.entries.read()
        return tuple(now.where(F.col("kind") == kind).select("pattern") for kind in ("safe", "malicious"))


def gate_batches(
    stream: DataFrame, lists: ListTable, table: str, counters: KeyedTable | None = None, progress: str | None = None,
    url: str = "url",
) -> StreamingQuery:
    """Gate every micro-batch with the lists as they are when it starts; append it to ``table``.

    ``counters`` (COUNTS, by decision) keeps running totals; each batch is added to them once.
    """
    def run(batch: DataFrame, number: int) -> None:
        safe, malicious = lists.lists()
        gated = gate.gate(batch, sketches.data_ensemble(malicious, safe), safe, malicious, url)
        folder = f"{table}/batch={number}"
        gated.write.mode("overwrite").parquet(folder)
        if counters is not None:
            written = batch.sparkSession.read.parquet(folder).groupBy("decision").agg(F.count(F.lit(1)).alias("urls"))
            counters.upsert(written.unionByName(counters.read()).groupBy("decision").agg(F.sum("urls").alias("urls")), number)

    return _started(stream, run, table, progress)


def _started(stream: DataFrame, run: Callable[[DataFrame, int], None], table: str, progress: str | None) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(run).option("checkpointLocation", progress or f"{table.rstrip('/')}-progress")
        .trigger(availableNow=True).start()
    )


# -- learned blacklist -------------------------------------------------------------------------------
def learned_table(spark: SparkSession, path: str, fold_every: int = 16) -> KeyedTable:
    """The learned blacklist: one row per URL."""
    return KeyedTable(spark, path, LEARNED, "url", fold_every)


def live_entries(learned: KeyedTable, as_of: Column, threshold: float = 0.1) -> DataFrame:
    """Entries that count at ``as_of``: verified ones, and scored ones that have not decayed."""
    return learned.read().where(_lives(as_of, threshold))


def _lives(as_of: Column, threshold: float) -> Column:
    return F.col("verified") | (S.decayed(F.col("score"), F.col("inserted_at"), as_of) >= threshold)


def judge_batches(
    requests: DataFrame, filter_of: sketches.Learned | Callable[[], sketches.Learned], learned: KeyedTable, table: str,
    progress: str | None = None, ts: str = "ts", threshold: float = 0.1,
) -> StreamingQuery:
    """Verdicts of every micro-batch, appended to ``table``, with the blacklist that the batches before it learned.

    A URL that one batch verifies is possible in the next ones, whatever the filter says by then. Event time is the
    latest request of a batch: entries that have decayed by then are not consulted, and a fold of the state drops
    them. ``filter_of`` is the prepared filter, or makes it anew for each batch.
    """
    def run(batch: DataFrame, number: int) -> None:
        kept = cut(batch)
        now = kept.agg(F.max(ts).alias("now")).first()["now"]
        if now is None:
            return
        as_of = F.lit(now)
        prepared = filter_of() if callable(filter_of) else filter_of
        verdicts = jobs.threat_verdicts(kept, prepared, blacklist=live_entries(learned, as_of, threshold).select("url"))
        folder = f"{table}/batch={number}"
        verdicts.write.mode("overwrite").parquet(folder)
        fresh = jobs.learned_entries(batch.sparkSession.read.parquet(folder), ts)
        learned.upsert(fresh, number, keep=_lives(as_of, threshold))

    return _started(requests, run, table, progress)


# -- expansions --------------------------------------------------------------------------------------
def expansion_table(spark: SparkSession, path: str, fold_every: int = 16) -> KeyedTable:
    """Known expansions, one row per URL."""
    return KeyedTable(spark, path, EXPANSIONS, "url", fold_every)


def expand_remembered(
    urls: DataFrame, hop_log: DataFrame, known: KeyedTable, now: Column, max_age: str = "1 day", batch: int | None = None
) -> DataFrame:
    """Expansion record per distinct URL: the known one if it is no older than ``max_age`` at ``now``, else a new one.

    Only URLs without a fresh record are followed; what they lead to is remembered. Runs jobs.
    """
    asked = cut(urls.select("url").where("url is not null").distinct())
    fresh = F.col("expanded_at") > now - F.expr(f"INTERVAL {max_age}")
    missing = asked.join(known.read().where(fresh).select("url"), "url", "left_anti")
    columns = [c for c in known.columns if c != "expanded_at"]
    found = chains.expand_b(missing, hop_log).withColumn("expanded_at", now)
    known.upsert(found.select(*known.columns), batch, keep=fresh)
    return asked.join(known.read(), "url").select(*columns)
