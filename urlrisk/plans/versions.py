"""Tables that grow by batches: every change is a new version, and a batch that runs again changes nothing.

A version's tables are written first and its row in the commit log last, so readers see whole versions only,
a job that was stopped in between writes the same version anew, and a change that names its batch is made
once. One writer at a time; versions that nobody reads any more are the folder owner's to remove.
"""

from __future__ import annotations

import json
from typing import Any, NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "version long, batch long, facts string"


class Commit(NamedTuple):
    version: int
    batch: int | None  # the last batch that was taken in
    facts: dict[str, Any]  # small settings and counts of this version


class Versions:
    """A folder of versioned tables and the log of its commits."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def latest(self) -> Commit | None:
        """The last whole version; None if there is none yet."""
        try:
            log = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        row = log.orderBy(F.desc("version")).first()
        return row and Commit(row["version"], row["batch"], json.loads(row["facts"]))

    def table(self, version: int, name: str, schema: Any) -> DataFrame:
        """A table of a version."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/version={version}")

    def write(self, version: int, name: str, rows: DataFrame) -> None:
        """Write a table of a version that is not committed yet, in place of what a stopped job left of it."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")

    def commit(self, version: int, batch: int | None, facts: dict[str, Any]) -> Commit:
        row = (version, batch, json.dumps(facts))
        self.spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return Commit(version, batch, facts)

    def is_taken(self, batch: int | None) -> bool:
        """Whether a numbered batch, or a later one, is in the latest version."""
        last = self.latest()
        return batch is not None and last is not None and last.batch is not None and last.batch >= batch


class KeyedTable:
    """One row per key, changed by batches: the state of a job, or a list that is edited while jobs read it.

    A batch is written as a delta of its own rows. After ``fold_every`` deltas they are folded into a new base,
    so a read goes over the base and a bounded number of deltas, however many batches there were. Of several
    rows of a key the one of the latest batch counts, within a batch the greatest by the other columns in order.
    A row whose ``gone`` is set removes its key.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, fold_every: int = 16) -> None:
        self.versions, self.key, self.fold_every = Versions(spark, path), key, fold_every
        self.empty = spark.createDataFrame([], schema)
        self.columns = self.empty.columns
        self.stored = f"{schema}, gone boolean, since long"

    def read(self) -> DataFrame:
        """The rows of the latest version."""
        return self._rows(self.versions.latest()).where("not gone").select(*self.columns)

    def _rows(self, last: Commit | None) -> DataFrame:
        if last is None:
            return self.empty.selectExpr("*", "false AS gone", "0L AS since")
        parts = [self.versions.table(v, "rows", self.stored) for v in last.facts["parts"]]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        rest = [c for c in self.columns if c != self.key]
        newest = F.max(F.struct("since", "gone", *rest)).alias("_r")
        found = every.groupBy(self.key).agg(newest) if len(parts) > 1 else every.select(self.key, F.struct("since", "gone", *rest).alias("_r"))
        return found.select(*[F.col(self.key) if c == self.key else F.col(f"_r.{c}").alias(c) for c in self.columns], "_r.gone", "_r.since")

    def upsert(self, rows: DataFrame, batch: int | None = None, gone: bool = False, keep: Column | None = None) -> None:
        """Take in a batch of rows (with ``gone``: remove their keys; only the key is read). ``keep`` says which rows a
        fold keeps; rows without a key are left out. Runs jobs; does nothing if the batch is in already."""
        if self.versions.is_taken(batch):
            return
        last = self.versions.latest()
        version = 0 if last is None else last.version + 1
        rest = [c for c in self.columns if c != self.key]
        fresh = rows.where(F.col(self.key).isNotNull())
        if gone:
            kinds = {c: self.empty.schema[c].dataType for c in rest}
            fresh = fresh.select(self.key, *[F.lit(None).cast(kinds[c]).alias(c) for c in rest]).distinct()
        else:
            value = F.max(F.struct(*rest)).alias("_r") if rest else F.lit(None).alias("_r")
            fresh = fresh.groupBy(self.key).agg(value).select(self.key, *[f"_r.{c}" for c in rest])
        typed = [F.col(c).cast(self.empty.schema[c].dataType).alias(c) for c in self.columns]
        stamped = fresh.select(*typed, F.lit(gone).alias("gone"), F.lit(version).cast("long").alias("since"))
        self.versions.write(version, "rows", stamped)
        parts = [*(last.facts["parts"] if last else []), version]
        if len(parts) > self.fold_every:
            folded = self._rows(Commit(version, batch, {"parts": parts})).where("not gone")
            version += 1
            self.versions.write(version, "rows", folded if keep is None else folded.where(keep))
            parts = [version]
        known = last.batch if last else None
        self.versions.commit(version, known if batch is None else batch, {"parts": parts})
