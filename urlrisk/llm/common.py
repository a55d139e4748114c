"""Pieces that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.plans.lineage import scratch_path

#: A word: a run of anything but ASCII white space. The bytes methods split() and lower() of Python
#: follow the same rule (six white space bytes, A-Z only), so workers use them on UTF-8 bytes.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts lineage, survives executors.

    Unlike a checkpoint the table is columnar, so later reads take only the columns they need. The files
    stay until the owner of the checkpoint folder removes them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_UNITS = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}


def size_setting(value: str) -> int:
    """A number of bytes as Spark's settings write it: 64, 64b, 64k, 64m, 64mb ..."""
    text = value.strip().lower()
    number = text.rstrip("bkmgtp")
    unit = text[len(number):]
    return int(number) * _UNITS[unit[0] if unit else "b"]


def light_batches(spark: SparkSession) -> None:
    """Let Python workers get at most 1000 rows and 16 MB at a time, so that long texts don't add up.

    Spark reads the two settings when a plan runs, after the operator has returned it, so they are lowered for the
    session and stay so. A session that has them lower keeps its own.
    """
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 16 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = size_setting(spark.conf.get(name))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def utf8(text: str | Column) -> Column:
    """The UTF-8 bytes of a text, which Python workers get as bytes; null stays null. A string of Spark may hold any
    bytes: what is no UTF-8 becomes U+FFFD, so that workers can decode."""
    return F.make_valid_utf8(F.col(text) if isinstance(text, str) else text).cast("binary")


def row_key(doc_id: Column, text: Column) -> Column:
    """A digest of id and text, never null: what decisions about rows are joined back by. Rows that share
    it are repeats of each other."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), F.when(text.isNull(), "0").otherwise("1"), text).cast("binary"))


def is_training(doc_id: Column, modulus: int, held_out: int) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, by remainder. A null id may not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus != held_out, F.lit(False))
