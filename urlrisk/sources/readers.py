"""Scans: labelled CSV and TSV, request batches, hop logs, pages, feature statistics, streams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlrisk import catalogs as C
from urlrisk.operators import datasets

LABEL_NAMES = {"legitimate": "benign", "phishing": "malicious"}
LABEL_RESULTS = {"benign": 0, "malicious": 1}


def _mapped(column: Column, values: dict) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out


def read_labeled_csv(
    spark: SparkSession, candidates: Iterable[str], sample_size: int | None = None
) -> DataFrame:
    """Labelled URLs from the first candidate path that exists; optionally a hash-ordered sample."""
    tried = list(candidates)
    for path in tried:
        try:
            df = (
                spark.read.schema(C.LABELED_URLS).option("header", True).option("quote", '"')
                .option("escape", '"').csv(path)
            )
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return df if sample_size is None else datasets.random_sample(df, sample_size)
    raise FileNotFoundError(f"no dataset found; tried {tried}")


def read_labeled_tsv(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Labelled URLs of tab-separated split files, with a ``split`` column; a missing file is skipped.

    Lines are trimmed, cut at the first tab, and dropped when they have no second part.
    """
    parts = []
    for split, path in paths.items():
        try:
            lines = spark.read.text(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        fields = F.split(F.trim(F.col("value"), F.lit(" \t\r\n")), "\t", 2)
        label = _mapped(F.trim(F.get(fields, F.lit(0))), LABEL_NAMES)
        parts.append(
            lines.where(F.size(fields) == 2)
            .select(F.trim(F.get(fields, F.lit(1))).alias("url"), label.alias("label"))
            .withColumn("result", _mapped(F.col("label"), LABEL_RESULTS))
            .withColumn("split", F.lit(split))
        )
    if not parts:
        schema = T.StructType([*C.LABELED_URLS.fields, T.StructField("split", T.StringType())])
        return spark.createDataFrame([], schema)
    return datasets.union_all(*parts)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Single scan requests from JSON lines."""
    return spark.read.schema(C.SCAN_REQUESTS).json(path)


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """Batch requests from JSON lines, one row per URL with its batch and the batch's ``top_k`` (default 10).

    A batch without a ``batch_id`` is numbered by its place in the files.
    """
    batches = spark.read.schema(C.BATCH_REQUESTS).json(path)
    place = F.monotonically_increasing_id().cast("string")
    named = batches.select(
        "urls", F.coalesce("batch_id", place).alias("batch_id"), F.coalesce("top_k", F.lit(10)).alias("top_k")
    )
    return named.select("batch_id", F.explode("urls").alias("url"), "top_k")


def read_hop_log(spark: SparkSession, path: str) -> DataFrame:
    """Fetched responses: status, location, content type and body per URL."""
    return spark.read.schema(C.HOP_LOG).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages."""
    return spark.read.schema(C.PAGES).parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Feature means and deviations saved by ``write_stats``."""
    fields = [
        T.StructField(f"{name}_{kind}", T.DoubleType()) for name in C.FEATURES for kind in ("mean", "std")
    ]
    return spark.read.schema(T.StructType(fields)).json(path)


def stream_parquet(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Streaming scan of a Parquet folder or glob."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
