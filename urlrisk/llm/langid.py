"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from urlrisk.llm.common import is_training, light_batches, utf8

DIMS = 4096
BINS = 24
UNKNOWN = "und"
#: The least share of a language's sample that a centroid stands for.
LEAST_SHARE = 0.01
_AT_ONCE = 256


class Model(NamedTuple):
    """idf per dimension; unit centroids with their language; the least similarity per language and length."""

    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    langs: list[str]
    floor: np.ndarray


@cache
def _letters() -> np.ndarray:
    """Per code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str) -> tuple[np.ndarray, int, bool]:
    """Hashed counts of 1- to 3-grams of code points, how many there are, and whether there is a letter.

    The text is lower-cased; any run of other characters than letters counts as one space.
    """
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(DIMS, np.int64), 0, False
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter stands for the run
    keep[0] = True
    c = np.where(letter, codes, 32)[keep].astype(np.uint64)
    one = (c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    two = ((c[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[1:] * np.uint64(0x165667B19E3779F9))) >> np.uint64(40)
    three = ((c[:-2] * np.uint64(0x27D4EB2F165667C5)) ^ (c[1:-1] * np.uint64(0x85EBCA77C2B2AE63)) ^ (c[2:] * np.uint64(0x9E3779B185EBCA87))) >> np.uint64(40)
    grams = np.concatenate([one, two, three]) % np.uint64(DIMS)
    return np.bincount(grams.astype(np.int64), minlength=DIMS), len(grams), True


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors (zero without a letter), the bins of their lengths, and whether there is a letter."""
    got = [counts(t) for t in texts]
    raw = np.array([g[0] for g in got], np.float32).reshape(len(got), DIMS)
    found = np.log1p(raw) * idf.astype(np.float32)
    norm = np.linalg.norm(found, axis=1, keepdims=True)
    bins = np.array([min(BINS - 1, g[1].bit_length()) for g in got], np.int64)
    return found / np.where(norm > 0, norm, 1), bins, np.array([g[2] for g in got], bool)


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means, started from points far from each other."""
    centers = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        centers.append(x[np.argmin(np.max(x @ np.array(centers).T, axis=1))])
    c = np.array(centers)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def floors(near: np.ndarray, bins: np.ndarray, low: float, least: int = 50) -> np.ndarray:
    """Per length bin: the ``low`` quantile of the similarities of at least ``least`` rows (all, if there are
    fewer) of that bin and, as far as needed, the bins around it."""
    found = []
    for b in range(BINS):
        off = np.abs(bins - b)
        found.append(np.quantile(near[off <= np.sort(off)[min(least, len(off)) - 1]], low))
    return np.array(found)


def fit(
    labelled: DataFrame, clusters: int = 3, sample: int = 800, slack: float = 0.35, low: float = 0.1
) -> Model | None:
    """Learn from (doc_id, text, lang); rows without text or language teach nothing; None without any.

    Document frequencies cover every row: each task sends one count per dimension, merged in a shuffle.
    Every value of ``lang`` is learned, invalid UTF-8 in it as U+FFFD. Centroids come from about ``sample`` rows per
    language, chosen by a hash of the id; one task clusters one language. What the driver and each task get is
    at most ``clusters`` x DIMS numbers per language (48 KB; a few thousand languages fit): a cluster of less than
    LEAST_SHARE of the sample (often one mislabelled row) is no centroid. A language rejects texts that are less
    similar to its nearest centroid than ``slack`` times the ``low`` quantile of the sample rows of like length
    (``floors``).
    """
    light_batches(labelled.sparkSession)
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("doc_id").cast("bigint"), utf8("text").alias("_text"), F.make_valid_utf8("lang").alias("lang"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for t in batch["_text"]:
                total += counts(t.decode())[0] > 0
                n += 1
        yield pd.DataFrame({"dim": np.arange(-1, DIMS), "n": np.concatenate([[n], total])})

    merged = rows.select("_text").mapInPandas(frequencies, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n"))
    seen = {r["dim"]: r["n"] for r in merged.collect()}
    df = np.array([seen.get(d, 0) for d in range(DIMS)], float)
    idf = np.log((1 + seen.get(-1, 0)) / (1 + df)) + 0.1

    steps = 1 << 20
    draw = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(steps))
    order = Window.partitionBy("lang").orderBy("_draw", "doc_id")
    share = rows.groupBy("lang").agg(F.ceil(F.lit(float(steps * sample)) / F.count(F.lit(1))).alias("_share"))
    # one small row per language, of which the driver gets 48 KB each below
    chosen = rows.withColumn("_draw", draw).join(F.broadcast(share), "lang").where("_draw < _share")
    bounded = chosen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 2 * sample)

    def centroids(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["_draw", "doc_id"])
        x, bins, ok = vectors([t.decode() for t in own["_text"]], idf)
        x, bins = x[ok], bins[ok]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        c = cluster(x, clusters)
        held = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
        c = c[held >= min(LEAST_SHARE * len(x), held.max())]
        floor = floors((x @ c.T).max(axis=1), bins, low) * slack
        return pd.DataFrame({
            "lang": own["lang"].iloc[0], "centroid": [v.astype("<f4").tobytes() for v in c],
            "floor": [floor.tolist()] * len(c)})

    got = bounded.select("lang", "doc_id", "_text", "_draw").groupBy("lang").applyInPandas(
        centroids, "lang string, centroid binary, floor array<double>").collect()
    if not got:
        return None
    langs = sorted({r["lang"] for r in got})
    at = {lang: i for i, lang in enumerate(langs)}
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["centroid"])))
    return Model(
        idf, np.array([np.frombuffer(bytes(r["centroid"]), "<f4") for r in got]), np.array([at[r["lang"]] for r in got]), langs,
        np.array([next(r["floor"] for r in got if r["lang"] == lang) for lang in langs]))


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether the text is rejected."""
    given = ["" if t is None else t for t in texts]
    if model is None or not given:
        return [UNKNOWN] * len(given), np.zeros(len(given)), np.ones(len(given), bool)
    x, bins, ok = vectors(given, model.idf)
    near = x @ model.centroids.T
    best = np.stack([near[:, model.owner == i].max(axis=1) for i in range(len(model.langs))], axis=1)
    top = best.argmax(axis=1)
    at = np.arange(len(given))
    odds = np.exp(20.0 * (best - best[at, top][:, None]).astype(float))
    score = np.where(ok, 1.0 / odds.sum(axis=1), 0.0)
    rejected = ~ok | (best[at, top] < model.floor[top, bins])
    return [model.langs[i] if good else UNKNOWN for i, good in zip(top, ok, strict=True)], score, rejected


def identify(docs: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """All columns of ``docs`` and ``out`` struct<lang, score, rejected>, which replaces a column of that name.

    A text is a TF-IDF vector of hashed character n-grams, compared by cosine with every centroid. Its
    language is that of the nearest one; the score is the softmax share of that language. It is rejected
    if even that one is too far for a text of its length, or if there is no letter (null and empty texts
    too): then lang is ``und``. Texts of any length are read whole, invalid UTF-8 as U+FFFD; an empty table stays
    empty. One pass, no shuffle; the model is a few numbers per language.
    """
    light_batches(docs.sparkSession)
    kind = "struct<lang:string,score:double,rejected:boolean>"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts: list[pd.DataFrame] = []
            for at in range(0, max(1, len(batch)), _AT_ONCE):
                part = [None if t is None else t.decode() for t in batch.iloc[at:at + _AT_ONCE]]
                langs, score, rejected = predict(part, model)
                parts.append(pd.DataFrame({"lang": langs, "score": score.astype(float), "rejected": rejected}))
            yield pd.concat(parts, ignore_index=True)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn(out, F.pandas_udf(run, kind)(utf8(text)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> Model | None:
    """The model of the documents that may be learned from."""
    return fit(docs.where(is_training(F.col("doc_id"), 4, 2)))


def op6_langid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit_documents(docs))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))
