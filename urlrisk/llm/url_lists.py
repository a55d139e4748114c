"""URL filters: a sorted array of digests, memory-mapped in tasks, with the full strings beside it."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.llm.common import light_batches, stored
from urlrisk.plans.lineage import scratch_path

#: The seed of Spark's xxhash64, so that the JVM builds the keys that workers probe with.
SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


class RuleArray(NamedTuple):
    """A built list: the files that Spark ships to executors, by volume (None: too large, probe by shuffle), the
    number of leading digest bits that name a volume, the lengths of rule paths and of the longest host in bytes, the bits
    of a digest that count, and the rules themselves as (key, verdict)."""

    files: dict[int, str] | None
    volume_bits: int
    path_lengths: tuple[int, ...]
    longest_host: int
    digest_bits: int
    rules: DataFrame


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _digest(key: Column, bits: int) -> Column:
    return F.xxhash64(key) if bits == 64 else F.shiftright(F.xxhash64(key), 64 - bits)


def build(rules: DataFrame, volume_bytes: int = 64 << 20, ship_up_to: int = 4 << 30, digest_bits: int = 64) -> RuleArray:
    """Make the sorted array from ``rules`` (host, path, verdict).

    A rule's key is its host, A-Z lower-cased, followed by its path. Rules with a null part, a host that holds
    ``/``, ``?`` or ``#``, a path that neither is empty nor starts with ``/`` (no URL has either) or another
    verdict than allow and block are left out; of several verdicts of one key block holds.

    Spark sorts the 64-bit digests into volumes of about ``volume_bytes``, by their leading bits, and a task per
    volume writes one file to shared storage: digests in order, ends of strings, verdicts, strings. Spark
    then fetches the files to every executor once, where workers map them, so the memory in use is that of the
    touched pages. ``ship_up_to`` bounds their size; a larger list is not shipped but joined by shuffle, with
    the same result. ``digest_bits`` below 64 provokes collisions, which change nothing but time.
    """
    own, tail = F.translate("host", UPPER, LOWER), F.col("path")
    fits = ~own.rlike("[/?#]") & ((tail == "") | tail.startswith("/")) & F.col("verdict").isin(*VERDICTS)
    keyed = stored(
        rules.where(F.coalesce(fits, F.lit(False))).select(F.concat(own, tail).alias("key"), F.octet_length(tail).alias("tail"), "verdict")
        .groupBy("key").agg(F.max("verdict").alias("verdict"), F.max("tail").alias("tail"))
        .withColumn("host", F.octet_length("key") - F.col("tail")).withColumn("digest", _digest(F.col("key"), digest_bits)), "url-rules")
    known = keyed.agg(F.sum(F.octet_length("key") + 17).alias("bytes"), F.collect_set("tail").alias("tails"), F.max("host").alias("host")).first()
    size, lengths, longest = known["bytes"] or 0, tuple(sorted(known["tails"])), known["host"] or 0
    if size > ship_up_to or not size:
        return RuleArray(None, 0, lengths, longest, digest_bits, keyed.select("key", "verdict"))
    volume_bits = max(0, (-(-size // volume_bytes) - 1).bit_length())
    volume = F.lit(0) if not volume_bits else F.shiftrightunsigned("digest", 64 - volume_bits).cast("int")

    def packed(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["digest", "key"])
        keys = [bytes(k) for k in own["key"]]
        ends = np.cumsum([0, *map(len, keys)]).astype("<i8")
        blob = b"".join([
            np.array([len(keys)], "<i8").tobytes(), own["digest"].to_numpy().astype("<i8").tobytes(), ends.tobytes(),
            (own["verdict"] == "block").to_numpy().astype(np.uint8).tobytes(), *keys])
        return pd.DataFrame({"volume": [int(own["volume"].iloc[0])], "value": [blob]})

    volumes = keyed.withColumn("volume", volume).select("volume", "digest", F.col("key").cast("binary"), "verdict")
    blobs = stored(volumes.groupBy("volume").applyInPandas(packed, "volume int, value binary"), "url-volumes")
    files: dict[int, str] = {}
    for r in blobs.select("volume").collect():
        folder = scratch_path(keyed.sparkSession, "url-array")
        # the text writer puts out the bytes of a string as they are, on any file system that Spark reaches
        blobs.where(F.col("volume") == r["volume"]).select(F.col("value").cast("string")).coalesce(1).write.text(folder)
        file = keyed.sparkSession.read.text(folder).inputFiles()[0]
        keyed.sparkSession.sparkContext.addFile(file)
        files[r["volume"]] = os.path.basename(file)
    return RuleArray(files, volume_bits, lengths, longest, digest_bits, keyed.select("key", "verdict"))


class Volume:
    """One file of the array, mapped."""

    def __init__(self, file: str) -> None:
        raw = np.memmap(file, np.uint8, "r")
        n = int(raw[:8].view("<i8")[0])
        self.digests = raw[8:8 + 8 * n].view("<i8")
        self.ends = raw[8 + 8 * n:16 + 16 * n].view("<i8")
        self.block = raw[16 + 16 * n:16 + 17 * n]
        self.strings = raw[16 + 17 * n:]

    def find(self, digests: np.ndarray, keys: list[bytes]) -> np.ndarray:
        """Per key its place in the array, -1 if it isn't there: a binary search of all digests at once, then the
        strings of equal digests are compared."""
        at = np.searchsorted(self.digests, digests)
        out = np.full(len(keys), -1)
        at[at == len(self.digests)] = 0
        for i in np.flatnonzero(self.digests[at] == digests).tolist():
            here = int(at[i])
            while here < len(self.digests) and self.digests[here] == digests[i]:
                if self.strings[self.ends[here]:self.ends[here + 1]].tobytes() == keys[i]:
                    out[i] = here
                    break
                here += 1
        return out


@cache
def _volume(file: str) -> Volume:
    """A worker's mapping of a volume."""
    return Volume(SparkFiles.get(file))


def candidates(own: bytes, tail: bytes, lengths: tuple[int, ...], longest: int) -> list[tuple[bytes, bytes]]:
    """The (host, path) of rules that would fit: the host and its parents, each with the path's beginnings, as far
    as they are no longer than the ``longest`` host of the list."""
    hosts = [own] if len(own) <= longest else []
    dot = max(0, len(own) - longest - 1)
    while (dot := own.find(b".", dot)) >= 0:
        dot += 1
        hosts.append(own[dot:])
    starts = [tail[:n] for n in lengths if n <= len(tail)]
    return [(h, p) for h in hosts for p in starts]


def judge(pages: DataFrame, array: RuleArray, url: str = "url", default: str = "allow", out: str = "filter") -> DataFrame:
    """All columns of ``pages`` and ``out`` struct<host, path, rule, verdict>, which replaces a column of that name.

    A rule fits its host and all subdomains, if the path starts with the rule's. The longest one wins, by code
    points of host and path together, then by the host's. A URL that no rule fits has a null rule and the
    verdict ``default``. Null URLs and those without ``://`` have an empty host and path, which only a rule of an
    empty host would fit. Hosts are taken as written, with user and port. URLs with invalid UTF-8 are read with
    U+FFFD in place of the invalid bytes. An empty list gives every URL the default.

    One pass, no shuffle: each batch probes all its candidates (parents x lengths of rule paths) in the mapped
    array. A list that was too large to ship is joined by shuffle, one row per candidate.
    """
    taken = pages.withColumn(out, F.struct(host(F.col(url)).alias("host"), path(F.col(url)).alias("path")))
    if array.files is None:
        return _by_shuffle(taken, array, default, out)
    light_batches(pages.sparkSession)
    files, volume_bits, lengths, longest, digest_bits = array[:5]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked: list[bytes] = []
            of: list[int] = []
            rank: list[tuple[int, int]] = []
            for i, (h, p) in enumerate(zip(batch["host"], batch["path"], strict=True)):
                for a, b in candidates(h, p, lengths, longest):
                    asked.append(a + b)
                    of.append(i)
                    own = len(a.decode())
                    rank.append((own + len(b.decode(errors="replace")), own))
            found: list[tuple[tuple[int, int], bytes, bool] | None] = [None] * len(batch)
            digests = np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in asked), np.uint64, len(asked)).view(np.int64)
            if digest_bits < 64:
                digests = digests >> (64 - digest_bits)
            volumes = digests.view(np.uint64) >> np.uint64(64 - volume_bits) if volume_bits else np.zeros(len(asked), np.uint64)
            for v in np.unique(volumes).tolist():
                if v not in files:  # no rule fell into it
                    continue
                some, volume = np.flatnonzero(volumes == v), _volume(files[v])
                hits = volume.find(digests[some], [asked[j] for j in some])
                for j, at in zip(some[hits >= 0].tolist(), hits[hits >= 0].tolist(), strict=True):
                    best = found[of[j]]
                    if best is None or rank[j] > best[0]:
                        found[of[j]] = (rank[j], asked[j], bool(volume.block[at]))
            yield pd.DataFrame({
                "rule": pd.Series([None if f is None else f[1].decode() for f in found], dtype=object),
                "verdict": pd.Series([default if f is None else VERDICTS[f[2]] for f in found], dtype=object)})

    probe.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    answer = F.pandas_udf(probe, "struct<rule:string,verdict:string>")
    parts = F.struct(F.col(f"{out}.host").cast("binary").alias("host"), F.col(f"{out}.path").cast("binary").alias("path"))
    judged = taken.withColumn("__found", answer(parts))
    return judged.withColumn(out, F.struct(f"{out}.host", f"{out}.path", "__found.rule", "__found.verdict")).drop("__found")


def _by_shuffle(taken: DataFrame, array: RuleArray, default: str, out: str) -> DataFrame:
    """The same by joins on the keys of all candidates: of distinct hosts and paths, so that frequent URLs count
    once; keys of the list are unique, so adaptive execution may split a frequent one."""
    h, p = F.col("host"), F.col("path")
    distinct = taken.select(F.col(f"{out}.host").alias("host"), F.col(f"{out}.path").alias("path")).distinct()
    labels = F.split(F.right(h, F.lit(array.longest_host + 1)), r"\.", -1)
    parents = F.filter(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
        lambda x: F.octet_length(x) <= array.longest_host)
    lengths = F.array(*[F.lit(n) for n in array.path_lengths]) if array.path_lengths else F.array().cast("array<int>")
    raw = p.cast("binary")
    starts = F.transform(F.filter(lengths, lambda n: n <= F.octet_length(p)), lambda n: F.substring(raw, F.lit(1), n).cast("string"))
    asked = distinct.withColumn("_host", F.explode(parents)).withColumn("_start", F.explode(starts)).withColumn("key", F.concat("_host", "_start"))
    best = asked.join(array.rules, "key").groupBy("host", "path").agg(
        F.max(F.struct(F.length("key"), F.length("_host"), "key", "verdict")).alias("_best"))
    found = best.select(F.struct("host", "path").alias("__parts"), F.col("_best.key").alias("__rule"), F.col("_best.verdict").alias("__verdict"))
    joined = taken.join(found, F.col(out) == F.col("__parts"), "left")
    return joined.withColumn(out, F.struct(
        f"{out}.host", f"{out}.path", F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit(default)).alias("verdict"),
    )).drop("__parts", "__rule", "__verdict")


#: The list of the registered query: (verdict, host, path).
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def op11_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    array = build(spark.createDataFrame(RULES, "verdict string, host string, path string"))
    found = judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), array)
    return found.select("page_id", "filter.*")


ORACLE = """
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), parts AS (
  SELECT row_number() OVER () AS at, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), fitting AS (
  SELECT p.at, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.at ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS nth
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fitting f ON f.at = p.at AND f.nth = 1"""
