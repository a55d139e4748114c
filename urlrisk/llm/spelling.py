"""Spelling variants: generated edits probe blocked Bloom filters, an exact join confirms what they let through."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.llm.common import light_batches, stored, utf8
from urlrisk.plans.skew import lookup_join

#: Letters of words in UTF-8: A-Z is lowered first, U+00C0 to U+00FF are two bytes that start with C3.
RUN = re.compile(rb"(?:[a-z]++|(?:\xc3[\x80-\xbf])++)++")
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
#: Longer words share one shard of the filter.
LONGEST_SHARD = 64
#: 64-bit blocks of the filter that travel in one row, and bits that a word sets in its block.
CHUNK, BITS_SET = 8192, 5
#: Words a task counts before it hands them on; candidates that one vectorised pass holds.
COUNTED_AT_ONCE, EDITS_AT_ONCE = 300_000, 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CODES = {ord(c): i for i, c in enumerate(ALPHABET)}


class Filter(NamedTuple):
    """A Bloom filter in blocks of 64 bits, with a shard of its own per word length."""

    blocks: np.ndarray
    first: np.ndarray  # the first block of each shard
    count: np.ndarray  # its number of blocks


def _letters(seed: int = 12) -> np.ndarray:
    """A random odd number per letter."""
    return np.random.default_rng(seed).integers(1, 2**63, len(ALPHABET), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(length: int) -> np.ndarray:
    """_ODD to the power 0, 1, 2 ... modulo 2^64."""
    factors = np.full(length + 1, _ODD, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def codes(words: list[str]) -> np.ndarray:
    """Letter numbers of words of one length, a row each."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
    table = np.zeros(0x100, np.int64)
    for code, i in _CODES.items():
        table[code] = i
    return table[flat]


def sums(letters: np.ndarray) -> np.ndarray:
    """The hash of each word before mixing: a polynomial in _ODD over its letters, modulo 2^64."""
    return (_letters()[letters] * powers(letters.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def places(total: np.ndarray, length: int, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block numbers and the bits in them of words of a length, from their sums."""
    h = total ^ (total >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    shard = min(length, LONGEST_SHARD)
    block = np.uint64(first[shard]) + (((h >> np.uint64(32)) * np.uint64(count[shard])) >> np.uint64(32))
    mask = np.zeros(len(h), np.uint64)
    for i in range(BITS_SET):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return block, mask


def passing(total: np.ndarray, length: int, bloom: Filter) -> np.ndarray:
    """Which sums may belong to a word of the vocabulary."""
    shape = total.shape
    if not bloom.count[min(length, LONGEST_SHARD)]:
        return np.zeros(shape, bool)
    block, mask = places(total.ravel(), length, bloom.first, bloom.count)
    return ((bloom.blocks[block.astype(np.int64)] & mask) == mask).reshape(shape)


def edits(words: list[str], bloom: Filter) -> Iterator[tuple[int, str]]:
    """(word number, edit) for what the filter lets through, of words of one length: every deletion of a letter,
    and every replacement by a later one of ALPHABET.

    So each pair of words at distance one is generated by exactly one of the two: by the longer, or by the one
    whose letter comes first. Sums of edits follow from sums of beginnings and ends, without making strings.
    """
    letters = codes(words)
    n, length = letters.shape
    power = powers(length)
    terms = _letters()[letters] * power[:-1]
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    total = before[:, -1]
    back = np.uint64(pow(int(_ODD), -1, 1 << 64))
    if length > 1:
        shorter = before[:, :-1] + (total[:, None] - before[:, 1:]) * back
        # of a run of equal letters only the first deletion
        fresh = np.concatenate([np.ones((n, 1), bool), letters[:, 1:] != letters[:, :-1]], axis=1)
        for i, at in np.argwhere(passing(shorter, length - 1, bloom) & fresh).tolist():
            yield i, words[i][:at] + words[i][at + 1:]
    step = max(1, EDITS_AT_ONCE // (n * len(ALPHABET)))
    for a in range(0, length, step):
        own = letters[:, a:a + step]
        base = total[:, None] - terms[:, a:a + step]
        other = base[:, :, None] + _letters()[None, None, :] * power[a:a + own.shape[1]][None, :, None]
        later = np.arange(len(ALPHABET))[None, None, :] > own[:, :, None]
        for i, at, c in np.argwhere(later & passing(other, length, bloom)).tolist():
            yield i, words[i][:a + at] + ALPHABET[c] + words[i][a + at + 1:]


def count_words(docs: DataFrame, every: int = 97, letters: int = 5) -> DataFrame:
    """(word, n): the runs of letters of all texts, with planted slips, that have at least ``letters`` letters.

    A run whose crc32 together with its document's id is divisible by ``every`` loses the letter at that
    remainder by its length. A null id counts as an empty one; invalid UTF-8 ends a run. Each task adds up its
    own documents, so a frequent word leaves a task about once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()

        def handed() -> pd.DataFrame:
            out = pd.DataFrame({"word": pd.Series([w.decode() for w in total], dtype=object), "n": np.fromiter(total.values(), np.int64, len(total))})
            total.clear()
            return out

        for batch in batches:
            for doc_id, raw in zip(batch["_id"], batch["_text"], strict=True):
                if raw is None:
                    continue
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for word, n in Counter(RUN.findall(raw.lower())).items():
                    h = zlib.crc32(word, start)
                    if h % every == 0:
                        own = word.decode()
                        word = (own[:(at := h % len(own))] + own[at + 1:]).encode()
                    if len(word) >= letters and (word.isascii() or len(word.decode()) >= letters):
                        total[word] += n
                if len(total) > COUNTED_AT_ONCE:
                    yield handed()
        yield handed()

    light_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("string").alias("_id"), utf8("text").alias("_text"))
    return narrow.mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def bloom_of(vocabulary: DataFrame, bits_per_word: int = 32, most_bytes: int = 64 << 20) -> Filter:
    """The filter of a vocabulary (word): ``bits_per_word`` per word, ``most_bytes`` altogether.

    Beyond that the filter fills up and lets more through, which the exact join then removes. Workers name the
    bits, a shuffle puts blocks together, and the driver gets the chunks of the finished filter.
    """
    shard = F.least(F.length("word"), F.lit(LONGEST_SHARD))
    per = {r["shard"]: r["count"] for r in vocabulary.groupBy(shard.alias("shard")).count().collect()}
    wanted = np.array([-(-per.get(s, 0) * bits_per_word // 64) for s in range(LONGEST_SHARD + 1)], float)
    scale = min(1.0, (most_bytes // 8 - LONGEST_SHARD) / max(1.0, wanted.sum()))
    count = np.ceil(wanted * scale).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, words in batch["word"].groupby(batch["word"].map(len)):
                block, mask = places(sums(codes(list(words))), length, first, count)
                yield pd.DataFrame({"block": block.astype(np.int64), "mask": mask.view(np.int64)})

    def chunk(own: pd.DataFrame) -> pd.DataFrame:
        at = np.zeros(CHUNK, np.int64)
        at[own["block"].to_numpy() % CHUNK] = own["mask"].to_numpy()
        return pd.DataFrame({"chunk": [int(own["block"].iloc[0]) // CHUNK], "bits": [at.tobytes()]})

    merged = vocabulary.select("word").mapInPandas(bits, "block bigint, mask bigint").groupBy("block").agg(F.bit_or("mask").alias("mask"))
    chunks = merged.groupBy(F.floor(F.col("block") / CHUNK)).applyInPandas(chunk, "chunk bigint, bits binary").collect()
    blocks = np.zeros(-(-int(count.sum()) // CHUNK) * CHUNK, np.uint64)
    for r in chunks:
        blocks[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["bits"]), np.uint64)
    return Filter(blocks, first, count)


def near_words(vocabulary: DataFrame, bits_per_word: int = 32, most_bytes: int = 64 << 20) -> DataFrame:
    """(word, near, n, near_n): all ordered pairs of words (word, n) that differ by one inserted, deleted or replaced letter.

    The filter is broadcast (``most_bytes`` bounds it); each task probes the edits of its words, and only those
    that pass are shuffled, to a join with the vocabulary that keeps the true ones. A word has one row, so
    no key of that join is frequent on its side. Words consist of letters of ALPHABET; any number of pairs is kept.
    """
    spark = vocabulary.sparkSession
    light_batches(spark)
    sent = spark.sparkContext.broadcast(tuple(bloom_of(vocabulary, bits_per_word, most_bytes)))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bloom = Filter(*sent.value)
        for batch in batches:
            for length, own in batch.groupby(batch["word"].map(len)):
                step = max(1, EDITS_AT_ONCE // (length * len(ALPHABET)))
                for at in range(0, len(own), step):
                    part = own.iloc[at:at + step]
                    got = list(edits(list(part["word"]), bloom))
                    if got:
                        of = [i for i, _ in got]
                        yield pd.DataFrame({
                            "word": pd.Series(part["word"].to_numpy()[of], dtype=object), "n": part["n"].to_numpy()[of],
                            "near": pd.Series([e for _, e in got], dtype=object)})

    maybe = vocabulary.select("word", "n").mapInPandas(probe, "word string, n bigint, near string")
    once = maybe.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    return once.select(F.explode(F.array(
        F.struct("word", "near", "n", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("near_n").alias("n"), F.col("n").alias("near_n")),
    )).alias("pair")).select("pair.*")


def variants(docs: DataFrame, least: int = 3, letters: int = 5, every: int = 97, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root): the words of all documents with ``least`` occurrences or more.

    Two words are near if they differ by one inserted, deleted or replaced letter. A word's form is its most
    frequent near word (ties: the first in code-point order), if that has ``ratio`` times its count; root
    is reached by following forms, by doubling: as counts grow by ``ratio`` (2 or more) at each step there are at
    most log2(log2(n)) rounds. Null texts have no words, repeated rows count each, an empty table gives no rows.
    """
    vocabulary = stored(count_words(docs, every, letters).where(F.col("n") >= least), "words")
    pairs = near_words(vocabulary).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    known = stored(lookup_join(vocabulary, pairs, "word").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("best.m") >= F.col("n") * ratio, F.col("best.near")).alias("form"),
        F.when(-F.col("best.m") >= F.col("n") * ratio, -F.col("best.m")).alias("form_n")), "word-forms")
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(lookup_join(roots, step, "root").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "word-roots")
        roots = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            break
    return lookup_join(known, roots, "word").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def oracle() -> str:
    """The query in SQL. crc32 goes byte by byte with a table that SQL works out; pairs meet by what is left of a word
    without one letter."""
    return r"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(CAST(c AS UBIGINT), [CAST(0 AS UBIGINT) FOR i IN range(8)]),
    lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, CAST(3988292384 AS UBIGINT)) ELSE a >> 1 END)) AS crc
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), distinct_runs AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), [CAST(('0x' || substr(h, 2 * i + 1, 2)) AS UBIGINT) FOR i IN range(len(h) // 2)]),
    lambda a, b: xor(a >> 8, crc[CAST(xor(a, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS c
  FROM (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM distinct_runs), steps
), slipped AS (
  SELECT CASE WHEN c % 97 = 0 THEN substr(run, 1, CAST(c % length(run) AS BIGINT)) || substr(run, CAST(c % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed
), words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cuts AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form,
    CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), ways(word, place) AS (SELECT word, word FROM forms UNION ALL SELECT y.word, f.form FROM ways y JOIN forms f ON f.word = y.place WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, y.place AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN ways y ON y.word = f.word JOIN forms g ON g.word = y.place AND g.form IS NULL"""
