"""Near-duplicate documents: an n-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlrisk.llm.common import light_batches, row_key, stored, utf8
from urlrisk.llm.links import components

#: Numbers of the hashed frequency table, and parts it travels in.
BUCKETS, PARTS = 1 << 19, 8
#: At most this many ids are broadcast; more are joined by shuffle, with the same result.
BROADCAST_ROWS = 1_000_000
_SHINGLES_AT_ONCE = 1_000_000


class _Words(dict):
    """64-bit hashes of words; forgets them when there are many. Only speed depends on that."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words; of all words if there are fewer."""
    found = [] if text is None else text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out + h[i:len(h) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _frequencies(texts: DataFrame, words: int) -> np.ndarray:
    """In how many documents the shingles of each bucket occur, over all documents.

    Each task adds up its documents into one table; tables are summed 64 at a time.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, n = np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for text in batch["_text"]:
                held.append(shingles(text, words) >> np.uint64(64 - 19))
                n += len(held[-1])
                if n > _SHINGLES_AT_ONCE:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=BUCKETS)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=BUCKETS)
        task = TaskContext.get().partitionId()
        yield pd.DataFrame({"task": task, "part": range(PARTS), "counts": [p.tobytes() for p in np.split(total, PARTS)]})

    def add(own: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in own["counts"])
        return pd.DataFrame({"task": [own["task"].iloc[0] // 64], "part": [own["part"].iloc[0]], "counts": [total.tobytes()]})

    kind = "task int, part int, counts binary"
    tables = stored(texts.mapInPandas(count, kind), "shingle-counts")
    tasks = (tables.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        tables = tables.groupBy(F.floor(F.col("task") / 64).alias("_group"), "part").applyInPandas(add, kind)
        tasks = -(-tasks // 64)
    got = sorted(tables.collect(), key=lambda r: r["part"])
    return np.concatenate([np.frombuffer(bytes(r["counts"]), np.int64) for r in got]) if got else np.zeros(BUCKETS, np.int64)


def _classes_of_frequency(counts: np.ndarray) -> np.ndarray:
    """0 for buckets without a frequent shingle, then by powers of two over twice the mean."""
    floor = 2.0 * counts.mean() + 8.0
    return np.log2(np.maximum(counts / floor, 0.5)).clip(-1).astype(np.int8) + (counts > floor)


def _need(left: Column, right: Column, num: int, den: int) -> Column:
    """The least intersection of linked sets of these sizes."""
    return F.ceil((left + right) * num / (num + den))


def _least(size: int, num: int, den: int) -> int:
    """The least intersection of a set of this size with any that it links with."""
    return -(-size * num // den)


def similar_documents(
    docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), longest: int = 4, verify_cost: float = 8.0,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text).

    A document's set holds its distinct shingles of ``words`` lower-cased words (fewer words: all of them
    as one; none: empty, linked with nothing). Documents link when intersection / union is at least
    ``similarity``; component_id is the smallest id reachable by links. Links are exact up to 64-bit hashes.

    Equal sets are one class. Shingles are ordered from rare to frequent by a hashed table of counts over
    all documents, so passages that many documents share stand last. If two sets must share T shingles,
    the first |x| - T + l of each share l: a document's prefix is lengthened from l = 1 up to ``longest``,
    to where the estimated cost is least (the partners its prefix meets, plus ``verify_cost`` times those
    that can meet it l times), and then l shared prefix shingles are required before a pair is verified.
    T follows from both sizes, so the longer shingle lists of a document only count against small partners.

    Large groups of near copies are joined without all their pairs. First every document is compared with
    one document per shared prefix shingle (the one with most shared shingles); verified links give
    components. Then, per shingle, only documents outside the shingle's largest component meet the others,
    and only those of other components: what is skipped is connected already, so no link is lost that
    joins components. Sets of the documents in question are made again from their texts.

    Null texts have no shingles; repeated rows fall into one class; null ids get their component's id, or
    null when alone; an empty table gives no rows.
    """
    plain = docs.select("doc_id", "text", F.lit(None).cast("string").alias("_key"))
    return _linked(plain, words, similarity, longest, verify_cost).select("doc_id", "n_shingles", "component_id")


def _linked(
    docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), longest: int = 4, verify_cost: float = 8.0,
) -> DataFrame:
    """As ``similar_documents``, with a column ``_key`` carried along and ``root``, which names the component
    (null without shingles)."""
    light_batches(docs.sparkSession)
    num, den = similarity
    texts = docs.select(F.col("doc_id").cast("bigint"), utf8("text").alias("_text"), "_key")
    order = _classes_of_frequency(_frequencies(texts.select("_text"), words))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            size, digest, first = [], [], []
            for text in batch["_text"]:
                own = shingles(text, words)
                size.append(len(own))
                digest.append(_digest(own))
                keep = min(len(own), len(own) - _least(len(own), num, den) + longest)
                ranked = own[np.argsort(order[(own >> np.uint64(64 - 19)).astype(np.int64)], kind="stable")]
                first.append(ranked[:keep].view(np.int64))
            yield pd.DataFrame({
                "rid": np.arange(rid, rid + len(batch)), "doc_id": batch["doc_id"].astype("Int64"), "_key": batch["_key"], "n": np.array(size, np.int64),
                "digest": digest, "prefix": pd.Series(first, dtype=object)})
            rid += len(batch)

    wide = stored(texts.mapInPandas(prefixes, "rid bigint, doc_id bigint, _key string, n bigint, digest binary, prefix array<bigint>"), "prefixes")
    meta = wide.select("rid", "doc_id", "_key", "n", "digest")
    classes = stored(
        meta.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("rid").alias("rid")), "shingle-classes")
    copies = stored(meta.where("n > 0").select("rid", "digest").join(
        classes.select("digest", F.col("rid").alias("_first")), "digest").where("rid != _first").select("rid"), "copies")
    single = wide.select("rid", "n", "prefix").join(_if_small(copies), "rid", "left_anti")
    postings = _postings(single, num, den, longest, verify_cost)
    verify = _verifier(texts.select("doc_id", "_text"), meta.select("rid", "doc_id", "digest"), words, num, den)

    links = verify(_stars(postings, num, den))
    known = components(links)
    rest = verify(_across(postings, known, num, den))
    final = components(known.select("node", "root").unionAll(rest))
    joined = classes.join(final.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = joined.join(smallest, "root").select("digest", "component_id", "root")
    linked = meta.where("n > 0").join(by_class, "digest").select("doc_id", "_key", F.col("n").alias("n_shingles"), "component_id", "root")
    empty = meta.where("n = 0").select(
        "doc_id", "_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("root"))
    return linked.unionByName(empty)


def _if_small(keys: DataFrame) -> DataFrame:
    """``keys`` (narrow rows, written out) marked for broadcast if their number is within the bound."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _postings(single: DataFrame, num: int, den: int, longest: int, verify_cost: float) -> DataFrame:
    """(token, rid, n, i, ell, score): prefix shingles that several classes share.

    ``i`` is the place in the prefix, ``ell`` the matches that the class requires, ``score`` the share of
    its prefix that others share too.
    """
    listed = single.select("rid", F.posexplode("prefix").alias("i", "token"))
    met = stored(listed.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1"), "shared-shingles")
    sized = met.join(single.select("rid", "n"), "rid")
    base = F.col("n") - F.ceil(F.col("n") * num / den)
    least = F.ceil(F.col("n") * num / den)
    sums = [F.sum(F.when(F.col("i") < base + ell, F.col("df") - 1).otherwise(0)).alias(f"_c{ell}") for ell in range(1, longest + 1)]
    per = sized.groupBy("rid", "n").agg(*sums, F.sum(F.when(F.col("i") < base + 1, 1).otherwise(0)).alias("_shared"))
    cost = [F.when(least >= ell, F.col(f"_c{ell}") * (1 + verify_cost / ell)) for ell in range(1, longest + 1)]
    cheapest = F.least(*cost) if longest > 1 else cost[0]
    ell = F.lit(1)
    for e in range(longest, 0, -1):
        ell = F.when(cost[e - 1] == cheapest, e).otherwise(ell)
    chosen = per.select("rid", "n", ell.alias("ell"), (F.col("_shared") / (base + 1)).alias("score"))
    return stored(met.join(chosen, "rid").select("token", "rid", "n", "i", "ell", "score"), "postings")


def _may_link(a: str, b: str, ell: Column | int, num: int, den: int) -> Column:
    """Whether a shared shingle at these places is in both prefixes that a pair of these sizes needs."""
    need = _need(F.col(f"{a}n"), F.col(f"{b}n"), num, den)
    return (
        (need <= F.least(f"{a}n", f"{b}n")) & (F.col(f"{a}i") < F.col(f"{a}n") - need + ell) & (F.col(f"{b}i") < F.col(f"{b}n") - need + ell))


def _stars(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of every class with the most typical one of each shingle it shares."""
    hubs = postings.groupBy("token").agg(F.max(F.struct("score", "rid", "n", "i")).alias("_h")).select(
        "token", *[F.col(f"_h.{c}").alias(f"_h{c}") for c in ("rid", "n", "i")])
    met = postings.join(hubs, "token").where("rid != _hrid").where(_may_link("", "_h", 1, num, den))
    return met.select(F.greatest("rid", "_hrid").alias("a"), F.least("rid", "_hrid").alias("b")).distinct()


def _across(postings: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes in different components that share enough prefix shingles."""
    own = stored(
        postings.drop("score").join(known.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid")),
        "postings")
    sizes = own.groupBy("token", "root").agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.groupBy("token").agg(
        F.count(F.lit(1)).alias("_k"), F.max(F.struct("_n", "root")).alias("_l")).where("_k > 1").select("token", F.col("_l.root").alias("_major"))
    mixed = own.join(largest, "token")
    cols = ("rid", "n", "i", "ell", "root")
    left = mixed.where("root != _major").select("token", *[F.col(c).alias(f"_a{c}") for c in cols])
    right = mixed.select("token", "_major", *[F.col(c).alias(f"_b{c}") for c in cols])
    larger = F.when(F.struct("_an", "_arid") > F.struct("_bn", "_brid"), F.col("_aell")).otherwise(F.col("_bell"))
    met = left.join(right, "token").where(
        (F.col("_aroot") != F.col("_broot")) & ((F.col("_broot") == F.col("_major")) | (F.col("_arid") < F.col("_brid")))
        & _may_link("_a", "_b", larger, num, den))
    a, b = F.greatest("_arid", "_brid").alias("a"), F.least("_arid", "_brid").alias("b")
    return met.groupBy(a, b, larger.alias("_ell")).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= F.col("_ell")).select("a", "b")


def _verifier(texts: DataFrame, meta: DataFrame, words: int, num: int, den: int):
    """A function that keeps the pairs (a, b) of classes whose sets are similar enough.

    It brings the pairs' texts together, which take less room than their sets, and makes the sets again.
    """

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}

        def set_of(rid: int, text: bytes) -> np.ndarray:
            if rid not in held:
                if len(held) >= 64:
                    held.clear()
                held[rid] = shingles(text, words)
            return held[rid]

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["_ta"], batch["_tb"], strict=True):
                x, y = set_of(a, ta), set_of(b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * (num + den) >= num * (len(x) + len(y)))
            yield batch[["a", "b"]][np.array(keep, bool)]

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        asked = pairs.select(F.col("a").alias("rid")).unionAll(pairs.select("b")).distinct()
        asked = stored(asked.join(meta, "rid").withColumnsRenamed({"doc_id": "_id", "digest": "_digest"}), "pair-members")
        # ids may repeat; the digest tells which text is meant, and of equal rows one is enough
        named = texts.join(_if_small(asked.select("_id").distinct()), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        marked = named.mapInPandas(_digests(words), "doc_id bigint, _text binary, _digest binary")
        members = marked.join(_if_small(asked), ["_digest"]).where(F.col("doc_id").eqNullSafe(F.col("_id"))).select("rid", "_text")
        members = stored(members.groupBy("rid").agg(F.min("_text").alias("_text")), "pair-texts")
        both = pairs.join(members.select(F.col("rid").alias("a"), F.col("_text").alias("_ta")), "a").join(
            members.select(F.col("rid").alias("b"), F.col("_text").alias("_tb")), "b")
        return stored(both.mapInPandas(similar, "a bigint, b bigint"), "verified")

    return verify


def _digest(found: np.ndarray) -> bytes | None:
    """Names a set; None for the empty one."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _digests(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "_text": batch["_text"],
                "_digest": pd.Series([_digest(shingles(t, words)) for t in batch["_text"]], dtype=object)})

    return run


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one row of each component left, with all their columns.

    The row with the smallest id stays; of repeated rows with it any one; a null id counts as larger than
    all others. Documents without words are in no component and all stay.
    """
    key = "__row_key"
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    found = _linked(keyed.select("doc_id", "text", F.col(key).alias("_key")))
    first = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_key")
    winners = found.where("root is not null").groupBy("root").agg(F.min(first).alias("_w")).select(F.col("_w._key").alias(key), F.lit(False).alias("__all"))
    empty = found.where("root is null").select(F.col("_key").alias(key), F.lit(True).alias("__all")).distinct()
    joined = keyed.join(winners.unionAll(empty), key)
    nth = joined.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return nth.where(F.col("__all") | (F.col("__nth") == 1)).select(*docs.columns)


def op2_jaccard(spark, sf_dir):
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 3, 2))]) AS s
    FROM words WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pair AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
  ) JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 100 * i >= 80 * (sa.n + sb.n - i)
), reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT p.b, r.root FROM reach r JOIN pair p ON p.a = r.node
), smallest AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN size z USING (doc_id) LEFT JOIN smallest m ON m.node = d.doc_id"""
