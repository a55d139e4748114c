"""Near-duplicate embeddings: Euclidean p-stable hashing with exact cosine checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import stored
from urlrisk.llm.links import components

_KEYED = "vec_id bigint, label string, digest binary, vector binary"


def vector_bytes(value) -> bytes | None:
    """The vector as doubles; None if it is null, empty, zero, or holds null or non-finite components."""
    if value is None or not len(value):
        return None
    try:
        v = np.asarray(value, dtype=np.float64)
    except (TypeError, ValueError):
        return None
    return v.tobytes() if np.isfinite(v).all() and v.any() else None


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows of unit length. Scaled by the largest component first, so that squares don't over- or underflow."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def buckets(x: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """One 64-bit bucket key per unit vector and table: quantised projections on Gaussian directions."""
    rng = np.random.default_rng([seed, x.shape[1]])
    directions = rng.standard_normal((x.shape[1], tables * hashes))
    offsets = rng.random(tables * hashes) * width
    cells = np.floor((x @ directions + offsets) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, hashes)
    odd = rng.integers(1, 2**63, (tables, hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (cells * odd).sum(axis=2, dtype=np.uint64) + rng.integers(1, 2**63, tables, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return mixed.view(np.int64)


def _roots(hit: np.ndarray) -> np.ndarray:
    """Per member the smallest member it is connected to by a symmetric matrix of hits."""
    label = np.arange(len(hit))
    while True:
        low = np.where(hit, label[None, :], len(hit)).min(axis=1, initial=len(hit))
        fresh = np.minimum(label, low)
        fresh = np.minimum(fresh, fresh[fresh])
        if (fresh == label).all():
            return label
        label = fresh


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, tables: int = 32, hashes: int = 10, width: float = 1.0,
    block: int = 256, seed: int = 4,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label).

    Rows link if their labels are equal and their cosine is ``threshold`` or more. Equal vectors of a label
    are one class, which stands for all its rows. Unit vectors are hashed into ``tables`` tables by
    ``hashes`` quantised random projections each; classes that share a bucket are compared exactly, in
    double precision. At cosine 0.98 a pair shares no bucket with a chance of about 0.2 % (defaults).

    A bucket of any size is dealt out as pairs of blocks of about ``block`` classes, so no task holds a
    whole bucket. Each pair of classes counts in the first table where it meets. A block pair returns, per
    class, its number of links and one connection to the smallest class it reaches there: rows in
    proportion to the members, not the pairs. Nothing is capped.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label,
    link with nothing: no links, their own id as component. Vectors of unequal length don't link. Repeated
    rows are vectors of their own that link with each other; a null id counts as a link but is never the
    component's id unless it stands alone.
    """
    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [vector_bytes(v) for v in batch["embedding"]]
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"],
                "digest": [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw],
                "vector": pd.Series(raw, dtype=object)})

    # the label travels as text, as a column of numbers with nulls would not keep its type; in hex, as it may be no UTF-8
    label = F.hex(F.col("label").cast("string").cast("binary")).alias("label")
    narrow = vectors.select(F.col("vec_id").cast("bigint"), "embedding", label)
    keyed = stored(narrow.mapInPandas(key, _KEYED), "vectors")
    can = F.col("digest").isNotNull() & F.col("label").isNotNull()
    rows = keyed.select("vec_id", "label", "digest")
    classes = stored(
        keyed.where(can).groupBy("label", "digest").agg(
            F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("members"), F.min("vector").alias("vector"))
        .withColumn("cid", F.monotonically_increasing_id()), "vector-classes")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, own in batch.groupby(batch["vector"].map(len)):
                at = buckets(unit(list(own["vector"])), tables, hashes, width, seed)
                yield pd.DataFrame({
                    "cid": np.repeat(own["cid"].to_numpy(), tables), "label": np.repeat(own["label"].to_numpy(), tables),
                    "dims": np.repeat(own["vector"].map(len).to_numpy(), tables),
                    "slot": np.tile(np.arange(tables), len(own)), "bucket": at.ravel()})

    place = ["label", "dims", "slot", "bucket"]
    met = classes.select("cid", "label", "vector").mapInPandas(hashed, "cid bigint, label string, dims int, slot int, bucket bigint")
    met = stored(met, "vector-buckets")
    full = met.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        *place, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    dealt = met.join(full, place).withColumn("_own", F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "cid", *place, F.col("_own"), F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    shipped = dealt.join(classes.select("cid", "members", "vector"), "cid")
    group = [*place, "_i", "_j"]

    def compare(own: pd.DataFrame) -> pd.DataFrame | None:
        x = unit(list(own["vector"]))
        side = own["_own"].to_numpy()
        hit = x @ x.T >= threshold
        np.fill_diagonal(hit, False)
        if own["_i"].iloc[0] != own["_j"].iloc[0]:
            hit &= side[:, None] != side[None, :]
        r, c = np.nonzero(hit)
        if not len(r):
            return None
        keys = buckets(x, tables, hashes, width, seed)
        new = np.zeros(len(r), bool)
        for at in range(0, len(r), 65536):
            new[at:at + 65536] = (keys[r[at:at + 65536]] == keys[c[at:at + 65536]]).argmax(axis=1) == own["slot"].iloc[0]
        cid, members = own["cid"].to_numpy(), own["members"].to_numpy()
        links = np.bincount(r[new], members[c[new]], len(own)).astype(np.int64)
        some = hit.any(axis=1)
        return pd.DataFrame({"cid": cid[some], "links": links[some], "root": cid[_roots(hit)][some]})

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups of a sorted partition, one after the other; holds one group and one batch."""
        left: pd.DataFrame | None = None
        empty = pd.DataFrame({"cid": [], "links": [], "root": []})
        for batch in batches:
            have = batch if left is None else pd.concat([left, batch], ignore_index=True)
            starts = _starts(have, group)
            found = [compare(have.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True) if b - a > 1]
            left = have.iloc[starts[-1]:] if len(starts) else have
            found = [f for f in found if f is not None]
            yield pd.concat(found, ignore_index=True) if found else empty
        if left is not None and len(left) > 1 and (last := compare(left)) is not None:
            yield last

    found = stored(
        shipped.repartition(*group).sortWithinPartitions(*group).mapInPandas(compared, "cid bigint, links bigint, root bigint"),
        "vector-links")
    stars = components(found.select("cid", "root"))
    direct = found.groupBy("cid").agg(F.sum("links").alias("_links"))
    joined = classes.select("label", "digest", "cid", "first_id", "members").join(direct, "cid", "left").join(
        stars.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    joined = stored(joined, "vector-components")
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = joined.join(smallest, "root").select(
        "label", "digest", "component_id", (F.coalesce("_links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    linked = rows.where(can).join(by_class, ["label", "digest"]).select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.where(~can).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _starts(rows: pd.DataFrame, group: list[str]) -> np.ndarray:
    """Positions where a group begins in sorted rows."""
    change = np.zeros(len(rows), bool)
    if len(rows):
        change[0] = True
    for c in group:
        v = rows[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def op4_embedding_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0
), pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.root FROM reach r JOIN pair p ON p.a = r.node
), smallest AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node
), direct AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, s.component_id, e.vec_id = s.component_id AS kept
FROM embeddings e LEFT JOIN smallest s ON s.node = e.vec_id LEFT JOIN direct d ON d.a = e.vec_id"""
