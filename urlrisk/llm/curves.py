"""Approximate nearest neighbours on shifted space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlrisk.llm.common import stored
from urlrisk.llm.embedding_dedup import vector_bytes
from urlrisk.plans.skew import row_ranks


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points with integer coordinates of ``bits`` bits (points x axes).

    Skilling's transform, for all points at once: undo the excess turns from the top bit down, Gray-decode
    over the axes, then interleave the bits. axes * bits must be 63 at most.
    """
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        p = q - 1
        for i in range(axes):
            flip = (x[:, i] & q) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(flip, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = high
    while q > 1:
        t = np.where((x[:, -1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(x: np.ndarray, center: np.ndarray, scale: float, curves: int, axes: int, bits: int, seed: int) -> np.ndarray:
    """Per point and curve its Hilbert key: each curve projects on ``axes`` random orthonormal directions
    of its own and shifts the grid at random. ``scale`` is the spread of a projected coordinate."""
    rng = np.random.default_rng([seed, x.shape[1], 9])
    out = np.empty((len(x), curves), np.int64)
    used = min(axes, x.shape[1])
    side = 1 << bits
    for c in range(curves):
        basis, _ = np.linalg.qr(rng.standard_normal((x.shape[1], used)))
        # a grid of +-4 spreads, shifted by up to one more
        at = (x - center) @ basis / (10.0 * scale) + 0.5 + (rng.random(used) - 0.5) / 5.0
        out[:, c] = hilbert(np.clip(np.floor(at * side), 0, side - 1), bits)
    return out


def nearest_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, allowed: np.ndarray | None, k: int):
    """Per query up to ``k`` nearest of ``x`` as (query index, id, distance); ties go to the smaller id.

    A fast pass by inner products keeps all that may be among the nearest, with room for its rounding;
    distances of those are then taken from the differences.
    """
    squares = (q * q).sum(axis=1)[:, None] - 2.0 * (q @ x.T) + (x * x).sum(axis=1)[None, :]
    squares[own[:, None] == ids[None, :]] = np.inf
    if allowed is not None:
        squares[~allowed] = np.inf
    room = 1e-9 * (1.0 + (q * q).sum(axis=1) + (x * x).sum(axis=1).max(initial=0.0))
    limit = np.partition(squares, min(k, squares.shape[1]) - 1, axis=1)[:, min(k, squares.shape[1]) - 1] if squares.shape[1] else np.zeros(len(q))
    at, of = np.nonzero((squares <= (limit + room)[:, None]) & np.isfinite(squares))
    exact = np.sqrt(((q[at] - x[of]) ** 2).sum(axis=1))
    order = np.lexsort((ids[of], exact, at))
    at, of, exact = at[order], of[order], exact[order]
    first = np.searchsorted(at, at, side="left")
    keep = np.arange(len(at)) - first < k
    return at[keep], ids[of[keep]], exact[keep]


def _points(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, curves: int = 8, axes: int = 8, bits: int = 7,
    recall: float = 0.95, sample: int = 96, block: int = 4096, seed: int = 9,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query by Euclidean distance.

    ``vectors`` has (vec_id, embedding); ``is_query`` selects the queries among its rows. Every row gets a
    position on ``curves`` Hilbert curves through differently projected and shifted grids; positions are
    ranks from a range partitioning. A query's candidates are the rows within a window of ranks around it
    on any curve; they are reranked by exact distance in double precision.

    The window is fitted: for about ``sample`` queries, chosen by a hash and compared with all rows, it is
    the distance in rank on their best curve that holds a share ``recall`` of their true neighbours. On
    data of low intrinsic dimension that is a small part of the rows; on vectors without structure no
    index can do with few candidates and the window widens until the search is sound.

    Work is dealt in blocks of ``block`` ranks. A task holds one block and streams the queries whose
    windows reach it; per query and block it returns at most ``k`` rows.

    Only vectors of one length have a distance: each length has curves, a window and blocks of its own, and
    the driver holds a centre and ``sample`` queries of each. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without id, take no part. A row is no candidate of queries with its
    own id; repeated rows count once. Ties go to the smaller id; fewer candidates give fewer rows.
    """
    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [vector_bytes(v) for v in batch["embedding"]]
            good = np.array([r is not None for r in raw], bool)
            yield pd.DataFrame({
                "vec_id": batch["vec_id"][good], "query": batch["query"][good],
                "vector": pd.Series([r for r in raw if r is not None], index=batch.index[good], dtype=object)})

    narrow = vectors.where(F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint"), F.coalesce(is_query, F.lit(False)).alias("query"), "embedding")
    points = stored(narrow.mapInPandas(clean, "vec_id bigint, query boolean, vector binary").withColumn(
        "uid", F.monotonically_increasing_id()).withColumn("dims", (F.octet_length("vector") / 8).cast("int")), "points")

    # centre and spread per length: sums over all rows
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, own in batch.groupby("dims"):
                x = _points(own["vector"])
                yield pd.DataFrame({"dims": dims, "dim": range(-2, dims), "total": [float((x * x).sum()), float(len(x)), *x.sum(axis=0)]})

    got = points.select("dims", "vector").mapInPandas(sums, "dims int, dim int, total double").groupBy("dims", "dim").agg(
        F.sum("total").alias("total")).groupBy("dims").agg(F.sort_array(F.collect_list(F.struct("dim", "total"))).getField("total").alias("t")).collect()
    if not got:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = {r["dims"]: int(r["t"][1]) for r in got}
    grid: dict[int, tuple[np.ndarray, float]] = {}
    for r in got:
        center = np.array(r["t"][2:]) / rows[r["dims"]]
        spread = max(r["t"][0] / rows[r["dims"]] - float(center @ center), 0.0) / r["dims"]
        grid[r["dims"]] = center, max(float(np.sqrt(spread)), 1e-12)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, own in batch.groupby("dims"):
                keys = curve_keys(_points(own["vector"]), *grid[dims], curves, axes, bits, seed)
                yield pd.DataFrame({
                    "uid": np.repeat(own["uid"].to_numpy(), curves), "dims": dims, "curve": np.tile(np.arange(curves), len(own)), "key": keys.ravel()})

    along = points.select("uid", "dims", "vector").mapInPandas(keyed, "uid bigint, dims int, curve int, key bigint")
    ranks = stored(row_ranks(along, ["dims", "curve"], [F.col("key"), F.col("uid")], "at").select("uid", "curve", "at"), "curve-ranks")

    windows = _windows(points, ranks, rows, k, sample, recall)
    # one row per length
    sizes = F.broadcast(vectors.sparkSession.createDataFrame([(d, n, windows.get(d, 0)) for d, n in rows.items()], "dims int, rows bigint, window bigint"))
    placed = ranks.join(points, "uid").withColumn("own", F.floor(F.col("at") / block))
    blocks = F.sequence(F.floor(F.greatest(F.col("at") - F.col("window"), F.lit(0)) / block), F.floor(F.least(F.col("at") + F.col("window"), F.col("rows")) / block))
    asked = placed.where("query").join(sizes, "dims").withColumn("block", F.explode(blocks)).select(
        "dims", "curve", "block", F.lit(1).alias("ask"), "at", "vec_id", "vector")
    held = placed.select("dims", "curve", F.col("own").alias("block"), F.lit(0).alias("ask"), "at", "vec_id", "vector")

    def reranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by block, its own rows before the queries; holds one block and one batch."""
        now, parts, block_of = None, [], None
        for batch in batches:
            out = []
            for (*where, ask), own in batch.groupby(["dims", "curve", "block", "ask"], sort=True):
                if where != now:
                    now, parts, block_of = where, [], None
                if not ask:
                    parts.append((_points(own["vector"]), own["vec_id"].to_numpy(), own["at"].to_numpy()))
                    continue
                if not parts:
                    continue
                if block_of is None:
                    block_of = [np.concatenate(p) for p in zip(*parts, strict=True)]
                x, ids, at = block_of
                for a in range(0, len(own), 512):
                    part = own.iloc[a:a + 512]
                    near = np.abs(part["at"].to_numpy()[:, None] - at[None, :]) <= windows[where[0]]
                    q, found, score = nearest_of(_points(part["vector"]), x, ids, part["vec_id"].to_numpy(), near, k)
                    out.append(pd.DataFrame({"query_id": part["vec_id"].to_numpy()[q], "vec_id": found, "score": score}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = held.unionByName(asked).repartition("dims", "curve", "block").sortWithinPartitions("dims", "curve", "block", "ask").mapInPandas(
        reranked, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= k).dropDuplicates(["query_id", "vec_id", "score"])
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(points: DataFrame, queries: list[tuple[int, bytes]], k: int) -> DataFrame:
    """(query_id, vec_id, uid, score): the exact neighbours of a few queries, by one pass over all rows."""
    by_size: dict[int, list[tuple[int, bytes]]] = {}
    for i, v in queries:
        by_size.setdefault(len(v), []).append((i, v))
    asked = {n: (np.array([i for i, _ in own], np.int64), _points([v for _, v in own])) for n, own in by_size.items()}

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, own in batch.groupby(batch["vector"].map(len)):
                if size not in asked:
                    continue
                ids, x = asked[size]
                allowed = ids[:, None] != own["vec_id"].to_numpy()[None, :]
                q, at, score = nearest_of(x, _points(own["vector"]), np.arange(len(own)), np.full(len(x), -1), allowed, k)
                yield pd.DataFrame({
                    "query_id": ids[q], "vec_id": own["vec_id"].to_numpy()[at], "uid": own["uid"].to_numpy()[at], "score": score})

    order = Window.partitionBy("query_id").orderBy("score", "vec_id", "uid")
    some = points.select("uid", "vec_id", "vector").mapInPandas(nearest, "query_id bigint, vec_id bigint, uid bigint, score double")
    return some.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def _windows(points: DataFrame, ranks: DataFrame, rows: dict[int, int], k: int, sample: int, recall: float) -> dict[int, int]:
    """Per length of vectors that has queries: how far apart in rank, on their best curve, ``recall`` of the sample's
    neighbours stand."""
    drawn = Window.partitionBy("dims").orderBy(F.xxhash64("vec_id"), "uid")
    few = points.where("query").select("dims", "vec_id", "vector", "uid").withColumn("_n", F.row_number().over(drawn)).where(F.col("_n") <= sample).collect()
    if not few:
        return {}
    spark = points.sparkSession
    truth = brute_force(points, [(r["vec_id"], bytes(r["vector"])) for r in few], k).select("query_id", F.col("uid").alias("_near"))
    own = spark.createDataFrame([(r["vec_id"], r["uid"], r["dims"]) for r in few], "query_id bigint, _from bigint, dims int")
    # ``sample`` x ``k`` rows per length at most
    pairs = truth.join(F.broadcast(own), "query_id")
    wanted = F.broadcast(pairs.select(F.explode(F.array("_near", "_from")).alias("uid")).distinct())
    where = ranks.join(wanted, "uid")
    gaps = pairs.join(where.select(F.col("uid").alias("_from"), "curve", F.col("at").alias("_a")), "_from").join(
        where.select(F.col("uid").alias("_near"), "curve", F.col("at").alias("_b")), ["_near", "curve"])
    best = gaps.groupBy("dims", "query_id", "_from", "_near").agg(F.min(F.abs(F.col("_a") - F.col("_b"))).alias("gap")).select("dims", "gap").collect()
    found: dict[int, list[int]] = {r["dims"]: [] for r in few}
    for r in best:
        found[r["dims"]].append(r["gap"])
    return {d: min(rows[d], int(np.ceil(np.quantile(gap, recall)))) if gap else 0 for d, gap in found.items()}


def op9_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.pmod(F.col("vec_id"), F.lit(100)) == 0)
