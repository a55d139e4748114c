"""Hard-negative mining: an STR-packed R-tree whose boxes bound inner products, searched best first."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlrisk.llm.common import stored
from urlrisk.plans.skew import row_ranks

#: Up to this, products and sums of whole numbers are exact in double precision.
EXACT = 2.0**53
#: (bottom, top) pairs, one after the other.
WINDOWS = "array<bigint>"


class Tree(NamedTuple):
    """A packed R-tree in arrays. Nodes of a level stand side by side, leaves first, the root last; a leaf holds
    the rows ``first`` up to ``last``, another node the nodes of that range."""

    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    low: np.ndarray  # boxes, per coordinate
    high: np.ndarray
    label_low: np.ndarray
    label_high: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaves: int


def str_order(x: np.ndarray, size: int, axes: list[int]) -> np.ndarray:
    """Sort-tile-recursive: rows sorted by the first axis, cut into slabs, each sorted by the next, and so on, so
    that every ``size`` rows in turn are a tile."""
    tiles = -(-len(x) // size)
    if not axes or tiles <= 1:
        return np.arange(len(x)) if not axes else np.argsort(x[:, axes[0]], kind="stable")
    slabs = int(np.ceil(tiles ** (1 / len(axes))))
    height = -(-tiles // slabs) * size
    order = np.argsort(x[:, axes[0]], kind="stable")
    return np.concatenate([own[str_order(x[own], size, axes[1:])] for own in np.split(order, range(height, len(x), height))])


def pack_tree(ids: np.ndarray, labels: np.ndarray, points: np.ndarray, leaf: int, fan: int, axes: int = 3) -> Tree:
    """Pack rows into leaves by STR over the label and the widest coordinates, and nodes into nodes in that order."""
    spread = np.argsort(-points.std(axis=0), kind="stable")[:axes - 1].tolist()
    order = str_order(np.concatenate([labels[:, None], points], axis=1), leaf, [0, *[a + 1 for a in spread]])
    ids, labels, points = ids[order], labels[order], points[order]
    first, last = [np.arange(0, len(ids), leaf)], [np.minimum(np.arange(leaf, len(ids) + leaf, leaf), len(ids))]
    boxes = [[f.reduceat(v, first[0], axis=0) for f, v in (
        (np.minimum, points), (np.maximum, points), (np.minimum, labels), (np.maximum, labels))]]
    base = 0
    while len(boxes[-1][0]) > 1:
        n = len(boxes[-1][0])
        starts = np.arange(0, n, fan)
        boxes.append([f.reduceat(v, starts, axis=0) for f, v in zip(
            (np.minimum, np.maximum, np.minimum, np.maximum), boxes[-1], strict=True)])
        first.append(base + starts)
        last.append(base + np.minimum(starts + fan, n))
        base += n
    low, high, label_low, label_high = (np.concatenate(b) for b in zip(*boxes, strict=True))
    return Tree(ids, labels, points, low, high, label_low, label_high, np.concatenate(first), np.concatenate(last), len(boxes[0][0]))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: in doubles if no sum can exceed their range of whole numbers."""
    if not len(a) or not len(b) or a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product of each query with any point of each box: per coordinate the
    product with one end of the box is least and that with the other greatest."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    return times(plus, low) + times(minus, high), times(plus, high) + times(minus, low)


def best_first(
    tree: Tree, score_of: Callable[[slice], np.ndarray], own_id: int, label: int, same: bool, window: tuple[int, int] | None, k: int,
    least: np.ndarray, most: np.ndarray, leaf_scores: dict[int, np.ndarray],
) -> list[tuple[int, int]]:
    """The first ``k`` (score, id) of rows of the same or of another label whose score lies in ``window``.

    Boxes wait in a queue, the greatest possible score first; those that hold no such label, miss the window or
    stay strictly below the k-th score found are pruned. ``least`` and ``most`` are the query's interval per
    node; ``leaf_scores`` keeps the scores of leaves for the query's other windows.
    """
    bottom, top = window or (-(2**63), 2**63 - 1)
    kept: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
    root = len(tree.first) - 1
    queue = [(-min(int(most[root]), top), root)]
    while queue:
        bound, node = heapq.heappop(queue)
        if len(kept) == k and -bound < kept[0][0]:
            break
        if node >= tree.leaves:
            for child in range(tree.first[node], tree.last[node]):
                a, b = tree.label_low[child], tree.label_high[child]
                if (a <= label <= b if same else not a == b == label) and most[child] >= bottom and least[child] <= top:
                    reach = min(int(most[child]), top)
                    if len(kept) < k or reach >= kept[0][0]:
                        heapq.heappush(queue, (-reach, child))
            continue
        rows = slice(tree.first[node], tree.last[node])
        if (score := leaf_scores.get(node)) is None:
            score = leaf_scores[node] = score_of(rows)
        fits = (tree.labels[rows] == label) == same
        fits &= (score >= bottom) & (score <= top) & (tree.ids[rows] != own_id)
        if len(kept) == k:
            fits &= score >= kept[0][0]
        if fits.sum() > k:  # ties at the k-th stay
            fits &= score >= -np.partition(-score[fits], k - 1)[k - 1]
        for s, i in zip(score[fits].tolist(), tree.ids[rows][fits].tolist(), strict=True):
            if len(kept) < k:
                heapq.heappush(kept, (s, -i))
            elif (s, -i) > kept[0]:
                heapq.heapreplace(kept, (s, -i))
    return [(s, -i) for s, i in sorted(kept, reverse=True)]


def visit(tree: Tree, asked: pd.DataFrame, same: bool, k: int) -> pd.DataFrame:
    """The answers of one tree to a batch of queries (aid, vec_id, label, vector, windows), a row per hit."""
    q = _points(asked["vector"])
    least, most = intervals(q, tree.low, tree.high)
    exact = q.shape[1] * float(np.abs(q).max()) * float(np.abs(tree.points).max()) < EXACT
    points, queries = (tree.points.astype(float), q.astype(float)) if exact else (tree.points, q)
    out: list[tuple[int, int, int, int]] = []
    for i, (aid, own_id, label, windows) in enumerate(zip(asked["aid"], asked["vec_id"], asked["label"], asked["windows"], strict=True)):
        leaf_scores: dict[int, np.ndarray] = {}

        def score_of(rows: slice, i: int = i) -> np.ndarray:
            return (points[rows] @ queries[i]).astype(np.int64)

        for w, window in enumerate([None] if windows is None else np.asarray(windows).reshape(-1, 2).tolist()):
            found = best_first(tree, score_of, own_id, label, same, window, k, least[i], most[i], leaf_scores)
            out += [(aid, w, score, hit) for score, hit in found]
    return pd.DataFrame(out, columns=["aid", "window", "score", "vec_id"], dtype=np.int64)


def _points(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), -1)


def quantised(vectors: DataFrame, is_anchor: Column, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, anchor, vector): floor(scale * x) of every component, as 64-bit whole numbers, and the label.

    Rows with a null id, label, vector or component or a non-finite one, and empty vectors, take no part, nor do
    those whose inner products no 64-bit number could hold. Repeats of a whole row count once.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[bytes | None] = []
            for v in batch["embedding"]:
                x = None
                if v is not None and len(v) and all(c is not None for c in v):
                    x = np.floor(scale * np.asarray(v, np.float64))
                    if not np.isfinite(x).all() or len(x) * float(np.abs(x).max()) ** 2 >= 2.0**62:
                        x = None
                out.append(None if x is None else x.astype("<i8").tobytes())
            good = np.array([v is not None for v in out], bool)
            yield pd.DataFrame({
                "vec_id": batch["vec_id"][good], "label": batch["label"][good], "anchor": batch["anchor"][good],
                "vector": pd.Series([v for v in out if v is not None], index=batch.index[good], dtype=object)})

    narrow = vectors.select(
        F.col("vec_id").cast("bigint"), label.cast("bigint").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        "embedding").where("vec_id is not null and label is not null and embedding is not null")
    return narrow.mapInPandas(run, "vec_id bigint, label bigint, anchor boolean, vector binary").distinct()


def tiled(points: DataFrame, tile: int, axes: int = 3) -> DataFrame:
    """(uid, tile) for ``points`` (uid, label, dims, vector), by STR over the table: sorted by label, cut into slabs,
    each sorted by the widest coordinate, cut, and so on by the next, down to ``tile`` rows.

    Ranks come from range partitions of narrow rows, so a label of any share spreads over many tasks. Vectors
    of different lengths are in different tiles. A tile is named by the path of its slabs.
    """
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, own in batch.groupby("dims"):
                x = _points(own["vector"]).astype(float)
                yield pd.DataFrame({"dims": dims, "dim": range(dims), "n": len(x), "s": x.sum(axis=0), "q": (x * x).sum(axis=0)})

    moments = points.select("dims", "vector").mapInPandas(sums, "dims int, dim int, n bigint, s double, q double").groupBy("dims", "dim").agg(
        F.sum("n").alias("rows"), (F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("spread"))
    place = Window.partitionBy("dims").orderBy(F.desc("spread"), "dim")
    # axes - 1 numbers per length of vectors
    chosen = moments.withColumn("_r", F.row_number().over(place)).where(F.col("_r") < axes).groupBy("dims").agg(
        F.max("rows").alias("rows"), F.sort_array(F.collect_list(F.struct("_r", "dim"))).getField("dim").alias("axes"))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [np.frombuffer(v, "<i8")[np.asarray(a, int)].tolist() for v, a in zip(batch["vector"], batch["axes"], strict=True)]
            yield batch[["uid", "dims", "rows", "label"]].assign(keys=pd.Series(keys, index=batch.index, dtype=object))

    state = points.select("uid", "dims", "label", "vector").join(chosen, "dims").mapInPandas(
        keyed, "uid bigint, dims int, rows bigint, label bigint, keys array<bigint>").withColumn("tile", F.col("dims").cast("string"))
    slabs = F.ceil(F.pow(F.ceil(F.col("rows") / tile), 1.0 / axes))
    for level in range(axes):
        key = F.coalesce(F.get("keys", F.lit(level - 1)), F.lit(0)) if level else F.col("label")
        ranked = row_ranks(state, ["tile"], [key, F.col("uid")], "_rank")
        slab = F.floor((F.col("_rank") - 1) / (F.lit(tile) * F.pow(slabs, axes - 1 - level))).cast("bigint")
        state = ranked.withColumn("tile", F.concat_ws(".", "tile", slab)).drop("_rank")
    return state.select("uid", "tile")


def _streamed(key: list[str], begin: Callable[[pd.DataFrame], object], answer: Callable[[object, pd.DataFrame], pd.DataFrame]):
    """For mapInPandas over rows sorted by ``key`` and ``ask``: a group's rows with ask 0 make something once, those with
    ask 1 are answered with it batch by batch. Holds one group's first kind of rows and one batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, made = None, [], None
        for batch in batches:
            for (*where, ask), own in batch.groupby([*key, "ask"], sort=True):
                if where != now:
                    now, held, made = where, [], None
                if not ask:
                    held.append(own)
                elif held or made is not None:
                    if made is None:
                        made, held = begin(pd.concat(held, ignore_index=True)), []
                    yield answer(made, own.reset_index(drop=True))
    return run


class Forest:
    """The tiles of a table and the directory of their boxes."""

    def __init__(self, points: DataFrame, tile: int, leaf: int, fan: int, boxes: int) -> None:
        self.leaf, self.fan = leaf, fan
        sized = stored(points.withColumn("dims", (F.octet_length("vector") / 8).cast("int")).withColumn(
            "uid", F.monotonically_increasing_id()), "rtree-points")
        self.points = stored(sized.join(tiled(sized, tile), "uid"), "rtree-tiles")

        def box(own: pd.DataFrame) -> pd.DataFrame:
            x = _points(own["vector"])
            return pd.DataFrame({
                "tile": [own["tile"].iloc[0]], "dims": [x.shape[1]], "rows": [len(x)], "low": [x.min(axis=0).tobytes()],
                "high": [x.max(axis=0).tobytes()], "label_low": [own["label"].min()], "label_high": [own["label"].max()]})

        self.directory = stored(self.points.select("tile", "label", "vector").groupBy("tile").applyInPandas(
            box, "tile string, dims int, rows bigint, low binary, high binary, label_low bigint, label_high bigint"), "rtree-boxes")
        self.chunks = max(1, -(-self.directory.count() // boxes))

    def route(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(aid, tile): the tiles that may answer a query, judged by their boxes.

        Queries meet the directory chunk by chunk. Of a tile of the query's label alone with more than ``k`` rows,
        ``k`` score its least product at least; tiles that stay strictly below cannot answer.
        """
        spark = asked.sparkSession
        parts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // self.chunks))
        chunk = F.pmod(F.xxhash64("tile"), F.lit(self.chunks))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("aid", "bigint"), ("label", "bigint"), ("vector", "binary"), ("windows", WINDOWS))]
        boxes = self.directory.withColumn("chunk", chunk).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
            "chunk", "part", "dims", F.lit(0).alias("ask"), "tile", "rows", "low", "high", "label_low", "label_high", *none)
        empty = [F.lit(None).cast(boxes.schema[c].dataType).alias(c) for c in ("tile", "rows", "low", "high", "label_low", "label_high")]
        queries = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1)))).select(
            F.col("chunk").cast("bigint"), F.pmod(F.xxhash64("aid"), F.lit(parts)).cast("int").alias("part"), "dims", F.lit(1).alias("ask"),
            *empty, "aid", "label", "vector", "windows")

        def begin(own: pd.DataFrame):
            return own, _points(own["low"]), _points(own["high"])

        def answer(made, own: pd.DataFrame) -> pd.DataFrame:
            known, low, high = made
            least, most = intervals(_points(own["vector"]), low, high)
            a, b, n = (known[c].to_numpy() for c in ("label_low", "label_high", "rows"))
            label = own["label"].to_numpy()[:, None]
            pure = (a == b)[None, :] & (a[None, :] == label)
            may = (a[None, :] <= label) & (label <= b[None, :]) if same else ~pure
            if same:
                sure = np.where(pure & (n > k)[None, :], least, np.iinfo(np.int64).min).max(axis=1)
                may &= most >= sure[:, None]
            else:
                for i, windows in enumerate(own["windows"]):
                    w = np.asarray(windows).reshape(-1, 2)
                    may[i] &= ((most[i][None, :] >= w[:, :1]) & (least[i][None, :] <= w[:, 1:])).any(axis=0)
            q, t = np.nonzero(may)
            return pd.DataFrame({"aid": own["aid"].to_numpy().astype(np.int64)[q], "tile": pd.Series(known["tile"].to_numpy()[t], dtype=object)})

        key = ["chunk", "part", "dims"]
        return boxes.unionByName(queries).repartition(*key).sortWithinPartitions(*key, "ask").mapInPandas(
            _streamed(key, begin, answer), "aid bigint, tile string")

    def search(self, asked: DataFrame, same: bool, k: int, asks_per_task: int = 20_000) -> DataFrame:
        """(aid, window, rank, score, vec_id): per query and window the first ``k``, by score and then the smaller id.

        ``asked`` has (aid, vec_id, label, dims, vector, windows). A tile's rows are one tree, made where its queries
        arrive; a tile with more than ``asks_per_task`` queries is copied to several tasks.
        """
        leaf, fan = self.leaf, self.fan
        routes = stored(self.route(asked, same, k), "rtree-routes")
        copies = routes.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / asks_per_task).cast("int").alias("_copies"))
        held = self.points.join(copies, "tile").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).select(
            "tile", "copy", F.lit(0).alias("ask"), F.lit(None).cast("bigint").alias("aid"), "vec_id", "label", "vector",
            F.lit(None).cast(WINDOWS).alias("windows"))
        queries = routes.join(copies, "tile").join(asked, "aid").select(
            "tile", F.pmod(F.xxhash64("aid"), "_copies").cast("int").alias("copy"), F.lit(1).alias("ask"), "aid", "vec_id", "label", "vector", "windows")

        def begin(own: pd.DataFrame) -> Tree:
            return pack_tree(own["vec_id"].to_numpy(), own["label"].to_numpy(), _points(own["vector"]), leaf, fan)

        key = ["tile", "copy"]
        found = held.unionByName(queries).repartition(*key).sortWithinPartitions(*key, "ask").mapInPandas(
            _streamed(key, begin, lambda tree, own: visit(tree, own, same, k)), "aid bigint, window bigint, score bigint, vec_id bigint")
        order = Window.partitionBy("aid", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("aid", "window", "rank", "score", "vec_id")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5,
    percent: tuple[int, int] = (80, 100), scale: int = 256, tile: int = 4096, leaf: int = 256, fan: int = 8, boxes: int = 2048,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, embedding, label).

    Components become floor(scale * x); a score is the inner product with the anchor, exact in whole numbers. Higher
    scores come first, ties by the smaller id. An anchor's positives are its first ``positives`` other rows of its
    label; the negatives of each are the first ``negatives`` rows of other labels whose score is at least
    ``percent[0]`` and at most ``percent[1]`` hundredths of the positive's.

    The rows are packed into tiles of about ``tile`` rows by STR, and each tile is an R-tree of ``leaf`` rows a leaf
    and ``fan`` nodes a node. Queries go to the tiles whose boxes may answer them, positives first, then all windows
    of an anchor at once; what a tile returns is at most the asked number per window, merged in a shuffle. Nothing
    is sampled or capped: a box is left out only if its interval proves that it holds no answer. On vectors without
    structure few boxes can be left out, and the work is that of comparing the anchors with all rows in blocks.

    Rows with a null id, label, vector or component, a non-finite component or an empty vector take no part, nor do
    those beyond 64-bit products. Zero vectors take part. Vectors of unequal length don't meet. Repeats of a whole
    row count once; other rows of an anchor's id are neither its positives nor its negatives. An empty table, or
    one without anchors, gives no rows.
    """
    forest = Forest(quantised(vectors, is_anchor, F.col("label") if label is None else label, scale), tile, leaf, fan, boxes)
    anchors = forest.points.where("anchor").select(F.col("uid").alias("aid"), "vec_id", "label", "dims", "vector")
    asked = anchors.withColumn("windows", F.lit(None).cast(WINDOWS))
    near = stored(forest.search(asked, True, positives).select("aid", "rank", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "rtree-positives")
    whole = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(whole * percent[0] / 100).cast("bigint"), F.floor(whole * percent[1] / 100).cast("bigint")
    windows = near.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn(
        "at", F.row_number().over(Window.partitionBy("aid").orderBy("rank")) - 1)
    by_anchor = windows.groupBy("aid").agg(
        F.flatten(F.sort_array(F.collect_list(F.struct("at", F.array("low", "high").alias("w")))).getField("w")).alias("windows"))
    found = forest.search(anchors.join(by_anchor, "aid"), False, negatives)
    return found.join(windows.select("aid", F.col("at").cast("bigint").alias("window"), "positive_id", "positive_score"), ["aid", "window"]).join(
        anchors.select("aid", F.col("vec_id").alias("anchor_id")), "aid").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth
  FROM scored WHERE same
), negative AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND p.nth <= 5
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5"""
