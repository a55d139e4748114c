"""Probabilistic membership: plain, counting, sliced and fingerprint filters, vote, ageing, similarity.

Every filter is a set of integer positions. Building one is an aggregation (positions are spread by the
hash, so no group is hot; repeated items collapse before the shuffle). There are three ways to probe one,
with the same result:

* positions of a constant list become a hash-set literal;
* shipped: the filter is one array of 63-bit words, read by an uncorrelated scalar subquery, so probing
  is a projection with no shuffle;
* shuffled: the distinct items' positions are joined to the filter words, for filters of any size.

``ship_up_to`` is the largest number of positions that is shipped to every task; a larger filter is
shuffled, and 0 always shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk import catalogs as C
from urlrisk.functions import hashing as H
from urlrisk.functions import scores as S
from urlrisk.functions import text as X
from urlrisk.functions import urls as U
from urlrisk.operators import matching
from urlrisk.plans.lineage import cut
from urlrisk.plans.skew import lookup_join, semi_lookup

WORD_BITS = 63  # keeps the sign bit clear
WORDS = [f"_h{i}" for i in range(4)]
MAX_BITMAP_BITS = 1 << 27  # 16 MiB of bits: default bound of a filter that is shipped to every task
MAX_GRAMS = 1 << 20  # default bound of a trigram set that is broadcast (at most 12 bytes each)
LITERAL_GRAMS = 1 << 14  # bound of one that becomes a hash-set literal, where asked for


# -- filter shapes ---------------------------------------------------------------------------------
@dataclass(frozen=True)
class Shape:
    """Size of a filter: number of positions and hashes per item."""

    m: int
    k: int

    @staticmethod
    def plain(items: int = 316254, fp_rate: float = 0.01) -> "Shape":
        m = H.bloom_bits(items, fp_rate)
        return Shape(m, H.bloom_hashes(m, items))

    @staticmethod
    def rounded(items: int, fp_rate: float) -> "Shape":
        m = H.bloom_bits(items, fp_rate)
        return Shape(m, H.rounded_hashes(m, items))


def plain_positions(item: Column, shape: Shape) -> list[Column]:
    """Positions of the plain filter: one seeded MD5 per hash."""
    return H.seeded_positions(item, shape.m, shape.k)


def digest_columns(df: DataFrame, item: Column, prefix: str) -> DataFrame:
    """Add the four 32-bit words of the item's MD5 as ``<prefix>0..3`` (computed once, null for null)."""
    staged = df.withColumn(f"{prefix}d", F.md5(item))
    words = H.words32(F.col(f"{prefix}d"))
    return staged.withColumns({f"{prefix}{i}": w for i, w in enumerate(words)}).drop(f"{prefix}d")


def counting_positions(prefix: str, shape: Shape) -> list[Column]:
    """Positions of counting and sliced filters: double hashing on two digest words (wider for a huge filter)."""
    first, second = F.col(f"{prefix}0"), F.col(f"{prefix}1")
    if shape.m >= H.WIDE:
        first, second = H.wide_words([F.col(f"{prefix}{i}") for i in range(4)])
    return H.double_hash_positions(first, second, shape.m, shape.k)


def fingerprint_buckets(capacity: int, bucket_size: int = 4) -> int:
    """Power-of-two bucket count for a capacity."""
    return 1 << (max(1, capacity // bucket_size) - 1).bit_length()


def fingerprint_code(prefix: str, buckets: int) -> Column:
    """Position of an item in the fingerprint filter.

    The two candidate buckets are i1 and i1 xor h(fp); the pair is determined by the fingerprint and
    the smaller of the two, so that pair is the whole identity of an entry.
    """
    low = F.col(f"{prefix}2") % 256
    fp = F.when(low == 0, 1).otherwise(low).cast("bigint")
    first = F.col(f"{prefix}3") % buckets
    other = first.bitwiseXOR((fp * F.lit(0x5BD1E995).cast("bigint")) % buckets)
    return fp * F.lit(buckets).cast("bigint") + F.least(first, other)


# -- position sets ---------------------------------------------------------------------------------
class LiteralPositions:
    """Positions of a constant list as a hash-set literal."""

    def __init__(self, positions: frozenset[int]):
        self._members = ",".join(f"{p}L" for p in sorted(positions))

    def has(self, position: str) -> Column:
        """Whether the position in the named column is set (null for null)."""
        return F.expr(f"`{position}` IN ({self._members})" if self._members else f"`{position}` < 0")

    def has_all(self, positions: list[str]) -> Column:
        """Whether all positions in the named columns are set."""
        return reduce(lambda a, b: a & b, [self.has(p) for p in positions])


class BitmapPositions(LiteralPositions):
    """Positions as an array of 63-bit words.

    The one-row words table is written out first (a job), so that every reference to it is a scan of
    one row. The array enters expressions as a scalar subquery: evaluated once, never copied into rows.
    """

    def __init__(self, words: DataFrame):
        self._words = cut(words)

    def has(self, position: str) -> Column:
        return bit_at(self._words.scalar(), F.col(position))


@dataclass(frozen=True)
class ShuffledPositions:
    """Positions as the table ``(word, bits)`` of set bits, to which probes are shuffled."""

    words: DataFrame


Positions = LiteralPositions | ShuffledPositions


def bit_at(words: Column, position: Column) -> Column:
    """Bit of a words array."""
    word = F.get(words, F.floor(position / WORD_BITS).cast("int"))
    return F.getbit(word, (position % WORD_BITS).cast("int")) == 1


def with_positions(df: DataFrame, positions: list[Column], prefix: str = "_p") -> tuple[DataFrame, list[str]]:
    """Stage positions as columns, so that each is computed once; returns the column names."""
    names = [f"{prefix}{i}" for i in range(len(positions))]
    return df.withColumns(dict(zip(names, positions))), names


def position_rows(items: DataFrame, positions: list[Column]) -> DataFrame:
    """One row per item and hash."""
    return items.select(F.explode(F.array(*positions)).alias("position"))


def filter_words(positions: DataFrame, *by: str) -> DataFrame:
    """Set bits per word: ``(*by, word, bits)``."""
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), (F.col("position") % WORD_BITS).cast("int")
    )
    return (
        positions.select(*by, F.floor(F.col("position") / WORD_BITS).cast("bigint").alias("word"), bit.alias("bit"))
        .groupBy(*by, "word").agg(F.bit_or("bit").alias("bits"))
    )


def dense_words(words: DataFrame, m: int) -> DataFrame:
    """One row holding all words of an ``m``-bit filter in order."""
    every = words.sparkSession.range(m // WORD_BITS + 1).withColumnRenamed("id", "word")
    filled = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return filled.agg(F.transform(ordered, lambda w: w["bits"]).alias("words"))


def held(words: DataFrame, m: int, ship_up_to: int = MAX_BITMAP_BITS) -> Positions:
    """Position set of an ``m``-bit filter's words: shipped up to ``ship_up_to`` positions, else shuffled."""
    return BitmapPositions(dense_words(words, m)) if m <= ship_up_to else ShuffledPositions(words)


def add_flag(df: DataFrame, item: str, positions: list[Column], members: Positions, flag: str) -> DataFrame:
    """Add ``flag``: all of the item's positions are set (null for a null item).

    ``positions`` are functions of ``item`` and, where staged, of its digest columns.
    """
    if not isinstance(members, ShuffledPositions):
        staged, names = with_positions(df, positions)
        return staged.withColumn(flag, members.has_all(names)).drop(*names)
    staged = [w for w in WORDS if w in df.columns]
    distinct = df.select(item, *staged).where(F.col(item).isNotNull()).dropDuplicates([item])
    probes = distinct.select(item, F.explode(F.array(*positions)).alias("_at")).select(
        item, "_at", F.floor(F.col("_at") / WORD_BITS).cast("bigint").alias("word")
    )
    bit = F.getbit(F.col("bits"), (F.col("_at") % WORD_BITS).cast("int")) == 1
    verdicts = (
        probes.join(members.words, "word", "left")
        .groupBy(item).agg(F.min(F.coalesce(bit, F.lit(False))).alias(flag))
    )
    return lookup_join(df, verdicts, item)


# -- plain filter ----------------------------------------------------------------------------------
def build_plain(items: DataFrame, column: str, shape: Shape) -> DataFrame:
    """Words ``(word, bits)`` of the filter over the distinct items."""
    distinct = items.select(column).where(F.col(column).isNotNull()).distinct()
    return filter_words(position_rows(distinct, plain_positions(F.col(column), shape)))


def probe_plain(
    df: DataFrame, column: str, words: DataFrame, shape: Shape, flag: str = "in_filter",
    ship_up_to: int = MAX_BITMAP_BITS,
) -> DataFrame:
    """Add ``flag``: the item is possibly in the filter."""
    members = held(words, shape.m, ship_up_to)
    probed = add_flag(df, column, plain_positions(F.col(column), shape), members, flag)
    return probed.withColumn(flag, F.coalesce(flag, F.lit(False)))


def plain_stats(words: DataFrame, shape: Shape) -> DataFrame:
    """Size, bits set, load factor and estimated false-positive rate."""
    load = F.col("bits_set") / F.lit(float(shape.m))
    return words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("bits_set")).select(
        F.lit(shape.m).alias("size_bits"),
        F.lit(shape.m / 8 / 1024).alias("size_kb"),
        F.lit(shape.k).alias("hash_functions"),
        "bits_set",
        load.alias("load_factor"),
        F.pow(load, F.lit(shape.k)).alias("estimated_fpr"),
    )


# -- counting filter -------------------------------------------------------------------------------
def counting_table(items: DataFrame, column: str, shape: Shape) -> DataFrame:
    """``(position, count)``, saturating at 255; a repeated item counts every time.

    Repeats are summed before positions are expanded, so a hot item is expanded once.
    """
    weighted = items.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return _summed_positions(weighted, column, shape, "count").withColumn(
        "count", F.least(F.col("count"), F.lit(255))
    )


def _summed_positions(weighted: DataFrame, column: str, shape: Shape, out: str) -> DataFrame:
    staged = digest_columns(weighted, F.col(column), "_h")
    rows = staged.select(F.explode(F.array(*counting_positions("_h", shape))).alias("position"), "_n")
    return rows.groupBy("position").agg(F.sum("_n").alias(out))


def counting_remove(
    table: DataFrame, removed: DataFrame, column: str, shape: Shape, ship_up_to: int = MAX_BITMAP_BITS
) -> DataFrame:
    """Counters after removing each listed item once, if the filter contains it.

    An item the filter does not contain weighs zero; it is not filtered out, because a predicate on the
    probe would be pushed below the hash columns it is made of.
    """
    once = removed.select(column).where(F.col(column).isNotNull()).distinct()
    probed = counting_probe(once, column, table, shape, "_in", ship_up_to)
    weighted = probed.select(column, F.col("_in").cast("int").alias("_n"))
    minus = _summed_positions(weighted, column, shape, "_minus")
    left = F.greatest(F.col("count") - F.coalesce(F.col("_minus"), F.lit(0)), F.lit(0))
    return (
        table.join(minus, "position", "left").select("position", left.alias("count")).where("count > 0")
    )


def counting_probe(
    df: DataFrame, column: str, table: DataFrame, shape: Shape, flag: str = "in_filter",
    ship_up_to: int = MAX_BITMAP_BITS,
) -> DataFrame:
    """Add ``flag``: every counter of the item is positive."""
    members = held(filter_words(table.where("count > 0").select("position")), shape.m, ship_up_to)
    staged = digest_columns(df, F.col(column), "_h")
    probed = add_flag(staged, column, counting_positions("_h", shape), members, flag)
    return probed.withColumn(flag, F.coalesce(flag, F.lit(False))).drop(*WORDS)


# -- sliced filter ---------------------------------------------------------------------------------
@dataclass(frozen=True)
class Slices:
    """Shapes of a growing filter: each further slice has a tighter rate, and is full at 60 % fill."""

    capacity: int
    fp_rate: float = 0.01
    tighten: float = 0.8

    def shape(self, index: int) -> Shape:
        return Shape.rounded(self.capacity, self.fp_rate * self.tighten**index)

    def room(self, index: int) -> int:
        """Items after which 60 % of the slice's positions are expected to be set."""
        shape = self.shape(index)
        return max(1, int(shape.m / shape.k * 0.9162907318741551))  # -ln(0.4)

    def shapes_for(self, items: int) -> list[Shape]:
        shapes, room = [self.shape(0)], self.room(0)
        while room < items:
            shapes.append(self.shape(len(shapes)))
            room += self.room(len(shapes) - 1)
        return shapes


@dataclass(frozen=True)
class SliceTable(Sequence):
    """All slices of a filter as one table ``(slice, word, bits)``, with their shapes; a sequence of (shape, words)."""

    shapes: tuple[Shape, ...]
    words: DataFrame

    def __len__(self) -> int:
        return len(self.shapes)

    def __getitem__(self, index: int) -> tuple[Shape, DataFrame]:
        return self.shapes[index], words_of(self.words, range(len(self))[index])


def words_of(table: DataFrame, index: int) -> DataFrame:
    """Words ``(word, bits)`` of one slice."""
    return table.where(F.col("slice") == index).select("word", "bits")


def stacked(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    """Words of several slices as one table ``(slice, word, bits)``."""
    parts = [words.select(F.lit(i).alias("slice"), "word", "bits") for i, words in enumerate(tables)]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "slice int, word long, bits long"))


def place_in_slices(distinct: DataFrame, column: str, shapes: Sequence[Shape], rooms: Sequence[int], first: int = 0) -> DataFrame:
    """Add digest words, and number, size ``m`` and hashes ``k`` of the slice that takes the item: slices from ``first``
    on, by the third digest word in proportion to ``rooms``. The slices are rows, so that the plan is the same for any
    number of them."""
    share, total, lower, spans = 0, sum(rooms), 0, []
    for index, (shape, room) in enumerate(zip(shapes, rooms, strict=True)):
        share += room
        upper = (1 << 32) if index == len(rooms) - 1 else (1 << 32) * share // total
        spans.append((first + index, shape.m, shape.k, lower, upper))
        lower = upper
    table = distinct.sparkSession.createDataFrame(spans, "slice int, m long, k int, _lower long, _upper long")
    inside = (F.col("_h2") >= F.col("_lower")) & (F.col("_h2") < F.col("_upper"))
    return digest_columns(distinct, F.col(column), "_h").join(F.broadcast(table), inside).drop("_lower", "_upper")


def _slice_position(words: list[Column], index: Column) -> Column:
    """What ``counting_positions`` has at ``index``, in a slice whose size is in the column ``m``."""
    size, wide = F.col("m"), F.col("m") >= H.WIDE
    first, second = (F.when(wide, w).otherwise(n) for n, w in zip(words[:2], H.wide_words(words), strict=True))
    step = F.when(second % size == 0, F.lit(1).cast("bigint")).otherwise(second)
    return (first + index.cast("bigint") * step) % size


def slice_words(placed: DataFrame) -> DataFrame:
    """Set bits ``(slice, word, bits)`` of placed items."""
    rows = placed.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "slice", _slice_position([F.col(w) for w in WORDS], F.col("_i")).alias("position"))
    return filter_words(rows, "slice")


def build_sliced(items: DataFrame, column: str, slices: Slices) -> SliceTable:
    """Shapes and words of all slices. Runs one job to count the distinct items.

    Items are spread over the slices by hash instead of in arrival order, so slices fill side by side
    and the build needs no global ordering.
    """
    distinct = items.select(column).where(F.col(column).isNotNull()).distinct()
    shapes = slices.shapes_for(distinct.count())
    placed = place_in_slices(distinct, column, shapes, [slices.room(i) for i in range(len(shapes))])
    return SliceTable(tuple(shapes), slice_words(placed))


def probe_sliced(
    df: DataFrame, column: str, built: Sequence[tuple[Shape, DataFrame]], flag: str = "in_filter",
    ship_up_to: int = MAX_BITMAP_BITS,
) -> DataFrame:
    """Add ``flag``: any slice contains the item. Runs jobs.

    Slices are shipped together, a row each, as long as they have ``ship_up_to`` positions in all; an item looks
    through them until one contains it. To the words of a larger slice, items are shuffled.
    """
    if not isinstance(built, SliceTable):
        built = SliceTable(tuple(s for s, _ in built), stacked(df.sparkSession, [words for _, words in built]))
    words, groups, apart = cut(built.words), [], []
    for index, shape in enumerate(built.shapes):
        if shape.m > ship_up_to:
            apart.append(index)
        elif groups and sum(built.shapes[i].m for i in groups[-1]) + shape.m <= ship_up_to:
            groups[-1].append(index)
        else:
            groups.append([index])
    staged, names = digest_columns(df, F.col(column), "_h"), []
    for chosen in [*groups, *([apart] if apart else [])]:
        names.append(f"_in{len(names)}")
        rows = [(i, built.shapes[i].m, built.shapes[i].k) for i in chosen]
        shapes = df.sparkSession.createDataFrame(rows, "slice int, m long, k int")
        look = _in_shuffled if chosen is apart else _in_shipped
        staged = look(staged, column, shapes, max(k for _, _, k in rows), words, names[-1])
    found = reduce(lambda a, b: a | b, [F.coalesce(F.col(name), F.lit(False)) for name in names])
    return staged.withColumn(flag, found).drop(*names, *WORDS)


def _in_shipped(staged: DataFrame, item: str, shapes: DataFrame, most: int, words: DataFrame, flag: str) -> DataFrame:
    """Add ``flag``: one of the slices, of ``most`` hashes at most, contains the item."""
    every = shapes.withColumn("word", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("m") / WORD_BITS))))
    filled = every.join(words, ["slice", "word"], "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    dense = cut(filled.groupBy("slice", "m", "k").agg(F.transform(ordered, lambda w: w["bits"]).alias("_words")))
    asked = [F.col(w).outer() for w in WORDS]
    hits = [(F.col("k") <= i) | bit_at(F.col("_words"), _slice_position(asked, F.lit(i))) for i in range(most)]
    return staged.withColumn(flag, F.broadcast(dense).where(reduce(lambda a, b: a & b, hits)).exists())


def _in_shuffled(staged: DataFrame, item: str, shapes: DataFrame, most: int, words: DataFrame, flag: str) -> DataFrame:
    """The same by shuffles, for slices of any size."""
    distinct = staged.select(item, *WORDS).where(F.col(item).isNotNull()).dropDuplicates([item])
    at = _slice_position([F.col(w) for w in WORDS], F.col("_i"))
    probes = distinct.crossJoin(F.broadcast(shapes)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        item, "slice", at.alias("_at")).withColumn("word", F.floor(F.col("_at") / WORD_BITS).cast("bigint"))
    bit = F.getbit(F.col("bits"), (F.col("_at") % WORD_BITS).cast("int")) == 1
    verdicts = (
        probes.join(words, ["slice", "word"], "left")
        .groupBy(item, "slice").agg(F.min(F.coalesce(bit, F.lit(False))).alias("_all"))
        .groupBy(item).agg(F.max("_all").alias(flag))
    )
    return lookup_join(staged, verdicts, item)


def _slice_flag(staged: DataFrame, item: str, slices: list[tuple[Shape, Positions]], flag: str) -> DataFrame:
    names = [f"_slice{i}" for i in range(len(slices))]
    for name, (shape, members) in zip(names, slices):
        staged = add_flag(staged, item, counting_positions("_h", shape), members, name)
    return staged.withColumn(flag, reduce(lambda a, b: a | b, map(F.col, names))).drop(*names)


# -- fingerprint filter ----------------------------------------------------------------------------
def fingerprint_table(items: DataFrame, column: str, buckets: int) -> DataFrame:
    """``(position, count)`` of the stored fingerprints."""
    weighted = items.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    staged = digest_columns(weighted, F.col(column), "_h")
    return (
        staged.select(fingerprint_code("_h", buckets).alias("position"), "_n")
        .groupBy("position").agg(F.sum("_n").alias("count"))
    )


def fingerprint_remove(table: DataFrame, removed: DataFrame, column: str, buckets: int) -> DataFrame:
    """Fingerprints after deleting one instance per listed item, where there is one."""
    minus = fingerprint_table(removed, column, buckets).withColumnRenamed("count", "_minus")
    left = F.col("count") - F.coalesce(F.col("_minus"), F.lit(0))
    return (
        table.join(minus, "position", "left").select("position", left.alias("count")).where("count > 0")
    )


def fingerprint_probe(
    df: DataFrame, column: str, table: DataFrame, buckets: int, flag: str = "in_filter",
    ship_up_to: int = MAX_BITMAP_BITS,
) -> DataFrame:
    """Add ``flag``: the item's fingerprint is stored."""
    members = held(filter_words(table.select("position")), buckets * 256, ship_up_to)
    staged = digest_columns(df, F.col(column), "_h")
    probed = add_flag(staged, column, [fingerprint_code("_h", buckets)], members, flag)
    return probed.withColumn(flag, F.coalesce(flag, F.lit(False))).drop(*WORDS)


# -- vote over the three filters -------------------------------------------------------------------
@dataclass(frozen=True)
class Ensemble:
    """Position sets of the three block-list filters and of the allow-list filter."""

    counting_shape: Shape
    allow_shape: Shape
    buckets: int
    counting: Positions
    slices: list[tuple[Shape, Positions]]
    fingerprints: Positions
    allow: Positions


VOTE_THRESHOLD = 0.5
CAPACITY, ALLOW_CAPACITY = 200_000, 50_000
FP_RATE, ALLOW_FP_RATE = 0.01, 0.001
COUNTING_SHAPE = Shape.rounded(CAPACITY, FP_RATE)
ALLOW_SHAPE = Shape.rounded(ALLOW_CAPACITY, ALLOW_FP_RATE)
BUCKETS = fingerprint_buckets(CAPACITY)


def constant_ensemble(
    spark: SparkSession, malicious: list[str] | None = None, safe: list[str] | None = None
) -> Ensemble:
    """Ensemble over constant lists, for at most a few thousand entries.

    Their positions are evaluated on the driver and become literals; give longer lists to ``data_ensemble``.
    """
    bad = [d.strip().lower() for d in (C.MALICIOUS_DOMAINS if malicious is None else malicious)]
    good = [d.strip().lower() for d in (C.SAFE_DOMAINS if safe is None else safe)]

    counting = LiteralPositions(_constant_positions(spark, tuple(bad), "counting"))
    return Ensemble(
        COUNTING_SHAPE, ALLOW_SHAPE, BUCKETS, counting, [(COUNTING_SHAPE, counting)],
        LiteralPositions(_constant_positions(spark, tuple(bad), "fingerprint")),
        LiteralPositions(_constant_positions(spark, tuple(good), "allow")),
    )


_CONSTANT: dict[tuple, frozenset[int]] = {}


def _constant_positions(spark: SparkSession, names: tuple[str, ...], kind: str) -> frozenset[int]:
    """Positions of a constant list, remembered per list: they depend on nothing else."""
    if (names, kind) not in _CONSTANT:
        rows = [(n,) for n in names if n]
        positions = {
            "counting": lambda: counting_positions("_h", COUNTING_SHAPE),
            "allow": lambda: counting_positions("_h", ALLOW_SHAPE),
            "fingerprint": lambda: [fingerprint_code("_h", BUCKETS)],
        }[kind]
        local = digest_columns(spark.createDataFrame(rows, "item string"), F.col("item"), "_h")
        found = local.select(F.array(*positions())).collect()
        _CONSTANT[(names, kind)] = frozenset(p for (group,) in found for p in group)
    return _CONSTANT[(names, kind)]


def _capacity(items: DataFrame, column: str, given: int | None, least: int) -> int:
    """The given capacity, else the counted entries but no less than the design size. May run a job."""
    return given or max(least, items.agg(F.count(column)).first()[0])


def data_ensemble(
    malicious: DataFrame, safe: DataFrame, column: str = "pattern", removed: DataFrame | None = None,
    capacity: int | None = None, allow_capacity: int | None = None, fp_rate: float = FP_RATE,
    allow_fp_rate: float = ALLOW_FP_RATE, ship_up_to: int = MAX_BITMAP_BITS,
) -> Ensemble:
    """Ensemble over lists given as data, sized by the capacities (by default: counted).

    Removal reaches the counting and fingerprint filters only; the sliced filter grows and never shrinks.
    """
    capacity = _capacity(malicious, column, capacity, CAPACITY)
    allow_capacity = _capacity(safe, column, allow_capacity, ALLOW_CAPACITY)
    shape, allow_shape = Shape.rounded(capacity, fp_rate), Shape.rounded(allow_capacity, allow_fp_rate)
    buckets = fingerprint_buckets(capacity)
    counting = counting_table(malicious, column, shape)
    fingerprints = fingerprint_table(malicious, column, buckets)
    if removed is not None:
        counting = counting_remove(counting, removed, column, shape, ship_up_to)
        fingerprints = fingerprint_remove(fingerprints, removed, column, buckets)
    sliced = build_sliced(malicious, column, Slices(capacity, fp_rate))
    allowed = counting_table(safe, column, allow_shape)

    def hold(positions: DataFrame, m: int) -> Positions:
        return held(filter_words(positions.select("position")), m, ship_up_to)

    return Ensemble(
        shape, allow_shape, buckets,
        hold(counting, shape.m),
        [(s, held(words, s.m, ship_up_to)) for s, words in sliced],
        hold(fingerprints, buckets * 256),
        hold(allowed, allow_shape.m),
    )


def vote(df: DataFrame, host: str, ensemble: Ensemble) -> DataFrame:
    """Add the votes, ``bloom_score`` and ``bloom_result``; all null where the host is null."""
    staged = digest_columns(df, F.col(host), "_h")
    filters: dict[str, tuple[Callable[[], list[Column]], Positions]] = {
        "allow": (lambda: counting_positions("_h", ensemble.allow_shape), ensemble.allow),
        "fingerprint": (lambda: [fingerprint_code("_h", ensemble.buckets)], ensemble.fingerprints),
        "counting": (lambda: counting_positions("_h", ensemble.counting_shape), ensemble.counting),
    }
    for name, (positions, members) in filters.items():
        staged = add_flag(staged, host, positions(), members, f"vote_{name}")
    first_shape, first = ensemble.slices[0]
    if len(ensemble.slices) == 1 and first is ensemble.counting and first_shape == ensemble.counting_shape:
        staged = staged.withColumn("vote_sliced", F.col("vote_counting")).drop(*WORDS)  # the same positions
    else:
        staged = _slice_flag(staged, host, ensemble.slices, "vote_sliced").drop(*WORDS)
    score = F.lit(0.0)
    for name, weight in C.VOTE_WEIGHTS.items():
        score = score + F.when(F.col(f"vote_{name}"), weight).otherwise(0.0)
    known = F.col(host).isNotNull()
    staged = staged.withColumn(
        "bloom_score", F.when(known, F.when(F.col("vote_allow"), 0.0).otherwise(score))
    )
    result = (
        F.when(F.col("vote_allow"), "KNOWN_SAFE").when(F.col("bloom_score") >= VOTE_THRESHOLD, "KNOWN_MALICIOUS")
        .otherwise("UNCERTAIN")
    )
    return staged.withColumn("bloom_result", F.when(known, result))


def ensemble_stats(
    malicious: DataFrame, safe: DataFrame, column: str = "pattern", capacity: int | None = None,
    fp_rate: float = FP_RATE,
) -> DataFrame:
    """Entries and loads of the ensemble's filters, its slices, weights and threshold; one row."""
    capacity = _capacity(malicious, column, capacity, CAPACITY)
    shape, buckets = Shape.rounded(capacity, fp_rate), fingerprint_buckets(capacity)
    slices = len(Slices(capacity, fp_rate).shapes_for(malicious.agg(F.count_distinct(column)).first()[0]))
    fingerprints = fingerprint_table(malicious, column, buckets).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("blacklist_entries")
    )
    counters = counting_table(malicious, column, shape).agg(F.count(F.lit(1)).alias("nonzero"))
    allow = safe.agg(F.count(column).alias("whitelist_entries"))
    entries = F.col("blacklist_entries")
    return allow.select(
        fingerprints.scalar().alias("blacklist_entries"), "whitelist_entries", counters.scalar().alias("nonzero")
    ).select(
        "blacklist_entries",
        "whitelist_entries",
        F.bround(entries / F.lit(float(buckets * 4)), 3).alias("fingerprint_load"),
        F.bround(F.col("nonzero") / F.lit(float(shape.m)), 3).alias("counting_load"),
        F.lit(slices).alias("slices"),
        F.lit(VOTE_THRESHOLD).alias("threshold"),
        *[F.lit(weight).alias(f"weight_{name}") for name, weight in C.VOTE_WEIGHTS.items()],
    )


# -- similarity, ageing, verdict -------------------------------------------------------------------
@dataclass(frozen=True)
class Grams:
    """Known trigrams ``(gram, _hit)``, written out, and whether they are few enough to broadcast; ``members`` is their
    list as SQL text if they are few enough for a literal."""

    rows: DataFrame
    few: bool
    members: str | None = None


def hold_grams(distinct: DataFrame, broadcast_up_to: int = MAX_GRAMS, literal_up_to: int = 0) -> Grams:
    """Write out and count distinct trigrams; collects at most ``literal_up_to`` of them. Runs two jobs or three."""
    rows = cut(distinct.select("gram"))
    count, members = rows.count(), None
    if literal_up_to and count <= min(literal_up_to, broadcast_up_to):
        quoted = (r["gram"].replace("\\", "\\\\").replace("'", "\\'") for r in rows.orderBy("gram").collect())
        members = ", ".join(f"'{gram}'" for gram in quoted)
    return Grams(rows.withColumn("_hit", F.lit(1.0)), count <= broadcast_up_to, members)


def known_grams(known: DataFrame, url: str = "url") -> DataFrame:
    """Distinct trigrams of known URLs (at most the cube of the alphabet)."""
    return known.select(F.explode(X.trigrams(F.col(url))).alias("gram")).distinct()


def trigram_similarity(
    df: DataFrame, known: DataFrame, url: str = "url", out: str = "similarity", broadcast_up_to: int = MAX_GRAMS,
    literal_up_to: int = 0,
) -> DataFrame:
    """Add the share of the URL's trigrams that occur in any known URL (0 for very short URLs). Exact."""
    return gram_share(df, hold_grams(known_grams(known, url), broadcast_up_to, literal_up_to), url, out)


def trigram_similarity_sketch(
    df: DataFrame, known: DataFrame, shape: Shape, url: str = "url", out: str = "similarity",
    ship_up_to: int = MAX_BITMAP_BITS, broadcast_up_to: int = MAX_GRAMS,
) -> DataFrame:
    """The same share, with known trigrams held in a filter that the distinct trigrams of ``df`` probe."""
    bad = digest_columns(known_grams(known, url), F.col("gram"), "_h")
    words = filter_words(position_rows(bad, counting_positions("_h", shape)))
    asked = digest_columns(known_grams(df, url), F.col("gram"), "_h")
    probed = add_flag(asked, "gram", counting_positions("_h", shape), held(words, shape.m, ship_up_to), "_in")
    hits = cut(probed.select("gram", "_in")).where("_in")
    return gram_share(df, hold_grams(hits, broadcast_up_to), url, out)


def gram_share(df: DataFrame, grams: Grams, url: str = "url", out: str = "similarity") -> DataFrame:
    """Add the share of each URL's trigrams that are in ``grams``.

    A few thousand trigrams are a hash-set literal, so that the share is a projection of the URL. More are
    broadcast: distinct URLs are shuffled once and expanded where they lie. Many are shuffled, and with them
    only two 64-bit hashes of each URL, never its text.
    """
    if grams.members is not None:
        hits = F.expr(f"size(filter(_grams, g -> g IN ({grams.members})))") if grams.members else F.lit(0)
        staged = df.withColumn("_grams", X.trigrams(F.col(url)))
        shares = F.when(F.size("_grams") > 0, hits / F.size("_grams").cast("double"))
        return staged.withColumn(out, F.coalesce(shares, F.lit(0.0))).drop("_grams")
    share = F.sum(F.coalesce(F.col("_hit"), F.lit(0.0))) / F.count(F.lit(1))
    if grams.few:
        urls = df.select(url).where(F.col(url).isNotNull()).distinct()
        asked = urls.select(url, F.explode(X.trigrams(F.col(url))).alias("gram"))
        shares = asked.join(F.broadcast(grams.rows), "gram", "left").groupBy(url).agg(share.alias(out))
        joined = lookup_join(df, shares, url)
    else:
        keys = {"_k0": F.xxhash64(url), "_k1": F.xxhash64(F.lit("second"), url)}
        urls = df.where(F.col(url).isNotNull()).select(*[k.alias(n) for n, k in keys.items()], X.trigrams(F.col(url)).alias("_grams"))
        asked = urls.dropDuplicates([*keys]).select(*keys, F.explode("_grams").alias("gram"))
        shares = asked.join(grams.rows, "gram", "left").groupBy(*keys).agg(share.alias(out))
        joined = df.withColumns(keys).join(shares, [*keys], "left").drop(*keys)
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


@dataclass(frozen=True)
class Learned:
    """The learned filter: URL positions and known trigrams, prepared once for any number of batches."""

    shape: Shape
    members: Positions
    grams: Grams


def learn(
    known: DataFrame, shape: Shape | None = None, url: str = "url", ship_up_to: int = MAX_BITMAP_BITS,
    broadcast_up_to: int = MAX_GRAMS, literal_up_to: int = LITERAL_GRAMS,
) -> Learned:
    """Build the learned filter of known malicious URLs. Runs jobs."""
    shape = shape or Shape.plain()
    members = held(build_plain(known, url, shape), shape.m, ship_up_to)
    return Learned(shape, members, hold_grams(known_grams(known, url), broadcast_up_to, literal_up_to))


def trigram_signature(url: Column) -> Column:
    """60-bit hash of the sorted trigrams: URLs with the same trigram set share it."""
    digest = F.md5(F.array_join(F.array_sort(X.trigrams(url)), ""))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def minhash_similarity(left: Column, right: Column, hashes: int = 10) -> Column:
    """Estimated Jaccard similarity of two URLs' trigram sets, for pairs that are already side by side."""
    a, b = H.minhash(X.trigrams(left), hashes), H.minhash(X.trigrams(right), hashes)
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: F.coalesce(e, F.lit(False)))
    return F.size(same) / F.lit(float(hashes))


def aged_entries(entries: DataFrame, as_of: Column, out: str = "effective_score") -> DataFrame:
    """Add the decayed score of threat entries at ``as_of``."""
    return entries.withColumn(out, S.decayed(F.col("score"), F.col("inserted_at"), as_of))


def expired_count(entries: DataFrame, as_of: Column, threshold: float = 0.1) -> DataFrame:
    """One row: entries that the expiry removes and keeps."""
    gone = F.col("effective_score") < threshold
    return aged_entries(entries, as_of).agg(
        F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept")
    )


def drop_expired(entries: DataFrame, as_of: Column, threshold: float = 0.1) -> DataFrame:
    """Entries whose decayed score is still at or above the threshold."""
    return aged_entries(entries, as_of).where(F.col("effective_score") >= threshold).drop("effective_score")


def constraints_met(
    url: Column, entropy: Column, depth: Column, pattern_score: Column | None = None,
    has_ip: Column | None = None,
) -> Column:
    """Number of suspicion constraints that hold, of five; a missing input never holds."""
    tld = F.lit(False)
    for suffix in C.CONSTRAINT_TLDS:
        tld = tld | F.endswith(url, F.lit(suffix))
    tests = [entropy > 4.0, tld, depth > 2]
    if pattern_score is not None:
        tests.append(pattern_score > 0.1)
    if has_ip is not None:
        tests.append(has_ip)
    total = F.lit(0)
    for test in tests:
        total = total + F.coalesce(test, F.lit(False)).cast("int")
    return total


def membership(
    df: DataFrame, known: DataFrame | Learned, shape: Shape | None = None, blacklist: DataFrame | None = None,
    url: str = "url", entries: DataFrame | None = None, as_of: Column | None = None,
) -> DataFrame:
    """Composite membership of URLs in the learned filter.

    Adds ``in_filter``, ``similarity``, ``in_blacklist`` and ``possibly_malicious``. With threat ``entries``
    ``(url, score, inserted_at)`` also ``effective_score``: the decayed score at ``as_of`` of the URL's latest
    entry, 0 for a URL without one.
    """
    learned = known if isinstance(known, Learned) else learn(known, shape, url)
    positions = plain_positions(F.col(url), learned.shape)
    probed = add_flag(df, url, positions, learned.members, "in_filter")
    probed = probed.withColumn("in_filter", F.coalesce("in_filter", F.lit(False)))
    probed = gram_share(probed, learned.grams, url)
    if blacklist is None:
        probed = probed.withColumn("in_blacklist", F.lit(False))
    else:
        probed = matching.member_flag(probed, blacklist, url)
    if entries is not None:
        latest = entries.groupBy("url").agg(F.max(F.struct("inserted_at", "score")).alias("_e"))
        aged = aged_entries(latest.select(F.col("url").alias(url), "_e.*"), as_of)
        probed = lookup_join(probed, aged.select(url, "effective_score"), url)
        probed = probed.withColumn("effective_score", F.coalesce("effective_score", F.lit(0.0)))
    return probed.withColumn(
        "possibly_malicious", F.col("in_filter") | (F.col("similarity") > 0.92) | F.col("in_blacklist")
    )


def membership_verdict(possibly: Column, constraints: Column) -> Column:
    """malicious when verified (three constraints or more), suspicious when only possible, else unknown."""
    return (
        F.when(possibly & (constraints >= 3), "malicious").when(possibly, "suspicious").otherwise("unknown")
    )


def verified_urls(verdicts: DataFrame, url: str = "url", verdict: str = "membership_verdict") -> DataFrame:
    """URLs to append to the verified blacklist."""
    return verdicts.where(F.col(verdict) == "malicious").select(url).distinct()


def host_key(df: DataFrame, url: str = "url", out: str = "domain", host_mode: str = "charstrip") -> DataFrame:
    """Add the host key that the filters are keyed by."""
    return df.withColumn(out, U.domain(F.col(url), host_mode))
