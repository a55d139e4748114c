"""Filters that are kept as tables and grow: batches are added and entries removed without a new build."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk import catalogs as C
from urlrisk.operators import sketches as K
from urlrisk.plans.lineage import cut
from urlrisk.plans.versions import Commit, Versions

WORDS = "word long, bits long"
COUNTS = "position long, count long"


# -- merging -----------------------------------------------------------------------------------------
def merge_words(*words: DataFrame) -> DataFrame:
    """Words of the filter that holds what any of ``words`` hold (all of one shape)."""
    return _union(words).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def merge_counts(*tables: DataFrame, limit: int | None = None) -> DataFrame:
    """Sum of counters; ``limit`` is where they saturate. Saturated counters merge as if counted at once."""
    total = F.sum("count")
    return _union(tables).groupBy("position").agg((total if limit is None else F.least(total, F.lit(limit))).cast("long").alias("count"))


def _union(tables: tuple[DataFrame, ...]) -> DataFrame:
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table.select(*every.columns))
    return every


@dataclass(frozen=True)
class GrownSlices(Sequence):
    """Per slice the items put into it, and the words of all in one table ``(slice, word, bits)``; a sequence of (items, words)."""

    counts: tuple[int, ...]
    table: DataFrame

    def __len__(self) -> int:
        return len(self.counts)

    def __getitem__(self, index: int) -> tuple[int, DataFrame]:
        return self.counts[index], K.words_of(self.table, range(len(self))[index])

    def filter(self, slices: K.Slices) -> K.SliceTable:
        return K.SliceTable(tuple(slices.shape(i) for i in range(len(self))), self.table)


def grow_slices(
    held: Sequence[tuple[int, DataFrame]], items: DataFrame, column: str, slices: K.Slices, ship_up_to: int = K.MAX_BITMAP_BITS
) -> GrownSlices:
    """``held``, per slice the items put into it and its words, after a batch of items. Runs jobs.

    Items that a slice contains already change nothing. The others are spread by hash over the room that is
    left in the last slice (60 % fill) and over as many further ones, each with a tighter rate, as they need.
    The words are written out.
    """
    if not isinstance(held, GrownSlices):
        held = GrownSlices(tuple(n for n, _ in held), K.stacked(items.sparkSession, [words for _, words in held]))
    distinct = items.select(column).where(F.col(column).isNotNull()).distinct()
    if held:
        # written out first: a predicate on the probe would be pushed below the hash columns it is made of
        distinct = cut(K.probe_sliced(distinct, column, held.filter(slices), "_in", ship_up_to)).where("not _in").select(column)
    new = cut(distinct)
    left = new.count()
    start = max(0, len(held) - 1)
    rooms = [max(0, slices.room(start) - (held.counts[start] if held else 0))]
    total = rooms[0]
    while total < left:
        rooms.append(slices.room(start + len(rooms)))
        total += rooms[-1]
    if not left:
        return held
    shapes = [slices.shape(start + offset) for offset in range(len(rooms))]
    placed = cut(K.place_in_slices(new, column, shapes, rooms, start))
    per = {r["slice"]: r["count"] for r in placed.groupBy("slice").count().collect()}
    counts = [(held.counts[i] if i < len(held) else 0) + per.get(i, 0) for i in range(start + len(rooms))]
    table = held.table.unionByName(K.slice_words(placed)).groupBy("slice", "word").agg(F.bit_or("bits").alias("bits"))
    return GrownSlices(tuple(counts), cut(table))


# -- plain filter ------------------------------------------------------------------------------------
class PlainStore:
    """A plain filter in a folder; each batch ORs its words in."""

    def __init__(self, spark: SparkSession, path: str, shape: K.Shape) -> None:
        self.versions, self.shape = Versions(spark, path), shape

    def words(self) -> DataFrame:
        """Words ``(word, bits)`` of the latest version."""
        last = self.versions.latest()
        if last is None:
            return self.versions.spark.createDataFrame([], WORDS)
        if (last.facts["m"], last.facts["k"]) != (self.shape.m, self.shape.k):
            raise ValueError(f"the stored filter has {last.facts['m']} positions and {last.facts['k']} hashes")
        return self.versions.table(last.version, "words", WORDS)

    def add(self, items: DataFrame, column: str, batch: int | None = None) -> None:
        """Add a batch of items. Runs jobs; does nothing if the numbered batch is in already."""
        if self.versions.is_taken(batch):
            return
        last, words = self.versions.latest(), self.words()
        version = 0 if last is None else last.version + 1
        self.versions.write(version, "words", merge_words(words, K.build_plain(items, column, self.shape)))
        self.versions.commit(version, _later(last, batch), {"m": self.shape.m, "k": self.shape.k})

    def probe(self, df: DataFrame, column: str, flag: str = "in_filter", ship_up_to: int = K.MAX_BITMAP_BITS) -> DataFrame:
        """Add ``flag``: the item is possibly in the filter."""
        return K.probe_plain(df, column, self.words(), self.shape, flag, ship_up_to)


def _later(last: Commit | None, batch: int | None) -> int | None:
    return (last.batch if last else None) if batch is None else batch


# -- ensemble ----------------------------------------------------------------------------------------
class EnsembleStore:
    """The vote's filters in a folder, of sizes fixed at the start; block-list entries come and go.

    Adding reaches all filters. Removing reaches the counting and fingerprint filters only, each entry once and
    only if they contain it; the sliced filter never shrinks. Counters saturate at 255.
    """

    def __init__(
        self, spark: SparkSession, path: str, capacity: int = K.CAPACITY, allow_capacity: int = K.ALLOW_CAPACITY,
        fp_rate: float = K.FP_RATE, allow_fp_rate: float = K.ALLOW_FP_RATE, ship_up_to: int = K.MAX_BITMAP_BITS,
    ) -> None:
        self.versions, self.ship_up_to = Versions(spark, path), ship_up_to
        self.sizes = {"capacity": capacity, "allow_capacity": allow_capacity, "fp_rate": fp_rate, "allow_fp_rate": allow_fp_rate}
        self.shape, self.allow_shape = K.Shape.rounded(capacity, fp_rate), K.Shape.rounded(allow_capacity, allow_fp_rate)
        self.buckets, self.slices = K.fingerprint_buckets(capacity), K.Slices(capacity, fp_rate)

    def _tables(self) -> tuple[Commit | None, dict[str, DataFrame], GrownSlices]:
        last, spark = self.versions.latest(), self.versions.spark
        if last is None:
            none = spark.createDataFrame([], COUNTS)
            return None, {"counting": none, "fingerprints": none, "allow": none}, GrownSlices((), spark.createDataFrame([], f"slice int, {WORDS}"))
        if last.facts["sizes"] != self.sizes:
            raise ValueError(f"the stored filters were made with {last.facts['sizes']}")
        tables = {name: self.versions.table(last.version, name, COUNTS) for name in ("counting", "fingerprints", "allow")}
        words = self.versions.table(last.version, "slices", f"slice int, {WORDS}")
        return last, tables, GrownSlices(tuple(last.facts["slices"]), words)

    def _write(self, last: Commit | None, batch: int | None, tables: dict[str, DataFrame], held: GrownSlices) -> None:
        version = 0 if last is None else last.version + 1
        for name, table in tables.items():
            self.versions.write(version, name, table)
        self.versions.write(version, "slices", held.table)
        self.versions.commit(version, _later(last, batch), {"sizes": self.sizes, "slices": list(held.counts)})

    def add(self, malicious: DataFrame | None = None, safe: DataFrame | None = None, column: str = "pattern", batch: int | None = None) -> None:
        """Add a batch of block-list and allow-list entries. Runs jobs; does nothing if the numbered batch is in already."""
        if self.versions.is_taken(batch):
            return
        last, tables, held = self._tables()
        if malicious is not None:
            tables["counting"] = merge_counts(tables["counting"], K.counting_table(malicious, column, self.shape), limit=255)
            tables["fingerprints"] = merge_counts(tables["fingerprints"], K.fingerprint_table(malicious, column, self.buckets))
            held = grow_slices(held, malicious, column, self.slices, self.ship_up_to)
        if safe is not None:
            tables["allow"] = merge_counts(tables["allow"], K.counting_table(safe, column, self.allow_shape), limit=255)
        self._write(last, batch, tables, held)

    def remove(self, malicious: DataFrame, column: str = "pattern", batch: int | None = None) -> None:
        """Remove block-list entries, each once. Runs jobs; does nothing if the numbered batch is in already."""
        if self.versions.is_taken(batch):
            return
        last, tables, held = self._tables()
        once = malicious.select(column).where(F.col(column).isNotNull()).distinct()
        tables["counting"] = K.counting_remove(tables["counting"], once, column, self.shape, self.ship_up_to)
        tables["fingerprints"] = K.fingerprint_remove(tables["fingerprints"], once, column, self.buckets)
        self._write(last, batch, tables, held)

    def ensemble(self) -> K.Ensemble:
        """The latest version, ready for ``sketches.vote`` and ``gate.gate``."""
        _, tables, held = self._tables()

        def hold(positions: DataFrame, m: int) -> K.Positions:
            return K.held(K.filter_words(positions.where("count > 0").select("position")), m, self.ship_up_to)

        empty = [(0, self.versions.spark.createDataFrame([], WORDS))]
        return K.Ensemble(
            self.shape, self.allow_shape, self.buckets, hold(tables["counting"], self.shape.m),
            [(self.slices.shape(i), K.held(words, self.slices.shape(i).m, self.ship_up_to)) for i, (_, words) in enumerate(held or empty)],
            hold(tables["fingerprints"], self.buckets * 256), hold(tables["allow"], self.allow_shape.m))

    def stats(self) -> DataFrame:
        """Entries and loads of the filters of the latest version, its slices, weights and threshold; one row."""
        last, tables, held = self._tables()
        entries = tables["fingerprints"].agg(F.coalesce(F.sum("count"), F.lit(0)).alias("blacklist_entries"))
        return entries.select(
            "blacklist_entries",
            F.bround(F.col("blacklist_entries") / F.lit(float(self.buckets * 4)), 3).alias("fingerprint_load"),
            F.bround(tables["counting"].agg(F.count(F.lit(1)).alias("n")).scalar() / F.lit(float(self.shape.m)), 3).alias("counting_load"),
            F.bround(tables["allow"].agg(F.count(F.lit(1)).alias("n")).scalar() / F.lit(float(self.allow_shape.m)), 3).alias("allow_load"),
            F.lit(max(1, len(held))).alias("slices"), F.lit(K.VOTE_THRESHOLD).alias("threshold"),
            *[F.lit(weight).alias(f"weight_{name}") for name, weight in C.VOTE_WEIGHTS.items()])
