"""Similar URLs among all: a banded join of classes of equal min-hash signatures of trigram sets."""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.functions import hashing as H
from urlrisk.functions import text as X
from urlrisk.plans.lineage import cut
from urlrisk.plans.skew import lookup_join, row_ranks

BLOCK = 512
PAIRS_A_TASK = 1 << 22
MOST_TASKS = 1 << 14
MOST_CHOICES = 1024


def band_shape(hashes: int, least: int) -> tuple[int, int]:
    """Bands and rows per band such that two signatures with ``least`` equal hashes agree in a whole band.

    They differ in ``hashes - least`` places at most, which spoil as many bands; one more band is left.
    """
    bands = hashes - least + 1
    return bands, hashes // bands


def _minimums(urls: DataFrame, hashes: int, url: str) -> DataFrame:
    """(url, mins) of the distinct URLs with trigrams. URLs are small and hashing them is not, so they are dealt over all cores."""
    spark = urls.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = urls.select(F.col(url).alias("url")).where(F.length(url) >= 3).distinct().repartition(parts, "url")
    paired = distinct.withColumn("_pairs", H.hash_pairs(X.trigrams(F.col("url"))))
    return paired.select("url", H.minhash_of(F.col("_pairs"), hashes).alias("mins"))


def signatures(urls: DataFrame, hashes: int, bands: int, rows: int, url: str = "url") -> DataFrame:
    """(url, mins, keys) of the distinct URLs with trigrams: min-hashes, and a 64-bit key per band."""
    keys = [F.xxhash64(F.lit(b), *[F.get("mins", F.lit(b * rows + r)) for r in range(rows)]) for b in range(bands)]
    return _minimums(urls, hashes, url).withColumn("keys", F.array(*keys))


def matches(left: str, right: str, hashes: int) -> Column:
    """In how many places two arrays of ``hashes`` values, of the named columns, are equal."""
    return reduce(Column.__add__, [(F.get(left, F.lit(i)) == F.get(right, F.lit(i))).cast("int") for i in range(hashes)])


def similar_urls(urls: DataFrame, threshold: float = 0.8, hashes: int = 10, url: str = "url", block: int = BLOCK) -> DataFrame:
    """(first_url, second_url, similarity): all pairs of distinct URLs whose signatures agree in a share
    ``threshold`` or more of their ``hashes`` min-hashes; the first of a pair is the smaller string. Runs jobs.

    URLs of one signature are a class. Classes are compared, by ``_similar_classes``, and a pair of them is
    written out as the pairs of their URLs, so that no pair of URLs is looked for or verified by itself: the
    result is that of comparing all with all. URLs of a class are held in blocks of about ``block``. The smaller
    class of a pair is sent to each block of the larger one, and the pairs of URLs are made there, by tasks of
    about PAIRS_A_TASK pairs (a task has one block at least, with all URLs similar to it). URLs of fewer than
    three characters have no trigrams and are similar to nothing; null URLs are left out and repeats count once.
    """
    least = max(1, math.ceil(threshold * hashes - 1e-9))
    bands, rows = band_shape(hashes, least)
    signed = cut(signatures(urls, hashes, bands, rows, url))
    grouped = signed.groupBy("mins", "keys").agg(F.count(F.lit(1)).alias("n"))
    classes = cut(grouped.withColumns({"id": F.monotonically_increasing_id(), "blocks": F.ceil(F.col("n") / block).cast("int")}))
    member = signed.select("url", "mins").join(classes.select("mins", "id", "blocks"), "mins")
    members = cut(member.groupBy("id", F.pmod(F.xxhash64("url"), F.col("blocks")).cast("int").alias("block")).agg(
        F.collect_list("url").alias("urls")))
    twins = classes.where("n > 1").select(
        F.col("id").alias("a"), F.col("blocks").alias("a_blocks"), F.col("id").alias("b"), F.lit(hashes).alias("_same"),
        (F.col("n") * F.col("n")).alias("_pairs"))
    linked = cut(_similar_classes(classes, least, hashes, block).unionByName(twins))
    pairs = linked.agg(F.sum("_pairs")).first()[0] or 0
    spark = urls.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-pairs // PAIRS_A_TASK)))
    smaller = members.select(F.col("id").alias("b"), F.col("block").alias("j"), F.col("urls").alias("b_urls"))
    larger = members.select(F.col("id").alias("a"), F.col("block").alias("i"), F.col("urls").alias("a_urls"))
    sent = linked.join(smaller, "b").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1))).where("a <> b OR i <= j")
    met = sent.repartition(tasks, "a", "i").join(larger.hint("shuffle_hash"), ["a", "i"])
    made = met.withColumn("a_url", F.explode("a_urls")).withColumn("b_url", F.explode("b_urls")).where("a <> b OR i <> j OR a_url < b_url")
    return made.select(
        F.least("a_url", "b_url").alias("first_url"), F.greatest("a_url", "b_url").alias("second_url"),
        (F.col("_same") / F.lit(float(hashes))).alias("similarity"))


def _similar_classes(classes: DataFrame, least: int, hashes: int, block: int) -> DataFrame:
    """(a, a_blocks, b, _same, _pairs): each two classes that agree in ``least`` places or more, the larger one as ``a``.

    ``band_shape`` cuts signatures into so many bands that no such two are missed. Classes that agree in a
    band meet by an equi-join on its key, are taken in the first band that they share, and are verified on whole
    signatures. A band key of any share of the classes is dealt out as pairs of blocks of about ``block`` classes,
    so no task gets one key whole. Rows that are shuffled hold a class, its hashes and its keys, once per band
    and block that they meet.
    """
    bands = band_shape(hashes, least)[0]
    held = ("id", "n", "blocks", "mins", "keys")
    placed = classes.select(F.posexplode("keys").alias("band", "key"), *held)
    sizes = classes.select(F.posexplode("keys").alias("band", "key")).groupBy("band", "key").agg(F.count(F.lit(1)).alias("_n"))
    shared = sizes.where("_n > 1").select(
        F.struct("band", "key").alias("place"), F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    # each place has one row there, so adaptive execution may split a frequent one
    dealt = lookup_join(placed.withColumn("place", F.struct("band", "key")), shared, "place", "inner").withColumn(
        "_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    last = F.col("_blocks") - 1
    first = dealt.withColumn("j", F.explode(F.sequence("_own", last))).select(
        "band", "key", F.col("_own").alias("i"), "j", *[F.col(c).alias(f"a_{c}") for c in held])
    second = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), "_own"))).select(
        "band", "key", "i", F.col("_own").alias("j"), *[F.col(c).alias(f"b_{c}") for c in held])
    shares = F.coalesce(*[F.when(F.get("a_keys", F.lit(b)) == F.get("b_keys", F.lit(b)), b) for b in range(bands)])
    met = first.join(second, ["band", "key", "i", "j"]).where(
        ((F.col("i") < F.col("j")) | (F.col("a_id") < F.col("b_id"))) & (shares == F.col("band")))
    found = met.withColumn("_same", matches("a_mins", "b_mins", hashes)).where(F.col("_same") >= least)
    sides = [F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("n", "id", "blocks")]) for s in ("a", "b")]
    larger, smaller = F.greatest(*sides), F.least(*sides)
    return found.select(
        larger["id"].alias("a"), larger["blocks"].alias("a_blocks"), smaller["id"].alias("b"), "_same",
        (F.col("a_n") * F.col("b_n")).alias("_pairs"))


def similar_counts(urls: DataFrame, threshold: float = 0.8, hashes: int = 10, url: str = "url") -> DataFrame:
    """(url, class_url, similar, best, best_similarity): per distinct URL with trigrams the smallest URL of the same
    signature, how many similar ones there are by the rule of ``similar_urls``, and the most similar one (ties: the
    smaller string; null if there is none). Runs jobs.

    No pairs are made, of which there may be as many as the square of the URLs. URLs of one signature are a class. The
    classes that agree in given places are counted by grouping, for each choice of ``least`` or more places; a URL that
    agrees in i places is in as many of the groups for j places as there are choices of j out of i, which gives the
    counts for exactly i places from the most places down. Beyond MOST_CHOICES choices, pairs are made after all.
    """
    least = max(1, math.ceil(threshold * hashes - 1e-9))
    signed = cut(_minimums(urls, hashes, url))
    grouped = signed.groupBy("mins").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("class_url"))
    # numbers in the order of the strings stand for them
    classes = cut(row_ranks(grouped, [], [F.col("class_url")], "id"))
    if sum(math.comb(hashes, j) for j in range(least, hashes)) > MOST_CHOICES:
        return _counts_of_pairs(signed, classes, urls, threshold, hashes, url)
    others = _other_classes(classes, least, hashes)
    place = signed.join(classes, "mins")
    second = place.where(F.col("url") > F.col("class_url")).groupBy("id").agg(F.min("url").alias("_second"))
    named = others.join(classes.select(F.col("id").alias("_best"), F.col("class_url").alias("_other")), "_best", "left").drop("_best")
    joined = place.join(second, "id", "left").join(named, "id", "left")
    twins = F.col("n") > 1
    return joined.select(
        "url", "class_url", (F.col("n") - 1 + F.coalesce("_others", F.lit(0))).alias("similar"),
        F.when(twins, F.when(F.col("url") > F.col("class_url"), F.col("class_url")).otherwise(F.col("_second"))).otherwise(
            F.col("_other")).alias("best"),
        F.when(twins, 1.0).otherwise(F.col("_same") / F.lit(float(hashes))).alias("best_similarity"))


def _other_classes(classes: DataFrame, least: int, hashes: int) -> DataFrame:
    """(id, _others, _same, _best) per class with similar ones: URLs in them, most places in agreement, the smallest id there."""
    chosen = [c for j in range(least, hashes) for c in itertools.combinations(range(hashes), j)]
    if not chosen:
        return classes.sparkSession.createDataFrame([], "id long, _others long, _same int, _best long")
    choices = F.from_json(F.lit(str([list(c) for c in chosen])), "array<array<int>>")
    values = F.transform(choices, lambda c: F.transform(c, lambda i: F.get("mins", i)))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.repartition(parts, "id").select("id", "n", F.posexplode(values).alias("choice", "agree"))
    key = ["choice", "agree"]
    shared = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_urls"), F.min("id").alias("_first")).where("_c > 1").drop("_c")
    met = cut(rows.join(shared, key).select("choice", F.size("agree").alias("j"), "id", "n", "_urls", "_first"))
    # a first class tells its group
    second = met.where("id > _first").groupBy("choice", "_first").agg(F.min("id").alias("_second"))
    near = met.join(second, ["choice", "_first"]).withColumn("_near", F.when(F.col("id") > F.col("_first"), F.col("_first")).otherwise(F.col("_second")))
    sums = near.groupBy("id").agg(*[
        f for j in range(least, hashes) for f in (
            F.coalesce(F.sum(F.when(F.col("j") == j, F.col("_urls") - F.col("n"))), F.lit(0)).alias(f"_o{j}"),
            F.min(F.when(F.col("j") == j, F.col("_near"))).alias(f"_b{j}"))])
    exact: dict[int, Column] = {}
    for j in range(hashes - 1, least - 1, -1):
        sums = sums.withColumn(f"_a{j}", reduce(lambda a, i: a - math.comb(i, j) * exact[i], exact, F.col(f"_o{j}")))
        exact[j] = F.col(f"_a{j}")
    same = F.coalesce(*[F.when(column > 0, j) for j, column in exact.items()])
    best = F.coalesce(*[F.when(column > 0, F.col(f"_b{j}")) for j, column in exact.items()])
    return sums.select("id", reduce(Column.__add__, exact.values()).alias("_others"), same.alias("_same"), best.alias("_best"))


def _counts_of_pairs(signed: DataFrame, classes: DataFrame, urls: DataFrame, threshold: float, hashes: int, url: str) -> DataFrame:
    pairs = similar_urls(urls, threshold, hashes, url)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("first_url").alias("url"), F.col("second_url").alias("other"), "similarity"),
        F.struct(F.col("second_url").alias("url"), F.col("first_url").alias("other"), "similarity"))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "other"))
    counted = both.groupBy("url").agg(F.count(F.lit(1)).alias("_n"), best.alias("_b"))
    return signed.join(classes.drop("n", "id"), "mins").join(counted, "url", "left").select(
        "url", "class_url", F.coalesce("_n", F.lit(0)).alias("similar"), F.col("_b.other").alias("best"),
        (-F.col("_b.s")).alias("best_similarity"))


def most_similar(urls: DataFrame, threshold: float = 0.8, hashes: int = 10, url: str = "url") -> DataFrame:
    """(url, similar, best, best_similarity): per URL that has any, how many similar ones there are and the most
    similar one (ties: the smaller string), by ``similar_counts``."""
    return similar_counts(urls, threshold, hashes, url).where("similar > 0").drop("class_url")
