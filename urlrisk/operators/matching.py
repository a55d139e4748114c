"""Domain-list matching: exact, parent-domain and prefix.

Built-in lists are small constants and become hash-set literals inside the projection. Lists of unknown
size are DataFrames ``(pattern, ...)``; they are matched on the distinct hosts and joined back, so a host
that owns a third of the URLs costs one row in the match itself, and adaptive execution splits its partition
in the join.
"""

from __future__ import annotations

from functools import reduce

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk import catalogs as C
from urlrisk.functions import urls as U
from urlrisk.plans.lineage import cut
from urlrisk.plans.skew import lookup_join, semi_lookup


# -- constant lists --------------------------------------------------------------------------------
def listed_or_parent(host: Column, domains: Iterable[str]) -> Column:
    """Host, or a parent of it with at least two labels, is listed.

    The last k labels of the host are looked up for every label count k that the list contains.
    """
    by_labels: dict[int, list[str]] = {}
    for name in domains:
        by_labels.setdefault(name.count(".") + 1, []).append(name)
    found = F.lit(False)
    for labels, names in sorted(by_labels.items()):
        tail = host if labels == 1 else F.substring_index(host, ".", -labels)
        found = found | tail.isin(names)
    return found


def listed_prefix(host: Column, prefixes: Iterable[str]) -> Column:
    """A listed string is a prefix of the host (the whole host counts)."""
    by_length: dict[int, list[str]] = {}
    for name in prefixes:
        by_length.setdefault(len(name), []).append(name)
    found = F.lit(False)
    for length, names in sorted(by_length.items()):
        found = found | F.left(host, F.lit(length)).isin(names)
    return found


def domain_verdict(
    host: Column, safe: Iterable[str] = C.SAFE_DOMAINS, malicious: Iterable[str] = C.MALICIOUS_DOMAINS,
    prefixes: Iterable[str] = C.MALICIOUS_PREFIXES,
) -> Column:
    """safe, malicious or unknown. An exact malicious hit is the longest possible prefix hit."""
    return (
        F.when(listed_or_parent(host, safe), "safe")
        .when(listed_prefix(host, [*malicious, *prefixes]), "malicious")
        .otherwise("unknown")
    )


def allow_listed(url: Column, profile: str) -> Column:
    """URL belongs to the profile's allow list (itself or a parent domain)."""
    authority = U.netloc(url)
    if profile == "A":
        front = F.substring_index(U.path(url), "/", 1)
        host = U.host_of(F.when(F.length(authority) > 0, authority).otherwise(front))
    else:
        host = U.host_of(authority, "charstrip")
    return listed_or_parent(host, C.ALLOW_LISTS[profile])


# -- lists as data ---------------------------------------------------------------------------------
def builtin_catalog(spark: SparkSession) -> DataFrame:
    """The built-in lists as ``(pattern, kind, match_mode)``."""
    rows = (
        [(d, "safe", "exact_parent") for d in C.SAFE_DOMAINS]
        + [(d, "malicious", "exact_prefix") for d in C.MALICIOUS_DOMAINS]
        + [(d, "malicious", "exact_prefix") for d in C.MALICIOUS_PREFIXES]
    )
    return spark.createDataFrame(rows, "pattern string, kind string, match_mode string")


def clean_list(df: DataFrame, column: str = "pattern") -> DataFrame:
    """Trimmed lower-case entries without blanks."""
    return df.withColumn(column, F.lower(F.trim(F.col(column)))).where(F.col(column) != "")


def insert_entries(catalog: DataFrame, added: DataFrame, keys: tuple[str, ...] = ("kind", "pattern")) -> DataFrame:
    """Catalog with ``added`` inserted; an added entry replaces the row of its kind and pattern.

    Lists of different kinds are separate. Of several added rows of one key the last counts, by
    ``inserted_at`` where there is one, else by the order of the other columns.
    """
    rest = [c for c in added.columns if c not in keys]
    order = [c for c in ("inserted_at",) if c in rest] + [c for c in rest if c != "inserted_at"]
    if order:
        fresh = added.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last")).select(*keys, *[f"_last.{c}" for c in rest])
    else:
        fresh = added.select(*keys).distinct()
    return catalog.join(fresh.select(*keys), list(keys), "left_anti").select(*catalog.columns).unionByName(fresh)


def delete_entries(catalog: DataFrame, removed: DataFrame, key: str = "pattern") -> DataFrame:
    """Catalog without the given entries."""
    return catalog.join(removed, key, "left_anti")


def sorted_entries(catalog: DataFrame, key: str = "pattern") -> DataFrame:
    """Entries in lexicographic order."""
    return catalog.orderBy(key)


def list_sizes(catalog: DataFrame) -> DataFrame:
    """Entries per kind."""
    return catalog.groupBy("kind").agg(F.count(F.lit(1)).alias("entries"))


def match_exact(df: DataFrame, catalog: DataFrame, key: str = "domain") -> DataFrame:
    """Left join of the catalog's payload columns on the host key (``pattern`` must be unique)."""
    return lookup_join(df, catalog.withColumnRenamed("pattern", key), key)


def parent_hits(hosts: DataFrame, catalog: DataFrame, key: str = "domain") -> DataFrame:
    """Distinct hosts with a proper parent domain (two labels or more) in the catalog."""
    candidates = hosts.select(key, F.explode(U.parent_domains(F.col(key))).alias("pattern"))
    listed = semi_lookup(candidates, catalog, "pattern", "_listed")
    return listed.where("_listed").select(key).distinct()


def prefix_hits(hosts: DataFrame, catalog: DataFrame, key: str = "domain") -> DataFrame:
    """Distinct hosts that begin with a catalog entry. Only the listed lengths are tried."""
    lengths = catalog.agg(F.collect_set(F.length("pattern"))).scalar()
    usable = F.filter("_lengths", lambda n: n <= F.length(F.col(key)))
    candidates = hosts.withColumn("_lengths", lengths).select(key, F.explode(usable).alias("_n")).select(
        key, F.left(F.col(key), F.col("_n")).alias("pattern")
    )
    listed = semi_lookup(candidates, catalog, "pattern", "_listed")
    return listed.where("_listed").select(key).distinct()


def match_parent(df: DataFrame, catalog: DataFrame, key: str = "domain", flag: str = "parent_match") -> DataFrame:
    """Add ``flag``: a proper parent of the host is listed."""
    return semi_lookup(df, parent_hits(df.select(key).distinct(), catalog, key), key, flag)


def match_prefix(df: DataFrame, catalog: DataFrame, key: str = "domain", flag: str = "prefix_match") -> DataFrame:
    """Add ``flag``: a listed string is a prefix of the host."""
    return semi_lookup(df, prefix_hits(df.select(key).distinct(), catalog, key), key, flag)


def match_verdict(
    df: DataFrame, safe: DataFrame, malicious: DataFrame, key: str = "domain", verdict: str = "verdict",
) -> DataFrame:
    """Domain verdict against lists given as data: safe (exact or parent) before malicious (prefix).

    The distinct hosts are written out and judged once (a job); ``df`` is then read once more for the join.
    """
    hosts = _hosts(df, key)
    is_safe = (
        hosts.join(safe.select(F.col("pattern").alias(key)), key, "left_semi")
        .unionByName(parent_hits(hosts, safe, key))
        .select(key, F.lit(0).alias("_rank"))
    )
    is_malicious = prefix_hits(hosts, malicious, key).select(key, F.lit(1).alias("_rank"))
    ranked = is_safe.unionByName(is_malicious).groupBy(key).agg(F.min("_rank").alias("_rank"))
    joined = lookup_join(df, cut(ranked), key)
    text = F.when(F.col("_rank") == 0, "safe").when(F.col("_rank") == 1, "malicious").otherwise("unknown")
    return joined.withColumn(verdict, text).drop("_rank")


def _hosts(df: DataFrame, key: str) -> DataFrame:
    return cut(df.select(key).where(F.col(key).isNotNull()).distinct())


def member_flag(df: DataFrame, members: DataFrame, key: str = "url", flag: str = "in_blacklist") -> DataFrame:
    """Add ``flag``: exact membership of ``key`` in a table of any size."""
    return semi_lookup(df, members, key, flag)


def not_listed(
    df: DataFrame, catalog: DataFrame, key: str = "domain", modes: tuple[str, ...] = ("exact", "parent", "prefix"),
) -> DataFrame:
    """Rows whose host no list entry matches in any of ``modes`` (an anti join; the distinct hosts are judged once)."""
    hosts = _hosts(df, key)
    found = {
        "exact": lambda: catalog.select(F.col("pattern").alias(key)),
        "parent": lambda: parent_hits(hosts, catalog, key),
        "prefix": lambda: prefix_hits(hosts, catalog, key),
    }
    hits = reduce(DataFrame.unionByName, [found[m]() for m in modes])
    listed = semi_lookup(df, cut(hits.distinct()), key, "_listed")
    return listed.where(~F.col("_listed")).drop("_listed")
