"""Keyword scans and the combined heuristic score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk import catalogs as C
from urlrisk.functions import text as X
from urlrisk.functions import urls as U
from urlrisk.plans.lineage import cut
from urlrisk.plans.skew import lookup_join


def scan_occurrences(df: DataFrame, words: list[str], url: str = "url") -> DataFrame:
    """One row per (URL, keyword, 0-based position), overlapping hits included.

    Only keywords that occur are expanded, inside the row: nothing is joined or shuffled.
    """
    low = F.lower(F.col(url))
    found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return (
        df.withColumn("keyword", F.explode(found))
        .withColumn("position", F.explode(X.all_positions(low, F.col("keyword"))))
    )


def category_counts(low: Column) -> dict[str, Column]:
    """Distinct keywords found, per category, in lower-cased text."""
    return {name: X.hits(low, words) for name, words in C.CATEGORY_KEYWORDS.items()}


def category_score(counts: dict[str, Column]) -> Column:
    """Weighted score with diminishing returns, capped at one, four decimals."""
    total = F.lit(0.0)
    for name, weight in C.CATEGORY_WEIGHTS.items():
        total = total + F.lit(weight) * F.least(counts[name], F.lit(3)) / F.lit(3.0)
    return F.bround(F.least(total, F.lit(1.0)), 4)


def categorized_scan(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``keyword_hits`` (keyword to positions), ``categories`` (category to count) and the score."""
    low = F.lower(F.col(url))
    counts = category_counts(low)
    words = [w for group in C.CATEGORY_KEYWORDS.values() for w in group]
    found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    entries = F.filter(
        F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in counts.items()]),
        lambda e: e["value"] > 0,
    )
    return df.withColumns({
        "keyword_hits": F.map_from_arrays(found, F.transform(found, lambda w: X.all_positions(low, w))),
        "categories": F.map_from_entries(entries),
        "category_score": category_score(counts),
    })


# -- dictionaries as tables -----------------------------------------------------------------------
def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters; none of a shorter or null text."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def dictionary_hits(df: DataFrame, dictionary: DataFrame, url: str = "url", size: int = 3) -> DataFrame:
    """``(url, category, keyword, weight)`` for every keyword of ``dictionary`` (category, keyword, weight) that the
    distinct URLs of ``df`` contain, in lower case.

    A dictionary may have any number of keywords, as none becomes part of the plan. Each is anchored at its rarest
    gram of ``size`` characters (shorter keywords: at themselves), counted over all URLs, so a URL meets only the
    keywords anchored at one of its grams, and ``contains`` confirms them. Keywords with a gram that no URL has are
    out at once. Repeats of a keyword in a category count once, with the greatest weight; null and empty keywords
    match nothing.
    """
    words = dictionary.select("category", F.lower("keyword").alias("keyword"), F.col("weight").cast("double").alias("weight")).where(
        "keyword <> ''").groupBy("category", "keyword").agg(F.max("weight").alias("weight"))
    words = cut(words)
    sizes = [r["n"] for r in words.select(F.least(F.length("keyword"), F.lit(size)).alias("n")).distinct().collect()]
    low = cut(df.select(F.col(url).alias("url")).where("url is not null").distinct().withColumn("low", F.lower("url")))
    no_grams = F.array().cast("array<string>")
    per_url = F.concat(no_grams, *[_grams(F.col("low"), n) for n in sorted(sizes)])
    per_word = F.concat(no_grams, *[F.when(F.least(F.length("keyword"), F.lit(size)) == n, _grams(F.col("keyword"), n)).otherwise(no_grams) for n in sorted(sizes)])
    held = low.select("url", F.explode(per_url).alias("gram"))
    asked = words.select("keyword").distinct().select("keyword", F.explode(per_word).alias("gram"))
    # how many URLs have each gram that any keyword has
    common = held.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("_g")
    anchors = asked.join(common, "gram", "left").groupBy("keyword").agg(rarest).where("_g.n > 0").select("keyword", F.col("_g.gram").alias("gram"))
    met = low.select("url", "low", F.explode(per_url).alias("gram")).join(cut(anchors), "gram")
    return met.where(F.contains("low", F.col("keyword"))).select("url", "keyword").join(words, "keyword").select(
        "url", "category", "keyword", "weight")


def dictionary_scan(df: DataFrame, dictionary: DataFrame, url: str = "url", size: int = 3) -> DataFrame:
    """``categorized_scan`` with the dictionary and its weights as data; a category weighs as its heaviest keyword."""
    hits = dictionary_hits(df, dictionary, url, size)
    per = hits.groupBy("url", "category").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max("weight").alias("weight"), F.collect_list("keyword").alias("words"))
    parts = F.sort_array(F.collect_list(F.struct("category", "n", "weight", "words")))
    scored = per.groupBy("url").agg(parts.alias("_parts")).select(
        F.col("url").alias(url),
        F.map_from_entries(F.transform("_parts", lambda p: F.struct(p["category"], p["n"]))).alias("categories"),
        F.array_sort(F.array_distinct(F.flatten(F.col("_parts.words")))).alias("_words"),
        F.bround(F.least(F.aggregate(
            "_parts", F.lit(0.0), lambda total, p: total + p["weight"] * F.least(p["n"], F.lit(3)) / F.lit(3.0)), F.lit(1.0)), 4).alias("category_score"))
    joined = lookup_join(df, scored, url)
    low = F.lower(F.col(url))
    return joined.withColumns({
        "categories": F.coalesce("categories", F.map_from_entries(F.array().cast("array<struct<k:string,v:int>>"))),
        "category_score": F.coalesce("category_score", F.lit(0.0)),
        "keyword_hits": F.map_from_arrays(
            F.coalesce("_words", F.array().cast("array<string>")),
            F.transform(F.coalesce("_words", F.array().cast("array<string>")), lambda w: X.all_positions(low, w))),
    }).drop("_words")


def builtin_dictionary(spark: SparkSession) -> DataFrame:
    """The built-in categories as a dictionary."""
    rows = [(c, w, float(C.CATEGORY_WEIGHTS[c])) for c, words in C.CATEGORY_KEYWORDS.items() for w in words]
    return spark.createDataFrame(rows, "category string, keyword string, weight double")


def entropy_profile(df: DataFrame, url: str = "url") -> DataFrame:
    """Entropy of URL, host (with port) and path, four decimals, and the suspicion flag."""
    u = F.col(url)
    staged = df.withColumns({"_e_netloc": F.lower(U.netloc(u)), "_e_path": U.path(u)}).withColumns({
        "_e_u": X.entropy(u), "_e_h": X.entropy(F.col("_e_netloc")), "_e_p": X.entropy(F.col("_e_path")),
    })
    return staged.withColumns({
        "url_entropy": F.bround(F.col("_e_u"), 4),
        "host_entropy": F.bround(F.col("_e_h"), 4),
        "path_entropy": F.bround(F.col("_e_p"), 4),
        "entropy_suspicious": (F.col("_e_u") > 4.5) | (F.col("_e_h") > 4.0),
    }).drop("_e_netloc", "_e_path", "_e_u", "_e_h", "_e_p")


def heuristic(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``category_score``, the entropies, ``heuristic_score`` and ``is_suspicious``.

    A null URL yields null scores without evaluating anything, which the gate uses to skip rows.
    """
    low, given = F.lower(F.col(url)), F.col(url).isNotNull()
    words = F.when(given, category_score(category_counts(low)))
    staged = entropy_profile(df.withColumn("category_score", words), url)
    signal = F.when(F.col("entropy_suspicious"), 1.0).otherwise(F.col("url_entropy") / 6.0)
    scored = staged.withColumn(
        "heuristic_score", F.when(given, F.bround(0.60 * F.col("category_score") + 0.40 * signal, 4))
    )
    return scored.withColumn(
        "is_suspicious", (F.col("heuristic_score") > 0.35) | (F.col("category_score") > 0.25)
    )
