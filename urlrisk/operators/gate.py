"""The pre-filter gate and its fast-path answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk import catalogs as C
from urlrisk.operators import keywords, matching, sketches
from urlrisk.plans.lineage import cut

BLOCK_AT = 0.70
FLAG_AT = 0.35

# Reasons of the decisions
REASONS = {
    "list_safe": "Trie whitelist exact/parent match",
    "list_bad": "Trie blacklist exact/prefix match",
    "vote_safe": "Bloom ensemble whitelist hit",
    "vote_weak": "Bloom hit but heuristics inconclusive → ML review",
    "flagged": "Heuristic flag (suspicious signals)",
    "plain": "No strong signal — standard ML forward",
}


def gate(
    df: DataFrame, ensemble: sketches.Ensemble | None = None, safe: DataFrame | None = None,
    malicious: DataFrame | None = None, url: str = "url",
) -> DataFrame:
    """Add domain, list_result, bloom_result, bloom_score, heuristic_score, decision, ml_skipped, reason.

    With the built-in lists this is one projection over the input. Work is skipped by nulling: a host
    that the lists settle has no digest to compute, and a URL the vote settles is not scanned for
    keywords or entropy. With ``safe``/``malicious`` given as data the list step becomes a skew-safe
    join on the host; pass the matching ``ensemble`` from ``sketches.data_ensemble``.
    """
    ensemble = ensemble or sketches.constant_ensemble(df.sparkSession)
    keyed = sketches.host_key(df, url)
    if safe is not None and malicious is not None:
        listed = matching.match_verdict(keyed, safe, malicious, "domain", "list_result")
    else:
        listed = keyed.withColumn("list_result", matching.domain_verdict(F.col("domain")))
    open_host = F.when(F.col("list_result") == "unknown", F.col("domain"))
    voted = sketches.vote(listed.withColumn("_host", open_host), "_host", ensemble)
    open_url = F.when(F.col("bloom_result").isin("KNOWN_MALICIOUS", "UNCERTAIN"), F.col(url))
    scored = keywords.heuristic(voted.withColumn("_url", open_url), "_url")
    scored = scored.withColumns({
        "bloom_score": F.coalesce(F.col("bloom_score"), F.lit(0.0)),
        "heuristic_score": F.coalesce(F.col("heuristic_score"), F.lit(0.0)),
    })
    scored = scored.withColumn("decision", _decision())
    helpers = ["_host", "_url", "vote_allow", "vote_fingerprint", "vote_counting", "vote_sliced",
               "category_score", "url_entropy", "host_entropy", "path_entropy", "entropy_suspicious",
               "is_suspicious"]
    return scored.withColumns({
        "ml_skipped": F.col("decision") != "FORWARD",
        "reason": _reason(),
    }).drop(*helpers)


def _strong() -> Column:
    return (F.col("bloom_result") == "KNOWN_MALICIOUS") & (F.col("heuristic_score") >= BLOCK_AT)


def _decision() -> Column:
    return (
        F.when(F.col("list_result") == "safe", "PASS")
        .when(F.col("list_result") == "malicious", "BLOCK")
        .when(F.col("bloom_result") == "KNOWN_SAFE", "PASS")
        .when(_strong(), "BLOCK")
        .otherwise("FORWARD")
    )


def _reason() -> Column:
    vote_block = F.concat(
        F.lit("Bloom blacklist ("), F.format_number(F.col("bloom_score"), 2),
        F.lit(") + heuristic ("), F.format_number(F.col("heuristic_score"), 2), F.lit(f" ≥ {BLOCK_AT})"),
    )
    return (
        F.when(F.col("list_result") == "safe", REASONS["list_safe"])
        .when(F.col("list_result") == "malicious", REASONS["list_bad"])
        .when(F.col("bloom_result") == "KNOWN_SAFE", REASONS["vote_safe"])
        .when(_strong(), vote_block)
        .when(F.col("bloom_result") == "KNOWN_MALICIOUS", REASONS["vote_weak"])
        .when(F.col("heuristic_score") >= FLAG_AT, REASONS["flagged"])
        .otherwise(REASONS["plain"])
    )


def gate_counters(gated: DataFrame) -> DataFrame:
    """Totals per decision and the share that skips the model, one row."""
    decided = {name: F.count_if(F.col("decision") == name) for name in ("BLOCK", "PASS", "FORWARD")}
    total = F.count(F.lit(1))
    skipped = (decided["BLOCK"] + decided["PASS"]) / F.greatest(total, F.lit(1))
    return gated.agg(
        total.alias("total_queries"),
        decided["BLOCK"].alias("blocked"),
        decided["PASS"].alias("passed"),
        decided["FORWARD"].alias("forwarded_to_ml"),
        F.bround(skipped, 3).alias("ml_skip_rate"),
    )


def split(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forwarded, settled) rows of a gated table. Runs a job.

    The gated rows are written out first. A filter on ``decision`` straight over ``gate`` would be
    pushed below its staged columns, which substitutes every definition into the predicate.
    """
    written = cut(gated)
    return written.where("decision = 'FORWARD'"), written.where("decision <> 'FORWARD'")


def fast_path(settled: DataFrame, url: str = "url") -> DataFrame:
    """Answers for rows the gate settled: label, confidence, probability, score, level and features."""
    blocked = F.col("decision") == "BLOCK"
    h = F.col("heuristic_score")
    block_score = F.greatest(F.lit(70), (70 + h * 25).cast("int"))
    out = settled.withColumns({
        "label": F.when(blocked, "Malicious").otherwise("Safe"),
        "confidence": F.when(blocked, F.least(0.60 + F.col("bloom_score") * 0.35, F.lit(0.99))).otherwise(0.99),
        "threat_probability": F.when(blocked, F.least(0.75 + h * 0.20, F.lit(0.99))).otherwise(0.01),
        "risk_score": F.when(blocked, block_score).otherwise(1),
    })
    return out.withColumns(fast_path_features(F.col(url), blocked, h))


def fast_path_features(url: Column, blocked: Column, heuristic_score: Column) -> dict[str, Column]:
    """Feature columns reported for settled rows: neutral but for a few."""
    columns = {}
    for name in C.FEATURES:
        if name in C.BOOLEAN_FEATURES:
            columns[name] = F.lit(False)
        elif name.endswith(("_ratio", "_entropy", "_score", "_proxy")):
            columns[name] = F.lit(0.0)
        else:
            columns[name] = F.lit(0)
    columns["url_length"] = F.length(url)
    columns["has_https"] = ~blocked & F.startswith(url, F.lit("https://"))
    columns["keyword_score"] = F.when(blocked, heuristic_score).otherwise(0.0)
    columns["domain_age_proxy"] = F.when(blocked, 0.0).otherwise(1.0)
    return columns

