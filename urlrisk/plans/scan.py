"""End-to-end scans: requests to response records, in both profiles, and batch ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk import catalogs as C
from urlrisk.functions import scores as S
from urlrisk.functions import urls as U
from urlrisk.operators import chains, gate, graph, ranking, scoring, sketches
from urlrisk.operators.features import extract_features
from urlrisk.plans.lineage import cut
from urlrisk.plans.skew import lookup_join

CHAIN_TYPE = (
    "array<struct<hop:int,url:string,status_code:int,is_suspicious:boolean,redirect_type:string,"
    "hop_risk_score:double>>"
)
RESULT_COLUMNS = [
    "url", "expanded_url", "is_shortened", "shortener_domain", "redirect_chain", "redirect_count",
    "loop_detected", "excessive_redirects", "suspicious_hops", "decision", *C.FEATURES, "label",
    "confidence", "threat_probability", "ml_points", "redirect_points", "heuristic_points", "risk_score",
    "risk_level", "errors",
]


def accept_requests(requests: DataFrame, raw: str = "url") -> DataFrame:
    """Normalise and check requested URLs: adds ``requested_url``, ``valid``, ``reason``."""
    staged = requests.withColumn("requested_url", F.col(raw)).withColumn(raw, U.with_scheme(F.col(raw)))
    check = U.validation(F.col(raw))
    fits = U.accepted(F.col("requested_url"))
    return staged.withColumns({
        "valid": fits & F.coalesce(check["valid"], F.lit(False)),
        "reason": F.when(~fits, "URL length outside 4 to 2048").otherwise(check["reason"]),
    })


def scan_b(
    requests: DataFrame, hop_log: DataFrame | None, ensemble: sketches.Ensemble | None = None, expansions: DataFrame | None = None
) -> DataFrame:
    """Profile B scan: one flat row per request, with ``valid`` and ``reason``.

    ``expansions`` are expansion records made before (``chains.expand_b``, or a table of remembered ones); URLs are
    then not followed here. A stage that has nothing for a URL does not cost it its row: what it would
    have told is filled with neutral values and noted in ``errors``, and the other stages go on.

    Every distinct URL is scanned once and joined back to its requests, however often it was asked for.
    Settled URLs get the fast path; only forwarded ones are expanded and scored. A rejected request keeps
    its text as it came in ``url``, the reason, and nulls for the rest.
    """
    checked = accept_requests(requests)
    valid = checked.where("valid").select("url", "valid", "reason")
    results = cut(scan_distinct_b(valid, hop_log, ensemble, expansions))
    rejected = checked.where("not valid").select(F.col("requested_url").alias("url"), "valid", "reason")
    return lookup_join(valid, results, "url", "inner").unionByName(rejected, allowMissingColumns=True)


def scan_distinct_b(
    urls: DataFrame, hop_log: DataFrame | None, ensemble: sketches.Ensemble | None = None, expansions: DataFrame | None = None
) -> DataFrame:
    """Profile B result per distinct URL."""
    forwarded, settled = gate.split(gate.gate(urls.select("url").distinct(), ensemble))
    records = chains.expand_b(forwarded, hop_log) if expansions is None else expansions
    joined = lookup_join(forwarded.drop("domain", "reason"), chains.analyze_chain(records), "url")
    # before the features, which read the expanded URL and the chain's figures
    joined = scoring.neutral_defaults(joined, {"expansion": "redirect_chain", "redirect": "suspicious_hops"})
    scored = extract_features(joined, "B", "expanded_url")
    scored = scoring.predict_b(scoring.enrich_keywords(scored), "expanded_url")
    scored = scoring.neutral_defaults(scoring.risk_score(scored), {"features": "url_entropy", "prediction": "label", "risk": "risk_score"})

    settled = gate.fast_path(settled)
    blocked = F.col("decision") == "BLOCK"
    hop = F.struct(
        F.lit(0).alias("hop"), F.col("url"), F.when(~blocked, 200).alias("status_code"),
        blocked.alias("is_suspicious"), F.lit("none").alias("redirect_type"),
        F.lit(0.0).alias("hop_risk_score"),
    )
    note = F.when(blocked, F.concat(F.lit("Blocked by Stage 1 pre-filter: "), F.col("reason")))
    settled = settled.withColumns({
        "expanded_url": F.col("url"), "is_shortened": F.lit(False),
        "shortener_domain": F.lit(None).cast("string"), "redirect_chain": F.array(hop).cast(CHAIN_TYPE),
        "redirect_count": F.lit(0), "loop_detected": F.lit(False), "excessive_redirects": F.lit(False),
        "suspicious_hops": F.lit(0), "ml_points": F.lit(0), "redirect_points": F.lit(0),
        "heuristic_points": F.col("risk_score"), "risk_level": F.col("label"),
        "errors": F.array_compact(F.array(note)),
    })
    scored = scored.withColumn("redirect_chain", F.col("redirect_chain").cast(CHAIN_TYPE))
    return scored.select(RESULT_COLUMNS).unionByName(settled.select(RESULT_COLUMNS))


def response_records(results: DataFrame) -> DataFrame:
    """Nested response records of a profile B scan; rejected requests have none."""
    results = results.where("valid")
    chain = F.transform("redirect_chain", lambda h: F.struct(
        h["hop"].alias("hop"), h["url"].alias("url"), h["status_code"].alias("status_code"),
        h["is_suspicious"].alias("is_suspicious"),
    ))
    breakdown = F.struct(
        F.col("ml_points").alias("ml_contribution"), F.col("redirect_points").alias("redirect_contribution"),
        F.col("heuristic_points").alias("heuristic_contribution"),
        F.when(F.col("decision") != "FORWARD", "stage1_pre_filter").alias("source"),
    )
    return results.select(
        F.col("url").alias("original_url"), "expanded_url", "is_shortened", "shortener_domain",
        chain.alias("redirect_chain"), "redirect_count", "loop_detected", "excessive_redirects",
        F.struct(*C.FEATURES).alias("features"),
        F.struct("label", "confidence", "threat_probability").alias("prediction"),
        F.struct(
            F.col("risk_score").alias("score"), F.col("risk_level").alias("level"),
            breakdown.alias("breakdown"),
        ).alias("risk_score"),
        "errors",
    )


def score_urls_a(urls: DataFrame, edges: DataFrame) -> DataFrame:
    """Profile A graph profile, features and classification per distinct URL."""
    return scoring.classify_a(extract_features(graph.url_profile(urls, edges), "A"))


def scan_a(
    urls: DataFrame, hop_log: DataFrame, edges: DataFrame, malicious: DataFrame, benign: DataFrame,
    shape: sketches.Shape | None = None, blacklist: DataFrame | None = None,
) -> DataFrame:
    """Profile A scan: one flat row per distinct URL.

    ``malicious`` and ``benign`` are tables of known URLs (column ``url``). The graph and membership
    stages run on the analysed URL, which is the destination of a shortened one.
    """
    expanded = cut(chains.expand_a(urls, hop_log))
    targets = expanded.select(F.explode(F.array("url", "final_url")).alias("url")).distinct()
    scored = cut(score_urls_a(targets, edges).select(
        "url", "entropy", "redirect_depth", "chain_length", "keyword_score", "threat_probability",
        "verdict", "action", "allow_listed",
    ))
    moved = F.col("is_shortened") & (F.col("final_url") != F.col("url"))
    paired = expanded.withColumn("analyzed_url", F.when(moved, F.col("final_url")).otherwise(F.col("url")))
    own = scored.select("url", F.col("threat_probability").alias("original_prob"))
    paired = paired.join(own, "url")
    paired = lookup_join(paired, scored.withColumnRenamed("url", "analyzed_url"), "analyzed_url", "inner")
    blended = S.blend(F.col("original_prob"), F.col("threat_probability"))
    differs = F.col("analyzed_url") != F.col("url")
    paired = paired.withColumn("expanded_prob", F.when(differs, F.col("threat_probability")))
    paired = paired.withColumn(
        "threat_probability", F.when(differs, blended).otherwise(F.col("threat_probability"))
    ).withColumn(
        "verdict", F.when(differs, S.blended_verdict(F.col("threat_probability"))).otherwise(F.col("verdict"))
    )

    nodes = expanded.select(F.when(moved, F.col("final_url")).otherwise(F.col("url")).alias("node")).distinct()
    threats = graph.threat_paths(nodes, edges, malicious.select(F.col("url").alias("node")))
    member = sketches.membership(
        nodes.withColumnRenamed("node", "url"), malicious, shape, blacklist
    ).withColumnRenamed("url", "analyzed_url")
    stage = threats.withColumnRenamed("node", "analyzed_url").join(member, "analyzed_url")
    joined = lookup_join(paired, stage, "analyzed_url", "inner")

    met = sketches.constraints_met(F.col("analyzed_url"), F.col("entropy"), F.col("redirect_depth"))
    joined = joined.withColumn(
        "membership_verdict", sketches.membership_verdict(F.col("possibly_malicious"), met)
    )
    joined = ranking.with_rank(joined)
    baseline = ranking.code_length_baseline(benign)
    joined = ranking.entropy_anomaly(joined, baseline, "analyzed_url").drop("url_entropy")
    return scoring.final_verdict(joined)


def rank_urls(urls: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Batch ranking: the k most threatening URLs of a batch, profile A scores."""
    return ranking.top_k(ranking.with_rank(score_urls_a(urls, edges)), k)


def rank_batches(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """The most threatening URLs of each batch ``(batch_id, url, top_k)``; a URL is scored once for all batches."""
    scored = cut(ranking.with_rank(score_urls_a(requests.select("url"), edges)))
    return ranking.top_per_batch(lookup_join(requests, scored, "url", "inner"))
