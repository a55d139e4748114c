"""Probabilities, labels, risk points and final verdicts over feature tables (narrow projections)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk import catalogs as C
from urlrisk.functions import scores as S
from urlrisk.operators import matching
from urlrisk.operators.features import feature_map


def normalize_features(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Features scaled by their maxima, or standardised by a one-row table of ``<name>_mean/_std``."""
    if stats is None:
        scaled = {
            name: S.scaled(F.col(name).cast("double"), top) for name, top in zip(C.FEATURES, C.MAX_VALUES)
        }
        return df.withColumns(scaled)
    row = stats.select(F.struct(*stats.columns)).scalar()
    with_stats = df.withColumn("_stats", row)
    scaled = {
        name: S.standardized(
            F.col(name).cast("double"), F.col(f"_stats.{name}_mean"), F.col(f"_stats.{name}_std")
        )
        for name in C.FEATURES
    }
    return with_stats.withColumns(scaled).drop("_stats")


def fallback_probability(df: DataFrame, out: str = "threat_probability") -> DataFrame:
    """Add the weighted fallback probability of a feature table."""
    return df.withColumn(out, S.threat_probability(feature_map()))


def classify_a(df: DataFrame, url: str = "url", mode: str = "fallback") -> DataFrame:
    """Profile A result: threat_probability, verdict, action, reason. Listed URLs exit early."""
    listed = matching.allow_listed(F.col(url), "A")
    staged = df.withColumn("allow_listed", listed)
    prob = F.when(F.col("allow_listed"), 0.01).otherwise(S.threat_probability(feature_map()))
    staged = staged.withColumn("threat_probability", prob)
    verdict = F.when(F.col("allow_listed"), "safe").otherwise(
        S.verdict_a(F.col("threat_probability"), C.THRESHOLDS[mode])
    )
    return staged.withColumn("verdict", verdict).withColumns({
        "action": S.action_a(F.col("verdict")),
        "reason": F.when(F.col("allow_listed"), "Whitelisted domain"),
    })


def predict_b(df: DataFrame, url: str = "url") -> DataFrame:
    """Profile B prediction: label, confidence, threat_probability (four decimals)."""
    listed = matching.allow_listed(F.col(url), "B")
    staged = df.withColumn("_p", F.when(~listed, S.threat_probability(feature_map())))
    p = F.col("_p")
    return staged.withColumns({
        "label": F.when(p.isNull(), "Safe").otherwise(S.label_b(p)),
        "confidence": F.when(p.isNull(), 0.99).otherwise(S.confidence_b(p)),
        "threat_probability": F.when(p.isNull(), 0.01).otherwise(F.bround(p, 4)),
    }).drop("_p")


def enrich_keywords(df: DataFrame) -> DataFrame:
    """keyword_score becomes the larger of itself and the gate's heuristic score."""
    return df.withColumn("keyword_score", F.greatest("keyword_score", "heuristic_score"))


def risk_score(df: DataFrame) -> DataFrame:
    """Add ml_points, redirect_points, heuristic_points, risk_score and risk_level."""
    points = S.risk_points(
        F.col("threat_probability"), F.col("redirect_count"), F.col("loop_detected"),
        F.col("excessive_redirects"), F.col("suspicious_hops"), feature_map(),
    )
    staged = df.withColumns(points)
    total = F.least(
        F.col("ml_points") + F.col("redirect_points") + F.col("heuristic_points"), F.lit(100)
    )
    return staged.withColumn("risk_score", total).withColumn("risk_level", S.risk_level(F.col("risk_score")))


def final_verdict(df: DataFrame) -> DataFrame:
    """Final profile A verdict.

    Reads threat_probability, membership_verdict, is_shortened, redirect_count, allow_listed; adds
    final_probability, final_verdict, final_confidence, recommendation, warning.
    """
    trusted = F.col("allow_listed")
    adjusted = S.adjusted_probability(
        F.col("threat_probability"), F.col("is_shortened"), F.col("redirect_count")
    )
    staged = df.withColumn(
        "final_probability", F.when(trusted, F.col("threat_probability")).otherwise(adjusted)
    )
    p, member = F.col("final_probability"), F.col("membership_verdict")
    staged = staged.withColumns({
        "final_verdict": F.when(trusted, "safe").otherwise(S.final_verdict(p, member)),
        "final_confidence": F.when(trusted, "high").otherwise(S.final_confidence(p, member)),
    })
    return staged.withColumns({
        "recommendation": S.recommendation(F.col("final_verdict"), F.col("is_shortened"), trusted),
        "warning": S.shortener_warning(F.col("is_shortened"), F.col("redirect_count"), trusted),
    })


def rule_scores(df: DataFrame, weights: dict[str, float], out: str = "rule_score") -> DataFrame:
    """Add the rule-weighted score from in_malicious, redirect_depth and pattern_score."""
    return df.withColumn(
        out, S.rule_score(F.col("in_malicious"), F.col("redirect_depth"), F.col("pattern_score"), weights)
    )


#: Stages of a scan, and the column whose absence says that a stage has nothing for a URL.
STAGES = {"expansion": "redirect_chain", "features": "url_entropy", "prediction": "label", "redirect": "suspicious_hops", "risk": "risk_score"}


def neutral_defaults(df: DataFrame, stages: dict[str, str] = STAGES) -> DataFrame:
    """Fill what a failed stage left null with neutral values and note it in ``errors``."""
    notes: list[Column] = [
        F.when(F.col(column).isNull(), f"{stage} missing")
        for stage, column in stages.items() if column in df.columns
    ]
    defaults: dict[str, Column] = {
        "risk_score": F.lit(0), "risk_level": F.lit("Unknown"),
        "label": F.lit("Unknown"), "confidence": F.lit(0.0), "threat_probability": F.lit(0.0),
        "redirect_count": F.lit(0), "loop_detected": F.lit(False), "excessive_redirects": F.lit(False),
        "suspicious_hops": F.lit(0), "max_hop_risk": F.lit(0.0), "unique_domains_in_chain": F.lit(1),
        "cross_domain_redirect": F.lit(False), "is_shortened": F.lit(False),
        "expanded_url": F.col("url"), "redirect_depth": F.lit(0), "chain_length": F.lit(1),
    }
    for name in C.FEATURES:
        if name not in defaults:
            defaults[name] = F.lit(False) if name in C.BOOLEAN_FEATURES else F.lit(0)
    before = F.col("errors") if "errors" in df.columns else F.array().cast("array<string>")
    errors = F.concat(
        F.coalesce(before, F.array().cast("array<string>")), F.array_compact(F.array(*notes))
    )
    filled = {c: F.coalesce(F.col(c), value) for c, value in defaults.items() if c in df.columns}
    return df.withColumn("errors", errors).withColumns(filled)
