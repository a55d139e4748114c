"""Scoring arithmetic as column expressions: probability, labels, risk points, verdict texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlrisk import catalogs as C


def _num(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")


def scaled(feature: Column, maximum: float) -> Column:
    """min(x / max, 1)."""
    return F.least(feature / F.lit(float(maximum)), F.lit(1.0))


def standardized(feature: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std, with a zero deviation read as one."""
    return (feature - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def weighted_sum(features: dict[str, Column]) -> Column:
    """Dot product of the scaled features with the fixed weights."""
    total = F.lit(0.0)
    for name, weight, maximum in zip(C.FEATURES, C.WEIGHTS, C.MAX_VALUES):
        total = total + F.lit(weight) * scaled(_num(features[name]), maximum)
    return total


def sigmoid5(score: Column) -> Column:
    """1 / (1 + e^(-5 * score))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(score * F.lit(-5.0)))


def threat_probability(features: dict[str, Column]) -> Column:
    """Weighted fallback probability."""
    return sigmoid5(weighted_sum(features))


def verdict_a(prob: Column, thresholds: tuple[float, float]) -> Column:
    """Profile A verdict."""
    low, high = thresholds
    return F.when(prob < low, "safe").when(prob <= high, "uncertain").otherwise("malicious")


def action_a(verdict: Column) -> Column:
    """Follow-up action of a profile A verdict."""
    return (
        F.when(verdict == "safe", "early_exit")
        .when(verdict == "uncertain", "send_to_bloom_filter")
        .otherwise("flag_and_register")
    )


def label_b(prob: Column) -> Column:
    """Profile B label."""
    low, high = C.THRESHOLDS["B"]
    return F.when(prob < low, "Safe").when(prob > high, "Malicious").otherwise("Suspicious")


def confidence_b(prob: Column) -> Column:
    """Profile B confidence, four decimals, half-even."""
    low, high = C.THRESHOLDS["B"]
    raw = F.when(prob < low, 1.0 - prob).when(prob > high, prob).otherwise(F.abs(prob - 0.5) * 2.0)
    return F.bround(raw, 4)


def blend(original: Column, destination: Column) -> Column:
    """Probability of a shortened URL: 35 % its own, 65 % its destination's."""
    return 0.35 * original + 0.65 * destination


def blended_verdict(prob: Column) -> Column:
    """Verdict of a blended probability."""
    return (
        F.when(prob < 0.25, "safe").when(prob > 0.60, "malicious").when(prob > 0.40, "suspicious")
        .otherwise("uncertain")
    )


def risk_points(
    prob: Column, redirect_count: Column, loop: Column, excessive: Column, bad_hops: Column,
    features: dict[str, Column],
) -> dict[str, Column]:
    """The 0-100 risk score with its three parts and its level."""
    def flag(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    ml = F.bround(prob * 55.0).cast("int")
    redirect = F.least(
        flag(loop, 10) + flag(excessive, 8) + F.least(redirect_count * 2, F.lit(5))
        + F.least(bad_hops * 3, F.lit(9)),
        F.lit(25),
    ).cast("int")
    heuristic = F.least(
        flag(features["has_ip"], 6) + flag(features["has_at_symbol"], 4) + flag(features["tld_suspicious"], 5)
        + flag(features["brand_in_subdomain"], 6) + flag(features["has_homograph"], 7)
        + flag(features["keyword_score"] > 0.15, 4) + flag(features["url_entropy"] > 4.5, 3)
        + flag(features["url_length"] > 100, 2),
        F.lit(20),
    )
    return {"ml_points": ml, "redirect_points": redirect, "heuristic_points": heuristic}


def risk_level(score: Column) -> Column:
    """Level of a 0-100 score."""
    return F.when(score <= 30, "Safe").when(score <= 60, "Suspicious").otherwise("Malicious")


def adjusted_probability(prob: Column, shortened: Column, redirects: Column) -> Column:
    """Penalties for shortened URLs and long chains, capped at one."""
    first = F.when(shortened & (prob < 0.5), F.least(prob + 0.05, F.lit(1.0))).otherwise(prob)
    return F.when(redirects > 3, F.least(first + 0.05, F.lit(1.0))).otherwise(first)


def final_verdict(prob: Column, membership: Column) -> Column:
    """Final profile A verdict from the adjusted probability and the membership verdict."""
    return (
        F.when(prob < 0.25, "safe")
        .when((membership == "malicious") | (prob > 0.75), "malicious")
        .when((prob > 0.55) | ((membership == "suspicious") & (prob > 0.35)), "suspicious")
        .when(prob > 0.35, "uncertain")
        .otherwise("safe")
    )


def final_confidence(prob: Column, membership: Column) -> Column:
    """Confidence that goes with ``final_verdict``."""
    return (
        F.when(prob < 0.25, "high")
        .when((membership == "malicious") | (prob > 0.75), "high")
        .when((prob > 0.55) | ((membership == "suspicious") & (prob > 0.35)), "medium")
        .when(prob > 0.35, "low")
        .otherwise("medium")
    )


# --------------------------------------------------------------------------------------------------
# Recommendation texts (plain, for shortened URLs)
# --------------------------------------------------------------------------------------------------
RECOMMENDATIONS = {
    "malicious": ("Block immediately. Add to blacklist.", ""),
    "suspicious": (
        "Flag for manual review. Monitor activity.", " URL shortener detected - verify destination.",
    ),
    "uncertain": ("Allow with caution. Log for analysis.", " URL shortener - consider expanding first."),
    "safe": ("Allow. No action needed.", " (Destination verified)"),
}
TRUSTED_TEXT = "Allow. Trusted domain."
TRUSTED_SHORT_TEXT = "Shortener resolves to a trusted destination. Safe to proceed."


def recommendation(verdict: Column, shortened: Column, trusted: Column) -> Column:
    """Advice text for a verdict."""
    text = F.when(trusted & shortened, TRUSTED_SHORT_TEXT).when(trusted, TRUSTED_TEXT)
    for name, (plain, extra) in RECOMMENDATIONS.items():
        text = text.when((verdict == name) & shortened, plain + extra).when(verdict == name, plain)
    return text.otherwise("Unknown verdict")


def shortener_warning(shortened: Column, redirects: Column, trusted: Column) -> Column:
    """Warning text for shortened URLs, null otherwise."""
    return F.when(
        shortened & ~trusted,
        F.concat(
            F.lit("URL shortener detected ("), redirects.cast("string"),
            F.lit(" redirects). Extra caution advised."),
        ),
    )


def threat_rank(
    prob: Column | None = None, entropy: Column | None = None, depth: Column | None = None,
    keyword_score: Column | None = None, weights: dict[str, float] | None = None,
) -> Column:
    """Composite rank; missing inputs take their neutral value. ``weights`` replaces those of RANK_WEIGHTS it names."""
    w = C.RANK_WEIGHTS | (weights or {})
    if unknown := set(w) - set(C.RANK_WEIGHTS):
        raise ValueError(f"no such rank weights: {sorted(unknown)}")
    p = F.coalesce(prob, F.lit(0.5)) if prob is not None else F.lit(0.5)
    e = F.coalesce(entropy, F.lit(3.0)) if entropy is not None else F.lit(3.0)
    d = F.coalesce(depth.cast("double"), F.lit(0.0)) if depth is not None else F.lit(0.0)
    k = F.coalesce(keyword_score, F.lit(0.0)) if keyword_score is not None else F.lit(0.0)
    return (
        w["probability"] * p + w["entropy"] * (e / 5.0) + w["redirect_depth"] * F.least(d / 10.0, F.lit(1.0)) + w["keyword_score"] * k
    )


def rule_score(
    in_malicious: Column, depth: Column, pattern_score: Column, weights: dict[str, float]
) -> Column:
    """Rule-weighted score, capped at one."""
    return F.least(
        F.when(in_malicious, weights["malicious"]).otherwise(0.0)
        + F.when(depth > 3, weights["redirect"] * 0.8).otherwise(0.0)
        + F.when(pattern_score > 0.5, weights["pattern"] * 0.6).otherwise(0.0),
        F.lit(1.0),
    )


def decayed(score: Column, inserted_at: Column, as_of: Column) -> Column:
    """Score after exponential ageing."""
    now, then = as_of.cast("timestamp"), inserted_at.cast("timestamp")
    age = (F.unix_micros(now) - F.unix_micros(then)) / F.lit(1e6)
    return score * F.exp(age * F.lit(-C.DECAY_PER_SECOND))
