"""The 25-column feature vector, per profile, as one narrow projection (no shuffle, no Python)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk import catalogs as C
from urlrisk.functions import text as X
from urlrisk.functions import urls as U

_TMP = "_f_"


def extract_features(df: DataFrame, profile: str = "B", url: str = "url") -> DataFrame:
    """Add the 25 feature columns.

    ``redirect_depth`` and ``chain_length`` are taken from the input when present, else they get the
    profile's neutral value. Parsing results are staged in temporary columns so that each is computed
    once: the optimizer keeps a projection separate when its costly outputs are used more than once.
    """
    if profile not in U.HOST_MODE:
        raise ValueError(f"unknown profile {profile!r}")
    u = F.col(url)
    passthrough = [c for c in df.columns if c not in C.FEATURES or c == url]
    depth = F.col("redirect_depth") if "redirect_depth" in df.columns else F.lit(0)
    chain = F.col("chain_length") if "chain_length" in df.columns else F.lit(0 if profile == "A" else 1)

    staged = df.withColumns({f"{_TMP}depth": depth.cast("int"), f"{_TMP}chain": chain.cast("int")})
    staged = U.split_columns(staged, url, _TMP).withColumn(f"{_TMP}plain", F.lower(U.percent_decode(u)))
    authority = F.lower(F.col(f"{_TMP}netloc"))
    spoof_host = authority
    if profile == "A":
        spoof_host = F.when(F.length(authority) > 0, authority).otherwise(
            F.lower(F.substring_index(u, "/", 1))
        )
    staged = staged.withColumns({
        f"{_TMP}host": U.host_of(authority),
        f"{_TMP}key": U.host_of(authority, U.HOST_MODE[profile]),
        f"{_TMP}spoof": spoof_host,
        f"{_TMP}lpath": F.lower(F.col(f"{_TMP}path")),
    })
    staged = staged.withColumns({
        f"{_TMP}root": F.substring_index(F.col(f"{_TMP}spoof"), ".", -2),
        f"{_TMP}leet": F.translate(F.col(f"{_TMP}key"), "01345", "oieAs"),
    })
    columns = _feature_columns(profile, u)
    return staged.select(*passthrough, *[columns[name].alias(name) for name in C.FEATURES])


def _feature_columns(profile: str, u: Column) -> dict[str, Column]:
    def t(name: str) -> Column:
        return F.col(f"{_TMP}{name}")

    host, key = t("host"), t("key")
    digits = X.per_char(X.count_digits(u), u)
    upper = X.per_char(X.count_upper(u), u)
    special = X.per_char(X.count_any(u, "@%=&?#"), u)
    url_entropy, host_entropy = X.entropy(u), X.entropy(host)
    words = C.KEYWORDS_BY_PROFILE[profile]
    keyword_score = X.hits(t("plain"), words) / F.lit(float(len(words)))
    if profile == "A":
        depth_host, age_host = key, key
        front = F.substring_index(F.substring_index(F.lower(u), "?", 1), "/", 1)
        tld = U.has_tld(front, C.SUSPICIOUS_TLDS) | U.has_tld(
            F.concat(F.lit("."), key), C.SUSPICIOUS_TLDS
        )
    else:
        digits, upper, special, url_entropy, host_entropy, keyword_score = (
            F.bround(c, 4) for c in (digits, upper, special, url_entropy, host_entropy, keyword_score)
        )
        depth_host, age_host = host, host
        tld = U.has_tld(host, C.SUSPICIOUS_TLDS)
    return {
        "url_length": F.length(u),
        "domain_length": F.length(key),
        "subdomain_depth": X.count_of(depth_host, "."),
        "path_depth": X.count_of(u, "/"),
        "query_length": F.length(t("query")),
        "num_query_params": F.when(F.length(t("query")) > 0, X.count_of(t("query"), "&") + 1).otherwise(0),
        "dot_count": X.count_of(u, "."),
        "hyphen_count": X.count_of(u, "-"),
        "digit_ratio": digits,
        "uppercase_ratio": upper,
        "special_char_ratio": special,
        "url_entropy": url_entropy,
        "domain_entropy": host_entropy,
        "has_https": F.startswith(u, F.lit("https://")),
        "tld_suspicious": tld,
        "has_ip": u.rlike(U.IP_ANYWHERE),
        "has_at_symbol": F.contains(u, F.lit("@")),
        "double_slash_path": F.contains(t("path"), F.lit("//")),
        "has_suspicious_port": F.coalesce(U.port(t("netloc")).isin(C.SUSPICIOUS_PORTS), F.lit(False)),
        "redirect_depth": t("depth"),
        "keyword_score": keyword_score,
        "brand_in_subdomain": _spoofed_brand(t("spoof"), t("root"), t("lpath")),
        "has_homograph": _homograph(t("leet"), key),
        "domain_age_proxy": F.when(U.has_tld(age_host, C.TRUSTED_TLDS), 1.0).otherwise(0.3),
        "chain_length": t("chain"),
    }


def _spoofed_brand(host: Column, root: Column, path: Column) -> Column:
    """A brand in the subdomains or the path whose root domain does not carry it."""
    labels = F.rtrim(F.substr(host, F.lit(1), F.length(host) - F.length(root)), F.lit("."))
    found = F.lit(False)
    for brand in C.SPOOFED_BRANDS:
        b = F.lit(brand)
        found = found | ((F.contains(labels, b) | F.contains(path, b)) & ~F.contains(root, b))
    return found


def _homograph(leet: Column, host: Column) -> Column:
    """A brand appears only after look-alike digits are read as letters."""
    found = F.lit(False)
    for brand in C.SPOOFED_BRANDS:
        found = found | (F.contains(leet, F.lit(brand)) & ~F.contains(host, F.lit(brand)))
    return (leet != host) & found


def feature_map() -> dict[str, Column]:
    """The feature columns by name."""
    return {name: F.col(name) for name in C.FEATURES}


def feature_array() -> Column:
    """Ordered vector of doubles, for model input."""
    return F.array(*[F.col(name).cast("double") for name in C.FEATURES])


def pattern_signals(df: DataFrame, url: str = "url", keywords: list[str] = C.PATTERN_KEYWORDS) -> DataFrame:
    """Pattern-matching signals on the adversarially normalised URL. A keyword listed twice counts twice."""
    u = F.col(url)
    staged = df.withColumn("normalized_url", U.adversarial_form(u))
    norm = F.col("normalized_url")
    count = X.hits(norm, keywords)
    return staged.withColumns({
        "matched_keywords": X.matched(norm, keywords),
        "match_count": count,
        "pattern_score": count / F.lit(float(max(1, len(keywords)))),
        "has_ip_address": u.rlike(U.IP_ANYWHERE),
        "digit_ratio": X.per_char(X.count_digits(u), u),
        "dot_count": X.count_of(u, "."),
        "hyphen_count": X.count_of(u, "-"),
        "special_char_ratio": X.per_char(X.count_any(u, "@%=&?"), u),
    })


def feature_flags(df: DataFrame, key: str = "url") -> DataFrame:
    """Long format (key, feature, value, flagged) of a feature table; flagged marks a bad value."""
    bad_booleans = [name for name in C.BOOLEAN_FEATURES if name != "has_https"]
    wide = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in C.FEATURES])
    long = wide.unpivot(["key"], C.FEATURES, "feature", "value")
    name, value = F.col("feature"), F.col("value")
    flagged = (
        (name.isin(bad_booleans) & (value == 1.0))
        | ((name == "keyword_score") & (value > 0.1))
        | ((name == "url_entropy") & (value > 4.5))
        | ((name == "url_length") & (value > 100))
    )
    return long.withColumn("flagged", flagged).withColumnRenamed("key", key)
