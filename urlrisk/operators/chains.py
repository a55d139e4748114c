"""Redirect chains from a hop log: following, flags, risk, expansion, blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk import catalogs as C
from urlrisk.functions import pages as P
from urlrisk.functions import scores as S
from urlrisk.functions import text as X
from urlrisk.functions import urls as U
from urlrisk.plans.lineage import cut
from urlrisk.plans.skew import lookup_join

HTTP_REDIRECTS = [301, 302, 303, 307, 308]


def next_hops(hop_log: DataFrame, profile: str = "B") -> DataFrame:
    """``(url, status_code, next_url, hop_type, hop_error)``: the one successor of each logged URL.

    Profile A follows HTTP redirects only; profile B also reads meta refreshes and scripted redirects.
    The page body is consulted only where the status leaves it open.
    """
    url, body = F.col("url"), F.col("body")
    is_redirect = F.col("status_code").isin(HTTP_REDIRECTS)
    location = F.trim(F.coalesce(F.col("location"), F.lit("")))
    absolute = location.rlike("^https?://") if profile == "B" else F.startswith(location, F.lit("http"))
    http_target = F.when(
        is_redirect & (location != ""), F.when(absolute, location).otherwise(U.resolve(url, location))
    )
    if profile == "A":
        return hop_log.select(
            "url", "status_code", http_target.alias("next_url"),
            F.when(is_redirect, "http_3xx").otherwise("none").alias("hop_type"),
            F.lit(None).cast("string").alias("hop_error"),
        )
    is_text = F.contains(F.coalesce("content_type", F.lit("")), F.lit("html")) | F.contains(
        F.coalesce("content_type", F.lit("")), F.lit("text")
    )
    readable = ~is_redirect & is_text
    staged = hop_log.withColumns({
        "_http": http_target,
        "_meta": F.when(readable, P.meta_refresh_target(body, url)),
        "_js": F.when(readable, P.script_redirect_target(body, url)),
    })
    meta = F.when(F.col("_meta") != url, F.col("_meta"))
    script = F.when(F.col("_js") != url, F.col("_js"))
    return staged.select(
        "url", "status_code",
        F.coalesce(F.col("_http"), meta, script).alias("next_url"),
        F.when(is_redirect, "http_3xx").when(meta.isNotNull(), "meta_refresh")
        .when(script.isNotNull(), "js_redirect").otherwise("none").alias("hop_type"),
        F.when(is_redirect & (location == ""), "Empty Location header").alias("hop_error"),
    )


def successors(hops: DataFrame) -> DataFrame:
    """``(current, path, next_url)``: one row per logged URL with its own hop as a path of one.

    Of several responses for a URL the latest counts (by ``fetched_at`` where ``hops`` has it, else any one,
    always the same).
    """
    response = ("status_code", "next_url", "hop_type", "hop_error")
    newest = F.max(F.struct(*[c for c in ("fetched_at",) if c in hops.columns], *response)).alias("_r")
    latest = hops.groupBy(F.col("url").alias("current")).agg(newest)
    own = F.struct(
        F.col("current").alias("url"), F.col("_r.status_code").cast("int").alias("status_code"),
        F.col("_r.hop_type").alias("redirect_type"), F.col("_r.hop_error").alias("hop_error"), F.lit(True).alias("known"))
    return latest.select("current", F.array(own).alias("path"), F.col("_r.next_url").alias("next_url"))


def _dead_end(url: Column) -> Column:
    """The path of a URL that was never fetched."""
    return F.array(F.struct(
        url.alias("url"), F.lit(None).cast("int").alias("status_code"), F.lit("none").alias("redirect_type"),
        F.lit(None).cast("string").alias("hop_error"), F.lit(False).alias("known")))


def paths(steps: DataFrame, length: int) -> DataFrame:
    """``(current, path, next_url)`` with paths of ``length`` hops or more, where the chain is that long.

    By pointer doubling: each URL has one successor, so the path of twice the length is the URL's own path and the
    one of where it leads. A round is one join of what still moves with the table, and there are
    log2(``length``) of them; a chain that has ended takes part in none. A path that starts at a URL which was
    never fetched is a dead end.
    """
    reach = 1
    while reach < length:
        done = steps.where("next_url is null")
        moving = steps.where("next_url is not null")
        if moving.isEmpty():
            break
        ahead = steps.select(F.col("current").alias("next_url"), F.col("path").alias("_path"), F.col("next_url").alias("_next"), F.lit(True).alias("_known"))
        longer = lookup_join(moving, ahead, "next_url").select(
            "current", F.concat("path", F.coalesce("_path", _dead_end(F.col("next_url")))).alias("path"),
            F.when(F.col("_known"), F.col("_next")).alias("next_url"))
        steps = cut(done.unionByName(longer))
        reach *= 2
    return steps


def follow(urls: DataFrame, hops: DataFrame, max_hops: int, stop_at_loops: bool = True) -> DataFrame:
    """Follow every distinct URL through the successor table.

    Result: ``url, hops array<struct<hop,url,status_code,redirect_type>>, loop_detected, errors``, plus
    ``next_url``, where the chain would have gone on. ``urls`` are made distinct here, so a repeated URL
    is followed once. A URL missing from the table is a dead end. The successor table is written out
    once, so page bodies are read once and not per hop; paths double in length each round, and loops and
    the limit are found on the finished paths, which hold ``2 * max_hops + 2`` hops at most.
    """
    most = max_hops + 1
    asked = urls.select(F.col("url").alias("current")).where("url is not null").distinct()
    known = paths(cut(successors(hops)), most)
    found = lookup_join(asked, known, "current").select(
        F.col("current").alias("url"), F.coalesce("path", _dead_end(F.col("current"))).alias("path"), "next_url")
    visited = F.transform("path", lambda h: h["url"])
    # positions (from 1) of hops whose successor came before
    nexts = F.concat(F.slice(visited, 2, 2 * most), F.array("next_url"))
    returns = F.filter(
        F.sequence(F.lit(1), F.least(F.size("path"), F.lit(max_hops))),
        lambda i: F.array_position(visited, F.get(nexts, i - 1)).between(1, i))
    staged = found.withColumn("_back", F.get(returns, F.lit(0)) if stop_at_loops and max_hops else F.lit(None).cast("int"))
    staged = staged.withColumn("_size", F.coalesce("_back", F.least(F.size("path"), F.lit(most))))
    staged = staged.withColumns({
        "_after": F.get(nexts, F.col("_size") - 1), "_path": F.slice("path", F.lit(1), F.col("_size"))})

    def record(h: Column, i: Column) -> Column:
        return F.struct(i.alias("hop"), h["url"].alias("url"), h["status_code"].alias("status_code"), h["redirect_type"].alias("redirect_type"))

    def error(h: Column, i: Column) -> Column:
        at = F.concat(F.lit(" at hop "), i.cast("string"))
        return F.when(~h["known"], F.concat(F.lit("Connect error"), at, F.lit(" ("), h["url"], F.lit(")"))).when(
            h["hop_error"].isNotNull(), F.concat(h["hop_error"], at))

    loop = F.when(F.col("_back").isNotNull(), F.concat(
        F.lit("Redirect loop at hop "), F.col("_back").cast("string"), F.lit(": "), F.col("_after")))
    return cut(staged.select(
        "url", F.col("_after").alias("next_url"), F.transform("_path", record).alias("hops"),
        F.array_compact(F.concat(F.transform("_path", error), F.array(loop))).alias("errors"),
        F.col("_back").isNotNull().alias("loop_detected")))


# -- per-hop expressions ---------------------------------------------------------------------------
def hop_suspicious(url: Column) -> Column:
    """Suspicious top-level domain or an IP address for a host."""
    authority = U.netloc(url)
    return U.has_tld(U.host_of(authority, "charstrip"), C.HOP_TLDS) | U.is_ip(U.true_host(authority))


def hop_risk(url: Column) -> Column:
    """Risk of a single hop, 0 to 1."""
    host = U.domain(url, "charstrip")
    words = X.hits(F.lower(url), C.HOP_KEYWORDS) / F.lit(float(len(C.HOP_KEYWORDS)))
    return F.least(
        F.when(U.has_tld(host, C.HOP_RISK_TLDS), 0.35).otherwise(0.0)
        + F.when(host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), 0.30).otherwise(0.0)
        + F.when(X.entropy(url) > 4.5, 0.15).otherwise(0.0)
        + F.least(words, F.lit(0.20)),
        F.lit(1.0),
    )


# -- expansion -------------------------------------------------------------------------------------
def expand_b(urls: DataFrame, hop_log: DataFrame) -> DataFrame:
    """Expansion record per distinct URL, profile B.

    Columns: url, expanded_url, is_shortened, shortener_domain, redirect_chain, redirect_count,
    loop_detected, excessive_redirects, errors.
    """
    followed = follow(urls, next_hops(hop_log, "B"), C.MAX_HOPS["B"])
    return summarize(flag_hops(followed))


def flag_hops(followed: DataFrame) -> DataFrame:
    """Turn ``hops`` into ``redirect_chain`` with suspicion and open-redirect flags; add the virtual hop.

    A chain has at most max_hops + 2 elements, so everything stays inside the row.
    """
    staged = followed.withColumns({
        "embedded": U.open_redirect_target(F.col("url")),
        "is_shortened": U.is_shortener(F.col("url"), "B"),
    })

    def annotate(hop: Column) -> Column:
        embedded = (hop["redirect_type"] == "none") & U.open_redirect_target(hop["url"]).isNotNull()
        return F.struct(
            hop["hop"].alias("hop"), hop["url"].alias("url"), hop["status_code"].alias("status_code"),
            (hop_suspicious(hop["url"]) | embedded).alias("is_suspicious"),
            F.when(embedded, "open_redirect").otherwise(hop["redirect_type"]).alias("redirect_type"),
        )

    virtual = F.col("embedded").isNotNull() & (F.size("hops") <= 1)
    extra = F.struct(
        F.size("hops").alias("hop"), F.col("embedded").alias("url"),
        F.lit(None).cast("int").alias("status_code"),
        hop_suspicious(F.col("embedded")).alias("is_suspicious"),
        F.lit("open_redirect").alias("redirect_type"),
    )
    chain = F.transform("hops", annotate)
    host = U.domain(F.col("url"))
    return staged.withColumns({
        "redirect_chain": F.when(virtual, F.concat(chain, F.array(extra))).otherwise(chain),
        "shortener_domain": F.when(F.col("is_shortened"), host),
        "is_shortened": F.col("is_shortened") | virtual,
    }).drop("hops", "embedded", "next_url")


def summarize(flagged: DataFrame, max_hops: int = C.MAX_HOPS["B"]) -> DataFrame:
    """Add redirect_count, expanded_url (the original for an empty chain) and excessive_redirects."""
    count = F.greatest(F.size("redirect_chain") - 1, F.lit(0))
    last = F.try_element_at(F.col("redirect_chain"), F.lit(-1))
    return flagged.withColumns({
        "redirect_count": count,
        "expanded_url": F.coalesce(last["url"], F.col("url")),
        "excessive_redirects": count >= max_hops,
    })


def expand_a(urls: DataFrame, hop_log: DataFrame) -> DataFrame:
    """Expansion record per distinct URL, profile A: only shorteners are followed, HTTP redirects only.

    Columns: url, final_url, redirect_chain (array of URLs), redirect_count, is_shortened, error.
    """
    distinct = urls.select("url").where("url is not null").distinct()
    short = U.is_shortener(F.col("url"), "A")
    hops = C.MAX_HOPS["A"]
    followed = follow(distinct.where(short), next_hops(hop_log, "A"), hops - 1, stop_at_loops=False)
    visited = F.transform("hops", lambda h: h["url"])
    final = F.coalesce(F.col("next_url"), F.element_at(visited, -1))
    chain = F.when(F.col("next_url").isNull(), visited).otherwise(F.concat(visited, F.array("next_url")))
    followed = followed.select(
        "url", final.alias("final_url"), chain.alias("redirect_chain"),
        (F.size(chain) - 1).alias("redirect_count"), F.lit(True).alias("is_shortened"),
        F.try_element_at(F.col("errors"), F.lit(1)).alias("error"),
    )
    plain = distinct.where(~short).select(
        "url", F.col("url").alias("final_url"), F.array("url").alias("redirect_chain"),
        F.lit(0).alias("redirect_count"), F.lit(False).alias("is_shortened"),
        F.lit(None).cast("string").alias("error"),
    )
    return followed.unionByName(plain)


# -- analysis --------------------------------------------------------------------------------------
def analyze_chain(expanded: DataFrame) -> DataFrame:
    """Add hop risks and the chain aggregates.

    Columns: redirect_chain with ``hop_risk_score``, suspicious_hops, max_hop_risk,
    unique_domains_in_chain, cross_domain_redirect, redirect_depth, chain_length.
    """
    risks = F.transform("redirect_chain", lambda h: hop_risk(h["url"]))
    staged = expanded.withColumn("_risks", risks)

    def annotate(hop: Column, risk: Column) -> Column:
        return F.struct(
            hop["hop"].alias("hop"), hop["url"].alias("url"), hop["status_code"].alias("status_code"),
            (hop["is_suspicious"] | (risk > 0.3)).alias("is_suspicious"),
            hop["redirect_type"].alias("redirect_type"), F.bround(risk, 3).alias("hop_risk_score"),
        )

    domains = F.array_distinct(F.transform("redirect_chain", lambda h: U.domain(h["url"])))
    origin, final = U.domain(F.col("url")), U.domain(F.col("expanded_url"))
    return staged.withColumns({
        "redirect_chain": F.zip_with("redirect_chain", "_risks", annotate),
        "suspicious_hops": F.size(F.filter("_risks", lambda r: r > 0.3)),
        "max_hop_risk": F.coalesce(F.bround(F.array_max("_risks"), 3), F.lit(0.0)),
        "unique_domains_in_chain": F.size(domains),
        "cross_domain_redirect": (origin != "") & (final != "") & (origin != final),
        "redirect_depth": F.col("redirect_count"),
        "chain_length": F.size("redirect_chain"),
    }).drop("_risks")


def explode_chain(expanded: DataFrame) -> DataFrame:
    """One row per hop of each chain."""
    return expanded.select("url", F.explode("redirect_chain").alias("_h")).select("url", "_h.*")


def blend_scores(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Blend each shortened URL's probability with its destination's and re-label it.

    ``scored``: unique ``url, threat_probability``; ``pairs``: ``url, final_url``. Rows whose destination
    is the URL itself are left out, as they are not blended.
    """
    apart = pairs.where(F.col("url") != F.col("final_url")).select("url", "final_url").distinct()
    own = scored.select("url", F.col("threat_probability").alias("original_prob"))
    other = scored.select(F.col("url").alias("final_url"), F.col("threat_probability").alias("expanded_prob"))
    joined = apart.join(own, "url").join(other, "final_url")
    blended = S.blend(F.col("original_prob"), F.col("expanded_prob"))
    return joined.withColumn("threat_probability", blended).withColumn(
        "verdict", S.blended_verdict(F.col("threat_probability"))
    )


def expansion_stats(expanded: DataFrame) -> DataFrame:
    """Number of expansion records and their serialised size."""
    record = F.to_json(F.struct(*expanded.columns))
    return expanded.agg(
        F.count(F.lit(1)).alias("cached_urls"),
        F.coalesce(F.sum(F.length(record)), F.lit(0)).alias("cache_size_bytes"),
    )
