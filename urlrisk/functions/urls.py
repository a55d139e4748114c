"""URL functions: normalisation, splitting, host keys, query parameters, reference resolution.

``host_mode`` controls how a leading ``www`` is treated:

* ``charstrip`` removes every leading ``w`` or ``.`` character (``washingtonpost.com`` becomes
  ``ashingtonpost.com``); this is the behaviour profile B has to reproduce;
* ``prefix`` removes exactly one leading ``www.`` (profile A);
* ``keep`` leaves the host alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk import catalogs as C
from urlrisk.functions import text as X

HOST_MODE = {"A": "prefix", "B": "charstrip"}

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/]*)"
_BEFORE_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/]*)?"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# The patterns and reasons of the request check
_VALID = r"(?i)^(https?|ftp)://([a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+)$"
_PRIVATE = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.|0\.|::1|localhost)"
REASONS = {
    "length": "URL is empty or too long",
    "pattern": "URL failed structural regex check",
    "host": "URL has no host/netloc",
}
IP_ANYWHERE = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"^({_OCTET}\.){{3}}{_OCTET}$"


# -- splitting -------------------------------------------------------------------------------------
def _before_query(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def scheme(url: Column) -> Column:
    """Lower-case scheme, empty if absent."""
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc(url: Column) -> Column:
    """Authority component including userinfo and port."""
    return F.regexp_extract(_before_query(url), _AUTHORITY, 1)


def path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    raw = F.regexp_replace(_before_query(url), _BEFORE_PATH, "")
    return F.when(F.contains(raw, F.lit(";")), F.regexp_replace(raw, ";[^/]*$", "")).otherwise(raw)


def query(url: Column) -> Column:
    """Query string without the question mark."""
    plain = F.substring_index(url, "#", 1)
    mark = F.instr(plain, "?")
    return F.when(mark > 0, F.substr(plain, mark + 1)).otherwise(F.lit(""))


def fragment(url: Column) -> Column:
    """Fragment without the hash sign."""
    mark = F.instr(url, "#")
    return F.when(mark > 0, F.substr(url, mark + 1)).otherwise(F.lit(""))


def split_columns(df: DataFrame, url: str = "url", prefix: str = "_") -> DataFrame:
    """Add netloc, path and query columns, so later expressions reuse them instead of parsing again."""
    u = F.col(url)
    return df.withColumns({f"{prefix}netloc": netloc(u), f"{prefix}path": path(u), f"{prefix}query": query(u)})


# -- hosts -----------------------------------------------------------------------------------------
def host_of(authority: Column, host_mode: str = "keep") -> Column:
    """Lower-case host text of an authority: everything before the first colon, ``www`` per mode."""
    host = F.substring_index(F.lower(authority), ":", 1)
    if host_mode == "charstrip":
        return F.ltrim(host, F.lit("w."))
    if host_mode == "prefix":
        return F.when(F.startswith(host, F.lit("www.")), F.substr(host, F.lit(5))).otherwise(host)
    if host_mode == "keep":
        return host
    raise ValueError(f"unknown host mode {host_mode!r}")


def domain(url: Column, host_mode: str = "charstrip") -> Column:
    """Host key of a URL."""
    return host_of(netloc(url), host_mode)


def _host_port(authority: Column) -> Column:
    return F.substring_index(authority, "@", -1)


def true_host(authority: Column) -> Column:
    """Host name without userinfo, port or brackets, lower-cased."""
    rest = _host_port(authority)
    bracketed = F.regexp_extract(rest, r"^[^\[]*\[([^\]]*)", 1)
    return F.lower(F.when(F.contains(rest, F.lit("[")), bracketed).otherwise(F.substring_index(rest, ":", 1)))


def port(authority: Column) -> Column:
    """Port number; null when absent, not numeric or out of range."""
    rest = _host_port(authority)
    digits = F.when(
        F.contains(rest, F.lit("[")), F.regexp_extract(rest, r"\][^:]*:([0-9]+)$", 1)
    ).otherwise(F.regexp_extract(rest, r"^[^:]*:([0-9]+)$", 1))
    number = F.when(F.contains(rest, F.lit(":")), digits.try_cast("int"))
    return F.when(number.between(0, 65535), number)


def is_ip(host: Column) -> Column:
    """Whole host is an IPv4 or IPv6 literal."""
    return host.rlike(_IPV4) | (F.contains(host, F.lit(":")) & host.rlike(r"^[0-9a-f:.]+$"))


def is_private(url: Column) -> Column:
    """Host text begins like a private, loopback or link-local address."""
    return true_host(netloc(url)).rlike(_PRIVATE)


def has_tld(host: Column, tlds: list[str]) -> Column:
    """Host ends in ``.<tld>`` for one of the listed suffixes (none of which contains a dot)."""
    return F.contains(host, F.lit(".")) & F.substring_index(host, ".", -1).isin(tlds)


def root_domain(url: Column) -> Column:
    """Last two labels of what follows an http(s) scheme, up to the first slash."""
    rest = F.regexp_replace(url, "^https?://", "")
    return F.substring_index(F.substring_index(rest, "/", 1), ".", -2)


def parent_domains(host: Column) -> Column:
    """Proper parent domains keeping at least two labels, nearest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(
        F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice(labels, i, n), ".")
    )
    return F.when(n >= 3, parents).otherwise(F.array().cast("array<string>"))


def is_shortener(url: Column, profile: str) -> Column:
    """URL belongs to a known shortening service."""
    if profile == "A":
        return F.replace(F.lower(netloc(url)), F.lit("www."), F.lit("")).isin(C.SHORTENERS_A)
    return domain(url).isin(C.SHORTENERS_B)


# -- normalisation ---------------------------------------------------------------------------------
def with_scheme(raw: Column) -> Column:
    """Trimmed URL with ``http://`` in front unless it already names http, https or ftp."""
    u = F.trim(raw)
    return F.when(u.rlike("^(http|https|ftp)://"), u).otherwise(F.concat(F.lit("http://"), u))


def validation(url: Column) -> Column:
    """Struct (valid, reason) of the structural check."""
    reason = (
        F.when(url.isNull() | (F.length(url) == 0) | (F.length(url) > 2048), F.lit(REASONS["length"]))
        .when(~url.rlike(_VALID), F.lit(REASONS["pattern"]))
        .when(F.length(netloc(url)) == 0, F.lit(REASONS["host"]))
        .otherwise(F.lit("ok"))
    )
    return F.struct((reason == "ok").alias("valid"), reason.alias("reason"))


def accepted(raw: Column) -> Column:
    """Request length limits hold for the raw text (4 to 2048 characters)."""
    return F.coalesce(F.length(raw).between(4, 2048), F.lit(False))


def percent_decode(value: Column) -> Column:
    """Decode %XX escapes; a plus sign stays, a malformed escape stays as written."""
    guarded = F.regexp_replace(F.replace(value, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.contains(value, F.lit("%")), F.try_url_decode(guarded)).otherwise(value)


def leet_expand(value: Column) -> Column:
    """Lower-case and replace look-alike digits and signs by letters."""
    return F.translate(F.lower(value), "0134578@$", "oieastbas")


def collapse_separators(value: Column) -> Column:
    """Remove hyphens and underscores."""
    return F.translate(value, "-_", "")


def adversarial_form(url: Column) -> Column:
    """Decoded, lower-cased, look-alikes expanded, separators removed."""
    return collapse_separators(leet_expand(percent_decode(url)))


# -- query parameters ------------------------------------------------------------------------------
def query_params(query_string: Column) -> Column:
    """Ordered array of (name, value) pairs; pairs without a value are dropped."""
    def decode(part: Column) -> Column:
        return percent_decode(F.replace(part, F.lit("+"), F.lit(" ")))

    pairs = F.filter(F.split(query_string, "&"), lambda p: p.rlike("^[^=]*=."))
    return F.transform(
        pairs,
        lambda p: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("name"),
            decode(F.substr(p, F.instr(p, "=") + 1)).alias("value"),
        ),
    )


def open_redirect_target(url: Column) -> Column:
    """URL embedded in the first value of a redirect-like parameter; null when there is none."""
    def first_target(params: Column) -> Column:
        names = F.transform(params, lambda p: p["name"])
        first = F.filter(params, lambda p, i: F.array_position(names, p["name"]) == i + 1)
        named = F.filter(first, lambda p: F.lower(p["name"]).isin(C.OPEN_REDIRECT_PARAMS))
        targets = F.transform(named, lambda p: percent_decode(p["value"]))
        return F.get(F.filter(targets, lambda t: t.rlike("^https?://")), F.lit(0))

    # an embedded URL shows as "http" or as escapes behind the question mark; skip all other URLs
    return F.when(url.rlike(r"\?.*(http|%)"), X.let(query_params(query(url)), first_target))


# -- reference resolution --------------------------------------------------------------------------
def resolve(base: Column, target: Column) -> Column:
    """Resolve a reference against its base URL (null if either is null)."""
    return X.let(target, lambda t: _resolved(base, t))


def _resolved(base: Column, target: Column) -> Column:
    authority = F.concat(scheme(base), F.lit("://"), netloc(base))
    base_path = F.regexp_replace(_before_query(base), _BEFORE_PATH, "")
    target_path = _before_query(target)
    tail = F.substr(target, F.length(target_path) + 1)
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    joined = F.when(F.startswith(target, F.lit("/")), target_path).otherwise(F.concat(folder, target_path))
    return (
        F.when(F.length(target) == 0, base)
        .when(target.rlike(_SCHEME), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme(base), F.lit(":"), target))
        .when(F.startswith(target, F.lit("?")), F.concat(authority, base_path, target))
        .when(F.startswith(target, F.lit("#")), F.concat(F.substring_index(base, "#", 1), target))
        .otherwise(F.concat(authority, X.let(joined, _collapse_dots), tail))
    )


def _collapse_dots(joined: Column) -> Column:
    """Rooted path without empty, ``.`` and ``..`` segments (a trailing slash stays)."""
    rooted = F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(rooted.rlike(r"//|/\.|^$"), X.let(F.split(F.substr(rooted, F.lit(2)), "/"), _join_segments)).otherwise(
        rooted
    )


def _join_segments(parts: Column) -> Column:
    inner = F.filter(parts, lambda s, i: (s != "") | (i == F.size(parts) - 1))
    kept = F.aggregate(
        inner,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), tail), "^//+$", "/")
