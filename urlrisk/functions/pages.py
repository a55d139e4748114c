"""Soft-redirect targets found in page markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlrisk.functions import urls as U

# --------------------------------------------------------------------------------------------------
# Patterns, tried in this order
# --------------------------------------------------------------------------------------------------
META_PATTERNS = [
    r"""(?i)<meta[^>]+http-equiv=["']?refresh["']?[^>]+content=["']?\s*\d*\s*;?\s*url=([^"'>\s]+)""",
    r"""(?i)content=["']?\s*\d*\s*;?\s*url=([^"'>\s]+)""",
]
SCRIPT_PATTERNS = [
    r"""(?i)window\.location(?:\.href)?\s*=\s*["']([^"']+)["']""",
    r"""(?i)window\.location\.replace\s*\(\s*["']([^"']+)["']""",
    r"""(?i)location\.href\s*=\s*["']([^"']+)["']""",
    r"""(?i)document\.location\s*=\s*["']([^"']+)["']""",
]


def _first(candidates: list[Column]) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def meta_refresh_target(html: Column, base: Column) -> Column:
    """Resolved target of a meta refresh, null if the page has none.

    Every pattern needs ``url=``, a cheap test that keeps the regular expressions off most pages.
    """
    found = _first([F.regexp_extract(html, p, 1) for p in META_PATTERNS])
    return F.when(F.contains(F.lower(html), F.lit("url=")), U.resolve(base, found))


def script_redirect_target(html: Column, base: Column) -> Column:
    """Resolved target of a scripted redirect, null if the page has none."""
    found = []
    for pattern in SCRIPT_PATTERNS:
        target = F.trim(F.regexp_extract(html, pattern, 1))
        found.append(F.when(~target.rlike("^(javascript:|#)"), target))
    return F.when(F.contains(F.lower(html), F.lit("location")), U.resolve(base, _first(found)))
