"""Threat-shaped relations derived from the given ``pages`` and ``events`` tables, row by row.

The page URLs alone are all harmless, so a fixed rule on the page id gives most pages a URL, a redirect
and a response of a known kind. The same rules are written as SQL in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.plans.skew import spread

#: Added to a page's id for its given URL.
GIVEN = 224_000_000
#: First and last page of the long chain, and the page that every fourteenth one leads to.
LONG_CHAIN, HUB = (20, 40), 45
MALICIOUS_KINDS = [0, 1, 2, 3, 7, 8, 9, 10, 11]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _threat_url() -> Column:
    pid, kind = F.col("page_id").cast("string"), F.col("page_id") % 16

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    return (
        F.when(kind == 0, text("http://paypa1-secure.xyz/login/verify?account=", pid))
        .when(kind == 1, text("http://g00gle-secure-login.xyz/verify?id=", pid))
        .when(kind == 2, text("http://paypal.secure-login.tk/verify/", pid))
        .when(kind == 3, text("http://192.168.", (F.col("page_id") % 256).cast("string"), ".1/admin?n=", pid))
        .when(kind == 4, text("https://github.com/org/repo", pid))
        .when(kind == 5, text("https://api.github.com/v", pid))
        .when(kind == 6, text("http://bit.ly/3free", pid))
        .when(kind == 7, text("http://legitimate.com@evil-phishing.xyz/login?n=", pid))
        .when(kind == 8, text("http://evil.xyz:8888/cmd//execute?n=", pid))
        .when(kind == 9, text("http://go.example.com/out?url=http%3A%2F%2Fevil", pid, ".ml%2Fx"))
        .when(kind == 10, text("http://secure-paypal.evil", pid, ".net/%6C%6F%67%69%6E"))
        .when(kind == 11, text("http://xK8mN2pQ7rT4vY1z.top/a/b/c?x=", pid))
        .when(kind == 12, text("https://www.washingtonpost.com/story/", pid))
        .otherwise(F.col("url"))
    )


def corpus_rows(given: DataFrame) -> DataFrame:
    """(page_id, url, result) of a table or stream of pages: each made URL, and every page's own one.

    Where the rule replaces a page's URL, the given URL is a harmless row of its own under the page id
    plus GIVEN, a multiple of all cycle lengths of the rules.
    """
    result = F.when((F.col("page_id") % 16).isin(MALICIOUS_KINDS), 1).otherwise(0)
    made = F.struct("page_id", _threat_url().alias("url"), result.alias("result"))
    own = F.struct((F.col("page_id") + GIVEN).alias("page_id"), F.col("url").alias("url"), F.lit(0).alias("result"))
    both = F.when(F.col("page_id") % 16 <= 12, F.array(made, own)).otherwise(F.array(made))
    return given.select(F.explode(both).alias("_row")).select("_row.*")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, result): the labelled URLs, every given one among them."""
    return corpus_rows(pages(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): chains of up to four hops, two-node cycles, a chain of twenty hops with a loop behind it, and a hub."""
    c = corpus(spark, sf_dir).select("page_id", "url")
    page = F.col("page_id")
    target = (
        F.when(page.between(*LONG_CHAIN), F.when(page == LONG_CHAIN[1], page - 2).otherwise(page + 1))
        .when(page % 14 == 10, F.lit(HUB))
        .when(page % 14 < 4, page + 1)
        .when(page % 28 == 4, page - 1)
    )
    moved = c.select(F.col("url").alias("src"), target.alias("page_id")).where("page_id is not null")
    return moved.join(c.withColumnRenamed("url", "dst"), "page_id").select("src", "dst")


def hop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): page bodies, some with a soft redirect."""
    kind = F.col("page_id") % 16
    meta = '<meta http-equiv="refresh" content="0; url=/next">'
    script = '<script>window.location.href = "http://evil.ml/x"</script>'
    html = (
        F.when(kind == 13, F.concat(F.lit(meta), F.col("html")))
        .when(kind == 14, F.concat(F.lit(script), F.col("html")))
        .otherwise(F.col("html"))
    )
    return pages(spark, sf_dir).select("page_id", "url", html.alias("html"))


def hop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, status_code, location, content_type, body): one response per corpus URL, some missing."""
    c = corpus(spark, sf_dir)
    bodies = hop_pages(spark, sf_dir).select("page_id", F.col("html").alias("body"))
    moves = edges(spark, sf_dir).select(F.col("src").alias("url"), "dst")
    kind = F.col("page_id") % 14
    bodies = bodies.withColumnRenamed("page_id", "_page")
    joined = c.join(bodies, c["page_id"] % GIVEN == bodies["_page"]).join(moves, "url", "left").where(
        (kind != 9) | F.col("page_id").between(*LONG_CHAIN))
    moved = F.col("dst").isNotNull()
    return joined.select(
        "url",
        F.when(moved, 301).when(kind.isin(7, 8), 302).otherwise(200).alias("status_code"),
        F.when(moved, F.col("dst")).when(kind == 8, "").when(kind == 7, "/next/../final?x=1").alias("location"),
        F.when(kind == 6, "image/png").otherwise("text/html").alias("content_type"),
        "body",
    )


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user_id, page_id, url): repeated requests for corpus URLs."""
    visits = log_pages(events(spark, sf_dir), spark, sf_dir).select("event_id", "ts", "user_id", "page_id")
    return visits.join(corpus(spark, sf_dir).select("page_id", "url"), "page_id")


def log_pages(requests: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the ``page_id`` of the URL they ask for: each page in turn, made and given URLs alternating."""
    n = pages(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    page = F.col("event_id") % n
    own = (F.floor(F.col("event_id") / n) % 2 == 1) & (page % 16 <= 12)
    return requests.withColumn("page_id", page + F.when(own, GIVEN).otherwise(0))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, url): one distinct URL per event, for throughput queries."""
    log = scan_log(spark, sf_dir)
    mark = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    return log.select("event_id", F.concat("url", mark, F.lit("e="), F.col("event_id").cast("string")).alias("url"))
