import math
from collections import Counter
from urllib.parse import parse_qs, unquote, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from urlrisk.functions import pages as P
from urlrisk.functions import text as X
from urlrisk.functions import urls as U
from urlrisk.operators import matching

ODD = [
    "https://www.google.com/search?q=a+b&x=%41#frag", "http://user:pw@host.com:8080/p;v=1?q", "ftp://h/p//q",
    "http://example.com/search?q=<script>alert('xss')</script>", "no-scheme.tk/path?x=1", "localhost:8080/x",
    "http://[2001:db8::1]:443/x", "//cdn.host/x", "mailto:a@b.c", "http://a_b.com:99999/", "http://h.com?x=/y//z",
    "HTTP://UPPER.COM/A;p=1/B;q=2", "http://h.com/a%2Fb%zz%C3%A9", "http://washingtonpost.com", "", "http://",
]


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_split_agrees_with_the_standard_library(urls):
    df, u = urls(ODD), F.col("url")
    rows = df.select(U.scheme(u), U.netloc(u), U.path(u), U.query(u), U.fragment(u)).collect()
    for url, row in zip(ODD, rows):
        p = urlparse(url)
        assert tuple(row) == (p.scheme, p.netloc, p.path, p.query, p.fragment), url


def test_true_host_and_port(urls):
    df, u = urls(ODD), F.col("url")
    for url, (host, port) in zip(ODD, df.select(U.true_host(U.netloc(u)), U.port(U.netloc(u))).collect()):
        p = urlparse(url)
        try:
            expected = p.port
        except ValueError:
            expected = None
        assert (host, port) == (p.hostname or "", expected), url


def test_percent_decode_agrees_with_unquote(urls):
    texts = ODD + ["%6C%6F%67%69%6E", "a+b%2Bc", "%", "%4", "%E2%82%AC%ff", "%%41"]
    assert column(urls(texts), U.percent_decode(F.col("url"))) == [unquote(t) for t in texts]


def test_entropy(urls):
    texts = ["aaaa", "ab", "hello world", "é€é", "a\nb\n", "http://xK8mN2pQ7rT4vY1z.top/a", ""]

    def expected(t):
        return -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()) if t else 0.0

    got = column(urls(texts), X.entropy(F.col("url")))
    assert got == pytest.approx([expected(t) for t in texts], abs=1e-12)


def test_host_modes(urls):
    df = urls(["https://www.washingtonpost.com/x", "https://wikipedia.org", "http://www.paypal.com"])
    assert column(df, U.domain(F.col("url"), "charstrip")) == ["ashingtonpost.com", "ikipedia.org", "paypal.com"]
    assert column(df, U.domain(F.col("url"), "prefix")) == ["washingtonpost.com", "wikipedia.org", "paypal.com"]


def test_resolve_agrees_with_urljoin(spark):
    bases = ["http://h.com/a/b/c?x=1#f", "https://h.com", "http://h.com/a//b/"]
    targets = ["/next", "x.html", "../up", "../../../top", "./here/", "?q=2", "#frag", "", "//o.net/z", "..",
               "https://abs.io/p", "/a/./b/../c", "d/../e?u=1"]
    pairs = [(b, t) for b in bases for t in targets]
    df = spark.createDataFrame(pairs, "base string, target string")
    got = column(df, U.resolve(F.col("base"), F.col("target")))
    wrong = [(p, g, urljoin(*p)) for p, g in zip(pairs, got) if g != urljoin(*p)]
    assert not wrong


def test_query_params_and_open_redirect(urls):
    items = [
        "http://redirect1.tk/go?url=http://redirect2.ml/go?url=http://final-malware.ga",
        "http://h/x?a=1&&b=&URL=https%3A%2F%2Fe.com%2Fp", "http://h/x?q=http://no.com", "http://h/x?url=foo&url=http://x.com",
        "http://h/x?next=/rel&to=http%253A%252F%252Fdouble.com", "http://h/x",
    ]
    got = column(urls(items), U.open_redirect_target(F.col("url")))
    assert got == [
        "http://redirect2.ml/go?url=http://final-malware.ga", "https://e.com/p", None, None, "http://double.com", None,
    ]
    params = column(urls(items), U.query_params(U.query(F.col("url"))))
    for url, found in zip(items, params):
        expected = [(k, v) for k, vs in parse_qs(urlparse(url).query).items() for v in vs]
        assert sorted((p.name, p.value) for p in found) == sorted(expected)


def test_validation_and_private_hosts(urls):
    df = urls(["http://h.com/a", "http://h.com/<x>", "", "http:///p", "http://" + "a" * 2050, "javascript:1"])
    assert [r.valid for r in column(df, U.validation(F.col("url")))] == [True] + [False] * 5
    hosts = urls(["http://192.168.1.1/admin", "http://172.20.0.1", "http://172.40.0.1", "http://localhost:80", "http://8.8.8.8"])
    assert column(hosts, U.is_private(F.col("url"))) == [True, True, False, True, False]
    assert column(urls(["google.com", " https://x.io "]), U.with_scheme(F.col("url"))) == ["http://google.com", "https://x.io"]


def test_parent_domains_and_lists(urls):
    df = urls(["http://a.b.c.com", "http://c.com", "http://com"])
    assert column(df, U.parent_domains(U.domain(F.col("url"), "keep"))) == [["b.c.com", "c.com"], [], []]
    hosts = urls(["api.github.com", "github.com", "notgithub.com", "secure-paypal.evil.net", "paypa1.com.x.y", "x.com"])
    assert column(hosts, matching.domain_verdict(F.col("url"))) == [
        "safe", "safe", "unknown", "malicious", "malicious", "safe",
    ]


def test_soft_redirects(spark):
    rows = [
        ("http://h/a/b", '<META http-equiv=refresh content="5; URL=/next">'),
        ("http://h/a/b", "<meta content='0;url=http://o/x' http-equiv='refresh'>"),
        ("http://h/a/b", "<script>window.location = 'javascript:void(0)'; document.location='go.html'</script>"),
        ("http://h/a/b", "<p>location, location</p>"),
    ]
    df = spark.createDataFrame(rows, "url string, html string")
    u, h = F.col("url"), F.col("html")
    assert column(df, P.meta_refresh_target(h, u)) == ["http://h/next", "http://o/x", None, None]
    assert column(df, P.script_redirect_target(h, u)) == [None, None, "http://h/a/go.html", None]


def test_positions_overlap(urls):
    assert column(urls(["aaaa"]), X.all_positions(F.col("url"), F.lit("aa"))) == [[0, 1, 2]]
    assert column(urls(["x"]), X.all_positions(F.col("url"), F.lit("aa"))) == [[]]
