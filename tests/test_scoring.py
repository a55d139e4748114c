import math

import pytest
from pyspark.sql import functions as F

from urlrisk import catalogs as C
from urlrisk.operators import features, gate, keywords, model, scoring
from urlrisk.plans import scan


def by_url(df):
    return {r["url"]: r for r in df.collect()}


def test_catalog_sizes():
    assert len(C.ALLOW_LIST_A) == 112 and len(C.ALLOW_LIST_B) == 38 and len(C.SAFE_DOMAINS) == 55
    assert len(C.MALICIOUS_DOMAINS) == 31 and len(C.MALICIOUS_PREFIXES) == 10
    assert len(C.KEYWORDS_BY_PROFILE["A"]) == 61 and len(C.LURE_KEYWORDS) == 41
    assert len(C.SHORTENERS_A) == 34 and len(C.SHORTENERS_B) == 42 and len(C.OPEN_REDIRECT_PARAMS) == 41
    assert sum(len(v) for v in C.CATEGORY_KEYWORDS.values()) == 65 and len(C.FEATURES) == 25


@pytest.mark.parametrize("profile", ["A", "B"])
def test_fixture_features(urls, profile):
    rows = by_url(features.extract_features(urls([
        "http://paypal.secure-login.xyz/verify", "http://g00gle.com", "http://micr0soft.com", "http://paypa1.com",
        "http://legitimate.com@evil-phishing.xyz/login", "http://malicious-site.com:4444/payload",
        "http://192.168.1.1/admin", "https://github.com",
    ]), profile))
    first = rows["http://paypal.secure-login.xyz/verify"]
    assert first.tld_suspicious and first.keyword_score > 0 and first.brand_in_subdomain
    assert rows["http://g00gle.com"].has_homograph and rows["http://micr0soft.com"].has_homograph
    assert not rows["http://paypa1.com"].has_homograph
    assert rows["http://legitimate.com@evil-phishing.xyz/login"].has_at_symbol
    assert rows["http://malicious-site.com:4444/payload"].has_suspicious_port
    assert rows["http://192.168.1.1/admin"].has_ip
    assert rows["https://github.com"].has_https and rows["https://github.com"].chain_length == (0 if profile == "A" else 1)


def test_schemeless_host_in_profile_a(urls):
    rows = by_url(features.extract_features(urls(["evil.tk/path", "paypal.evil.com/x"]), "A"))
    assert rows["evil.tk/path"].tld_suspicious
    assert rows["paypal.evil.com/x"].brand_in_subdomain


def test_probability_floor(urls):
    """Without an allow list no URL is ever safe: the weights bottom out well above the threshold."""
    lowest = sum(w for w in C.WEIGHTS if w < 0)
    assert 1 / (1 + math.exp(-5 * lowest)) == pytest.approx(0.354, abs=1e-3)
    scored = scoring.classify_a(features.extract_features(urls(["https://a.com", "https://www.google.com"]), "A"))
    rows = by_url(scored)
    assert rows["https://a.com"].verdict == "uncertain" and rows["https://www.google.com"].verdict == "safe"
    assert rows["https://www.google.com"].threat_probability == 0.01


def test_risk_points(spark):
    flags = {n: False for n in C.BOOLEAN_FEATURES}
    calm = {**{n: 0.0 for n in C.FEATURES}, **flags, "threat_probability": 0.02, "redirect_count": 0,
            "loop_detected": False, "excessive_redirects": False, "suspicious_hops": 0, "url": "calm"}
    wild = {**calm, **{n: True for n in flags}, "threat_probability": 0.95, "redirect_count": 5, "loop_detected": True,
            "excessive_redirects": True, "suspicious_hops": 3, "keyword_score": 0.5, "url_entropy": 5.0,
            "url_length": 150.0, "url": "wild"}
    rows = by_url(scoring.risk_score(spark.createDataFrame([calm, wild])))
    assert (rows["calm"].risk_score, rows["calm"].risk_level) == (1, "Safe")
    assert (rows["wild"].ml_points, rows["wild"].redirect_points, rows["wild"].heuristic_points) == (52, 25, 20)
    assert (rows["wild"].risk_score, rows["wild"].risk_level) == (97, "Malicious")


def test_gate_partitions_its_input(urls):
    items = [
        "https://github.com", "https://api.github.com/v1", "http://paypa1-secure.xyz/login/verify?account=reset",
        "https://www.washingtonpost.com", "http://unknown-site.info/x",
    ]
    forwarded, settled = gate.split(gate.gate(urls(items)))
    rows = by_url(gate.fast_path(settled))
    assert {r.url for r in forwarded.collect()} == {"https://www.washingtonpost.com", "http://unknown-site.info/x"}
    assert rows["https://github.com"].decision == "PASS" and rows["https://github.com"].risk_score == 1
    blocked = rows["http://paypa1-secure.xyz/login/verify?account=reset"]
    assert (blocked.decision, blocked.risk_score, blocked.threat_probability) == ("BLOCK", 70, 0.75)
    assert blocked.confidence == pytest.approx(0.60)


def test_gate_reads_no_shuffle(urls):
    plan = gate.gate(urls(["http://a.com"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_update_counts_as_download(urls):
    row = keywords.categorized_scan(urls(["http://x.com/update"])).first()
    assert row.categories == {"download": 1} and row.keyword_hits == {"update": [13]}


def test_requests_are_checked(urls):
    rows = {r.requested_url: r for r in scan.accept_requests(urls(["google.com", "", "http://a b.com"])).collect()}
    assert rows["google.com"].valid and rows["google.com"].url == "http://google.com"
    assert not rows[""].valid and not rows["http://a b.com"].valid


def test_scan_returns_rejected_requests(spark, urls):
    log = spark.createDataFrame([], C.HOP_LOG)
    rows = {r.url: r for r in scan.scan_b(urls(["github.com", "", "http://a b.com", None]), log).collect()}
    assert rows["http://github.com"].valid and rows["http://github.com"].risk_score is not None
    assert not rows[""].valid and not rows["http://a b.com"].valid and not rows[None].valid
    assert rows[""].reason and rows[None].reason and rows[""].risk_score is None


def test_neutral_defaults(spark):
    df = spark.createDataFrame([("http://a", None, None)], "url string, label string, threat_probability double")
    row = scoring.neutral_defaults(df).first()
    assert (row.label, row.threat_probability, row.errors) == ("Unknown", 0.0, ["prediction missing"])


def test_training_rows_are_dealt_evenly(spark, monkeypatch):
    """Each step of the solver waits for the largest partition; a split by ranks may leave all training rows in one."""
    dealt = []

    class Stopped(Exception):
        pass

    class Watch:
        def __init__(self, **given):
            pass

        def fit(self, train):
            dealt.extend(len(p) for p in train.rdd.glom().collect())
            raise Stopped

    monkeypatch.setattr(model, "MultilayerPerceptronClassifier", Watch)
    rows = spark.range(4000).coalesce(1)
    with pytest.raises(Stopped):
        model.train_network(rows, rows)
    assert sum(dealt) == 4000 and len(dealt) == spark.sparkContext.defaultParallelism and max(dealt) < 1.2 * min(dealt)
