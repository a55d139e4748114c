import random

import pytest

from urlrisk.operators import keywords, ranking

SCHEMA = "category string, keyword string, weight double"



def test_builtin_dictionary_as_a_table(spark, urls):
    given = urls(["http://paypal.secure-login.tk/verify?account=1", "http://a.org/", "", None, "HTTP://LOGIN.VERIFY/login", "http://a.org/"])
    table = keywords.dictionary_scan(given, keywords.builtin_dictionary(spark))
    plain = {r.url: (r.category_score, r.categories, r.keyword_hits) for r in keywords.categorized_scan(given).collect() if r.url is not None}
    got = {r.url: (r.category_score, r.categories, r.keyword_hits) for r in table.collect() if r.url is not None}
    assert got == plain and table.count() == 6


@pytest.mark.parametrize("size", [2, 3, 5])
def test_a_hundred_thousand_keywords(spark, urls, size):
    rng = random.Random(size)
    words = {"".join(rng.choices("abcdefgh", k=rng.randrange(1, 10))) for _ in range(260_000)}
    given = ["http://" + "".join(rng.choices("abcdefgh", k=rng.randrange(1, 25))) + ".org/" for _ in range(60)] + ["é", "http://é.org"]
    table = [(f"c{len(w) % 4}", w, 0.25) for w in sorted(words)] + [("x", "É", 1.0), ("x", "", 1.0), ("x", None, 1.0), ("c0", "ORG", 0.5), ("c0", "org", 0.1)]
    assert len(table) > 100_000
    dictionary = spark.createDataFrame(table, SCHEMA).cache()
    got = {(r.url, r.category, r.keyword, r.weight) for r in keywords.dictionary_hits(urls(given), dictionary, size=size).collect()}
    lowered = {(c, w.lower()): v for c, w, v in sorted(table, key=lambda t: t[2]) if w}
    assert got == {(u, c, w, v) for (c, w), v in lowered.items() for u in given if w in u.lower()}
    plan = keywords.dictionary_hits(urls(given), dictionary, size=size)._jdf.queryExecution().toString()
    assert len(plan) < 100_000  # no list of keywords in it


def test_empty_dictionary(spark, urls):
    scanned = keywords.dictionary_scan(urls(["http://a.org/"]), spark.createDataFrame([], SCHEMA)).first()
    assert (scanned.category_score, scanned.categories, scanned.keyword_hits) == (0.0, {}, {})


def test_rank_weights(spark):
    df = spark.createDataFrame([("u", 0.5, 2.0, 4)], "url string, threat_probability double, entropy double, redirect_depth int")
    usual = ranking.with_rank(df).first().threat_rank
    assert usual == pytest.approx(0.45 * 0.5 + 0.25 * 0.4 + 0.2 * 0.4)
    other = ranking.with_rank(df, weights={"probability": 1.0, "entropy": 0.0}).first().threat_rank
    assert other == pytest.approx(0.5 + 0.2 * 0.4)
    with pytest.raises(ValueError, match="weights"):
        ranking.with_rank(df, weights={"probabilty": 1.0})
