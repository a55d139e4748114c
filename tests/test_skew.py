import heapq
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlrisk.operators import datasets, model, ranking
from urlrisk.plans import skew


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot_keys", [1, 1000])
def test_lookup_join_keeps_every_row(spark, monkeypatch, how, hot_keys):
    monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 20}") for i in range(300)] + [(1000, None)]
    left = spark.createDataFrame(rows, "id int, k string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(10)], "k string, v int")
    got = sorted(skew.lookup_join(left, right, "k", how, split_hot=True).select("id", "k", "v").collect(), key=str)
    want = sorted(left.join(right, "k", how).select("id", "k", "v").collect(), key=str)
    assert got == want


def test_ranks_of_a_hot_group(spark):
    rows = [("hot", i) for i in range(200)] + [("cold", 7), (None, 1)]
    df = spark.createDataFrame(rows, "g string, v int")
    ranks = skew.row_ranks(df, ["g"], [F.desc("v")]).collect()
    assert {(r.g, r.v): r["rank"] for r in ranks} == {**{("hot", i): 200 - i for i in range(200)}, ("cold", 7): 1, (None, 1): 1}


def test_budget_against_a_greedy_loop(spark):
    rng = np.random.default_rng(3)
    items = [(f"u{i}", float(rng.integers(1, 5)) / 4, 3.0, float(rng.integers(1, 4)), int(i % 3 > 0)) for i in range(150)]
    df = spark.createDataFrame(items, "url string, threat_probability double, entropy double, lookup_cost double, batch int")
    got = {(r.batch, r.url): r.partial for r in ranking.budgeted_selection(df, 40.5, ["batch"]).collect()}
    import hashlib

    want = {}
    for batch in (0, 1):
        order = sorted((x for x in items if x[4] == batch),
                       key=lambda x: (-x[1] * x[2] / x[3], hashlib.md5(x[0].encode()).hexdigest()))
        left = 40.5
        for url, _, _, cost, _ in order:
            if left <= 0:
                break
            want[(batch, url)] = cost > left
            if cost > left:
                break
            left -= cost
    assert got == want


def test_code_length_against_a_heap(urls):
    def expected(texts):
        heap = list(Counter("".join(texts)).values())
        total, n = 0, sum(heap)
        heapq.heapify(heap)
        while len(heap) > 1:
            pair = heapq.heappop(heap) + heapq.heappop(heap)
            total += pair
            heapq.heappush(heap, pair)
        return total / n

    texts = ["http://abc.com/xyz", "https://example.org", "aaaa"]
    assert ranking.code_length_baseline(urls(texts)).first()[0] == pytest.approx(expected(texts))
    assert ranking.code_length_baseline(urls(["aaa"])).first()[0] == 1.0
    assert ranking.code_length_baseline(urls([""])).first()[0] == 0.0


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    values = [("a", float(v)) for v in rng.integers(0, 50, 500)] + [("b", 3.5)]
    df = spark.createDataFrame(values, "g string, v double")
    rows = {r.g: r for r in datasets.distribution_profile(df, "v", ["g"]).collect()}
    a = np.array([v for g, v in values if g == "a"])
    got = rows["a"]
    assert (got.median_value, got.p95_value, got.p99_value) == pytest.approx(
        (np.median(a), np.percentile(a, 95), np.percentile(a, 99)))
    assert got.std_value == pytest.approx(a.std()) and rows["b"].p99_value == 3.5


def test_split_is_exact_per_class(spark):
    df = spark.createDataFrame([(f"u{i}", int(i < 300)) for i in range(400)], "url string, result int")
    counts = {(r.result, r.split): r["count"] for r in datasets.stratified_split(df).groupBy("result", "split").count().collect()}
    assert counts == {(1, "train"): 210, (1, "val"): 45, (1, "test"): 45, (0, "train"): 70, (0, "val"): 15, (0, "test"): 15}


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "result int, threat_probability double")
    assert model.roc_auc(df).first()[0] == pytest.approx(0.875)


def test_keep_first(spark):
    df = spark.createDataFrame([("u", "b", 1, 5), ("u", "a", 0, 9), ("v", "c", 1, 1)], "url string, label string, source int, line int")
    rows = {r.url: r.label for r in datasets.keep_first(df, ["source", "line"]).collect()}
    assert rows == {"u": "a", "v": "c"}
