"""Filters, lists and states that grow by batches."""

import pytest
from pyspark.sql import functions as F

from urlrisk import catalogs as C
from urlrisk.operators import sketches as K
from urlrisk.operators import stored_filters as SF
from urlrisk.plans.lineage import scratch_path
from urlrisk.plans.versions import KeyedTable, Versions
from urlrisk.streaming import state


def items(spark, names, column="pattern"):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_plain_filter_in_batches(spark):
    shape = K.Shape.plain(500, 0.01)
    path = scratch_path(spark, "plain")
    names = [f"http://m{i}.com" for i in range(90)] + ["http://m1.com", None]
    for batch in (0, 1, 1, 2, 0):  # some batches run again, also late
        SF.PlainStore(spark, path, shape).add(items(spark, names[batch * 30:(batch + 1) * 32], "url"), "url", batch)
    store = SF.PlainStore(spark, path, shape)
    assert rows(store.words()) == rows(K.build_plain(items(spark, names[:64] + names[60:], "url"), "url", shape))
    store.add(items(spark, ["http://later.com"], "url"), "url")
    assert store.probe(items(spark, ["http://later.com", "http://m3.com"], "url"), "url").where("in_filter").count() == 2
    with pytest.raises(ValueError, match="positions"):
        SF.PlainStore(spark, path, K.Shape(10, 1)).words()


def test_a_stopped_version_is_written_anew(spark):
    shape = K.Shape.plain(500, 0.01)
    path = scratch_path(spark, "plain")
    store = SF.PlainStore(spark, path, shape)
    store.add(items(spark, ["a"], "url"), "url", 0)
    Versions(spark, path).write(1, "words", spark.createDataFrame([(7, 7)], SF.WORDS))  # never committed
    assert rows(store.words()) == rows(K.build_plain(items(spark, ["a"], "url"), "url", shape))
    store.add(items(spark, ["b"], "url"), "url", 1)
    assert rows(store.words()) == rows(K.build_plain(items(spark, ["a", "b"], "url"), "url", shape))


@pytest.mark.parametrize("capacity", [1000, 30])
def test_ensemble_in_batches(spark, capacity):
    """A store of three batches votes as one build does, after removals too."""
    bad, good = [f"bad{i}.com" for i in range(60)], [f"good{i}.org" for i in range(20)]
    store = SF.EnsembleStore(spark, scratch_path(spark, "ensemble"), capacity, 100)
    for batch in range(3):
        for _ in range(2):
            store.add(items(spark, bad[batch::3]), items(spark, good[batch::3]), batch=batch)
    store.remove(items(spark, [*bad[:5], "never.com", bad[0]]), batch=3)
    store.remove(items(spark, bad[:5]), batch=3)
    once = K.data_ensemble(items(spark, bad), items(spark, good), removed=items(spark, [*bad[:5], "never.com"]), capacity=capacity, allow_capacity=100)
    asked = items(spark, [*bad, *good, *[f"other{i}.net" for i in range(100)]])
    flags = ["pattern", "vote_allow", "vote_fingerprint", "vote_counting"]
    got, want = K.vote(asked, "pattern", store.ensemble()), K.vote(asked, "pattern", once)
    assert rows(got.select(*flags)) == rows(want.select(*flags))
    assert got.where("pattern LIKE 'bad%' AND NOT vote_sliced").count() == 0
    if capacity == 1000:  # one slice, so the same positions
        assert rows(got.select("pattern", "bloom_result")) == rows(want.select("pattern", "bloom_result"))
    stats = store.stats().first()
    # in few buckets an entry that never came may share a fingerprint with one that did
    assert stats.blacklist_entries == 55 or capacity == 30 and stats.blacklist_entries == 54
    assert (stats.slices > 1) == (capacity == 30)
    store.add(malicious=items(spark, ["new.example"]))
    assert K.vote(items(spark, ["new.example"]), "pattern", store.ensemble()).first().bloom_result == "KNOWN_MALICIOUS"
    with pytest.raises(ValueError, match="made with"):
        SF.EnsembleStore(spark, store.versions.path, capacity + 1, 100).ensemble()


def test_empty_store(spark):
    store = SF.EnsembleStore(spark, scratch_path(spark, "ensemble"), 100, 100)
    assert K.vote(items(spark, ["a.com", None]), "pattern", store.ensemble()).where("bloom_result = 'UNCERTAIN'").count() == 1
    assert store.stats().first().blacklist_entries == 0


def test_slices_grow_tighter(spark):
    slices, held = K.Slices(50), []
    for batch in range(5):
        held = SF.grow_slices(held, items(spark, [f"u{i}" for i in range(batch * 70, batch * 70 + 90)]), "pattern", slices)
    assert len(held) > 3 and sum(n for n, _ in held) <= 370
    assert all(n <= 1.3 * slices.room(i) for i, (n, _) in enumerate(held))
    built = [(slices.shape(i), words) for i, (_, words) in enumerate(held)]
    asked = items(spark, [f"u{i}" for i in range(370)] + [f"other{i}" for i in range(1000)])
    hits = K.probe_sliced(asked, "pattern", built).where("in_filter")
    assert hits.where("pattern LIKE 'u%'").count() == 370 and hits.where("pattern LIKE 'other%'").count() < 150  # 0.6 ** 7 a slice at most
    again = SF.grow_slices(held, items(spark, ["u1", "u2", None]), "pattern", slices)
    assert [n for n, _ in again] == [n for n, _ in held]


def test_slices_grow_in_one_table(spark):
    """A batch that opens many slices makes as many plans as one that opens few, and none per slice."""
    batch = items(spark, [f"u{i}" for i in range(1200)] + ["u1", None])
    few, many = (SF.grow_slices([], batch, "pattern", K.Slices(n)) for n in (1200, 20))
    assert len(many) > 20 * len(few) and sum(many.counts) == sum(few.counts) == 1200
    assert many.table.columns == ["slice", "word", "bits"] and many.table.select("slice").distinct().count() == len(many)
    assert len(many.table._jdf.queryExecution().logical().toString()) <= 1.2 * len(few.table._jdf.queryExecution().logical().toString())
    again = SF.grow_slices(many, items(spark, [f"u{i}" for i in range(1100, 1400)]), "pattern", K.Slices(20))
    assert sum(again.counts) <= 1400 and K.probe_sliced(items(spark, [f"u{i}" for i in range(1400)]), "pattern", again.filter(K.Slices(20))).where(
        "NOT in_filter").count() == 0


@pytest.mark.parametrize("fold_every", [1, 3, 16])
def test_keyed_table(spark, fold_every):
    path = scratch_path(spark, "keyed")
    table = KeyedTable(spark, path, "k string, a int, b string", "k", fold_every)
    assert table.read().count() == 0 and table.read().columns == ["k", "a", "b"]

    def put(batch, *given, **how):
        df = spark.createDataFrame([(a, b, k) for k, a, b in given], "a int, b string, k string")
        table.upsert(df, batch, **how)

    put(0, ("x", 1, "one"), ("y", 2, "two"), ("y", 3, "two"), (None, 0, "no key"))
    put(1, ("x", 0, "later"), ("z", 9, None))
    put(1, ("x", 7, "the batch again"))
    assert rows(table.read()) == [("x", 0, "later"), ("y", 3, "two"), ("z", 9, None)]
    put(2, ("y", None, None), gone=True)
    assert rows(table.read()) == [("x", 0, "later"), ("z", 9, None)]
    put(3, ("y", 5, "back"))
    for i in range(4, 9):
        put(i, (f"n{i}", i, "n"))
    assert len(table.read().collect()) == 8
    assert len(KeyedTable(spark, path, "k string, a int, b string", "k").versions.latest().facts["parts"]) <= fold_every + 1


def test_lists_change_between_batches(spark):
    """An entry that is added between two micro-batches changes the second one only."""
    lists = state.ListTable(spark, scratch_path(spark, "lists"))
    lists.insert(spark.createDataFrame([("good.com", "safe"), ("old.com", "malicious")], "pattern string, kind string"))
    folder, table = scratch_path(spark, "urls"), scratch_path(spark, "gated")
    counters = KeyedTable(spark, scratch_path(spark, "counts"), state.COUNTS, "decision")
    for batch in range(2):
        if batch:
            lists.insert(spark.createDataFrame([("new.com", "malicious")], "pattern string, kind string"))
            lists.delete(spark.createDataFrame([("old.com", "malicious")], "pattern string, kind string"))
        urls = [f"http://{h}/{batch}" for h in ("good.com", "old.com", "new.com")]
        spark.createDataFrame([(u,) for u in urls], "url string").write.mode("append").parquet(folder)
        state.gate_batches(spark.readStream.schema("url string").parquet(folder), lists, table, counters).awaitTermination()
    got = dict(spark.read.parquet(table).select("url", "list_result").collect())
    assert got == {
        "http://good.com/0": "safe", "http://old.com/0": "malicious", "http://new.com/0": "unknown",
        "http://good.com/1": "safe", "http://old.com/1": "unknown", "http://new.com/1": "malicious"}
    assert dict(counters.read().collect()) == {"PASS": 2, "BLOCK": 2, "FORWARD": 2}


def test_verified_in_the_first_batch_is_possible_in_the_second(spark):
    bad, plain = "http://10.0.0.1/login-verify-secure-account.xyz", "http://plain.org/"
    schema = "url string, ts timestamp, redirect_depth int"
    folder, table, path = (scratch_path(spark, n) for n in ("requests", "judged", "learned"))
    shape = K.Shape.rounded(100, 0.001)
    filters = [K.learn(items(spark, [bad], "url"), shape), K.learn(items(spark, [], "url"), shape)]
    for day in (1, 2):
        spark.sql(f"SELECT url, timestamp'2024-01-0{day} 00:00:00' AS ts, 5 AS redirect_depth FROM VALUES ('{bad}'), ('{bad}'), ('{plain}') AS t(url)").write.mode("append").parquet(folder)
        learned = state.learned_table(spark, path)  # the job is started anew
        state.judge_batches(spark.readStream.schema(schema).parquet(folder), filters[day - 1], learned, table).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(table).select("batch", "url", "in_filter", "membership_verdict").collect()}
    assert got == {(0, bad, True, "malicious"), (0, plain, False, "unknown"), (1, bad, False, "malicious"), (1, plain, False, "unknown")}
    assert spark.read.parquet(table).count() == 6 and [r.url for r in learned.read().collect()] == [bad]


def test_decayed_entries_are_not_consulted(spark):
    learned = state.learned_table(spark, scratch_path(spark, "learned"), fold_every=1)
    learned.upsert(spark.sql("SELECT 'scored' url, 1.0D score, timestamp'2024-01-01 00:00:00' inserted_at, false verified UNION ALL "
                             "SELECT 'verified', 1.0D, timestamp'2024-01-01 00:00:00', true"), 0)
    soon, late = (F.lit(t).cast("timestamp") for t in ("2024-01-01 01:00:00", "2024-01-02 00:00:00"))
    assert {r.url for r in state.live_entries(learned, soon).collect()} == {"scored", "verified"}
    assert {r.url for r in state.live_entries(learned, late).collect()} == {"verified"}
    learned.upsert(spark.sql("SELECT 'other' url, 1.0D score, timestamp'2024-01-02 00:00:00' inserted_at, true verified"), 1, keep=state._lives(late, 0.1))
    assert {r.url for r in learned.read().collect()} == {"verified", "other"}  # the fold forgot the other


def test_expansions_are_remembered(spark, urls):
    def log(*hops):
        return spark.createDataFrame([(u, 301, v, "text/html", "") for u, v in hops], C.HOP_LOG)

    known = state.expansion_table(spark, scratch_path(spark, "expansions"))
    at = [F.lit(t).cast("timestamp") for t in ("2024-01-01 00:00:00", "2024-01-01 12:00:00", "2024-01-03 00:00:00")]
    first = state.expand_remembered(urls(["http://a.org/", None]), log(("http://a.org/", "http://b.org/")), known, at[0])
    assert [r.expanded_url for r in first.collect()] == ["http://b.org/"]
    moved = log(("http://a.org/", "http://c.org/"), ("http://d.org/", "http://c.org/"))
    second = state.expand_remembered(urls(["http://a.org/", "http://d.org/"]), moved, known, at[1])
    assert dict(second.select("url", "expanded_url").collect()) == {"http://a.org/": "http://b.org/", "http://d.org/": "http://c.org/"}
    third = state.expand_remembered(urls(["http://a.org/"]), moved, known, at[2])
    assert [r.expanded_url for r in third.collect()] == ["http://c.org/"]
    assert known.read().count() == 2
