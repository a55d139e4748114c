import hashlib
import random
from itertools import combinations

import duckdb
import pytest

import __spark_entry__ as entry_point
from urlrisk.operators import chains, similar

P = 2147483647


def trigrams(url):
    low = url.lower()
    return {low[i:i + 3] for i in range(len(low) - 2)}


def signature(url, hashes):
    pairs = [(int(d[:7], 16), int(d[8:15], 16)) for d in (hashlib.md5(g.encode()).hexdigest() for g in trigrams(url))]
    return [min((a + i * b) % P for a, b in pairs) for i in range(hashes)]


def some_urls(seed=1):
    rng = random.Random(seed)
    hosts = ["paypa1-secure.xyz", "github.com", "go.example.com", "evil.xyz:8888"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['login/verify', 'org/repo', 'out', 'a/b/c'])}?n={rng.randrange(60)}" for _ in range(120)]
    urls += [f"http://shop.example.net/item/{i}" for i in range(150)]  # one band holds most of the rows
    return [*urls, *urls[:10], "", "ab", "abc", "ABC", None, None, "é" * 5000]


@pytest.mark.parametrize(("threshold", "hashes", "block"), [(0.8, 10, 512), (0.8, 10, 16), (0.9, 20, 32), (0.5, 10, 64)])
def test_every_similar_pair_is_found(spark, urls, threshold, hashes, block):
    given = some_urls()
    signed = {u: signature(u, hashes) for u in {u for u in given if u and len(u) >= 3}}
    wanted = {}
    for a, b in combinations(sorted(signed, key=str.encode), 2):
        same = sum(x == y for x, y in zip(signed[a], signed[b], strict=True)) / hashes
        if same >= threshold:
            wanted[a, b] = same
    rows = similar.similar_urls(urls(given), threshold, hashes, block=block).collect()
    assert len(rows) == len(wanted) and {(r.first_url, r.second_url): r.similarity for r in rows} == wanted
    # of truly similar pairs, by their trigrams, most have signatures that say so
    true = [(a, b) for a, b in combinations(sorted(signed, key=str.encode), 2)
            if len(trigrams(a) & trigrams(b)) >= 0.95 * len(trigrams(a) | trigrams(b))]
    assert true and sum(p in wanted for p in true) >= 0.9 * len(true)


@pytest.mark.parametrize(("threshold", "hashes", "most"), [(0.8, 10, 1024), (0.7, 6, 1024), (1.0, 4, 1024), (0.8, 10, 0)])
def test_counts_without_pairs(spark, urls, monkeypatch, threshold, hashes, most):
    """Classes, links and the most similar URL are those of all pairs, by groups or, with too many choices, by pairs."""
    monkeypatch.setattr(similar, "MOST_CHOICES", most)
    if most:
        monkeypatch.setattr(similar, "similar_urls", None)  # pairs are not made
    signed = {u: signature(u, hashes) for u in {u for u in some_urls() if u and len(u) >= 3}}
    least, wanted = round(threshold * hashes + 0.49), {}
    for a, mine in signed.items():
        near = [(-sum(x == y for x, y in zip(mine, other, strict=True)), b.encode(), b) for b, other in signed.items() if b != a]
        near = sorted(n for n in near if -n[0] >= least)
        twins = [b for b, other in signed.items() if other == mine]
        wanted[a] = (min(twins, key=str.encode), len(near), *((near[0][2], -near[0][0] / hashes) if near else (None, None)))
    rows = similar.similar_counts(urls(some_urls()), threshold, hashes).collect()
    assert len(rows) == len(wanted) and {r.url: tuple(r)[1:] for r in rows} == wanted
    assert similar.most_similar(urls(some_urls()), threshold, hashes).count() == sum(w[1] > 0 for w in wanted.values())


def test_the_query_returns_every_pair(spark, tmp_path):
    """Each two similar URLs of the corpus are a row, those of one signature as well; by its SQL too."""
    spark.range(480).selectExpr("id AS page_id", "concat('http://shop.example.net/item/', id) AS url", "'' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    made = entry_point.queries()["b22_similar_urls"](spark, str(tmp_path))
    rows = {tuple(r) for r in made.select("first_url", "second_url", "similarity").collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    corpus = [u for u, in duck.execute("SELECT url FROM pages WHERE page_id % 16 > 12").fetchall()]
    signed = {u: signature(u, 10) for u in corpus}
    same = {(a, b): sum(x == y for x, y in zip(signed[a], signed[b], strict=True)) for a, b in combinations(sorted(corpus), 2)}
    assert {p for p, n in same.items() if n >= 8} == {(a, b) for a, b, _ in rows if a in signed and b in signed}
    assert {8, 9, 10} <= {round(10 * s) for _, _, s in rows}
    assert set(duck.execute(entry_point.oracle_sql()["b22_similar_urls"]).fetchall()) == rows


def test_pairs_are_made_by_blocks(spark, urls, monkeypatch):
    """Classes of many blocks: every pair comes once, however the blocks and tasks are cut."""
    given = urls([f"http://shop.example.net/item/{i}{i}" for i in range(10, 400)] + [None, "ab"])
    whole = similar.similar_urls(given)
    monkeypatch.setattr(similar, "PAIRS_A_TASK", 100)
    cut = similar.similar_urls(given, block=7)
    assert sorted(whole.collect()) == sorted(cut.collect()) and whole.count() > 1000
    assert cut.rdd.getNumPartitions() > 10 * whole.rdd.getNumPartitions()


def test_bands_leave_one_whole():
    for hashes in range(1, 40):
        for least in range(1, hashes + 1):
            bands, rows = similar.band_shape(hashes, least)
            assert rows >= 1 and bands * rows <= hashes and bands > hashes - least


def test_no_task_gets_a_frequent_band(spark, urls):
    """The rows of one band and block pair are few, though a band holds most of the URLs."""
    signed = similar.signatures(urls([f"http://shop.example.net/item/{i}" for i in range(1500)]), 10, 3, 3)
    most = signed.selectExpr("posexplode(keys) as (band, key)").groupBy("band", "key").count().agg({"count": "max"}).first()[0]
    pairs = similar.similar_urls(urls([f"http://shop.example.net/item/{i}" for i in range(1500)]), block=100)
    assert most > 500 and pairs.count() == pairs.distinct().count() > 0


def test_edges_of_the_join(spark, urls):
    best = {r.url: r for r in similar.most_similar(urls(["http://a.org/1", "http://a.org/1", "http://a.org/2", None, "zz"]), 0.5).collect()}
    assert set(best) <= {"http://a.org/1", "http://a.org/2"}
    empty = spark.createDataFrame([], "url string")
    assert similar.similar_urls(empty).count() == 0 and similar.most_similar(empty).count() == 0


def hop_by_hop(log, start, most):
    """Chain following one request after the other."""
    seen, errors, at = [start], [], start
    while True:
        hop = len(seen) - 1
        if at not in log:
            errors.append(f"Connect error at hop {hop} ({at})")
            return seen, False, errors
        target = log[at]
        if target is None:
            return seen, False, errors
        if hop < most and target in seen:
            return seen, True, [*errors, f"Redirect loop at hop {hop + 1}: {target}"]
        if hop == most:
            return seen, False, errors
        seen.append(target)
        at = target


@pytest.mark.parametrize("most", [1, 3, 9, 15, 16])
def test_doubling_against_one_hop_at_a_time(spark, urls, most):
    rng = random.Random(most)
    names = [f"http://n{i}.org/" for i in range(60)]
    log = {n: rng.choice([None, names[0], rng.choice(names), f"http://gone{rng.randrange(5)}.org/"]) for n in names}
    log |= {f"http://c{i}.org/": f"http://c{i + 1}.org/" for i in range(24)} | {"http://c24.org/": "http://c22.org/", "http://self.org/": "http://self.org/"}
    table = spark.createDataFrame([(u, 301 if t else 200, t, "http_3xx" if t else "none", None) for u, t in log.items()],
                                  "url string, status_code int, next_url string, hop_type string, hop_error string")
    asked = [*log, "http://never.org/"]
    rows = chains.follow(urls([*asked, asked[0]]), table, most).collect()
    assert len(rows) == len(asked)
    got = {r.url: ([h.url for h in r.hops], r.loop_detected, r.errors) for r in rows}
    assert got == {u: hop_by_hop(log, u, most) for u in asked}
    assert all([h.hop for h in r.hops] == list(range(len(r.hops))) for r in rows)


def test_doubling_takes_few_rounds(spark, urls, monkeypatch):
    written = []
    real = chains.cut

    def watch(df):
        written.append(1)
        return real(df)

    monkeypatch.setattr(chains, "cut", watch)
    table = spark.createDataFrame([(f"http://c{i}.org/", 301, f"http://c{i + 1}.org/", "http_3xx", None) for i in range(20)],
                                  "url string, status_code int, next_url string, hop_type string, hop_error string")
    rows = chains.follow(urls(["http://c0.org/"]), table, 15).collect()
    assert len(rows[0].hops) == 16 and rows[0].next_url == "http://c16.org/"
    assert len(written) == 6  # the table, four doublings, the result
