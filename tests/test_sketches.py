import hashlib

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from urlrisk.operators import sketches as K


def digest(text):
    return int(hashlib.md5(text.encode()).hexdigest(), 16)


def test_sizes():
    assert K.Shape.plain() == K.Shape(3031313, 6)
    assert K.Shape.rounded(200_000, 0.01) == K.Shape(1917011, 7)
    assert K.Shape.rounded(50_000, 0.001) == K.Shape(718879, 10)
    assert K.fingerprint_buckets(200_000) == 65536


def test_positions_are_the_md5_residues(urls):
    shape = K.Shape.plain(1000, 0.01)
    rows = urls(["http://a.com", "é"]).select("url", F.array(*K.plain_positions(F.col("url"), shape))).collect()
    for url, got in rows:
        assert got == [digest(f"{i}:{url}") % shape.m for i in range(shape.k)]


def test_filters_have_no_false_negatives_and_both_probes_agree(urls):
    members = urls([f"http://m{i}.com" for i in range(300)])
    probes = urls([f"http://m{i}.com" for i in range(600)] + ["http://m1.com"] * 200)
    shape = K.Shape.plain(300, 0.05)
    words = K.build_plain(members, "url", shape)
    shipped = sorted(K.probe_plain(probes, "url", words, shape).collect())
    shuffled = sorted(K.probe_plain(probes, "url", words, shape, ship_up_to=0).collect())
    assert shipped == shuffled and len(shipped) == 800
    inside = {f"http://m{i}.com" for i in range(300)}
    assert all(hit for url, hit in shipped if url in inside)
    bits = {digest(f"{i}:{u}") % shape.m for u in inside for i in range(shape.k)}
    for url, hit in shipped:
        assert hit == all(digest(f"{i}:{url}") % shape.m in bits for i in range(shape.k))


def test_probe_of_many_known_urls_tells_them_apart(spark, tmp_path):
    """The filter of the registered probe has room for its list: it holds the known URLs and next to none of the others."""
    spark.range(800).selectExpr("id AS page_id", "concat('http://h', id, '.org/') AS url", "'' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    rows = dict(entry_point.queries()["f3_bloom_probe"](spark, str(tmp_path)).collect())
    known = {u for u in rows if u.startswith(("http://paypa1", "http://paypal.", "http://evil.xyz", "http://secure-paypal"))}
    assert len(known) == 200 and len(rows) == 1450 and all(rows[u] for u in known)
    assert sum(rows.values()) <= len(known) + 2
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert dict(duck.execute(entry_point.oracle_sql()["f3_bloom_probe"]).fetchall()) == rows


def test_counting_filter_removes_what_it_contains(urls):
    shape = K.Shape.rounded(100, 0.001)
    table = K.counting_table(urls(["a", "b", "b"]), "url", shape)
    left = K.counting_remove(table, urls(["a", "zzz"]), "url", shape)
    rows = dict(K.counting_probe(urls(["a", "b"]), "url", left, shape).collect())
    assert rows == {"a": False, "b": True}
    assert left.agg(F.sum("count")).first()[0] == 2 * shape.k


def test_sliced_filter_grows(urls):
    members = urls([f"u{i}" for i in range(400)])
    built = K.build_sliced(members, "url", K.Slices(50))
    assert len(built) > 3 and len({shape for shape, _ in built}) == len(built)
    assert all(r.in_filter for r in K.probe_sliced(members, "url", built).collect())


def test_slices_of_one_table(urls):
    """Many slices: the plans have no part per slice, and the slices hold what they hold apart, by each way of probing."""
    members = urls([f"u{i}" for i in range(900)] + ["u1", None])
    few, many = K.build_sliced(members, "url", K.Slices(300)), K.build_sliced(members, "url", K.Slices(30))
    assert len(many) > 6 * len(few)
    asked = urls([f"u{i}" for i in range(1000)] + [f"other{i}" for i in range(3000)] + [None, "u1", ""])

    def size(df):
        return len(df._jdf.queryExecution().logical().toString())

    assert size(many.words) < 1.2 * size(few.words)
    assert size(K.probe_sliced(asked, "url", many)) < 3 * size(K.probe_sliced(asked, "url", few))  # 20 hashes instead of 8
    in_slices = [(s, set()) for s in many.shapes]
    for r in many.words.selectExpr("slice", "word", "bits", "explode(sequence(0, 62)) AS bit").where("getbit(bits, bit) = 1").collect():
        in_slices[r.slice][1].add(63 * r.word + r.bit)

    def contained(url):
        first, second = (int(digest_hex(url)[i:i + 8], 16) for i in (0, 8))
        return any(all((first + i * (second if second % s.m else 1)) % s.m in set_bits for i in range(s.k)) for s, set_bits in in_slices)

    largest = max(s.m for s, _ in many)
    for ship_up_to in (K.MAX_BITMAP_BITS, 8 * largest, largest - 1, 0):
        rows = K.probe_sliced(asked, "url", many, ship_up_to=ship_up_to).collect()
        assert len(rows) == 4003 and all(r.in_filter == (r.url is not None and contained(r.url)) for r in rows)
    assert K.probe_sliced(asked, "url", list(few)).collect() == K.probe_sliced(asked, "url", few).collect()


def digest_hex(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_fingerprints_keep_the_second_instance(urls):
    buckets = K.fingerprint_buckets(1000)
    table = K.fingerprint_table(urls(["a", "a", "b"]), "url", buckets)
    left = K.fingerprint_remove(table, urls(["a", "b"]), "url", buckets)
    assert dict(K.fingerprint_probe(urls(["a", "b"]), "url", left, buckets).collect()) == {"a": True, "b": False}


def test_constant_and_data_ensembles_agree(spark, urls):
    bad, good = ["evil.com", "bad.xyz"], ["good.com"]
    hosts = urls(["evil.com", "bad.xyz", "good.com", "other.org"])
    constant = K.vote(hosts, "url", K.constant_ensemble(spark, bad, good))
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "pattern string")
    data = K.vote(hosts, "url", K.data_ensemble(frame(bad), frame(good)))
    columns = ["url", "bloom_score", "bloom_result"]
    assert sorted(constant.select(columns).collect()) == sorted(data.select(columns).collect())
    assert dict(data.select("url", "bloom_result").collect()) == {
        "evil.com": "KNOWN_MALICIOUS", "bad.xyz": "KNOWN_MALICIOUS", "good.com": "KNOWN_SAFE", "other.org": "UNCERTAIN",
    }


def test_shuffled_and_shipped_probes_agree(spark, urls):
    members, probes = urls([f"m{i}" for i in range(200)]), urls([f"m{i}" for i in range(400)] + [None, "m1", ""])
    shape, buckets = K.Shape.rounded(200, 0.05), K.fingerprint_buckets(400)
    counted, codes = K.counting_table(members, "url", shape), K.fingerprint_table(members, "url", buckets)
    sliced = K.build_sliced(members, "url", K.Slices(50))
    frame = members.withColumnRenamed("url", "pattern")
    few = frame.where("pattern LIKE '%9'")
    for probe in (
        lambda n: K.counting_probe(probes, "url", K.counting_remove(counted, probes.limit(9), "url", shape, n), shape, ship_up_to=n),
        lambda n: K.fingerprint_probe(probes, "url", codes, buckets, ship_up_to=n),
        lambda n: K.probe_sliced(probes, "url", sliced, ship_up_to=n),
        lambda n: K.vote(probes, "url", K.data_ensemble(frame, few, ship_up_to=n)),
        lambda n: K.trigram_similarity_sketch(probes, members, shape, ship_up_to=n, broadcast_up_to=n),
        lambda n: K.trigram_similarity(probes, members, broadcast_up_to=n),
    ):
        shipped, shuffled = probe(K.MAX_BITMAP_BITS), probe(0)
        assert shipped.columns == shuffled.columns
        assert sorted(shipped.collect(), key=str) == sorted(shuffled.collect(), key=str)


def test_a_filter_beyond_32_bits_of_positions(urls):
    shape = K.Shape.plain(1_000_000_000, 0.01)
    assert shape.m > 1 << 32
    members, probes = urls(["a", "b", "é"]), urls(["a", "b", "é", "c", "d"])
    rows = probes.select("url", F.array(*K.plain_positions(F.col("url"), shape))).collect()
    assert all(got == [digest(f"{i}:{url}") % shape.m for i in range(shape.k)] for url, got in rows)
    words = K.build_plain(members, "url", shape)
    assert dict(K.probe_plain(probes, "url", words, shape).collect()) == dict(a=True, b=True, é=True, c=False, d=False)
    table = K.counting_table(members, "url", shape)
    assert table.agg(F.max("position")).first()[0] > 1 << 32
    assert dict(K.counting_probe(probes, "url", table, shape).collect()) == dict(a=True, b=True, é=True, c=False, d=False)


def test_ensemble_grows_with_its_list(spark):
    listed = spark.range(800_000).select(F.concat(F.lit("bad"), "id", F.lit(".example")).alias("pattern"))
    hosts = spark.range(1000).select(F.concat(F.lit("other"), "id", F.lit(".org")).alias("host"))
    hosts = hosts.unionByName(listed.limit(100).withColumnRenamed("pattern", "host"))
    voted = K.vote(hosts, "host", K.data_ensemble(listed, listed.limit(0)))
    rows = dict(voted.groupBy("bloom_result").count().collect())
    # two buckets of four slots at 76 % load with 255 fingerprints, plus 1 % of the counting filter: 34 of 1000
    # unlisted hosts are expected, 60 are 4.5 deviations above
    assert rows.get("KNOWN_SAFE", 0) == 0 and 100 <= rows["KNOWN_MALICIOUS"] <= 160


def test_trigram_similarity(urls):
    known = urls(["abcdef"])
    rows = dict(K.trigram_similarity(urls(["abcdef", "ABCxyz", "zz", "qqqq"]), known).collect())
    assert rows == {"abcdef": 1.0, "ABCxyz": 0.25, "zz": 0.0, "qqqq": 0.0}
    sketch = K.trigram_similarity_sketch(urls(["abcdef", "ABCxyz", "zz"]), known, K.Shape.rounded(1000, 0.0001))
    assert dict(sketch.collect()) == {"abcdef": 1.0, "ABCxyz": 0.25, "zz": 0.0}


def test_trigram_share_three_ways(spark, urls):
    """As a literal, broadcast and shuffled, with trigrams that need quoting."""
    known = urls(["http://it's.org/\\x", "é\"漢字", "a\nb c", "${var}", "%d\ty"])
    asked = urls(["http://it's.org/\\y", "é\"漢", "A\nB C", "", None, "ab", "no match", "${VAR}", "%d\ty", "http://it's.org/\\y"])
    grams = K.known_grams(known)
    ways = [K.hold_grams(grams, literal_up_to=1000), K.hold_grams(grams), K.hold_grams(grams, broadcast_up_to=0)]
    assert [w.members is not None for w in ways] == [True, False, False] and [w.few for w in ways] == [True, True, False]
    rows = [sorted(K.gram_share(asked, w).collect(), key=str) for w in ways]
    assert rows[0] == rows[1] == rows[2] and dict(rows[0])["A\nB C"] == 1.0
    plan = K.gram_share(asked, ways[0])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert {r.similarity for r in K.trigram_similarity(asked, known.limit(0), literal_up_to=9).collect()} == {0.0}


def test_minhash_of_equal_and_disjoint(spark):
    df = spark.createDataFrame([("abcdef", "abcdef"), ("abcdef", "uvwxyz"), ("ab", "ab")], "a string, b string")
    assert [r[0] for r in df.select(K.minhash_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_ageing(spark):
    df = spark.sql("SELECT 'u' url, 1.0D score, timestamp'2024-01-01 00:00:00' inserted_at")
    late = F.lit("2024-01-01 06:24:00").cast("timestamp")
    assert K.drop_expired(df, late).isEmpty()
    assert tuple(K.expired_count(df, late).first()) == (1, 0)
    assert not K.drop_expired(df, F.lit("2024-01-01 06:20:00").cast("timestamp")).isEmpty()
