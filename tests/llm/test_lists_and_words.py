"""URL lists, spelling variants and hard negatives, against plain versions."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from urlrisk.llm import rtree, spelling, url_lists

# URL lists --------------------------------------------------------------------------------------------------------

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "Sub.Example.org", ""),
         ("allow", "x.example.org", "/es/deep"), ("block", "é.net", "/ü"), ("allow", "twice.net", "/"), ("block", "twice.net", "/"),
         ("allow", None, "/"), ("block", "net", None), ("block", "a/b", "/"), ("block", "net", "tail"), ("perhaps", "net", "/")]
URLS = [
    None, "", "no scheme", "://", "http://", "http://EXAMPLE.org/es/1?q#f", "https://m.example.org/en/12", "https://m.example.org/en/2",
    "http://example.org", "http://org/", "http://notexample.org/es/", "ftp://x.example.org/es/deeper", "http://a.sub.example.org?x=/es/",
    "http://é.net/ünder", "http://twice.net/", "a://b://example.org/es/", "http://example.org:80/es/", "http://u@org/x", "http://.org/",
    "http://" + "a." * 20_000 + "org/" + "x" * 50_000, "http://a\nb.org/\nx", "http://example.org/es/", "http://example.org/es/",
]


def plain_verdict(url, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3:] if url and at >= 0 else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = re.sub("[A-Z]+", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in RULES:
        if h is None or p is None or re.search("[/?#]", h) or verdict not in ("allow", "block"):
            continue
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            own = (len(h + p), len(h), verdict)
            best = max(best or own, own)
            if best == own:
                rule = h + p
    return host, path, rule if best else None, best[2] if best else default


@pytest.mark.parametrize("how", [{}, {"ship_up_to": 1}, {"digest_bits": 2}, {"volume_bytes": 64}])
def test_url_lists(spark, how):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id bigint, url string, host string, filter int")
    array = url_lists.build(spark.createDataFrame(RULES, "verdict string, host string, path string"), **how)
    assert (array.files is None) == ("ship_up_to" in how) and (array.volume_bits > 0) == ("volume_bytes" in how)
    judged = url_lists.judge(pages, array, default="block")
    assert judged.columns == pages.columns
    rows = {r.page_id: tuple(r["filter"]) for r in judged.collect()}
    assert rows == {i: plain_verdict(u, "block") for i, u in enumerate(URLS)}


def test_url_lists_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id bigint, url string")
    empty = url_lists.build(spark.createDataFrame([], "verdict string, host string, path string"))
    assert tuple(url_lists.judge(pages, empty).first()["filter"]) == ("a.org", "/x", None, "allow")
    array = url_lists.build(spark.createDataFrame(RULES, "verdict string, host string, path string"))
    assert url_lists.judge(pages.limit(0), array).count() == 0
    broken = pages.withColumn("url", F.concat(F.lit("http://org/"), F.unhex(F.lit("FF41")).cast("string")))
    assert tuple(url_lists.judge(broken, array).first()["filter"])[2:] == ("org/", "allow")


def test_digests_agree(spark):
    """Workers name keys as the JVM does."""
    keys = ["", "org/", "é.net/ü", "x" * 100]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", F.xxhash64("k").alias("h")).collect()
    assert all(np.uint64(xxhash.xxh64_intdigest(r.k.encode(), url_lists.SEED)).view(np.int64) == r.h for r in rows)


# spelling variants ------------------------------------------------------------------------------------------------

WORDS = ["colour", "color", "colours", "Colour", "colr", "coloür", "COLÖUR", "château", "chateau", "chateaux", "planet", "planets", "plane",
         "x" * 200, "x" * 201, "y" + "x" * 199, "ab", "abcde", "abcdef", "aabcde", "abbcde", "abcdz", "zbcde"]


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain_variants(n):
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y), default=None) for w, x in near.items()}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def word_rows():
    rng = np.random.default_rng(12)
    rows = [(None, "colour, colour; colour"), (1, None), (2, ""), (3, "12 !? 漢字"), (3, "12 !? 漢字"), (4, "planet " * 30_000)]
    rows += [(10 + i, " ".join(rng.choice(WORDS, 40, p=np.arange(1, 24) / 276))) for i in range(60)]
    return [*rows, *rows[6:12]]


def test_variants(spark):
    rows = word_rows()
    docs = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in rows], "doc_id bigint, text string, word string, n int, form string")
    got = spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len({r.word for r in got})
    assert {tuple(r) for r in got} == plain_variants(plain_words(rows))
    assert spelling.variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [{"bits_per_word": 1, "most_bytes": 1 << 10}, {"bits_per_word": 64}])
def test_full_filter_changes_nothing(spark, bits):
    """A filter that lets through almost everything, and one that hardly ever errs."""
    n = plain_words(word_rows())
    pairs = spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n bigint"), **bits).collect()
    assert len(pairs) == len(set(map(tuple, pairs)))
    assert {tuple(p) for p in pairs} == {(a, b, n[a], n[b]) for a in n for b in n if is_near(a, b)}


def test_edits_are_all_of_them():
    """With a filter that passes everything, each neighbour by deletion or a later letter comes up once."""
    full = spelling.Filter(np.full(200, -1).view(np.uint64), np.arange(65), np.ones(65, np.int64))
    got = list(spelling.edits(["aab", "zÿa"], full))
    want = [(i, w[:k] + w[k + 1:]) for i, w in enumerate(["aab", "zÿa"]) for k in range(3)]
    want += [(i, w[:k] + c + w[k + 1:]) for i, w in enumerate(["aab", "zÿa"]) for k in range(3) for c in spelling.ALPHABET if c > w[k]]
    assert sorted(got) == sorted(set(want))


def test_query_on_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    n = plain_words([(r.doc_id, r.text) for r in docs])
    got = spelling.op12_spelling(spark, sf_dir).collect()
    assert {(r.word, r.n) for r in got} == set(n.items())
    known = sorted(n)[::40]
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and is_near(w, x)] for w in known}
    by_word = {r.word: r for r in got}
    for w in known:
        best = min(near[w], key=lambda y: (-n[y], y), default=None)
        assert by_word[w].n_near == len(near[w])
        assert by_word[w].form == (best if best is not None and n[best] >= 2 * n[w] else None)


# hard negatives ---------------------------------------------------------------------------------------------------

def plain_negatives(rows):
    """rows: (id, vector, label, whether an anchor)."""
    known = []
    for i, v, label, anchor in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            own = (i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v), label, anchor)
            if own not in known:
                known.append(own)
    out = Counter()
    for i, q, label, anchor in known:
        if not anchor:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, other) for j, v, other, _ in known if j != i and len(v) == len(q))
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fitting = [(s, k) for s, k, other in scored if other != label and 80 * -p <= 100 * -s <= 100 * -p]
            out.update((i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(fitting[:5]))
    return out


@pytest.mark.parametrize("sizes", [{}, {"tile": 16, "leaf": 4, "fan": 2, "boxes": 3}, {"tile": 50, "leaf": 7, "fan": 3}])
def test_hard_negatives(spark, sizes):
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(size=6).round(1 if i % 2 else 3).tolist(), int(rng.integers(3) if i % 3 else 1), i % 9 == 0) for i in range(160)]
    rows += [(200 + i, [0.5, 0.25 + 0.125 * (i % 2), 0.0, 1.0, 0.0, 0.5], i % 4, i % 10 == 0) for i in range(60)]  # ties
    rows += [(300, None, 1, True), (301, [], 1, True), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, True), (303, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 1, True),
             (304, [0.0] * 6, 1, True), (305, [1.0] * 6, None, True), (None, [1.0] * 6, 1, True), (9, rows[9][1], rows[9][2], True), (306, [2.0, 1.0], 1, True),
             (307, [1.0, 2.0], 1, False), (308, [1.0, 1.5], 0, False), (18, [0.3] * 6, 2, False), (309, [1e30] * 6, 1, True)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, pick boolean").selectExpr("*", "1 as uid", "'t' as tile", "2 as rank")
    got = Counter(map(tuple, rtree.hard_negatives(table, F.col("pick"), **sizes).collect()))
    assert got == plain_negatives(rows[:-1])  # no 64-bit number holds the last one's products
    assert rtree.hard_negatives(table.limit(0), F.col("pick")).count() == 0
    assert rtree.hard_negatives(table, F.lit(False)).count() == 0


def test_boxes_bound_products():
    rng = np.random.default_rng(5)
    x = rng.integers(-1000, 1000, (300, 5))
    tree = rtree.pack_tree(np.arange(300), rng.integers(0, 3, 300), x, 8, 3)
    assert sorted(tree.ids.tolist()) == list(range(300)) and tree.last[-1] - tree.first[-1] <= 3
    q = rng.integers(-1000, 1000, (20, 5))
    least, most = rtree.intervals(q, tree.low, tree.high)
    for leaf in range(tree.leaves):
        score = q @ tree.points[tree.first[leaf]:tree.last[leaf]].T
        assert (score >= least[:, leaf:leaf + 1]).all() and (score <= most[:, leaf:leaf + 1]).all()
    big = np.array([[2**30, -(2**30)]])
    assert rtree.times(big, big)[0, 0] == 2**61 and rtree.times(np.array([[2**30 + 1]]), np.array([[2**30 + 1]]))[0, 0] == (2**30 + 1) ** 2
