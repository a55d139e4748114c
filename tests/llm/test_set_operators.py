"""Jaccard join, mixing, embedding near-duplicates, shards, nearest neighbours and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from urlrisk.llm import common, curves, embedding_dedup, jaccard, links, mixing, sharding

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id int, _key string, rank int, copies int"


def docs_of(spark, rows):
    """Documents (id, text, source) with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0, "k", 0, 0) for i, t, s in rows], DOCS)


def roots(nodes, pairs):
    """Smallest node reachable, by repeated lowering."""
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


# components -------------------------------------------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(220)] + [(500, 500)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    assert got == {n: r for n, r in want.items() if n != r}
    assert links.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Jaccard join -----------------------------------------------------------------------------------------------------

def plain_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def near_copies(seed=2):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = [None, "", " \n\t", "one two", "One TWO", "one two three four five", "É é é é é é"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 150, 400]))]
        for _ in range(rng.choice([1, 3, 25])):
            own = base[:]
            for _ in range(rng.randrange(0, 1 + len(base) // 14)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    for _ in range(40):  # mostly one shared passage
        own = [rng.choice(words) for _ in range(rng.choice([2, 8, 20, 60]))]
        at = rng.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    texts += [texts[9]] * 30 + ["long " * 30_000 + "end"] * 2
    return texts


@pytest.mark.parametrize("longest", [1, 4])
def test_jaccard(spark, longest):
    texts = near_copies()
    sets = plain_sets(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and sets[i]]
    want = roots(range(len(texts)), pairs)
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    rows = jaccard.similar_documents(docs, longest=longest).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(i, len(sets[i]), want[i]) for i in range(len(texts))}
    assert len(rows) == len(texts)
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == sorted(set(want.values()))


def test_jaccard_by_shuffle(spark, monkeypatch):
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(near_copies(3))])
    broadcast = sorted(map(tuple, jaccard.similar_documents(docs).collect()))
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, jaccard.similar_documents(docs).collect())) == broadcast


def test_jaccard_edges(spark):
    text = "a b c d e f g h i j"
    repeated = docs_of(spark, [(1, text, "s"), (1, text, "s"), (None, text, "s"), (None, "x y", "s"), (4, None, "s"), (4, None, "s"), (2, "p q r s t u", None)])
    got = Counter((r.doc_id, r.component_id) for r in jaccard.similar_documents(repeated).collect())
    assert got == Counter({(1, 1): 2, (None, 1): 1, (None, None): 1, (4, 4): 2, (2, 2): 1})
    kept = jaccard.one_of_each(repeated)
    assert kept.columns == repeated.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({(1, text): 1, (None, "x y"): 1, (4, None): 2, (2, "p q r s t u"): 1})
    assert jaccard.similar_documents(docs_of(spark, [])).count() == 0


# mixing -----------------------------------------------------------------------------------------------------------

def plain_targets(sizes, weights=(3, 1, 2)):
    """Water filling step by step, as the contract says it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    rest, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 30))), rng.choice(["b", "a", "퟿", "\U0001f600", None, "hot", "hot", "hot"])) for i in range(900)]
    rows += [(7, "w w w", "a")] * 5 + [(None, "w", "b"), (901, None, "empty")]
    docs = docs_of(spark, rows)
    out = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - want[s]) <= 31 for s in sizes)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, out))
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_targets_of_many_sources(spark):
    rng = random.Random(11)
    sizes = {f"s{i:03}": rng.choice([0, 1, 5, 40, 1000, 100_000]) for i in range(400)}
    sized = spark.createDataFrame([(s, n) for s, n in sizes.items()] + [(None, 77)], "source string, size bigint")
    want = plain_targets(sizes | {None: 77})
    got = {r.source: r.target for r in mixing.targets(sized, (3, 1, 2), (3, 2), 2).collect()}
    assert got == {s: pytest.approx(t, rel=1e-12) for s, t in want.items()}


def test_mixed_rows(spark):
    docs = docs_of(spark, [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(200)] + [(3, "w w w ", "b")] * 4)
    counts = defaultdict(int)
    for r in mixing.mix(docs).collect():
        counts[r.doc_id, r.size] += r.copies
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, len(r.text.split())) for r in got.collect()) == Counter({k: n for k, n in counts.items() if n})


# embeddings -------------------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, cid int, vector string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, e, lab, 1, "x") for i, e, lab in rows], VECTORS)


def planted(seed=6, n=240, dims=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = centers[i % 12] + rng.normal(size=dims) * [0.0, 0.02, 0.05, 0.2][i % 4] * (1 if i % 3 else 3)
        rows.append((i, [float(x) for x in (v * rng.uniform(0.5, 2)).astype(np.float32)], [0, 1, None][i % 5 // 2]))
    return rows


def test_embedding_dedup(spark):
    rows = planted()
    rows += [(300 + i, rows[0][1], 0) for i in range(40)] + [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [], 0), (404, [1.0, None], 0), (405, [1.0, 2.0], 0), (405, [1.0, 2.0], 0)]
    good = [(n, v, lab) for n, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    pairs = []
    for x, (a, v, la) in enumerate(good):
        for b, w, lb in good[:x]:
            if la == lb and len(v) == len(w):
                p, q = np.array(v, float), np.array(w, float)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.98:
                    pairs.append((a, b))
    root = roots(range(len(rows)), pairs)
    degree = Counter(x for p in pairs for x in p)
    smallest = {}
    for n, r in root.items():
        smallest[r] = min(smallest.get(r, 10**9), rows[n][0])
    want = Counter((rows[n][0], degree[n], smallest[root[n]], rows[n][0] == smallest[root[n]]) for n in range(len(rows)))
    for block in (256, 8):  # also with buckets cut into blocks
        got = embedding_dedup.near_duplicates(vectors_of(spark, rows), block=block, tables=48)
        assert Counter(map(tuple, got.collect())) == want
    assert embedding_dedup.near_duplicates(vectors_of(spark, [])).count() == 0


def test_embedding_labels_of_any_bytes(spark):
    rows = [(i, [1.0, 2.0, 0.5], 0) for i in range(6)]
    labels = F.when(F.col("vec_id") < 2, F.unhex(F.lit("FF")).cast("string")).when(F.col("vec_id") < 4, F.unhex(F.lit("FE")).cast("string")).otherwise("")
    found = embedding_dedup.near_duplicates(vectors_of(spark, rows).withColumn("label", labels)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (1, i - i % 2) for i in range(6)}


def test_hilbert_is_a_curve():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = curves.hilbert(side, 3)
    assert sorted(keys) == list(range(512))
    walk = side[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 4)) @ rng.normal(size=(4, 24))
    rows = [(i, [float(x) for x in v.astype(np.float32)], 0) for i, v in enumerate(base)]
    rows += [(2000 + i, rows[100][1], 0) for i in range(14)] + [(3000, None, 0), (3100, [0.0] * 24, 0), (3200, [1.0], 0), (None, rows[0][1], 0)]
    vectors = vectors_of(spark, rows)
    got = defaultdict(list)
    for r in curves.search(vectors, F.col("vec_id") % 100 == 0, block=128).collect():
        got[r.query_id].append(r)
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v is not None and len(v) == 24 and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    hit = 0
    assert set(got) == {i for i in ids if i % 100 == 0}
    for q, own in got.items():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        assert all(r.score == d[ids == r.vec_id][0] for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        hit += len({r.vec_id for r in own} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hit >= 0.9 * 10 * len(got)
    assert [r.vec_id for r in got[100]] == list(range(2000, 2010))  # ties: the smaller ids
    few = curves.search(vectors_of(spark, rows[:4]), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert curves.search(vectors_of(spark, []), F.lit(True)).count() == 0


def test_neighbours_of_every_length(spark):
    """Vectors meet those of their own length only, whichever length is the most frequent."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=[2, 3, 24][i % 3] if i < 300 else 24).tolist(), 0) for i in range(900)]
    got = defaultdict(list)
    for r in curves.search(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, block=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    hits = defaultdict(list)
    for q in range(0, 900, 20):
        x = np.array(rows[q][1], np.float32).astype(float)
        other = [(float(np.sqrt(((np.array(v, np.float32).astype(float) - x) ** 2).sum())), i) for i, v, _ in rows if len(v) == len(x) and i != q]
        assert len(got[q]) == 10 and got[q] == sorted(got[q])
        hits[len(x)].append(len(set(got[q]) & set(sorted(other)[:10])) / 10)
    assert all(np.mean(h) >= 0.9 for h in hits.values()) and set(hits) == {2, 3, 24}


@pytest.mark.parametrize(("setting", "size"), [("64", 64), ("64b", 64), ("2k", 2048), ("64m", 64 << 20), (" 1GB", 1 << 30), ("-1", -1), ("0", 0)])
def test_size_settings(setting, size):
    assert common.size_setting(setting) == size


def test_recall_on_given_vectors(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(set)
    for r in curves.op9_neighbours(spark, sf_dir).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for q in ids[ids % 100 == 0]:
        d = ((x - x[ids == q][0]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hits.append(len(got[q] & set(ids[np.lexsort((ids, d))[:10]].tolist())) / 10)
    assert np.mean(hits) >= 0.9


# shards -----------------------------------------------------------------------------------------------------------

def test_shards(spark):
    rng = random.Random(9)
    rows = [(i, "é" * rng.randrange(0, 60), rng.choice("ab")) for i in range(600)] + [(i, "same text", "a") for i in range(600, 900)]
    rows += [(5, "x", None)] * 3 + [(None, None, "a")]
    out = sharding.kd_shards(docs_of(spark, rows), shards=7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    size, slots = defaultdict(int), defaultdict(list)
    for r in out:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 7
    assert set(size) == set(range(7)) and all(abs(s - mean) < 3 * 140 for s in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in out if r.text_crc32 == zlib.crc32(b"same text")}) <= 3
    assert sharding.kd_shards(docs_of(spark, []), shards=7).count() == 0
    assert {r.slot for r in sharding.kd_shards(docs_of(spark, rows[:3]), shards=7).collect()} == {0}


def plain_shards(rows, shards):
    """rows: (id, size, crc32, dimensions). The k-d tree by recursion over whole lists."""
    out = {}

    def cut(own, first, due):
        if due == 1 or not own:
            out.update({r: first for r in own})
            return
        wide = [max(r[3][d] for r in own) - min(r[3][d] for r in own) for d in range(2)]
        axis = wide.index(max(wide))
        own.sort(key=lambda r: (r[3][axis], r[2], r[0] is None, r[0] or 0))
        left, total, done, kept = due // 2, sum(r[1] for r in own), 0, 0
        for r in own:
            if (2 * done + r[1]) * due < 2 * total * left:
                kept += 1
            done += r[1]
        cut(own[:kept], first, left)
        cut(own[kept:], first + left, due - left)

    cut(list(rows), 0, shards)
    return out


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_shards_like_a_plain_tree(spark, shards):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 80))), rng.choice(["en", "de", "fr", None])) for i in range(500)]
    rows += [(500 + i, "one text of many copies", "en") for i in range(250)] + [(900, None, "de"), (None, "no id", "fr"), (901, "", None)]
    docs = spark.createDataFrame([(*r, 0, 0.5) for r in rows], "doc_id bigint, text string, lang string, shard int, _d0 double")
    got = {r.doc_id: r.shard for r in sharding.kd_shards(docs, shards=shards).collect()}
    plain = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()),
              (float(np.log2(len((t or "").encode()) + 1)) / 32, zlib.crc32(g.encode()) / 2**32 if g is not None else 1.0)) for i, t, g in rows]
    assert got == {r[0]: shard for r, shard in plain_shards(plain, shards).items()}


def test_shards_are_native(spark, sf_dir):
    plan = sharding.op5_sharding(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# pipeline ---------------------------------------------------------------------------------------------------------

def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.language(spark, docs, sf_dir)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == columns and len(texts) >= 0.99 * docs.count()
    single = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    sets = dict(zip(texts, plain_sets(texts.values()), strict=True))
    pairs = [(i, j) for i in sets for j in sets if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and sets[i]]
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(roots(sets, pairs).values()))
    clean = corpus_pipeline.secret_scan(spark, single, sf_dir)
    assert clean.columns == columns and clean.count() == single.count()
    assert clean.where("text rlike '(password|token) *= *\"?[0-9a-f]{10,}'").count() == 0
    assert clean.where("n_chars != length(text)").count() == 0
    mix = corpus_pipeline.source_mix(spark, clean, sf_dir)
    counts = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}
    assert mix.columns == columns and counts == want
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id: r.n for r in pieces.where("piece = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null, empty, long, repeated and broken texts, extra columns of clashing names, and no rows at all."""
    prose = "the and of with this that from which are was were have been " * 8
    rows = [(i, prose + f"w{i} x{i * 7} y{i * 13} " * 6, "en", "s", 0) for i in range(40)]
    rows += [(100, None, "en", "s", 0), (101, "", None, None, 0), (102, "123 !?", "en", "s", 0), (103, prose * 500, "en", "t", 0)]
    rows += [rows[3], rows[3], (104, rows[5][1], "en", None, 0), (None, prose + "no id at all", None, "s", 0), (105, prose + " password = 'a8Kq02LmZ91x'", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr(
        "*", "1 as component_id", "'k' as __row_key", "2 as copies", "'x' as _text", "3 as size", "4 as rank", "5 as piece")
    broken = docs.where("doc_id = 7").withColumn("doc_id", F.lit(200)).withColumn("text", F.concat("text", F.unhex(F.lit("FFC3")).cast("string")))
    docs.unionByName(broken).write.parquet(f"{tmp_path}/documents.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == given.columns, name
    assert at.where("doc_id in (101, 102)").count() == 0
    assert at.where("doc_id = 105 and text like '%a8Kq02LmZ91x%'").count() == 0
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert pieces and max(p.length for p in pieces) <= 1024
    empty = f"{tmp_path}/empty"
    given.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
