import random
from collections import defaultdict, deque

from urlrisk import catalogs as C
from urlrisk.operators import chains, graph
from urlrisk.plans.lineage import cut


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def random_graph(seed, nodes=30, hub_share=0.33):
    """Random edges with a hub that a third of them point to, and some cycles."""
    rng = random.Random(seed)
    names = [f"http://node-{i}.example.com/{rng.random()}" for i in range(nodes)]
    edges = {(rng.choice(names), names[0] if rng.random() < hub_share else rng.choice(names)) for _ in range(40)}
    return names, sorted(edges)


def distances(edges, start):
    out, seen, queue = defaultdict(list), {start: 0}, deque([start])
    for a, b in edges:
        out[a].append(b)
    while queue:
        node = queue.popleft()
        for nxt in out[node]:
            if nxt not in seen:
                seen[nxt] = seen[node] + 1
                queue.append(nxt)
    return seen


def test_closure_depth_and_nearest_against_search(spark):
    names, edges = random_graph(5)
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    reach = {(r.src, r.dst): r.dist for r in graph.closure(frame(spark, edges)).collect()}
    expected = {(a, b): d for a in names for b, d in distances(edges, a).items() if d}
    assert reach == expected
    depth = dict(graph.redirect_depth(nodes, frame(spark, edges)).collect())
    assert depth == {a: max(distances(edges, a).values()) for a in names}
    bad = names[3:6]
    found = graph.nearest_malicious(frame(spark, edges), spark.createDataFrame([(n,) for n in bad], "node string"))
    nearest = {r.node: (r.path_length, r.closest_malicious) for r in found.collect()}
    wanted = {}
    for a in names:
        hits = [(d, b) for b, d in distances(edges, a).items() if b in bad]
        if hits:
            wanted[a] = min(hits)
    assert nearest == wanted


def test_long_chain_with_hub_and_profile_against_search(spark, urls):
    rng = random.Random(3)
    names = [f"http://node-{i}.example.com/{rng.random()}" for i in range(23)] + ["aaaa", "bbbb"]
    edges = [(names[i], names[i + 1]) for i in range(24)] + [(n, names[0]) for n in names[20:23]] + [("http://x.org/", "http://x.org/")]
    reach = {(r.src, r.dst): r.dist for r in graph.closure(frame(spark, edges)).collect()}
    assert reach == {(a, b): d for a in names for b, d in distances(edges, a).items() if d}
    near = {(r.src, r.dst): r.dist for r in graph.closure(frame(spark, edges), max_depth=5).collect()}
    assert near == {k: d for k, d in reach.items() if d <= 5}
    some = spark.createDataFrame([(names[2],), (names[24],)], "node string")
    part = {(r.src, r.dst): r.dist for r in graph.closure(frame(spark, edges), some, 7).collect()}
    assert part == {k: d for k, d in reach.items() if k[0] in (names[2], names[24]) and d <= 7}
    asked = [names[0], names[15], names[22], "aaaa", "http://alone.org/1", "http://alone.org/1"]
    rows, searched = ({r.url: (r.redirect_depth, r.chain_length) for r in graph.url_profile(urls(asked), frame(spark, edges), search_below=b).collect()}
                      for b in (0.0, 9.0))
    assert rows == searched  # both ways
    open_edges = [(a, b) for a, b in edges if not {a, b} & {"aaaa", "bbbb"}]
    assert rows == {
        u: (max(distances(edges, u).values()),
            0 if u == "aaaa" else sum(d <= 10 for d in distances(open_edges, u).values()))
        for u in set(asked)
    }


def test_small_batch_writes_nothing_of_graph_size(spark, urls, monkeypatch):
    written = []

    def watch(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", watch)
    edges = spark.range(5000).selectExpr("concat('http://n', id, '.com/') src", "concat('http://n', id + 1000, '.com/') dst")
    asked = urls([f"http://n{i}.com/" for i in range(10)])
    assert {r.redirect_depth for r in graph.url_profile(asked, edges).collect()} == {5}
    assert max(written) <= 20


def test_topological_levels_leave_cycles_out(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")]
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "node string")
    levels = dict(graph.topological_levels(nodes, frame(spark, edges)).collect())
    assert levels == {"a": 0, "b": 1, "c": 2}


def test_low_entropy_nodes_are_not_passed(spark):
    a, b, low = "http://abcdefgh.com/1", "http://ijklmnop.org/2", "aaaa"
    nodes = spark.createDataFrame([(n,) for n in (a, b, low)], "node string")
    rows = {tuple(r) for r in graph.chain_nodes(nodes, frame(spark, [(a, low), (low, b), (b, a)])).collect()}
    assert rows == {(a, a, 0), (b, b, 0), (b, a, 1)}


def hop_log(spark, rows):
    return spark.createDataFrame(rows, C.HOP_LOG)


def test_chains(spark, urls):
    chain = [(f"http://c{i}.com/", 301, f"http://c{i + 1}.com/", "text/html", "") for i in range(20)]
    log = hop_log(spark, chain + [
        ("http://l1.com/", 302, "/l2", "text/html", ""), ("http://l1.com/l2", 301, "http://l1.com/", "text/html", ""),
        ("http://m.com/", 200, None, "text/html", '<meta http-equiv="refresh" content="0; url=http://e.ml/">'),
        ("http://e.ml/", 404, None, "text/html", "gone"),
        ("http://p.com/", 200, None, "image/png", '<script>location.href="http://no.com"</script>'),
        ("http://blank.com/", 301, " ", "text/html", ""),
    ])
    starts = ["http://c0.com/", "http://l1.com/", "http://m.com/", "http://p.com/", "http://blank.com/",
              "http://dead.com/?url=http%3A%2F%2Fevil.tk%2F", "http://c19.com/"]
    out = {r.url: r for r in chains.analyze_chain(chains.expand_b(urls(starts + starts[:1]), log)).collect()}
    assert len(out) == len(starts)
    long = out["http://c0.com/"]
    assert (long.redirect_count, long.excessive_redirects, long.loop_detected) == (15, True, False)
    loop = out["http://l1.com/"]
    assert loop.loop_detected and loop.redirect_count == 1
    assert loop.errors == ["Redirect loop at hop 2: http://l1.com/"]
    meta = out["http://m.com/"]
    assert meta.expanded_url == "http://e.ml/" and meta.redirect_chain[0].redirect_type == "meta_refresh"
    assert meta.cross_domain_redirect and meta.redirect_chain[1].is_suspicious and meta.suspicious_hops == 1
    assert out["http://p.com/"].redirect_count == 0
    assert out["http://blank.com/"].errors == ["Empty Location header at hop 0"]
    virtual = out["http://dead.com/?url=http%3A%2F%2Fevil.tk%2F"]
    assert virtual.is_shortened and virtual.expanded_url == "http://evil.tk/"
    assert virtual.redirect_chain[0].redirect_type == "open_redirect" and virtual.redirect_chain[0].is_suspicious
    assert out["http://c19.com/"].errors == ["Connect error at hop 1 (http://c20.com/)"]


def test_profile_a_expands_shorteners_only(spark, urls):
    log = hop_log(spark, [
        ("http://bit.ly/a", 301, "http://x.com/", None, None), ("http://x.com/", 302, "http://y.com/", None, None),
        ("http://y.com/", 200, None, None, None), ("http://bit.ly/loop", 301, "http://bit.ly/loop", None, None),
    ])
    out = {r.url: r for r in chains.expand_a(urls(["http://bit.ly/a", "http://x.com/", "http://bit.ly/loop"]), log).collect()}
    assert out["http://bit.ly/a"].redirect_chain == ["http://bit.ly/a", "http://x.com/", "http://y.com/"]
    assert out["http://x.com/"].final_url == "http://x.com/" and not out["http://x.com/"].is_shortened
    assert out["http://bit.ly/loop"].redirect_count == 10
