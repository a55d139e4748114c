"""Reference SQL for the registered queries, written against the given tables only.

Named relations and small text builders keep the statements readable; each one expands to a plain
``WITH ... SELECT``. Where SQL cannot state a query (model training, or a job whose steps SQL would have
to repeat in full) there is no entry, and tests check the query instead.
"""

from __future__ import annotations

from urlrisk import catalogs as C
from urlrisk.functions import scores as S
from urlrisk.operators import gate as G
from urlrisk.operators import sketches as K

RFC = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


# -- text builders ---------------------------------------------------------------------------------
def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def part(u: str, group: int) -> str:
    return f"regexp_extract({u}, '{RFC}', {group})"


def netloc(u: str) -> str:
    return part(u, 2)


def path(u: str) -> str:
    return f"regexp_replace({part(u, 3)}, ';[^/]*$', '')"


def host(u: str, mode: str = "keep", authority: str | None = None) -> str:
    text = f"split_part(lower({authority or netloc(u)}), ':', 1)"
    if mode == "charstrip":
        return f"ltrim({text}, 'w.')"
    if mode == "prefix":
        return rf"regexp_replace({text}, '^www\.', '')"
    return text


def tld(h: str, tlds) -> str:
    return rf"regexp_matches({h}, '\.({'|'.join(tlds)})$')"


def entropy(t: str) -> str:
    return f"CASE WHEN length({t}) > 0 THEN list_aggregate(string_split({t}, ''), 'entropy') ELSE 0.0 END"


def count_of(t: str, char: str) -> str:
    return f"(length({t}) - length(replace({t}, '{char}', '')))"


def hits(t: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({t}, '{w}') AS BIGINT)" for w in words) + ")"


def share(pattern: str, u: str) -> str:
    return f"(length(regexp_replace({u}, '{pattern}', '', 'g')) / length({u}))"


def decoded(u: str) -> str:
    return f"url_decode({u})"


def adversarial(u: str) -> str:
    return f"translate(translate(lower({decoded(u)}), '0134578@$', 'oieastbas'), '-_', '')"


def parents(h: str) -> str:
    labels = f"string_split({h}, '.')"
    return (
        f"CASE WHEN len({labels}) >= 3 THEN "
        f"[array_to_string({labels}[i + 1:], '.') for i in range(1, len({labels}) - 1)] ELSE [] END"
    )


def listed_or_parent(h: str, names) -> str:
    return f"list_has_any(list_append({parents(h)}, {h}), [{quoted(names)}])"


def listed_prefix(h: str, names) -> str:
    return f"len(list_filter([{quoted(names)}], lambda p: starts_with({h}, p))) > 0"


def trigrams(t: str) -> str:
    low = f"lower({t})"
    return (
        f"CASE WHEN length({low}) >= 3 THEN "
        f"list_distinct([substr({low}, i, 3) for i in range(1, length({low}) - 1)]) ELSE [] END"
    )


def hex_int(digest: str, start: int, size: int) -> str:
    return f"CAST('0x' || substr({digest}, {start}, {size}) AS BIGINT)"


def md5_mod(text: str, m: int) -> str:
    out = "CAST(0 AS BIGINT)"
    for i in range(4):
        out = f"(({out} * 4294967296 + {hex_int(f'md5({text})', 1 + 8 * i, 8)}) % {m})"
    return out


def seeded(item: str, shape: K.Shape) -> str:
    return "[" + ", ".join(md5_mod(f"'{i}:' || {item}", shape.m) for i in range(shape.k)) + "]"


def double_hashed(item: str, shape: K.Shape) -> str:
    h1, h2 = hex_int(f"md5({item})", 1, 8), hex_int(f"md5({item})", 9, 8)
    step = f"(CASE WHEN {h2} % {shape.m} = 0 THEN 1 ELSE {h2} END)"
    return f"[({h1} + i * {step}) % {shape.m} for i in range({shape.k})]"


def fingerprint(item: str, buckets: int) -> str:
    low = f"({hex_int(f'md5({item})', 17, 8)} % 256)"
    fp = f"(CASE WHEN {low} = 0 THEN 1 ELSE {low} END)"
    first = f"({hex_int(f'md5({item})', 25, 8)} % {buckets})"
    return f"({fp} * {buckets} + least({first}, xor({first}, ({fp} * {0x5BD1E995}) % {buckets})))"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def flag(x: str) -> str:
    return f"CAST(({x}) AS BIGINT)"


# -- relations -------------------------------------------------------------------------------------
RELATIONS: dict[str, tuple[list[str], str]] = {}


def relation(name: str, needs: list[str], sql: str) -> None:
    RELATIONS[name] = (needs, sql)


def with_(select: str, *names: str) -> str:
    """``select`` with the named relations and everything they need in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in RELATIONS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    body = ",\n".join(f"{n} AS ({RELATIONS[n][1]})" for n in ordered)
    return f"WITH RECURSIVE {body}\n{select}" if body else select


relation("corpus", [], """
  SELECT page_id, CASE page_id % 16
    WHEN 0 THEN concat('http://paypa1-secure.xyz/login/verify?account=', page_id)
    WHEN 1 THEN concat('http://g00gle-secure-login.xyz/verify?id=', page_id)
    WHEN 2 THEN concat('http://paypal.secure-login.tk/verify/', page_id)
    WHEN 3 THEN concat('http://192.168.', page_id % 256, '.1/admin?n=', page_id)
    WHEN 4 THEN concat('https://github.com/org/repo', page_id)
    WHEN 5 THEN concat('https://api.github.com/v', page_id)
    WHEN 6 THEN concat('http://bit.ly/3free', page_id)
    WHEN 7 THEN concat('http://legitimate.com@evil-phishing.xyz/login?n=', page_id)
    WHEN 8 THEN concat('http://evil.xyz:8888/cmd//execute?n=', page_id)
    WHEN 9 THEN concat('http://go.example.com/out?url=http%3A%2F%2Fevil', page_id, '.ml%2Fx')
    WHEN 10 THEN concat('http://secure-paypal.evil', page_id, '.net/%6C%6F%67%69%6E')
    WHEN 11 THEN concat('http://xK8mN2pQ7rT4vY1z.top/a/b/c?x=', page_id)
    WHEN 12 THEN concat('https://www.washingtonpost.com/story/', page_id)
    ELSE url END AS url,
    CASE WHEN page_id % 16 IN (0, 1, 2, 3, 7, 8, 9, 10, 11) THEN 1 ELSE 0 END AS result
  FROM pages UNION ALL SELECT page_id + 224000000, url, 0 FROM pages WHERE page_id % 16 <= 12""")
relation("edges", ["corpus"], """
  SELECT a.url AS src, b.url AS dst FROM corpus a JOIN corpus b ON b.page_id = CASE
    WHEN a.page_id = 40 THEN 38 WHEN a.page_id BETWEEN 20 AND 39 THEN a.page_id + 1 WHEN a.page_id % 14 = 10 THEN 45
    WHEN a.page_id % 14 < 4 THEN a.page_id + 1 WHEN a.page_id % 28 = 4 THEN a.page_id - 1 END""")
relation("hop_pages", [], """
  SELECT page_id, url, CASE page_id % 16
    WHEN 13 THEN concat('<meta http-equiv="refresh" content="0; url=/next">', html)
    WHEN 14 THEN concat('<script>window.location.href = "http://evil.ml/x"</script>', html)
    ELSE html END AS html FROM pages""")
relation("hop_log", ["corpus", "edges", "hop_pages"], """
  SELECT c.url,
    CASE WHEN e.dst IS NOT NULL THEN 301 WHEN c.page_id % 14 IN (7, 8) THEN 302 ELSE 200 END AS status_code,
    CASE WHEN e.dst IS NOT NULL THEN e.dst WHEN c.page_id % 14 = 8 THEN ''
         WHEN c.page_id % 14 = 7 THEN '/next/../final?x=1' END AS location,
    CASE WHEN c.page_id % 14 = 6 THEN 'image/png' ELSE 'text/html' END AS content_type,
    h.html AS body
  FROM corpus c JOIN hop_pages h ON c.page_id % 224000000 = h.page_id LEFT JOIN edges e ON e.src = c.url
  WHERE c.page_id % 14 <> 9 OR c.page_id BETWEEN 20 AND 40""")
relation("scan_log", ["corpus"], """
  SELECT e.event_id, e.ts, e.user_id, c.page_id, c.url
  FROM events e, (SELECT count(*) AS n FROM pages) k, corpus c
  WHERE c.page_id = e.event_id % k.n + CASE WHEN (e.event_id // k.n) % 2 = 1 AND (e.event_id % k.n) % 16 <= 12 THEN 224000000 ELSE 0 END""")
relation("visits", ["scan_log"], """
  SELECT event_id, concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'e=', event_id) AS url
  FROM scan_log""")
relation("known_bad", ["corpus"], "SELECT url FROM corpus WHERE result = 1 AND page_id % 2 = 0")
relation("hosts", ["corpus"], f"SELECT *, {host('url', 'charstrip')} AS domain FROM corpus")
relation("log_hosts", ["scan_log", "hosts"],
         "SELECT s.event_id, s.url, h.domain FROM scan_log s JOIN hosts h ON h.url = s.url")
relation("safe_hosts", ["hosts"], r"""
  SELECT DISTINCT regexp_extract(domain, '([^.]*\.)?[^.]*$') AS pattern
  FROM hosts WHERE result = 0 AND page_id % 3 = 0""")
relation("bad_hosts", ["hosts"],
         "SELECT DISTINCT domain AS pattern FROM hosts WHERE result = 1 AND page_id % 3 <> 0")
relation("catalog", [], f"""
  SELECT unnest([{quoted(C.SAFE_DOMAINS)}]) AS pattern, 'safe' AS kind
  UNION ALL SELECT unnest([{quoted(C.MALICIOUS_DOMAINS + C.MALICIOUS_PREFIXES)}]), 'malicious'""")
relation("grown", ["catalog", "bad_hosts"], """
  SELECT * FROM catalog UNION ALL
  SELECT pattern, 'malicious' FROM bad_hosts WHERE pattern NOT IN (SELECT pattern FROM catalog WHERE kind = 'malicious')""")
relation("reach_all", ["edges"], """
  SELECT src, dst, 1 AS dist FROM edges
  UNION SELECT r.src, e.dst, r.dist + 1 FROM reach_all r JOIN edges e ON e.src = r.dst WHERE r.dist < 30""")
relation("reach", ["reach_all"],
         "SELECT src, dst, min(dist) AS dist FROM reach_all WHERE src <> dst GROUP BY src, dst")
relation("depths", ["corpus", "reach"], """
  SELECT c.url, coalesce(max(r.dist), 0) AS redirect_depth
  FROM corpus c LEFT JOIN reach r ON r.src = c.url GROUP BY c.url""")
relation("kept", ["corpus"], f"SELECT url FROM corpus WHERE {entropy('url')} >= 3.0")
relation("pruned_all", ["edges", "kept"], """
  SELECT url AS src, url AS node, 0 AS depth FROM kept
  UNION SELECT p.src, e.dst, p.depth + 1 FROM pruned_all p JOIN edges e ON e.src = p.node
  WHERE p.depth < 10 AND e.dst IN (SELECT url FROM kept)""")
relation("pruned", ["pruned_all"], "SELECT src, node, min(depth) AS depth FROM pruned_all GROUP BY src, node")
relation("profile", ["corpus", "depths", "pruned"], f"""
  SELECT c.url, d.redirect_depth, {entropy('c.url')} AS entropy,
    (SELECT count(*) FROM pruned p WHERE p.src = c.url) AS chain_length
  FROM corpus c JOIN depths d ON d.url = c.url""")
relation("bad_nodes", ["corpus"], "SELECT url AS node FROM corpus WHERE page_id % 7 = 4")
relation("nearest", ["corpus", "reach", "bad_nodes"], """
  SELECT node, arg_min(dst, (dist, dst)) AS closest_malicious, min(dist) AS path_length FROM (
    SELECT node, node AS dst, 0 AS dist FROM bad_nodes
    UNION ALL SELECT src, dst, dist FROM reach WHERE dst IN (SELECT node FROM bad_nodes)) GROUP BY node""")


def feature_select(profile: str, source: str, extra: str = "", url: str = "url") -> str:
    """The 25 features over ``source``; ``extra`` columns pass through. Depth and chain come from it."""
    u, words = "u", C.KEYWORDS_BY_PROFILE[profile]
    mode = "prefix" if profile == "A" else "charstrip"
    digits, upper = share("[^0-9]", u), share(r"[^\p{Lu}]", u)
    special = share("[^@%=&?#]", u)
    url_e, host_e = entropy(u), entropy("host")
    keyword = f"({hits('plain', words)} / {len(words)})"
    depth_host = age_host = "key"
    bad_tld = (
        f"({tld('front', C.SUSPICIOUS_TLDS)} OR {tld(chr(39) + '.' + chr(39) + ' || key', C.SUSPICIOUS_TLDS)})"
    )
    if profile == "B":
        digits, upper, special, url_e, host_e, keyword = (
            f"round_even({x}, 4)" for x in (digits, upper, special, url_e, host_e, keyword)
        )
        depth_host = age_host = "host"
        bad_tld = tld("host", C.SUSPICIOUS_TLDS)
    spoof = " OR ".join(
        f"((contains(labels, '{b}') OR contains(lpath, '{b}')) AND NOT contains(root, '{b}'))"
        for b in C.SPOOFED_BRANDS
    )
    homograph = " OR ".join(
        f"(contains(leet, '{b}') AND NOT contains(key, '{b}'))" for b in C.SPOOFED_BRANDS
    )
    port = r"TRY_CAST(nullif(regexp_extract(regexp_extract(nl, '[^@]*$'), '^[^:]*:([0-9]+)$', 1), '') AS INT)"
    return f"""
  SELECT {extra} u AS url, length(u) AS url_length, length(key) AS domain_length,
    {count_of(depth_host, '.')} AS subdomain_depth, {count_of(u, '/')} AS path_depth,
    length(query) AS query_length,
    CASE WHEN query = '' THEN 0 ELSE len(string_split(query, '&')) END AS num_query_params,
    {count_of(u, '.')} AS dot_count, {count_of(u, '-')} AS hyphen_count, {digits} AS digit_ratio,
    {upper} AS uppercase_ratio, {special} AS special_char_ratio, {url_e} AS url_entropy,
    {host_e} AS domain_entropy, starts_with(u, 'https://') AS has_https, {bad_tld} AS tld_suspicious,
    regexp_matches(u, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}') AS has_ip,
    contains(u, '@') AS has_at_symbol, contains(path, '//') AS double_slash_path,
    coalesce({port} IN ({', '.join(map(str, C.SUSPICIOUS_PORTS))}), FALSE) AS has_suspicious_port,
    redirect_depth, {keyword} AS keyword_score, ({spoof}) AS brand_in_subdomain,
    ({homograph}) AS has_homograph,
    CASE WHEN {tld(age_host, C.TRUSTED_TLDS)} THEN 1.0 ELSE 0.3 END AS domain_age_proxy, chain_length
  FROM (SELECT *, translate(key, '01345', 'oieAs') AS leet,
      rtrim(left(authority, length(authority) - length(root)), '.') AS labels
    FROM (SELECT *, {host('', mode, 'nl')} AS key, {host('', 'keep', 'nl')} AS host, lower(nl) AS authority,
        regexp_extract(lower(nl), '([^.]*\\.)?[^.]*$') AS root, lower(path) AS lpath
      FROM (SELECT *, {netloc('u')} AS nl, {path('u')} AS path, {part('u', 4)} AS query,
          lower({decoded('u')}) AS plain, split_part(split_part(lower(u), '?', 1), '/', 1) AS front
        FROM (SELECT * EXCLUDE ({url}), {url} AS u FROM ({source})))))"""


def features(profile: str) -> str:
    chain = 0 if profile == "A" else 1
    return feature_select(
        profile, f"SELECT page_id, result, url, 0 AS redirect_depth, {chain} AS chain_length FROM corpus",
        "page_id, result,",
    )


relation("features_a", ["corpus"], features("A"))
relation("features_b", ["corpus"], features("B"))


def probability(prefix: str = "") -> str:
    terms = [
        f"{w} * least(CAST({prefix}{n} AS DOUBLE) / {m}, 1.0)"
        for n, w, m in zip(C.FEATURES, C.WEIGHTS, C.MAX_VALUES)
    ]
    return f"(1.0 / (1.0 + exp(-5.0 * ({' + '.join(terms)}))))"


def feature_list() -> str:
    whole = {n for n, m in zip(C.FEATURES, C.MAX_VALUES) if m > 1} - {"url_entropy", "domain_entropy"}
    return ", ".join(
        f"CAST({n} AS BIGINT) AS {n}" if n in whole or n in C.BOOLEAN_FEATURES else f"{r6(n)} AS {n}"
        for n in C.FEATURES
    )


def allow_host(profile: str) -> str:
    if profile == "B":
        return host("url", "charstrip")
    front = f"CASE WHEN {netloc('url')} <> '' THEN {netloc('url')} ELSE split_part({path('url')}, '/', 1) END"
    return host("url", "keep", front)


def allow(profile: str) -> str:
    return listed_or_parent(allow_host(profile), C.ALLOW_LISTS[profile])


relation("scored_a", ["features_a"], f"SELECT *, {probability()} AS p, {allow('A')} AS allowed FROM features_a")
relation("classified_a", ["scored_a"], """
  SELECT *, CASE WHEN allowed THEN 0.01 ELSE p END AS threat_probability,
    CASE WHEN allowed OR p < 0.30 THEN 'safe' WHEN p <= 0.65 THEN 'uncertain' ELSE 'malicious' END AS verdict
  FROM scored_a""")


def predict_b(source: str) -> str:
    return f"""
  SELECT * EXCLUDE (p, allowed), CASE WHEN allowed OR p < 0.25 THEN 'Safe' WHEN p > 0.60 THEN 'Malicious'
      ELSE 'Suspicious' END AS label,
    CASE WHEN allowed THEN 0.99 ELSE round_even(CASE WHEN p < 0.25 THEN 1.0 - p WHEN p > 0.60 THEN p
      ELSE abs(p - 0.5) * 2.0 END, 4) END AS confidence,
    CASE WHEN allowed THEN 0.01 ELSE round_even(p, 4) END AS threat_probability
  FROM (SELECT *, {probability()} AS p, {allow('B')} AS allowed FROM {source})"""


relation("predicted_b", ["features_b"], predict_b("features_b"))


def category_score(t: str) -> str:
    terms = [
        f"{C.CATEGORY_WEIGHTS[n]} * least({hits(t, words)}, 3) / 3.0" for n, words in C.CATEGORY_KEYWORDS.items()
    ]
    return f"round_even(least({' + '.join(terms)}, 1.0), 4)"


def heuristic_select(source: str) -> str:
    return f"""
  SELECT *, round_even(0.60 * category_score + 0.40 *
      CASE WHEN entropy_suspicious THEN 1.0 ELSE url_entropy / 6.0 END, 4) AS heuristic_score
  FROM (SELECT *, {category_score('lower(url)')} AS category_score, round_even(eu, 4) AS url_entropy,
      round_even(eh, 4) AS host_entropy, round_even(ep, 4) AS path_entropy,
      (eu > 4.5 OR eh > 4.0) AS entropy_suspicious
    FROM (SELECT *, {entropy('url')} AS eu, {entropy(f"lower({netloc('url')})")} AS eh,
        {entropy(path('url'))} AS ep FROM {source}))"""


relation("heuristics", ["hosts"], heuristic_select("hosts"))


def positions_of(names, shape: K.Shape) -> str:
    return f"(SELECT list(p) FROM (SELECT unnest({double_hashed('n', shape)}) AS p FROM (SELECT unnest([{quoted(names)}]) AS n)))"


def vote_select(source: str, bad: str, safe: str, sliced: str | None = None, fingerprints: str | None = None) -> str:
    """Votes over ``source(domain)``; ``bad``/``safe`` are scalar subqueries giving position lists."""
    fps = fingerprints or (
        f"(SELECT list({fingerprint('n', K.BUCKETS)}) FROM (SELECT unnest([{quoted(C.MALICIOUS_DOMAINS)}]) AS n))"
    )
    return f"""
  SELECT *, CASE WHEN v_allow THEN 'KNOWN_SAFE' WHEN bloom_score >= 0.5 THEN 'KNOWN_MALICIOUS'
    ELSE 'UNCERTAIN' END AS bloom_result
  FROM (SELECT *, CASE WHEN v_allow THEN 0.0 ELSE 0.50 * CAST(v_fp AS INT) + 0.25 * CAST(v_count AS INT)
      + 0.25 * CAST(v_slice AS INT) END AS bloom_score
    FROM (SELECT *, list_has_all({safe}, {double_hashed('domain', K.ALLOW_SHAPE)}) AS v_allow,
        list_has_all({bad}, {double_hashed('domain', K.COUNTING_SHAPE)}) AS v_count,
        list_has_all({sliced or bad}, {double_hashed('domain', K.COUNTING_SHAPE)}) AS v_slice,
        list_contains({fps}, {fingerprint('domain', K.BUCKETS)}) AS v_fp FROM {source}))"""


BUILTIN_VOTE = (positions_of(C.MALICIOUS_DOMAINS, K.COUNTING_SHAPE), positions_of(C.SAFE_DOMAINS, K.ALLOW_SHAPE))
relation("voted", ["hosts"], vote_select("hosts", *BUILTIN_VOTE))
VERDICT = (
    f"CASE WHEN {listed_or_parent('domain', C.SAFE_DOMAINS)} THEN 'safe' "
    f"WHEN {listed_prefix('domain', C.MALICIOUS_DOMAINS + C.MALICIOUS_PREFIXES)} THEN 'malicious' "
    "ELSE 'unknown' END"
)


def gate_select(source: str, verdict: str = VERDICT) -> str:
    """Gate over ``source``, which has the votes and the heuristic score of every row."""
    return f"""
  SELECT *, decision <> 'FORWARD' AS ml_skipped, CASE
      WHEN list_result = 'safe' THEN '{G.REASONS["list_safe"]}'
      WHEN list_result = 'malicious' THEN '{G.REASONS["list_bad"]}'
      WHEN bloom_result = 'KNOWN_SAFE' THEN '{G.REASONS["vote_safe"]}'
      WHEN decision = 'BLOCK' THEN printf('Bloom blacklist (%.2f) + heuristic (%.2f ≥ 0.7)', bloom_score, heuristic_score)
      WHEN bloom_result = 'KNOWN_MALICIOUS' THEN '{G.REASONS["vote_weak"]}'
      WHEN heuristic_score >= 0.35 THEN '{G.REASONS["flagged"]}' ELSE '{G.REASONS["plain"]}' END AS reason
  FROM (SELECT * REPLACE (
      CASE WHEN list_result = 'unknown' THEN bloom_result END AS bloom_result,
      CASE WHEN list_result = 'unknown' THEN bloom_score ELSE 0.0 END AS bloom_score,
      CASE WHEN list_result = 'unknown' AND bloom_result <> 'KNOWN_SAFE' THEN heuristic_score ELSE 0.0 END AS heuristic_score),
    CASE WHEN list_result = 'safe' THEN 'PASS' WHEN list_result = 'malicious' THEN 'BLOCK'
      WHEN bloom_result = 'KNOWN_SAFE' THEN 'PASS'
      WHEN bloom_result = 'KNOWN_MALICIOUS' AND heuristic_score >= 0.70 THEN 'BLOCK'
      ELSE 'FORWARD' END AS decision
    FROM (SELECT *, {verdict} AS list_result FROM ({source})))"""


relation("gated", ["voted"], gate_select(heuristic_select("voted")))
relation("visit_hosts", ["visits"], f"SELECT url, {host('url', 'charstrip')} AS domain FROM visits")
relation("visit_voted", ["visit_hosts"], vote_select("visit_hosts", *BUILTIN_VOTE))
relation("visit_gated", ["visit_voted"], gate_select(heuristic_select("visit_voted")))
FAST = """
  SELECT *, CASE WHEN decision = 'BLOCK' THEN 'Malicious' ELSE 'Safe' END AS label,
    CASE WHEN decision = 'BLOCK' THEN least(0.60 + bloom_score * 0.35, 0.99) ELSE 0.99 END AS confidence,
    CASE WHEN decision = 'BLOCK' THEN least(0.75 + heuristic_score * 0.20, 0.99) ELSE 0.01 END AS threat_probability,
    CASE WHEN decision = 'BLOCK' THEN greatest(70, CAST(floor(70 + heuristic_score * 25) AS INT)) ELSE 1 END AS risk_score
  FROM gated WHERE decision <> 'FORWARD'"""
relation("fast", ["gated"], FAST)


# -- chains ----------------------------------------------------------------------------------------
ORIGIN = f"concat(lower({part('url', 1)}), '://', {netloc('url')})"
META = r"""regexp_extract(body, '<meta[^>]+http-equiv=["'']?refresh["'']?[^>]+content=["'']?\s*\d*\s*;?\s*url=([^"''>\s]+)', 1, 'i')"""
SCRIPT = r"""regexp_extract(body, 'window\.location(?:\.href)?\s*=\s*["'']([^"'']+)["'']', 1, 'i')"""


def soft(target: str) -> str:
    return (
        f"CASE WHEN {target} = '' THEN NULL WHEN starts_with({target}, 'http') THEN {target} "
        f"ELSE {ORIGIN} || {target} END"
    )


relation("nexts", ["hop_log"], f"""
  SELECT url, status_code, CASE
      WHEN status_code = 301 OR (status_code = 302 AND starts_with(location, 'http')) THEN location
      WHEN status_code = 302 AND location = '' THEN NULL
      WHEN status_code = 302 THEN {ORIGIN} || '/final?x=1'
      WHEN contains(content_type, 'html') THEN coalesce({soft(META)}, {soft(SCRIPT)}) END AS next_url,
    CASE WHEN status_code IN (301, 302) THEN 'http_3xx' WHEN NOT contains(content_type, 'html') THEN 'none'
      WHEN {META} <> '' THEN 'meta_refresh' WHEN {SCRIPT} <> '' THEN 'js_redirect' ELSE 'none' END AS hop_type,
    CASE WHEN status_code = 302 AND location = '' THEN 'Empty Location header' END AS hop_error
  FROM hop_log""")
relation("walk", ["corpus", "nexts"], """
  SELECT c.url AS start, 0 AS hop, c.url, n.status_code, n.next_url, coalesce(n.hop_type, 'none') AS redirect_type,
    [c.url] AS seen, CASE WHEN n.url IS NULL THEN concat('Connect error at hop 0 (', c.url, ')')
      WHEN n.hop_error IS NOT NULL THEN concat(n.hop_error, ' at hop 0') END AS error
  FROM corpus c LEFT JOIN nexts n ON n.url = c.url
  UNION ALL
  SELECT w.start, w.hop + 1, w.next_url, n.status_code, n.next_url, coalesce(n.hop_type, 'none'),
    list_append(w.seen, w.next_url), CASE WHEN n.url IS NULL
      THEN concat('Connect error at hop ', w.hop + 1, ' (', w.next_url, ')')
      WHEN n.hop_error IS NOT NULL THEN concat(n.hop_error, ' at hop ', w.hop + 1) END
  FROM walk w LEFT JOIN nexts n ON n.url = w.next_url
  WHERE w.next_url IS NOT NULL AND NOT list_contains(w.seen, w.next_url) AND w.hop < 15""")
relation("walked", ["walk"], """
  SELECT start, max(hop) AS last_hop, arg_max(url, hop) AS last_url,
    coalesce(bool_or(list_contains(seen, next_url) AND hop < 15), FALSE) AS loop_detected,
    list_filter(list_append(list(error ORDER BY hop),
      max(CASE WHEN list_contains(seen, next_url) AND hop < 15
        THEN concat('Redirect loop at hop ', hop + 1, ': ', next_url) END)), lambda e: e IS NOT NULL) AS errors
  FROM walk GROUP BY start""")
# the corpus embeds redirect targets in one way only: an escaped http URL in the "url" parameter
EMBEDDED = r"nullif(regexp_extract(url_decode(url), '[?&]url=(http://[^&#]*)', 1), '')"
IP_HOST = rf"regexp_matches(split_part(regexp_extract({netloc('url')}, '[^@]*$'), ':', 1), '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$')"
HOP_BAD = f"({tld(host('url', 'charstrip'), C.HOP_TLDS)} OR {IP_HOST})"
relation("hops", ["walk", "walked"], f"""
  SELECT start, hop, url, status_code,
    {HOP_BAD} OR (redirect_type = 'none' AND {EMBEDDED} IS NOT NULL) AS is_suspicious,
    CASE WHEN redirect_type = 'none' AND {EMBEDDED} IS NOT NULL THEN 'open_redirect' ELSE redirect_type END AS redirect_type
  FROM walk
  UNION ALL
  SELECT start, 1, url, NULL, {HOP_BAD}, 'open_redirect'
  FROM (SELECT start, {EMBEDDED.replace('(url)', '(start)')} AS url FROM walked WHERE last_hop = 0) WHERE url IS NOT NULL""")
SHORT_B = f"({host('url', 'charstrip')} IN ({quoted(C.SHORTENERS_B)}))"
SHORT_A = f"(replace(lower({netloc('url')}), 'www.', '') IN ({quoted(C.SHORTENERS_A)}))"
HOP_RISK = f"""least(1.0, CASE WHEN {tld(host('url', 'charstrip'), C.HOP_RISK_TLDS)} THEN 0.35 ELSE 0.0 END
    + CASE WHEN regexp_matches({host('url', 'charstrip')}, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') THEN 0.30 ELSE 0.0 END
    + CASE WHEN {entropy('url')} > 4.5 THEN 0.15 ELSE 0.0 END
    + least({hits('lower(url)', C.HOP_KEYWORDS)} / {len(C.HOP_KEYWORDS)}, 0.20))"""
relation("expanded", ["hops", "walked"], f"""
  SELECT url, last_url AS expanded_url, chain_length - 1 AS redirect_count, chain_length - 1 >= 15 AS excessive,
    loop_detected, errors, {SHORT_B} OR virtual AS is_shortened,
    CASE WHEN {SHORT_B} THEN {host('url', 'charstrip')} END AS shortener_domain,
    suspicious_hops, max_hop_risk, unique_domains, chain_length
  FROM (SELECT h.start AS url, arg_max(h.url, h.hop) AS last_url, count(*) AS chain_length,
      any_value(w.loop_detected) AS loop_detected, any_value(w.errors) AS errors,
      count(*) > any_value(w.last_hop) + 1 AS virtual, sum(CAST(h.risk > 0.3 AS INT)) AS suspicious_hops,
      round_even(max(h.risk), 3) AS max_hop_risk, count(DISTINCT h.domain) AS unique_domains
    FROM (SELECT *, {HOP_RISK} AS risk, {host('url', 'charstrip')} AS domain FROM hops) h
    JOIN walked w ON w.start = h.start GROUP BY h.start)""")
relation("short_walk", ["corpus", "hop_log"], f"""
  SELECT url AS start, 0 AS hop, url, [url] AS chain FROM corpus WHERE {SHORT_A}
  UNION ALL
  SELECT w.start, w.hop + 1, n.next_url, list_append(w.chain, n.next_url) FROM short_walk w JOIN (
    SELECT url, CASE WHEN starts_with(location, 'http') THEN location ELSE {ORIGIN} || '/final?x=1' END AS next_url
    FROM hop_log WHERE status_code IN (301, 302) AND location <> '') n ON n.url = w.url WHERE w.hop < 10""")
relation("expanded_a", ["corpus", "short_walk", "hop_log"], f"""
  SELECT start AS url, arg_max(url, hop) AS final_url, arg_max(chain, hop) AS redirect_chain,
    max(hop) AS redirect_count, TRUE AS is_shortened,
    CASE WHEN arg_max(url, hop) NOT IN (SELECT url FROM hop_log) AND max(hop) < 10
      THEN concat('Connect error at hop ', max(hop), ' (', arg_max(url, hop), ')') END AS error
  FROM short_walk GROUP BY start
  UNION ALL SELECT url, url, [url], 0, FALSE, NULL FROM corpus WHERE NOT {SHORT_A}""")

# -- full profile B scan ---------------------------------------------------------------------------
relation("forward_features", ["gated", "expanded"], feature_select(
    "B", """SELECT g.url AS request, e.expanded_url AS url, e.redirect_count AS redirect_depth, e.chain_length,
      g.heuristic_score, e.is_shortened, e.shortener_domain, e.redirect_count, e.loop_detected, e.excessive,
      e.suspicious_hops, e.errors FROM gated g JOIN expanded e ON e.url = g.url WHERE g.decision = 'FORWARD'""",
    "request, heuristic_score, is_shortened, shortener_domain, redirect_count, loop_detected, excessive, "
    "suspicious_hops, errors,"))
relation("forward_scored", ["forward_features"], predict_b(
    "(SELECT * REPLACE (greatest(keyword_score, heuristic_score) AS keyword_score) FROM forward_features)"))
relation("forward_risk", ["forward_scored"], """
  SELECT *, least(100, ml_points + redirect_points + heuristic_points) AS risk_score FROM (
    SELECT *, CAST(round_even(threat_probability * 55.0, 0) AS INT) AS ml_points,
      least(25, 10 * CAST(loop_detected AS INT) + 8 * CAST(excessive AS INT) + least(redirect_count * 2, 5)
        + least(suspicious_hops * 3, 9)) AS redirect_points,
      least(20, 6 * CAST(has_ip AS INT) + 4 * CAST(has_at_symbol AS INT) + 5 * CAST(tld_suspicious AS INT)
        + 6 * CAST(brand_in_subdomain AS INT) + 7 * CAST(has_homograph AS INT)
        + 4 * CAST(keyword_score > 0.15 AS INT) + 3 * CAST(url_entropy > 4.5 AS INT)
        + 2 * CAST(url_length > 100 AS INT)) AS heuristic_points FROM forward_scored)""")


def settled_feature(name: str) -> str:
    special = {
        "url_length": "length(url)", "has_https": "decision = 'PASS' AND starts_with(url, 'https://')",
        "keyword_score": "CASE WHEN decision = 'BLOCK' THEN heuristic_score ELSE 0.0 END",
        "domain_age_proxy": "CASE WHEN decision = 'BLOCK' THEN 0.0 ELSE 1.0 END",
    }
    return special.get(name, "FALSE" if name in C.BOOLEAN_FEATURES else "0")


relation("scanned", ["fast", "forward_risk"], f"""
  SELECT request AS url, url AS expanded_url, is_shortened, shortener_domain, redirect_count, loop_detected,
    excessive AS excessive_redirects, suspicious_hops, 'FORWARD' AS decision, {', '.join(C.FEATURES)}, label,
    confidence, threat_probability, ml_points, redirect_points, heuristic_points, risk_score,
    CASE WHEN risk_score <= 30 THEN 'Safe' WHEN risk_score <= 60 THEN 'Suspicious' ELSE 'Malicious' END AS risk_level,
    errors FROM forward_risk
  UNION ALL
  SELECT url, url, FALSE, NULL, 0, FALSE, FALSE, 0, decision, {', '.join(settled_feature(n) for n in C.FEATURES)},
    label, confidence, threat_probability, 0, 0, risk_score, risk_score, label,
    CASE WHEN decision = 'BLOCK' THEN ['Blocked by Stage 1 pre-filter: ' || reason] ELSE [] END FROM fast""")

# -- membership and profile A scan -----------------------------------------------------------------
relation("bad_grams", ["known_bad"], f"SELECT DISTINCT unnest({trigrams('url')}) AS gram FROM known_bad")
relation("alike", ["corpus", "bad_grams"], f"""
  SELECT url, avg(CASE WHEN b.gram IS NOT NULL THEN 1.0 ELSE 0.0 END) AS similarity
  FROM (SELECT url, unnest({trigrams('url')}) AS gram FROM corpus) u LEFT JOIN bad_grams b ON b.gram = u.gram
  GROUP BY url""")


def filter_positions(source: str, shape: K.Shape) -> str:
    return f"SELECT DISTINCT unnest({seeded('url', shape)}) AS position FROM {source}"


def in_filter(urls: str, positions: str, shape: K.Shape) -> str:
    return f"""
  SELECT url, bool_and(position IN (SELECT position FROM {positions})) AS in_filter
  FROM (SELECT url, unnest({seeded('url', shape)}) AS position FROM {urls}) GROUP BY url"""


BIG, SMALL = K.Shape.plain(), K.Shape.plain(20, 0.05)
relation("positions_big", ["known_bad"], filter_positions("known_bad", BIG))
relation("all_bad", ["corpus"], "SELECT url FROM corpus WHERE result = 1")
relation("positions_all", ["all_bad"], filter_positions("all_bad", BIG))
relation("positions_small", ["known_bad"], filter_positions("known_bad", SMALL))
relation("probed_small", ["corpus", "positions_small"], in_filter("corpus", "positions_small", SMALL))
relation("probed_big", ["corpus", "positions_big"], in_filter("corpus", "positions_big", BIG))
relation("blacklist", ["corpus"], "SELECT url FROM corpus WHERE page_id % 32 = 9")
relation("member", ["probed_big", "alike", "blacklist"], """
  SELECT url, in_filter, similarity, in_blacklist, in_filter OR similarity > 0.92 OR in_blacklist AS possible
  FROM (SELECT p.url, p.in_filter, s.similarity, p.url IN (SELECT url FROM blacklist) AS in_blacklist
    FROM probed_big p JOIN alike s ON s.url = p.url)""")
PATTERN_COUNT = hits("normalized_url", C.PATTERN_KEYWORDS)
relation("signals", ["corpus"], rf"""
  SELECT url, normalized_url, {PATTERN_COUNT} AS match_count, {PATTERN_COUNT} / 18 AS pattern_score,
    array_to_string(list_filter([{quoted(C.PATTERN_KEYWORDS)}], lambda w: contains(normalized_url, w)), '|') AS matched_keywords,
    regexp_matches(url, '[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}') AS has_ip_address,
    {share('[^0-9]', 'url')} AS digit_ratio, {count_of('url', '.')} AS dot_count,
    {count_of('url', '-')} AS hyphen_count, {share('[^@%=&?]', 'url')} AS special_char_ratio
  FROM (SELECT url, {adversarial('url')} AS normalized_url FROM corpus)""")
relation("met", ["signals", "depths"], rf"""
  SELECT s.url, CAST({entropy('s.url')} > 4.0 AS INT) + CAST(regexp_matches(s.url, '\.(tk|ml|ga|cf|gq|xyz)$') AS INT)
    + CAST(pattern_score > 0.1 AS INT) + CAST(has_ip_address AS INT) + CAST(redirect_depth > 2 AS INT) AS met
  FROM signals s JOIN depths d ON d.url = s.url""")

# scan A: profile and features of every URL a shortener may lead to
relation("targets", ["expanded_a"], "SELECT url FROM expanded_a UNION SELECT final_url FROM expanded_a")
relation("target_profile", ["targets", "reach", "edges"], f"""
  SELECT t.url, {entropy('t.url')} AS entropy,
    coalesce((SELECT max(dist) FROM reach r WHERE r.src = t.url), 0) AS redirect_depth,
    CASE WHEN {entropy('t.url')} < 3.0 THEN 0
      ELSE 1 + (SELECT count(*) FROM reach r WHERE r.src = t.url AND r.dist <= 10) END AS chain_length
  FROM targets t""")
relation("target_scored", ["target_profile"], f"""
  SELECT *, CASE WHEN allowed THEN 0.01 ELSE p END AS prob,
    CASE WHEN allowed OR p < 0.30 THEN 'safe' WHEN p <= 0.65 THEN 'uncertain' ELSE 'malicious' END AS verdict
  FROM (SELECT *, {probability()} AS p, {allow('A')} AS allowed
    FROM ({feature_select('A', 'SELECT url, entropy, redirect_depth, chain_length FROM target_profile', 'entropy,')}))""")
relation("a_pairs", ["expanded_a", "target_scored"], """
  SELECT x.url, x.final_url AS analyzed_url, x.is_shortened, x.redirect_count, d.entropy, d.redirect_depth, d.allowed,
    CASE WHEN x.url <> x.final_url THEN 0.35 * o.prob + 0.65 * d.prob ELSE d.prob END AS prob, d.verdict AS own_verdict
  FROM expanded_a x JOIN target_scored o ON o.url = x.url JOIN target_scored d ON d.url = x.final_url""")
relation("a_probed", ["targets", "positions_big"], in_filter("targets", "positions_big", BIG))
relation("a_alike", ["targets", "bad_grams"], f"""
  SELECT url, avg(CASE WHEN b.gram IS NOT NULL THEN 1.0 ELSE 0.0 END) AS similarity
  FROM (SELECT url, unnest({trigrams('url')}) AS gram FROM targets) u LEFT JOIN bad_grams b ON b.gram = u.gram
  GROUP BY url""")
relation("a_nearest", ["targets", "reach", "known_bad"], """
  SELECT t.url, CASE WHEN t.url IN (SELECT url FROM known_bad) THEN 0 ELSE
    (SELECT min(dist) FROM reach r WHERE r.src = t.url AND r.dst IN (SELECT url FROM known_bad)) END AS path_length
  FROM targets t""")
relation("char_weights", ["corpus"], """
  SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(url, '')) AS ch FROM corpus WHERE result = 0) GROUP BY ch""")
relation("merges", ["char_weights"], """
  SELECT list_sort(list(n)) AS w, CAST(0 AS BIGINT) AS total FROM char_weights
  UNION ALL SELECT list_sort(list_append(w[3:], w[1] + w[2])), CAST(total + w[1] + w[2] AS BIGINT)
  FROM merges WHERE len(w) > 1""")
relation("baseline", ["merges", "char_weights"],
         "SELECT max(total) / (SELECT sum(n) FROM char_weights) AS baseline FROM merges")
relation("a_stage", ["a_pairs", "a_probed", "a_alike", "a_nearest"], r"""
  SELECT *, prob AS threat_probability, CASE WHEN NOT possible THEN 'unknown' WHEN met >= 3 THEN 'malicious'
      ELSE 'suspicious' END AS member,
    CASE WHEN url = analyzed_url THEN own_verdict WHEN prob < 0.25 THEN 'safe' WHEN prob > 0.60 THEN 'malicious'
      WHEN prob > 0.40 THEN 'suspicious' ELSE 'uncertain' END AS verdict,
    CASE WHEN allowed THEN prob ELSE least(1.0, (CASE WHEN is_shortened AND prob < 0.5 THEN prob + 0.05 ELSE prob END)
      + CASE WHEN redirect_count > 3 THEN 0.05 ELSE 0.0 END) END AS final_probability
  FROM (SELECT p.*, n.path_length, f.in_filter OR s.similarity > 0.92 AS possible,
      CAST(p.entropy > 4.0 AS INT) + CAST(regexp_matches(p.analyzed_url, '\.(tk|ml|ga|cf|gq|xyz)$') AS INT)
        + CAST(p.redirect_depth > 2 AS INT) AS met
    FROM a_pairs p JOIN a_probed f ON f.url = p.analyzed_url JOIN a_alike s ON s.url = p.analyzed_url
    JOIN a_nearest n ON n.url = p.analyzed_url)""")
relation("a_final", ["a_stage"], """
  SELECT *, CASE WHEN allowed OR final_probability < 0.25 THEN 'safe'
      WHEN member = 'malicious' OR final_probability > 0.75 THEN 'malicious'
      WHEN final_probability > 0.55 OR (member = 'suspicious' AND final_probability > 0.35) THEN 'suspicious'
      WHEN final_probability > 0.35 THEN 'uncertain' ELSE 'safe' END AS final_verdict,
    CASE WHEN allowed OR final_probability < 0.25 THEN 'high'
      WHEN member = 'malicious' OR final_probability > 0.75 THEN 'high'
      WHEN final_probability > 0.55 OR (member = 'suspicious' AND final_probability > 0.35) THEN 'medium'
      WHEN final_probability > 0.35 THEN 'low' ELSE 'medium' END AS final_confidence
  FROM a_stage""")
RANK_A = "(0.45 * prob + 0.25 * (entropy / 5.0) + 0.20 * least(redirect_depth / 10.0, 1.0))"
relation("profile_scored", ["profile"], f"""
  SELECT *, CASE WHEN allowed THEN 0.01 ELSE p END AS prob FROM (
    SELECT *, {probability()} AS p, {allow('A')} AS allowed
    FROM ({feature_select('A', 'SELECT * FROM profile', 'entropy,')}))""")
relation("merged", ["corpus", "scan_log"], """
  SELECT url, CASE result WHEN 1 THEN 'malicious' ELSE 'benign' END AS label, result, 0 AS source, 0 AS line FROM corpus
  UNION ALL SELECT url, 'benign', 0, 1, event_id FROM scan_log""")
relation("entries", ["scan_log"],
         "SELECT url, max(ts) AS inserted_at FROM scan_log GROUP BY url")
relation("aged", ["entries", "scan_log"], """
  SELECT url, exp(-0.0001 * (epoch_us((SELECT max(ts) FROM scan_log)) - epoch_us(inserted_at)) / 1000000.0) AS effective_score
  FROM entries""")


def _recommendation() -> str:
    cases = [
        f"WHEN allowed AND is_shortened THEN '{S.TRUSTED_SHORT_TEXT}'", f"WHEN allowed THEN '{S.TRUSTED_TEXT}'",
    ]
    for name, (plain, extra) in S.RECOMMENDATIONS.items():
        cases.append(
            f"WHEN final_verdict = '{name}' THEN '{plain}' || CASE WHEN is_shortened THEN '{extra}' ELSE '' END"
        )
    return f"CASE {' '.join(cases)} END"


def _minhash(u: str, count: int) -> str:
    a = "CAST('0x' || substr(md5(g), 1, 7) AS BIGINT)"
    b = "CAST('0x' || substr(md5(g), 9, 7) AS BIGINT)"
    return "[" + ", ".join(
        f"list_min([({a} + {i} * {b}) % 2147483647 for g in {trigrams(u)}])" for i in range(count)
    ) + "]"


def _stats_long() -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{n}_{kind}' AS stat, {r6(f'{fn}(CAST({n} AS DOUBLE))')} AS value FROM features_a"
        for n in C.FEATURES for kind, fn in (("mean", "avg"), ("std", "stddev_pop"))
    )


def _flags_long() -> str:
    bad = {n: n for n in C.BOOLEAN_FEATURES if n != "has_https"}
    bad |= {"keyword_score": "keyword_score > 0.1", "url_entropy": "url_entropy > 4.5", "url_length": "url_length > 100"}
    return "\nUNION ALL ".join(
        f"SELECT '{n}' AS feature, count(*) FILTER (WHERE {bad.get(n, 'FALSE')}) AS flagged, "
        f"{r6(f'avg(CAST({n} AS DOUBLE))')} AS avg_value FROM features_b" for n in C.FEATURES
    )


def _report() -> str:
    cells = """(SELECT sum(CAST(result = 0 AND NOT hit AS INT)) AS tn, sum(CAST(result = 0 AND hit AS INT)) AS fp,
      sum(CAST(result = 1 AND NOT hit AS INT)) AS fn, sum(CAST(result = 1 AND hit AS INT)) AS tp
      FROM (SELECT result, p > 0.5 AS hit FROM scored_a))"""

    def ratio(a: str, b: str) -> str:
        return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END)"

    metrics = f"""(SELECT *, {ratio('2 * p0 * r0', 'p0 + r0')} AS f0, {ratio('2 * p1 * r1', 'p1 + r1')} AS f1,
      n0 + n1 AS n FROM (SELECT {ratio('tn', 'tn + fn')} AS p0, {ratio('tn', 'tn + fp')} AS r0, tn + fp AS n0,
      {ratio('tp', 'tp + fp')} AS p1, {ratio('tp', 'tp + fn')} AS r1, tp + fn AS n1,
      (tn + tp) / (tn + fp + fn + tp) AS acc FROM {cells}))"""
    rows = {
        "benign": ("p0", "r0", "f0", "n0"), "malicious": ("p1", "r1", "f1", "n1"),
        "accuracy": ("acc", "acc", "acc", "n"),
        "macro avg": ("(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "n"),
        "weighted avg": tuple(f"({x}0 * n0 + {x}1 * n1) / n" for x in "prf") + ("n",),
    }
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS class, {r6(p)} AS precision, {r6(r)} AS recall, {r6(f)} AS f1, "
        f"CAST({n} AS BIGINT) AS support FROM {metrics}" for name, (p, r, f, n) in rows.items()
    )


def _prefix_positions(source: str, shape: K.Shape) -> str:
    return f"SELECT unnest({double_hashed('domain', shape)}) AS position, domain FROM {source}"


relation("signed", ["corpus"], f"SELECT url, {_minhash('url', 10)} AS m FROM (SELECT DISTINCT url FROM corpus WHERE length(url) >= 3)")
SLICES = K.Slices(200)
COUNTING, TINY = K.Shape.rounded(2000, 0.01), K.Shape.rounded(50, 0.05)
FP_BUCKETS = K.fingerprint_buckets(2000)


def _sliced_select(slices: K.Slices = SLICES, most: int = 40) -> str:
    """Membership in the sliced filter; ``most`` bounds the slices of the small tables it is run on."""
    rows, upto = [], 0
    for i in range(most):
        shape, upto = slices.shape(i), upto + slices.room(i)
        rows.append(f"({i}, {shape.m}, {shape.k}, {upto}, {upto - slices.room(i)})")
    h1, h2, h3 = (hex_int("md5(url)", start, 8) for start in (1, 9, 17))
    at = "list_transform(range(k), lambda i: (h1 + i * CASE WHEN h2 % m = 0 THEN 1 ELSE h2 END) % m)"
    return f"""SELECT url, CAST(bool_or(hit) AS BIGINT) AS contained FROM (
      WITH shapes(slice, m, k, upto, below) AS (VALUES {", ".join(rows)}),
      hashed AS (SELECT DISTINCT url, {h1} AS h1, {h2} AS h2, {h3} AS h3 FROM corpus),
      member AS (SELECT * FROM hashed WHERE url IN (SELECT url FROM corpus WHERE result = 1)),
      used AS (SELECT *, max(upto) OVER () AS total, max(slice) OVER () AS last FROM shapes
        WHERE below < (SELECT greatest(count(*), 1) FROM member)),
      placed AS (SELECT url, h1, h2, min(slice) AS slice FROM member, used
        WHERE slice = last OR h3 < (4294967296 * upto) // total GROUP BY ALL),
      filled AS (SELECT DISTINCT slice, unnest({at}) AS position FROM placed JOIN used USING (slice)),
      asked AS (SELECT url, slice, unnest({at}) AS position FROM hashed, used)
      SELECT c.page_id, c.url, bool_and(f.position IS NOT NULL) AS hit FROM corpus c JOIN asked a ON a.url = c.url
      LEFT JOIN filled f ON f.slice = a.slice AND f.position = a.position GROUP BY c.page_id, c.url, a.slice)
      GROUP BY page_id, url"""


def oracle_sql() -> dict[str, str]:
    """Reference SQL by query name."""
    label = "CASE WHEN result = 1 THEN 'malicious' ELSE 'benign' END"
    per_url: dict[str, str] = {
        "b3_private_host": "CAST(regexp_matches(regexp_replace(regexp_extract(lower(" + netloc("url")
        + r"), '[^@]*$'), ':.*$', ''), '^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.|0\.|localhost)') AS BIGINT) AS private",
        "b4_split": f"lower({part('url', 1)}) AS scheme, {netloc('url')} AS netloc, {path('url')} AS path, "
        f"{part('url', 4)} AS query, {part('url', 5)} AS fragment",
        "b5_domain_key": ", ".join(f"{host('url', m)} AS {m}" for m in ("charstrip", "prefix", "keep")),
        "b6_true_host": f"regexp_replace(regexp_extract(lower({netloc('url')}), '[^@]*$'), ':.*$', '') AS true_host",
        "b7_port": f"TRY_CAST(nullif(regexp_extract(regexp_extract({netloc('url')}, '[^@]*$'), ':([0-9]+)$', 1), '') AS BIGINT) AS port",
        "b8_root_domain": r"regexp_extract(split_part(regexp_replace(url, '^https?://', ''), '/', 1), '([^.]*\.)?[^.]*$') AS root",
        "b9_percent_decode": f"{decoded('url')} AS decoded",
        "b10_leet_expand": "translate(lower(url), '0134578@$', 'oieastbas') AS expanded",
        "b11_collapse": "translate(url, '-_', '') AS collapsed",
        "b12_adversarial_form": f"{adversarial('url')} AS normalized",
        "b13_parent_domains": f"unnest({parents(host('url', 'charstrip'))}) AS parent",
        "b15_open_redirect": f"{EMBEDDED} AS target",
        "b16_shortener": f"{flag(SHORT_A)} AS short_a, {flag(SHORT_B)} AS short_b",
        "b20_trigrams": f"unnest({trigrams('url')}) AS gram",
        "b21_trigram_signature": hex_int(f"md5(array_to_string(list_sort({trigrams('url')}), ''))", 1, 15) + " AS signature",
        "d2_first_position": ", ".join(
            f"CAST(instr(lower(url), '{w}') - 1 AS BIGINT) AS {w}" for w in ("login", "verify", "secure", "paypal")
        ),
        "e8_allow_list": f"{flag(allow('A'))} AS allow_a, {flag(allow('B'))} AS allow_b",
        "i3_hop_suspicion": f"{flag(HOP_BAD)} AS suspicious",
        "i6_hop_risk": f"{r6(HOP_RISK)} AS risk",
    }
    out = {name: with_(f"SELECT url, {sql} FROM corpus", "corpus") for name, sql in per_url.items()}

    def add(name: str, select: str, *names: str) -> None:
        out[name] = with_(select, *names)

    # A
    add("a1_csv_scan", f"SELECT url, {label} AS label, CAST(result AS BIGINT) AS result FROM corpus", "corpus")
    add("a2_tsv_scan", f"""SELECT url, {label} AS label, CAST(result AS BIGINT) AS result, 'test' AS split
      FROM corpus WHERE page_id % 10 NOT IN (7, 8)""", "corpus")
    add("a3_csv_sink", f"""SELECT {label} AS label, count(*) AS n, CAST(sum(length(url)) AS BIGINT) AS chars
      FROM corpus GROUP BY ALL""", "corpus")
    add("a4_feature_stats", _stats_long(), "features_a")
    add("a5_list_load", "SELECT domain AS pattern, count(*) AS added FROM hosts WHERE page_id % 5 <> 0 GROUP BY domain", "hosts")
    add("a6_batch_intake", """SELECT 'b' || (page_id // 50) AS batch_id, url, CAST(CASE WHEN (page_id // 50) % 2 = 0 THEN 5 ELSE 10 END AS BIGINT) AS top_k
      FROM corpus""", "corpus")
    add("a7_hop_log", """SELECT url, CAST(status_code AS BIGINT) AS status_code, location, content_type,
      CAST(length(body) AS BIGINT) AS body_chars FROM hop_log""", "hop_log")
    # B
    add("b1_with_scheme", """SELECT page_id, CASE WHEN page_id % 3 = 0
      THEN 'http://' || regexp_replace(url, '^https?://', '') ELSE url END AS url FROM corpus""", "corpus")
    add("b2_validation", """SELECT page_id, CAST(page_id % 7 IN (0, 5, 6) AS BIGINT) AS valid, CASE page_id % 7
      WHEN 1 THEN 'URL failed structural regex check' WHEN 2 THEN 'URL is empty or too long'
      WHEN 3 THEN 'URL has no host/netloc' WHEN 4 THEN 'URL is empty or too long' ELSE 'ok' END AS reason
      FROM corpus""", "corpus")
    add("b14_query_params", f"""SELECT url, CAST(i - 1 AS BIGINT) AS pos, url_decode(split_part(ps[i], '=', 1)) AS name,
        url_decode(substr(ps[i], instr(ps[i], '=') + 1)) AS value
      FROM (SELECT url, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT url,
        list_filter(string_split({part('url', 4)}, '&'), lambda p: regexp_matches(p, '^[^=]*=.')) AS ps FROM corpus))""", "corpus")
    folder = f"list_filter(string_split({part('url', 3)}, '/')[:-2], lambda s: s <> '')"
    add("b17_resolve", f"""SELECT url, CASE page_id % 6 WHEN 0 THEN {ORIGIN} || '/next'
      WHEN 1 THEN {ORIGIN} || '/' || array_to_string(list_concat({folder}, ['sub', 'page.html']), '/')
      WHEN 2 THEN lower({part('url', 1)}) || '://cdn.example.com/x' WHEN 3 THEN 'https://other.org/y?z=1'
      WHEN 4 THEN {ORIGIN} || '/' || array_to_string(list_concat({folder}[:-2], ['up', 'a']), '/')
      ELSE {ORIGIN} || {part('url', 3)} || '?only=query' END AS resolved FROM corpus""", "corpus")
    add("b18_meta_refresh", f"SELECT url, {soft(META)} AS target FROM (SELECT url, html AS body FROM hop_pages)", "hop_pages")
    add("b19_script_redirect", f"SELECT url, {soft(SCRIPT)} AS target FROM (SELECT url, html AS body FROM hop_pages)", "hop_pages")
    add("b22_similar_urls", f"""SELECT a.url AS first_url, b.url AS second_url, {r6("len(list_filter(list_zip(a.m, b.m), lambda z: z[1] = z[2])) / 10")} AS similarity
      FROM signed a JOIN signed b ON a.url < b.url WHERE len(list_filter(list_zip(a.m, b.m), lambda z: z[1] = z[2])) >= 8""", "signed")
    add("b22_most_similar", f"""SELECT url, count(*) AS similar, arg_min(other, (-same, other)) AS best, {r6("max(same) / 10")} AS best_similarity
      FROM (SELECT a.url, b.url AS other, len(list_filter(list_zip(a.m, b.m), lambda z: z[1] = z[2])) AS same
        FROM signed a JOIN signed b ON a.url <> b.url) WHERE same >= 8 GROUP BY url""", "signed")
    add("b22_minhash_similarity", f"""SELECT src, dst, {r6("len(list_filter(list_zip(a, b), lambda z: z[1] = z[2])) / 10")} AS similarity
      FROM (SELECT src, dst, {_minhash('src', 10)} AS a, {_minhash('dst', 10)} AS b FROM edges)""", "edges")
    # C
    add("c_features_a", f"SELECT url, {feature_list()} FROM features_a", "features_a")
    add("c_features_b", f"SELECT url, {feature_list()} FROM features_b", "features_b")
    checksum = " + ".join(f"{i + 1} * CAST({n} AS DOUBLE)" for i, n in enumerate(C.FEATURES))
    add("c25_vector", f"SELECT url, CAST(25 AS BIGINT) AS n, {r6(checksum)} AS checksum FROM features_a", "features_a")
    add("c26_pattern_signals", f"""SELECT url, normalized_url, matched_keywords, match_count, {r6('pattern_score')} AS pattern_score,
      {flag('has_ip_address')} AS has_ip_address, {r6('digit_ratio')} AS digit_ratio, CAST(dot_count AS BIGINT) AS dot_count,
      CAST(hyphen_count AS BIGINT) AS hyphen_count, {r6('special_char_ratio')} AS special_char_ratio FROM signals""", "signals")
    add("c27_feature_flags", _flags_long(), "features_b")
    # D
    add("d1_occurrences", f"""SELECT url, keyword, CAST(i - 1 AS BIGINT) AS position FROM (SELECT url, keyword,
        unnest(range(1, length(url) + 1)) AS i FROM corpus, (SELECT unnest([{quoted(C.LURE_KEYWORDS)}]) AS keyword))
      WHERE substr(lower(url), i, length(keyword)) = keyword""", "corpus")
    add("d3_matched_keywords", "SELECT url, match_count, matched_keywords FROM signals", "signals")
    words = [w for group in C.CATEGORY_KEYWORDS.values() for w in group]
    occurrences = " + ".join(
        f"(length(url) - length(replace(lower(url), '{w}', ''))) // {len(w)}" for w in words
    )
    add("d4_categorized_scan", "SELECT url, " + r6(category_score("lower(url)")) + " AS category_score, " + ", ".join(
        f"{hits('lower(url)', group)} AS {n}" for n, group in C.CATEGORY_KEYWORDS.items()
    ) + f", {hits('lower(url)', words)} AS keywords, CAST({occurrences} AS BIGINT) AS occurrences FROM corpus", "corpus")
    out["d4_dictionary_scan"] = out["d4_categorized_scan"]
    add("d5_entropy_profile", f"""SELECT url, {r6('url_entropy')} AS url_entropy, {r6('host_entropy')} AS host_entropy,
      {r6('path_entropy')} AS path_entropy, {flag('entropy_suspicious')} AS entropy_suspicious FROM heuristics""", "heuristics")
    add("d6_heuristic", f"""SELECT url, {r6('category_score')} AS category_score, {r6('heuristic_score')} AS heuristic_score,
      {flag('heuristic_score > 0.35 OR category_score > 0.25')} AS is_suspicious FROM heuristics""", "heuristics")
    # E
    add("e1_exact_match", """SELECT event_id, domain, CASE WHEN domain IN (SELECT pattern FROM bad_hosts) THEN 'malicious' END AS kind
      FROM log_hosts""", "log_hosts", "bad_hosts")
    in_safe = f"len(list_filter({parents('domain')}, lambda p: list_contains(safe, p))) > 0"
    lists = "(SELECT list(pattern) AS safe FROM safe_hosts) s, (SELECT list(pattern) AS bad FROM bad_hosts) b"
    has_bad = "len(list_filter(bad, lambda p: starts_with(domain, p))) > 0"
    add("e2_parent_match", f"""SELECT url, domain, {flag(in_safe)} AS parent_match
      FROM hosts, (SELECT list(pattern) AS safe FROM safe_hosts) s""", "hosts", "safe_hosts")
    add("e3_prefix_match", f"""SELECT url, domain, {flag(listed_prefix('domain', C.MALICIOUS_DOMAINS + C.MALICIOUS_PREFIXES))} AS prefix_match
      FROM hosts""", "hosts")
    add("e4_domain_verdict", f"SELECT url, {VERDICT} AS verdict FROM hosts", "hosts")
    list_verdict = f"CASE WHEN list_contains(safe, domain) OR {in_safe} THEN 'safe' WHEN {has_bad} THEN 'malicious' ELSE 'unknown' END"
    add("e4_list_verdict", f"SELECT event_id, domain, {list_verdict} AS verdict FROM log_hosts, {lists}",
        "log_hosts", "safe_hosts", "bad_hosts")
    add("e5_sorted_entries", "SELECT pattern, kind FROM grown ORDER BY pattern", "grown")
    add("e6_insert_delete", "SELECT pattern, kind FROM grown WHERE pattern NOT IN (SELECT pattern FROM safe_hosts)", "grown", "safe_hosts")
    add("e7_list_sizes", "SELECT kind, count(*) AS entries FROM grown GROUP BY kind", "grown")
    add("e9_blacklist", f"SELECT event_id, url, {flag('url IN (SELECT url FROM known_bad)')} AS in_blacklist FROM scan_log",
        "scan_log", "known_bad")
    add("e10_not_listed", """SELECT event_id, url FROM log_hosts l WHERE NOT EXISTS (SELECT 1 FROM
      (SELECT pattern FROM safe_hosts UNION SELECT pattern FROM bad_hosts) p WHERE starts_with(l.domain, p.pattern)
      OR (ends_with(l.domain, '.' || p.pattern) AND contains(p.pattern, '.')))""", "log_hosts", "safe_hosts", "bad_hosts")
    # F
    word_bits = "bit_or(CAST(1 AS BIGINT) << CAST(position % 63 AS INT))"
    add("f2_bloom_build", f"SELECT position // 63 AS word, {word_bits} AS bits FROM positions_all GROUP BY 1", "positions_all")
    add("f2_grown_filter", f"SELECT position // 63 AS word, {word_bits} AS bits FROM positions_all GROUP BY 1", "positions_all")
    add("f3_bloom_probe", f"SELECT url, {flag('in_filter')} AS in_filter FROM probed_big", "probed_big")
    add("f3_bloom_probe_shuffled", f"""SELECT s.event_id, {flag('in_filter')} AS in_filter FROM scan_log s
      JOIN probed_small p ON p.url = s.url""", "scan_log", "probed_small")
    add("f4_bloom_stats", f"""SELECT CAST({BIG.m} AS BIGINT) AS size_bits, {r6(str(BIG.m / 8 / 1024))} AS size_kb,
      CAST({BIG.k} AS BIGINT) AS hash_functions, n AS bits_set, {r6(f'n / {BIG.m}')} AS load_factor,
      {r6(f'pow(n / {BIG.m}, {BIG.k})')} AS estimated_fpr FROM (SELECT count(*) AS n FROM positions_all)""", "positions_all")
    add("f5_counting_filter", f"""SELECT t.position, CAST(t.c - coalesce(m.c, 0) AS BIGINT) AS count FROM
      (SELECT position, least(count(*), 255) AS c FROM ({_prefix_positions("(SELECT domain FROM hosts WHERE result = 1)", COUNTING)}) GROUP BY position) t
      LEFT JOIN (SELECT position, count(*) AS c FROM (SELECT domain, position,
          bool_and(position IN (SELECT position FROM ({_prefix_positions("(SELECT domain FROM hosts WHERE result = 1)", COUNTING)})))
            OVER (PARTITION BY domain) AS contained FROM ({_prefix_positions(
        "(SELECT DISTINCT domain FROM hosts WHERE page_id % 16 IN (0, 10))", COUNTING)})) WHERE contained GROUP BY position) m
      ON m.position = t.position WHERE t.c > coalesce(m.c, 0)""", "hosts")
    add("f5_counting_probe", f"""SELECT h.url, h.domain, {flag('hit')} AS in_filter FROM hosts h JOIN (
      SELECT domain, bool_and(position IN (SELECT position FROM ({_prefix_positions("(SELECT domain FROM hosts WHERE result = 1)", TINY)}))) AS hit
      FROM ({_prefix_positions("(SELECT DISTINCT domain FROM hosts)", TINY)}) GROUP BY domain) p ON p.domain = h.domain""", "hosts")
    add("f6_sliced_filter", _sliced_select(), "corpus")
    add("f6_grown_filter", "SELECT url, CAST(1 AS BIGINT) AS contained FROM corpus WHERE result = 1", "corpus")
    code = fingerprint("domain", FP_BUCKETS)
    add("f7_fingerprint_filter", f"""SELECT url, domain, {flag(f'''{code} IN (SELECT code FROM
      (SELECT {code} AS code, sum(CASE WHEN result = 1 THEN 1 ELSE 0 END) - sum(CASE WHEN page_id % 16 = 10 THEN 1 ELSE 0 END) AS n
       FROM hosts GROUP BY 1) WHERE n > 0)''')} AS in_filter FROM hosts""", "hosts")
    add("f8_vote", f"SELECT url, {r6('bloom_score')} AS bloom_score, bloom_result FROM voted", "voted")
    bad_pos = f"(SELECT list(p) FROM (SELECT unnest({double_hashed('pattern', K.COUNTING_SHAPE)}) AS p FROM bad_hosts WHERE NOT starts_with(pattern, 'secure-paypal')))"
    all_pos = f"(SELECT list(p) FROM (SELECT unnest({double_hashed('pattern', K.COUNTING_SHAPE)}) AS p FROM bad_hosts))"
    safe_pos = f"(SELECT list(p) FROM (SELECT unnest({double_hashed('pattern', K.ALLOW_SHAPE)}) AS p FROM safe_hosts))"
    bad_fps = f"(SELECT list({fingerprint('pattern', K.BUCKETS)}) FROM bad_hosts WHERE NOT starts_with(pattern, 'secure-paypal'))"
    add("f8_vote_data_lists", f"SELECT url, {r6('bloom_score')} AS bloom_score, bloom_result FROM ({vote_select('hosts', bad_pos, safe_pos, all_pos, bad_fps)})",
        "hosts", "bad_hosts", "safe_hosts")
    add("f9_grown_ensemble", f"SELECT url, {r6('bloom_score')} AS bloom_score, bloom_result FROM ({vote_select('hosts', bad_pos, safe_pos, all_pos, bad_fps)})",
        "hosts", "bad_hosts", "safe_hosts")
    add("f9_grown_stats", f"""SELECT (SELECT len({bad_fps})) AS blacklist_entries, round_even((SELECT len({bad_fps})) / {K.BUCKETS * 4}, 3) AS fingerprint_load,
      round_even((SELECT len(list_distinct({bad_pos}))) / {K.COUNTING_SHAPE.m}, 3) AS counting_load,
      round_even((SELECT len(list_distinct({safe_pos}))) / {K.ALLOW_SHAPE.m}, 3) AS allow_load, CAST(1 AS BIGINT) AS slices""",
        "bad_hosts", "safe_hosts")
    add("f9_ensemble_stats", f"""SELECT (SELECT count(*) FROM bad_hosts) AS blacklist_entries, (SELECT count(*) FROM safe_hosts) AS whitelist_entries,
      round_even((SELECT count(*) FROM bad_hosts) / {K.BUCKETS * 4}, 3) AS fingerprint_load,
      round_even((SELECT count(DISTINCT p) FROM (SELECT unnest({double_hashed('pattern', K.COUNTING_SHAPE)}) AS p FROM bad_hosts)) / {K.COUNTING_SHAPE.m}, 3) AS counting_load,
      CAST(1 AS BIGINT) AS slices, 0.5 AS threshold, {", ".join(f'{w} AS weight_{n}' for n, w in C.VOTE_WEIGHTS.items())}""",
        "bad_hosts", "safe_hosts")
    add("f10_trigram_similarity", f"SELECT s.event_id, {r6('similarity')} AS similarity FROM scan_log s JOIN alike m ON m.url = s.url",
        "scan_log", "alike")
    add("f10_trigram_sketch", f"SELECT url, {r6('similarity')} AS similarity FROM alike", "alike")
    add("f11_decayed_score", f"SELECT url, {r6('effective_score')} AS effective_score FROM aged", "aged")
    add("f12_expiry", "SELECT url FROM aged WHERE effective_score >= 0.1", "aged")
    add("f12_expired_count", """SELECT count(*) FILTER (WHERE effective_score < 0.1) AS removed,
      count(*) FILTER (WHERE effective_score >= 0.1) AS kept FROM aged""", "aged")
    add("f13_membership", f"""SELECT m.url, {flag('in_filter')} AS in_filter, {r6('similarity')} AS similarity,
      {flag('in_blacklist')} AS in_blacklist, {flag('possible')} AS possibly_malicious,
      {r6("coalesce(a.effective_score, 0)")} AS effective_score
      FROM member m LEFT JOIN aged a ON a.url = m.url AND contains(a.url, 'e')""", "member", "aged")
    add("f14_constraints", "SELECT url, CAST(met AS BIGINT) AS met FROM met", "met")
    add("f15_membership_verdict", """SELECT m.url, CASE WHEN NOT possible THEN 'unknown' WHEN met >= 3 THEN 'malicious'
      ELSE 'suspicious' END AS verdict FROM member m JOIN met c ON c.url = m.url""", "member", "met")
    # G
    add("g1_gate", f"""SELECT url, domain, list_result, {r6('bloom_score')} AS bloom_score, bloom_result,
      {r6('heuristic_score')} AS heuristic_score, decision, {flag('ml_skipped')} AS ml_skipped, reason FROM gated""", "gated")
    RELATIONS["data_lists"] = (["hosts", "safe_hosts", "bad_hosts"], f"SELECT * FROM hosts, {lists}")
    RELATIONS["data_voted"] = (["data_lists"], vote_select("data_lists", all_pos, safe_pos, all_pos, (
        f"(SELECT list({fingerprint('pattern', K.BUCKETS)}) FROM bad_hosts)")))
    RELATIONS["data_gated"] = (["data_voted"], gate_select(heuristic_select("data_voted"), list_verdict))
    add("g1_gate_data_lists", f"""SELECT s.event_id, g.list_result, g.decision, {r6('heuristic_score')} AS heuristic_score
      FROM scan_log s JOIN data_gated g ON g.url = s.url""", "scan_log", "data_gated")
    add("g2_gate_counters", """SELECT count(*) AS total_queries, count(*) FILTER (WHERE decision = 'BLOCK') AS blocked,
      count(*) FILTER (WHERE decision = 'PASS') AS passed, count(*) FILTER (WHERE decision = 'FORWARD') AS forwarded_to_ml,
      round_even(avg(CASE WHEN decision = 'FORWARD' THEN 0.0 ELSE 1.0 END), 3) AS ml_skip_rate
      FROM scan_log s JOIN gated g ON g.url = s.url""", "gated", "scan_log")
    add("g3_fast_path", f"""SELECT url, decision, label, {r6('confidence')} AS confidence, {r6('threat_probability')} AS threat_probability,
      CAST(risk_score AS BIGINT) AS risk_score, CAST(length(url) AS BIGINT) AS url_length, {flag(settled_feature('has_https'))} AS has_https,
      {r6(settled_feature('keyword_score'))} AS keyword_score, {r6(settled_feature('domain_age_proxy'))} AS domain_age_proxy,
      CAST(0 AS DOUBLE) AS url_entropy FROM fast""", "fast")
    # H
    add("h1_edges", f"""SELECT url AS src, CASE WHEN starts_with(location, 'http') THEN location ELSE {ORIGIN} || '/final?x=1' END AS dst
      FROM hop_log WHERE status_code IN (301, 302) AND location <> ''
      UNION SELECT url, {EMBEDDED} FROM corpus WHERE {EMBEDDED} IS NOT NULL
      UNION SELECT url, dst FROM (SELECT url, coalesce({soft(META)}, {soft(SCRIPT)}) AS dst
        FROM (SELECT url, html AS body FROM hop_pages)) WHERE dst IS NOT NULL""", "hop_log", "corpus", "hop_pages")
    add("h2_bfs_chain", "SELECT src, node, CAST(depth AS BIGINT) AS depth FROM pruned", "pruned")
    add("h3_dfs_chain", "SELECT src, count(*) AS chain_length FROM pruned GROUP BY src", "pruned")
    add("h4_redirect_depth", "SELECT url AS node, CAST(redirect_depth AS BIGINT) AS redirect_depth FROM depths", "depths")
    RELATIONS["layers"] = (["corpus", "edges", "cyclic"], """
      SELECT url AS node, 0 AS level FROM corpus WHERE url NOT IN (SELECT node FROM cyclic)
      UNION SELECT e.dst, l.level + 1 FROM layers l JOIN edges e ON e.src = l.node
      WHERE e.dst NOT IN (SELECT node FROM cyclic) AND l.level < 50""")
    RELATIONS["cyclic"] = (["reach_all"], """
      SELECT DISTINCT node FROM (SELECT src AS node FROM reach_all WHERE src = dst
      UNION SELECT dst FROM reach_all WHERE src IN (SELECT src FROM reach_all WHERE src = dst))""")
    add("h5_topological_levels", "SELECT node, CAST(max(level) AS BIGINT) AS level FROM layers GROUP BY node", "layers")
    add("h6_url_profile", f"""SELECT url, CAST(redirect_depth AS BIGINT) AS redirect_depth, CAST(chain_length AS BIGINT) AS chain_length,
      {r6('entropy')} AS entropy FROM profile""", "profile")
    add("h7_closure", "SELECT src, dst, CAST(dist AS BIGINT) AS dist FROM reach", "reach")
    RELATIONS["key_edges"] = (["edges", "corpus"], """
      SELECT src, dst FROM edges WHERE src IN (SELECT url FROM corpus WHERE page_id % 5 <> 1)
      AND dst IN (SELECT url FROM corpus WHERE page_id % 5 <> 1)""")
    RELATIONS["key_reach"] = (["key_edges"], """
      SELECT src, dst FROM key_edges UNION SELECT r.src, e.dst FROM key_reach r JOIN key_edges e ON e.src = r.dst""")
    add("h8_key_closure", "SELECT src, dst FROM key_reach WHERE src <> dst", "key_reach")
    add("h9_shortest_paths", """SELECT src, dst, CAST(dist AS BIGINT) AS dist FROM reach
      UNION ALL SELECT url, url, 0 FROM corpus""", "reach", "corpus")
    inherits = flag("url IN (SELECT node FROM nearest)")
    add("h10_threat_propagation", f"SELECT url AS node, {inherits} AS inherits_threat FROM corpus", "nearest", "corpus")
    add("h11_nearest_malicious", "SELECT node, closest_malicious, CAST(path_length AS BIGINT) AS path_length FROM nearest", "nearest")
    add("h12_threat_paths", f"""SELECT url AS node, closest_malicious, CAST(path_length AS BIGINT) AS path_length,
      {inherits} AS inherits_threat FROM corpus LEFT JOIN nearest ON node = url""", "nearest", "corpus")
    add("h13_graph_counters", """SELECT (SELECT count(*) FROM corpus) AS graph_nodes,
      (SELECT count(DISTINCT src) FROM edges) AS redirect_depths_tracked,
      (SELECT count(*) FROM bad_nodes) AS malicious_urls_registered""", "corpus", "edges", "bad_nodes")
    # I
    add("i1_follow", """SELECT start, CAST(hop AS BIGINT) AS hop, url, CAST(status_code AS BIGINT) AS status_code, redirect_type
      FROM walk""", "walk")
    add("i1_expand_a", f"""SELECT url, final_url, array_to_string(redirect_chain, '|') AS redirect_chain,
      CAST(redirect_count AS BIGINT) AS redirect_count, {flag('is_shortened')} AS is_shortened, error FROM expanded_a""", "expanded_a")
    add("i2_loops", f"""SELECT start AS url, {flag('loop_detected')} AS loop_detected, array_to_string(errors, '|') AS errors
      FROM walked""", "walked")
    add("i4_flagged_hops", f"""SELECT h.start, {flag('e.is_shortened')} AS is_shortened, e.shortener_domain, CAST(h.hop AS BIGINT) AS hop, h.url,
      CAST(h.status_code AS BIGINT) AS status_code, {flag('h.is_suspicious')} AS is_suspicious, h.redirect_type
      FROM hops h JOIN expanded e ON e.url = h.start""", "hops", "expanded")
    add("i5_chain_summary", f"""SELECT url, expanded_url, CAST(redirect_count AS BIGINT) AS redirect_count,
      {flag('excessive')} AS excessive_redirects, {flag('loop_detected')} AS loop_detected, {flag('is_shortened')} AS is_shortened
      FROM expanded""", "expanded")
    crossed = f"{host('url', 'charstrip')} <> '' AND {host('expanded_url', 'charstrip')} <> '' AND {host('url', 'charstrip')} <> {host('expanded_url', 'charstrip')}"
    add("i7_chain_risk", f"""SELECT url, CAST(suspicious_hops AS BIGINT) AS suspicious_hops, {r6('max_hop_risk')} AS max_hop_risk,
      CAST(unique_domains AS BIGINT) AS unique_domains_in_chain, {flag(crossed)} AS cross_domain_redirect,
      CAST(redirect_count AS BIGINT) AS redirect_depth, CAST(chain_length AS BIGINT) AS chain_length FROM expanded""", "expanded")
    add("i8_expansion_reuse", """SELECT s.event_id, s.url, e.expanded_url, CAST(e.redirect_count AS BIGINT) AS redirect_count
      FROM scan_log s JOIN expanded e ON e.url = s.url""", "scan_log", "expanded")
    RELATIONS["plain_targets"] = (["targets"], f"""
      SELECT *, {probability()} AS p, {allow('A')} AS allowed FROM ({feature_select(
        'A', 'SELECT url, 0 AS redirect_depth, 0 AS chain_length FROM targets')})""")
    add("i8_remembered", f"""SELECT e.url, e.expanded_url, CAST(e.redirect_count AS BIGINT) AS redirect_count, {flag('e.is_shortened')} AS is_shortened,
      {flag('e.url NOT IN (SELECT url FROM corpus WHERE page_id % 3 = 0)')} AS followed_late FROM expanded e""", "expanded", "corpus")
    add("i9_blend", f"""SELECT url, final_url, {r6('o')} AS original_prob, {r6('d')} AS expanded_prob, {r6('b')} AS threat_probability,
      CASE WHEN b < 0.25 THEN 'safe' WHEN b > 0.60 THEN 'malicious' WHEN b > 0.40 THEN 'suspicious' ELSE 'uncertain' END AS verdict
      FROM (SELECT *, 0.35 * o + 0.65 * d AS b FROM (SELECT x.url, x.final_url,
        CASE WHEN f.allowed THEN 0.01 ELSE f.p END AS o, CASE WHEN g.allowed THEN 0.01 ELSE g.p END AS d
        FROM expanded_a x JOIN plain_targets f ON f.url = x.url JOIN plain_targets g ON g.url = x.final_url
        WHERE x.is_shortened AND x.url <> x.final_url))""", "expanded_a", "plain_targets")
    add("i10_expansion_stats", """SELECT count(*) AS cached_urls, CAST(sum(length(
      concat('{"url":"', url, '","final_url":"', final_url, '","redirect_count":', redirect_count, '}'))) AS BIGINT) AS cache_size_bytes
      FROM expanded_a""", "expanded_a")
    # J
    add("j1_normalize", "SELECT url, " + ", ".join(
        f"{r6(f'least(CAST({n} AS DOUBLE) / {m}, 1.0)')} AS {n}" for n, m in zip(C.FEATURES, C.MAX_VALUES)
    ) + " FROM features_a", "features_a")
    add("j1_standardize", "SELECT url, " + ", ".join(
        r6(f"(CAST({n} AS DOUBLE) - avg(CAST({n} AS DOUBLE)) OVER ()) / CASE WHEN stddev_pop(CAST({n} AS DOUBLE)) OVER () = 0 "
           f"THEN 1 ELSE stddev_pop(CAST({n} AS DOUBLE)) OVER () END") + f" AS {n}" for n in C.FEATURES
    ) + " FROM features_a", "features_a")
    add("j2_fallback", f"SELECT url, {r6('p')} AS threat_probability FROM scored_a", "scored_a")
    add("j3_verdict_a", f"""SELECT url, {r6('threat_probability')} AS threat_probability, verdict, CASE verdict WHEN 'safe' THEN 'early_exit'
      WHEN 'uncertain' THEN 'send_to_bloom_filter' ELSE 'flag_and_register' END AS action,
      CASE WHEN allowed THEN 'Whitelisted domain' END AS reason FROM classified_a""", "classified_a")
    add("j4_predict_b", f"""SELECT url, label, {r6('confidence')} AS confidence, {r6('threat_probability')} AS threat_probability
      FROM predicted_b""", "predicted_b")
    add("j8_split", """SELECT url, CAST(result AS BIGINT) AS result, CASE WHEN r <= floor(n * 0.70) THEN 'train'
      WHEN r <= floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM (SELECT url, result,
      row_number() OVER (PARTITION BY result ORDER BY md5('42:' || url), url) AS r, count(*) OVER (PARTITION BY result) AS n
      FROM corpus)""", "corpus")
    add("j9_report", _report(), "scored_a")
    add("j9_confusion", """SELECT CAST(result AS BIGINT) AS label, CAST(p > 0.5 AS BIGINT) AS predicted, count(*) AS count
      FROM scored_a GROUP BY ALL""", "scored_a")
    add("j10_auc", f"""SELECT {r6('(sum(CASE WHEN result = 1 THEN rk END) - np * (np + 1) / 2) / (np * (n - np))')} AS auc
      FROM (SELECT result, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk,
        count(*) OVER () AS n, sum(result) OVER () AS np FROM (SELECT result, {r6('p')} AS s FROM scored_a)) GROUP BY n, np""", "scored_a")
    RELATIONS["splits"] = (["corpus"], """SELECT url, result, CASE WHEN r <= floor(n * 0.70) THEN 'train'
      WHEN r <= floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM (SELECT url, result,
      row_number() OVER (PARTITION BY result ORDER BY md5('42:' || url), url) AS r, count(*) OVER (PARTITION BY result) AS n
      FROM corpus)""")
    yes = "CAST(1 AS BIGINT)"
    add("j5_network", f"""SELECT count(*) FILTER (WHERE result = 0) AS benign, count(*) FILTER (WHERE result = 1) AS malicious,
      {yes} AS auc_reached, {yes} AS accuracy_reached, {yes} AS false_positives_low FROM splits WHERE split = 'test'""", "splits")
    add("j6_early_stop", f"""SELECT CAST(result AS DOUBLE) AS label, count(*) AS rows, {yes} AS ended_by_rule,
      {yes} AS within_limit FROM splits WHERE split = 'val' GROUP BY result""", "splits")
    add("j7_inference", f"SELECT url, CAST(result AS DOUBLE) AS label, {yes} AS in_range, {yes} AS agreement_reached FROM corpus", "corpus")
    RELATIONS["training"] = (["profile", "corpus"], feature_select(
        "A", "SELECT p.*, c.result FROM profile p JOIN corpus c ON c.url = p.url", "result,"))
    add("j11_training_table", f"SELECT url, CAST(result AS BIGINT) AS result, {feature_list()} FROM training", "training")
    anomaly = f"abs({entropy('analyzed_url')} - (SELECT baseline FROM baseline)) > 1.5"
    add("j12_scan_a", f"""SELECT url, analyzed_url, {flag('is_shortened')} AS is_shortened, CAST(redirect_count AS BIGINT) AS redirect_count,
      {r6('prob')} AS threat_probability, verdict, {flag('path_length IS NOT NULL')} AS inherits_threat,
      CAST(path_length AS BIGINT) AS path_length, member AS membership_verdict, {r6(RANK_A)} AS threat_rank,
      {flag(anomaly)} AS is_anomaly, {r6('final_probability')} AS final_probability, final_verdict, final_confidence
      FROM a_final""", "a_final", "baseline")
    add("j13_recommendation", f"""SELECT url, final_verdict, {_recommendation()} AS recommendation,
      CASE WHEN is_shortened AND NOT allowed THEN concat('URL shortener detected (', redirect_count,
        ' redirects). Extra caution advised.') END AS warning FROM a_final""", "a_final")
    points = ", ".join(f"CAST({p} AS BIGINT) AS {p}" for p in ("ml_points", "redirect_points", "heuristic_points", "risk_score"))
    add("j14_risk_score", f"SELECT url, {points}, risk_level FROM scanned", "scanned")
    add("j15_enrichment", f"""SELECT g.url, {r6('greatest(f.keyword_score, g.heuristic_score)')} AS keyword_score
      FROM gated g JOIN features_b f ON f.url = g.url WHERE decision = 'FORWARD'""", "gated", "features_b")
    add("j16_scan_b", f"""SELECT url, expanded_url, {flag('is_shortened')} AS is_shortened, shortener_domain,
      CAST(redirect_count AS BIGINT) AS redirect_count, {flag('loop_detected')} AS loop_detected,
      {flag('excessive_redirects')} AS excessive_redirects, CAST(suspicious_hops AS BIGINT) AS suspicious_hops, decision,
      {feature_list()}, label, {r6('confidence')} AS confidence, {r6('threat_probability')} AS threat_probability, {points},
      risk_level, array_to_string(errors, '|') AS errors FROM scanned""", "scanned")
    add("j16_records", f"""SELECT url AS original_url, expanded_url, label, CAST(risk_score AS BIGINT) AS score, risk_level AS level,
      CAST(url_length AS BIGINT) AS url_length, CAST(redirect_count + 1 AS BIGINT) AS hops,
      CASE WHEN decision <> 'FORWARD' THEN 'stage1_pre_filter' END AS source FROM scanned""", "scanned")
    add("j17_rule_score", f"""SELECT s.url, {r6('''least(1.0, CASE WHEN s.url IN (SELECT node FROM bad_nodes) THEN 0.5 ELSE 0.0 END
      + CASE WHEN redirect_depth > 3 THEN 0.3 * 0.8 ELSE 0.0 END + CASE WHEN pattern_score > 0.5 THEN 0.2 * 0.6 ELSE 0.0 END)''')} AS rule_score
      FROM signals s JOIN depths d ON d.url = s.url""", "signals", "depths", "bad_nodes")
    add("j18_neutral_defaults", f"""SELECT c.url, {r6("coalesce(p.url_entropy, 0)")} AS url_entropy,
      coalesce(p.label, 'Unknown') AS label, {r6('coalesce(p.confidence, 0)')} AS confidence,
      {r6('coalesce(p.threat_probability, 0)')} AS threat_probability,
      CAST(CASE WHEN length(c.url) % 3 <> 0 THEN e.redirect_count ELSE 0 END AS BIGINT) AS redirect_count,
      array_to_string(list_filter([CASE WHEN length(c.url) % 3 = 0 THEN 'expansion missing' END,
        CASE WHEN p.url IS NULL THEN 'features missing' END, CASE WHEN p.url IS NULL THEN 'prediction missing' END],
        lambda x: x IS NOT NULL), '|') AS errors
      FROM corpus c JOIN expanded e ON e.url = c.url
      LEFT JOIN (SELECT * FROM predicted_b WHERE page_id % 4 <> 1) p ON p.url = c.url""", "corpus", "expanded", "predicted_b")
    add("j16_rejected", """SELECT * FROM (SELECT CASE page_id % 7 WHEN 1 THEN url || '<script>' WHEN 2 THEN ''
        WHEN 3 THEN 'http:///path' ELSE url || repeat('a', 2100) END AS url, CAST(0 AS BIGINT) AS valid,
      CASE page_id % 7 WHEN 1 THEN 'URL failed structural regex check' WHEN 3 THEN 'URL has no host/netloc'
        ELSE 'URL length outside 4 to 2048' END AS reason, CAST(1 AS BIGINT) AS unscored
      FROM corpus WHERE page_id % 7 IN (1, 2, 3, 4))""", "corpus")
    # K
    add("k1_threat_rank", f"SELECT url, {r6(RANK_A)} AS threat_rank FROM profile_scored", "profile_scored")
    add("j18_live_defaults", f"""SELECT g.url, CASE WHEN length(g.url) % 3 = 0 THEN g.url ELSE e.expanded_url END AS expanded_url,
      CAST(CASE WHEN length(g.url) % 3 = 0 THEN 0 ELSE e.redirect_count END AS BIGINT) AS redirect_count,
      {flag("length(g.url) % 3 <> 0 AND e.is_shortened")} AS is_shortened, {flag("length(g.url) % 3 = 0")} AS noted, {yes} AS scored, {yes} AS labelled
      FROM gated g JOIN expanded e ON e.url = g.url WHERE g.decision = 'FORWARD'""", "gated", "expanded")
    add("k1_weighted_rank", f"SELECT url, {r6('0.6 * prob + 0.05 * (entropy / 5.0) + 0.35 * least(redirect_depth / 10.0, 1.0)')} AS threat_rank FROM profile_scored",
        "profile_scored")
    add("k2_ranking", f"""SELECT url, {r6('0.45 * 0.5 + 0.25 * (url_entropy / 5.0) + 0.10 * keyword_score')} AS threat_rank
      FROM features_a""", "features_a")
    add("k3_top_k", f"SELECT url, {r6('r')} AS threat_rank FROM (SELECT url, {RANK_A} AS r FROM profile_scored) ORDER BY r DESC, url LIMIT 10",
        "profile_scored")
    add("k3_top_per_batch", f"""SELECT batch_id, url, place FROM (SELECT 'b' || (c.page_id // 50) AS batch_id, c.url,
      CASE WHEN (c.page_id // 50) % 2 = 0 THEN 5 ELSE 10 END AS k,
      row_number() OVER (PARTITION BY c.page_id // 50 ORDER BY r DESC, c.url) AS place
      FROM corpus c JOIN (SELECT url, {RANK_A} AS r FROM profile_scored) s ON s.url = c.url) WHERE place <= k""",
        "profile_scored", "corpus")
    add("k4_budget", """SELECT batch, url, CAST(used > 50.5 AS BIGINT) AS partial FROM (
      SELECT *, sum(cost) OVER (PARTITION BY batch ORDER BY v / cost DESC, md5(url), url ROWS UNBOUNDED PRECEDING) AS used
      FROM (SELECT page_id % 4 AS batch, url, round(p, 4) * round(url_entropy, 4) AS v, CAST(1 + page_id % 3 AS DOUBLE) AS cost
        FROM scored_a)) WHERE used - cost < 50.5""", "scored_a")
    add("k5_code_baseline", f"SELECT {r6('baseline')} AS baseline FROM baseline", "baseline")
    anomalies = f"""SELECT url, {entropy('url')} AS e, (SELECT baseline FROM baseline) AS b FROM"""
    add("k6_entropy_anomaly", f"""SELECT url, {r6('e')} AS url_entropy, {r6('b')} AS baseline_entropy, {r6('abs(e - b)')} AS deviation,
      {flag('abs(e - b) > 1.5')} AS is_anomaly FROM ({anomalies} corpus)""", "corpus", "baseline")
    add("k7_rank_records", f"""SELECT url, {r6('0.45 * p + 0.25 * (e / 5.0)')} AS threat_rank, {r6('e')} AS url_entropy,
      {r6('b')} AS baseline_entropy, {r6('abs(e - b)')} AS deviation, {flag('abs(e - b) > 1.5')} AS is_anomaly
      FROM (SELECT url, p, url_entropy AS e, (SELECT baseline FROM baseline) AS b FROM scored_a)""", "scored_a", "baseline")
    # L
    whole = "CAST(result AS BIGINT) AS result, CAST(source AS BIGINT) AS source, CAST(line AS BIGINT) AS line"
    add("l1_union", f"SELECT url, label, {whole} FROM merged", "merged")
    add("l2_balanced_sample", """SELECT url, CAST(result AS BIGINT) AS result FROM (SELECT url, result,
      row_number() OVER (PARTITION BY result ORDER BY md5('42:' || url), url) AS r FROM corpus) WHERE r <= 30""", "corpus")
    add("l3_keep_first", f"""SELECT url, label, {whole} FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source, line) AS r
      FROM merged) WHERE r = 1""", "merged")
    add("l4_shuffle", "SELECT url, CAST(result AS BIGINT) AS result FROM corpus ORDER BY md5('42:' || url)", "corpus")
    add("l5_sample", """SELECT url, CAST(result AS BIGINT) AS result FROM corpus WHERE result = 1
      ORDER BY md5('42:' || url), url LIMIT 10""", "corpus")
    add("l6_class_stats", f"""SELECT n AS total_urls, b AS benign_count, m AS malicious_count, concat(b, '/', m) AS balance_ratio,
      {r6('100.0 * b / n')} AS benign_pct, {r6('100.0 * m / n')} AS malicious_pct FROM (SELECT count(*) AS n,
      count(*) FILTER (WHERE result = 0) AS b, count(*) FILTER (WHERE result = 1) AS m FROM corpus)""", "corpus")
    add("l7_intersect", "SELECT dst AS url FROM edges INTERSECT SELECT url FROM corpus WHERE result = 1", "edges", "corpus")
    add("l8_distinct", "SELECT count(DISTINCT domain) AS domains FROM log_hosts", "log_hosts")
    out["l9_distribution"] = f"""SELECT event_type, {r6('avg(value)')} AS avg_value, {r6('stddev_pop(value)')} AS std_value,
      {r6('min(value)')} AS min_value, {r6('max(value)')} AS max_value, count(value) AS samples, {r6('median(value)')} AS median_value,
      {r6('quantile_cont(value, 0.95)')} AS p95_value, {r6('quantile_cont(value, 0.99)')} AS p99_value,
      CAST(CASE WHEN avg(value) <= 0 THEN 100 ELSE greatest(0, least(100, floor(10000.0 / avg(value)))) END AS BIGINT) AS efficiency,
      {r6('CASE WHEN avg(value) > 0 THEN 1000.0 / avg(value) ELSE 0.0 END')} AS throughput
      FROM events WHERE value IS NOT NULL GROUP BY event_type"""
    add("l10_head", "SELECT page_id, url, CAST(result AS BIGINT) AS result FROM corpus ORDER BY page_id LIMIT 100", "corpus")
    add("l11_verdict_accuracy", f"SELECT url, {flag('(threat_probability > 0.5) = (result = 1)')} AS correct FROM classified_a", "classified_a")
    # M
    add("m1_stream_scan", f"SELECT url, label, {r6('threat_probability')} AS threat_probability FROM predicted_b", "predicted_b")
    add("m2_stream_counters", "SELECT decision, count(*) AS urls FROM gated GROUP BY decision", "gated")
    add("m3_first_seen", "SELECT DISTINCT url FROM scan_log", "scan_log")
    add("m3_late_rows", """SELECT concat(url, '#', page_id) AS url, half FROM (
      SELECT url, page_id, CAST(0 AS BIGINT) AS half FROM corpus WHERE page_id % 2 = 0
      UNION ALL SELECT url, page_id, CAST(1 AS BIGINT) FROM corpus WHERE page_id % 2 = 1 OR (page_id % 224000000) * 60 + 3630
        <= (SELECT max(page_id % 224000000) FROM corpus WHERE page_id % 2 = 0) * 60 - 3630)""", "corpus")
    add("m4_learned_blacklist", """SELECT c.url, CAST(1 AS DOUBLE) AS score FROM corpus c
      JOIN met m ON m.url = c.url JOIN alike a ON a.url = c.url
      WHERE m.met >= 3 AND (c.url IN (SELECT url FROM known_bad) OR a.similarity > 0.92)""", "corpus", "met", "alike", "known_bad")
    for half, test in (("first", "starts_with"), ("second", "NOT starts_with")):
        RELATIONS[f"{half}_bad"] = (["bad_hosts"], f"SELECT pattern FROM bad_hosts WHERE {test}(pattern, 'secure-paypal')")
        own = all_pos.replace("bad_hosts", f"{half}_bad")
        RELATIONS[f"{half}_lists"] = (["hosts", "safe_hosts", f"{half}_bad"], f"SELECT * FROM hosts, {lists.replace('bad_hosts', f'{half}_bad')}")
        RELATIONS[f"{half}_voted"] = ([f"{half}_lists"], vote_select(f"{half}_lists", own, safe_pos, own, (
            f"(SELECT list({fingerprint('pattern', K.BUCKETS)}) FROM {half}_bad)")))
        RELATIONS[f"{half}_gated"] = ([f"{half}_voted"], gate_select(heuristic_select(f"{half}_voted"), list_verdict))
    add("m2_changing_lists", """SELECT url, list_result, decision, count(*) OVER (PARTITION BY decision) AS decision_total FROM (
      SELECT * FROM first_gated WHERE page_id % 2 = 0 UNION ALL SELECT * FROM second_gated WHERE page_id % 2 = 1)""", "first_gated", "second_gated")
    add("m4_keyed_state", """
      SELECT event_id, url, half, CASE WHEN NOT possible THEN 'unknown' WHEN met >= 3 THEN 'malicious' ELSE 'suspicious' END AS membership_verdict
      FROM (SELECT l.event_id, l.url, (l.event_id // 100) % 2 AS half, m.met,
          CASE WHEN (l.event_id // 100) % 2 = 0 THEN l.url IN (SELECT url FROM known_bad) OR a.similarity > 0.92
            ELSE coalesce(v.verified, FALSE) END AS possible
        FROM scan_log l JOIN met m ON m.url = l.url JOIN alike a ON a.url = l.url LEFT JOIN (
          SELECT DISTINCT l.url, TRUE AS verified FROM scan_log l JOIN met m ON m.url = l.url JOIN alike a ON a.url = l.url
          WHERE (l.event_id // 100) % 2 = 0 AND m.met >= 3 AND (l.url IN (SELECT url FROM known_bad) OR a.similarity > 0.92)) v ON v.url = l.url)""",
        "scan_log", "met", "alike", "known_bad")
    # throughput
    add("t_visit_features", f"SELECT url, {feature_list()} FROM ({feature_select('B', 'SELECT url, 0 AS redirect_depth, 1 AS chain_length FROM visits')})", "visits")
    add("t_visit_gate", "SELECT decision, reason, count(*) AS urls FROM visit_gated GROUP BY ALL", "visit_gated")
    return out
