"""Fixed values shared by all operators: word lists, thresholds, weights, schemas.

Everything here is plain data. Lists are small constants, so operators fold them into expressions as
literals; lists supplied by a user arrive as DataFrames instead (see ``operators.matching``).
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------------------------------
# Suffix lists
# --------------------------------------------------------------------------------------------------
SUSPICIOUS_TLDS = [
    "tk", "ml", "ga", "cf", "gq", "xyz", "top", "work", "click", "loan", "win", "racing", "date",
    "download", "stream", "gdn", "accountant", "trade",
]
HOP_TLDS = [
    "xyz", "top", "click", "tk", "ml", "gq", "cf", "ga", "work", "loan", "win", "racing", "date",
    "stream", "download", "accountant", "faith", "trade", "review",
]
HOP_RISK_TLDS = [
    "xyz", "top", "click", "tk", "ml", "gq", "cf", "ga", "work", "loan", "win", "racing", "date", "stream",
]
CONSTRAINT_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".xyz"]
TRUSTED_TLDS = ["com", "org", "net", "edu", "gov"]
SUSPICIOUS_PORTS = [8080, 8443, 9090, 3333, 4444, 5555, 7777, 8888, 9999]

# --------------------------------------------------------------------------------------------------
# Keyword dictionaries
# --------------------------------------------------------------------------------------------------
LURE_KEYWORDS = [
    "login", "verify", "secure", "update", "bank", "paypal", "apple", "amazon", "confirm", "account",
    "signin", "ebay", "password", "suspended", "locked", "urgent", "support", "billing", "invoice",
    "expire", "validate", "credential", "recovery", "reset", "authentication", "wallet", "crypto",
    "security", "alert", "click", "free", "prize", "winner", "download", "install", "offer", "discount",
    "limited", "claim", "reward", "gift",
]
ATTACK_KEYWORDS = [
    "phishing", "malware", "ransomware", "spyware", "trojan", "exploit", "hack", "hacked", "crack",
    "bypass", "payload", "shell", "cmd", "steal", "stealer", "keylog", "logger", "inject", "xss", "sqli",
]
KEYWORDS_BY_PROFILE = {"A": LURE_KEYWORDS + ATTACK_KEYWORDS, "B": LURE_KEYWORDS}

# The pattern dictionary lists "verify" twice; the score divides by all 18 entries.
PATTERN_KEYWORDS = [
    "login", "verify", "secure", "update", "bank", "paypal", "apple", "amazon", "confirm", "account",
    "signin", "ebay", "password", "suspended", "locked", "urgent", "click", "verify",
]

HOP_KEYWORDS = [
    "login", "verify", "account", "secure", "banking", "update", "confirm", "paypal", "password", "suspended",
]

# "update" belongs to "download" only: the later listing wins over the one under "account".
CATEGORY_KEYWORDS = {
    "credential": [
        "login", "signin", "password", "passwd", "credential", "username", "userid", "auth", "authenticate",
    ],
    "account": [
        "account", "verify", "confirm", "validate", "suspended", "locked", "restore", "reactivate", "expire",
    ],
    "finance": [
        "paypal", "bank", "banking", "billing", "invoice", "payment", "transfer", "wallet", "crypto",
        "bitcoin", "refund", "claim", "reward", "prize", "winner",
    ],
    "brand": [
        "apple", "google", "microsoft", "amazon", "netflix", "ebay", "instagram", "facebook", "twitter",
        "linkedin", "wellsfargo", "chase", "citibank", "barclays",
    ],
    "urgency": [
        "urgent", "immediate", "alert", "warning", "attention", "action", "required", "important", "critical",
    ],
    "download": ["download", "install", "setup", "update", "upgrade", "exe", "apk", "dmg", "payload"],
}
CATEGORY_WEIGHTS = {
    "credential": 0.25, "account": 0.20, "finance": 0.25, "brand": 0.20, "urgency": 0.15, "download": 0.15,
}
SPOOFED_BRANDS = [
    "paypal", "apple", "google", "microsoft", "amazon", "facebook", "netflix", "instagram", "twitter",
    "ebay", "wellsfargo", "bankofamerica", "chase", "citibank",
]

# --------------------------------------------------------------------------------------------------
# Domain lists
# --------------------------------------------------------------------------------------------------
SAFE_DOMAINS = [
    "google.com", "youtube.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com",
    "reddit.com", "github.com", "wikipedia.org", "amazon.com", "apple.com", "microsoft.com", "netflix.com",
    "spotify.com", "stackoverflow.com", "mozilla.org", "cloudflare.com", "dropbox.com", "adobe.com",
    "salesforce.com", "oracle.com", "ibm.com", "zoom.us", "slack.com", "notion.so", "twitch.tv",
    "discord.com", "telegram.org", "whatsapp.com", "bbc.com", "cnn.com", "reuters.com", "theguardian.com",
    "nytimes.com", "washingtonpost.com", "forbes.com", "medium.com", "mit.edu", "stanford.edu",
    "harvard.edu", "nasa.gov", "nih.gov", "python.org", "nodejs.org", "rust-lang.org", "golang.org",
    "docker.com", "kubernetes.io", "pytorch.org", "tensorflow.org", "paypal.com", "ebay.com", "visa.com",
    "mastercard.com",
]
MALICIOUS_DOMAINS = [
    "paypa1.com", "paypa1-secure.xyz", "paypa1-login.xyz", "g00gle.com", "g00gle-secure.xyz", "g0ogle.com",
    "micros0ft.com", "micros0ft-account.xyz", "microsoft-support.top", "app1e.com", "app1e-id.xyz",
    "apple-id-verify.click", "amaz0n.com", "arnazon.com", "amazon-security.xyz", "secure-paypal.xyz",
    "paypal-secure-login.xyz", "paypal-verify.top", "secure-banking-update.xyz", "bank-secure-login.top",
    "account-verify-login.xyz", "login-verify-account.click", "free-prize-winner.top", "claim-reward-now.xyz",
    "crypto-wallet-recovery.tk", "bitcoin-recovery.xyz", "malware-download.top", "exploit-kit.xyz",
    "ransomware-unlock.click", "trojan-install.xyz", "virus-payload.top",
]
MALICIOUS_PREFIXES = [
    "secure-paypal.", "paypal-secure.", "login-verify.", "account-suspended.", "secure-banking.",
    "free-prize.", "crypto-wallet.", "bitcoin-recovery.", "malware-download.", "exploit-kit.",
]
ALLOW_LIST_A = [
    "google.com", "www.google.com", "google.co.in", "bing.com", "www.bing.com", "yahoo.com",
    "www.yahoo.com", "duckduckgo.com", "www.duckduckgo.com", "facebook.com", "www.facebook.com",
    "twitter.com", "www.twitter.com", "x.com", "www.x.com", "instagram.com", "www.instagram.com",
    "linkedin.com", "www.linkedin.com", "reddit.com", "www.reddit.com", "youtube.com", "www.youtube.com",
    "whatsapp.com", "www.whatsapp.com", "telegram.org", "www.telegram.org", "github.com", "www.github.com",
    "stackoverflow.com", "www.stackoverflow.com", "microsoft.com", "www.microsoft.com", "apple.com",
    "www.apple.com", "amazon.com", "www.amazon.com", "aws.amazon.com", "azure.microsoft.com",
    "cloud.google.com", "developer.apple.com", "docs.microsoft.com", "learn.microsoft.com",
    "developer.mozilla.org", "mozilla.org", "www.mozilla.org", "paypal.com", "www.paypal.com", "ebay.com",
    "www.ebay.com", "walmart.com", "www.walmart.com", "target.com", "www.target.com", "bestbuy.com",
    "www.bestbuy.com", "etsy.com", "www.etsy.com", "netflix.com", "www.netflix.com", "spotify.com",
    "www.spotify.com", "twitch.tv", "www.twitch.tv", "imdb.com", "www.imdb.com", "nytimes.com",
    "www.nytimes.com", "bbc.com", "www.bbc.com", "bbc.co.uk", "www.bbc.co.uk", "cnn.com", "www.cnn.com",
    "reuters.com", "www.reuters.com", "wikipedia.org", "www.wikipedia.org", "en.wikipedia.org", "mit.edu",
    "www.mit.edu", "stanford.edu", "www.stanford.edu", "harvard.edu", "www.harvard.edu", "nasa.gov",
    "www.nasa.gov", "nih.gov", "www.nih.gov", "cdc.gov", "www.cdc.gov", "whitehouse.gov",
    "www.whitehouse.gov", "zoom.us", "www.zoom.us", "slack.com", "www.slack.com", "notion.so",
    "www.notion.so", "dropbox.com", "www.dropbox.com", "drive.google.com", "docs.google.com",
    "mail.google.com", "salesforce.com", "www.salesforce.com", "oracle.com", "www.oracle.com", "ibm.com",
    "www.ibm.com", "adobe.com", "www.adobe.com",
]
ALLOW_LIST_B = [
    "google.com", "www.google.com", "bing.com", "yahoo.com", "duckduckgo.com", "facebook.com",
    "twitter.com", "x.com", "instagram.com", "linkedin.com", "reddit.com", "youtube.com", "github.com",
    "stackoverflow.com", "microsoft.com", "apple.com", "amazon.com", "paypal.com", "ebay.com",
    "wikipedia.org", "mozilla.org", "netflix.com", "spotify.com", "twitch.tv", "bbc.com", "cnn.com",
    "reuters.com", "mit.edu", "stanford.edu", "nasa.gov", "zoom.us", "slack.com", "notion.so",
    "dropbox.com", "adobe.com", "oracle.com", "ibm.com", "salesforce.com",
]
ALLOW_LISTS = {"A": ALLOW_LIST_A, "B": ALLOW_LIST_B}

SHORTENERS_A = [
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "adf.ly", "bit.do", "lnkd.in",
    "db.tt", "qr.ae", "cur.lv", "ity.im", "q.gs", "po.st", "bc.vc", "u.to", "j.mp", "buzurl.com",
    "cutt.us", "u.bb", "yourls.org", "prettylinkpro.com", "scrnch.me", "filoops.info", "vurl.com",
    "vzturl.com", "2.gp", "tweez.me", "v.gd", "tr.im", "link.zip", "short.link",
]
SHORTENERS_B = [
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "adf.ly", "bit.do", "lnkd.in",
    "db.tt", "qr.ae", "cur.lv", "ity.im", "q.gs", "po.st", "bc.vc", "u.to", "j.mp", "buzurl.com",
    "cutt.us", "u.bb", "yourls.org", "prettylinkpro.com", "scrnch.me", "v.gd", "tr.im", "short.link",
    "rb.gy", "shorturl.at", "tiny.cc", "rebrand.ly", "snipurl.com", "clck.ru", "durl.me", "gg.gg", "s.id",
    "shorte.st", "linktr.ee", "mcaf.ee", "soo.gd", "chilp.it",
]
OPEN_REDIRECT_PARAMS = [
    "url", "redirect", "redirect_url", "redirect_uri", "redirecturl", "return", "return_url", "returnurl",
    "returnto", "return_to", "next", "next_url", "goto", "go", "target", "destination", "dest", "to",
    "redir", "redir_url", "link", "forward", "location", "checkout_url", "continue", "continue_url", "data",
    "ref", "page", "uri", "back", "path", "request", "site", "jump", "out", "view", "from_url", "callback",
    "u", "r",
]

# --------------------------------------------------------------------------------------------------
# Feature vector (order, weights, scale) and score constants
# --------------------------------------------------------------------------------------------------
FEATURES = [
    "url_length", "domain_length", "subdomain_depth", "path_depth", "query_length", "num_query_params",
    "dot_count", "hyphen_count", "digit_ratio", "uppercase_ratio", "special_char_ratio", "url_entropy",
    "domain_entropy", "has_https", "tld_suspicious", "has_ip", "has_at_symbol", "double_slash_path",
    "has_suspicious_port", "redirect_depth", "keyword_score", "brand_in_subdomain", "has_homograph",
    "domain_age_proxy", "chain_length",
]
BOOLEAN_FEATURES = [
    "has_https", "tld_suspicious", "has_ip", "has_at_symbol", "double_slash_path", "has_suspicious_port",
    "brand_in_subdomain", "has_homograph",
]
WEIGHTS = [
    0.010, 0.008, 0.040, 0.010, 0.008, 0.005, 0.012, 0.025, 0.050, 0.015, 0.040, 0.030, 0.020, -0.080,
    0.120, 0.150, 0.080, 0.040, 0.060, 0.030, 0.160, 0.180, 0.200, -0.040, 0.010,
]
MAX_VALUES = [500, 100, 5, 20, 300, 15, 20, 15, 1, 1, 1, 5, 5, 1, 1, 1, 1, 1, 1, 10, 1, 1, 1, 1, 10]

THRESHOLDS = {"fallback": (0.30, 0.65), "deep": (0.25, 0.55), "B": (0.25, 0.60)}
RANK_WEIGHTS = {"probability": 0.45, "entropy": 0.25, "redirect_depth": 0.20, "keyword_score": 0.10}
VOTE_WEIGHTS = {"fingerprint": 0.50, "counting": 0.25, "sliced": 0.25}
DECAY_PER_SECOND = 1e-4
MAX_HOPS = {"A": 10, "B": 15}

# --------------------------------------------------------------------------------------------------
# Schemas (explicit everywhere; nothing is inferred)
# --------------------------------------------------------------------------------------------------
LABELED_URLS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("result", T.IntegerType()),
])
SCAN_REQUESTS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("follow_redirects", T.BooleanType()),
    T.StructField("timeout", T.IntegerType()),
])
BATCH_REQUESTS = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("urls", T.ArrayType(T.StringType())),
    T.StructField("top_k", T.IntegerType()),
])
HOP_LOG = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("location", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("body", T.StringType()),
])
PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
