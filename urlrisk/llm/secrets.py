"""Secret scans: fixed patterns, and names with literals from an assignment-aware lexer."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import light_batches, utf8

SPAN = "struct<kind:string,start:int,end:int,name:string,score:double>"
#: Kinds in the order that breaks ties; the last is what the lexer adds.
KINDS = ("assign", "access", "hex", "literal")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: A name and an operator. The name may be quoted (JSON), a chain (a.b.c, a["b"]) or a flag (--api-key=...).
#: Comparisons (==, <=, !=) are not assignments. Possessive: a failing start is never tried in another way.
HEAD = re.compile(
    r"""(?<![\w.])(?<![\w.]-)(?P<name>[A-Za-z_][\w.\-]*+(?:\[["'][\w.\-]++["']\])*+)["'`]?+[ \t]*+"""
    r"""(?P<op>\??:(?![:/=])|:=|=>|[+.]?=(?![=~>]))""")
#: What may be a type between ":" and "=": no single colon, so that texts between two heads are looked at once.
ANNOTATION = re.compile(r"""[ \t]*+(?P<type>(?:[^:=;\n"`{}()]|::)*+)=(?![=~>])""")
TYPE_WORDS = re.compile(
    r"""[&*]{0,2}(?:'[a-z_]\w*[ \t]+)?(?:(?:mut|const)[ \t]+)?[A-Za-z_][\w.:]*+\??(?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.:]*+\??)*+""")
#: The start of a quoted literal with its prefix (b"...", r#"..."#, $"..."); three quotes may hold line feeds.
QUOTE = re.compile(r"""(?:[A-Za-z]{1,2}\#{0,3}|u8|[$@]{1,2})?+(?P<quote>\"\"\"|'''|["'`])""")
_INSIDE = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+") for q in "\"'`"}
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
#: The end of a line, before a value that stands alone on the next, in a list or not.
LINE_VALUE = re.compile(r"""[ \t]*+\r?+\n[ \t]*+(?:-[ \t]++)?+""")
_REST_OF_LINE = re.compile(r"""[ \t]*+[,;]?+[ \t\r]*+(?:\n|\Z)""")
_BLANK = re.compile(r"[ \t]*+")
_OPENING = re.compile(r"[(\[]\s*+")
#: Between literals: a comma; a joining operator, with names between; a line that goes on; space.
_JOINT = re.compile(r"""(?P<next>\s*+,\s*+)|\s*+[+.&]\s*+(?:[A-Za-z_][\w.]*+\s*+[+&]\s*+)*+|[ \t]*+\\\r?\n[ \t]*+|\s++""")
#: Name parts that make a target sensitive, with their weight; fixed values.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.5, "authorization": 0.7,
    "private": 0.5, "access": 0.4, "api": 0.4, "key": 0.3, "salt": 0.5, "signature": 0.5, "signing": 0.5, "jwt": 0.8,
}
#: What a key has to be of to be a secret one, and what it weighs then; fixed values.
KEYS = frozenset(
    "access account aes api app auth aws client consumer crypt crypto deploy encryption hmac jwt master private rsa secret service session shared "
    "signing ssh storage".split())
KEY_WEIGHT = 0.6
#: Last parts of names that say the value is about a secret, not one; fixed values.
HEADS = frozenset(
    "column count description dir error expires expiry field file filename form format header help hint index input label length list message name "
    "names page param parameter path pattern placeholder policy prompt regex size timeout title ttl type uri url".split())
#: Literals that stand for no secret; fixed values.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "undefined"}
#: Literals that only refer to values elsewhere: ${NAME}, $(command), %(name)s, %NAME%, {{name}}, {name}, <placeholder>,
#: also several in a row, and $NAME.
REFERENCE = re.compile(
    r"""\$[A-Za-z_]\w*|(?:(?:\$\{[^{}]*\}|\$\([^()]*\)|%\([^()]*\)[a-z]|%\w+%|[$\#]?\{\{[^{}]*\}\}|<%[^%]*%>|\{[\w.]*\}|<[^<>]*>)[:/@.\- ]*)+""")
#: Bare values that name something: no digits, parts joined by underscores or dots.
NAMED = re.compile(r"[A-Za-z]++(?:[._]+[A-Za-z]*+)++|_[A-Za-z_.]*+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NAME = re.compile(r"[A-Za-z_][\w.]*\Z")
MIN_SCORE = 1.0


def name_weight(name: str) -> float:
    """How sensitive a target's name is: the weights of its parts, split at case and punctuation."""
    parts = list(dict.fromkeys(p.lower() for p in _PARTS.findall(name)))
    if not parts or parts[-1] in HEADS:
        return 0.0
    weight = sum(SENSITIVE.get(p, 0.0) for p in parts)
    return weight + (KEY_WEIGHT - SENSITIVE["key"] if "key" in parts and KEYS & set(parts) else 0.0)


def literal_weight(value: str, spaces: bool = False) -> float:
    """How much a literal looks like a secret, 0 to 1: entropy per character by length, mixed classes.
    One that holds white space counts only if ``spaces`` says so."""
    if len(value) < 8 or value.lower() in PLACEHOLDERS or REFERENCE.fullmatch(value) or not spaces and any(c.isspace() for c in value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = any(c.isdigit() for c in value) + any(c.isupper() for c in value) + any(c.islower() for c in value)
    mixed = 1.0 if classes >= 2 else 0.5
    return mixed * min(1.0, entropy / 3.0) * min(1.0, len(value) / 12)


class Pair(NamedTuple):
    """Names that are given something: groups of literals, each in one or more parts, or a bare value."""

    names: list[str]
    groups: list[list[tuple[int, int]]]
    bare: str | None = None


class Lexer:
    """Reads the pairs of one text in order, in time linear in its length: it moves on after every value, and what
    could not be read once (an unclosed quote) is not tried again."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.unclosed: dict[str, int] = {}  # up to where no literal of a quote closes

    def string(self, at: int) -> tuple[int, int, int] | None:
        """The literal that starts here: start and end of what it quotes, and where it ends."""
        m = QUOTE.match(self.text, at)
        if not m or m.start("quote") < self.unclosed.get(m["quote"], 0):
            return None
        quote, start = m["quote"], m.end()
        if len(quote) == 3:
            end = self.text.find(quote, start)
            if end < 0:
                self.unclosed[quote] = len(self.text)
                return None
            return start, end, end + 3
        end = _INSIDE[quote].match(self.text, start).end()
        if self.text[end:end + 1] != quote:
            self.unclosed[quote] = end
            return None
        return start, end, end + 1

    def annotated(self, at: int) -> tuple[str, int] | None:
        """A type and "=" after a colon: the type, and where the value may start."""
        m = ANNOTATION.match(self.text, at)
        if not m or not m["type"]:
            return None
        if not m["type"][-1].isspace() and (m.end() == len(self.text) or self.text[m.end()].isspace()):
            return None  # padding of a bare value
        words, depth = [], 0
        for piece in re.split(r"([\[\]<>])", m["type"]):
            if piece in ("[", "<"):
                depth += 1
            elif piece in ("]", ">"):
                depth -= 1
            elif not depth:
                words.append(piece)
            if depth < 0:
                return None
        plain = "".join(words).strip()
        return (plain, m.end()) if not depth and TYPE_WORDS.fullmatch(plain) else None

    def strings(self, at: int) -> tuple[list[list[tuple[int, int]]], int] | None:
        """Literals from here on: in brackets, in parts that are joined, or one. Commas within brackets separate groups."""
        inside = False
        while m := _OPENING.match(self.text, at):
            inside, at = True, m.end()
        if (first := self.string(at)) is None:
            return None
        groups, end = [[first[:2]]], first[2]
        while m := _JOINT.match(self.text, end):
            if not inside and (m["next"] is not None or "\n" in m[0] and not m[0].strip()):
                break
            if (more := self.string(m.end())) is None:
                break
            if m["next"] is not None:
                groups.append([])
            groups[-1].append(more[:2])
            end = more[2]
        return groups, end

    def pairs(self) -> Iterator[Pair]:
        text, at = self.text, 0
        while m := HEAD.search(text, at):
            names, value = [m["name"]], m.end()
            # "label: name = ..." reads like an annotation, so the type may be the name
            if m["op"][-1] == ":" and (typed := self.annotated(value)):
                names, value = [m["name"], typed[0]], typed[1]
            at = value = _BLANK.match(text, value).end()
            line = LINE_VALUE.match(text, value)
            if line:
                value = line.end()
            if found := self.strings(value):
                if not line or _REST_OF_LINE.match(text, found[1]):
                    at = found[1]
                    yield Pair(names, found[0])
                continue
            inner = HEAD.match(text, value)
            # a bare value that starts a pair itself is looked at up to that pair's value only
            bare = BARE.match(text, value, inner.end() + 1) if inner else BARE.match(text, value)
            if not bare or line and not _REST_OF_LINE.match(text, bare.end()):
                continue
            if inner and inner.end() == bare.end() and inner["op"][-1] == "=" and not text[inner.end():inner.end() + 1].strip():
                inner = None  # padding of a bare value
            if inner and (line or name_weight(inner["name"]) or not max(map(name_weight, names))):
                continue  # only a label before a pair
            at = value if inner else bare.end()
            end = value + len(bare[0].rstrip(".:!?"))
            yield Pair(names, [[(value, end)]], text[value:end])


def _led_to(pairs: list[Pair]) -> list[int | None]:
    """Per pair the one that holds what its names get: itself, or where the names that it is given lead, which are
    those given last before, or else first after. None in a ring. Each step is taken once."""
    places: dict[str, list[int]] = {}
    for i, pair in enumerate(pairs):
        for name in pair.names:
            places.setdefault(name, []).append(i)
    target: list[int | None] = []
    for i, pair in enumerate(pairs):
        given = places.get(pair.bare, []) if pair.bare is not None and _NAME.match(pair.bare) else []
        n = bisect_left(given, i)
        later = [g for g in given[n:n + 2] if g != i][:1]
        target.append(given[n - 1] if n else later[0] if later else None)
    led: dict[int, int | None] = {}
    for i in range(len(pairs)):
        way, at = [], i
        while at not in led and target[at] is not None:
            led[at] = None  # until known: meeting it again is a ring
            way.append(at)
            at = target[at]
        end = led[at] if at in led else led.setdefault(at, at)
        led.update(dict.fromkeys(way, end))
    return [led[i] for i in range(len(pairs))]


def literals(text: str) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, name, score) of literals that sensitive names get in source or configuration text.

    A value is a quoted literal, several in brackets or joined to one, or a bare one, on the line of the name or
    alone on the next. Parts of a joined literal are judged as one and marked each. A bare value that starts a pair
    itself is read as that pair, unless only the name before it is sensitive. A name that is given another name
    takes the literal which that one held last, or else gets later, so a sensitive target marks the literal where
    it is written. Literals with white space count under names of full weight.
    """
    pairs = list(Lexer(text).pairs())
    found: dict[tuple[int, int], tuple[str, float]] = {}
    for pair, end in zip(pairs, _led_to(pairs), strict=True):
        if end is None or not (weight := max(map(name_weight, pair.names))):
            continue
        if pairs[end].bare is not None and NAMED.fullmatch(pairs[end].bare):
            continue
        for parts in pairs[end].groups:
            score = weight * literal_weight("".join(text[a:b] for a, b in parts), weight >= 1) * 2
            for where in parts:
                if score >= MIN_SCORE and where[0] < where[1] and score > found.get(where, ("", 0.0))[1]:
                    found[where] = (max(pair.names, key=name_weight), round(score, 6))
    return [(a, b, *v) for (a, b), v in sorted(found.items())]


def spans(text: str) -> list[tuple[str, int, int, str | None, float | None]]:
    """All spans of one text by (start, kind, end): (kind, start, end, name, score)."""
    out: list[tuple] = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [("assign", *m.span(), m[1], None) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), None, None) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span(), None, None) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        out += [("literal", *x) for x in literals(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """The documents with ``secret_spans``, an array of SPAN in order of start: base kinds and literals.

    Offsets count code points, ends are exclusive. Base spans (assign, access, hex) are the leftmost
    non-overlapping matches of each kind. ``literal`` spans are what the lexer adds: the literal that a
    sensitive name is given, directly or through another name, if the name's weight times the literal's
    reaches MIN_SCORE; they cover the literal only and may lie within a base span.

    One pass over each whole text without a shuffle, in time linear in its length. Null and empty texts have no
    spans; every input row gives one output row (doc_id, secret_spans), whatever it repeats, and an empty table
    none. Invalid UTF-8 is read as U+FFFD.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[] if t is None else [
                {"kind": k, "start": a, "end": b, "name": n, "score": s} for k, a, b, n, s in spans(t.decode())
            ] for t in batch["_text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "secret_spans": pd.Series(rows, dtype=object)})

    light_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), utf8("text").alias("_text")).mapInPandas(
        run, f"doc_id bigint, secret_spans array<{SPAN}>")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret in ``text`` replaced by ``mark``; all columns stay, n_chars follows.

    Overlapping spans are replaced as one. Null texts stay null.
    """
    light_batches(docs.sparkSession)
    out = F.pandas_udf(_redacted(mark), "string")(F.make_valid_utf8("text"))
    changed = docs.withColumn("text", out)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


def _redacted(mark: str):
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        parts, at, until = [], 0, -1
        for _, start, end, _, _ in spans(text):
            if start > until or until < 0:
                parts += [text[at:start], mark]
            until = at = max(until, end)
        return "".join([*parts, text[at:]])

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(None if not isinstance(t, str) else t) for t in texts], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return run


def _joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op1_secrets(spark, sf_dir):
    scanned = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = F.col("secret_spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(found, lambda s: s["kind"] != "literal")
    return scanned.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(found).alias("spans"), count("literal"))
