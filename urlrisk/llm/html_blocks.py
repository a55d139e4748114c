"""Main text of web pages: flat text blocks, classified by a decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.llm.common import light_batches, utf8

#: What starts at a "<": a comment, a declaration or a tag; the scanner finds its end.
_START = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*+))")
#: The rest of a tag. A quote opens a value only after "=", and only if another closes it; unquoted values may hold quotes.
_REST = re.compile(r"""(?P<attributes>(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)*+)>""")
#: Elements without text of the page.
RAW = frozenset("annotation annotation-xml iframe script select style template textarea title".split())
#: Tags that don't end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder "
    "munderover semantics".split())
#: Elements whose nesting is followed; others may stay open.
CONTAINERS = frozenset("article aside blockquote body button center dd details dialog div dl fieldset figure footer form header li main menu nav noscript ol section table td th tr ul".split())
#: Elements whose marks hold for their own blocks, up to the next element of a block.
LEAVES = frozenset("dt h1 h2 h3 h4 h5 h6 p".split())
#: Elements, roles and name parts of what surrounds an article; fixed values.
CHROME_TAGS = frozenset("aside button dialog fieldset footer form header menu nav".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CHROME_NAMES = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "overlay pagination pager popup promo promoted promotion reader related replies reply respond sharing share sidebar "
    "signup social sponsor sponsored subscribe toolbar widget".split())
#: Of these, the names of boxes that may hold articles of their own.
BOX_NAMES = frozenset("comment comments disqus promo promoted promotion related replies reply respond sponsor sponsored".split())
#: Names made from one of these and "header" are those of a heading.
HEADED = frozenset("article body content entry heading main page post section story text title".split())
#: Ids that tell of surroundings within an article too; others are made from headings there.
BOX_IDS = BOX_NAMES | {"ad", "ads", "newsletter", "sidebar", "toolbar"}
#: With one of these a name tells of a page's layout, as has-sidebar does.
QUALIFIERS = frozenset("closed disabled enabled has no open with without".split())
ARTICLE_TAGS = frozenset({"article", "main"})
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))?+)?+""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "chrome", "article", "paragraph")
#: The labelled table: blocks as (words, link density) of the block, the one before and the one after, whether they
#: stand in surrounding markup and in an article element, and whether a reader calls them main text.
TABLE = [
    # menus, headers, footers, forms, adverts and comments by their markup
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (2, 1.0, 1, 1.0, 8, 0.0, 1, 0, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0), (24, 0.0, 1, 1.0, 6, 0.0, 1, 0, 0), (60, 0.0, 30, 0.0, 12, 0.1, 1, 0, 0),
    (14, 0.0, 80, 0.0, 0, 0.0, 1, 0, 0), (7, 0.3, 40, 0.0, 0, 0.0, 1, 0, 0), (120, 0.0, 5, 0.0, 90, 0.0, 1, 0, 0),
    (35, 0.1, 90, 0.0, 20, 0.0, 1, 1, 0), (6, 0.5, 70, 0.0, 50, 0.0, 1, 1, 0), (90, 0.0, 60, 0.0, 3, 0.0, 1, 1, 0),
    (3, 0.0, 60, 0.0, 45, 0.0, 1, 1, 0), (18, 0.0, 0, 0.0, 55, 0.0, 1, 1, 0), (250, 0.0, 10, 0.0, 9, 0.0, 1, 0, 0),
    # headings and paragraphs of an article element, short ones too
    (8, 0.0, 8, 0.0, 60, 0.0, 0, 1, 1), (12, 0.0, 1, 1.0, 7, 0.0, 0, 1, 1), (1, 0.0, 80, 0.0, 40, 0.0, 0, 1, 1),
    (3, 0.0, 1, 0.0, 2, 0.0, 0, 1, 1), (45, 0.0, 12, 0.0, 70, 0.0, 0, 1, 1), (180, 0.0, 60, 0.0, 90, 0.0, 0, 1, 1),
    (64, 0.1, 33, 0.0, 12, 0.2, 0, 1, 1), (30, 0.3, 80, 0.0, 60, 0.0, 0, 1, 1), (6, 0.0, 44, 0.0, 10, 0.1, 0, 1, 1),
    (400, 0.0, 2, 0.0, 0, 0.0, 0, 1, 1), (25, 0.2, 70, 0.1, 60, 0.0, 0, 1, 1), (2, 0.0, 0, 0.0, 30, 0.0, 0, 1, 1),
    (9, 0.0, 9, 0.0, 9, 0.1, 0, 1, 1), (15, 0.0, 20, 0.0, 0, 0.0, 0, 1, 1), (5, 0.2, 90, 0.0, 85, 0.0, 0, 1, 1),
    # link lists within one, and single links among its text
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0), (5, 1.0, 40, 0.0, 4, 1.0, 0, 1, 0), (7, 0.9, 6, 0.9, 8, 0.9, 0, 1, 0),
    (3, 1.0, 4, 1.0, 0, 0.0, 0, 1, 0), (12, 1.0, 10, 1.0, 9, 1.0, 0, 1, 0), (4, 1.0, 70, 0.0, 0, 0.0, 0, 1, 0),
    (21, 1.0, 60, 0.0, 50, 0.0, 0, 1, 0), (9, 1.0, 33, 0.0, 12, 0.0, 0, 1, 0), (30, 1.0, 24, 0.0, 26, 0.1, 0, 1, 0),
    (6, 1.0, 80, 0.0, 35, 0.0, 0, 1, 0), (15, 1.0, 3, 0.0, 90, 0.0, 0, 1, 0), (75, 1.0, 40, 0.1, 7, 0.0, 0, 1, 0),
    # pages without such markup: long blocks with few links, and short ones among them
    (40, 0.0, 30, 0.0, 50, 0.0, 0, 0, 1), (80, 0.1, 5, 1.0, 70, 0.0, 0, 0, 1), (22, 0.0, 60, 0.0, 40, 0.0, 0, 0, 1),
    (150, 0.05, 3, 1.0, 4, 1.0, 0, 0, 1), (17, 0.0, 45, 0.0, 35, 0.0, 0, 0, 1), (9, 0.0, 55, 0.0, 60, 0.0, 0, 0, 1),
    (6, 0.0, 70, 0.0, 38, 0.0, 0, 0, 1), (30, 0.25, 40, 0.0, 30, 0.1, 0, 0, 1), (35, 0.0, 8, 0.0, 9, 0.0, 0, 0, 1),
    (55, 0.0, 2, 0.0, 3, 0.0, 0, 0, 1), (19, 0.0, 28, 0.0, 31, 0.0, 0, 0, 1), (12, 0.0, 40, 0.0, 44, 0.0, 0, 0, 1),
    (3, 0.0, 50, 0.0, 62, 0.0, 0, 0, 1), (90, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (10, 0.0, 1, 1.0, 75, 0.0, 0, 0, 1),
    # and menus, notices and adverts there
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (3, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0), (4, 0.8, 60, 0.0, 3, 1.0, 0, 0, 0),
    (6, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), (8, 0.5, 5, 0.6, 4, 0.9, 0, 0, 0), (2, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0),
    (5, 0.0, 1, 1.0, 2, 0.0, 0, 0, 0), (7, 0.0, 3, 0.0, 2, 1.0, 0, 0, 0), (25, 0.9, 30, 0.9, 20, 0.8, 0, 0, 0),
    (45, 0.7, 30, 0.8, 3, 1.0, 0, 0, 0), (3, 0.0, 4, 0.0, 2, 0.0, 0, 0, 0), (9, 0.0, 6, 0.5, 5, 0.4, 0, 0, 0),
    (12, 0.6, 50, 0.0, 40, 0.0, 0, 0, 0), (4, 0.0, 90, 0.0, 0, 0.0, 0, 0, 0), (8, 0.0, 75, 0.0, 0, 0.0, 0, 0, 0),
    (11, 0.1, 80, 0.0, 2, 1.0, 0, 0, 0), (1, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0), (60, 1.0, 1, 1.0, 50, 0.0, 0, 0, 0),
]
#: The same for blocks of p elements and others: only where a block of an article is all links does it matter, as that
#: is a paragraph of the text or a list of links.
LABELLED = [
    (*row[:-1], paragraph, 1 if paragraph and row[7] and not row[6] and row[1] >= 0.9 else row[-1])
    for row in TABLE for paragraph in (0, 1)]


class Block(NamedTuple):
    text: str
    words: int
    links: float
    chrome: bool
    article: bool
    paragraph: bool = False
    listed: bool = False  # in a list item
    form: int = 0  # the number of the outermost form, from 1


#: Marks: by a name, by the name of a box, by tag, role or hiding.
NAMED, BOXED, FIXED = 1, 2, 4
#: A form with so many words in blocks of PROSE words or more, or with an article, is a page within a form.
PAGE_WORDS, PROSE = 100, 15


def _marks(tag: str, attributes: str, article: bool) -> int:
    """Whether an element's tag, role or names say that it surrounds an article, as a sum of marks.

    Ids tell less than classes: never those of headings and paragraphs, and within an article only BOX_IDS.
    """
    marks = FIXED if tag in CHROME_TAGS and tag != "form" else 0
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in CHROME_ROLES:
            marks |= FIXED
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            marks |= FIXED
        if name == "id" and (tag in LEAVES or article and value.strip().lower() not in BOX_IDS):
            continue
        if name in ("class", "id") and tag != "body":
            for one in value.split():
                parts = {p.lower() for p in _NAME_PARTS.findall(one)}
                if tag == "form":
                    parts -= {"form"}  # aspnetForm, form1
                if parts & HEADED or tag[0] == "h" and tag[1:].isdigit():
                    parts -= {"header"}  # a heading is called so itself
                if not parts & QUALIFIERS and (found := parts & CHROME_NAMES):
                    marks |= BOXED if found & BOX_NAMES else NAMED
    return marks


class Markup(NamedTuple):
    """A piece of markup: where it starts and ends, and of a tag the name, attributes and whether it closes."""

    start: int
    end: int
    tag: str = ""
    attributes: str = ""
    close: bool = False


def markup(page: str) -> Iterator[Markup]:
    """Comments, declarations, tags and raw elements in order; in time linear in the page.

    What never ends (a comment, a raw element) reaches to the end of the page. A tag whose quotes leave it
    without an end ends at the next ">", as do all tags after it; a "<" with no ">" after it is text.
    """
    at, blind, last = 0, False, page.rfind(">")
    while m := _START.search(page, at):
        if m["comment"]:
            ends = [e for e in (page.find("-->", m.end()), page.find("--!>", m.end())) if e >= 0]
            end = page.index(">", min(ends)) + 1 if ends else len(page)
            yield Markup(m.start(), end)
        elif m.start() > last:
            return
        elif m["other"]:
            end = page.index(">", m.start()) + 1
            yield Markup(m.start(), end)
        else:
            rest = None if blind else _REST.match(page, m.end())
            blind = rest is None
            end = rest.end() if rest else page.index(">", m.start()) + 1
            tag = m["tag"].lower()
            if tag in RAW:
                closing = None if m["close"] else _closing(tag).search(page, end)
                yield Markup(m.start(), end if m["close"] else closing.end() if closing else len(page), tag)
                end = end if m["close"] else closing.end() if closing else len(page)
            else:
                yield Markup(m.start(), end, tag, rest["attributes"] if rest else page[m.end():end - 1], bool(m["close"]))
        at = end


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?![\w:-])[^>]*+>?", re.IGNORECASE)


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in order; empty ones are left out.

    A block ends at any tag that isn't inline. Its link density is the share of its words within links.
    Comments and elements like scripts and styles have no text; an unclosed one reaches to the end. Marks are
    inherited; but main forgets those by a name from around it, and so does an article that is not within
    another, except those of boxes that hold articles of their own. A form marks its blocks unless it holds an
    article or as much prose as one.
    """
    found: list[Block] = []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, marks, within an article
    solid = [0]  # the places of elements other than div in it
    leaf = ("", 0)  # the open element of LEAVES, its marks
    opened: dict[str, int] = {}
    pieces: list[str] = []
    linked: list[str] = []
    in_link = 0
    forms = form = 0  # how many there are; the open one, 0 if it is within an article
    at = 0

    def flush() -> None:
        text = html.unescape("".join(pieces))
        words = text.split()
        if words:
            in_links = len(html.unescape(" ".join(linked)).split())
            _, marks, article = stack[-1]
            told = opened.get("noscript") and "javascript" in text.lower()  # a notice
            found.append(Block(
                " ".join(words), len(words), min(1.0, in_links / len(words)), bool(marks or leaf[1] or told), article, leaf[0] == "p",
                bool(opened.get("li")), form if opened.get("form") else 0))
        pieces.clear()
        linked.clear()

    def add(text: str) -> None:
        pieces.append(text)
        if in_link:
            linked.append(text)

    def drop(depth: int) -> None:
        for top, _, _ in stack[depth:]:
            opened[top] -= 1
        del stack[depth:]
        while solid[-1] >= depth:
            solid.pop()

    for m in markup(page):
        if m.start > at:
            add(page[at:m.start])
        at = m.end
        if not m.tag or m.tag in RAW:
            if m.tag:
                flush()
            continue
        tag = m.tag
        if tag == "a":
            in_link = 0 if m.close else 1
        if tag in INLINE:
            continue
        flush()
        in_link = 0
        if tag in CONTAINERS or tag in LEAVES and (tag == leaf[0] or not m.close):
            leaf = (tag, _marks(tag, m.attributes, stack[-1][2])) if tag in LEAVES and not m.close else ("", 0)
        if tag not in CONTAINERS:
            continue
        if not m.close:
            if not m.attributes.endswith("/"):
                if tag == "li" and opened.get(tag) and stack[solid[-1]][0] == "li":  # ends an open one
                    drop(solid[-1])
                _, marks, article = stack[-1]
                if tag in ARTICLE_TAGS:
                    if tag == "main" and not article:
                        marks &= FIXED
                    elif not opened.get("article"):
                        marks &= ~NAMED
                elif not (tag == "header" and article):  # an article's own header holds its heading
                    marks |= _marks(tag, m.attributes, article)
                if tag == "form" and not opened.get(tag):
                    forms += 1
                    form = 0 if article else forms
                    marks |= FIXED if article else 0
                if tag != "div":
                    solid.append(len(stack))
                stack.append((tag, marks, article or tag in ARTICLE_TAGS))
                opened[tag] = opened.get(tag, 0) + 1
        elif opened.get(tag):
            depth = len(stack) - 1
            while stack[depth][0] != tag:
                depth -= 1
            drop(depth)
    add(page[at:])
    flush()
    return _without_forms(found)


def _without_forms(found: list[Block]) -> list[Block]:
    """Blocks of forms get the mark of surroundings; a form around a page, or around an article, is none."""
    prose: dict[int, int] = {}
    for b in found:
        if b.form and not b.chrome:
            own = PAGE_WORDS if b.article else b.words if b.words >= PROSE and b.links < 0.5 else 0
            prose[b.form] = prose.get(b.form, 0) + own
    return [b._replace(chrome=True) if b.form and prose.get(b.form, 0) < PAGE_WORDS else b for b in found]


def rows(found: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of each block; a missing neighbour has no words and no links. An item of a list has the neighbours of
    the list, as items are short and next to each other."""
    none = Block("", 0, 0.0, False, False)
    before, after = [none] * len(found), [none] * len(found)
    for side, order in ((before, range(len(found))), (after, range(len(found) - 1, -1, -1))):
        last = outside = none
        for i in order:
            side[i] = outside if found[i].listed else last
            last = found[i]
            if not found[i].listed:
                outside = found[i]
    return [
        (b.words, b.links, p.words, p.links, n.words, n.links, float(b.chrome), float(b.article), float(b.paragraph))
        for p, b, n in zip(before, found, after, strict=True)]


def train(spark: SparkSession, labelled=LABELLED, depth: int = 8):
    """A decision tree over FEATURES, as nested (feature, threshold, left, right) with 0 or 1 as leaves."""
    data = spark.createDataFrame([(Vectors.dense([float(v) for v in r[:-1]]), float(r[-1])) for r in labelled], ["features", "label"])
    fitted = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=1).fit(data.coalesce(1))

    def read(node):
        if node.numDescendants() == 0:
            return int(node.prediction())
        split = node.split()
        return split.featureIndex(), split.threshold(), read(node.leftChild()), read(node.rightChild())

    return read(fitted._java_obj.rootNode())


def is_main(tree, row: tuple[float, ...]) -> bool:
    while not isinstance(tree, int):
        feature, threshold, left, right = tree
        tree = left if row[feature] <= threshold else right
    return tree == 1


def main_text(page: str, tree) -> str:
    found = blocks(page)
    return " ".join(b.text for b, row in zip(found, rows(found), strict=True) if is_main(tree, row))


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """(page_id, url, text): the main text of each page; empty if there is none, also for null pages.

    Flat text blocks are classified one by one from their word count and link density, those of their
    neighbours, and whether the markup around them is that of an article or of what surrounds it, by a
    decision tree trained on the table LABELLED. Blocks keep their order and are joined by one space;
    character references are decoded and white space within a block becomes one space. One pass, no
    shuffle; repeated rows give repeated results, an empty table none. A page takes time in proportion to its
    length, however broken its markup is. Invalid UTF-8 is read as U+FFFD.
    """
    tree = train(pages.sparkSession) if tree is None else tree

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = ["" if h is None else main_text(h.decode(), tree) for h in batch["_html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": pd.Series(text, dtype=object)})

    light_batches(pages.sparkSession)
    found = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("binary"), utf8("html").alias("_html")).mapInPandas(
        run, "page_id bigint, url binary, text string")
    return found.withColumn("url", F.col("url").cast("string"))


def op8_html(spark, sf_dir):
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
