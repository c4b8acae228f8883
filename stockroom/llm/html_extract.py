"""Operator 8: main text of web pages by tree scoring.

The page becomes a light tree.  Elements that are never article text (scripts, styles, form
controls, navigation, headers, footers, asides, and containers whose class, id or role names an
advert, menu, notice, sidebar, comment list and so on) are left out.  So are forms, unless one
holds an article or main element or most of the page's long unlinked text.  Every text block passes points
to all its ancestors: one, plus one per comma, plus one per 100 characters up to three, times the
share of its text that is no link; the parent takes them whole, every further ancestor half of the one
below.  A container's score is discounted by
its link density and raised for article-like tags and names.  The best container is kept,
grown to the article or main element around it, with those siblings that score or read alike.

Names are read one by one, each as its words: ``post-comments`` is a comment list whatever comes first.  A
likely word saves an element only as a whole name or as the last word of one.  Names can be wrong: if
what is kept has no paragraph that reads like an article's, the page is read again without the names
(but for those of reader comments), and the second reading stands if it has one, or if the first is empty.

Blocks are the runs of text between block-level tags; character references are decoded, white
space inside a block becomes one space, and blocks are joined in page order by a blank line.

Defined results: null, empty or textless html gives the empty text with 0 characters; a page
without markup is one block; unclosed and stray tags are tolerated, a tag without end is text; equal
rows each get a row; ties between containers go to the first in page order; extra columns are
ignored.  Very long pages are parsed whole, in time linear in their length however their tags nest.

A left-out element without its end tag ends where HTML lets it: a head at the first body tag or
text, an li, dt, dd, td, th, tr or p at the next one, any other when an element around it ends.
If it held an article or main element, or runs to the end of a page without long text before
it, it was closed nowhere: then it is read again as a plain container.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import only, read

# Fixed tag sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SKIPPED = frozenset(
    "script style noscript template iframe object svg canvas button select option textarea input nav footer "
    "aside head title menu dialog video audio".split()
)
RAW = frozenset("script style textarea title noscript iframe template".split())
# Names of containers that hold no article text, matched as whole words of class, id and role.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination pager "
    "popup promo promoted promotion related remark reply replies respond share sharing shoutbox sidebar social sponsor "
    "sponsored subscribe toolbar widget complementary contentinfo dialog search alert".split()
)
LIKELY = frozenset("article articlebody body content entry main maincontent page post story text".split())
HOLDERS = frozenset("article main".split())
REMARKS = frozenset("comment comments reply remark".split())
LONG_BLOCK = 80  # characters of a block that reads like a paragraph of an article
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
# Elements that may lack an end tag: the start tags that end them, and the elements through which they do not reach.
_ROWS = frozenset("tbody tfoot thead tr".split())
_LISTS, _TABLE = BLOCK - {"address", "div", "p"}, frozenset(["table"])
_HOLD_ITEMS = frozenset("dl menu ol table ul".split())
ENDED_BY = {
    "li": (frozenset(["li"]), _LISTS),
    "dt": (frozenset(["dt", "dd"]), _LISTS),
    "dd": (frozenset(["dt", "dd"]), _LISTS),
    "td": (_ROWS | {"td", "th"}, _TABLE),
    "th": (_ROWS | {"td", "th"}, _TABLE),
    "tr": (_ROWS, _TABLE),
    "p": (CLOSES_P, CLOSES_P),
}

TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
TAG_MARK = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_WORD = re.compile(r"[a-z]+")
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
SAVES = LIKELY - {"text", "body", "content"}  # words that speak against an unlikely one
PASSED_ON = 0.5  # share of a container's points that its parent takes


class _Node:
    __slots__ = (
        "tag", "parent", "order", "points", "given", "chars", "link_chars", "weight", "in_link", "form", "block", "held"
    )

    def __init__(self, tag, parent, order, weight, in_link):
        self.tag, self.parent, self.order, self.weight, self.in_link = tag, parent, order, weight, in_link
        self.form = (parent.form if parent else None) or (self if tag == "form" else None)  # outermost form
        self.block = self if parent is None or tag in BLOCK else parent.block  # the block-level element around
        self.held = tag in HOLDERS or (parent is not None and parent.held)  # in an article or main element
        self.points = self.given = 0.0
        self.chars = self.link_chars = 0


class _Open:
    """Elements open at one time, innermost last, with the places of each tag and of block-level tags."""

    def __init__(self):
        self.items: list[tuple[str, object]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def __len__(self):
        return len(self.items)

    def push(self, tag, item):
        place = len(self.items)
        self.items.append((tag, item))
        self.places.setdefault(tag, []).append(place)
        if tag in BLOCK:
            self.blocks.append(place)

    def cut(self, place):
        """Close everything from ``place`` on."""
        while len(self.items) > place:
            tag, _ = self.items.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tag) -> int:
        """Place of the innermost open ``tag``, -1 if there is none."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def block_from(self, place) -> bool:
        """A block-level element is open at ``place`` or inside it."""
        return bool(self.blocks) and self.blocks[-1] >= place

    def any_of(self, tags) -> bool:
        return any(self.places.get(t) for t in tags)


def _names(attributes: str) -> list[list[str]]:
    """The words of every class, id and role name; ``hidden`` for the attribute of that name."""
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "hidden":
            out.append(["hidden"])
        else:
            out += [words for words in map(NAME_WORD.findall, value.lower().split()) if words]
    return out


def _unlikely(names: list[list[str]], listed: frozenset) -> bool:
    """Some name has a listed word, and no name is or ends in a word that speaks for the article."""
    return any(listed.intersection(words) for words in names) and not any(words[-1] in SAVES for words in names)


class _Tags:
    """Comments and tags of a page in order, each found in time linear in what it passes."""

    def __init__(self, page: str):
        self.page = page
        self.last_end = page.rfind(">")  # no tag ends after it
        self.quotes = {'"': True, "'": True}  # a quote of this kind may still be closed

    def _end(self, at: int) -> int:
        """Place after the ``>`` of the tag whose name ends at ``at``; one inside a quoted value does not count."""
        page, from_ = self.page, at
        while True:
            m = TAG_MARK.search(page, at)
            if m is None:  # the quoted values run to the end of the page: from here on quotes are plain
                self.quotes = dict.fromkeys(self.quotes, False)
                return page.find(">", from_) + 1
            at = m.end()
            mark = m[0]
            if mark == ">":
                return at
            before = m.start() - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and self.quotes[mark]:
                close = page.find(mark, at)
                if close < 0:
                    self.quotes[mark] = False
                else:
                    at = close + 1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, tag, closing, attributes) from ``at`` on; a comment or declaration has no tag."""
        page, size = self.page, len(self.page)
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else size, "", False, ""
            if start > self.last_end:
                at = start + 1
                continue
            if page.startswith(("<!", "<?"), start):
                return start, page.find(">", start) + 1, "", False, ""
            m = TAG_NAME.match(page, start)
            if m is None:
                at = start + 1
                continue
            end = self._end(m.end())
            return start, end, m[2].lower(), bool(m[1]), page[m.end() : end - 1]


def _parse(page: str, listed: frozenset = UNLIKELY) -> tuple[list[_Node], list[tuple[_Node, str, int, int]]]:
    """Nodes in page order and blocks (holding node, text, linked and plain characters).

    ``listed`` are the name words of containers to leave out.
    """
    root = _Node("#root", None, 0, 0.0, False)
    nodes, blocks = [root], []
    stack = _Open()
    stack.push("#root", root)
    parts: list[str] = []
    linked = plain = 0
    long_seen = False  # a block that reads like a paragraph came by

    def inmost() -> _Node:
        return stack.items[-1][1]

    def flush():
        nonlocal parts, linked, plain, long_seen
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((inmost().block, text, linked, plain))
                long_seen = long_seen or (len(text) > LONG_BLOCK and plain > 0)
        parts, linked, plain = [], 0, 0

    def add(piece: str):
        nonlocal linked, plain
        if piece:
            parts.append(piece)
            if inmost().in_link:
                linked += len(piece.strip())
            else:
                plain += len(piece.strip())

    # the left-out element, where its start tag is, the elements open in it, and whether it held an article
    skip_tag, skip_at, inner, held = "", 0, _Open(), False
    unclosed: set[int] = set()  # start tags of left-out elements that nothing ends

    def ends_skip(tag: str) -> bool:
        """The start tag ends the left-out element, or the element that holds it."""
        for owner, between in ((skip_tag, ""), (stack.items[-1][0], skip_tag)):
            ends, bounds = ENDED_BY.get(owner, ((), frozenset()))
            if tag in ends and between not in bounds and not inner.any_of(bounds):
                return True
        return False

    def ends_around(tag: str) -> bool:
        """The end tag closes an element around the left-out element."""
        depth = stack.last(tag)
        if depth < 1 or tag in ("body", "html"):  # the page's end is seen to when it comes
            return False
        if tag in ENDED_BY:
            bounds = {"li": _HOLD_ITEMS, "dt": _HOLD_ITEMS, "dd": _HOLD_ITEMS}.get(tag, ENDED_BY[tag][1])
            return skip_tag not in bounds and not inner.any_of(bounds)
        return tag in BLOCK or not (skip_tag in BLOCK or inner.blocks or stack.block_from(depth))

    def read_again() -> int:
        nonlocal skip_tag
        unclosed.update([skip_at, *[start for _, start in inner.items]])
        skip_tag = ""
        return skip_at

    tags = _Tags(page)
    at, size = 0, len(page)

    def after_raw(tag: str, at: int) -> int:
        end = RAW_END[tag].search(page, at, tags.last_end + 1)
        return end.end() if end else size

    while True:
        found = tags.next(at)
        text_end = found[0] if found else size
        if skip_tag == "head" and page[at:text_end].strip():
            skip_tag = ""
        if not skip_tag:
            add(page[at:text_end])
        if found is None:
            if skip_tag and skip_tag != "head" and (held or not long_seen):
                at = read_again()
                continue
            break
        start, at, tag, closing, attributes = found
        if not tag:
            continue
        if skip_tag:  # inside a left-out element: what ends it counts
            if closing:
                depth = inner.last(tag)
                if depth >= 0:
                    if tag in BLOCK or not inner.block_from(depth):
                        inner.cut(depth)
                    continue
                if tag == skip_tag:
                    skip_tag = ""
                    continue
                if not ends_around(tag):
                    continue
                if held:
                    at = read_again()
                    continue
            elif tag in RAW:
                at = after_raw(tag, at)
                continue
            elif tag in HEAD_TAGS if skip_tag == "head" else not ends_skip(tag):
                if tag not in VOID and not attributes.endswith("/") and skip_tag != "head":
                    if tag in ENDED_BY and inner.items and inner.items[-1][0] == tag:
                        inner.cut(len(inner) - 1)
                    inner.push(tag, start)
                    held = held or (tag in HOLDERS and not _unlikely(_names(attributes), REMARKS))
                continue
            skip_tag = ""
        if closing:
            if tag in BLOCK:
                flush()
            depth = stack.last(tag)
            if depth > 0 and (tag in BLOCK or not stack.block_from(depth)):
                stack.cut(depth)
            continue
        if tag in ("br", "hr"):
            add(" ") if tag == "br" else flush()
            continue
        names = _names(attributes) if attributes else []
        left_out = tag in SKIPPED or (tag == "header" and not inmost().held) or any("hidden" in words for words in names)
        if not left_out and names and tag not in ("html", "body", "p", "h1") and tag not in HOLDERS | {"a", "b", "i"}:
            left_out = _unlikely(names, listed)
        if not left_out and tag == "article" and names:
            left_out = _unlikely(names, REMARKS) or any(words[-1] in REMARKS for words in names)
        if not left_out and tag in ("label", "legend") and inmost().form is not None:
            left_out = True
        if left_out and start not in unclosed:
            if tag in BLOCK:
                flush()
            if tag in RAW:
                at = after_raw(tag, at)
            elif tag not in VOID and not attributes.endswith("/"):
                skip_tag, skip_at, inner, held = tag, start, _Open(), False
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:  # an open paragraph ends where a new block begins
                depth = stack.last("p")
                if depth > 0:
                    stack.cut(depth)
            if tag in ("li", "dt", "dd", "tr", "td", "th") and stack.items[-1][0] == tag:
                stack.cut(len(stack) - 1)
        likely = any(LIKELY.intersection(words) for words in names)
        weight = 25.0 * (tag in HOLDERS) + 10.0 * likely - 10.0 * (tag in ("ul", "ol", "th"))
        node = _Node(tag, inmost(), len(nodes), weight, inmost().in_link or tag == "a")
        nodes.append(node)
        if not attributes.endswith("/"):
            stack.push(tag, node)
    flush()
    return nodes, _outside_forms(nodes, blocks)


def _outside_forms(nodes: list[_Node], blocks: list[tuple[_Node, str, int, int]]) -> list[tuple[_Node, str, int, int]]:
    """The blocks without those of forms, but with those of a form that holds the article."""
    holding = {n.form for n in nodes if n.form and n.tag in HOLDERS}
    long: dict[_Node | None, float] = {}
    for holder, text, linked, plain in blocks:
        if len(text) > LONG_BLOCK:
            long[holder.form] = long.get(holder.form, 0.0) + len(text) * plain / max(1, linked + plain)
    most = sum(long.values()) / 2
    return [b for b in blocks if b[0].form is None or b[0].form in holding or long.get(b[0].form, 0.0) > most]


def _kept_blocks(nodes: list[_Node], blocks: list[tuple[_Node, str, int, int]]) -> list[tuple[_Node, str, int, int]]:
    """The blocks of the best container and of its siblings that score or read alike."""
    if not blocks:
        return []
    for holder, text, linked, plain in blocks:
        share = len(text) * linked // max(1, linked + plain)
        taker = holder if holder.tag != "p" or holder.parent is None else holder.parent
        taker.given += (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - share / len(text))
        holder.chars += len(text)
        holder.link_chars += share
    for n in reversed(nodes):  # children come after their parents: each hands on what it holds
        n.points += n.given
        if n.parent is not None:
            n.parent.points += PASSED_ON * n.points
            n.parent.chars += n.chars
            n.parent.link_chars += n.link_chars

    def density(n):
        return n.link_chars / n.chars if n.chars else 0.0

    def score(n):
        return (n.points + n.weight) * (1 - density(n))

    best = max((n for n in nodes if n.chars), key=lambda n: (score(n), -n.order))
    top = best
    node = best
    while node is not None:  # the outermost article around the best container
        if node.tag in HOLDERS:
            top = node
        node = node.parent
    chosen = {top.order}
    if top.parent is not None and top.tag not in HOLDERS:
        floor = max(10.0, 0.2 * score(top))
        for n in nodes:
            if n.parent is top.parent and n is not top:
                alike = n.points > 0 and score(n) >= floor
                reads = n.tag == "p" and n.chars > LONG_BLOCK and density(n) < 0.25
                heading = n.tag in ("h1", "h2") and n.order < top.order
                if alike or reads or heading:
                    chosen.add(n.order)
    kept = [False] * len(nodes)
    for n in nodes:
        kept[n.order] = n.order in chosen or (n.parent is not None and kept[n.parent.order])
    return [b for b in blocks if kept[b[0].order]]


def _reads_like_an_article(blocks: list[tuple[_Node, str, int, int]]) -> bool:
    return any(len(text) > LONG_BLOCK and plain > linked for _, text, linked, plain in blocks)


def main_text(page: str | None) -> str:
    """The article text of one page."""
    page = page or ""
    blocks = _kept_blocks(*_parse(page))
    if not _reads_like_an_article(blocks):
        second = _kept_blocks(*_parse(page, REMARKS))
        if not blocks or _reads_like_an_article(second):
            blocks = second
    return "\n\n".join(text for _, text, _, _ in blocks)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url and the main ``text``."""

    @F.pandas_udf("string")
    def article(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in htmls], dtype=object)

    return only(pages, "page_id", "url", "html").select("page_id", "url", article("html").alias("text"))


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`extract` over the whole pages table."""
    found = extract(read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
