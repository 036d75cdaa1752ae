"""Main text of web pages by tree scoring.

One pass of a tokenizer builds the element tree and its text blocks, mending what real pages get
wrong (unclosed elements, stray end tags, raw-text elements, missing semicolons). Each block's
points, for its length and commas, go to its parent and in falling shares to the elements above; an
element's points are discounted by its link density, and the best element is the container.
Siblings whose own points or prose come close are kept with it, and a container inside an article
or main element grows to the whole of it.

What is never article text is left out before: elements (menus, footers, sidebars, forms, headers
outside an article), roles, hidden elements, reader comments, and elements whose class or id names
such a part, unless they hold an article or main element, as a page's wrapper may. Names that
article parts have too (discussion, related, notice, share) are only doubts: such an element is no
container and no sibling, hands no points on to those above it, and inside the container it goes if the score agrees, which is to say
that a third of it is links or its blocks earn less than half of what the others earn.

Defined results: null, empty and text-free pages give an empty text, and so does a page that is all
menus, sidebars, adverts and the like; a page whose every other block lies in parts named as overlays
keeps those; very long and very deeply nested pages are read whole, in time that grows with their
length: sums go from the leaves to the root once, flags from the root to the leaves once; elements
that tie in score: the one whose first block comes first, outer before inner; repeated rows are
treated alike; an empty table gives no rows; extra columns pass through, but for those of the
result's names (text, n_chars), which the result replaces.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import small_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)",
    re.S,
)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

RAW = frozenset("script style noscript template textarea title iframe object noframes".split())
#: Of the raw ones, those that end before the next tag if their end tag is missing.
SHORT = frozenset("textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math semantics mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mpadded".split())
CUT = frozenset("nav footer aside form button select fieldset menu dialog head svg annotation annotation-xml".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: Words in the names of parts that aren't article text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsored cookie cookies consent gdpr popup modal overlay newsletter subscribe signup sidebar nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead banner toolbar hidden".split()
)
#: Of them, those that mean the article's own inside an article or main element.
OUTSIDE = frozenset("header masthead banner".split())
#: Words that parts of articles have in their names too.
DOUBTS = frozenset("notice notices alert discussion reply replies related recommended recommendations share sharing social rail promo promotion sponsor widget menu login search form skip".split())
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
#: A name made of these only is that of the article; one with a word of STATES tells of something else on the page.
KEEP = frozenset("article content main post entry story page body".split())
STATES = frozenset("has with no without is open closed on off enabled disabled".split())
#: Names of parts that may hold all of a page.
WRAPS = frozenset("overlay modal popup".split())
DOUBT, WRAP, NAMED, COMMENT = 1, 2, 3, 4
#: An end tag of one of these doesn't close elements outside of the nearest one of these.
SCOPES = frozenset("html body table td th article section main".split())
WHOLE = ("article", "main")


class _Node:
    __slots__ = ("tag", "parent", "cut", "linked", "inside", "hint", "whole", "points", "own", "blocks", "chars", "link_chars", "inline", "block", "scope", "open", "doubtful", "worst")

    def __init__(self, tag: str, parent: _Node | None, cut: bool, hint: int):
        self.tag, self.parent, self.hint = tag, parent, hint
        self.cut = cut or hint == COMMENT or (parent is not None and parent.cut)
        self.linked = tag == "a" or (parent is not None and parent.linked)
        self.inside = tag in WHOLE or (parent is not None and parent.inside)
        self.whole = False  # it holds an article or main element
        self.points, self.own, self.blocks, self.chars, self.link_chars = 0.0, 0.0, 0, 0, 0
        self.inline = tag in INLINE
        self.block = parent.block if self.inline and parent is not None else self  # the innermost one that isn't inline
        self.scope = parent.scope if parent is not None and tag not in SCOPES else self
        self.open: dict[str, list[_Node]] | None = None  # open elements by tag: of a scope, those in it; of a block, its inline ones
        self.doubtful, self.worst = False, 0

    def up(self) -> Iterator[_Node]:
        node = self
        while node is not None:
            yield node
            node = node.parent

    def density(self) -> float:
        return self.link_chars / max(1, self.chars)


def _hidden(attributes: dict[str, str]) -> bool:
    """By an attribute named hidden, by aria-hidden or by style; other attributes' values say nothing."""
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or _UNSEEN.search(attributes.get("style", "")) is not None


def _hint(attributes: dict[str, str], inside: bool) -> int:
    """What class, id and a one-word aria-label say of an element."""
    tokens = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    if len(label := attributes.get("aria-label", "").split()) == 1:
        tokens += label
    found, names = 0, [[w.lower() for w in _WORDS.findall(x)] for x in tokens]
    names = [words for words in names if words and not STATES.intersection(words)]
    if any(words[0] in COMMENTS or words[-1] in COMMENTS for words in names):
        return COMMENT
    for words in names:
        if KEEP.issuperset(words):
            return 0
        if (NAMES - OUTSIDE if inside else NAMES).intersection(words) and not ({"article", "entry", "post"}.intersection(words) and OUTSIDE.intersection(words)):
            found = max(found, WRAP if WRAPS.issuperset(NAMES.intersection(words)) else NAMED)
        elif DOUBTS.intersection(words):
            found = max(found, DOUBT)
    return found


def _open(tag: str, rest: str, parent: _Node) -> _Node:
    """The element that a start tag begins."""
    cut, hint = tag in CUT or tag == "header" and not parent.inside, 0
    if rest and not cut and tag not in ("html", "body"):
        attributes: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(rest):
            attributes.setdefault(name.lower(), "".join(values))
        cut = _HIDDEN.search(rest) is not None and _hidden(attributes) or attributes.get("role", "").strip().lower() in CUT_ROLES
        if tag not in INLINE:
            hint = _hint(attributes, parent.inside)
            if tag in WHOLE and hint != COMMENT:
                hint = 0
    node = _Node(tag, parent, cut, hint)
    if tag in WHOLE and not node.cut:
        for up in parent.up():
            if up.whole:
                break
            up.whole = True
    return node


def _parse(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """Elements in page order, and blocks: the innermost block element, its text, and how much of it is linked.

    What is open is looked up by tag, in the innermost scope or block, so no end tag walks up the tree.
    """
    root = _Node("#root", None, False, 0)
    top, nodes, blocks, text, linked = root, [root], [], [], 0
    scopes: dict[str, list[_Node]] = {}  # open elements of SCOPES, and svg, by tag
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                blocks.append((top.block, whole, linked))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not top.cut:
            piece = entities.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if top.linked:
                linked += len(piece.strip())

    def books(node: _Node) -> list[dict[str, list[_Node]]]:
        """Where an open element is entered."""
        out = []
        if node.tag in SCOPES or node.tag == "svg":
            out.append(scopes)
        for holder in {id(x): x for x in ((node.parent.scope,) if node.tag not in SCOPES else ()) + ((node.block,) if node.inline else ())}.values():
            if holder.open is None:
                holder.open = {}
            out.append(holder.open)
        return out

    def close_to(node: _Node) -> None:
        """Close what is open inside node; each element is closed once."""
        nonlocal top
        while top is not node:
            for book in books(top):
                book[top.tag].pop()
            top = top.parent

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        ends, rest = found["end"] or found["end2"], found["rest"] or ""
        if tag == "br" or tag == "hr":
            add(" ")
            continue
        if ends:
            if tag in INLINE:
                # Of the inline elements that are open in this block; a block inside them hides them.
                if top.inline and (mine := (top.block.open or {}).get(tag)) and mine[-1].block is top.block:
                    close_to(mine[-1].parent)
                continue
            held = scopes.get(tag) if tag in SCOPES else (top.scope.open or {}).get(tag)
            if held:
                flush()
                close_to(held[-1].parent)
            elif tag in SCOPES and tag == root.tag:
                flush()
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                close = None if tag in endless else re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
                if close:
                    at = close.end()
                else:
                    endless.add(tag)
                    at = max(at, found_at) if tag in SHORT and (found_at := page.find("<", at)) >= 0 else n
            continue
        if tag in CUT and rest.endswith("/"):  # <svg/>: nothing inside
            continue
        if top.tag == "head":  # what isn't raw or void can't be in it: its end tag is missing
            close_to(top.parent)
        if tag not in INLINE:
            flush()
            block = top.block
            if block.tag == "p" or block.tag == tag and tag in ("li", "td", "th", "tr", "dd", "dt", "option") or block.tag[0] == "h" and block.tag[1:].isdigit():
                block = block.parent
            close_to(block)
            if tag in _BREAKS and (drawn := scopes.get("svg")):  # HTML ends an svg that was left open
                close_to(drawn[-1].parent)
        top = _open(tag, rest, top)
        nodes.append(top)
        for book in books(top):
            book.setdefault(tag, []).append(top)
    flush()
    return nodes, blocks


_BREAKS = frozenset("body blockquote dd div dl dt h1 h2 h3 h4 h5 h6 hr li ol p pre table ul article section main nav header footer aside".split())
_LEAVES = frozenset("p li td th pre blockquote dd dt h1 h2 h3 h4 h5 h6 figcaption summary".split())


def points_of(text: str) -> float:
    """For commas, and for length up to 300 characters."""
    return text.count(",") + text.count("，") + min(len(text) / 100, 3)


#: So many elements above a block get a share of its points; what one further up would get is under a fiftieth.
LEVELS = 16


def share(level: int) -> float:
    """What of a block's points an element gets that stands so far above its parent (0: the parent)."""
    return 1 / (1 if level == 0 else 2 if level == 1 else 3 * level)


def _best(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> _Node | None:
    for node, text, linked in blocks:
        points = points_of(text)
        node.chars += len(text)
        node.link_chars += linked
        node.own += points
        node.blocks += 1
        up = node.parent if node.tag in _LEAVES and node.parent is not None else node
        for level in range(LEVELS):
            if up is None or up.tag in ("#root", "html"):
                break
            up.points += points * share(level)
            if _doubted(up):
                break
            up = up.parent
    for node in reversed(nodes):  # children come after their parents
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.own += node.own
            up.blocks += node.blocks
    seen: set[int] = set()
    found: list[_Node] = []
    for node, _, _ in blocks:
        up, new = node.parent if node.tag in _LEAVES and node.parent is not None else node, []
        while up is not None and not up.doubtful and id(up) not in seen:
            seen.add(id(up))
            new.append(up)
            up = up.parent
        found += reversed(new)
    return max((x for x in found if x.tag not in ("#root", "html")), key=lambda x: x.points * (1 - x.density()), default=None)


def _doubted(node: _Node) -> bool:
    return node.hint == DOUBT and not node.whole


def _agrees(node: _Node, best: _Node) -> bool:
    """A doubted element earns little: links, or blocks worth less than half of the container's others."""
    others = best.blocks - node.blocks
    return node.density() >= 1 / 3 or others > 0 and node.own / max(1, node.blocks) < 0.5 * (best.own - node.own) / others


def extract(page: str | None) -> str:
    """Main text of a page, one block a line."""
    if not page:
        return ""
    nodes, blocks = _parse(page.replace("\0", ""))
    for node in nodes:
        up = node.parent
        node.doubtful = _doubted(node) or up is not None and up.doubtful
        node.worst = max(0 if node.whole or node.hint == DOUBT else node.hint, up.worst if up is not None else 0)
    blocks = [b for b in blocks if b[0].worst < WRAP] or [b for b in blocks if b[0].worst < NAMED]
    best = _best(nodes, blocks)
    if best is None:
        return "\n".join(b[1] for b in blocks)
    best = next((x for x in best.up() if x.tag in WHOLE and x.density() < 0.5), best)
    # From the root down: whether an element is in best, in a doubted part of it that goes, or in a sibling of best.
    inside, gone, beside = {id(best)}, set(), {}
    for node in nodes:
        up = id(node.parent)
        if up in inside:
            inside.add(id(node))
            if up in gone or _doubted(node) and _agrees(node, best):
                gone.add(id(node))
        elif node is not best and node.parent is not None:
            if node.parent is best.parent:
                beside[id(node)] = node
            elif up in beside:
                beside[id(node)] = beside[up]
    kept = []
    for node, text, linked in blocks:
        if id(node) in inside:
            if id(node) not in gone:
                kept.append(text)
            continue
        sibling = beside.get(id(node))
        if sibling is None or _doubted(sibling) or best.tag in WHOLE and sibling.tag != best.tag:
            continue
        density = sibling.density()
        close = sibling.points * (1 - density) >= 0.2 * best.points
        prose = sibling.tag == "p" and (sibling.chars > 80 and density < 0.25 or sibling.link_chars == 0 and re.search(r"[.!?]( |$)", text) is not None)
        if close or prose:
            kept.append(text)
    return "\n".join(kept)


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages plus text and n_chars, without the html column. Narrow: no shuffle."""

    small_batches(pages.sparkSession)
    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(extract, na_action=None)

    others = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    return pages.withColumn("_text", text_of(F.col(column))).select(*others, F.col("_text").alias("text"), F.char_length("_text").cast("long").alias("n_chars"))
