"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text between block-level tags, each with its path of block-level tags from the root.
Inline tags leave the path alone, so that markup left open does not split one kind of block into many. By path the text
length, the punctuation and the share of text inside links are summed over all its blocks and divided by their number; the
ratios are smoothed along the page with a Gaussian kernel and fused. Paths whose fused ratio reaches SHARE of its mean over
the page's characters are content. The content's container is the innermost element with nearly all (PART) of the largest sum
over its blocks, counted as their length where their path is content and against it where not; an article or main element
that holds the container is it. In the container a block comes out if its path's ratio reaches LEAST of that of the content:
lists of links, teasers and what else has little text of its own stay behind whatever its tag. A heading comes with the block
that it stands over, one right before the container with that. Links weigh against length and punctuation and no more: a
linked sentence is one still, and one or two links are no list of them. What buttons alone say is no text, what they say in a
sentence is.

Tags and names are evidence only: whole words of names, of which the worst along a path counts once, multiply ratios within
bounds, up for article and main where the container is chosen, down for names of boilerplate; in the container against what
its text has itself, so that an article with such a name loses nothing. Without all evidence the ratios find the same blocks
but for prose that only its name tells from the text, of which reader comments are most: their names weigh more. Left out by tag
is only what the contract names by itself: menus, headers outside the article, footers, sidebars, forms and their controls,
scripts, styles, and what browsers don't show (where that leaves nothing, these are read too).

Null and empty pages, and pages without text, have empty text. Tags that are never closed end with what they stand in; a
tag, comment or script that the page ends in is dropped, as browsers do. Time is in proportion to the page, however
deep or broken. Character references are decoded, white space inside a block becomes one space, blocks are joined by a line
feed. Repeated rows each get their own result, an empty table none; other columns of the table play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts_of

#: A tag up to its end; possessive, so that each character is looked at once or twice.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=\"']++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_ATTRIBUTE = re.compile(r"""(?i)(?<![^\s"'])(class|id|role|style|hidden|aria-hidden)(?![^\s=])(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")

# Elements of HTML by what they mean for a text.
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"))
BLOCKS = frozenset(("address", "article", "aside", "audio", "blockquote", "body", "canvas", "caption", "center", "colgroup", "datalist", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "noscript", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "template", "tfoot", "th", "thead", "tr", "ul", "video"))
LEFT_OUT = frozenset(("head", "nav", "menu", "footer", "aside", "form", "header", "noscript", "template", "audio", "canvas", "datalist", "video"))
CONTROLS = frozenset(("select",))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LEAVES = HEADINGS | {"p", "li", "dt", "dd", "td", "th", "pre", "figcaption", "caption", "summary"}
MAIN = frozenset(("article", "main"))
# What an end of these elements a new one of the second brings. Each kind ends itself, so that few are open.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}} | dict.fromkeys(("thead", "tbody", "tfoot"), {"thead", "tbody", "tfoot"}) | dict.fromkeys(HEADINGS, HEADINGS)
SCOPES = frozenset(("ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "html"))
# Words in a class, id or role of elements that are seldom the article; those of STRONG hardly ever. Whole words.
WEAK = frozenset("toolbar popup modal overlay login search share sharing social related recommended recommendations discussion pagination pager widget widgets tags tag skip copyright disclaimer alert alerts notice notices signup teaser teasers more".split())
STRONG = frozenset("nav navbar navigation menu menus menubar topbar masthead breadcrumb breadcrumbs sidebar sidebars footer contentinfo complementary advert adverts advertisement advertisements ad ads adv adbox adsense banner banners sponsor sponsors sponsored promo promos cookie cookies consent gdpr newsletter newsletters subscribe subscription disqus".split())
COMMENTS = frozenset("comment comments commentlist commentary commenting reply replies respond".split())
#: A name that begins like this says what a page has, not what the element is.
ABOUT = frozenset("has with without no is show hide".split())
#: Width of the smoothing kernel in blocks; the share of the mean that the ratio of a content path has to reach, and the
#: share of the content's that a path in its container has to reach; what the ratio of a path of links alone is multiplied by
#: at least, and where it has one or two blocks only; and the share of a container's worth that makes a part of it the container.
SIGMA, SHARE, LEAST, LINKS, FEW_LINKS, PART = 1.0, 0.5, 0.05, 0.1, 0.3, 0.97
#: What names and tags multiply a ratio by where the container is chosen, and where blocks in it are. Comments are prose like
#: the text, and nothing but their names tells them from it.
FACTORS = {"main": (3.0, 1.0), "weak": (0.6, 0.25), "strong": (0.35, 0.05), "comments": (0.02, 0.001), "": (1.0, 1.0)}


class Node:
    """A block-level element: its place in the order of their starts, its path as a number, the evidence along the path,
    whether it is left out, whether it is in an article or main, and the nearest open element at or above it that a start
    tag can end. Of the evidence along a path the worst counts, once."""

    __slots__ = ("tag", "parent", "index", "path", "kind", "out", "main", "ends")

    def __init__(self, tag: str, parent: Node | None, index: int, path: int, kind: str, out: bool, main: Node | None):
        self.tag, self.parent, self.index, self.path, self.kind, self.out, self.main = tag, parent, index, path, kind, out, main
        self.ends: Node | None = self if tag in CLOSED_BY or tag == "p" else parent.ends if parent is not None and tag not in SCOPES else None


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


@lru_cache(8192)
def names(attributes: str) -> tuple[bool, str, bool]:
    """Of an element with these attributes: whether it is hidden, strong or weak if its names are boilerplate's, and whether
    they are those of comments."""
    hidden, kind, comments = False, "", False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"(?i)display\s*:\s*none", value):
            hidden = True
        elif name in ("class", "id", "role"):
            for own in value.split():
                parts = [x.lower() for x in _NAME_PART.findall(own)]
                if parts and parts[0] not in ABOUT:
                    comments |= not COMMENTS.isdisjoint(parts)
                    kind = "strong" if kind == "strong" or not STRONG.isdisjoint(parts) else "weak" if kind or not WEAK.isdisjoint(parts) else ""
    return hidden, kind, comments


class Reader:
    """Reads a page into its blocks and elements."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.paths: dict[tuple[int, str, str], int] = {}
        root = self.top = Node("", None, 0, 0, "", False, None)
        self.nodes = [root]
        self.opened: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = self.hidden = self.pressed = 0
        self.button = False
        self.link_in: Node | None = None
        self.hidden_in = root
        self.read(page)

    def read(self, page: str) -> None:
        at, end, more = 0, len(page), {}

        def find(mark: str, start: int) -> int:
            """Where the mark comes next, the end if nowhere; not looked for again once there is none."""
            found = page.find(mark, start) if more.get(mark, True) else -1
            more[mark] = found >= 0
            return found if found >= 0 else end

        while at < end:
            opening = find("<", at)
            if opening > at:
                self.add(page[at:opening])
            if opening == end:
                break
            at = opening
            after = page[at + 1 : at + 2]
            if after == "!" or after == "?":
                if page.startswith("<!--", at):
                    at = find("-->", at + 4) + 3
                elif page.startswith("<![CDATA[", at) and (stop := find("]]>", at + 9)) < end:
                    self.add(page[at + 9 : stop])
                    at = stop + 3
                else:
                    at = find(">", at) + 1
                continue
            if not (after.isalpha() and after.isascii() or after == "/" and page[at + 2 : at + 3].isalpha()):
                self.add("<")
                at += 1
                continue
            m = _TAG.match(page, at)
            if m is None:  # the page ends in this tag
                break
            at = m.end()
            tag, closing = m[2].lower(), bool(m[1])
            if tag in RAW and not closing:
                stop = re.compile(rf"(?i)</{tag}(?![^\s/>])[^>]*+>").search(page, at)
                at = stop.end() if stop else end
            elif tag in BLOCKS:
                (self.close if closing else self.open)(tag, m[3])
            else:
                self.inline(tag, closing, m[3])
        self.flush()

    def add(self, raw: str) -> None:
        if not self.hidden:
            text = unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.link_in is not None:
                self.linked += len(text)
            if self.button:
                self.pressed += len(text)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text and self.pressed < len(text):  # what buttons alone say is no text
                self.blocks.append(Block(self.top, text, min(self.linked, len(text))))
        self.linked = self.pressed = 0
        self.button = False

    def inline(self, tag: str, closing: bool, attributes: str) -> None:
        if tag == "br":
            self.add(" ")
        elif tag == "hr":
            self.flush()
        elif tag not in VOID:
            if tag == "a":
                self.link_in = None if closing else self.top
            elif tag == "button":
                self.button = not closing
            if self.hidden:
                self.hidden = max(0, self.hidden + (-1 if closing else 1))
            elif not closing and (tag in CONTROLS or attributes and names(attributes)[0]):
                self.hidden, self.hidden_in = 1, self.top

    def leave(self, node: Node) -> None:
        """The element ends, and with it all that is open inside."""
        while True:
            own = self.top
            self.opened[own.tag] -= 1
            self.top = own.parent
            if own is node:
                break
        if self.link_in is not None and node.index <= self.link_in.index:
            self.link_in = None
        if self.hidden and node.index <= self.hidden_in.index:
            self.hidden = 0

    def close(self, tag: str, _: str) -> None:
        self.flush()
        if self.opened[tag]:
            node = self.top
            while node.tag != tag:
                self.leave(node)
                node = self.top
            self.leave(node)

    def open(self, tag: str, attributes: str) -> None:
        self.flush()
        node, ended = self.top.ends, None
        while node is not None:
            if node.tag == "p" or tag in CLOSED_BY[node.tag]:
                ended = node
            node = node.parent.ends if node.tag not in SCOPES else None
        if ended is not None:
            self.leave(ended)
        top = self.top
        hidden, kind, comments = names(attributes) if attributes and tag not in ("html", "body") else (False, "", False)
        main = top.main
        if comments:
            kind = "comments"
        elif tag in MAIN:
            kind = "" if main is not None else "main"
        path = self.paths.setdefault((top.path, tag, kind), len(self.paths) + 1)
        out = top.out or hidden or tag in LEFT_OUT and not (tag == "header" and main is not None)
        if kind == "main":
            kind = top.kind if top.kind == "comments" else "main"
        elif not kind or top.kind and FACTORS[top.kind] < FACTORS[kind]:
            kind = top.kind
        node = Node(tag, top, len(self.nodes), path, kind, out, main or None)
        if tag in MAIN and main is None and not comments:
            node.main = node
        self.nodes.append(node)
        self.opened[tag] += 1
        self.top = node


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, reach, mode="edge"), kernel / kernel.sum(), "valid")


def ratios(blocks: list[Block]) -> np.ndarray:
    """For each block the fused ratio of its path."""
    _, path = np.unique([b.node.path for b in blocks], return_inverse=True)
    n = np.bincount(path)
    length, marks, linked = (np.array(x, float) for x in ([len(b.text) for b in blocks], [len(_PUNCTUATION.findall(b.text)) for b in blocks], [b.linked for b in blocks]))
    total = np.bincount(path, length)
    chars, marks = (total / n)[path], (np.bincount(path, marks) / n)[path]
    plain = np.maximum(0, 1 - np.bincount(path, linked) / total)
    plain = np.maximum(plain * np.minimum(1, 2 * plain), np.where(n <= 2, FEW_LINKS, LINKS))[path]  # mostly links is worse than half
    chars, marks = np.sqrt(chars * smoothed(chars)), np.sqrt(marks * smoothed(marks))
    fused = np.log1p(chars) * (1 + np.log1p(marks)) * plain
    return (np.bincount(path, fused) / n)[path]


def container(nodes: list[Node], blocks: list[Block], worth: np.ndarray) -> Node:
    """The element whose blocks' worths add up to most, the innermost of equals; not one that holds a single run of text."""
    total = np.zeros(len(nodes))
    np.add.at(total, [b.node.index for b in blocks], worth)
    for node in reversed(nodes):  # children come after their parents
        if node.parent is not None:
            total[node.parent.index] += total[node.index]
    best = len(nodes) - 1 - int(np.argmax(total[::-1]))
    most = total[best]
    for node in nodes[best + 1 :]:  # of what is inside, the innermost that holds nearly all of it
        if node.parent.index == best and total[node.index] >= PART * most:
            best = node.index
    node = nodes[best]
    while node.tag in LEAVES and node.parent is not None:
        node = node.parent
    return node.main or node


def evidence(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """What a block's ratio is multiplied by where the container is chosen, and in the container."""
    both = np.array([FACTORS[b.node.kind] for b in blocks])
    return both[:, 0], both[:, 1]


def selected(nodes: list[Node], blocks: list[Block]) -> list[Block]:
    """The content's blocks, in order."""
    plain, length = ratios(blocks), np.array([len(b.text) for b in blocks], float)
    outer, inner = evidence(blocks)
    ratio, weight = plain * outer, length * np.minimum(1, outer)
    content = ratio >= SHARE * (ratio * weight).sum() / weight.sum()
    holder = container(nodes, blocks, np.where(content, length, -np.maximum(length, 10)))
    last = holder.index
    for node in nodes[holder.index + 1 :]:  # what is inside follows it without a gap
        if node.parent.index < holder.index or node.parent.index > last:
            break
        last = node.index
    inside = np.array([holder.index <= b.node.index <= last for b in blocks])
    here = inside & content
    own = plain * inner
    # against the container's text as it is named itself: names that all of it has tell nothing
    chosen = inside & (own >= LEAST * np.average(plain[here], weights=length[here]) * np.average(inner[here], weights=length[here])) if here.any() else inside
    for k in range(len(blocks) - 2, -1, -1):  # a heading goes with what it stands over
        if inside[k] and chosen[k + 1] and blocks[k].node.tag in HEADINGS and not blocks[k].linked and blocks[k].node.parent is blocks[k + 1].node.parent:
            chosen[k] = True
    k = int(np.argmax(inside))
    while k and blocks[k - 1].node.tag in HEADINGS and not blocks[k - 1].linked and outer[k - 1] >= 1:
        chosen[k := k - 1] = True
    return [b for b, x in zip(blocks, chosen, strict=True) if x]


def main_text(page: str) -> str:
    own = Reader(page)
    blocks = [b for b in own.blocks if not b.node.out] or own.blocks
    return "\n".join(b.text for b in selected(own.nodes, blocks)) if blocks else ""


def extract(df: DataFrame, key: str = "page_id", keep: tuple[str, ...] = ("url",), html: str = "html") -> DataFrame:
    """The key, the columns kept, text and n_chars of every page of df."""
    kinds = dict(df.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in texts_of(batch, "_html")]
        own = [batch.column(k) for k in range(len(keep) + 1)]
        return pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [key, *keep, "text", "n_chars"])

    return map_arrow(df.select(key, *keep, df[html].alias("_html")), run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep)) + ", text string, n_chars long")
