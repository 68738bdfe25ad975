"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements. Each paragraph has points for its length and its commas, less the
share of its characters that are links; it passes them to its container, half to the next one out, and
less beyond. The container with most points, less its own share of links, is the article's, widened to the article or main element that
holds it; siblings with a fair share of its points, and headings right before it, stay with it. Elements whose
tag, role or names say menu, header, footer, sidebar, notice, advert, form, script, style or comments are
left out wherever they stand, and so are lists that are nearly all links.
"""

from __future__ import annotations

import html
import re
from itertools import takewhile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, map_rows

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""[\s/"'=]*(?:([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?)?""")
_WORDS = re.compile(r"[a-z]+|[0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {name: re.compile(f"</{name}", re.I | re.A) for name in "script style textarea title noscript iframe template svg math object select".split()}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption caption summary address".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Which open elements a start tag closes, up to the elements that bound it.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_LEFT_OUT = frozenset("head nav footer aside form button dialog menu canvas audio video script style noscript template iframe svg math object select textarea title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NAMED_OUT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr newsletter subscribe subscription "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus respond share sharing social related recommended "
    "popup modal overlay notice alert widget toolbar pagination pager login signup search form".split()
)
#: Words before a listed one that make a name say something about the layout, or about the head of the article, and not what the element is.
_LAYOUT = frozenset("has no with without show hide hidden toggle enable enabled disable disabled".split())
_OWN_HEAD = frozenset("entry post article content story page section title".split())
_COMMENTS = frozenset("comment comments disqus respond".split())
#: Share of the page's unlinked text from which an element is the page's content, whatever its name, unless that is of reader comments.
CONTENT = 0.5
_SELF_CLOSED = frozenset(("svg", "math"))
_ARTICLE = frozenset(("article", "main"))
_CORE = frozenset(("html", "body", "article", "main"))


def _events(page: str):
    """(text, name, closing, attributes) for each tag, with the text before it; last the text after all tags."""
    at = 0
    while True:
        found = _OPEN.search(page, at)
        if not found:
            yield page[at:], None, False, {}
            return
        text, begin = page[at : found.start()], found.start()
        if found[0] == "<!--":
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            yield text, "", False, {}
            continue
        if found[0][1] in "!?":
            end = page.find(">", begin)
            at = len(page) if end < 0 else end + 1
            yield text, "", False, {}
            continue
        closing = found[0][1] == "/"
        name = _NAME.match(page, begin + 1 + closing)
        at, attributes = name.end(), {}
        while at < len(page) and page[at] != ">":
            attr = _ATTR.match(page, at)
            if attr.end() == at:
                at += 1
                continue
            at = attr.end()
            if attr[1] and not closing:
                attributes.setdefault(attr[1].lower(), (attr[2] or "").strip("\"'"))
        at += 1
        tag = name[0].lower()
        whole = tag in _SELF_CLOSED and page[at - 2] == "/"
        yield text, tag, closing, attributes
        if whole:
            yield "", tag, True, {}
        elif tag in _RAW and not closing:
            end = _RAW[tag].search(page, at)
            at = end.start() if end else len(page)


def _is_out(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in _LEFT_OUT or (tag == "header" and not in_article):
        return True
    if tag in _CORE or not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in _ROLES:
        return True
    return False


def _named(tag: str, attributes: dict[str, str], in_article: bool) -> str | None:
    """What an element is by the names in its class and id, if that is not the article: "comments", "other" or None."""
    if tag in _CORE or not attributes or (in_article and tag in _HEADING):
        return None
    kind = None
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = _WORDS.findall(name)
        for before, word in zip([None, *words], words):
            if word in _NAMED_OUT and before not in _LAYOUT and not (word in ("header", "form") and before in _OWN_HEAD):
                if word in _COMMENTS:
                    return "comments"
                kind = "other"
    return kind


class _Tree:
    """Block elements by number, each after its parent, and the blocks of text in page order."""

    def __init__(self, page: str) -> None:
        self.parent, self.tag, self.out, self.named = [-1], ["html"], [False], [None]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        stack = [("html", 0)]  # tag, element; an inline tag has the element that holds it
        places: dict[str, list[int]] = {}  # of each tag in the stack, without the first
        bounds: list[int] = []  # places of the tags that are not inline
        buffer, linked, links, article = [], 0, 0, 0

        def push(tag: str, element: int) -> None:
            places.setdefault(tag, []).append(len(stack))
            if tag not in _INLINE:
                bounds.append(len(stack))
            stack.append((tag, element))

        def last(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(buffer).split())
            if text:
                self.blocks.append((stack[-1][1], text, min(linked, len(text))))
            buffer.clear()
            linked = 0

        def close(keep: int) -> None:
            nonlocal links, article
            while len(stack) > keep:
                tag, element = stack[-1]
                if tag not in _INLINE or self.tag[element] == tag:
                    flush()
                stack.pop()
                places[tag].pop()
                if tag not in _INLINE:
                    bounds.pop()
                links -= tag == "a"
                article -= tag in _ARTICLE

        for text, tag, closing, attributes in _events(page):
            if text and not self.out[stack[-1][1]]:
                text = html.unescape(text) if "&" in text else text
                buffer.append(text)
                if links:
                    linked += len(text.strip())
            if not tag:
                continue
            if closing:
                at = last((tag,))
                if at:
                    close(at)
                elif tag == "p":
                    flush()
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in _ENDS_P:
                if bounds and stack[bounds[-1]][0] == "p":
                    close(bounds[-1])
            if tag in _CLOSES:
                names, ends = _CLOSES[tag]
                end = last(ends)
                at = min((i for name in names for i in takewhile(lambda i: i > end, reversed(places.get(name, ())))), default=0)
                if at:
                    close(at)
            out = _is_out(tag, attributes, article > 0)
            named = _named(tag, attributes, article > 0)
            if tag in _INLINE and not out and not named:
                push(tag, stack[-1][1])
            else:
                if tag not in _INLINE:
                    flush()
                else:  # an inline element that is left out doesn't end the block around it
                    pass
                held = stack[-1][1]
                if tag in _INLINE:
                    self._add(held, "inline-out", True, None)
                else:
                    self._add(held, tag, out, named)
                push(tag, len(self.tag) - 1)
            links += tag == "a"
            article += tag in _ARTICLE
        close(0 + 1)
        flush()

    def _add(self, parent: int, tag: str, out: bool, named: str | None) -> None:
        self.parent.append(parent)
        self.tag.append(tag)
        self.out.append(out or self.out[parent])
        self.named.append(named)

    def take_out_named(self) -> None:
        """Leave out what its names say is not the article, unless it holds an article or main, or most of the page's unlinked text."""
        n = len(self.tag)
        unlinked, holds = [0] * n, [t in _ARTICLE for t in self.tag]
        for element, text, in_links in self.blocks:
            unlinked[element] += len(text) - in_links
        for e in range(n - 1, 0, -1):
            unlinked[self.parent[e]] += unlinked[e]
            holds[self.parent[e]] = holds[self.parent[e]] or holds[e]
        for e in range(1, n):
            kind = self.named[e]
            own = bool(kind) and not holds[e] and (kind == "comments" or unlinked[e] < CONTENT * unlinked[0])
            self.out[e] = self.out[e] or own or self.out[self.parent[e]]
        self.blocks = [b for b in self.blocks if not self.out[b[0]]]


def main_blocks(page: str | None) -> list[str]:
    """The article's blocks of text in page order."""
    tree = _Tree(page or "")
    tree.take_out_named()
    parent, tag = tree.parent, tree.tag
    n = len(tag)
    points, chars, linked, links_in = [0.0] * n, [0] * n, [0] * n, [0] * n
    for element, text, in_links in tree.blocks:
        chars[element] += len(text)
        linked[element] += in_links
        links_in[element] += in_links > 0
        share = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - in_links / len(text))
        to = parent[element] if tag[element] in _PARAGRAPH and parent[element] >= 0 else element
        for level in range(1, 6):
            if to < 0:
                break
            points[to] += share / level
            to = parent[to]
    for e in range(n - 1, 0, -1):
        chars[parent[e]] += chars[e]
        linked[parent[e]] += linked[e]
        links_in[parent[e]] += links_in[e]
    density = [x / c if c else 0.0 for x, c in zip(linked, chars)]
    score = [p * (1 - d) for p, d in zip(points, density)]
    if not tree.blocks:
        return []
    best = max(range(n), key=lambda e: (score[e], -e))
    up, wide = best, best
    while up > 0:
        if tag[up] in _ARTICLE:
            wide = up
        up = parent[up]
    best = wide
    kept = [False] * n
    kept[best] = True
    if tag[best] not in _CORE:
        around = [e for e in range(n) if parent[e] == parent[best] and e != best]
        for e in around:
            fair = score[e] >= max(1.0, 0.2 * score[best]) or (tag[e] == "p" and chars[e] > 80)
            kept[e] = (fair and density[e] < 0.25) or (tag[e] in _HEADING and e < best)
    menu = [tag[e] in ("ul", "ol", "dl", "table") and density[e] > 0.75 and links_in[e] > 2 for e in range(n)]
    for e in range(1, n):
        kept[e] = (kept[e] or kept[parent[e]]) and not menu[e]
    return [text for element, text, _ in tree.blocks if kept[element]]


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page))


def extract(pages: DataFrame, keep: list[str], html_col: str) -> DataFrame:
    """`keep` columns, text and n_chars (code points) of every row; a null or empty page has the empty text.

    Each page is taken whole and by itself, so repeated rows have equal results and an empty table an empty one.
    """
    start = lambda: lambda page: (lambda text: (text, len(text)))(main_text(page))
    pages, (html_col, *keep), back = aside(pages, html_col, *keep)
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    return back(map_rows(rows, keep, start, [("text", T.StringType()), ("n_chars", T.LongType())]))
