"""Main text of web pages by paths on which a host's pages agree.

First every page is parsed and its containers are scored by the text that lies in their own text blocks, less the text
of links. A container's path is generalised: tags with their classes, digits taken out, told by a hash of fixed length so
that deep nesting costs no more than shallow. Spark sums each page's best score of each path over
a host's pages; the winner is the path with most votes. Then every page is read again with the winning path of its host;
a page without such a container takes its own best one. A page's best container is widened first: to the article or main element
that it stands in, else as far as the rest is article text too, so that titles, leads and sections of other classes stay. Within the container, menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are left out. Only paths and scores are shuffled, never pages.

An element is left out for its tag or role, or if a whole class or id says so: `site-header` does, `has-sidebar`,
`section-header` or `share-price` don't. Of comments, adverts and cookie notices one word is enough (`comment-body`, `google-ad`), unless
the others say a state (`no-comments`) or a part of an article; within program code names don't count. An element that is out by its name alone and holds four fifths of the page's text or
more is a wrapper and stays, unless it is one of reader comments. Left-out elements that stand inside a line don't end it.

Defined results: a null or blank page has the empty text; a page without any container gives the text of its body; a page
without a host votes alone under the empty host; of paths with equal votes the greatest hash wins; repeated rows vote each;
an empty table gives an empty result; extra
columns are ignored. Unclosed tags and cut-off pages are read as far as they go.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

#: Fixed values of the markup language.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINER = {"article", "body", "div", "main", "section", "td"}
#: What isn't an article's text, by tag, by role and by a word of the class or id.
LEFT_OUT_TAGS = {"aside", "button", "canvas", "dialog", "footer", "form", "head", "header", "iframe", "input", "menu", "nav", "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title"}
LEFT_OUT_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
COMMENT_WORDS = {"comment", "comments", "disqus", "discussion", "replies", "reply", "respond"}
LEFT_OUT_WORDS = COMMENT_WORDS | {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "footer", "gdpr", "header",
    "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "related", "share", "sharing", "sidebar", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets",
}
#: Words beside which a name still says the same.
MODIFIERS = {
    "area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "desktop", "form", "global", "group", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "media", "mobile",
    "outer", "page", "posts", "primary", "right", "secondary", "signup", "site", "slot", "sticky", "stories", "thread", "top", "unit", "wp", "wrap", "wrapper",
}
#: One of these words is enough, unless the other words of the name say what is or isn't the case, or (but for comments) name a part of an article.
STRONG_WORDS = {"comment", "comments", "disqus", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "cookie", "cookies", "consent"}
STATES = {"allowed", "closed", "code", "disabled", "enabled", "free", "has", "hoc", "less", "lib", "no", "off", "on", "open", "opened", "with", "without"}
PARTS = {"article", "articles", "baking", "body", "content", "contents", "entry", "headline", "history", "intro", "lead", "post", "posts", "recipe", "recipes", "section", "sections", "story", "stories", "text", "title"}
TITLES = {"h1", "h2", "h3"}
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "body", "article", "section", "main", "div"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)[^>]*>?", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: The share of a page's text from which an element that only its name leaves out is a wrapper.
WRAPPER = 0.8


class Node:
    """path: hash of the generalised path; out: left out with all below; soft: the nearest element out by its name alone; own: the nearest container."""

    __slots__ = ("tag", "path", "out", "soft", "link", "parent", "own", "first", "last", "level", "told", "names")

    def __init__(self, tag, path, out, soft, link, parent, first):
        self.tag, self.path, self.out, self.names, self.link, self.parent, self.first, self.last = tag, path, out, soft, link, parent, first, -1
        self.soft = self if soft else parent.soft if parent else None
        self.own = parent.own if parent else self
        self.level, self.told = [0.0, 0.0, 0.0], 0.0

    def score(self) -> float:
        return self.level[0] + self.level[1] / 2 + self.level[2] / 4


@lru_cache(1 << 16)
def _path(above: str, name: str) -> str:
    return hashlib.blake2b(f"{above}>{name}".encode("utf-8", "replace"), digest_size=8).hexdigest()


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v[1:-1] if v[:1] in "\"'" and v else v) for k, v in ATTR.findall(text)}


def _names(tag: str, attrs: dict[str, str]) -> set[str]:
    """Words that leave an element out, of those of its classes and its id that hold no word of another kind."""
    if tag in ("body", "html", "main"):
        return set()
    found = set()
    for token in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        words = set(WORDS.findall(CAMEL.sub(" ", token).lower()))
        said = words & LEFT_OUT_WORDS
        if not said:
            continue
        alone = words <= LEFT_OUT_WORDS | MODIFIERS | ({"section", "sections"} if said & COMMENT_WORDS else set())
        strong = said & STRONG_WORDS and not words & STATES and (said & COMMENT_WORDS or not words & PARTS)
        if alone or strong:
            found |= said
    return found & COMMENT_WORDS if tag == "article" else found


def _left_out(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """The header of an article holds its title and lead, other headers those of the site."""
    return tag in LEFT_OUT_TAGS and not (tag == "header" and in_article) or attrs.get("role", "").lower() in LEFT_OUT_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"


def parse(page: str) -> tuple[list[tuple[Node, str, float]], list[Node]]:
    """(blocks in page order with the node they stand in and how much of them isn't links, all containers).

    A block that is left out has an empty text.
    """
    root = Node("html", "html", False, None, False, None, 0)
    top, stack, containers, blocks, buffer = root, [root], [root], [], []
    softs: list[Node] = []
    open_: dict[str, int] = {}
    chars = [0, 0]  # of the buffer: all, outside links

    def put(text: str) -> None:
        buffer.append(text)
        n = len(text.strip())
        chars[0] += n
        if not top.link:
            chars[1] += n

    def flush() -> None:
        if buffer:
            text = SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                blocks.append((next(n for n in reversed(stack) if n.tag in BLOCK or n is root), text, len(text) * chars[1] / max(1, chars[0])))
            buffer.clear()
            chars[:] = 0, 0

    def pop_to(at: int) -> None:
        nonlocal top
        for n in stack[at:]:
            n.last = len(blocks)
            open_[n.tag] -= 1
        del stack[at:]
        top = stack[-1]

    def ends(at: int) -> None:
        """Close stack[at:]; the line ends if one of the blocks that close isn't left out."""
        if not stack[at].out and any(n.tag in BLOCK for n in stack[at:] if not n.out):
            flush()
        pop_to(at)

    def close(tags: set[str], within: set[str]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if top.out and not stack[at].out:
                return  # what is left out doesn't close what isn't
            if stack[at].tag in tags:
                ends(at)
                return
            if stack[at].tag in within:
                return

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            if not top.out:
                put(page[at:])
            break
        if m.start() > at and not top.out:
            put(page[at : m.start()])
        at = m.end()
        end, start = m[1], m[2] or m[4]
        if end:
            end = end.lower()
            if open_.get(end):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == end:
                        ends(k)
                        break
                    if stack[k].tag in BLOCK and end not in BLOCK:
                        break  # an inline tag doesn't close blocks
        elif start:
            start = start.lower()
            attrs = _attributes(m[3]) if m[3] else {}
            if start in BLOCK and not top.out:
                flush()
            if start in BLOCK:
                if top.tag == "head":
                    pop_to(len(stack) - 1)
                if start in CLOSES_P:
                    close({"p"}, SCOPE)
            if start in SAME:
                close(SAME[start], SCOPE)
            if start == "br" and not top.out:
                put("\n")
            if start in VOID or (m[3] or "").endswith("/") and start not in BLOCK:
                continue
            in_code = open_.get("pre") or open_.get("code")  # where a comment is one of the program
            names = set() if top.out or in_code else _names(start, attrs)
            out = top.out or _left_out(start, attrs, open_.get("article", 0) > 0) or bool(names) and start not in BLOCK
            path = top.path
            if start in BLOCK:
                name = start + "".join("." + c for c in sorted(re.sub(r"\d+", "", attrs.get("class", "")).split()))
                path = _path(path, name)
            node = Node(start, path, out, None if out else names, top.link or start == "a", top, len(blocks))
            if node.soft is node:
                softs.append(node)
            stack.append(node)
            open_[start] = open_.get(start, 0) + 1
            top = node
            if start in CONTAINER and not out:
                node.own = node
                containers.append(node)
            if start in RAW:
                close_at = re.compile(rf"</{start}\b[^>]*>", re.I).search(page, at)
                at = close_at.end() if close_at else n
                pop_to(len(stack) - 1)
        # comments and declarations have no text
    flush()
    for x in stack:
        x.last = len(blocks)
    if softs:
        for node, _, plain in blocks:
            if node.soft:
                node.soft.told += plain
        for s in reversed(softs):
            if s.parent.soft:
                s.parent.soft.told += s.told
        most = WRAPPER * sum(plain for _, _, plain in blocks)
        gone: set[int] = set()
        for s in softs:
            if s.told < most or s.names & COMMENT_WORDS or s.parent.soft and id(s.parent.soft) in gone:
                gone.add(id(s))
        blocks = [(x, "", 0.0) if x.soft and id(x.soft) in gone else (x, text, plain) for x, text, plain in blocks]
    return blocks, containers


def _scored(blocks: list[tuple[Node, str, float]], containers: list[Node]) -> list[tuple[Node, float]]:
    """(container, score): the text in blocks right below it, half of that one level further up. The best one is widened.

    Containers on one path within the same container are parts of it: it gets all of their text, so none of them beats it.
    """
    parts = Counter((id(c.parent.own), c.path) for c in containers if c.parent)
    for node, _, plain in blocks:
        node.own.level[0] += plain * (1.0 if node.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "li") else 0.5)
    for c in reversed(containers):
        if c.parent:
            up, own = c.parent.own.level, c.level
            shift = 0 if parts[id(c.parent.own), c.path] > 1 else 1
            for i in range(3 - shift):
                up[i + shift] += own[i]
    found = [(c, c.score()) for c in containers if c.score() > 0]
    if found:
        best, most = max(found, key=lambda x: x[1])
        found.append((_widened(best, blocks), most))
    return found


def _widened(best: Node, blocks: list[tuple[Node, str, float]]) -> Node:
    """The article or main element that the container stands in; else the furthest container of which the rest is article text too.

    That is so if nearly none of the rest is links and it holds a title or is a tenth of the text or more. A title, a lead or
    sections of other classes are found so beside the longest section.
    """

    def rest(wide: Node, inner: Node) -> tuple[int, float, bool]:
        outside = [*blocks[wide.first : inner.first], *blocks[inner.last : wide.last]]
        return sum(len(t) for _, t, _ in outside), sum(plain for _, _, plain in outside), any(t and n.tag in TITLES for n, t, _ in outside)

    above, node = [], best
    while node.parent and node.tag not in ("body", "html"):
        above.append(node)
        node = node.parent.own if node.parent.own is not node else node.parent
    for wide in above:
        if wide.tag in ("article", "main"):
            told, plain, _ = rest(wide, best)
            return wide if plain * 2 >= told else best
    wide, inner = best, sum(plain for _, _, plain in blocks[best.first : best.last])
    for node in above[1:]:
        told, plain, titled = rest(node, wide)
        if plain < 0.8 * told or told and not titled and 10 * plain < inner:
            break
        if told:
            wide, inner = node, inner + plain
    return wide


def scores(page: str | None) -> list[tuple[str, float]]:
    """(generalised path, score) of the containers, and last that of the widened best one."""
    return [(c.path, s) for c, s in _scored(*parse(page or ""))]


def main_text(page: str | None, paths: list[str]) -> str:
    """The blocks of the containers on the first of the paths that the page has; else of its own best container, widened."""
    blocks, containers = parse(page or "")
    for path in paths:
        found = [c for c in containers if c.path == path]
        if any(blocks[i][1] for c in found for i in range(c.first, c.last)):
            break
    else:
        found = [c for c, _ in _scored(blocks, containers)[-1:]] or containers[:1]
        found = [c for c in containers if c.path == found[0].path]
    keep, upto = [], 0
    for c in found:  # in page order; one may lie within another
        keep += [text for _, text, _ in blocks[max(c.first, upto) : c.last] if text]
        upto = max(upto, c.last)
    return "\n".join(keep)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the path with most votes. A page's vote for a path is the best score of its containers there, 1000 for the page's best."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums: dict[tuple[str, str], int] = {}
            for host, page in zip(b["host"], b["html"], strict=True):
                found = scores(page)
                best = max((s for _, s in found), default=0.0)
                most: dict[str, float] = {}
                for path, s in found[:-1]:
                    most[path] = max(s, most.get(path, 0.0))
                if found and found[-1][0] != (first := max(found[:-1], key=lambda x: x[1])[0]):
                    most[first] /= 2  # its text is part of the widened one
                    most[found[-1][0]] = best
                for path, s in most.items():
                    sums[host, path] = sums.get((host, path), 0) + round(1000 * s / best)
            yield pd.DataFrame([(h, p, v) for (h, p), v in sums.items()], columns=["host", "path", "votes"])

    votes = pages.mapInPandas(vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = votes.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("b"))
    return best.select("host", F.array("b.path").alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, host: one row per page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    paths = materialize(host_paths(rows.select("host", "html")), "host-paths")  # a row a host; it stays until the result has been read

    @F.pandas_udf("string")
    def text(page: pd.Series, chosen: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, [] if c is None else list(c)) for p, c in zip(page, chosen, strict=True)], dtype=object)

    told = rows.join(small(paths, 300), "host", "left").withColumn("text", text("html", "paths"))
    return told.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host")
