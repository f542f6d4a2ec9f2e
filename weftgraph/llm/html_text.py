"""Main text of web pages: parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clustering.

Each page streams through the standard library's HTML parser. Its events build blocks (paragraphs, headings, list
items, cells); a block is the line of the ratio: characters of text for each tag that bears on it. The ratios are
smoothed along the page with a Gaussian; lines whose smoothed ratio reaches the page's standard deviation seed
content clusters. What the page itself marks wins over the curve: a block inside an element that is never
content (menus, headers, footers, sidebars, notices, adverts, scripts, styles) is out. So is one inside an element whose
class or id names such a part, or inside a form, unless that element holds an article or main element or more than
MOST of the page's text, in which case its name says something else; and one among reader comments, unless they hold
the page's main element or first heading. Where most of the seeds' text lies in article or main elements, these elements' blocks are
the region; elsewhere a cluster extends over neighbouring lines that are not link lists.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

SIGMA = 1.0
LEAST_RATIO = 10.0
LINKED = 0.5
# fixed values: element names by role
RAW = {"script", "style"}
SKIP = {"head", "nav", "footer", "aside", "button", "select", "textarea", "noscript", "template", "iframe", "svg", "object", "canvas", "dialog", "menu", "script", "style", "title"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "aside", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES_P = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "alertdialog", "form"}
# fixed values: words of a class or id that name a part which is no content, comments, and words that follow them in such names
COMMENTS = {"comment", "comments", "disqus", "respond", "reply", "replies"}
PARTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr",
    "notice", "popup", "modal", "newsletter", "subscribe", "menu", "navbar", "nav", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead",
    "toolbar", "share", "sharing", "social", "related", "recommended", "pagination", "pager", "login", "signup", "search",
}
FOLLOW = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "col", "column", "container", "content", "desktop", "fixed", "footer", "form", "group",
    "header", "icon", "icons", "inner", "item", "items", "label", "left", "link", "links", "list", "main", "media", "mobile", "outer", "overlay", "panel", "posts", "articles",
    "stories", "primary", "right", "row", "secondary", "section", "site", "slot", "space", "sticky", "text", "thread", "title", "toggle", "top", "tree", "unit", "widget", "widgets", "wrap", "wrapper", "up",
}
#: A named part or form with more of the page's unlinked text than this is the page's frame.
MOST = 0.5
_JOINT = re.compile(r"[-_]+")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
IN_HEAD = {"html", "head", "title", "meta", "link", "base", "style", "script", "noscript", "template"}
_SPACE = re.compile(r"\s+")
_TAG = re.compile(r"<[A-Za-z/!?]")


def _named(value: str, inner: bool, every: bool) -> str:
    """What a class or id names: "part", "comments" or nothing. A name counts if it is such a word, or begins with one and goes on with words that often follow.

    inner: in an article, whose own header is no such part. every: all names must count, not any.
    """
    kinds = []
    for name in value.lower().split():
        first, *rest = [w for w in _JOINT.split(name) if w] or [""]
        known = all(w in FOLLOW or w in PARTS or w in COMMENTS or w.isdigit() for w in rest)
        if first in ("side", "bread", "nav") and rest[:1] in (["bar"], ["crumb"], ["crumbs"]):
            first = "sidebar"
        if inner and first in ("header", "masthead"):
            known = False
        kinds.append("comments" if known and first in COMMENTS else "part" if known and first in PARTS else "")
    if every and not all(kinds):
        return ""
    return "comments" if "comments" in kinds else "part" if "part" in kinds else ""


class _Blocks(HTMLParser):
    """Collects (text, tags, characters in links, inside an article, innermost named part) for each block that may be content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []
        self.open: Counter[str] = Counter()
        self.items = [0]  # open list items by list, the innermost list last
        self.dead = self.core = self.links = 0
        self.blocks: list[tuple[str, int, int, bool, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = 0
        # named parts and forms by number: the one around it, its kind, and whether it holds what content is made of
        self.around: list[int] = []
        self.kinds: list[str] = []
        self.frames: list[bool] = []
        self.part = -1

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.blocks.append((text, self.tags, self.linked, self.core > 0, self.part))
            self.tags = 0
        self.text, self.linked = [], 0

    def _kind(self, tag: str, attrs: list) -> str:
        """The kind of part that an element's name says it is, "form" for a form."""
        if tag in ("html", "body", "main"):
            return ""
        a = {k: v or "" for k, v in attrs}
        every = tag in HEADINGS | {"p", "blockquote", "pre"}
        names = [_named(a.get(k, ""), self.core > 0, every) for k in ("class", "id") if a.get(k)]
        if "comments" in names:
            return "comments"
        if "part" in names and tag != "article" and not (self.core and tag in HEADINGS):
            return "part"
        return "form" if tag == "form" else ""

    def killed(self) -> list[bool]:
        """Of each part whether its blocks are out."""
        own = [0] * len(self.kinds)
        for text, _, linked, _, part in self.blocks:
            if part >= 0:
                own[part] += max(0, len(text) - linked)
        total = sum(max(0, len(text) - linked) for text, _, linked, _, _ in self.blocks)
        # a part's number is larger than that of the one around it
        for i in range(len(own) - 1, -1, -1):
            if self.around[i] >= 0:
                own[self.around[i]] += own[i]
                self.frames[self.around[i]] |= self.frames[i] and (self.kinds[i] != "comments")
        out: list[bool] = []
        for i, kind in enumerate(self.kinds):
            stays = self.frames[i] or (kind != "comments" and own[i] > MOST * total)
            out.append(not stays or (self.around[i] >= 0 and out[self.around[i]]))
        return out

    def _unwanted(self, tag: str, attrs: list) -> bool:
        if tag in SKIP:
            return True
        if tag == "header":
            return not self.core
        a = {k: v or "" for k, v in attrs}
        return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES or bool(re.search(r"display\s*:\s*none", a.get("style", ""), re.I))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        # a head without its end tag ends at the first element that can't be in one
        if tag == "body" or (self.stack and self.stack[-1][0] == "head" and tag not in IN_HEAD):
            self._close("head")
        if tag in CLOSES_P and self.open["p"]:
            self._close("p")
        if tag == "li" and self.items[-1]:
            self._close("li")
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        bad = self._unwanted(tag, attrs)
        if bad:
            self.flush()
            self.dead += 1
        if self.part >= 0 and (tag == "main" or (tag == "h1" and self.kinds[self.part] == "comments") or (tag == "article" and self.kinds[self.part] != "comments")):
            self.frames[self.part] = True
        kind = "" if bad or self.dead else self._kind(tag, attrs)
        if kind:
            self.flush()
            self.around.append(self.part)
            self.kinds.append(kind)
            self.frames.append(False)
            self.part = len(self.kinds) - 1
        self.stack.append((tag, bad, bool(kind)))
        self.open[tag] += 1
        if tag in ("ul", "ol"):
            self.items.append(0)
        self.items[-1] += tag == "li"
        self.core += tag in ("article", "main")
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SKIP:
            self._close(tag)

    def _close(self, tag: str) -> None:
        t = ""
        while self.open[tag] and t != tag:
            t, bad, named = self.stack.pop()
            if t in BLOCKS or bad or named:
                self.flush()
            self.dead -= bad
            if named:
                self.part = self.around[self.part]
            self.core -= t in ("article", "main")
            self.links -= t == "a"
            self.open[t] -= 1
            if t in ("ul", "ol"):
                self.items.pop()
            self.items[-1] -= t == "li"

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        self._close(tag)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment without its end goes on to the end of the page."""
        end = self.rawdata.find("-->", i + 2)
        return end + 3 if end >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        """Comments, the document type with its internal subset, marked sections and anything else behind <! are markup."""
        page = self.rawdata
        if page.startswith("<!--", i):
            return self.parse_comment(i)
        if page.startswith("<![CDATA[", i):
            end = page.find("]]>", i)
            return end + 3 if end >= 0 else len(page)
        end = page.find(">", i)
        inner = page.find("[", i, end) if page[i + 2 : i + 9].lower() == "doctype" else -1
        if inner >= 0:
            subset = re.compile(r"\]\s*>").search(page, inner)
            end = subset.end() - 1 if subset else end
        return end + 1 if end >= 0 else len(page)

    def handle_data(self, data: str) -> None:
        if not self.dead:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def _smoothed(x: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over lines, the ends repeated."""
    reach = int(np.ceil(3 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(x, reach, mode="edge"), kernel / kernel.sum(), "valid")


def main_text(html: str | None) -> str:
    """The page's content blocks, joined in page order by a blank line; empty if there is none."""
    if not html:
        return ""
    # a tag that the page ends in is none; the parser would look for its end again from each of its characters
    cut = _TAG.search(html, html.rfind(">") + 1)
    parser = _Blocks()
    parser.feed(html[: cut.start()] if cut else html)
    parser.close()
    parser.flush()
    out = parser.killed()
    blocks = [b[:4] for b in parser.blocks if b[4] < 0 or not out[b[4]]]
    if not blocks:
        return ""
    ratio = _smoothed(np.array([len(t) / max(1, n) for t, n, _, _ in blocks], float))
    seed = ratio >= max(min(float(ratio.std()), float(ratio.max())), min(LEAST_RATIO, float(ratio.max())))
    core = np.array([c for _, _, _, c in blocks])
    long = np.array([len(t) for t, _, _, _ in blocks])
    # a teaser's article beside a story that lies in none is not the region
    if (seed & core).any() and 2 * long[seed & core].sum() >= long[seed].sum():
        keep = core
    else:
        listy = np.array([k > LINKED * len(t) for t, _, k, _ in blocks])
        keep, grown = seed & ~listy, False
        while not grown:
            near = np.zeros(len(keep), bool)
            near[1:] |= keep[:-1]
            near[:-1] |= keep[1:]
            more = keep | (near & ~listy)
            grown = bool((more == keep).all())
            keep = more
    return "\n\n".join(t for (t, _, _, _), k in zip(blocks, keep, strict=True) if k)


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns with text and n_chars (code points), one row for each page.

    Null or empty html gives an empty text. Broken markup is read as the parser recovers it. Repeated rows repeat;
    other columns are left out, whatever their names.
    """
    fields = [pages.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            text = [main_text(h) for h in b.column("_html").to_pylist()]
            yield {f.name: b.column(f.name) for f in fields} | {"text": text, "n_chars": [len(t) for t in text]}

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["text string", "n_chars long"])
    return map_batches(pages.select(*keep, F.col(html_col).cast("string").alias("_html")), run, schema)
