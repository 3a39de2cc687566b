"""A tolerant reader of whole HTML pages: a tree of blocks with their text.

Only what main-text extraction needs is kept. Inline elements are transparent: their text belongs to the
block around them. A block's text is one run per stretch between block boundaries, with character references
decoded and white space collapsed. Markup that ends early, unclosed elements and stray end tags are read the
way browsers do in the common cases (implied ends of p, li, dt, dd, tr, td, th, option; unmatched end tags
are ignored), so the text is never cut.
"""

from __future__ import annotations

import re
from html import unescape

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

#: elements of HTML, by what they are to a reader (fixed values)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noframes template".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr".split())
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
             "hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
SCOPE = set("ul ol dl table select article main section div body".split())
CHROME = set("nav footer aside menu head datalist".split())
MUTED = set("button select option svg canvas object audio video map meter progress".split())
LANDMARK = {"article", "main"}

#: class, id and role words that name what is not the article (fixed values)
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager skip sitemap "
    "sidebar aside rail widget footer foot masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay subscribe newsletter signup login paywall "
    "comment comments disqus reply replies respond discussion "
    "share sharing social related recommended recommendations outbrain taboola "
    "complementary contentinfo search dialog alertdialog form".split())
HEADER_WORDS = {"header", "banner"}
COMMENT_WORDS = {"comment", "comments", "reply", "replies"}

DEPTH = 40          #: deeper blocks are judged with their ancestor at this depth; their text stays

HIDDEN = re.compile(r"display\s*:\s*none", re.I)
SPLIT_NAME = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """One block: its label, its children (blocks and text runs) in page order, and what is known of it.

    ``noise``: 2 by its element, 1 by its role, class or a form around it, 0 not. ``holds``: it is, or
    has below it, what the page declares to be its main content.
    """

    __slots__ = ("tag", "label", "children", "noise", "landmark", "holds", "depth")

    def __init__(self, tag: str, label: str, noise: int, landmark: bool, depth: int):
        self.tag, self.label, self.noise, self.landmark, self.depth = tag, label, noise, landmark, depth
        self.holds = False
        self.children: list = []

    @property
    def dropped(self) -> bool:
        """Rules call it noise; a class or a form around the main content doesn't."""
        return self.noise == 2 or self.noise == 1 and not self.holds


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _said(at: dict[str, str]) -> set[str]:
    """The words of class, id and role; names such as has-sidebar only tell of something elsewhere."""
    names = [n for n in f"{at.get('class', '')} {at.get('id', '')} {at.get('role', '')}".split()
             if not n.lower().startswith(("has-", "with-", "no-", "without-", "is-"))]
    return {w.lower() for n in names for w in SPLIT_NAME.split(n) if w}


def _described(tag: str, raw: str, in_landmark: bool) -> tuple[str, int, bool]:
    """Label, how rules call it noise, whether it declares main content."""
    at = _attributes(raw)
    names, role = at.get("class", ""), at.get("role", "").lower()
    label = tag + "".join("." + w for w in sorted(re.sub(r"\d+", "0", names).split()))
    said = _said(at)
    if tag in LANDMARK or role in ("main", "article") or "articleBody" in at.get("itemprop", ""):
        return (label, 1, False) if said & COMMENT_WORDS else (label, 0, True)
    if tag in CHROME or tag in MUTED:
        return label, 2, False
    hidden = "hidden" in at or at.get("aria-hidden", "").lower() == "true" or HIDDEN.search(at.get("style", ""))
    named = tag != "body" and said & (NOISE_WORDS if in_landmark else NOISE_WORDS | HEADER_WORDS)
    return label, int(bool(hidden or named or tag == "form" or tag == "header" and not in_landmark)), False


class _Reader:
    """The open elements and the text run of one page while it is read."""

    def __init__(self):
        self.root = Node("html", "html", 0, False, 0)
        self.stack: list[tuple[str, Node, bool]] = [("html", self.root, False)]   # element, block of its text, muted
        self.open: dict[str, int] = {}
        self.run: list[str] = []
        self.muted = self.landmarks = 0

    def text(self, s: str) -> None:
        if not self.muted:
            self.run.append(s)

    def flush(self) -> None:
        """End the run: what was read since the last block boundary is one text of the innermost block."""
        if self.run:
            text = " ".join("".join(self.run).split())
            self.run.clear()
            if text:
                self.stack[-1][1].children.append(text)

    def push(self, tag: str, node: Node, muted: bool = False) -> None:
        self.stack.append((tag, node, muted))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.muted += muted

    def block(self, tag: str, label: str, noise: int, landmark: bool) -> None:
        self.flush()
        top = self.stack[-1][1]
        if top.depth >= DEPTH and not noise and not landmark:
            self.push(tag, top)
            return
        node = Node(tag, label, noise, landmark, top.depth + 1)
        top.children.append(node)
        self.push(tag, node)
        if landmark:
            self.landmarks += 1
            for _, above, _ in reversed(self.stack):
                if above.noise == 2 or above.holds:
                    break
                above.holds = True

    def pop(self) -> None:
        tag, node, muted = self.stack[-1]
        parent = self.stack[-2][1]
        if not muted and (tag not in INLINE or node is not parent):
            self.flush()
        self.stack.pop()
        self.open[tag] -= 1
        self.muted -= muted
        if node is not parent:
            self.landmarks -= node.landmark
            if not node.children:
                parent.children.pop()       # an element without text; it is its parent's last child

    def close(self, tags: set[str], stop: set[str]) -> None:
        """End the open elements down to the nearest one of ``tags``, unless one of ``stop`` lies between."""
        if not any(self.open.get(t) for t in tags):
            return
        at = len(self.stack) - 1
        while at > 0 and self.stack[at][0] not in tags:
            if self.stack[at][0] in stop:
                return
            at -= 1
        while at > 0 and len(self.stack) > at:
            self.pop()

    def start(self, tag: str, raw: str) -> None:
        if tag == "html" or tag == "body" and self.open.get("body"):
            return
        if tag == "br":
            self.text(" ")
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            return
        if tag != "head":
            self.close({"head"}, set())
        if tag in LANDMARK:
            self.close({"nav"}, LANDMARK | {"aside"})
        if tag in ENDS_P:
            self.close({"p"}, {"button", "td", "th", "li"} | SCOPE)
        if tag in SIBLINGS:
            self.close(SIBLINGS[tag], SCOPE)
        label, noise, landmark = _described(tag, raw, self.landmarks > 0)
        if tag in MUTED or tag in INLINE and noise:
            self.push(tag, self.stack[-1][1], True)
        elif tag in INLINE:
            self.push(tag, self.stack[-1][1])
        else:
            self.block(tag, label, noise, landmark)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.text(" ")
        elif tag == "p" and not self.open.get("p"):
            self.flush()
        elif tag not in ("html", "body"):
            inline = tag in INLINE or tag in MUTED
            self.close({tag}, ENDS_P | SCOPE | {"li", "td", "th", "dd", "dt"} if inline else set())


def parse(html: str) -> tuple[Node, str]:
    """The tree of blocks of a page and its title."""
    reader, title, raw_end = _Reader(), None, {}
    pos, size = 0, len(html)
    while pos < size:
        m = TOKEN.search(html, pos)
        if m is None:
            reader.text(unescape(html[pos:]))
            break
        if m.start() > pos:
            reader.text(unescape(html[pos:m.start()]))
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                reader.text(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if (m[1] or m[4]) == "/":
            reader.end(tag)
        elif tag in RAW:
            if tag not in raw_end:
                raw_end[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)
            e = raw_end[tag].search(html, pos)
            if tag == "title" and title is None:
                title = " ".join(unescape(html[pos:e.start() if e else size]).split())
            pos = e.end() if e else size
        else:
            reader.start(tag, m[3] or m[6] or "")
    while len(reader.stack) > 1:
        reader.pop()
    reader.flush()
    return reader.root, title or ""
