"""Main-text extraction with a tree-structured graphical model over the DOM.

Every structural element and every block of text is a node with a hidden label, content or not. A
node's own potential is a logistic function of its features (tag, class words, length, links,
punctuation); a potential for each kind of child couples parent and child labels. Sum-product messages
pass from the leaves to the root and back, which gives exact marginals on a tree; blocks whose marginal
is above one half make the text. Both kinds of potentials are trained from labelled pages.

Blocks: a run of text inside a block element, ended by the start or end of any block element. Inline
markup and <br> stay inside the run. Character references are decoded, white space becomes one space.

Defined cases: null, empty or tag-less html gives the empty text or its text as one block; scripts,
styles, templates, comments and titles are never text; unclosed, misnested and stray tags are repaired
as browsers do in outline; a tag that never ends is text; repeated rows give equal texts; an empty table
gives an empty result. Nesting of any depth is kept, and parsing takes time in proportion to the page.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import bounded_batches

# Fixed values of HTML: elements without end tags, elements whose inside is no text, elements that stay in a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript title textarea iframe object svg math select noembed noframes audio video canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": (), "tbody": ("thead", "tr", "td", "th")}
LIST_ROOTS = frozenset("ul ol menu dl table".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+>", re.S)
_ENDLESS = re.compile(r"<!--|<!\[CDATA\[")
_ATTR = re.compile(r"(?:class|id|role|itemprop|hidden|aria-hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_NAME_WORDS = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    names: str = ""
    parent: int = -1
    depth: int = 0
    text: list[str] = field(default_factory=list)
    link_chars: int = 0
    chars: int = 0


def parse(html: str) -> list[Node]:
    """Nodes in page order, parents before children; text blocks have the tag ``#text``."""
    nodes = [Node("#root")]
    stack = [0]
    where: dict[str, list[int]] = defaultdict(list)  # places of the open elements of a tag in the stack
    run: list[str] = []
    links = in_link = 0
    at, n = 0, len(html)

    def flush():
        nonlocal links
        joined = _SPACE.sub(" ", entities.unescape("".join(run))).strip() if run else ""
        run.clear()
        if joined:
            top = stack[-1]
            nodes.append(Node("#text", parent=top, depth=nodes[top].depth + 1, text=[joined], link_chars=links, chars=len(joined)))
        links = 0

    def innermost(tags):
        return max((where[t][-1] for t in tags if where[t]), default=0)

    def close(tags, stop):
        at = innermost(tags)
        if at > innermost(stop):
            while len(stack) > at:
                where[nodes[stack.pop()].tag].pop()

    def add_text(raw):
        nonlocal links
        if raw:
            run.append(raw)
            if in_link:
                links += len(raw)

    last = html.rfind(">") + 1  # no tag ends behind it, but comments do with the page
    while at < n:
        m = _TOKEN.search(html, at, last) if at < last else None
        if not m:
            endless = _ENDLESS.search(html, at)
            add_text(html[at : endless.start()] if endless else html[at:])
            break
        add_text(html[at : m.start()])
        at = m.end()
        if m[0].startswith(("<!--", "<![CDATA[")) and not m[0].endswith(("-->", "]]>")):
            break
        name = m[2] or m[5]  # the second form has an unclosed quote
        if name is None:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or ""
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            if tag not in ("svg", "math"):
                run.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                run.append(" ")
            continue
        flush()
        if closing:
            if tag not in VOID:
                close({tag}, ())
            in_link = 0
            continue
        if tag in CLOSES_P:
            close({"p"}, ("td", "th", "div", "article", "section", "main", "aside", "body"))
            if tag[0] == "h" and len(tag) == 2:
                close({"h1", "h2", "h3", "h4", "h5", "h6"}, ("div", "article", "section", "p", "li", "td"))
        elif tag in CLOSED_BY:
            for t in CLOSED_BY[tag]:
                close({t}, LIST_ROOTS)
        if tag in VOID or tag in ("html", "body") and any(x.tag == tag for x in nodes[:4]):
            continue
        names = " ".join(a or b or c for a, b, c in _ATTR.findall(attributes)).lower() if attributes else ""
        top = stack[-1]
        nodes.append(Node(tag, names, top, nodes[top].depth + 1))
        where[tag].append(len(stack))
        stack.append(len(nodes) - 1)
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[nodes[i].parent]
        p.chars += nodes[i].chars
        p.link_chars += nodes[i].link_chars
    return nodes


KINDS = {
    **dict.fromkeys(("article", "main"), "body"),
    **dict.fromkeys(("nav", "menu", "search"), "nav"),
    **dict.fromkeys(("header", "hgroup"), "header"),
    "footer": "footer",
    **dict.fromkeys(("aside", "dialog"), "aside"),
    **dict.fromkeys(("form", "fieldset", "button", "input", "legend", "datalist", "output"), "form"),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "head"),
    **dict.fromkeys(("p", "pre", "blockquote", "figure", "figcaption", "details", "summary", "address"), "para"),
    **dict.fromkeys(("ul", "ol", "li", "dl", "dt", "dd"), "list"),
    **dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "table"),
    **dict.fromkeys(("div", "section", "center"), "div"),
    "#text": "text",
    "#root": "root",
    **dict.fromkeys(("html", "body"), "root"),
    "head": "meta",
}
GOOD = frozenset("article content post entry story body main text prose markdown richtext articlebody blogpost hentry lead".split())
BAD = {
    **dict.fromkeys(("nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", "links", "sitemap", "skip"), "nav"),
    **dict.fromkeys(("ad", "ads", "advert", "advertisement", "adverts", "banner", "promo", "promotion", "sponsor", "sponsored", "adsense", "dfp", "outbrain", "taboola"), "ad"),
    **dict.fromkeys(("cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "banner", "paywall", "toast", "privacy", "dialog"), "notice"),
    **dict.fromkeys(("comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "commentlist", "thread"), "comment"),
    **dict.fromkeys(("sidebar", "aside", "related", "recommended", "widget", "rail", "trending", "popular", "more", "complementary", "recirc"), "side"),
    **dict.fromkeys(("share", "sharing", "social", "follow", "newsletter", "subscribe", "signup", "login", "search", "form", "author", "byline", "tags", "meta"), "form"),
    **dict.fromkeys(("footer", "copyright", "contentinfo", "colophon", "legal", "bottom"), "footer"),
    **dict.fromkeys(("header", "masthead", "topbar", "logo", "brand", "branding"), "header"),
    **dict.fromkeys(("hidden", "none", "sr", "visuallyhidden"), "hidden"),
}
KIND_NAMES = ("body", "nav", "header", "footer", "aside", "form", "head", "para", "list", "table", "div", "text", "root", "meta", "other")
CLASS_NAMES = ("good", "nav", "ad", "notice", "comment", "side", "form", "footer", "header", "hidden")
COUPLED = {k: i for i, k in enumerate(KIND_NAMES)}
BAD_KINDS = frozenset(COUPLED[k] for k in ("nav", "header", "footer", "aside", "form", "meta"))
N_FEATURES = 1 + len(KIND_NAMES) + len(CLASS_NAMES) + 10
_END = re.compile(r"[.!?…。»”\"')]$")


def kind_of(tag: str) -> str:
    return KINDS.get(tag, "other")


def classes_of(node: Node) -> set[str]:
    words = set(_NAME_WORDS.findall(node.names))
    found = {BAD[w] for w in words if w in BAD}
    if words & GOOD and not found:
        found.add("good")
    return found


def features(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Features of each node, and the kind that couples it to its parent."""
    x = np.zeros((len(nodes), N_FEATURES), np.float64)
    kinds = np.empty(len(nodes), np.int64)
    total = max(1, nodes[0].chars)
    class_at = {c: 1 + len(KIND_NAMES) + i for i, c in enumerate(CLASS_NAMES)}
    base = 1 + len(KIND_NAMES) + len(CLASS_NAMES)
    x[:, 0] = 1
    holds = [False] * len(nodes)  # whether a node holds or is a marked article
    for i in range(len(nodes) - 1, 0, -1):
        holds[i] = holds[i] or kind_of(nodes[i].tag) == "body" or bool(nodes[i].names) and "good" in classes_of(nodes[i])
        holds[nodes[i].parent] |= holds[i]
    nearest = [0] * len(nodes)  # of the marked elements around a node, what the innermost is: 1 good, -1 bad
    for i, node in enumerate(nodes):
        around = nearest[node.parent] if i else 0
        kind = COUPLED[kind_of(node.tag)]
        if kind == COUPLED["header"] and around > 0:
            kind = COUPLED["div"]  # an article's own header holds its title
        kinds[i] = kind
        x[i, 1 + kind] = 1
        found = classes_of(node) if node.names and kind != COUPLED["root"] else set()
        if holds[i] and node.chars > 0.6 * total:
            found &= {"good"}  # names of what wraps the page tell of its parts
        for c in found:
            x[i, class_at[c]] = 1
        if kind in BAD_KINDS or any(c != "good" for c in found):
            nearest[i] = -1
        else:
            # Good markup inside a marked-off part, such as an article among comments, stays marked off.
            nearest[i] = 1 if around >= 0 and (kind == COUPLED["body"] or "good" in found) else around
        x[i, base + 8] = nearest[i] > 0
        x[i, base + 9] = nearest[i] < 0
        density = min(1.0, node.link_chars / node.chars) if node.chars else 0.0
        x[i, base] = density
        x[i, base + 1] = np.log1p(node.chars) / 8
        x[i, base + 2] = node.chars / total
        if node.text:
            t = node.text[0]
            x[i, base + 3] = bool(_END.search(t))
            x[i, base + 4] = min(1.0, t.count(" ") / 40)
            x[i, base + 5] = "©" in t or "all rights reserved" in t.lower()
            x[i, base + 6] = density > 0.8
            x[i, base + 7] = node.chars < 25
    return x, kinds


@dataclass
class TreeModel:
    """Log potentials: weights of a node's features for content, and a 2 x 2 table for each kind of child."""

    weights: np.ndarray
    pair: np.ndarray  # [kind, parent label, child label]

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """Probability of content for each node by sum-product, upward then downward, in log space."""
        x, kinds = features(nodes)
        own = np.zeros((len(nodes), 2))
        own[:, 1] = x @ self.weights
        up = own.copy()
        sent = np.zeros((len(nodes), 2))  # message of a node to its parent
        parents = [n.parent for n in nodes]
        pair = self.pair[kinds]
        for i in range(len(nodes) - 1, 0, -1):
            a, b = up[i]
            p = pair[i]
            m0 = np.logaddexp(p[0, 0] + a, p[0, 1] + b)
            m1 = np.logaddexp(p[1, 0] + a, p[1, 1] + b)
            sent[i] = m0, m1
            q = parents[i]
            up[q, 0] += m0
            up[q, 1] += m1
        full = up.copy()
        for i in range(1, len(nodes)):
            q = parents[i]
            a, b = full[q] - sent[i]  # the parent's belief without this child
            p = pair[i]
            full[i, 0] += np.logaddexp(p[0, 0] + a, p[1, 0] + b)
            full[i, 1] += np.logaddexp(p[0, 1] + a, p[1, 1] + b)
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -60, 60)))

    def extract(self, html: str | None, threshold: float = 0.5) -> str:
        nodes = parse(html or "")
        if len(nodes) == 1:
            return ""
        p = self.marginals(nodes)
        return "\n".join(n.text[0] for n, q in zip(nodes, p) if n.text and q > threshold)


def train(pages: list[tuple[str, list[str]]], passes: int = 400, ridge: float = 0.001) -> TreeModel:
    """A model from labelled pages: html and the texts of its content blocks in page order.

    A block is content if it is the next one of the page's texts; an element is content if most of its
    characters are. Pair potentials are smoothed log ratios of label counts of parents and children;
    feature weights then maximise the likelihood of each node given its parent's label.
    """
    xs, ks, ys, ps = [], [], [], []
    for html, texts in pages:
        nodes = parse(html)
        x, kinds = features(nodes)
        y = np.zeros(len(nodes), np.int64)
        good = np.zeros(len(nodes))
        want = 0
        for i, node in enumerate(nodes):
            if node.text and want < len(texts) and node.text[0] == texts[want]:
                y[i], want = 1, want + 1
                good[i] = node.chars
        for i in range(len(nodes) - 1, 0, -1):
            if not nodes[i].text:
                y[i] = good[i] > 0.5 * max(1, nodes[i].chars)
            good[nodes[i].parent] += good[i]
        y[0] = 1
        parents = np.array([n.parent for n in nodes])
        xs.append(x[1:])
        ks.append(kinds[1:])
        ys.append(y[1:])
        ps.append(y[parents[1:]])
    x, k, y, p = np.concatenate(xs), np.concatenate(ks), np.concatenate(ys), np.concatenate(ps)
    pair = np.zeros((len(KIND_NAMES), 2, 2))
    for kind in range(len(KIND_NAMES)):
        counts = np.full((2, 2), 1.0)
        np.add.at(counts, (p[k == kind], y[k == kind]), 1)
        # The child's share under a parent label against its share overall: what the parent adds.
        ratio = np.log(counts / counts.sum(axis=1, keepdims=True)) - np.log(counts.sum(axis=0) / counts.sum())
        pair[kind] = np.clip(ratio, -4, 4)
    offset = pair[k, p, 1] - pair[k, p, 0]
    w = np.zeros(x.shape[1])
    for _ in range(passes // 20):
        q = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        hess = (x.T * (q * (1 - q) + 1e-6)) @ x + ridge * len(y) / 100 * np.eye(x.shape[1])
        w += np.linalg.solve(hess, x.T @ (y - q) - ridge * len(y) / 100 * w)
    return TreeModel(w, pair)


# --- Labelled pages: layouts that sites use, filled with drawn words, so that every block's label is known.

_SYLLABLES = "ka lo mi ren tas ul ver son dal pe ri no sta en or the an der la que".split()
_NAV = "Home News Sport World Contact About Shop Blog Archive Help Login Kontakt Accueil Inicio Über Start Menu".split()
_NOTICES = ["We use cookies to improve your visit.", "This site uses cookies. Accept all", "Subscribe to keep reading.", "Your session has expired."]


class PageMaker:
    """Draws labelled pages of different layouts."""

    def __init__(self, seed: int = 11):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        text = " ".join(out)
        return text[:1].upper() + text[1:] + r.choice((".", ".", ".", "", "!", "?"))

    def box(self, names: tuple[str, ...], inner: str, tags=("div",)) -> str:
        r = self.r
        tag = r.choice(tags)
        attr = r.choice(("class", "class", "id"))
        name = r.choice(names)
        label = f' {attr}="{name}"' if tag in ("div", "section", "ul", "p") or r.random() < 0.5 else ""
        return f"<{tag}{label}>{inner}</{tag}>"

    def nav(self) -> str:
        items = "".join(f'<li><a href="/{i}">{self.r.choice(_NAV) if self.r.random() < 0.6 else self.words(1, 2)}</a></li>' for i in range(self.r.randint(2, 9)))
        return self.box(("menu", "nav", "navbar", "main-menu", "breadcrumbs"), f"<ul>{items}</ul>", ("nav", "nav", "div", "menu"))

    def boilerplate(self, inside: bool = False) -> str:
        r = self.r
        pick = r.choice((0, 1, 2, 3, 4, 5, 7)) if inside else r.randrange(9)
        if pick == 0:
            return self.box(("ad", "ads", "advert", "banner", "promo-box", "ad-slot"), r.choice((self.words(2, 40), f"<p>{self.words(5, 40)}</p>", self.words(3, 12) + "<br>" + self.words(2, 10))), ("div", "div", "aside", "section"))
        if pick == 1:
            return self.box(("sidebar", "related", "widget", "right-rail", "popular"), f"<h3>{self.words(1, 4)}</h3>" + "".join(r.choice((f"<p>{self.words(4, 30)}</p>", f'<p><a href="#">{self.words(3, 9)}</a></p>')) for _ in range(r.randint(1, 4))), ("aside", "aside", "div"))
        if pick == 2:
            return self.box(("cookie-notice", "consent", "notice", "gdpr-banner", "alert"), f"<p>{r.choice(_NOTICES) if r.random() < 0.5 else self.words(4, 30)}</p><button>{self.words(1, 2)}</button>", ("div", "div", "dialog", "section"))
        if pick == 3:
            return self.box(("comments", "comment-list", "disqus", "replies"), "".join(f'<div class="comment"><p>{self.words(3, 50)}</p></div>' for _ in range(r.randint(1, 5))), ("section", "div", "div"))
        if pick == 4:
            return f'<form action="/s"><label>{self.words(1, 3)}</label><input name="q"><p>{self.words(2, 12)}</p><button>{self.words(1, 2)}</button></form>'
        if pick == 5:
            return self.box(("share", "social", "newsletter", "subscribe"), "".join(f'<a href="#">{self.words(1, 2)}</a> ' for _ in range(r.randint(2, 5))) + r.choice(("", f"<p>{self.words(3, 15)}</p>")))
        if pick == 6:
            return f"<header><h2>{self.words(1, 4)}</h2><p>{self.words(2, 9)}</p></header>" if r.random() < 0.5 else self.box(("header", "masthead", "topbar"), f"<p>{self.words(1, 8)}</p>")
        if pick == 7:
            return f"<!-- {self.words(2, 6)} --><script>var a='<p>{self.words(2, 4)}</p>';</script><style>p{{margin:0}}</style>"
        return self.nav()

    def footer(self) -> str:
        inner = r"&copy; " + self.words(1, 3) + self.r.choice((" &middot; ", " | ", "<br>")) + self.words(2, 18)
        return self.box(("footer", "site-footer", "copyright"), self.r.choice((inner, f"<p>{inner}</p>")), ("footer", "footer", "div"))

    def body(self) -> tuple[str, list[str]]:
        """Content blocks as markup and as texts."""
        r, out, texts = self.r, [], []

        def block(tag: str, text: str, closed: bool = True, soup: bool = False):
            texts.append(text)
            shown = text
            if r.random() < 0.2:
                cut = shown.split(" ")
                i = r.randrange(len(cut))
                cut[i] = r.choice(("<b>{}</b>", "<em>{}</em>", '<a href="#">{}</a>')).format(cut[i])
                shown = " ".join(cut)
            out.append(f"<{tag}>{'<b>' if soup else ''}{shown}{'<br>' if soup else ''}{f'</{tag}>' if closed and not soup else ''}")

        if r.random() < 0.85:
            own = r.random() < 0.2
            out.append("<header>" if own else "")
            block("h1" if r.random() < 0.8 else "h2", self.words(1, 14))
            out.append("</header>" if own else "")
        for _ in range(r.choice((1, r.randint(1, 14), r.randint(1, 14), r.randint(1, 14)))):
            kind = r.random()
            if kind < 0.7:
                block("p", self.words(*r.choice(((1, 3), (3, 12), (12, 60), (60, 150)))), closed=r.random() < 0.8, soup=r.random() < 0.15)
            elif kind < 0.78:
                block("h2" if r.random() < 0.6 else "h3", self.words(1, 7))
            elif kind < 0.86:
                out.append("<ul>")
                for _ in range(r.randint(1, 5)):
                    block("li", self.words(1, 20))
                out.append("</ul>")
            elif kind < 0.92:
                block("blockquote", self.words(5, 40))
            elif kind < 0.95:
                block("pre", self.words(3, 20))
            else:
                out.append("<table><tr>")
                for _ in range(r.randint(1, 4)):
                    block("td", self.words(1, 6))
                out.append("</tr></table>")
            if r.random() < 0.05:
                out.append(self.boilerplate(inside=True))
            elif r.random() < 0.05:
                out.append(f"<p {r.choice(('style="display:none"', 'class="visually-hidden"', 'aria-hidden="hidden"'))}>{self.words(2, 12)}</p>")
        return "".join(out), texts

    def page(self) -> tuple[str, list[str]]:
        r = self.r
        inner, texts = self.body()
        wrap = r.randrange(7)
        if wrap < 3:
            inner = f"<article>{inner}</article>"
        elif wrap == 3:
            inner = f"<main>{inner}</main>"
        elif wrap == 4:
            inner = f'<main><article class="post">{inner}</article></main>'
        elif wrap == 5:
            inner = f'<div class="{r.choice(("content", "article-body", "post-content", "entry", "story", "main-text"))}">{inner}</div>'
        else:
            inner = f'<div id="wrap"><div class="col">{inner.replace("<header>", "").replace("</header>", "")}</div></div>'
        if r.random() < 0.25:
            inner = f'<div class="{r.choice(("container", "page", "wrapper", "row", "layout"))}">{inner}</div>'
        before = "".join(self.boilerplate() for _ in range(r.randint(0, 3)))
        after = "".join(self.boilerplate() for _ in range(r.randint(0, 3)))
        top = self.nav() if r.random() < 0.8 else ""
        end = self.footer() if r.random() < 0.85 else ""
        title = self.words(1, 8)
        everything = f"{top}{before}{inner}{after}{end}" if r.random() < 0.94 else inner
        if wrap != 6 and r.random() < 0.15:  # named after its parts
            everything = f'<div class="{r.choice(("with-sidebar", "has-header", "page menu-left"))}">{everything}</div>'
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body{r.choice(("", "", ' class="single has-sidebar"'))}>{everything}{r.choice(('</body></html>', ''))}", texts


def labelled_pages(n: int = 1000, seed: int = 11) -> list[tuple[str, list[str]]]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(n)]


def extract_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of (page_id, url, html)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(model or train(labelled_pages()))  # a few hundred numbers

    def run(batches):
        held = shipped.value
        for batch in batches:
            texts = [held.extract(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
