"""Main-text extraction from web pages by gradient-boosted trees over DOM nodes.

A page is cut into tags, comments and text; elements form a tree (void elements
and unclosed paragraphs, items and cells end as browsers end them; anything else
unclosed ends with its parent). Each element gets features of its subtree and
place: text and link density, tag and attribute tokens, depth, sibling and
position statistics, the nearest sectioning ancestor. A boosted ensemble of
small regression trees on the logistic loss, trained here in numpy, gives each
element the probability of being main content.

Hierarchical decoding then chooses, for the whole tree at once, the consistent
labelling of the largest likelihood: once an element is dropped, all below it
is dropped. An element's own text is kept if the element is.

The trees are trained on layouts: real sentences of a bounded sample of pages
are set into page layouts whose blocks' roles are known (articles, menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, link
lists), with class names, nesting and order drawn at random from a fixed seed.

Text: character references decoded, white space inside a block turned into one
space, trimmed, blocks joined in page order by a newline. Block elements (and
what they enclose) are blocks; br is white space.

Defined results: a null or empty page gives an empty text; repeated rows each
get a row; columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import hashed_sample, table
from almanac.llm.textops import buffers, slices

#: Pages whose sentences the training layouts are filled with; layouts drawn.
FIT_PAGES = 200
#: Most sentences that the layouts are filled with.
SENTENCES = 20_000
LAYOUTS = 900
ROUNDS = 60
DEPTH = 4

# Fixed values of HTML itself.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that never hold readable text.
HIDDEN = frozenset("script style noscript template svg iframe head textarea select option button input object audio video canvas map".split())
#: What a start tag ends: an open element of these names, up to one of those.
ENDS = {"p": ({"p"}, set()), "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Start tags that end an open paragraph.
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Tag groups and attribute tokens that are features.
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "td", "blockquote", "pre", "nav", "header", "footer", "aside", "form", "a", "span", "figure", "body"]
GOOD = frozenset("article articles body content entry main page post posts story stories text blog hentry prose".split())
BAD_GROUPS = [
    frozenset("comment comments commentlist disqus response responses discussion discuss reply replies respond feedback".split()),
    frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner outbrain taboola partner partners".split()),
    frozenset("nav navbar navigation menu submenu breadcrumb breadcrumbs crumbs pager pagination tabs toolbar skip".split()),
    frozenset("side sidebar widget widgets rail related recommended recommendations popular trending tags archive archives".split()),
    frozenset("foot footer copyright legal colophon credits".split()),
    frozenset("head header masthead logo brand topbar".split()),
    frozenset("cookie cookies consent notice alert popup modal overlay gdpr subscribe newsletter signup paywall".split()),
    frozenset("share sharing social follow form login search contact hidden".split()),
]
#: Words that decide a name wherever they stand in it ("related-posts", "comment-body"); else its last known word does ("share-story").
STRONG = BAD_GROUPS[0] | BAD_GROUPS[1] | frozenset("related recommended popular trending cookie cookies consent newsletter".split())
#: Names with these words tell a state of the page, not what an element is ("has-sidebar", "nav-open").
STATES = frozenset("has no with without is show hide js open opened closed active enabled disabled sticky fixed".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>|\Z)", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_END = re.compile(r"[.!?…:;]")


class Page:
    """Elements in document order, and the runs of text with their elements."""

    __slots__ = ("tag", "parent", "attrs", "texts", "owner", "last")

    def __init__(self, source: str):
        self.tag: list[str] = ["#page"]
        self.parent: list[int] = [-1]
        self.attrs: list[str] = [""]
        #: (element, text), text None where a block begins or ends.
        self.texts: list[tuple[int, str | None]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        tag, parent, attrs, texts = self.tag, self.parent, self.attrs, self.texts
        open_, at, n = [0], 0, len(source)
        opened: Counter[str] = Counter()  # open elements by name, so that tags without a partner cost nothing

        def end(k: int) -> None:
            """Close the open elements from place k on."""
            for e in open_[k:]:
                if tag[e] not in INLINE:
                    texts.append((parent[e], None))
                    break
            opened.subtract(tag[e] for e in open_[k:])
            del open_[k:]

        while at < n:
            m = _TOKEN.search(source, at)
            upto = m.start() if m else n
            if upto > at:
                texts.append((open_[-1], source[at:upto]))
            if not m:
                break
            at = m.end()
            token = m[0]
            name = _NAME.match(token)
            if not name:  # a comment or declaration
                continue
            t = name[1].lower()
            if token[1] == "/":
                for k in () if not opened[t] else range(len(open_) - 1, 0, -1):
                    if tag[open_[k]] == t:
                        end(k)
                        break
                    if tag[open_[k]] not in INLINE and t in INLINE:
                        break  # an inline end tag doesn't reach out of its block
                continue
            if t in CLOSES_P or t in ENDS:
                for names, stop in ((ENDS.get(t, (set(), set()))), ({"p"}, {"td", "th", "li", "table"}) if t in CLOSES_P else (set(), set())):
                    if not any(opened[x] for x in names):
                        continue
                    for k in range(len(open_) - 1, 0, -1):
                        if tag[open_[k]] in names:
                            end(k)
                            break
                        if tag[open_[k]] in stop or names == {"p"} and tag[open_[k]] not in INLINE:
                            break
            e = len(tag)
            tag.append(t)
            parent.append(open_[-1])
            attrs.append(token[name.end() : -1])
            if t not in INLINE:
                texts.append((e, None))
            elif t == "br":
                texts.append((parent[e], " "))
            if t in RAW:
                close = _RAW_END[t].search(source, at)
                if t == "title" or t == "textarea":
                    texts.append((e, source[at : close.start() if close else n]))
                at = close.end() if close else n
                texts.append((parent[e], None))
            elif t not in VOID and not token.endswith("/>"):
                open_.append(e)
                opened[t] += 1
            elif t == "hr":
                texts.append((parent[e], None))


#: Elements that are never dropped.
ROOTS = frozenset(["#page", "html", "body"])
N_FEATURES = 19 + len(TAGS) + 1 + len(BAD_GROUPS) + 4


_NO_GROUP = (0.0,) * len(BAD_GROUPS)


def _said(attrs: str) -> tuple[float, tuple[float, ...]]:
    """Whether the class, id and role have a good name, and those of the bad groups."""
    good, bad = 0.0, [0.0] * len(BAD_GROUPS)
    for k, v in _ATTR.findall(attrs):
        if k.lower() not in ("class", "id", "role"):
            continue
        for name in v.strip("\"'").split():
            words = [w.lower() for w in _WORD.findall(name)]
            if STATES.intersection(words):
                continue
            for w in [w for w in words if w in STRONG] or words[::-1]:
                group = next((g for g, known in enumerate(BAD_GROUPS) if w in known), None)
                if group is not None:
                    bad[group] = 1.0
                elif w in GOOD:
                    good = 1.0
                else:
                    continue
                break
    return (good, tuple(bad)) if good or any(bad) else (0.0, _NO_GROUP)


def features(page: Page) -> np.ndarray:
    """A row for each element."""
    tags, parents = page.tag, page.parent
    n = len(tags)
    zeros = lambda: [0.0] * n  # noqa: E731  plain lists: elements are few and visited one by one
    own, words, stops, links, kids, below, paragraphs, items, nth = (zeros() for _ in range(9))
    depth, good, sure = zeros(), zeros(), zeros()
    bad, section = [_NO_GROUP] * n, [(0.0, 0.0, 0.0, 0.0)] * n
    in_link, hidden = [False] * n, [False] * n
    for e in range(1, n):
        p, t = parents[e], tags[e]
        in_link[e] = in_link[p] or t == "a"
        hidden[e] = hidden[p] or t in HIDDEN
        depth[e] = depth[p] + 1
        nth[e] = kids[p]
        kids[p] += 1
        sure[e] = sure[p]
        if page.attrs[e] and t not in ROOTS:  # a root's names tell of the page as a whole
            good[e], bad[e] = _said(page.attrs[e])
            if bad[e] is not _NO_GROUP and not good[e] and t not in ("article", "main"):
                sure[e] = max(sure[p], *bad[e])
        own_, side, edge, fine = section[p]
        if t in ("article", "main"):
            own_ = 1.0
        elif t in ("nav", "aside", "form", "menu"):
            side = 1.0
        elif t in ("header", "footer"):
            edge = 1.0
        section[e] = (own_, side, edge, max(fine, good[e]))
    for e, text in page.texts:
        if text and not hidden[e]:
            size = len(text.split())
            if size:
                own[e] += len(text)
                words[e] += size
                stops[e] += len(_END.findall(text))
                if in_link[e]:
                    links[e] += size
    before, total = zeros(), 0.0
    for e in range(n):
        before[e] = total
        total += words[e]
    chars = own.copy()
    for e in range(n - 1, 0, -1):
        p, t = parents[e], tags[e]
        chars[p] += chars[e]
        words[p] += words[e]
        stops[p] += stops[e]
        links[p] += links[e]
        below[p] += below[e] + 1
        paragraphs[p] += paragraphs[e] + (t == "p")
        items[p] += items[e] + (t == "li")
    chars, words, own, stops, links, kids, below, paragraphs, items, nth, depth, before, parent = (np.array(v) for v in (chars, words, own, stops, links, kids, below, paragraphs, items, nth, depth, before, parents))
    some, total = np.maximum(words, 1), max(1.0, total)
    sib = np.where(parent >= 0, kids[parent], 1)
    brothers = np.where(parent >= 0, words[parent], words) - words
    out = np.zeros((n, N_FEATURES), np.float32)
    for k, v in enumerate((np.log1p(chars), np.log1p(words), np.log1p(own), stops / some, links / some, words / (below + 1), depth, kids, nth, nth / np.maximum(sib, 1), sib, words / total, before / total, np.log1p(brothers), paragraphs, items, np.log1p(stops), hidden, sure)):
        out[:, k] = v
    at = [_TAG_AT.get(t, -1) for t in tags]
    rows = [e for e in range(n) if at[e] >= 0]
    out[rows, [19 + at[e] for e in rows]] = 1
    k = 19 + len(TAGS)
    out[:, k] = good
    out[:, k + 1 : k + 1 + len(BAD_GROUPS)] = bad
    out[:, k + 1 + len(BAD_GROUPS) :] = section
    return out


_TAG_AT = {t: k for k, t in enumerate(TAGS)}


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, on quantile bins."""

    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = 0.2, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        p = np.average(y, weights=weight)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = weight * (y - q), weight * np.maximum(q * (1 - q), 1e-6)
            feature, at, value = self._tree(binned, g, h)
            self.trees.append((feature, at, value))
            f += self._walk(x, feature, at, value)
        return self

    def _tree(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        size = 2 ** (self.depth + 1)
        feature, at, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.ones(len(g), np.int64)
        for k in range(1, size):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            G, H = g[rows].sum(), h[rows].sum()
            value[k] = self.rate * G / (H + 1)
            if k >= size // 2 or len(rows) < 20:
                continue
            best, part = (1e-3, -1, 0), binned[rows]
            for j, cuts in enumerate(self.cuts):
                if not len(cuts):
                    continue
                gl = np.cumsum(np.bincount(part[:, j], g[rows], len(cuts) + 1))[:-1]
                hl = np.cumsum(np.bincount(part[:, j], h[rows], len(cuts) + 1))[:-1]
                gain = np.where((hl > 1e-3) & (H - hl > 1e-3), gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1), -1)
                if gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
            if best[1] >= 0:
                feature[k], at[k] = best[1], self.cuts[best[1]][best[2]]
                node[rows] = 2 * k + (part[:, best[1]] > best[2])
        return feature, at, value

    def _walk(self, x: np.ndarray, feature: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            j = feature[node]
            node = np.where(j >= 0, 2 * node + (x[rows, np.maximum(j, 0)] > at[node]), node)
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log odds of being main content."""
        return self.start + sum((self._walk(x, *t) for t in self.trees), np.zeros(len(x)))


#: Weight of the log odds of an element without text of its own.
WRAPPER = 0.25


def decode(page: Page, margin: np.ndarray) -> list[bool]:
    """The consistent labelling of the largest likelihood: kept elements have kept parents.

    With log odds m, a kept element adds m to the likelihood against dropping
    it; so its best is m plus its children's bests, or 0 with all dropped. An
    element without text of its own counts by ``WRAPPER`` only, as its children say
    more. The page's roots are always kept.
    """
    n, parent = len(page.tag), page.parent
    own = [False] * n
    for e, text in page.texts:
        if text and not text.isspace():
            own[e] = True
    best = [m if o else WRAPPER * m for m, o in zip(margin.tolist(), own, strict=True)]
    for e in range(n - 1, 0, -1):
        if page.tag[e] in HIDDEN:
            best[e] = 0.0
        elif best[e] > 0:
            best[parent[e]] += best[e]
    keep = [True] * n
    for e in range(1, n):
        keep[e] = keep[parent[e]] and (best[e] > 0 or page.tag[e] in ROOTS)
    return keep


def main_text(page: Page, keep: list[bool]) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            blocks.append(text)
        run.clear()

    for e, text in page.texts:
        if text is None:
            flush()
        elif keep[e]:
            run.append(_html.unescape(text))
    flush()
    return "\n".join(blocks)


class Layouts:
    """Pages whose elements' roles are known: data-k is 1 for what is, or holds, main content."""

    GOOD = ["content", "main-content", "post", "post-body", "entry-content", "article-body", "story", "page-content", "text", "blog-post"]
    BAD = {
        "nav": ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "pagination", "toolbar"],
        "header": ["header", "masthead", "site-header", "logo", "topbar"],
        "footer": ["footer", "site-footer", "copyright", "legal", "colophon"],
        "side": ["sidebar", "widget", "related", "recommended", "popular-posts", "rail", "trending", "tags"],
        "notice": ["cookie-notice", "consent", "alert", "popup", "gdpr", "newsletter", "subscribe", "modal", "notice"],
        "ad": ["ad", "ads", "advert", "sponsored", "banner", "promo", "ad-slot", "advertisement"],
        "form": ["search", "login", "contact-form", "signup"],
        "comments": ["comments", "comment-list", "responses", "disqus_thread", "discussion", "user-comments"],
        "share": ["share", "social", "share-links", "follow-us"],
    }

    def __init__(self, sentences: list[str], seed: int = 3):
        self.sentences, self.rng = sentences or ["Lorem ipsum dolor sit amet."], np.random.default_rng(seed)

    def one(self, of: list):
        return of[int(self.rng.integers(len(of)))]

    def some(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, n: int) -> str:
        return " ".join(self.one(self.sentences).split()[:n]) or "x"

    def prose(self, lo: int = 1, hi: int = 5) -> str:
        text = " ".join(self.one(self.sentences) for _ in range(int(self.rng.integers(lo, hi + 1))))
        return text + " &copy; &amp; &#8212;" if self.some(0.05) else text

    def el(self, name: str, k: int, inner: str, said: str = "") -> str:
        how = self.one(["class", "class", "id"])
        return f'<{name} data-k="{k}"' + (f' {how}="{said}"' if said else "") + f">{inner}</{name}>"

    def links(self, k: int, lo: int = 2, hi: int = 9) -> str:
        return self.el(self.one(["ul", "ul", "ol"]), k, "".join(self.el("li", k, self.el("a", k, self.words(int(self.rng.integers(1, 6))))) for _ in range(int(self.rng.integers(lo, hi)))))

    def noise(self, role: str) -> str:
        said = self.one(self.BAD[role])
        div = self.one(["div", "section", "div"])
        if role == "nav":
            name, inner = self.one(["nav", "div", "ul"]), self.links(0)
            return self.el("nav", 0, inner) if self.some(0.4) else self.el("div" if name == "ul" else name, 0, inner, said)
        if role == "header":
            inner = self.el(self.one(["a", "h2", "p", "span"]), 0, self.words(4)) + (self.noise("nav") if self.some(0.5) else "")
            return self.el("header", 0, inner) if self.some(0.5) else self.el("div", 0, inner, said)
        if role == "footer":
            inner = self.one(["&copy; 2024 ", "", "&copy; site.example &middot; "]) + (self.words(int(self.rng.integers(2, 10))) if self.some(0.5) else self.el("p", 0, self.prose(1, 2))) + (self.links(0) if self.some(0.4) else "")
            return self.el("footer", 0, inner) if self.some(0.7) else self.el("div", 0, inner, said)
        if role == "side":
            inner = "".join(self.el("h3", 0, self.words(3)) + (self.links(0) if self.some(0.6) else self.el("p", 0, self.prose(1, 2))) for _ in range(int(self.rng.integers(1, 4))))
            return self.el("aside", 0, inner) if self.some(0.4) else self.el("div", 0, inner, said)
        if role == "notice":
            return self.el(div, 0, self.el("p", 0, self.prose(1, 2)) + (self.el("button", 0, "OK") if self.some(0.6) else self.el("a", 0, "OK")) if self.some(0.7) else self.prose(1, 2), said)
        if role == "ad":
            return self.el(self.one(["div", "div", "section", "aside"]), 0, self.prose(1, 2) if self.some(0.6) else self.el("p", 0, self.prose(1, 1)) + self.el("a", 0, self.words(3)), said)
        if role == "form":
            inner = "".join(self.el("label", 0, self.words(2)) + '<input data-k="0">' for _ in range(int(self.rng.integers(1, 4)))) + self.el("button", 0, "Send")
            return self.el("form", 0, self.el("p", 0, self.words(6)) * self.some(0.4) + inner, said * self.some(0.5))
        if role == "share":
            return self.el("div", 0, "".join(self.el("a", 0, self.words(1)) for _ in range(3)), said)
        inner = self.el(self.one(["h2", "h3"]), 0, self.words(2)) * self.some(0.7)
        for _ in range(int(self.rng.integers(1, 7))):
            who = self.el(self.one(["span", "b", "h4", "p"]), 0, self.words(2), self.one(["author", "user", ""]))
            inner += self.el(self.one(["div", "li", "article"]), 0, who + (self.el("p", 0, self.prose(1, 3)) if self.some(0.8) else self.prose(1, 3)), self.one(["comment", "reply", "comment-body", ""]))
        return self.el(div, 0, inner + (self.noise("form") if self.some(0.3) else ""), said)

    def misled(self) -> str:
        """Names of main content that have a bad word in them."""
        bad = self.one(self.BAD[self.one(["nav", "header", "footer", "side", "share"])])
        return self.one([f"{bad}-{self.one(self.GOOD)}", f"{self.one(self.GOOD)} {bad}", f"{self.one(self.GOOD)} with-{bad}"])

    def body(self) -> str:
        """Blocks of an article."""
        out = self.el(self.one(["h1", "h1", "h2"]), 1, self.words(int(self.rng.integers(1, 11)))) * self.some(0.9)
        if self.some(0.25):
            out = self.el("header", 1, out + self.el("p", 1, self.words(8), self.one(["subtitle", "lead", ""])) * self.some(0.6), f"{self.one(self.GOOD)}-header" if self.some(0.4) else "")
        for _ in range(int(self.rng.integers(0, 3 if self.some(0.3) else 14))):
            pick = self.rng.random()
            if pick < 0.62:
                inner = self.prose(1, 5) if self.some(0.85) else self.words(3)
                out += self.el("p", 1, inner + (" " + self.el(self.one(["a", "b", "em"]), 1, self.words(3)) + " " + self.words(5)) * self.some(0.25))
            elif pick < 0.7:
                out += f'<p data-k="1"><b data-k="1">{self.words(9)}<br>'
            elif pick < 0.78:
                out += self.el(self.one(["h2", "h3"]), 1, self.words(6))
            elif pick < 0.84:
                out += self.el(self.one(["ul", "ol"]), 1, "".join(self.el("li", 1, self.words(12)) for _ in range(int(self.rng.integers(2, 6)))))
            elif pick < 0.88:
                out += self.el("blockquote", 1, self.el("p", 1, self.prose(1, 2)) if self.some(0.5) else self.prose(1, 2))
            elif pick < 0.91:
                out += self.el("table", 1, "".join(self.el("tr", 1, self.el("td", 1, self.words(3)) * 2) for _ in range(3)))
            elif pick < 0.94:
                out += self.el("figure", 1, '<img data-k="1">' + self.el("figcaption", 1, self.words(8)))
            elif pick < 0.97:
                out += self.el("div", 1, self.el("p", 1, self.prose(1, 4)))
            else:
                out += self.noise(self.one(["ad", "share", "side", "notice", "form"]))
        return out

    def page(self) -> str:
        how = self.rng.random()
        body = self.body()
        if how < 0.5:
            main = self.el("article", 1, body, self.one(["", "", *self.GOOD]) if self.some(0.85) else self.misled())
        elif how < 0.65:
            main = self.el("main", 1, body, self.one(["", *self.GOOD]))
        elif how < 0.95:
            main = self.el(self.one(["div", "section", "td"]), 1, body, self.one(self.GOOD + ["", ""]))
            main = self.el("table", 1, self.el("tr", 1, main)) if main.startswith("<td") else main
        else:
            main = body
        if self.some(0.25):
            main = self.el(self.one(["main", "div", "section"]), 1, main + self.noise(self.one(["comments", "side", "share"])) * self.some(0.5), self.one(["", "", "container", *self.GOOD]))
        above = [self.noise(r) for r in ("notice", "header", "nav", "ad", "form", "side", "share") if self.some(0.4)]
        below = [self.noise(r) for r in ("comments", "side", "ad", "notice", "form", "nav", "share") if self.some(0.35)]
        if self.some(0.85):
            below.append(self.noise("footer"))
        if self.some(0.12):  # columns of a table or of plain boxes, without names
            row, cell = self.one([("tr", "td"), ("div", "div")])
            columns = [self.el(cell, 0, self.links(0, 3, 12) if self.some(0.7) else " ".join(self.el("a", 0, self.words(1)) for _ in range(int(self.rng.integers(3, 9))))), self.el(cell, 1, main)]
            main = self.el(row, 1, "".join(columns if self.some(0.7) else columns[::-1]))
            main = self.el("table", 1, main) if row == "tr" else main
        if self.some(0.3):
            above.append(self.el("div", 0, " ".join(self.el(self.one(["a", "a", "span"]), 0, self.words(1)) for _ in range(int(self.rng.integers(3, 9))))))
        if self.some(0.2):
            below.append(self.el(self.one(["div", "p"]), 0, self.one([" | ", " \u00b7 ", " - "]).join(self.words(int(self.rng.integers(1, 3))) for _ in range(int(self.rng.integers(2, 6))))))
        inside = "".join(above) + main + "".join(below)
        if self.some(0.3):
            inside = self.el("div", 1, inside, self.one(["wrapper", "container", "site", "page", self.misled()]))
        return f'<html data-k="1"><head data-k="0"><title data-k="0">{self.words(8)}</title></head><body data-k="1">{inside}</body></html>'


_ROLE = re.compile(r'data-k="([01])"')


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES, layouts: int = LAYOUTS, sentences: int = SENTENCES) -> Boosted:
    """The trees, trained on layouts filled with ``sentences`` sentences, by hash, of ``fit_pages`` pages."""
    some = hashed_sample(pages.where("html is not null"), F.col("page_id"), fit_pages, pages.count())
    plain = F.regexp_replace(F.col("html").cast("string"), r"(?s)<(script|style)\b.*?</\1>|<[^>]*+>", "\n")
    said = some.select(F.explode(F.split(plain, r"\n|(?<=[.!?])\s")).alias("s")).select(F.trim("s").alias("s")).where(r"s rlike '\\S\\s+\\S'").distinct()
    rows = said.orderBy(F.xxhash64("s"), "s").limit(sentences).collect()  # bounded
    sentences_ = sorted({_html.escape(_html.unescape(r.s), quote=False) for r in rows})
    draw = Layouts(sentences_)
    xs, ys = [], []
    for _ in range(layouts):
        page = Page(draw.page())
        role = [m[1] == "1" if (m := _ROLE.search(a)) else None for a in page.attrs]
        rows_ = [e for e, r in enumerate(role) if r is not None]
        xs.append(features(page)[rows_])
        ys.append(np.array([role[e] for e in rows_], float))
    x, y = np.concatenate(xs), np.concatenate(ys)
    return Boosted().fit(x, y, np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())))


def extract(pages: DataFrame, model: Boosted) -> DataFrame:
    """page_id, url and the main text of every page."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            data, offsets = buffers(batch.column("html"))
            for lo, hi in slices(offsets):  # the features of a byte of html may take 14 bytes
                parsed = [Page(data[a:b].tobytes().decode()) for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
                margins = model.margin(np.concatenate([features(p) for p in parsed]))
                at = np.cumsum([0] + [len(p.tag) for p in parsed])
                texts += [main_text(p, decode(p, margins[a:b])) for p, a, b in zip(parsed, at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts}, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())]))

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(extracted, "page_id long, url string, text string")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
