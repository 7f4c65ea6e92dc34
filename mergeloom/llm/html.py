"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

Nodes are block elements and the runs of text in them. Trees score each node from
its tags, attribute words, depth, text density of its subtree and its siblings.
Decoding then takes the most likely labelling in which no node is kept below one
that is dropped: a dropped node takes all of its subtree along. The text is that
of the kept runs, in page order.

The trees are trained on pages that `training_pages` writes, whose layouts vary
in the elements and names that pages use for articles and for what stands around
them; nothing is learned from the pages to be read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of pages that a task reads at once, or one longer page.
PAGES_CHARS = 1 << 22
#: The last alternatives take a tag with a stray quote up to the first >, and one that the page breaks off in.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PART = re.compile(r"[a-z]+")
#: Elements by how they are read.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
UNREAD = frozenset("script style template noscript iframe svg object head title textarea select button canvas audio video math".split())
#: Of the unread, those whose content is text up to their end tag, and those that run to the end of the page without one.
RAW = frozenset("script style title textarea iframe noscript".split())
ENDLESS = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening element ends an open one of these, up to one of those.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_BLOCK = re.compile(r"</?(?:" + "|".join(sorted(BLOCKS, key=lambda t: (-len(t), t))) + r")(?=[\s/>])", re.I)
TAGS = ("#text", "article", "aside", "blockquote", "div", "figure", "footer", "form", "h1", "h2", "header", "li", "main", "nav", "p", "section", "table", "ul")


def _after(tag: str, source: str, at: int) -> int:
    """Where the page goes on behind an unread element that opens before at.

    Elements of one name may be nested, but not in raw text. One without an end holds
    what stands before the next block element, so that it takes no more of the page along.
    """
    depth = 1
    for m in _edges(tag).finditer(source, at):
        depth += -1 if m[1] else tag not in RAW
        if not depth:
            return m.end()
    if tag in ENDLESS:
        return len(source)
    if tag == "head":
        return at
    m = _BLOCK.search(source, at)
    return m.start() if m else len(source)


@cache
def _edges(tag: str) -> re.Pattern:
    return re.compile(rf"<(/)?{tag}(?=[\s/>])[^>]*>", re.I)


class Page:
    """The nodes of a page, parents first: tag, names, parent, and text for runs."""

    def __init__(self, source: str) -> None:
        self.tag: list[str] = ["#root"]
        self.names: list[tuple[str, ...]] = [()]
        self.parent: list[int] = [-1]
        self.text: list[str] = [""]
        self.links: list[int] = [0]
        self.truth: list[int] = [-1]
        self._read(source)

    def _add(self, tag: str, names: tuple[str, ...], parent: int, text: str = "", links: int = 0) -> int:
        self.tag.append(tag)
        self.names.append(names)
        self.parent.append(parent)
        self.text.append(text)
        self.links.append(links)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack, run, link, linked = [0], [], 0, 0
        at = 0

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                run.clear()
                if text:
                    self._add("#text", (), stack[-1], text, min(linked, len(text)))
            linked = 0

        while True:
            m = TOKEN.search(source, at)
            text = source[at : m.start()] if m else source[at:]
            if text:
                run.append(text)
                if link:
                    linked += len(text)
            if not m:
                break
            at = m.end()
            end, start, given = m[1], m[2] or m[4], m[3] or m[5] or ""
            if start:
                tag = start.lower()
                if tag in UNREAD:
                    if not given.endswith("/") or tag in ENDLESS:
                        at = _after(tag, source, at)
                elif tag in BLOCKS:
                    flush()
                    link = 0
                    self._close_for(tag, stack)
                    if tag in ("html", "body") and any(self.tag[i] == tag for i in stack):
                        continue
                    names = tuple(w for a in ATTRIBUTE.finditer(given) for w in PART.findall((a[2] or a[3] or a[4] or "").lower())) if given else ()
                    i = self._add(tag, names, stack[-1])
                    if tag not in VOID and not given.endswith("/"):
                        stack.append(i)
                elif tag == "br":
                    run.append(" ")
                elif tag == "a":
                    link = 1
            elif end:
                tag = end.lower()
                if tag in BLOCKS:
                    flush()
                    link = 0
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == tag:
                            del stack[k:]
                            break
                elif tag == "a":
                    link = 0
                elif tag == "br":
                    run.append(" ")
        flush()

    def _close_for(self, tag: str, stack: list[int]) -> None:
        if self.tag[stack[-1]] == "p":
            stack.pop()
        if tag in ENDS:
            which, fence = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[k]]
                if t in fence:
                    return
                if t in which:
                    del stack[k:]
                    return


@dataclass
class Model:
    """Log-odds of names, bin edges of features, and trees of a fixed depth."""

    odds: dict[str, float]
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    depth: int
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out


def features(pages: list[Page], odds: dict[str, float]) -> np.ndarray:
    """A row for each node of all pages, in order."""
    blocks = []
    tag_no = {t: i for i, t in enumerate(TAGS)}
    for page in pages:
        n = len(page.tag)
        parent = np.array(page.parent)
        own = np.array([len(t) for t in page.text], float)
        is_text = np.array([t == "#text" for t in page.tag])
        chars, links, nodes, texts = own.copy(), np.array(page.links, float), np.ones(n), is_text.astype(float)
        stops = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in page.text], float)
        paras = np.array([float(t == "p") for t in page.tag])
        for i in range(n - 1, 0, -1):  # children come after their parents
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            nodes[p] += nodes[i]
            texts[p] += texts[i]
            stops[p] += stops[i]
            paras[p] += paras[i]
        name = np.array([min((odds.get(w, 0.0) for w in ws), default=0.0) for ws in page.names])
        good = np.array([max((odds.get(w, 0.0) for w in ws), default=0.0) for ws in page.names])
        tag = np.array([odds.get("<" + t, 0.0) for t in page.tag])
        depth, worst, best, worst_tag, best_tag = np.zeros(n), name.copy(), good.copy(), tag.copy(), tag.copy()
        order, count = np.zeros(n), np.zeros(n)
        sib_chars, sib_links = np.zeros(n), np.zeros(n)
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            worst[i], best[i] = min(name[i], worst[p]), max(good[i], best[p])
            worst_tag[i], best_tag[i] = min(tag[i], worst_tag[p]), max(tag[i], best_tag[p])
            order[i] = count[p]
            count[p] += 1
            sib_chars[p] = max(sib_chars[p], chars[i])
            sib_links[p] += links[i]
        up = np.maximum(parent, 0)
        kind = np.array([tag_no.get(t, len(TAGS)) for t in page.tag])
        hot = np.zeros((n, len(TAGS) + 1))
        hot[np.arange(n), kind] = 1
        before = np.cumsum(own) - own
        total = max(1.0, own.sum())
        cols = [name, good, tag, worst, best, worst_tag, best_tag, depth, np.log1p(chars), links / np.maximum(chars, 1), np.log1p(chars / nodes), np.log1p(chars / np.maximum(texts, 1)), np.log1p(nodes), stops / np.maximum(chars, 1), np.log1p(paras), chars / total, before / total, order, count[up], chars / np.maximum(sib_chars[up], 1), np.log1p(chars[up]), links[up] / np.maximum(chars[up], 1), name[up], tag[up]]
        blocks.append(np.hstack([np.stack(cols, 1), hot]))
    return np.concatenate(blocks) if blocks else np.zeros((0, 24 + len(TAGS) + 1))


def decode(page: Page, margin: np.ndarray) -> list[bool]:
    """The most likely labelling in which what is below a dropped node is dropped."""
    n = len(page.tag)
    keep_gain = -np.logaddexp(0, -margin)  # log P(kept)
    drop_gain = -np.logaddexp(0, margin)
    drop, best = drop_gain.copy(), keep_gain.copy()
    keep_gain[0] = best[0] = 0.0
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        drop[p] += drop[i]
        best[p] += max(best[i], drop[i])
    kept = [False] * n
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and bool(best[i] > drop[i])
    return kept


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Gradient boosting of depth-wise trees on binned features with logistic loss."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], 1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    f, inner = np.full(n, base), 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best_gain, best_f, best_b = np.full(wide, 1e-3), np.zeros(wide, np.int64), np.full(wide, -1)
            local = node - first
            for j in range(d):
                if not len(edges[j]):
                    continue
                m = len(edges[j]) + 1
                at = local * m + binned[:, j]
                gs = np.bincount(at, g, wide * m).reshape(wide, m).cumsum(1)
                hs = np.bincount(at, h, wide * m).reshape(wide, m).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                gain[(hs < 2) | (ha - hs < 2)] = 0
                b = gain[:, :-1].argmax(1)
                better = gain[np.arange(wide), b] > best_gain
                best_gain[better], best_f[better], best_b[better] = gain[np.arange(wide), b][better], j, b[better]
            for k in range(wide):
                feature[t, first + k] = best_f[k]
                cut[t, first + k] = edges[best_f[k]][best_b[k]] if best_b[k] >= 0 else np.inf
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        local = node - inner
        v = rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + 1)
        leaf[t] = v
        f += v[local]
    return feature, cut, leaf, base


#: What pages name the parts that stand around an article, and the article.
AROUND = {
    "menu": (("nav", "div", "ul", "header"), ("nav", "menu", "navbar", "navigation", "topbar", "breadcrumb", "toolbar", "site-nav", "main-menu")),
    "head": (("header", "div"), ("header", "masthead", "banner", "site-header", "logo", "branding")),
    "side": (("aside", "div", "section"), ("sidebar", "aside", "widget", "rail", "side", "related", "recommended", "popular", "trending")),
    "notice": (("div", "section", "aside", "dialog"), ("cookie", "notice", "consent", "gdpr", "banner", "alert", "popup", "modal", "overlay", "paywall")),
    "advert": (("div", "aside", "section", "figure"), ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "adsense")),
    "form": (("form", "div", "section"), ("form", "search", "newsletter", "subscribe", "signup", "login", "contact")),
    "talk": (("section", "div", "ol", "aside"), ("comments", "comment", "comment-list", "discussion", "replies", "reply", "respond", "disqus")),
    "share": (("div", "ul", "section"), ("share", "social", "sharing", "tags", "meta", "byline", "pagination", "pager", "tools")),
    "foot": (("footer", "div", "section"), ("footer", "site-footer", "copyright", "legal", "colophon", "bottom")),
}
MAIN = (("article", "article", "article", "main", "div", "section", "div"), ("article", "content", "post", "entry", "main", "story", "body", "post-content", "entry-content", "text", ""))


def training_pages(n: int = 500, seed: int = 7) -> list[tuple[str, str]]:
    """n pages of varied layouts, and the main text of each."""
    r = random.Random(seed)
    syllables = [a + b for a in "b c d f g l m n p r s t v th st ch".split() for b in "a e i o u an en er on ing".split()]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def sentence(a: int = 3, b: int = 22) -> str:
        ws = [word() for _ in range(r.randint(a, b))]
        for i in range(len(ws) - 1):
            if r.random() < 0.08:
                ws[i] += ","
        return " ".join(ws).capitalize() + r.choice("....!?")

    def heading(a: int, b: int) -> str:
        text = sentence(a, b)
        return text if r.random() < 0.3 else text[: r.randint(12, 70)].rstrip(" .!?,") or text

    def inline(text: str) -> str:
        if r.random() < 0.3:
            ws = text.split()
            i = r.randrange(len(ws))
            t = r.choice(("b", "i", "em", "strong", "a href='/x'", "span"))
            ws[i] = f"<{t}>{ws[i]}</{t.split()[0]}>"
            return " ".join(ws)
        return text

    def attributes(names: tuple[str, ...]) -> str:
        name = r.choice(names)
        if not name or r.random() < 0.25:
            return ""
        return f' {r.choice(("class", "class", "id"))}="{name}{r.choice(("", "", "-" + word(), " " + word()))}"'

    def around(kind: str) -> str:
        tags, names = AROUND[kind]
        t = r.choice(tags)
        a = attributes(names)
        if t in ("div", "section", "figure", "ul", "ol", "dialog") and not a:
            a = f' class="{r.choice(names)}"'
        if kind in ("menu", "share") or kind in ("side", "foot") and r.random() < 0.4:
            items = "".join(f"<li><a href='/{word()}'>{' '.join(word() for _ in range(r.randint(1, 3)))}</a></li>" for _ in range(r.randint(2, 9)))
            body = items if t in ("ul", "ol") else f"<ul>{items}</ul>" if r.random() < 0.7 else re.sub(r"</?li>", " ", items)
        elif kind == "form":
            body = f"<label>{word()}</label><input name='q'><p>{sentence(2, 8)}</p><button>{word()}</button>"
        elif kind == "talk":
            body = f"<h3>{word()}</h3>" + "".join(f'<div class="{r.choice(("comment", "reply", word()))}"><p>{sentence()}</p></div>' for _ in range(r.randint(1, 5)))
        elif kind == "foot":
            body = f"&copy; {word()} &middot; {sentence(2, 10)}"
        else:
            body = r.choice(("{}", "<p>{}</p>", "<span>{}</span>", "<h3>x</h3><p>{}</p>")).format(" ".join(sentence() for _ in range(r.randint(1, 2))))
        return f"<{t}{a}>{body}</{t}>"

    def article() -> tuple[str, list[str]]:
        parts, texts = [], []

        def put(t: str, text: str) -> None:
            parts.append(f"<{t}>{inline(text)}" + (f"</{t}>" if t != "p" or r.random() < 0.85 else r.choice(("", "<br>"))))
            texts.append(text)

        if r.random() < 0.8:
            put("h1", heading(1, 14))
        for _ in range(r.choice((0, 1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.75:
                put("p", " ".join(sentence() for _ in range(r.choice((1, 1, 2, 4, 7)))))
            elif kind < 0.82:
                put(r.choice(("h2", "h3")), heading(1, 6))
            elif kind < 0.88:
                items = [heading(1, 9) for _ in range(r.randint(2, 5))]
                parts.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
                texts.extend(items)
            elif kind < 0.93:
                q = sentence()
                parts.append(f"<blockquote><p>{q}</p></blockquote>")
                texts.append(q)
            elif kind < 0.96:
                c = sentence(2, 8)
                parts.append(f"<figure><img src='x'><figcaption>{c}</figcaption></figure>")
                texts.append(c)
            elif r.random() < 0.6:
                parts.append(around(r.choice(("advert", "share", "side"))))
        if not texts or r.random() < 0.1:
            put("p", heading(1, 12))
        return "".join(parts), texts

    out = []
    for _ in range(n):
        body, texts = article()
        t = r.choice(MAIN[0])
        a = attributes(MAIN[1])
        if t in ("div", "section") and not a:
            a = f' class="{r.choice(MAIN[1][1:-1])}"'
        main = f"<{t}{a}>{body}</{t}>"
        if r.random() < 0.2:
            main = f"<{r.choice(('div', 'main'))}{attributes(('wrap', 'page', 'container', 'content'))}>{main}"
        top = [around(k) for k in ("menu", "head", "advert", "notice", "form", "side") if r.random() < 0.45]
        low = [around(k) for k in ("share", "talk", "side", "advert", "foot", "form", "foot") if r.random() < 0.4]
        r.shuffle(top)
        page = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{''.join(top)}<!-- x -->{main}{''.join(low)}" + r.choice(("</body></html>", "", "</html>"))
        out.append((page, " ".join(texts)))
    return out


def _marked(page: Page, truth: str) -> np.ndarray:
    """1 for runs of the main text, taken in order, and for what holds one."""
    y, at = np.zeros(len(page.tag)), 0
    for i, t in enumerate(page.text):
        if t and truth.startswith(t, at):
            y[i], at = 1, at + len(t) + 1
    for i in range(len(y) - 1, 0, -1):
        if y[i]:
            y[page.parent[i]] = 1
    return y


def train(n: int = 500, seed: int = 7) -> Model:
    """Fits the trees on training_pages(n, seed)."""
    pages, ys = [], []
    for source, truth in training_pages(n, seed):
        page = Page(source)
        pages.append(page)
        ys.append(_marked(page, truth))
    seen: dict[str, list[float]] = {}
    for page, y in zip(pages, ys, strict=True):
        for tag, names, v in zip(page.tag, page.names, y, strict=True):
            for w in {*names, "<" + tag}:
                k = seen.setdefault(w, [0.0, 0.0])
                k[int(v)] += 1
    odds = {w: float(np.log((b + 1) / (a + 1))) for w, (a, b) in seen.items() if a + b >= 5}
    x, y = features(pages, odds), np.concatenate(ys)
    feature, cut, leaf, base = boosted(x, y)
    return Model(odds, feature, cut, leaf, int(np.log2(leaf.shape[1])), base)


def extract(sources: list[str], model: Model) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    margin = model.predict(features(pages, model.odds))
    out, at = [], 0
    for page in pages:
        kept = decode(page, margin[at : at + len(page.tag)])
        at += len(page.tag)
        out.append(" ".join(t for t, k in zip(page.text, kept, strict=True) if t and k))
    return out


def extracted(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages.

    Null and empty pages, and pages without a kept run, have the empty text. Unclosed and
    stray tags are read as browsers do where it matters here; no tag is ever text. Rows
    with null or repeated ids and urls are read like others, and equal pages alike. Very
    long pages are read whole: a task holds the nodes of up to 200 pages, or of one that
    has PAGES_CHARS characters. A node whose two labellings are equally likely is dropped.
    An empty table gives an empty result.
    """
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            some, size = [], 0
            for x in batch.column(2):
                some.append(x.as_py() or "")
                size += len(some[-1])
                if len(some) == 200 or size > PAGES_CHARS:
                    texts += extract(some, model)
                    some, size = [], 0
            texts += extract(some, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
