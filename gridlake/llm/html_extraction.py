"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

Every element that is not inline is a node with figures of its subtree, its place, its siblings and its attribute
tokens. Boosted trees give each node the chance that it holds main text. Decoding picks the likeliest labelling of the
whole tree in which nothing under a dropped node is kept. The trees are fitted to pages whose own sectioning elements
say what is what, and to made-up pages that mix those paragraphs with other furniture.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .sample import sampled_texts

#: Pages that the trees are fitted on, about; the longest of them in characters; and made-up pages.
FIT_PAGES, FIT_CHARS, MADE_UP = 300, 60_000, 300
#: Characters of pages that are looked at together.
AT_ONCE = 1 << 21
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 32
SEED = 5

#: Fixed values of HTML: elements without an end tag, elements within a line, elements whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
HIDDEN = frozenset("script style head title noscript template iframe object svg math canvas select option button textarea xmp noembed noframes".split())
#: Start tags that end an open p, and elements that end an open one of their own kind.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div td th".split())
MAIN_TAGS, FURNITURE_TAGS = frozenset(("article", "main")), frozenset(("nav", "header", "footer", "aside", "form", "dialog", "menu"))
TAGS = ("body", "div", "section", "article", "main", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "table", "td", "blockquote", "pre", "nav", "header", "footer", "aside", "form", "figure", "figcaption", "dl")
#: Words in class, id and role that speak against main text, and for it.
AGAINST = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer footer form header legal links login masthead menu modal nav navbar navigation newsletter notice notification outbrain pager pagination popup promo promoted recommended related respond reply search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar widget contentinfo complementary alert".split())
FOR = frozenset("article body content entry main post story text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>?", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Nodes in page order, and blocks of text (node, text, link characters, markup elements)."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    inline: list[int] = field(default_factory=list)


def parse(source: str) -> Page:
    """A forgiving reading of the page; broken or unclosed markup never fails."""
    page = Page()
    stack: list[tuple[str, int]] = []  # open elements: name, node
    hidden = links = 0
    parts: list[str] = []
    linked = 0

    def node(tag: str, attrs: str) -> int:
        words = tuple(w.lower() for m in _ATTR.finditer(attrs) for w in _WORD.findall(m[2] or m[3] or m[4] or "")) if attrs else ()
        parent = stack[-1][1] if stack else -1
        page.tag.append(tag)
        page.parent.append(parent)
        page.depth.append(page.depth[parent] + 1 if parent >= 0 else 0)
        page.tokens.append(words)
        page.inline.append(0)
        return len(page.tag) - 1

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.blocks.append((stack[-1][1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal hidden, links
        tag, _ = stack.pop()
        hidden -= tag in HIDDEN
        links -= tag == "a"

    def close(tags, scopes=frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in scopes:
                return

    stack.append(("html", node("html", "")))
    at, size = 0, len(source)
    while at < size:
        lt = source.find("<", at)
        end = size if lt < 0 else lt
        if hidden and stack[-1][0] == "head" and source[at:end].strip():
            close({"head"})  # words never stand in it
        if end > at and not hidden:
            parts.append(html.unescape(source[at:end]))  # a reference ends where its run of text does
            linked += (end - at) * (links > 0)
        if lt < 0:
            break
        m = _TOKEN.match(source, lt)
        if not m:
            if not hidden:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        links -= tag == "a"
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
            elif tag not in VOID:
                flush()
                if tag not in ("html", "body"):
                    close({tag})
            continue
        if tag in ("html", "body") and len(stack) > 1 and any(t == tag for t, _ in stack):
            continue
        if hidden and tag not in IN_HEAD and any(t == "head" for t, _ in stack):
            close({"head"})
        if tag in INLINE:
            page.inline[stack[-1][1]] += 1
            if tag == "br":
                parts.append(" ")
            elif tag not in VOID:
                stack.append((tag, stack[-1][1]))
                links += tag == "a"
            continue
        flush()
        if tag in ENDS_P:
            close({"p"}, SCOPES - {"p"})
        elif tag in ENDS_OWN:
            close(ENDS_OWN[tag], SCOPES - ENDS_OWN[tag])
        if tag in VOID or tag == "html":
            continue
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.I).search(source, at)
            at = size if not stop else max(source.find(">", stop.end()) + 1, stop.end())
            continue
        own = node(tag, m[3])
        stack.append((tag, own))
        hidden += tag in HIDDEN
    flush()
    return page


N_HASH = 16
FEATURES = len(TAGS) + N_HASH + 20


def features(page: Page) -> np.ndarray:
    """A row for each node."""
    n = len(page.tag)
    parent, depth = np.array(page.parent), np.array(page.depth)
    last = np.arange(1, n + 1)
    for i in range(n - 1, 0, -1):
        last[page.parent[i]] = max(last[page.parent[i]], last[i])
    own = np.zeros((n, 4))
    for v, text, linked in page.blocks:
        own[v] += (len(text), linked, text.count(" ") + 1, sum(text.count(c) for c in ".,;!?"))
    own = np.concatenate([own, np.array(page.inline)[:, None], np.ones((n, 1))], axis=1)
    total = np.concatenate([np.zeros((1, own.shape[1])), np.cumsum(own, axis=0)])
    sub = total[last] - total[np.arange(n)]
    x = np.zeros((n, FEATURES))
    against, good = np.zeros(n), np.zeros(n)
    for i, (tag, words) in enumerate(zip(page.tag, page.tokens, strict=True)):
        if tag in TAGS:
            x[i, TAGS.index(tag)] = 1
        for w in words:
            against[i] += w in AGAINST
            good[i] += w in FOR
            x[i, len(TAGS) + zlib.crc32(w.encode()) % N_HASH] = 1
    above = np.zeros((n, 2))
    for i in range(1, n):
        p = page.parent[i]
        above[i] = above[p][0] + against[p] + (page.tag[p] in FURNITURE_TAGS), above[p][1] + good[p] + (page.tag[p] in MAIN_TAGS)
    kids = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
    beside = np.zeros(n)
    np.add.at(beside, parent[1:], sub[1:, 0])
    up = np.maximum(parent, 0)
    chars, all_chars = sub[:, 0], max(sub[0, 0], 1)
    order = np.zeros(n)
    seen: dict[int, int] = {}
    for i in range(1, n):
        order[i] = seen.get(page.parent[i], 0)
        seen[page.parent[i]] = seen.get(page.parent[i], 0) + 1
    c = np.maximum(chars, 1)
    cols = [np.log1p(chars), chars / all_chars, sub[:, 1] / c, np.log1p(sub[:, 5]), chars / sub[:, 5], sub[:, 3] / c, np.log1p(sub[:, 2]), sub[:, 4] / sub[:, 5], depth, kids, order, order / np.maximum(kids[up], 1), chars / np.maximum(beside[up], 1), (beside[up] - chars) / np.maximum(kids[up], 1), against, good, above[:, 0], above[:, 1], own[:, 0] / c, total[np.arange(n), 0] / all_chars]
    x[:, len(TAGS) + N_HASH :] = np.stack(cols, axis=1)
    return x


class Boosted:
    """Logistic boosting of complete binary trees over binned features."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.base), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[row, f[at]] > c[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Boosted:
        inner = 2**DEPTH - 1
        if not len(y) or y.min() == y.max():
            return cls(0.0 if not len(y) else 4.0 * (2 * y[0] - 1), *(np.zeros((0, inner), t) for t in (np.int64, float)), np.zeros((0, inner + 1)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        base = float(np.log(y.mean() / (1 - y.mean())))
        out, features_, cuts, leaves = np.full(len(y), base), [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-out))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            f, c, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
            for v in range(inner):
                mine = np.flatnonzero(at == v)
                best = (1e-3, 0, 0)
                if len(mine) >= 10:
                    for j in range(x.shape[1]):
                        if not len(edges[j]):
                            continue
                        gs, hs = (np.cumsum(np.bincount(binned[mine, j], w[mine], len(edges[j]) + 1)) for w in (g, h))
                        gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                    if best[0] > 1e-3:
                        f[v], c[v] = best[1], edges[best[1]][best[2]]
                at[mine] = 2 * v + 1 + (x[mine, f[v]] > c[v])
            at -= inner
            leaf = RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
            out += leaf[at]
            features_.append(f)
            cuts.append(c)
            leaves.append(leaf)
        return cls(base, np.array(features_), np.array(cuts), np.array(leaves))


def decode(parent: list[int], raw: np.ndarray) -> np.ndarray:
    """The likeliest labelling in which no kept node lies under a dropped one."""
    keep, drop = -np.logaddexp(0, -raw), -np.logaddexp(0, raw)
    best, gone = keep.tolist(), drop.tolist()  # of the subtree: this node kept, all of it dropped
    for i in range(len(parent) - 1, 0, -1):
        p = parent[i]
        best[p] += max(best[i], gone[i])
        gone[p] += gone[i]
    out = np.zeros(len(parent), bool)
    for i in range(len(parent)):
        out[i] = best[i] >= gone[i] and (i == 0 or out[parent[i]])
    return out


def known(page: Page) -> np.ndarray | None:
    """Whether each node holds main text, by the page's own sectioning elements; None where it has none."""
    n = len(page.tag)
    main, off = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(1, n):
        p = page.parent[i]
        bad = page.tag[i] in FURNITURE_TAGS or any(w in AGAINST for w in page.tokens[i])
        off[i] = off[p] or bad
        main[i] = (main[p] or page.tag[i] in MAIN_TAGS) and not off[i]
    if not main.any():
        return None
    y = np.zeros(n)
    for v, *_ in page.blocks:
        y[v] = main[v]
    for i in range(n - 1, 0, -1):
        y[page.parent[i]] = max(y[page.parent[i]], y[i])
    return y


def made_up(texts: list[str], rng: np.random.Generator) -> str:
    """A page of paragraphs among furniture; MAIN marks the container of its text by data-main."""
    pick = lambda *x: x[rng.integers(len(x))]
    some = lambda lo, hi: [html.escape(texts[rng.integers(len(texts))]) for _ in range(rng.integers(lo, hi))]
    short = lambda: " ".join(some(1, 2)[0].split()[: rng.integers(1, 12)])
    links = lambda: "<ul>" + "".join(f"<li><a href='#'>{short()}</a></li>" for _ in range(rng.integers(2, 9))) + "</ul>"
    para = lambda lo, hi: "".join(f"<p>{t}</p>" for t in some(lo, hi))
    boxes = [
        lambda: pick("<nav>{}</nav>", "<div class='menu'>{}</div>", "<div id='navbar'>{}</div>", "<div>{}</div>").format(links()),
        lambda: pick("<header>{}</header>", "<div class='site-header'>{}</div>", "<div id='masthead'>{}</div>").format(f"<h2>{short()}</h2>"),
        lambda: pick("<footer>{}</footer>", "<div class='footer'>{}</div>", "<div id='copyright'>{}</div>").format(f"&copy; {short()} &middot; {short()}"),
        lambda: pick("<aside>{}</aside>", "<div class='sidebar'>{}</div>", "<div class='widget related'>{}</div>").format(f"<h3>{short()}</h3>" + links() + para(0, 2)),
        lambda: pick("<div class='notice'>{}</div>", "<div class='cookie-consent'>{}</div>", "<div id='banner'>{}</div>", "<section class='alert'>{}</section>").format(pick(short(), f"<p>{short()}</p>")),
        lambda: pick("<div class='ad'>{}</div>", "<div class='advert'>{}</div>", "<section class='sponsored promo'>{}</section>").format(pick(short(), some(1, 2)[0])),
        lambda: pick("<form>{}</form>", "<form class='newsletter'>{}</form>", "<div class='subscribe'><form>{}</form></div>").format(f"<label>{short()}</label><input><p>{short()}</p>"),
        lambda: pick("<section class='comments'>{}</section>", "<div id='comments'>{}</div>", "<ol class='comment-list'>{}</ol>").format("".join(pick("<div class='comment'><p>{}</p></div>", "<li>{}</li>", "<p>{}</p>").format(t) for t in some(1, 6))),
        lambda: pick("<div class='share'>{}</div>", "<div class='tags'>{}</div>", "<div class='breadcrumb'>{}</div>").format(" ".join(f"<a href='#'>{short()}</a>" for _ in range(3))),
    ]
    main = f"<h1>{short()}</h1>" * int(rng.integers(2)) + pick(para(1, 12), para(1, 6) + f"<h2>{short()}</h2>" + para(1, 6), "<ul>" + "".join(f"<li>{t}</li>" for t in some(1, 4)) + "</ul>" + para(1, 4))
    inside = "".join(pick(*boxes)() for _ in range(rng.integers(0, 3)))
    name = pick("article", "main", "div class='content'", "div class='post-body'", "section id='story'", "div", "div class='entry'")
    middle = f"<{name} data-main>{main}</{name.split()[0]}>"
    if rng.random() < 0.4:
        middle = middle.replace(" data-main>", ">").replace(main, f"<div data-main>{main}</div>{inside}")
    before, after = ("".join(pick(*boxes)() for _ in range(rng.integers(0, 5))) for _ in range(2))
    return f"<html><body>{before}{pick('{}', '<div id=page>{}</div>').format(middle)}{after}</body></html>"


def marked(source: str) -> tuple[Page, np.ndarray]:
    """A made-up page, and whether each node holds main text: those that stand in the marked element, and those above."""
    mark = re.search(r"<[^<>]* data-main>", source)
    page, top = parse(source), len(parse(source[: mark.start()] + "<div>").tag) - 1  # the node that the mark opens
    y = np.zeros(len(page.tag))
    inside = np.zeros(len(page.tag), bool)
    inside[top] = True
    for i in range(top + 1, len(page.tag)):
        inside[i] = inside[page.parent[i]]
    for v, *_ in page.blocks:
        y[v] = inside[v]
    for i in range(len(page.tag) - 1, 0, -1):
        y[page.parent[i]] = max(y[page.parent[i]], y[i])
    return page, y


def train(sources: list[str]) -> Boosted:
    rng = np.random.default_rng(SEED)
    xs, ys, texts = [], [], []
    for s in sources:
        page = parse(s)
        y = known(page)
        if y is not None:
            texts += [t for v, t, _ in page.blocks if y[v]][:20]
            xs.append(features(page))
            ys.append(y)
    texts = texts or ["Some words of a plain paragraph, long enough to be one.", "And another one, with a second sentence. Here it is."]
    for _ in range(MADE_UP):
        page, y = marked(made_up(texts, rng))
        xs.append(features(page))
        ys.append(y)
    return Boosted.fit(np.concatenate(xs), np.concatenate(ys))


def main_text(source: str, model: Boosted) -> str:
    page = parse(source)
    if not page.blocks:
        return ""
    keep = decode(page.parent, model.raw(features(page)))
    return "\n".join(t for v, t, _ in page.blocks if keep[v])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Boosted | None = None) -> DataFrame:
    """One row for each row of df: id_col, url_col, text, n_chars (code points of text).

    A null or empty page, and one without main text, gives the empty text. White space in a block becomes one space,
    character references are decoded, blocks are joined by a line feed. Repeated rows and null ids give a row each;
    other columns are not read; an empty df gives no rows. A page of any length is read whole, and is the most that a task needs at
    once beyond AT_ONCE characters. The trees are fitted to about FIT_PAGES of the pages with a sectioning element, picked by hash,
    and to MADE_UP made-up ones.
    """
    if model is None:
        body = F.col("html")
        some = df.select(F.col(html_col).alias("html")).where(F.length(body).between(1, FIT_CHARS) & body.rlike("(?i)<(article|main)[ >]"))
        model = train(sampled_texts(some, "html", FIT_PAGES))

    def run(batches):
        for b in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(2)), 0), np.int64))
            lo = 0
            while lo < b.num_rows:
                hi = min(lo + 200, max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + AT_ONCE, "right"))))
                part = b.slice(lo, hi - lo)
                lo = hi
                pages = [parse(s or "") for s in part.column(2).to_pylist()]
                x = [features(p) for p in pages]
                raw = np.split(model.raw(np.concatenate(x)), np.cumsum([len(v) for v in x])[:-1])
                texts = []
                for page, r in zip(pages, raw, strict=True):
                    keep = decode(page.parent, r) if page.blocks else []
                    texts.append("\n".join(t for v, t, _ in page.blocks if keep[v]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])
            tk.trim()

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return out.mapInArrow(tk.lean(run), f"id {kind}, url string, text string, n_chars long").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
