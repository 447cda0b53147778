"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down.

A page becomes a tree of block elements (and of others that carry a class, id or
role). Each node's features — its tag and attribute tokens as learned log-odds,
depth, text and link density of its subtree, what its siblings and parent are like,
its place in the page — go through boosted trees trained on generated pages. A node
can be kept only if all above it are: the choice that maximises the sum of the kept
nodes' log-odds is found bottom up, so no child is kept under a dropped ancestor.

Text of kept nodes has character references decoded; block boundaries and line
breaks separate, white space collapses to single spaces.

Edge cases: null and empty pages give an empty text; broken or unclosed markup is
repaired as browsers do in the common cases; text outside any element is kept if
its root is; null ids and addresses are kept; repeated rows give equal results; pages
of any length are read whole; an empty table gives an empty result; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, map_batches, table

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
NAMED = re.compile(r"(class|id|role|aria-label|itemprop|data-k)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg".split())
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I | re.A) for name in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mspace mstyle mpadded mphantom menclose merror mtable mtr mtd semantics annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul textarea button".split())
ENDS_P = BLOCK - {"option", "select", "textarea", "button", "body", "html", "head", "title"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Tree:
    """Nodes of a page in order, and its text pieces with the node each belongs to."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.tokens, self.truth = ["html"], [-1], [0], [()], [None]
        self.pieces: list[tuple[int, str, bool]] = []  # node, text, whether inside a link; node -1: a break
        self.starts = [0]
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements: tag, node
        links, at, unended = 0, 0, set()

        def pop_to(k: int) -> None:
            nonlocal links
            while len(stack) > k:
                t, _ = stack.pop()
                links -= t == "a"
                if t not in INLINE:
                    self.pieces.append((-1, "", False))

        for m in MARKUP.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self.pieces.append((stack[-1][1], source[at : m.start()], links > 0))
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, attrs = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        pop_to(k)
                        break
                    if name in INLINE and stack[k][0] not in INLINE:
                        break
                else:
                    if name == "p":
                        self.pieces.append((-1, "", False))
                continue
            if name in VOID:
                if name in ("br", "hr", "img", "input"):
                    self.pieces.append((-1, "", False))
                continue
            if name in RAW and not attrs.rstrip().endswith("/"):
                # without an end only scripts and styles take the rest of the page
                end = None if name in unended else ENDS[name].search(source, at)
                if end:
                    at = end.end()
                elif name in ("script", "style"):
                    at = len(source)
                else:
                    unended.add(name)
                self.pieces.append((-1, "", False))
                continue
            if name in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            if name in CLOSES:
                same, until = CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in until:
                        break
                    if stack[k][0] in same:
                        pop_to(k)
                        break
            if name not in ("head", "title", "html") and stack[-1][0] == "head":
                pop_to(len(stack) - 1)
            found = NAMED.findall(attrs) if attrs else ()
            if name == "html":
                continue
            if name in INLINE and not any(x[0].lower() in ("class", "id", "role") for x in found):
                stack.append((name, stack[-1][1]))
                links += name == "a"
                continue
            truth, tokens = None, []
            for key, *values in found:
                value = "".join(values)
                if key.lower() == "data-k":
                    truth = value
                else:
                    tokens += [t.lower() for t in TOKEN.findall(value)]
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1][1])
            self.depth.append(len(stack))
            self.tokens.append(tuple(tokens))
            self.truth.append(truth)
            self.starts.append(len(self.pieces))
            stack.append((name, node))
            links += name == "a"
            if name not in INLINE:
                self.pieces.append((-1, "", False))
        if at < len(source):
            self.pieces.append((stack[-1][1], source[at:], links > 0))

    def text(self, kept: np.ndarray) -> str:
        out = [" " if n < 0 else html.unescape(t) if "&" in t else t for n, t, _ in self.pieces if n < 0 or kept[n]]
        return " ".join("".join(out).split())


def log_odds(counts: dict[str, list[int]]) -> dict[str, float]:
    return {k: float(np.log((a + 0.5) / (b + 0.5))) for k, (a, b) in counts.items()}


def token_score(token: str, known: dict[str, float]) -> float | None:
    """A token's log-odds; for one not met in training that of the longest known token it starts or ends with."""
    if token in known:
        return known[token]
    for n in range(len(token) - 1, 3, -1):
        for t in (token[:n], token[-n:]):
            if t in known:
                return known[t]
    return None


FEATURES = 24


def node_features(tree: Tree, tags: dict[str, float], known: dict[str, float]) -> np.ndarray:
    n = len(tree.tag)
    parent = tree.parent
    chars, linked, stops, own, nodes, par, items, forms, heads = (np.zeros(n) for _ in range(9))
    first = np.full(n, -1.0)
    total = 0
    for i, t, link in tree.pieces:
        if i >= 0:
            k = len(t) - t.count(" ") if len(t) < 40 else len(t)
            if not k or t.isspace():
                continue
            own[i] += k
            linked[i] += k if link else 0
            stops[i] += t.count(".") + t.count(",")
            if first[i] < 0:
                first[i] = total
            total += k
    chars[:] = own
    for i, tag in enumerate(tree.tag):
        nodes[i] = 1
        par[i] = tag == "p"
        items[i] = tag in ("li", "option", "td")
        forms[i] = tag in ("form", "select", "textarea", "button", "fieldset", "option")
        heads[i] = tag in HEADINGS
    children = np.zeros(n)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        children[p] += 1
        for v in (chars, linked, stops, nodes, par, items, forms, heads):
            v[p] += v[i]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    rank, same = np.zeros(n), np.zeros(n)
    seen: dict[int, int] = {}
    alike: dict[tuple, int] = {}
    for i in range(1, n):
        rank[i] = seen[parent[i]] = seen.get(parent[i], -1) + 1
        alike[(parent[i], tree.tag[i])] = alike.get((parent[i], tree.tag[i]), 0) + 1
    for i in range(1, n):
        same[i] = alike[(parent[i], tree.tag[i])]
    x = np.zeros((n, FEATURES))
    up = np.array([max(p, 0) for p in parent])
    tag_odds = np.array([tags.get(t, 0.0) for t in tree.tag])
    low, high = np.zeros(n), np.zeros(n)
    for i, ts in enumerate(tree.tokens):
        if ts:
            s = [v for t in ts if (v := token_score(t, known)) is not None]
            if s:
                low[i], high[i] = min(s), max(s)
    density = linked / np.maximum(chars, 1)
    all_chars = max(total, 1)
    cols = (
        tag_odds, low, high, np.array(tree.depth, float), np.log1p(chars), chars / all_chars, density, chars / nodes,
        stops / np.maximum(chars, 1) * 100, children, rank, rank / np.maximum(children[up], 1), same, par / nodes, items / nodes,
        np.log1p(forms), heads, np.maximum(first, 0) / all_chars, tag_odds[up], low[up], high[up], chars[up] / all_chars, density[up], np.log1p(own),
    )
    for k, c in enumerate(cols):
        x[:, k] = c
    return x


class Boosted:
    """Boosted regression trees on the logistic loss, split on histograms."""

    def __init__(self, rounds: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 48):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], axis=1)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-9
            size = 2 ** (self.depth + 1) - 1
            feature, cut, leaf = np.full(size, -1), np.zeros(size), np.zeros(size)
            at = np.zeros(len(y), dtype=np.int64)
            for node in range(size):
                rows = np.nonzero(at == node)[0]
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                leaf[node] = gs / (hs + 1.0)
                if node >= 2**self.depth - 1 or len(rows) < 12:
                    continue
                best = (1e-4, -1, 0)
                for f, c in enumerate(self.cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(b[rows, f], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b[rows, f], h[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
                if best[1] >= 0:
                    feature[node], cut[node] = best[1], self.cuts[best[1]][best[2]]
                    at[rows] = 2 * node + 1 + (b[rows, best[1]] > best[2])
            self.trees.append((feature, cut, leaf * self.rate))
            score += (leaf * self.rate)[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + (x[row, np.maximum(f, 0)] >= cut[at]))
            out += leaf[at]
        return out


def decode(parent: list[int], tags: list[str], score: np.ndarray) -> np.ndarray:
    """Kept nodes: the best choice in which nothing is kept under a dropped node. The root stays; heads go."""
    n = len(parent)
    value = score.astype(float).copy()
    for i in range(n):
        if tags[i] in ("head", "title"):
            value[i] = -np.inf
    for i in range(n - 1, 0, -1):
        if value[i] > 0:
            value[parent[i]] += value[i]
    kept = np.zeros(n, dtype=bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[parent[i]] and value[i] > 0
    return kept


# Names that pages give their parts, for the generated pages.
NAMES = {
    "menu": "nav navbar navigation menu main-menu top-menu topnav breadcrumb breadcrumbs pagination pager toc-links tabs links skip-link",
    "header": "header site-header masthead top-bar banner-top logo branding page-header",
    "footer": "footer site-footer bottom colophon copyright credits legal page-footer",
    "aside": "sidebar side-bar aside widget widgets related related-posts recommended popular trending tags tag-cloud share social sharing author-box toolbar rail",
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert newsletter subscribe signup popup modal overlay announcement disclaimer paywall message warning",
    "advert": "ad ads advert advertisement adsense sponsored sponsor promo promotion banner ad-slot adbox outbrain taboola",
    "form": "form search search-form login contact-form feedback survey",
    "comment": "comments comment comment-list commentlist responses replies disqus discussion reply respond reviews",
    "content": "content main main-content article post post-content entry entry-content article-body story story-body text body page wrapper container site row col inner layout region block section prose",
}


def generated(pages: int, seed: int):
    """Pages with a mark, data-k, on each element: c for what belongs to the article."""
    r = random.Random(seed)
    names = {k: v.split() for k, v in NAMES.items()}
    syllables = "an er on the in th re es ti of en or at st and nd to is ha ou ed it he ea ar al de la que un der die el os mi".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def words(a: int, b: int) -> str:
        out = []
        for _ in range(r.randint(a, b)):
            out.append(word() + r.choice(("", "", "", "", "", "", ",", ".", "")))
        s = " ".join(out)
        return s[:1].upper() + s[1:] + "."

    def attr(kind: str, often: float) -> str:
        if r.random() > often:
            return ""
        name = r.choice(names[kind])
        if r.random() < 0.2:
            name += r.choice(("-1", "-wrap", "-inner", "_box", " clearfix", "-area", " hidden-xs"))
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def links(k: int) -> str:
        return "".join(f'<li data-k="n"><a href="/{word()}">{" ".join(word() for _ in range(r.randint(1, 3)))}</a></li>' for _ in range(k))

    def menu() -> str:
        ul = f'<ul data-k="n"{attr("menu", 0.2)}>{links(r.randint(2, 9))}</ul>'
        return f'<nav data-k="n"{attr("menu", 0.4)}>{ul}</nav>' if r.random() < 0.6 else f'<div data-k="n"{attr("menu", 0.8)}>{ul}</div>'

    def part(kind: str) -> str:
        t = {"header": "header", "footer": "footer", "aside": "aside", "form": "form", "comment": "section"}.get(kind, "div")
        plain = t in ("div", "section")
        t = t if r.random() < 0.65 else "div"
        a = attr(kind, (0.85 if kind == "aside" else 1.0) if plain or t == "div" else 0.4)
        p = lambda x, y: f'<p data-k="n">{words(x, y)}</p>'
        if kind == "header":
            inner = r.choice((f'<h1 data-k="n">{word()}</h1>', f'<div data-k="n"{attr("header", 0.6)}>{word()}</div>', p(2, 8), "")) + (menu() if r.random() < 0.5 else "") + (words(2, 6) if r.random() < 0.4 else "")
        elif kind == "footer":
            inner = r.choice((f"&copy; {word()} &middot; {words(2, 9)}", p(3, 20), f'<ul data-k="n">{links(4)}</ul>', p(2, 6) + menu(), words(2, 30)))
        elif kind == "aside":
            inner = r.choice((f'<h3 data-k="n">{word()}</h3><ul data-k="n">{links(r.randint(2, 7))}</ul>', p(4, 30), words(3, 30), p(4, 20) + p(4, 20)))
        elif kind in ("notice", "advert"):
            inner = r.choice((words(3, 30), p(3, 25), p(3, 9) + '<button data-k="n">OK</button>', f"<a href='/x'>{words(2, 9)}</a>"))
        elif kind == "form":
            inner = f'<label>{word()}</label><input name="q"><select data-k="n"><option data-k="n">{word()}</option><option data-k="n">{word()}</option></select><button data-k="n">{word()}</button>' + (p(2, 12) if r.random() < 0.5 else "") + ('<textarea data-k="n">x y</textarea>' if r.random() < 0.3 else "")
        else:
            one = lambda: f'<{(k := r.choice(("div", "li", "article", "p")))} data-k="n"{attr("comment", 0.6)}>{r.choice((words(3, 40), p(3, 40), f"<b>{word()}</b> {words(2, 20)}"))}</{k}>'
            inner = (f'<h3 data-k="n">{word()}</h3>' if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 6)))
        return f'<{t} data-k="n"{a}>{inner}</{t}>'

    def article() -> str:
        out = [f'<h1 data-k="c">{words(3, 12)}</h1>'] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 14)):
            k = r.random()
            if k < 0.72:
                s = words(1, 120) if r.random() < 0.8 else words(100, 400)
                s = s.replace(". ", f'. <a href="/{word()}">{word()}</a> ', 1) if r.random() < 0.2 else s
                s = f"<b>{s}" + ("<br>" if r.random() < 0.7 else "") if r.random() < 0.15 else s
                out.append(f'<p data-k="c">{s}' + ("</p>" if r.random() < 0.9 else ""))
            elif k < 0.8:
                h = r.choice(("h2", "h2", "h3", "h4"))
                out.append(f'<{h} data-k="c">{words(1, 7)}</{h}>')
            elif k < 0.86:
                out.append('<ul data-k="c">' + "".join(f'<li data-k="c">{words(2, 25)}</li>' for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.9:
                out.append(f'<blockquote data-k="c">{words(5, 40)}</blockquote>')
            elif k < 0.93:
                out.append('<table data-k="c">' + "".join('<tr data-k="c">' + "".join(f'<td data-k="c">{word()} {r.randint(1, 99)}</td>' for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif k < 0.96:
                out.append(f'<div data-k="c"{attr("content", 0.4)}>{words(5, 80)}</div>')
            elif k < 0.98:
                out.append(part(r.choice(("advert", "aside", "notice", "form"))))
            else:
                out.append(f'<pre data-k="c">{words(3, 20)}</pre><figure data-k="c"><img src="a.png"><figcaption data-k="c">{words(2, 12)}</figcaption></figure>')
        body = "".join(out)
        t = r.choice(("article", "article", "article", "div", "main", "section"))
        if r.random() < 0.25:
            body = f'<div data-k="c"{attr("content", 0.8)}>{body}</div>'
        tail = part("comment") if r.random() < 0.25 else ""
        return f'<{t} data-k="c"{attr("content", 0.9 if t == "div" else 0.4)}>{body}{tail}</{t}>'

    for _ in range(pages):
        often = r.choice((0.3, 0.6))
        top = [menu() for _ in range(r.random() < 0.75)] + [part(k) for k in ("header", "notice", "advert", "form") if r.random() < often]
        end = [part(k) for k in ("aside", "comment", "advert", "notice", "form", "footer") if r.random() < often or k == "footer" and r.random() < 0.6]
        r.shuffle(top)
        middle = article()
        if r.random() < 0.3:
            side = part("aside")
            middle = f'<div data-k="c"{attr("content", 0.8)}>{side + middle if r.random() < 0.5 else middle + side}</div>'
        body = "".join(top) + middle + "".join(end)
        if r.random() < 0.2:
            body = f'<div data-k="c"{attr("content", 0.8)}>{body}</div>'
        yield f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{body}</body></html>"


class Extractor:
    def __init__(self, pages: int = 400, seed: int = 3):
        trees = [Tree(p) for p in generated(pages, seed)]
        tags: dict[str, list[int]] = {}
        known: dict[str, list[int]] = {}
        for t in trees:
            for tag, ts, k in zip(t.tag, t.tokens, t.truth, strict=True):
                if k:
                    tags.setdefault(tag, [0, 0])[k != "c"] += 1
                    for x in set(ts):
                        known.setdefault(x, [0, 0])[k != "c"] += 1
        self.tags, self.known = log_odds(tags), log_odds(known)
        x = np.vstack([node_features(t, self.tags, self.known) for t in trees])
        truth = [k or "c" for t in trees for k in t.truth]
        self.model = Boosted().fit(x, np.array([k == "c" for k in truth], dtype=float))

    def extract(self, pages: list[str | None]) -> list[str]:
        trees = [Tree(p) if p else None for p in pages]
        some = [t for t in trees if t]
        if not some:
            return [""] * len(pages)
        scores = self.model.score(np.vstack([node_features(t, self.tags, self.known) for t in some]))
        out, at = [], 0
        for t in trees:
            if t is None:
                out.append("")
                continue
            n = len(t.tag)
            out.append(t.text(decode(t.parent, t.tag, scores[at : at + n])))
            at += n
        return out


def extract_text(pages: DataFrame, *, model: Extractor | None = None) -> DataFrame:
    """``page_id, url, text, n_chars``, one row a page."""
    sent = Sent(pages.sparkSession, model or Extractor())

    def make():
        def run(x: dict) -> dict:
            texts: list[str] = []
            for a in range(0, len(x["html"]), 500):
                texts += sent.value.extract(x["html"][a : a + 500])
            return {"page_id": x["page_id"], "url": x["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return run

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), make, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
