"""Main text of web pages: boosted trees over the nodes of the page's tree, decoded from the root.

Every block element and every run of inline text is a node. Features are its tag, the tokens of its attributes in groups,
its depth, how much text and how many links, paragraphs and other elements are below it, how it stands among its siblings,
and what its ancestors are. Gradient-boosted trees say how likely the node holds text of the article. Decoding takes the
likeliest choice for the whole tree in which a kept node has a kept parent, so no descendant contradicts an ancestor.

The trees are trained here, on pages that a generator draws by rules (articles in several kinds of markup, among menus,
headers, footers, sidebars, notices, adverts, forms and comments), with a fixed seed. Nulls and empty pages give the empty
string. Pages are whole, their order and repeats stay; other columns are ignored.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow
from .dom import Node, parse

#: Attribute tokens in groups.
GROUPS = {
    "menu": "nav navbar navigation menu menus topnav breadcrumb breadcrumbs crumbs tabs toc pagination pager skip",
    "header": "header masthead topbar branding logo hero siteheader top",
    "footer": "footer foot bottom copyright colophon legal sitefooter imprint",
    "sidebar": "sidebar side rail aside widget widgets related recommended recommendation trending popular more teaser teasers complementary also recirc",
    "notice": "notice cookie cookies consent gdpr banner alert newsletter subscribe subscription paywall disclaimer popup modal overlay toast privacy warning message notification",
    "advert": "ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored promo promotion promoted commercial outbrain taboola",
    "form": "form search login signin signup register contact input field poll survey",
    "comments": "comment comments discussion reply replies response responses disqus reader readers feedback respond thread",
    "share": "share sharing social follow tags tagcloud like rating print",
    "good": "article content contents post entry story body main text articlebody page hentry blog prose maincontent storybody",
}
_GROUP_OF = {w: i for i, ws in enumerate(GROUPS.values()) for w in ws.split()}
TAGS = "#root #text html body div p article main section nav header footer aside form ul ol li h1 h2 h3 h4 blockquote pre table tr td th dl dt dd figure figcaption button select fieldset address".split()
_TAG = {t: i for i, t in enumerate(TAGS)}
_BAD_TAGS = {"nav": 0, "header": 1, "footer": 2, "aside": 3, "form": 6, "button": 6, "select": 6, "fieldset": 6}
N_GROUPS = len(GROUPS)
N_FEATURES = len(TAGS) + 1 + 3 * N_GROUPS + 22
#: The trees: number, depth, step, bins of a feature, pages that teach.
TREES, DEPTH, RATE, BINS, PAGES, SEED = 80, 5, 0.25, 32, 1000, 11


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(reversed(n.children))
    return out


def describe(nodes: list[Node]) -> np.ndarray:
    """The features of all nodes."""
    return np.concatenate([*described(nodes)])


def described(nodes: list[Node], size: int = 4096) -> Iterator[np.ndarray]:
    """The same in blocks of so many nodes, so that a page of any length takes little room."""
    index = {id(n): i for i, n in enumerate(nodes)}
    k = len(nodes)
    parent = [-1 if n.parent is None else index[id(n.parent)] for n in nodes]
    chars, links, bold, leaves, marks, paras, items, depth = ([0] * k for _ in range(8))
    own = np.zeros((k, N_GROUPS), dtype=np.float32)
    above = np.zeros((k, N_GROUPS), dtype=np.float32)
    near = np.zeros((k, N_GROUPS), dtype=np.float32)
    for i, n in enumerate(nodes):
        p = parent[i]
        for w in n.tokens():
            g = _GROUP_OF.get(w)
            if g is not None:
                own[i, g] = 1
        if n.tag in _BAD_TAGS:
            own[i, _BAD_TAGS[n.tag]] = 1
        elif n.tag in ("article", "main"):
            own[i, N_GROUPS - 1] = 1
        if p >= 0:
            depth[i] = depth[p] + 1
            above[i] = np.maximum(above[p], own[p])
            near[i] = own[p] if own[p].any() else near[p]
        if n.tag == "#text":
            t = n.text
            chars[i], links[i], bold[i], leaves[i] = len(t), n.link, n.bold, 1
            marks[i] = t.count(",") + t.count(".") + t.count(";")
        paras[i] = n.tag == "p"
        items[i] = n.tag == "li"
    for i in range(k - 1, 0, -1):
        p = parent[i]
        for a in (chars, links, bold, leaves, marks, paras, items):
            a[p] += a[i]
    sizes = [1] * k
    for i in range(k - 1, 0, -1):
        sizes[parent[i]] += sizes[i]
    rank, alike = [0] * k, [0] * k
    for n in nodes:
        tags = Counter(c.tag for c in n.children)
        for j, c in enumerate(n.children):
            rank[index[id(c)]], alike[index[id(c)]] = j, tags[c.tag]
    total = max(1, chars[0])
    before, seen = [0] * k, 0
    for i, n in enumerate(nodes):
        before[i] = seen
        if n.tag == "#text":
            seen += len(n.text)
    base = len(TAGS) + 1
    for low in range(0, k, size):
        part = nodes[low : low + size]
        x = np.zeros((len(part), N_FEATURES), dtype=np.float32)
        for i, n in enumerate(part, low):
            x[i - low, _TAG.get(n.tag, len(TAGS))] = 1
            p = max(parent[i], 0)
            q = max(parent[p], 0)
            c = chars[i]
            brothers = len(nodes[p].children)
            x[i - low, base + 3 * N_GROUPS :] = (
                depth[i], np.log1p(c), c / total, links[i] / max(1, c), bold[i] / max(1, c), leaves[i], marks[i] / max(1, c) * 20, np.log1p(marks[i]),
                paras[i], items[i], c / max(1, sizes[i]), np.log1p(sizes[i]), rank[i], rank[i] / max(1, brothers - 1), brothers, alike[i] / max(1, brothers),
                c / max(1, chars[p]), chars[p] / total, links[p] / max(1, chars[p]), paras[p], before[i] / total, links[q] / max(1, chars[q]),
            )
        for g, a in enumerate((own, above, near)):
            x[:, base + g * N_GROUPS : base + (g + 1) * N_GROUPS] = a[low : low + size]
        yield x


class Trees:
    """Gradient-boosted regression trees for the log-odds, on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.cuts = []
        bins = np.zeros((d, n), dtype=np.int64)
        for j in range(d):
            values = np.unique(x[:, j])
            cut = (values[1:] + values[:-1]) / 2 if len(values) <= BINS else np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS))
            self.cuts.append(cut.astype(np.float32))
            bins[j] = np.searchsorted(self.cuts[j], x[:, j], side="left")
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        f = np.full(n, self.start)
        self.trees = []
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            at = np.zeros(n, dtype=np.int64)
            tree = []
            for level in range(DEPTH):
                width = 1 << level
                best = np.zeros(width), np.zeros(width, dtype=np.int64), np.full(width, BINS, dtype=np.int64)
                for j in range(d):
                    if not len(self.cuts[j]):
                        continue
                    key = at * BINS + bins[j]
                    sg = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    sh = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain[(sh < 1) | (th - sh < 1)] = 0
                    b = gain.argmax(axis=1)
                    v = gain[np.arange(width), b]
                    better = v > best[0] + 1e-9
                    best[0][better], best[1][better], best[2][better] = v[better], j, b[better]
                tree.append((best[1], best[2]))
                at = 2 * at + (bins[best[1][at], np.arange(n)] > best[2][at])
            leaf = np.bincount(at, g, 1 << DEPTH) / (np.bincount(at, h, 1 << DEPTH) + 1) * RATE
            self.trees.append((tree, leaf))
            f += leaf[at]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)])
        f, rows = np.full(len(x), self.start), np.arange(len(x))
        for tree, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for feature, cut in tree:
                at = 2 * at + (bins[feature[at], rows] > cut[at])
            f += leaf[at]
        return f


def chosen(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The likeliest choice of nodes, the root among them, in which kept nodes have kept parents; at equal odds the smaller."""
    index = {id(n): i for i, n in enumerate(nodes)}
    parent = [-1 if n.parent is None else index[id(n.parent)] for n in nodes]
    keep = [float(x) for x in odds]  # the best of each subtree with its top kept, less that of dropping it
    for i in range(len(nodes) - 1, 0, -1):
        if keep[i] > 0:
            keep[parent[i]] += keep[i]
    out = [True] * len(nodes)
    for i in range(1, len(nodes)):
        out[i] = out[parent[i]] and keep[i] > 0
    return out


def decode(nodes: list[Node], odds: np.ndarray) -> list[Node]:
    """The kept runs of text."""
    return [n for n, kept in zip(nodes, chosen(nodes, odds), strict=True) if kept and n.tag == "#text"]


# ---- pages that teach ----


def _words(draw: random.Random, n: int) -> str:
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "or", "ti", "ei", "sch", "ung", "eau", "ción", "ment", "ü", "é", "ar", "os"]
    out = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + draw.choice(["", "", ","]) if draw.random() < 0.1 else w for w in out) + draw.choice([".", ".", "", "!", "?", " &amp; more.", "..."])


def _inline(draw: random.Random, n: int) -> str:
    t = _words(draw, n).split(" ")
    kind = draw.random()
    if kind < 0.2 and len(t) > 4:
        tag = draw.choice(["b", "i", "em", "strong", "code", "span"])
        t[1] = f"<{tag}>{t[1]}</{tag}>"
    elif kind < 0.3 and len(t) > 4:
        t[2] = f'<a href="/x">{t[2]}</a>'
    elif kind < 0.4:
        t.insert(len(t) // 2, "<br>")
    elif kind < 0.5:
        t.insert(0, "<b>")
    return " ".join(t)


def _open(draw: random.Random, tag: str, tokens: list[str]) -> str:
    if not tokens or draw.random() < 0.15:
        return f"<{tag}>"
    w = draw.choice(tokens)
    w = draw.choice([w, w, f"site-{w}", f"{w}-wrap", f"c-{w}", f"{w} box", f"{w}_{draw.randint(1, 9)}", w.capitalize() + "Box"])
    return f'<{tag} {draw.choice(["class", "class", "id"])}="{w}">'


def _links(draw: random.Random, n: int, tag: str = "li") -> str:
    body = "".join(f'<{tag}><a href="/{i}">{_words(draw, draw.randint(1, 4))}</a></{tag}>' for i in range(n))
    return f"<ul>{body}</ul>" if tag == "li" else body


def _noise(draw: random.Random, kind: str) -> str:
    tags = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "sidebar": ["aside", "aside", "div", "section"], "notice": ["div", "div", "section", "p"], "advert": ["div", "div", "aside", "section"], "form": ["form", "form", "div"], "comments": ["section", "div", "div", "ol"], "share": ["div", "ul"]}
    tag = draw.choice(tags[kind])
    semantic = tag in ("nav", "header", "footer", "aside", "form")
    tokens = GROUPS[kind].split()[:8]
    s = lambda a, b: _words(draw, draw.randint(a, b))
    body = {
        "menu": lambda: _links(draw, draw.randint(2, 9), draw.choice(["li", "li", "div", "span"])),
        "header": lambda: draw.choice([f"<h1>{s(1, 4)}</h1>", f"<div>{s(1, 5)}</div>", f"<p>{s(2, 12)}</p>"]) + draw.choice(["", _links(draw, 4)]),
        "footer": lambda: draw.choice(["&copy; ", "Copyright ", "", "&middot; "]) + draw.choice([s(2, 25), f"<p>{s(3, 25)}</p>", _links(draw, 4), f"{s(2, 12)}\n{s(2, 12)}"]),
        "sidebar": lambda: draw.choice(["", f"<h3>{s(1, 4)}</h3>"]) + draw.choice([_links(draw, draw.randint(2, 8)), f"<p>{s(5, 30)}</p>", f"<p>{s(5, 20)}</p><p>{s(5, 20)}</p>", s(3, 20)]),
        "notice": lambda: draw.choice([s(4, 30), f"<p>{s(4, 30)}</p>", f"{s(4, 20)}<button>{s(1, 2)}</button>"]),
        "advert": lambda: draw.choice([s(2, 30), f"<p>{s(2, 30)}</p>", f'<a href="/ad">{s(2, 15)}</a>', f"<div>{s(2, 15)}</div><p>{s(3, 20)}</p>"]),
        "form": lambda: f"<label>{s(1, 4)}</label><input name=a><select><option>{s(1, 2)}<option>{s(1, 2)}</select><button>{s(1, 3)}</button>" + draw.choice(["", f"<p>{s(3, 15)}</p>", f"<textarea>{s(3, 9)}</textarea>"]),
        "comments": lambda: draw.choice(["", f"<h2>{s(1, 4)}</h2>"]) + "".join(draw.choice([f"<p>{s(3, 60)}</p>", f"<div><b>{s(1, 2)}</b><p>{s(3, 50)}</p></div>", f"<li>{s(3, 40)}</li>", f'<div class="comment">{s(3, 50)}</div>']) for _ in range(draw.randint(1, 6))),
        "share": lambda: draw.choice([_links(draw, draw.randint(2, 5)), s(1, 5)]),
    }[kind]()
    if kind == "form" and tag == "div":
        body = f"<form>{body}</form>"
    return (_open(draw, tag, tokens) if semantic or draw.random() < 0.3 else f'<{tag} {draw.choice(["class", "class", "id"])}="{draw.choice(tokens)}">') + body + f"</{tag}>"


def _article(draw: random.Random) -> list[str]:
    out = []
    if draw.random() < 0.8:
        out.append(f"<h{(h := draw.choice([1, 1, 2]))}>{_words(draw, draw.randint(2, 10))}</h{h}>")
    if draw.random() < 0.15:
        out.append(_words(draw, draw.randint(5, 60)))
    for _ in range(draw.choice([1, 1, 2, 3, 4, 6, 9, 14])):
        n = draw.choice([3, 8, 20, 40, 60, 90])
        text = _inline(draw, n)
        out.append(
            draw.choices(
                [f"<p>{text}</p>", f"<p>{text}", f"<div>{text}</div>", f"<blockquote>{text}</blockquote>", f"<h2>{_words(draw, 4)}</h2><p>{text}</p>", f"<ul><li>{text}</li><li>{_words(draw, 6)}</li></ul>", f"<table><tr><td>{_words(draw, 3)}</td><td>{_words(draw, 5)}</td></tr></table>", f"<figure><img src=a><figcaption>{_words(draw, 6)}</figcaption></figure>", f"<pre>{text}</pre>", text + "<br><br>"],
                [60, 12, 5, 4, 6, 5, 2, 2, 2, 2],
            )[0]
        )
    return out


def teaching_page(draw: random.Random) -> tuple[Node, set[int]]:
    """A page's tree and the ids of the nodes that hold article text."""
    inner = _article(draw)
    for kind, p in (("advert", 0.25), ("share", 0.2), ("sidebar", 0.12), ("notice", 0.12), ("form", 0.1), ("menu", 0.06)):
        if draw.random() < p:
            inner.insert(draw.randint(0, len(inner)), f"\1{_noise(draw, kind)}\2")
    if draw.random() < 0.15:
        inner.append(f"\1{_noise(draw, 'comments')}\2")
    tag = draw.choice(["article", "article", "article", "main", "div", "section", None])
    body = "".join(inner)
    if tag:
        body = (_open(draw, tag, GROUPS["good"].split()[:9]) if tag != "div" else f'<div class="{draw.choice(GROUPS["good"].split()[:9])}">') + body + f"</{tag}>"
    before = [f"\1{_noise(draw, k)}\2" for k, p in (("notice", 0.25), ("header", 0.4), ("menu", 0.75), ("advert", 0.45), ("form", 0.2), ("sidebar", 0.15)) if draw.random() < p]
    after = [f"\1{_noise(draw, k)}\2" for k, p in (("sidebar", 0.3), ("comments", 0.4), ("advert", 0.25), ("notice", 0.2), ("form", 0.15), ("menu", 0.15), ("footer", 0.8)) if draw.random() < p]
    draw.shuffle(before)
    for _ in range(draw.choice([0, 0, 1, 2])):
        body = f'<div{draw.choice(["", " class=wrapper", " id=page", " class=container", " id=content"])}>{body}</div>'
    whole = "".join(before) + body + "".join(after)
    head = f"<title>{_words(draw, 5)}</title><style>p{{a:b}}</style>" if draw.random() < 0.8 else ""
    source = f"<!DOCTYPE html><html><head>{head}</head><body>{whole}" + draw.choice(["</body></html>", ""])
    # Characters 1 and 2 bracket noise in the source; in the tree they are runs or parts of runs, and are taken out again.
    root = parse(source.replace("\1", "<mark-on></mark-on>").replace("\2", "<mark-off></mark-off>"))
    good, level = set(), 0
    for n in nodes_of(root):
        if n.tag == "mark-on":
            level += 1
        elif n.tag == "mark-off":
            level -= 1
        elif n.tag == "#text" and not level:
            while n is not None and id(n) not in good:
                good.add(id(n))
                n = n.parent
    for n in nodes_of(root):
        n.children = [c for c in n.children if c.tag not in ("mark-on", "mark-off")]
    return root, good


@cache
def model(pages: int = PAGES, seed: int = SEED) -> Trees:
    draw = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        root, good = teaching_page(draw)
        nodes = nodes_of(root)
        xs.append(describe(nodes)[1:])
        ys.append([id(n) in good for n in nodes[1:]])
    return Trees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


#: Nodes whose features are scored together.
NODES = 8192


def texts(sources: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page."""
    out, held, size = [], [], 0

    def scored() -> None:
        odds, at = trees.log_odds(np.concatenate([describe(p) for p in held])), 0
        for p in held:
            out.append(written(p, odds[at : at + len(p)]))
            at += len(p)
        held.clear()

    for s in sources:
        nodes = nodes_of(parse(s))
        if size + len(nodes) > NODES and held:
            scored()
            size = 0
        if len(nodes) > NODES:
            out.append(written(nodes, np.concatenate([trees.log_odds(x) for x in described(nodes)])))
        else:
            held.append(nodes)
            size += len(nodes)
    if held:
        scored()
    return out


def written(nodes: list[Node], odds: np.ndarray) -> str:
    return "\n\n".join(n.text for n in decode(nodes, odds))


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text of every page."""
    held = pages.sparkSession.sparkContext.broadcast(trees or model())

    def task(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts(part.column(2).to_pylist(), held.value), pa.string())], ["page_id", "url", "text"])

    return narrow(pages, "page_id", "url", "html").mapInArrow(task, "page_id long, url string, text string")
