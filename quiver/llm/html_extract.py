"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every element of a page is a row of features: its tag, attribute tokens, depth,
place among its siblings, how much text and how many links its subtree holds, and how these compare with its
siblings'. Boosted trees give the probability that the node belongs to the main text. Decoding
goes down the tree: a path may enter the main text once and leave it once, so a menu inside the article can be
left out, but no node is taken under one that was thrown out. Of all such choices the likeliest is found exactly.

The trees learn from a bounded sample of pages whose own semantic tags say where the text is. Some of them are
seen with these tags and class names made neutral, some with more asides, forms, notices and comments, so that the trees
also know pages without such help by their shape."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quiver.llm.common import spread_out

FIT_PAGES, TREES, DEPTH, RATE, BINS = 800, 60, 5, 0.25, 48

# Element kinds of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "head", "title", "iframe", "svg", "object", "textarea", "select", "button"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s",
          "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
            "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
TAG_GROUPS = [{"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "label", "input", "dialog"},
              {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"div", "section"}, {"a"},
              {"table", "tr", "td", "th", "tbody", "thead"}, {"body", "html"}, INLINE - {"a"}, {"pre", "blockquote", "figure", "figcaption"}]
GOOD_TOKENS = ["article", "content", "main", "post", "story", "entry", "body", "text"]
BAD_TOKENS = ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "nav", "menu", "breadcrumb", "header", "footer", "sidebar",
              "aside", "comment", "comments", "reply", "notice", "cookie", "consent", "popup", "modal", "newsletter", "subscribe", "share",
              "social", "related", "widget", "form", "login", "search", "copyright"]
HEAD_TAGS = {"title", "meta", "link", "base", "script", "style", "noscript", "template", "basefont", "bgsound", "noframes"}
SKIP_TAGS = {"nav", "menu", "header", "footer", "aside", "form", "dialog"}
TOKEN = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "depth", "texts")

    def __init__(self, tag: str, tokens: frozenset, parent: "Node | None"):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0


class Tree(HTMLParser):
    """A forgiving tree: void elements, implied ends of head, p, li, dt, dd, tr, td and option, stray end tags ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", frozenset(), None)
        self.nodes = [self.root]

    def open_p(self) -> "Node | None":
        n = self.at
        while n is not None and n.tag not in ("html", "body", "div", "article", "section", "li", "td", "table", "button"):
            if n.tag == "p":
                return n
            n = n.parent
        return None

    def open_head(self, tag: str) -> "Node | None":
        """The head that ``tag`` ends: one it stands in itself, or for body one it stands anywhere in."""
        n = self.at
        while tag == "body" and n.parent is not None and n.tag not in ("head", "template"):
            n = n.parent
        return n if n.tag == "head" else None

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and (p := self.open_p()) is not None:
            self.at = p.parent
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.at.tag in (
                ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)) and self.at.parent:
            self.at = self.at.parent
        if tag in ("html", "body") and self.at.depth < 2 and any(n.tag == tag for n in self.nodes[:64]):
            return
        if tag not in HEAD_TAGS and (head := self.open_head(tag)) is not None:
            self.at = head.parent
        tokens = frozenset(t for k, v in attrs if k in ("class", "id", "role", "itemprop") and v for t in TOKEN.findall(v.lower()))
        node = Node(tag, tokens, self.at)
        self.at.children.append(node)
        self.nodes.append(node)
        if tag not in VOID and node.depth < 400:  # deeper ones stay open as siblings; their text is kept
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            if tag in INLINE and n.tag not in INLINE:
                return
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        if self.at.tag == "head" and data.strip():
            self.at = self.at.parent
        if data:
            self.at.children.append(data)


def parse(html: str) -> list[Node]:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.nodes


FEATURES = len(TAG_GROUPS) + 17


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node, in document order (a node comes before its descendants)."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    chars, links, tags, words, stops = (np.zeros(n) for _ in range(5))
    for i, x in enumerate(nodes):
        if x.tag in SILENT:
            continue
        for c in x.children:
            if isinstance(c, str):
                t = c.split()
                words[i] += len(t)
                chars[i] += sum(map(len, t))
                stops[i] += c.count(".") + c.count(",") + c.count("?") + c.count("!")
        if x.tag == "a":
            links[i] = chars[i]
    parent = np.array([place[id(x.parent)] if x.parent else -1 for x in nodes])
    for i in range(n - 1, 0, -1):  # children add to their parents
        for a in (chars, links, words, stops):
            a[parent[i]] += a[i]
        tags[parent[i]] += tags[i] + 1
    own = np.maximum(1, chars)
    order, count = np.zeros(n), np.zeros(n)
    for i in range(1, n):
        order[i] = count[parent[i]]
        count[parent[i]] += 1
    out = np.zeros((n, FEATURES), np.float32)
    for k, group in enumerate(TAG_GROUPS):
        out[:, k] = [x.tag in group for x in nodes]
    g = len(TAG_GROUPS)
    sib = np.where(parent >= 0, count[parent], 1)
    total = max(1.0, chars[0])
    text_before = np.zeros(n)
    run = 0.0
    for i, x in enumerate(nodes):
        text_before[i] = run
        run += sum(len(c) for c in x.children if isinstance(c, str)) if x.tag not in SILENT else 0
    good, bad = frozenset(GOOD_TOKENS), frozenset(BAD_TOKENS)
    out[:, g] = [len(x.tokens & good) for x in nodes]
    out[:, g + 1] = [len(x.tokens & bad) for x in nodes]
    up = np.stack([out[:, g], out[:, g + 1], [x.tag in SKIP_TAGS for x in nodes], out[:, 0]], axis=1)
    for i in range(1, n):  # what the ancestors say
        up[i] += up[parent[i]]
    columns = [*up.T, [x.depth for x in nodes], order, sib, order / np.maximum(1, sib), np.log1p(chars), chars / total,
               links / own, chars / (tags + 1), np.log1p(words), stops / np.maximum(1, words), text_before / max(1.0, run)]
    for k, c in enumerate(columns):
        out[:, g + 2 + k] = c
    return out


def truth(nodes: list[Node]) -> np.ndarray | None:
    """1 for nodes inside the page's own article (or main), less menus, forms and the like in it; None without one."""
    label = np.zeros(len(nodes))
    place = {id(x): i for i, x in enumerate(nodes)}
    found = False
    for i, x in enumerate(nodes):
        up = label[place[id(x.parent)]] if x.parent else 0
        out = x.tag in SKIP_TAGS or x.tag in SILENT or bool(x.tokens & frozenset(BAD_TOKENS))
        label[i] = -1 if up == -1 or out else 1 if up == 1 or x.tag in ("article", "main") else 0
        found |= label[i] == 1
    return (label == 1).astype(float) if found else None


def neutral(nodes: list[Node]) -> None:
    """Take the meaning out of tags and attributes, as on pages that are all div."""
    for x in nodes:
        x.tokens = frozenset()
        if x.tag in SKIP_TAGS or x.tag in ("article", "main", "section"):
            x.tag = "div"


def rename(nodes: list[Node], rng: np.random.Generator) -> None:
    """An article as a div with a telling class, on half of the pages with telling classes for the rest."""
    for x in nodes:
        if x.tag in ("article", "main"):
            x.tag, x.tokens = "div", frozenset([GOOD_TOKENS[rng.integers(len(GOOD_TOKENS))]])


def varied(html: str, rng: np.random.Generator) -> str:
    """The page with more parts that are not its article, made from its own words: asides, forms, notices and comments before, in and behind
    the article, and with some of its paragraphs as other kinds of blocks."""
    words = re.sub(r"<[^>]*>", " ", html).split() or ["x"]

    def part() -> str:
        tag = ["div", "div", "section", "aside", "form", "header", "footer", "nav"][rng.integers(8)]
        name = BAD_TOKENS[rng.integers(len(BAD_TOKENS))]
        at, n = rng.integers(len(words)), int(rng.integers(1, 5))
        lines = [" ".join(words[at + 7 * k:at + 7 * k + int(rng.integers(1, 40))]) or "x" for k in range(n)]
        inner = ["".join(f"<p>{x}</p>" for x in lines), "<ul>" + "".join(f'<li><a href="/">{x}</a></li>' for x in lines) + "</ul>", lines[0],
                 "".join(f'<div class="{name}"><p>{x}</p></div>' for x in lines),
                 "".join(f"<label>{x}</label><input>" for x in lines)][4 if tag == "form" and rng.random() < 0.7 else rng.integers(4)]
        if tag not in ("div", "section") and rng.random() < 0.5:
            return f"<{tag}>{inner}</{tag}>"  # such a tag says enough
        return f'<{tag} class="{name}">{inner}</{tag}>'

    def parts() -> str:
        return "".join(part() for _ in range(int(rng.integers(0, 3))))

    def other(m: re.Match) -> str:
        k = rng.random()
        inner = m.group(1)
        if k < 0.06:
            return f"<ul><li>{inner}</li></ul>"
        if k < 0.1:
            return f"<blockquote>{inner}</blockquote>"
        if k < 0.14:
            return f"<h2>{inner[:60]}</h2><p>{inner}</p>"
        return m.group() + (part() if k > 0.97 else "")

    html = re.sub(r"<p>([^<]*)</p>", other, html)
    for mark in ("<article>", "</article>", "</body>"):
        html = html.replace(mark, parts() + mark)
    return html.replace("</article>", "</article>" + parts())


def boost(x: np.ndarray, y: np.ndarray) -> dict:
    """Trees of fixed depth on quantile bins, second-order gains, logistic loss."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    f, trees = np.zeros(len(y)), []
    width = BINS + 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for d in range(DEPTH):
            first, here = 2**d - 1, 2**d
            best = np.full(here, 1e-9)
            choice = np.zeros((here, 2), np.int64) - 1
            for j in range(x.shape[1]):
                key = (node - first) * width + binned[:, j]
                gs = np.bincount(key, g, here * width).reshape(here, width).cumsum(axis=1)
                hs = np.bincount(key, h, here * width).reshape(here, width).cumsum(axis=1)
                G, H = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (G - gs)**2 / (H - hs + 1) - G**2 / (H + 1)
                gain[:, len(cuts[j]):] = 0
                k = gain.argmax(axis=1)
                better = gain[np.arange(here), k] > best
                best[better] = gain[np.arange(here), k][better]
                choice[better] = np.stack([np.full(here, j), k], axis=1)[better]
            for i, (j, k) in enumerate(choice):
                if j >= 0:
                    feature[first + i], cut[first + i] = j, cuts[j][k]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        f += value[leaf]
        trees.append((feature, cut, value))
    return {"trees": trees}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    f, rows = np.zeros(len(x)), np.arange(len(x))
    for feature, cut, value in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        f += value[node - (2**DEPTH - 1)]
    return f


def decode(nodes: list[Node], logit: np.ndarray) -> np.ndarray:
    """The likeliest choice of states 0 (outside), 1 (main text), 2 (left out), where along a path states never fall. True: main text."""
    place = {id(x): i for i, x in enumerate(nodes)}
    n = len(nodes)
    gain = np.zeros((n, 3))
    gain[:, 1] = np.clip(logit, -8, 8)  # against not being main text
    for i, x in enumerate(nodes):
        if x.tag in SILENT:
            gain[i, 1] = -1e6
    best = gain.copy()
    for i in range(n - 1, 0, -1):
        p = place[id(nodes[i].parent)]
        b = best[i]
        best[p] += (max(b[0], b[1], b[2]), max(b[1], b[2]), b[2])
    state = np.zeros(n, np.int64)
    state[0] = 0 if best[0, 0] >= best[0, 1] else 1
    for i in range(1, n):
        s = state[place[id(nodes[i].parent)]]
        b = best[i]
        state[i] = s + int(np.argmax(b[s:]))
    return state == 1


def text_of(nodes: list[Node], take: np.ndarray) -> str:
    """Text of the chosen nodes in page order: white space inside a block as one space, blocks joined by one space."""
    place = {id(x): i for i, x in enumerate(nodes)}
    out: list[str] = []
    stack: list[tuple[Node, int]] = [(nodes[0], 0)]
    while stack:
        x, k = stack.pop()
        block = x.tag not in INLINE
        if k == 0 and block:
            out.append(" ")
        mine = bool(take[place[id(x)]])
        while k < len(x.children):
            c = x.children[k]
            k += 1
            if isinstance(c, str):
                if mine:
                    out.append(c)
            elif c.tag not in SILENT:
                stack.append((x, k))
                stack.append((c, 0))
                break
            else:
                out.append(" ")
        else:
            if block:
                out.append(" ")
    return " ".join("".join(out).split())


def fit(pages: list[str]) -> dict | None:
    xs, ys = [], []
    rng = np.random.default_rng(17)
    for i, html in enumerate(pages):
        nodes = parse(varied(html, rng) if i % 4 > 1 else html)
        y = truth(nodes)
        if y is None:
            continue
        if i % 4 == 1:
            neutral(nodes)
        if i % 4 == 3:
            rename(nodes, rng)
        xs.append(features(nodes))
        ys.append(y)
    if not xs:
        return None
    return boost(np.concatenate(xs), np.concatenate(ys))


def main_text(model: dict, html: str) -> str:
    nodes = parse(html)
    return text_of(nodes, decode(nodes, predict(model, features(nodes))))


def extract(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of each page. Null and empty html, and pages without main text, give an empty text; so does
    every page of a table in which no page marks its article. The model comes from the ``fit_pages`` pages whose hashed id comes first,
    of those that ``truth`` can use. Mostly these are among the first that hold such a tag; only if not, all pages with one are parsed."""
    spark = pages.sparkSession
    marked = pages.select(pages["page_id"].cast("long").alias("id"), F.xxhash64(pages["page_id"]).alias("o"), pages["html"].alias("html")).filter(
        F.col("html").rlike(r"(?i)<(article|main)[\s/>]"))

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = [h if truth(parse(h)) is not None else None for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(html, pa.string())], ["id", "o", "html"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        use = sorted((o, h) for h, o, _ in rows if h is not None)[:fit_pages]
        m = fit([h for _, h in use]) if use else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(m) if m else None], pa.binary()), pa.array([len(use)], pa.int64()),
                                          pa.array([sum(n for _, _, n in rows)], pa.int64())], ["model", "used", "seen"])

    def model_of(some: DataFrame) -> Row:
        ids = F.broadcast(some.select(F.col("id").alias("sid"), "o").orderBy("o", "sid").limit(fit_pages).select("sid"))
        found = marked.join(ids, F.col("id").eqNullSafe(F.col("sid")), "left_semi").mapInArrow(usable, "id long, o long, html string")
        found = found.groupBy("id", "o").agg(F.min("html").alias("html"), F.count(F.lit(1)).alias("n"))
        return found.select("html", "o", "n").repartition(1).mapInArrow(learn, "model binary, used long, seen long").first()

    found = model_of(marked)
    if found and found.used < fit_pages <= found.seen:
        found = model_of(spread_out(marked).mapInArrow(usable, "id long, o long, html string").filter("html is not null").select("id", "o").distinct())
    held = spark.sparkContext.broadcast(pickle.loads(bytes(found.model)) if found and found.model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts = []
            htmls = [h or "" for h in b.column(2).to_pylist()]
            for at in range(0, len(htmls), 64):  # the trees see the nodes of many pages at once
                parsed = [parse(h) for h in htmls[at:at + 64]]
                if m is None:
                    texts += [""] * len(parsed)
                    continue
                logit = predict(m, np.concatenate([features(p) for p in parsed]))
                cuts = np.cumsum([len(p) for p in parsed])[:-1]
                texts += [text_of(p, decode(p, z)) for p, z in zip(parsed, np.split(logit, cuts))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    src = spread_out(pages).select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
