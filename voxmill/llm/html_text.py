"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of elements. Each element has features of its subtree (text and link
density, tags, words), its attribute tokens, its depth and its siblings; boosted trees give
the odds that it is or holds main text. Decoding picks the consistent labelling of the whole
tree with the largest likelihood: an element that is dropped takes its descendants along,
and a descendant stays only under elements that stay.

Training pages are a bounded sample of the table's own pages. Elements of plain meaning
(article, nav, footer, ...) cut them into main and other blocks; the blocks are laid out
again under many schemes, with plain and with telling tags, classes and ids, which gives
labelled trees that differ from the pages they came from.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm import boosting
from voxmill.llm.common import sampled

# Fixed values of HTML: elements without content, of raw text, inline ones, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg xmp noframes".split())
#: Of these, elements that may be closed in their own tag, and that hide nothing behind them if they are never closed.
SELF_CLOSED = frozenset("svg iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle mpadded semantics".split())
BLOCK = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul tr td th tbody thead tfoot caption summary".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
SCOPES = frozenset("ul ol dl table body html div section article aside nav header footer main form td th blockquote".split())
HIDDEN = frozenset("head title".split())
#: What may open inside the head; anything else, or text, ends it.
HEAD = frozenset("title meta link base style script noscript template".split())

#: A quote delimits a value only after "="; elsewhere it is a character of its attribute. No part is tried twice.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|[\"'])*+)>", re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.\-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?", re.S)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Attribute words that tell what a block is for.
GROUPS: tuple[tuple[str, ...], ...] = (
    ("article", "post", "entry", "content", "story", "main", "text", "prose", "page"),
    ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "tabs", "pagination", "pager", "toc"),
    ("header", "masthead", "banner", "topbar", "branding", "logo", "hero"),
    ("footer", "foot", "copyright", "legal", "colophon", "bottom", "imprint"),
    ("sidebar", "aside", "side", "widget", "rail", "complementary"),
    ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promoted", "banner", "dfp", "adsense"),
    ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "toast", "dialog", "message", "warning", "info"),
    ("comment", "comments", "respond", "reply", "replies", "disqus", "discussion", "feedback", "reader"),
    ("form", "newsletter", "subscribe", "subscription", "signup", "login", "search", "contact", "register"),
    ("share", "social", "related", "recommended", "more", "trending", "popular", "tags", "byline", "author", "meta"),
)
TAGS = ("div", "p", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "h1", "h2", "span", "a", "body", "blockquote", "figure", "dialog", "pre", "button")


@dataclass
class Node:
    tag: str
    words: tuple[str, ...] = ()
    parent: Node | None = None
    parts: list[Node | str] = field(default_factory=list)
    hidden: bool = False
    closed: bool = False
    above: Node | None = None
    linked: bool = False

    def children(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]


def _words(attributes: str) -> tuple[tuple[str, ...], bool]:
    found, hidden = [], False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            found += [x.lower() for x in NAME_PART.findall(entities.unescape(value))]
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    return tuple(found), hidden


def parse(page: str | None) -> Node:
    """Element tree of a page. Text stays as written; unclosed and stray tags never fail."""
    root = Node("#root")
    at, end, page = root, 0, page or ""
    last, never = page.rfind(">") + 1, set()  # nothing behind the last ">" is a tag; tags that are not closed any more

    def closing(tag: str) -> int | None:
        found = None if tag in never else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, end)
        if found is None:
            never.add(tag)
        return found and found.end()

    while (m := TOKEN.search(page, end, last)) is not None:
        if m.start() > end:
            text = page[end : m.start()]
            if at.tag == "head" and text.strip():
                at = at.parent
            at.parts.append(text)
        end = m.end()
        tag = m.group(2)
        if tag is None:
            if (m.group().startswith("<!--") and not m.group().endswith("-->")) or (m.group().startswith("<![CDATA[") and not m.group().endswith("]]>")):
                end = len(page)
            continue
        tag = tag.lower()
        if m.group(1):
            node = at
            while node is not root and node.tag != tag:
                if node.tag in ("td", "th", "table") and tag in INLINE:
                    node = root
                    break
                node = node.parent
            if node is not root:
                node.closed = True
                at = node.parent
            continue
        if tag not in HEAD:
            while at.tag in HIDDEN:
                at = at.parent
        if tag == "br" or tag == "hr" or tag == "wbr" or tag in VOID:
            if tag != "wbr":
                at.parts.append(" ")
            continue
        if tag in BLOCK:  # an open paragraph ends where a block begins
            node = at
            while node is not root and (node.tag in INLINE):
                node = node.parent
            if node.tag == "p":
                at = node.parent
        if tag in CLOSES:
            node = at
            while node is not root and node.tag not in SCOPES:
                if node.tag in CLOSES[tag]:
                    at = node.parent
                node = node.parent
            if node.tag in CLOSES[tag]:
                at = node.parent
        words, hidden = _words(m.group(3)) if m.group(3).strip(" /\t\r\n") else ((), False)
        node = Node(tag, words, at, [], hidden)
        at.parts.append(node)
        if tag == "title":  # its content is text, tags or not; one that is never closed ends with the head
            close = closing(tag)
            end = close or end
            at = at if close else node
            continue
        if tag in RAW:
            node.hidden = True
            if not (tag in SELF_CLOSED and m.group(3).rstrip().endswith("/")):
                end = closing(tag) or (end if tag in SELF_CLOSED else len(page))
            continue
        if not m.group(3).endswith("/") or tag in BLOCK or tag in INLINE:
            at = node
    if end < len(page):
        if at.tag == "head":
            at = at.parent
        at.parts.append(re.split(r"<[!?]", page[end:], maxsplit=1)[0])
    return root


def clean_text(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


def elements(root: Node) -> list[Node]:
    """Elements that may hold text, parents first: not raw ones, not the head, and inline ones only as part of their block.

    Blocks below an inline element are listed too; ``above`` is the nearest listed ancestor, and
    ``linked`` tells of a link around the block (an anchor that is never closed is none).
    """
    out: list[Node] = []
    waiting: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    while waiting:
        node, above, linked = waiting.pop()
        if node.tag not in INLINE:
            node.above, node.linked = above, linked
            out.append(node)
            above = node
        elif node.hidden:
            continue
        else:
            linked = linked or (node.tag == "a" and node.closed)
        waiting += [(c, above, linked) for c in reversed(node.children()) if c.tag not in RAW and c.tag not in HIDDEN]
    return out


def _parents(nodes: list[Node]) -> list[int]:
    """Place of each element's nearest listed ancestor."""
    place = {id(x): k for k, x in enumerate(nodes)}
    return [place[id(x.above)] if x.above is not None else 0 for x in nodes]


GROUP_OF = {w: [k for k, g in enumerate(GROUPS) if w in g] for g in GROUPS for w in g}


def _tally(node: Node) -> tuple[int, int, int, int, int]:
    """(characters, characters in links, commas and stops, tags, links) of the text that belongs to the node's own block."""
    chars = linked = stops = tags = links = 0
    waiting: list[tuple[Node, bool]] = [(node, node.linked)]
    while waiting:
        at, in_link = waiting.pop()
        for x in at.parts:
            if isinstance(x, str):
                n = len(x.strip())
                chars += n
                linked += n * in_link
                stops += x.count(",") + x.count(".")
            elif x.tag in INLINE:
                tags += 1
                links += x.tag == "a"
                waiting.append((x, in_link or x.tag == "a"))
    return chars, linked, stops, tags, links


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each element of a page, in the order of :func:`elements`."""
    n = len(nodes)
    own = np.array([_tally(x) for x in nodes], float).reshape(n, 5)
    parent = np.array(_parents(nodes))
    depth, whole = np.zeros(n), own.copy()
    whole[:, 3] += 1
    kids, paragraphs, below = np.zeros(n), np.array([float(x.tag == "p") for x in nodes]), np.ones(n)
    for k in range(1, n):
        depth[k] = depth[parent[k]] + 1
    order, before = np.zeros(n), np.zeros(n)
    for k in range(1, n):
        order[k] = kids[parent[k]]
        kids[parent[k]] += 1
    for k in range(n - 1, 0, -1):
        whole[parent[k]] += whole[k]
        paragraphs[parent[k]] += paragraphs[k]
        below[parent[k]] += below[k]
    longest = np.zeros(n)
    for k in range(1, n):
        longest[parent[k]] = max(longest[parent[k]], whole[k, 0])
        before[k] = before[k - 1] + own[k - 1, 0]
    chars = whole[:, 0]
    total = max(1.0, chars[0])
    marks = np.zeros((n, len(GROUPS)))
    for k, x in enumerate(nodes):
        for w in x.words:
            for g in GROUP_OF.get(w, ()):
                marks[k, g] += 1
    above = np.zeros((n, len(GROUPS)))
    for k in range(1, n):
        above[k] = np.maximum(above[parent[k]], marks[parent[k]])
    tag = np.array([[x.tag == t for t in TAGS] for x in nodes], float).reshape(n, len(TAGS))
    under = np.zeros((n, len(TAGS)))
    for k in range(1, n):
        under[k] = np.maximum(under[parent[k]], tag[parent[k]])
    shape = np.stack([
        depth, np.log1p(chars), chars / total, whole[:, 1] / np.maximum(1, chars), whole[:, 2] / np.maximum(1, chars), chars / whole[:, 3], np.log1p(whole[:, 4]),
        np.log1p(paragraphs), paragraphs / below, kids, order, order / np.maximum(1, kids[parent]), np.log1p(own[:, 0]), own[:, 0] / np.maximum(1, chars),
        longest / np.maximum(1, chars), chars / np.maximum(1, chars[parent]), (longest[parent] == chars).astype(float), before / total, np.array([len(x.words) for x in nodes], float), np.array([float(x.hidden) for x in nodes]),
    ], axis=1)
    return np.concatenate([shape, marks, above, tag, under], axis=1).astype(np.float32)


def decode(nodes: list[Node], margin: np.ndarray) -> np.ndarray:
    """Kept elements of the most likely consistent labelling."""
    n = len(nodes)
    parent = _parents(nodes)
    yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    drop, stay = no.copy(), yes.copy()
    for k in range(n - 1, 0, -1):
        drop[parent[k]] += drop[k]
        stay[parent[k]] += max(drop[k], stay[k])
    kept = np.zeros(n, bool)
    for k in range(n):
        kept[k] = (k == 0 or kept[parent[k]]) and not nodes[k].hidden and (k == 0 or stay[k] > drop[k])
    return kept


def text_of(nodes: list[Node], kept: np.ndarray) -> str:
    """Text of the kept elements in page order; a block's text ends where another block begins."""
    wanted = {id(x) for x, k in zip(nodes, kept) if k}
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        made = clean_text(run)
        run.clear()
        if made:
            blocks.append(made)

    waiting: list[Node | str | None] = [nodes[0]]
    while waiting:
        x = waiting.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag in INLINE:
            if not x.hidden:
                waiting += reversed(x.parts)
        elif id(x) in wanted:
            flush()
            waiting.append(None)
            waiting += reversed(x.parts)
        else:
            flush()
    flush()
    return " ".join(blocks)


# Training pages.

MAIN_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset(("nav", "footer", "aside", "header", "form", "dialog"))


def _plain_blocks(root: Node) -> tuple[list[str], list[str]]:
    """(paragraphs of main elements, texts of other elements) of a page, both escaped."""
    main: list[str] = []
    other: list[str] = []
    for node in elements(root):
        line = []
        x: Node | None = node
        while x is not None:
            line.append(x)
            x = x.above
        texts = clean_text([p for p in _inline(node)])
        if not texts:
            continue
        if any(y.tag in OTHER_TAGS or any(g in (1, 3, 4, 5, 6, 7, 8) for w in y.words for g in GROUP_OF.get(w, ())) for y in line):
            other.append(entities.escape(texts))
        elif any(y.tag in MAIN_TAGS for y in line):
            main.append(entities.escape(texts))
    return main, other


def _inline(node: Node) -> list[str]:
    out: list[str] = []
    waiting: list[Node | str] = list(reversed(node.parts))
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag in INLINE:
            waiting += reversed(x.parts)
    return out


def _attribute(rng: random.Random, group: int, telling: float) -> str:
    if rng.random() > telling:
        return rng.choice(["", "", f' class="c{rng.randrange(99)}"', ' class="row"', ' class="box wrap"'])
    word = rng.choice(GROUPS[group])
    return rng.choice([f' class="{word}"', f' id="{word}"', f' class="{word}-{rng.choice(["box", "wrap", "list", "inner", "block"])}"', f' class="site-{word} col"'])


def _links(rng: random.Random, words: list[str]) -> str:
    item = [f'<a href="/{k}">{w}</a>' for k, w in enumerate(words)]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in item) + "</ul>" if rng.random() < 0.7 else "<p>" + " ".join(item) + "</p>"


def lay_out(rng: random.Random, main: list[str], other: list[str]) -> tuple[str, str]:
    """(page, mark) where elements of main text carry the attribute ``data-main``."""
    telling = rng.choice((0.5, 0.9, 1.0))
    words = lambda n: [rng.choice(" ".join(other + main).split()) for _ in range(n)]
    line = lambda: rng.choice(other) if other and rng.random() < 0.6 else " ".join(words(rng.randrange(3, 40)))

    def block(group: int, tags: tuple[str, ...], inner: str) -> str:
        tag = rng.choice(tags)
        attribute = _attribute(rng, group, 1.0 if tag in ("div", "section", "p", "ul") else telling * 0.5)
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def comment() -> str:
        return "<div" + _attribute(rng, 7, 0.7) + "><p>" + line() + "</p></div>"

    kinds = {
        "nav": lambda: block(1, ("nav", "div", "ul"), _links(rng, words(rng.randrange(3, 12)))),
        "header": lambda: block(2, ("header", "div"), "<h1>" * 0 + "<p>" + line() + "</p>" + (_links(rng, words(4)) if rng.random() < 0.5 else "")),
        "footer": lambda: block(3, ("footer", "div"), "&copy; " + line() + (_links(rng, words(4)) if rng.random() < 0.4 else "")),
        "side": lambda: block(4, ("aside", "div"), "<h3>" + " ".join(words(3)) + "</h3>" + (_links(rng, words(6)) if rng.random() < 0.5 else "<p>" + line() + "</p>")),
        "ad": lambda: block(5, ("div", "aside", "section"), rng.choice(["", "<p>"]) + line()),
        "notice": lambda: block(6, ("div", "section", "dialog", "p"), line() + (" <button>OK</button>" if rng.random() < 0.5 else "")),
        "comments": lambda: block(7, ("section", "div", "ul"), "<h3>" + " ".join(words(2)) + "</h3>" + "".join(comment() for _ in range(rng.randrange(1, 6)))),
        "form": lambda: block(8, ("form", "div"), rng.choice(["<p>", "<label>"]) + line() + '<input name="q"><button>' + " ".join(words(1)) + "</button>"),
        "more": lambda: block(9, ("div", "section", "ul"), _links(rng, words(rng.randrange(3, 8)))),
    }
    inside = [rng.choice(("ad", "notice", "form", "more", "side")) for _ in range(rng.choice((0, 0, 1, 2)))]
    body = []
    for k, text in enumerate(main):
        tag = rng.choice(("p", "p", "p", "div", "blockquote", "li", "pre")) if k else rng.choice(("h1", "h2", "p"))
        one = f"<{tag} data-main>{text}</{tag}>"
        body.append(f"<ul data-main>{one}</ul>" if tag == "li" else one)
    for kind in inside:
        body.insert(rng.randrange(len(body) + 1), kinds[kind]())
    if rng.random() < 0.3 and body:  # the article's own header holds its title
        body[0] = f"<header data-main>{body[0]}</header>" if "data-main" in body[0] else body[0]
    inner = "".join(body)
    for _ in range(rng.randrange(0, 3)):
        inner = f"<div data-main{_attribute(rng, 0, 0.5)}>{inner}</div>"
    tag = rng.choice(("article", "main", "div", "div", "section"))
    holder = f"<{tag} data-main{_attribute(rng, 0, telling if tag in ('div', 'section') else 0.5)}>{inner}" + (kinds["comments"]() if rng.random() < 0.15 else "") + f"</{tag}>"
    if rng.random() < 0.1:  # nothing but the text, with and without a frame
        return rng.choice((holder, inner, body[0], f"<body data-main>{inner}</body>")), "data-main"
    front = [kinds[k]() for k in ("nav", "header", "ad", "notice", "side") if rng.random() < 0.55]
    back = [kinds[k]() for k in ("comments", "side", "more", "form", "ad", "footer", "notice") if rng.random() < 0.5]
    rng.shuffle(front)
    middle = holder
    if rng.random() < 0.4:
        middle = f"<div data-main{_attribute(rng, 0, 0.3)}>{rng.choice(front) if front else ''}{holder}{rng.choice(back) if back else ''}</div>"
    page = "<body data-main>" + "".join(front) + middle + "".join(back) + "</body>"
    return (f"<html data-main><head><title>{entities.escape(line())}</title></head>{page}</html>" if rng.random() < 0.7 else page), "data-main"


def plain_labels(nodes: list[Node]) -> list[float] | None:
    """Labels of a page's own elements by elements of plain meaning; None if no main one holds text."""
    n = len(nodes)
    parent = _parents(nodes)
    inside, other, holds = [False] * n, [False] * n, [False] * n
    for k, x in enumerate(nodes):
        inside[k] = x.tag in MAIN_TAGS or (k > 0 and inside[parent[k]])
        told = x.tag in OTHER_TAGS or any(g in (1, 3, 4, 5, 6, 7, 8) for w in x.words for g in GROUP_OF.get(w, ()))
        other[k] = (told and x.tag not in MAIN_TAGS) or (k > 0 and other[parent[k]])
        holds[k] = inside[k] and not other[k] and bool(clean_text(_inline(x)))
    for k in range(n - 1, 0, -1):
        holds[parent[k]] = holds[parent[k]] or holds[k]
    return [float(h) for h in holds] if holds[0] else None


def training_rows(pages: list[str], per_page: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the pages' own elements and of laid-out ones."""
    rng = random.Random(seed)
    xs, ys = [], []
    taken = [(m, o) for m, o in (_plain_blocks(parse(p)) for p in pages) if m]
    for page in pages:
        nodes = elements(parse(page))
        y = plain_labels(nodes)
        if y is not None:
            xs.append(features(nodes))
            ys.append(y)
    for main, other in taken:
        for _ in range(per_page):
            some = main if rng.random() < 0.5 else main[: rng.randrange(1, len(main) + 1)]
            page, _mark = lay_out(rng, some, other)
            marked = re.sub(r"<(\w+) data-main", r'<\1 role="xmainx"', page)
            nodes = elements(parse(re.sub(r'role="xmainx"((?:\s+(?:id|class)="[^"]*")*)', r'role="xmainx"\1', marked)))
            y = [float("xmainx" in x.words or x.tag == "#root") for x in nodes]
            for x in nodes:
                x.words = tuple(w for w in x.words if w != "xmainx")
            xs.append(features(nodes))
            ys.append(y)
    if not xs:
        return np.zeros((0, 1)), np.zeros(0)
    return np.concatenate(xs), np.concatenate(ys)


def fit(pages: DataFrame, most_pages: int = 400, per_page: int = 3, most_chars: int = 200_000, seed: int = 7, rounds: int = 50) -> boosting.Boosted:
    """Fit on at most ``most_pages`` pages of the table, taken by hash from those up to ``most_chars`` long.

    If no page has a main element of plain meaning, blocks of the smallest kind serve: a fixed
    pair of short texts, so that a model always exists.
    """
    usable = pages.where(F.length("html").between(1, most_chars)).select(F.xxhash64("html").alias("h"))
    chosen = sampled(usable.distinct(), F.col("h"), most_pages)  # at most most_pages hashes; copies count once
    held = pages.select("html", F.xxhash64("html").alias("h")).join(F.broadcast(chosen), "h", "left_semi")
    sample = [r["html"] for r in held.groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()]
    x, y = training_rows(sample, per_page, seed)
    if not len(y):
        stand_in = "<article><p>" + "A longer text, of two lines. " * 8 + "</p><p>It ends here, at last.</p></article><footer>one two</footer>"
        x, y = training_rows([stand_in], 60, seed)
    return boosting.fit(x, y, rounds=rounds)


def extract_pages(model: boosting.Boosted, pages: list[str | None]) -> list[str]:
    trees = [elements(parse(p)) for p in pages]
    margin = model.margin(np.concatenate([features(t) for t in trees])) if trees else np.zeros(0)
    out, at = [], 0
    for nodes in trees:
        out.append(text_of(nodes, decode(nodes, margin[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract(pages: DataFrame, model: boosting.Boosted, at_once: int = 64) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each page; null or empty html gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                texts = extract_pages(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
