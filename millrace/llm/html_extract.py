"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A logistic classifier, trained at call time on
``TRAIN_PAGES`` made pages of known layout (a fixed seed; the documented bound), gives
each block its chance of being content; the two log-costs become the capacities of
its edges to source and sink. Neighbouring blocks, and neighbours below one parent,
are joined by smoothness edges that grow with the depth of their nearest common
ancestor. A maximum flow gives the minimum cut; blocks on the source's side are the
main text.

Scripts, styles, templates, forms' controls, comments and the head have no blocks.
Character references are decoded, white space in a block becomes one space, and
blocks are joined in page order by a line feed; a line break element is white space.

Edge cases: null and empty pages, and pages without content, have an empty text;
broken markup is read as browsers do in the main (unclosed elements end with their
parent, an unclosed tag at the end is dropped); rows that repeat are answered once
each. Memory grows with one page, and the graph with its blocks.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import map_rows, texts_of

TOKEN = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|[!?/][^>]*+(?:>|\Z)|[A-Za-z/][^>]*+\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noframes", "noembed", "xmp", "svg", "math", "canvas", "object", "audio", "video", "head", "select", "button", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr"}
SPACE = {"br"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}

GOOD = re.compile(r"article|content|post|entry|story|body|main|text|prose|page", re.I)
BAD_WORDS = (
    ("menu", re.compile(r"\b(?:.*[-_])?(nav|navbar|navigation|menu|menus|breadcrumbs?|toc|pager|pagination|tabs?|skip)\b|menu|navbar|navigation", re.I)),
    ("edge", re.compile(r"header|footer|masthead|banner|topbar|bottom|copyright|colophon|legal", re.I)),
    ("side", re.compile(r"sidebar|aside|widget|related|recommend|rail|promo|popular|trending|more-?(?:stories|posts)|see-?also|tags?\b|share|social|author-?bio", re.I)),
    ("ad", re.compile(r"\bads?\b|\bad[-_]|[-_]ads?\b|advert|sponsor|adsense|dfp|outbrain|taboola|promoted", re.I)),
    ("notice", re.compile(r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|subscribe|newsletter|paywall|signup|sign-up|login|toast|disclaimer", re.I)),
    ("comment", re.compile(r"comment|disqus|respon[ds]e?s?\b|replies|reply|discussion|reader-?(?:feedback|opinion)", re.I)),
)
BAD_TAGS = {"nav": "menu", "menu": "menu", "header": "edge", "footer": "edge", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice", "figcaption": "caption", "address": "edge"}
BAD_ROLES = {"navigation": "menu", "banner": "edge", "contentinfo": "edge", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alert": "notice", "alertdialog": "notice", "menu": "menu", "menubar": "menu"}
MARKS = ("menu", "edge", "side", "ad", "notice", "comment", "form", "hidden", "caption")
FEATURES = (*MARKS, "article", "main", "good", "heading", "paragraph", "item", "links", "long", "sentence", "copyright", "one")

TRAIN_PAGES, SEED = 600, 11
SMOOTH, SHARED, SCALE = 0.25, 0.15, 1000


class Block:
    """``depth``: the elements around it; ``shared``: those also around the block before; ``parent``: the second innermost."""

    __slots__ = ("text", "linked", "tag", "flags", "depth", "shared", "parent")

    def __init__(self, text: str, linked: int, tag: str, flags: frozenset[str], depth: int, shared: int, parent: int):
        self.text, self.linked, self.tag, self.flags = text, linked, tag, flags
        self.depth, self.shared, self.parent = depth, shared, parent


@lru_cache(maxsize=20_000)
def flags_of(tag: str, attributes: str) -> frozenset[str]:
    """What an element's name and attributes say of all below it."""
    out = set()
    if tag in ("article", "main"):
        out.add(tag)
    if tag in BAD_TAGS:
        out.add(BAD_TAGS[tag])
    named = ""
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "itemprop"):
            named += " " + value
        elif key == "role":
            if value.lower() in BAD_ROLES:
                out.add(BAD_ROLES[value.lower()])
            elif value.lower() in ("main", "article"):
                out.add(value.lower())
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            out.add("hidden")
    if named and tag not in ("html", "body"):
        for name, found in BAD_WORDS:
            if found.search(named):
                out.add(name)
        if not out & set(MARKS) and GOOD.search(named):
            out.add("good")
    return frozenset(out)


def blocks_of(page: str) -> list[Block]:
    """Blocks of visible text in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, frozenset[str]]] = []
    parts: list[str] = []
    linked, in_link, serial, at, n = 0, 0, 0, 0, len(page)
    opened: Counter[str] = Counter()
    low = 0  # the least depth since the last block

    def cut(k: int) -> None:
        nonlocal low
        opened.subtract(t for t, _, _ in stack[k:])
        del stack[k:]
        low = min(low, k)

    def close() -> None:
        nonlocal linked, low
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                flags = stack[-1][2] if stack else frozenset()
                parent = stack[-2][1] if len(stack) > 1 else 0
                out.append(Block(text, min(linked, len(text)), stack[-1][0] if stack else "body", flags, len(stack), low, parent))
                low = len(stack)
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ending = name.lower(), bool(m[1] or m[4])
        attributes = m[3] if m[2] else m[6]
        if tag == "a":
            in_link = 0 if ending else 1
        if tag in INLINE:
            continue
        if tag in SPACE:
            parts.append(" ")
            continue
        if tag in RAW and not ending:
            if attributes.rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            if tag not in ("button", "select", "datalist"):
                if tag not in ("svg", "math"):
                    close()
            else:
                close()
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>" if tag != "head" else r"</head\s*>|(?=<body[\s>])|(?=<(?:article|main|div|p|h1|nav|header|section)[\s>])", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        close()
        if tag in VOID:
            continue
        if ending:
            if opened[tag] > 0:
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        in_link = 0 if tag != "a" else in_link
        if stack and stack[-1][0] == "p":
            cut(len(stack) - 1)
        if tag in CLOSES:
            ends, fences = CLOSES[tag]
            for k in range(len(stack) - 1 if any(opened[t] > 0 for t in ends) else -1, -1, -1):
                if stack[k][0] in fences:
                    break
                if stack[k][0] in ends:
                    cut(k)
                    break
        above = stack[-1][2] if stack else frozenset()
        own = flags_of(tag, attributes)
        if tag == "header" and "article" in above:
            own -= {"edge"}  # an article's own header holds its title
        serial += 1
        opened[tag] += 1
        stack.append((tag, serial, above | own if own else above))
    close()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), len(FEATURES)))
    for row, b in zip(x, blocks, strict=True):
        for k, mark in enumerate(MARKS):
            row[k] = mark in b.flags
        size = len(b.text)
        row[len(MARKS) :] = (
            "article" in b.flags,
            "main" in b.flags,
            "good" in b.flags,
            b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
            b.tag in ("p", "blockquote", "pre"),
            b.tag in ("li", "td", "th", "dd", "dt"),
            b.linked / size,
            min(size, 400) / 400,
            b.text[-1] in ".!?…。:\"'”»",
            not b.flags & {"article", "main"} and (b.text[0] == "©" or "all rights reserved" in b.text.lower()),
            1.0,
        )
    return x


def made_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """(html, content blocks) of made pages in many layouts."""
    r = np.random.default_rng(seed)
    count = [0]

    def words(a: int, b: int) -> str:
        count[0] += 1
        return f"w{count[0]} " + " ".join("".join("etaoinshrdlu"[i] for i in r.integers(0, 12, r.integers(2, 9))) for _ in range(r.integers(a, b)))

    pick = lambda *x: x[int(r.integers(0, len(x)))]
    out = []
    for _ in range(n):
        content: list[str] = []

        def body(content=content) -> str:
            made = []
            for k in range(int(r.integers(1, 14))):
                tag = "h1" if k == 0 else pick("p", "p", "p", "p", "h2", "li", "blockquote", "p", "div")
                text = words(1, 5) if tag[0] == "h" and tag != "h" else words(1, pick(4, 12, 60, 60)) + pick(".", ".", ".", "!", "")
                content.append(text)
                inner = f'<a href="/x">{text}</a>' if r.random() < 0.04 else text
                made.append(f"<ul><li>{inner}</li></ul>" if tag == "li" else f"<{tag}>{inner}</{tag}>")
            return "".join(made)

        def links(k: int) -> str:
            return "<ul>" + "".join(f'<li><a href="/">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

        def boiler() -> str:
            text, small = words(3, pick(8, 40)) + ".", words(1, 4)
            return pick(
                f"<nav>{links(5)}</nav>", f'<div class="menu">{links(4)}</div>', f"<header><h2>{small}</h2><p>{text}</p></header>",
                f'<aside><h3>{small}</h3><p>{text}</p>{links(3)}</aside>', f'<div class="sidebar"><p>{text}</p></div>', f'<div class="ad">{text}</div>',
                f'<div id="cookie-notice"><p>{text}</p></div>', f'<div class="newsletter"><p>{text}</p></div>', f'<section class="comments"><h2>{small}</h2><p>{text}</p><p>{words(5, 50)}.</p></section>',
                f"<form><label>{small}</label><p>{text}</p></form>", f"<footer><p>&copy; {text}</p></footer>", f'<div class="footer">{text}</div>',
                f'<div class="share">{small}</div>', f'<div class="related"><p>{text}</p></div>', f"<div>{links(6)}</div>", f'<div class="comment-list"><div class="comment"><p>{text}</p></div></div>', f'<p class="advert">{text}</p>', f'<div hidden><p>{text}</p></div>', f"<p>&copy; {text}</p>",
            )

        core = body()
        if r.random() < 0.4:
            core += boiler()
            core += body()
        wrap = pick("<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', "<main><article>{}</article></main>", '<div id="post">{}</div>', "<div>{}</div>", "<section>{}</section>", "{}", "<article>{}</article>")
        page = "".join(boiler() for _ in range(int(r.integers(0, 4)))) + wrap.format(core) + "".join(boiler() for _ in range(int(r.integers(0, 4))))
        out.append((f"<html><head><title>t</title></head><body>{page}</body></html>", content))
    return out


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> np.ndarray:
    """Logistic weights by Newton steps with a small ridge."""
    xs, ys = [], []
    for page, content in made_pages(pages, seed):
        own, blocks = set(content), blocks_of(page)
        if blocks:
            xs.append(features(blocks))
            ys.append([b.text in own for b in blocks])
    x, y = np.concatenate(xs), np.concatenate(ys).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.3 * np.eye(len(w)), x.T @ (p - y) + 0.3 * w)
    return w


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut (Dinic on the residual graph).

    What can flow straight through a node is sent first; then only smoothness edges matter.
    """
    n = len(source)
    s = [max(0, a - b) for a, b in zip(source, sink, strict=True)]
    t = [max(0, b - a) for a, b in zip(source, sink, strict=True)]
    to, cap, graph = [], [], [[] for _ in range(n)]
    for a, b, c in edges:
        graph[a].append(len(to))
        to.append(b)
        cap.append(c)
        graph[b].append(len(to))
        to.append(a)
        cap.append(c)
    while True:
        level = [-1] * n
        queue = deque(k for k in range(n) if s[k] > 0)
        for k in queue:
            level[k] = 0
        reached = False
        while queue:
            a = queue.popleft()
            if t[a] > 0:
                reached = True
                continue
            for e in graph[a]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        at = [0] * n
        for root in [k for k in range(n) if s[k] > 0]:
            while s[root] > 0:
                path, a = [], root
                while t[a] <= 0:  # depth first, without recursion
                    while at[a] < len(graph[a]):
                        e = graph[a][at[a]]
                        if cap[e] > 0 and level[to[e]] == level[a] + 1:
                            break
                        at[a] += 1
                    else:
                        if not path:
                            a = -1
                            break
                        e = path.pop()
                        a = to[e ^ 1]
                        at[a] += 1
                        continue
                    path.append(graph[a][at[a]])
                    a = to[path[-1]]
                if a < 0:
                    break
                flow = min([s[root], t[a], *(cap[e] for e in path)])
                s[root] -= flow
                t[a] -= flow
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Edges between neighbours, and from each block to the next below its parent."""
    out, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            a = blocks[k - 1]
            near = b.shared / max(a.depth, b.depth, 1)
            if a.flags == b.flags:
                out.append((k - 1, k, int(SCALE * SMOOTH * (1 + near))))
            else:
                out.append((k - 1, k, int(SCALE * SMOOTH * near / 2)))
        if b.parent in last and last[b.parent] != k - 1 and blocks[last[b.parent]].flags == b.flags:
            out.append((last[b.parent], k, int(SCALE * SHARED)))
        last[b.parent] = k
    return [e for e in out if e[2] > 0]


def extract(page: str, weights: np.ndarray) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    z = np.clip(features(blocks) @ weights, -8, 8)
    # Equal costs leave a block to its neighbours.
    source = [int(SCALE * math.log1p(math.exp(v))) for v in z]
    sink = [int(SCALE * math.log1p(math.exp(-v))) for v in z]
    side = min_cut(source, sink, smoothness(blocks))
    return "\n".join(b.text for b, content in zip(blocks, side, strict=True) if content)


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of every whole page; the markup is dropped."""
    weights = trained()

    def make():
        return lambda batch: [[extract(p, weights) for p in texts_of(batch, html)]]

    return map_rows(pages, make, [(text, T.StringType())], [c for c in pages.columns if c != html])
