"""Main text of web pages by minimum-cut labelling.

A page is split into text blocks at block-level tags.  A linear classifier over
tag, name, length and link features gives each block the cost of calling it
content or boilerplate; these become capacities to the two terminals.  Blocks
that follow one another and blocks that are near in the tree are joined by
smoothness edges.  The minimum cut separates content from boilerplate; it is
found by max-flow (Dinic) after an exact reduction that fixes every block whose
own costs outweigh all of its smoothness edges.

The classifier is a logistic regression, fitted when first needed on pages that
:func:`examples` composes of marked content and boilerplate in varied layouts.
A container counts as boilerplate by its tag or by a word of its class, id or
role, unless the word is negated (``no-ads``, ``has-sidebar``) or the container
holds the page's article or most of its text: names are evidence, not a verdict.

Scripts, styles, comments, the head and embedded objects never become blocks.
Character references are decoded once, white space inside a block becomes one
space, empty blocks vanish, content blocks are joined by a line end.  Null or
empty html gives an empty text, and so does a page without a content block.
Rows stay one to one, repeated rows and null ids included; very long pages are
read whole, in time linear in the page but for the cut.  Columns named text or
n_chars are replaced; of the others those asked for stay.
"""

from __future__ import annotations

import functools
import html as _html
import math
import random
import re

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SKIPPED = frozenset("script style head title noscript template iframe svg canvas object math audio video textarea select".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
#: A new one of these ends an open one.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BAD_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
GOOD_TAGS = frozenset("article main".split())
BAD_NAMES = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup "
    "social share sharing related recommended recommendations sidebar widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar header masthead footer contentinfo complementary "
    "comment comments disqus respond reply replies login register search skip legal copyright disclaimer dialog form".split()
)
GOOD_NAMES = frozenset("article content post entry main story".split())

#: Parts of a name that turn the next one round, or speak of the whole page.
NEGATING = frozenset("has no with without layout page body main wrapper single".split())
#: A container with more than this part of the page's text is not boilerplate by its name.
MOST = 0.5
FEATURES = ("bias", "log words", "paragraph", "heading", "in article", "good name", "bad container", "share of links", "end mark", "two sentences")
#: Smoothness: blocks in sequence, and nearest earlier block under the same parent.
SEQUENCE, PROXIMITY = 0.25, 0.5


class Block:
    __slots__ = ("bad", "chain", "good", "heading", "link_chars", "name", "paragraph", "parent", "text")


class Element:
    """An open or closed element: chars of text before and behind it, whether an article stands in it."""

    __slots__ = ("article", "begin", "end", "firm", "good", "name", "outer", "serial", "skipped", "suspect", "tag")

    def __init__(self, tag, serial, outer, good, name, skipped, suspect, firm, begin):
        self.tag, self.serial, self.outer, self.good, self.name, self.skipped = tag, serial, outer, good, name, skipped
        self.suspect, self.firm, self.begin, self.end, self.article = suspect, firm, begin, None, False


def named_bad(names: list[list[str]]) -> bool:
    """Whether a name has a word of boilerplate that no word before it turns round."""
    return any(w in BAD_NAMES and not NEGATING.intersection(words[:i]) for words in names for i, w in enumerate(words))


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    root = Element("", 0, None, False, False, False, False, False, 0)
    stack, suspects = [root], []  # suspects: elements that may be boilerplate, outer ones first
    opened: dict[str, int] = {}
    serial, pending, links, link_depth, at, chars = 0, [], 0, 0, 0, 0

    def flush() -> None:
        nonlocal pending, links, chars
        if pending:
            text = " ".join(_html.unescape("".join(pending)).split())
            if text:
                top = stack[-1]
                tag = next((e for e in reversed(stack) if e.tag not in INLINE), root)
                b = Block()
                b.text, b.good, b.name, b.chain = text, top.good, top.name, top
                b.paragraph, b.heading = tag.tag[:1] == "p" and len(tag.tag) == 1, tag.tag[:1] == "h" and tag.tag[1:].isdigit()
                b.link_chars, b.parent = min(links, len(text)), stack[-2].serial if tag is top and len(stack) > 1 else tag.serial
                chars += len(text)
                out.append(b)
            pending, links = [], 0

    def text_until(end: int) -> None:
        nonlocal links
        if end > at and not stack[-1].skipped:
            piece = page[at:end]
            pending.append(piece)
            if link_depth:
                links += len(piece)

    def pop_to(k: int) -> None:
        nonlocal link_depth
        for e in stack[k:]:
            link_depth -= e.tag == "a"
            opened[e.tag] -= 1
            e.end = chars
            stack[k - 1].article |= e.article or e.tag in GOOD_TAGS and not e.suspect
        del stack[k:]

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text_until(n)
            break
        text_until(m.start())
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "br":
            pending.append(" ")
            continue
        inline = tag in INLINE
        if closing:
            if not inline:
                flush()
            if opened.get(tag):
                k = len(stack) - 1
                while k > 0 and stack[k].tag != tag and not (inline and stack[k].tag not in INLINE):
                    k -= 1
                if k > 0 and stack[k].tag == tag:
                    pop_to(k)
            continue
        if not inline:
            flush()
            if tag not in VOID:
                shut = CLOSES.get(tag)
                for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    if stack[i].tag == "p" or shut and stack[i].tag in shut:
                        pop_to(i)
                    elif stack[i].tag not in INLINE:
                        break
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else n
            if tag not in SKIPPED or end is None:
                continue
            close = page.find(">", at)
            at = close + 1 if close >= 0 else n
            continue
        top = stack[-1]
        serial += 1
        names = [[w.lower() for w in PARTS.findall(name)] for a in ATTRIBUTE.finditer(attributes) for name in a[2].strip("\"'").split()] if attributes else []
        firm = tag in BAD_TAGS and tag != "form" or tag == "header" and not top.good
        suspect = firm or tag == "form" or tag not in ("html", "body", "main") and named_bad(names)
        e = Element(tag, serial, top, top.good or tag in GOOD_TAGS, top.name or any(w in GOOD_NAMES for words in names for w in words), top.skipped or tag in SKIPPED, suspect, firm, chars)
        stack.append(e)
        opened[tag] = opened.get(tag, 0) + 1
        if suspect:
            suspects.append(e)
        link_depth += tag == "a"
    flush()
    pop_to(1)
    bad = {e.serial for e in suspects if e.firm or not e.article and e.end - e.begin <= MOST * chars}
    within: dict[int, bool] = {0: False}
    for b in out:
        todo, e = [], b.chain
        while e.serial not in within:
            todo.append(e)
            e = e.outer
        known = within[e.serial]
        for e in reversed(todo):
            known = within[e.serial] = known or e.serial in bad
        b.bad, b.chain = known, None
    return out


def features(b: Block) -> list[float]:
    return [
        1.0,
        math.log1p(b.text.count(" ") + 1),
        float(b.paragraph),
        float(b.heading),
        float(b.good),
        float(b.name),
        float(b.bad),
        b.link_chars / len(b.text),
        float(b.text[-1] in ".!?…"),
        float(len(re.findall(r"[.!?…]\s", b.text)) >= 1),
    ]


def examples(pages: int = 240, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Composed pages and, for each, the marks of its content blocks (other blocks have other marks)."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    out = []
    for _ in range(pages):
        marks: list[str] = []
        count = 0

        def text(low: int, high: int, content: bool, marks=marks) -> str:
            nonlocal count
            count += 1
            mark = f"{'c' if content else 'x'}{count}q"
            if content:
                marks.append(mark)
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(low, high))]
            for i in range(rng.randrange(6, 14), len(words), 11):
                words[i] += "."
            return f"{mark} {' '.join(words)}" + ("." if high > 12 and rng.random() < 0.9 else "")

        link_list = lambda k, text=text: "<ul>" + "".join(f'<li><a href="/x">{text(1, 4, False)}</a></li>' for _ in range(k)) + "</ul>"
        body = [f"<h1>{text(3, 9, True)}</h1>"]
        for _ in range(rng.randrange(1, 7)):
            body.append(rng.choice(["<p>{}</p>"] * 5 + ["<p><b>{}</b>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>"]).format(text(12, 80, True)))
            if rng.random() < 0.2:
                body.append(f"<h2>{text(2, 6, True)}</h2><p>{text(5, 30, True)}</p>")
            if rng.random() < 0.15:
                body.append(f'<div class="{rng.choice(["ad", "ad-slot", "promo", "newsletter-signup", "share-buttons"])}">{text(2, 14, False)}</div>')
        wrap = rng.choice(["<article>{}</article>"] * 3 + ["<main>{}</main>", '<div class="post-content">{}</div>', '<div id="content">{}</div>', '<div class="content-with-sidebar"><article>{}</article></div>', "<section>{}</section>", '<form id="aspnetForm"><div>{}</div></form>'])
        parts = [wrap.format("".join(body))]
        extra = [
            lambda text=text: f"<nav>{link_list(rng.randrange(3, 9))}</nav>",
            lambda text=text: f'<div class="{rng.choice(["menu", "navbar", "breadcrumbs", "topnav menu"])}">{link_list(rng.randrange(2, 6))}</div>',
            lambda text=text: f"<header><p>{text(1, 8, False)}</p></header>",
            lambda text=text: f'<div class="{rng.choice(["cookie-notice", "consent", "banner alert"])}">{text(6, 25, False)}<button>{text(1, 2, False)}</button></div>',
        ]
        below = [
            lambda text=text: f"<footer>{text(4, 20, False)}</footer>",
            lambda text=text: f"<aside><h3>{text(1, 4, False)}</h3>{link_list(4)}<p>{text(8, 20, False)}</p></aside>",
            lambda text=text: f'<div class="sidebar"><p>{text(8, 30, False)}</p>{link_list(3)}</div>',
            lambda text=text: f'<section id="comments"><h3>{text(1, 3, False)}</h3>' + "".join(f'<div class="comment"><p>{text(5, 40, False)}</p></div>' for _ in range(rng.randrange(1, 4))) + "</section>",
            lambda text=text: f'<div class="related">{link_list(rng.randrange(2, 5))}</div>',
            lambda text=text: f'<form action="/s"><label>{text(1, 3, False)}</label></form>',
            lambda text=text: f"<p>&copy; {text(2, 6, False)}</p>" if rng.random() < 0.3 else f'<div id="legal">{text(5, 15, False)}</div>',
        ]
        parts[:0] = [f() for f in rng.sample(extra, rng.randrange(1, 4))]
        parts += [f() for f in rng.sample(below, rng.randrange(1, 5))]
        names = rng.choice(["", "", ' class="has-sidebar"', ' class="layout no-ads"', ' class="single-post comment-open"', ' id="page-legal"'])
        out.append((f"<html><head><title>t</title></head><body{names}>{''.join(parts)}</body></html>", marks))
    return out


def fit(pages: list[tuple[str, list[str]]], rounds: int = 60, penalty: float = 2e-3) -> list[float]:
    """Weights of the logistic regression, by Newton's method."""
    x, y = [], []
    for page, marks in pages:
        good = set(marks)
        for b in blocks_of(page):
            x.append(features(b))
            y.append(float(any(w in good for w in b.text.split())))
    a, t = np.array(x), np.array(y)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = a.T @ (p - t) / len(t) + penalty * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(t) + penalty * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


@functools.lru_cache(maxsize=1)
def default_weights() -> tuple[float, ...]:
    return tuple(fit(examples()))


def score(b: Block, weights) -> float:
    """Log-odds that a block is content."""
    return sum(w * f for w, f in zip(weights, features(b), strict=True))


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut.

    ``source[i]`` is paid if node i falls on the sink side, ``sink[i]`` if on
    the source side, an edge's capacity if its ends are separated.  Nodes on
    which nothing depends fall on the sink side.
    """
    n = len(source)
    gain = [a - b for a, b in zip(source, sink, strict=True)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        if i != j and c > 0:
            near[i][j] = near[i].get(j, 0.0) + c
            near[j][i] = near[j].get(i, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:  # whoever outweighs all of its open neighbours is decided
        i = todo.pop()
        if label[i] is not None:
            continue
        if abs(gain[i]) >= sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, c in near[i].items():
                gain[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    core = [i for i in range(n) if label[i] is None]
    if core:
        side = _dinic(core, gain, near)
        for i in core:
            label[i] = i in side
    return [bool(x) for x in label]


def _dinic(core: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow."""
    place = {v: k + 2 for k, v in enumerate(core)}
    cap: list[dict[int, float]] = [{} for _ in range(len(core) + 2)]
    for v in core:
        k = place[v]
        if gain[v] > 0:
            cap[0][k], cap[k][0] = gain[v], 0.0
        elif gain[v] < 0:
            cap[k][1], cap[1][k] = -gain[v], 0.0
        for u, c in near[v].items():
            cap[k][place[u]] = c
    tiny = 1e-12
    while True:
        level, queue = {0: 0}, [0]
        for x in queue:
            for y, c in cap[x].items():
                if c > tiny and y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        if 1 not in level:
            return {v for v in core if place[v] in level}
        left = {x: list(cap[x]) for x in level}
        path = [0]
        while path:
            x = path[-1]
            if x == 1:
                push = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                cut = 0
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    cap[a][b] -= push
                    cap[b][a] = cap[b].get(a, 0.0) + push
                    if cap[a][b] <= tiny and not cut:
                        cut = k + 1
                del path[cut:]
                if not path:
                    path = [0]
                continue
            while left[x]:
                y = left[x][-1]
                if cap[x].get(y, 0.0) > tiny and level.get(y) == level[x] + 1:
                    path.append(y)
                    break
                left[x].pop()
            else:  # a dead end: its predecessor tries another way
                path.pop()
                if path:
                    left[path[-1]].pop()


def main_text(page: str | None, weights=None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    weights = weights or default_weights()
    logits = [score(b, weights) for b in blocks]
    soft = lambda z: math.log1p(math.exp(-abs(z))) + max(z, 0.0)
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, SEQUENCE))
        if (j := last.get(b.parent)) is not None:
            edges.append((j, i, PROXIMITY))
        last[b.parent] = i
    content = min_cut([soft(z) for z in logits], [soft(-z) for z in logits], edges)
    return "\n".join(b.text for b, keep in zip(blocks, content, strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id_col, *keep, text, n_chars) of every row."""
    common.small_batches(pages.sparkSession)
    weights = default_weights()
    src = pages.select(F.struct(*[pages[c] for c in (id_col, *keep) if c not in ("text", "n_chars")]).alias("row"), pages[html_col].cast("string").alias("html"))
    kind = src.schema["row"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(h, weights) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])

    out = src.mapInArrow(run, f"row {kind}, text string, n_chars long")
    return out.select("row.*", "text", "n_chars")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
