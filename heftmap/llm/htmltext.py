"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements.  Trees score every block from subtree density, link and control shares, attribute
tokens, depth, ancestors and sibling statistics; a decoder then gives every block one of three states - mixed, content or
boilerplate - with the largest total score under the rules that nothing below boilerplate is content and that mixed blocks
hold no text of their own, so an ancestor never contradicts a descendant.

Pages have no labels, so training makes them: the main text and the surroundings of about ``TRAIN_PAGES`` given pages
(a parameter), found by their semantic elements, are set again in layouts with and without such elements, where every
block's side is known.  The trees are fitted on the driver from that bounded sample; all pages are extracted by tasks.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftmap.llm.common import map_rows

TRAIN_PAGES = 240
TREES, DEPTH, RATE, BINS, LEAF_ROWS = 40, 4, 0.3, 32, 10
SEED = 7
# Element names of HTML.
BLOCKS = frozenset(
    "html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd article section main header footer nav aside form fieldset table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address details summary dialog menu center hgroup search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template svg math iframe object audio video canvas textarea select option optgroup datalist button title".split())
IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript template".split())
CONTROLS = frozenset("input button select textarea label".split())
CLOSED_BY = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
KEEPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
TAG_GROUPS = ({"p", "blockquote", "pre", "dd", "figcaption"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"}, {"li", "dt"}, {"div", "section", "center"},
              {"article", "main"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "dialog", "search"}, {"table", "tr", "td", "th", "tbody"})
TOKEN_GROUPS = (
    "article content post entry story main body text prose blog page read".split(),
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip".split(),
    "header masthead topbar branding logo site".split(),
    "footer copyright colophon legal bottom".split(),
    "sidebar aside widget widgets related recommended recommendations popular trending rail teaser secondary more links archive tags".split(),
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner adsense dfp outbrain taboola commercial".split(),
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer message toast".split(),
    "comment comments commentlist reply replies respond disqus discussion reviews feedback".split(),
    "share sharing social follow login search form author byline meta hidden".split())
GROUP_OF = {token: i for i, group in enumerate(TOKEN_GROUPS) for token in group}
NOT_LETTERS = re.compile(r"[^a-z]+")
WHITE = re.compile(r"\s+")
MARKS = re.compile(r"[.,;:!?]")
LANDMARKS = range(5, 11)


class Block:
    __slots__ = ("parent", "tag", "tokens", "depth", "chars", "own", "linked", "tags", "controls", "blocks", "marks", "below", "hidden", "longest")

    def __init__(self, parent: int, tag: str, attrs: list[tuple[str, str | None]], depth: int):
        self.parent, self.tag, self.depth = parent, tag, depth
        self.chars = self.own = self.linked = self.tags = self.controls = self.blocks = self.marks = self.longest = 0
        self.below: list[int] = []
        self.tokens: list[int] = []
        self.hidden = False
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label", "itemprop", "data-role"):
                for token in NOT_LETTERS.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", value or "").lower()):
                    if token in GROUP_OF:
                        self.tokens.append(GROUP_OF[token])
            elif name == "hidden" or name == "style" and "display:none" in (value or "").replace(" ", ""):
                self.hidden = True


class Page(HTMLParser):
    """Blocks in page order, and runs of text as (block, text) where block borders cut them."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.blocks = [Block(-1, "html", [], 0)]
        self.open = [0]
        self.silent: list[str] = []
        self.links = 0
        self.runs: list[tuple[int, str]] = []
        self.pending: list[str] = []
        self.feed(html)
        self.close()
        self._flush()
        self._sum()

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not needed."""
        return j

    def _flush(self) -> None:
        text = WHITE.sub(" ", "".join(self.pending)).strip()
        self.pending.clear()
        if text:
            at = self.open[-1]
            self.runs.append((at, text))
            self.blocks[at].own += len(text)
            self.blocks[at].marks += len(MARKS.findall(text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        top = self.blocks[self.open[-1]]
        # </head> may be left out: whatever cannot be in a head ends it.
        if self.silent[:1] == ["head"] and (tag in ("body", "html") or len(self.silent) == 1 and tag not in IN_HEAD):
            self.silent.clear()
        if self.silent:
            if tag in SILENT and tag not in VOID:
                self.silent.append(tag)
            return
        if tag == "body" or tag == "html":
            return
        if tag in CONTROLS:
            top.controls += 1
        if tag in SILENT:
            self.silent.append(tag)
            return
        top.tags += 1
        if tag == "br":
            self.pending.append(" ")
        if tag == "a":
            self.links += 1
        if tag not in BLOCKS:
            if tag == "hr":
                self._flush()
            return
        self._flush()
        self.links = 0
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.blocks[self.open[depth]].tag
            if name in CLOSED_BY and tag in CLOSED_BY[name]:
                del self.open[depth:]
                break
            if name in KEEPS.get(tag, ()) or name not in CLOSED_BY:
                break
        self.blocks[self.open[-1]].below.append(len(self.blocks))
        self.open.append(len(self.blocks))
        self.blocks.append(Block(self.open[-2], tag, attrs, len(self.open) - 1))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag):]
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in BLOCKS or tag in ("html", "body"):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.blocks[self.open[depth]].tag == tag:
                self._flush()
                self.links = 0
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        if self.silent == ["head"] and data.strip():
            self.silent.clear()
        if self.silent:
            return
        self.pending.append(data)
        if self.links:
            self.blocks[self.open[-1]].linked += len(data)

    def _sum(self) -> None:
        for block in self.blocks:
            block.chars += block.own
        for at in range(len(self.blocks) - 1, 0, -1):
            block, parent = self.blocks[at], self.blocks[self.blocks[at].parent]
            parent.chars += block.chars
            parent.longest = max(parent.longest, block.chars)
            parent.linked += block.linked
            parent.tags += block.tags
            parent.controls += block.controls
            parent.marks += block.marks
            parent.blocks += block.blocks + 1


def features(page: Page) -> np.ndarray:
    """One row per block."""
    blocks, total, out = page.blocks, max(1, page.blocks[0].chars), []
    above: list[set[int]] = []
    for at, b in enumerate(blocks):
        parent = blocks[b.parent] if at else b
        near = above[b.parent] if at else set()
        own_tags = {k for k, group in enumerate(TAG_GROUPS) if b.tag in group}
        marks = {("tag", k) for k in own_tags if k in LANDMARKS} | {("token", k) for k in b.tokens}
        above.append(near | marks)
        kin = parent.below or [at]
        place = 0 if not at else (at - kin[0]) / max(1, kin[-1] - kin[0])
        longest = parent.longest if at else b.chars
        row = [b.depth, math.log1p(b.chars), math.log1p(b.own), b.linked / (b.chars + 1), math.log1p(b.blocks), math.log1p(b.chars / (b.tags + 1)),
               b.marks / (b.chars + 1), b.chars / total, math.log1p(len(kin)), place, math.log1p(parent.chars / len(kin)), b.chars / (longest + 1),
               parent.linked / (parent.chars + 1), math.log1p(b.controls), b.own / (b.chars + 1), float(b.hidden)]
        row += [float(k in own_tags) for k in range(len(TAG_GROUPS))]
        row += [float(k in b.tokens) for k in range(len(TOKEN_GROUPS))]
        row += [float(("tag", k) in near) for k in LANDMARKS]
        row += [float(("token", k) in near) for k in range(len(TOKEN_GROUPS))]
        out.append(row)
    return np.array(out, np.float32)


@dataclass
class Trees:
    """Complete trees of one depth: split features and limits level by level, and leaf scores."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss over binned features, one level of every tree at a time."""
    n, width = x.shape
    if not n:  # nothing is known: all text counts as content
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), 1.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    base = math.log(rate / (1 - rate))
    score, grown = np.full(n, base), ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        slope, bend = y - p, p * (1 - p)
        feature, limit, node = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-6)
            for j in range(width):
                if not len(edges[j]):
                    continue
                key = (node - first) * BINS + binned[:, j]
                sums = [np.bincount(key, w, many * BINS).reshape(many, BINS).cumsum(axis=1) for w in (slope, bend, None)]
                left, right = [s[:, :len(edges[j])] for s in sums], [s[:, -1:] - s[:, :len(edges[j])] for s in sums]
                gain = left[0]**2 / (left[1] + 1) + right[0]**2 / (right[1] + 1) - (sums[0]**2 / (sums[1] + 1))[:, -1:]
                gain[(left[2] < LEAF_ROWS) | (right[2] < LEAF_ROWS)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(many), at]
                better = np.flatnonzero(top > best)
                best[better], feature[first + better], limit[first + better] = top[better], j, edges[j][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        leaves = node - (2**DEPTH - 1)
        value = RATE * np.bincount(leaves, slope, 2**DEPTH) / (np.bincount(leaves, bend, 2**DEPTH) + 1)
        score += value[leaves]
        for kept, part in zip(grown, (feature, limit, value)):
            kept.append(part)
    return Trees(*map(np.array, grown), base)


MIXED, CONTENT, BOILERPLATE = range(3)


def decode(page: Page, score: np.ndarray) -> list[bool]:
    """Which blocks are content, by the best consistent assignment: mixed over anything, content over content or boilerplate, boilerplate over itself."""
    worth = np.clip(score, -6, 6)
    totals = [[0.0, 0.0, 0.0] for _ in page.blocks]
    for at in range(len(page.blocks) - 1, -1, -1):
        block, mine = page.blocks[at], totals[at]
        mine[CONTENT] += worth[at]
        mine[BOILERPLATE] -= worth[at]
        if block.own:
            mine[MIXED] -= 12 + abs(worth[at])
        if at:
            up = totals[block.parent]
            up[MIXED] += max(mine)
            up[CONTENT] += max(mine[CONTENT], mine[BOILERPLATE])
            up[BOILERPLATE] += mine[BOILERPLATE]
    states: list[int] = []
    for at, block in enumerate(page.blocks):
        if not at:
            allowed = (MIXED, CONTENT, BOILERPLATE)
        else:
            allowed = {MIXED: (MIXED, CONTENT, BOILERPLATE), CONTENT: (CONTENT, BOILERPLATE), BOILERPLATE: (BOILERPLATE,)}[states[block.parent]]
        states.append(max(allowed, key=totals[at].__getitem__))
    return [s == CONTENT for s in states]


def text_of(page: Page, content: list[bool]) -> str:
    return "\n".join(text for at, text in page.runs if content[at])


def semantic_sides(page: Page) -> list[bool | None]:
    """Side of every block by semantic elements and plain attribute words; None where they say nothing."""
    sides: list[bool | None] = []
    for at, b in enumerate(page.blocks):
        up = sides[b.parent] if at else None
        if up is False or b.tag in ("nav", "footer", "aside", "form", "dialog", "search") or b.tag == "header" and not up or any(k in (1, 3, 4, 5, 6, 7) for k in b.tokens):
            sides.append(False)
        elif up or b.tag in ("article", "main"):
            sides.append(True)
        else:
            sides.append(None)
    return sides


def layout(rng: random.Random, content: list[str], other: list[str]) -> str:
    """A page of the given texts in which ``data-side`` tells every block's side."""
    def say(k: int) -> str:
        return escape(" ".join(rng.choice(other).split()[:k]) or "more")

    def attr(names: str) -> str:
        name = rng.choice(names.split())
        return rng.choice(("", f' class="{name}"', f' class="{name} box"', f' id="{name}"', f' class="c-{name}__inner"'))

    def must(names: str) -> str:
        name = rng.choice(names.split())
        return rng.choice((f' class="{name}"', f' id="{name}"', f' class="wide {name}"'))

    def plain(tag: str, extra: str, inside: str) -> str:
        return f'<{tag}{extra} data-side="0">{inside}</{tag}>'

    def items(n: int, tag: str = "li") -> str:
        return "".join(plain(tag, "", f'<a href="/{i}">{say(rng.randint(1, 6))}</a>') for i in range(n))

    menu = rng.choice((lambda: plain("nav", attr("menu main-nav"), plain("ul", "", items(rng.randint(3, 9)))),
                       lambda: plain("div", must("menu navbar navigation breadcrumbs"), plain("ul", "", items(rng.randint(3, 9)))),
                       lambda: plain("ul", must("menu nav pagination"), items(rng.randint(3, 9)))))
    extras = [
        lambda: plain("header", attr("header masthead"), plain(rng.choice(("div", "h1", "p")), attr("logo branding"), say(4)) + menu()),
        lambda: plain("div", must("header masthead topbar"), plain("p", "", say(6))),
        lambda: plain(rng.choice(("aside", "div")), must("sidebar widget related popular"), plain("h3", "", say(3)) + plain("ul", "", items(rng.randint(2, 6)))),
        lambda: plain("aside", attr("sidebar"), plain("p", "", say(rng.randint(5, 30))) + plain("p", "", say(12))),
        lambda: plain("div", must("ad ads advert sponsored promo banner"), rng.choice((say(rng.randint(3, 25)), plain("p", "", say(rng.randint(3, 25)))))),
        lambda: plain("div", must("cookie-notice consent gdpr notice newsletter popup alert"), plain("p", "", say(rng.randint(5, 25))) + "<button>OK</button>"),
        lambda: plain("form", attr("newsletter search login"), plain("p", "", say(rng.randint(2, 12))) + '<label>Mail</label><input name="q"><button>Go</button>'),
        lambda: plain("div", must("share social follow"), items(3, "div")),
    ]
    comments = lambda: plain(rng.choice(("section", "div", "ul", "ol")), must("comments comment-list discussion replies disqus"), "".join(
        plain(rng.choice(("div", "article", "p")), attr("comment reply"), rng.choice((say(rng.randint(4, 40)), plain("p", "", say(rng.randint(4, 60)))))) for _ in range(rng.randint(1, 5))))
    foot = lambda: plain(rng.choice(("footer", "div")), must("footer copyright legal"), rng.choice((say(8), plain("p", "", say(12))))) if rng.random() < 0.5 else plain("footer", "", say(8))
    side = ' data-side="1"'
    body = [f"<h1{side}>{escape(content[0])}</h1>"]
    for text in content[1:]:
        kind = rng.random()
        if kind < 0.75:
            body.append(f"<p{side}>{escape(text)}</p>")
        elif kind < 0.8:
            body.append(f"<h2{side}>{escape(text[:60])}</h2>")
        elif kind < 0.85:
            body.append(f"<ul{side}>" + "".join(f"<li{side}>{escape(t)}</li>" for t in text.split(". ")[:5]) + "</ul>")
        elif kind < 0.9:
            body.append(f"<blockquote{side}>{escape(text)}</blockquote>")
        else:
            body.append(f"<div{side}>{escape(text)}</div>")
    inner = extras[2:] + [comments]
    for _ in range(rng.choice((0, 0, 1, 2))):
        body.insert(rng.randint(1, len(body)), rng.choice(inner)())
    tag, extra = rng.choice((("article", ""), ("article", attr("post entry")), ("main", ""), ("div", must("content article-body post entry story")), ("div", ""), ("section", must("main-content text"))))
    main = f"<{tag}{extra}{side}>{''.join(body)}</{tag}>"
    if rng.random() < 0.3:
        main = f'<div{attr("content wrap page")} data-side="?">{main}</div>'
    before = [rng.choice(extras)() for _ in range(rng.randint(0, 3))] + ([menu()] if rng.random() < 0.8 else [])
    after = [rng.choice(extras)() for _ in range(rng.randint(0, 2))] + ([comments()] if rng.random() < 0.4 else []) + ([foot()] if rng.random() < 0.8 else [])
    rng.shuffle(before)
    page = "".join([*before, main, *after])
    return f'<html><body>{page if rng.random() < 0.6 else f"""<div{attr("page wrapper")} data-side="?">{page}</div>"""}</body></html>'


class Marked(Page):
    """A page that also notes the known side of its blocks."""

    def __init__(self, html: str):
        self.sides: dict[int, str] = {}
        super().__init__(html)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        before = len(self.blocks)
        super().handle_starttag(tag, attrs)
        if len(self.blocks) > before:
            self.sides[before] = dict(attrs).get("data-side") or "?"


def learn(pages: list[str], seed: int = SEED) -> Trees:
    rng = random.Random(seed)
    xs, ys = [], []
    for html in pages:
        page = Page(html)
        sides = semantic_sides(page)
        # Texts only fill the made layouts, so a page without landmarks fills them with what is not known to be boilerplate.
        content = [t for at, t in page.runs if sides[at]] or [t for at, t in page.runs if sides[at] is None] or [t for _, t in page.runs]
        other = [t for at, t in page.runs if sides[at] is False] or content
        known = [at for at, s in enumerate(sides) if s is not None]
        xs.append(features(page)[known])
        ys.append(np.array([float(bool(sides[at])) for at in known]))
        if not content or not other:
            continue
        for _ in range(3):
            start = rng.randrange(len(content))
            drawn = [content[0], *content[start:start + rng.randint(1, 12)]]
            made = Marked(layout(rng, drawn, other if rng.random() < 0.5 else other + content))
            known = [at for at, s in made.sides.items() if s != "?"]
            xs.append(features(made)[known])
            ys.append(np.array([float(made.sides[at] == "1") for at in known]))
    x = np.concatenate(xs) if xs else np.zeros((0, features(Page("")).shape[1]), np.float32)
    y = np.concatenate(ys) if ys else np.zeros(0)
    return boost(x, y) if 0 < y.sum() < len(y) else boost(x[:0], y[:0])  # one side alone teaches nothing


def fit(pages: DataFrame, html: str = "html", train_pages: int = TRAIN_PAGES) -> Trees:
    """Learns from the ``train_pages`` pages of the lowest hashes; copies count once, however many there are."""
    rows = pages.select(F.col(html).cast("string").alias("_html")).where("_html is not null").withColumn("h", F.xxhash64("_html"))
    lowest = [r.h for r in rows.select("h").distinct().orderBy("h").limit(train_pages).collect()]
    if not lowest:
        return learn([])
    drawn = rows.where(F.col("h") <= lowest[-1]).groupBy("h").agg(F.min("_html").alias("_html"))
    return learn([r._html for r in drawn.orderBy("h").collect()])


def extract_text(pages: DataFrame, trees: Trees, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and ``text`` of every row: content blocks in page order, one per line, white space inside a block as one space.

    Null and empty pages, and pages without content, have an empty text.  Repeated rows and null ids keep a row each; an empty
    table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(html).cast("string").alias("_html"), *keep)
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            texts: list[str] = []
            held: list[tuple[Page, np.ndarray]] = []

            def score() -> None:
                if held:
                    scores = trees.score(np.concatenate([x for _, x in held]))
                    at = 0
                    for page, x in held:
                        texts.append(text_of(page, decode(page, scores[at:at + len(x)])))
                        at += len(x)
                held.clear()

            size = 0
            for value in batch.column(0).to_pylist():
                page = Page(value or "")
                held.append((page, features(page)))
                size += len(page.blocks)
                if size > 20_000:
                    score()
                    size = 0
            score()
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*keep, "text"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[1:])
    return map_rows(rows, read, f"{kept}text string")
