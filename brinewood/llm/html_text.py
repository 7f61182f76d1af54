"""HTML extraction by minimum cut: a page's blocks are labelled content or boilerplate.

A page is read into blocks of text. The graph of a page has a node per block and one per element that says something about what
stands in it (``article``, ``nav``, a class, a role, ...). Their terminal capacities are the costs of two classifiers:

* a block's cost is a logistic model's log-odds over what its text looks like (length, share of links, how it ends, commas,
  capitals). The model is fitted to weak labels, a bounded sample of the table's blocks (``TRAIN_PAGES``,
  ``TRAIN_BLOCKS``): content where elements clearly say so (an article), boilerplate where they clearly say the
  opposite (a menu, a footer). The elements themselves aren't among its features, so it says something about other blocks too.
  A normal prior (``PRIOR``) keeps a model of few or one-sided labels sane;
* an element's cost adds up the fixed evidence of its name, role and class and of those around it. Words of a class are one
  kind of evidence among these.

Smoothness edges join a block to its nearest such element and such elements to each other (proximity in the tree), blocks
that follow each other, the more the more of their enclosing elements are shared, and the next blocks under the same
parent and of the same signature of names and classes. The maximum flow separates the page where that costs least, and
what stays on the source's side is the main text: a paragraph of one word stays with its article, a sentence in an
advert goes with its box, and where no element says anything neighbours decide together.

Cases: a null or empty page, and one without content, gives the empty text; broken markup is read as browsers
roughly do (unclosed elements end with their parents; scripts and styles end at their end tags only); repeated
rows are read each; very long pages are read whole; costs that tie go to boilerplate; an empty table gives an
empty result, and without labels the prior decides; only page_id, url and html are read, so extra columns,
whatever their names, don't matter.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Never text: what browsers don't show, or show as controls.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button datalist head title".split())
#: Elements that an opening tag of the key closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **{k: {"p"} for k in "p div article aside section nav header footer form ul ol table h1 h2 h3 h4 h5 h6 blockquote pre main figure dl fieldset address details".split()},
}
#: Where such closing stops.
SCOPE = {"li": {"ul", "ol", "menu"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}}

#: What may stand in a head; any other element ends one that is open.
IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript template".split())
#: Words of a class that tell a state or name the head of an article, not what the element is.
STATE = re.compile(r"(?<!\S)(?:(?:has|with|without|no)[-_]\S+|\S+[-_](?:open|closed|enabled|disabled)|(?:article|entry|post|story)[-_]+header)(?!\S)")

# Evidence of elements, in log-odds: above zero for content.
TAG_WEIGHT = {
    "article": 4.0, "main": 3.0, "blockquote": 1.0, "pre": 1.0, "table": 0.5, "figure": 0.3,
    "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "header": -6.0, "dialog": -9.0, "label": -4.0, "fieldset": -6.0, "address": -1.0,
}
NEGATIVE = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|footer\w*|header|masthead|topbar|sidebar\w*|side|aside|widget\w*|"
    r"related|recommend\w*|comments?|commentlist|disqus|respond|replies|reply|cookies?|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscribe\w*|signup|login|"
    r"share|sharing|social\w*|toolbar|pagination|pager|copyright|legal|disclaimer|search\w*|form|skip|hidden|tags|byline|meta|toc)(?:$|[^a-z])"
)
POSITIVE = re.compile(r"(?:^|[^a-z])(?:article\w*|content|main\w*|post|story|body|entry|text|page)(?:$|[^a-z])")
NEGATIVE_WEIGHT, POSITIVE_WEIGHT = -9.0, 1.5
HIDDEN_WEIGHT = -12.0
ROLE_WEIGHT = {"navigation": -9.0, "banner": -7.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "dialog": -9.0, "alert": -9.0, "main": 3.0, "article": 3.0, "form": -9.0, "menu": -9.0}
#: What a block's own element adds to its cost; not fitted, as it goes with the labels.
OWN_TAG = {"p": 1.0, "h1": 1.5, "h2": 1.0, "h3": 1.0, "h4": 0.5, "h5": 0.5, "h6": 0.5, "blockquote": 1.0, "pre": 1.0, "td": 0.3, "figcaption": 0.3}
#: Features of a block's text, the mean of their weights before any page is seen, and how sure that is.
FEATURES = ("one", "length", "short", "links", "stop", "commas", "capitals", "longest")
PRIOR = np.array([-0.6, 1.2, -0.4, -3.0, 0.4, 0.3, -0.5, 0.5])
PRIOR_PRECISION = 2.0
#: The bounded sample that the model is fitted on: pages, and blocks of these, by smallest hashes.
TRAIN_PAGES, TRAIN_BLOCKS = 400, 20_000
#: Evidence of elements from which on a block is an example.
CLEAR = 2.5
#: Largest costs of blocks and of elements; an element that is sure outweighs a text that looks otherwise.
MOST_BLOCK, MOST_ELEMENT = 2.5, 8.0
#: Smoothness: block and element, element and element, neighbours (times the share of common elements), same parent, same signature.
TO_ELEMENT, AMONG_ELEMENTS, NEXT, SAME_PARENT, SAME_SIGNATURE = 6.0, 0.5, 0.8, 0.6, 0.3


#: What stands above the outermost element.
TOP = ("", 0, 0.0, False, False, 0.0, 0, 0)


class Block:
    """A run of text: the elements it stands in, their evidence, the nearest one that has any, its parent and signature."""

    __slots__ = ("text", "links", "path", "score", "element", "tag", "signature")

    def __init__(self, path: tuple[int, ...], score: float, element: int, tag: str, signature: int):
        self.text: list[str] = []
        self.links, self.path, self.score, self.element, self.tag, self.signature = 0, path, score, element, tag, signature


class _Reader(HTMLParser):
    """Blocks of a page in order. ``stack``: (name, number, evidence so far, inside a link, skipped, penalty of classes in that evidence,
    nearest element with evidence, signature) of open elements. ``elements``: evidence and parent of those that have some."""

    def __init__(self, only_article: bool = False) -> None:
        self.only_article = only_article
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, float, bool, bool, float, int, int]] = []
        self.elements: dict[int, tuple[float, int]] = {}
        self.blocks: list[Block] = []
        self.open: Block | None = None
        self.count = 0

    def _pop_to(self, k: int) -> None:
        if any(x[0] in BREAKS for x in self.stack[k:]):
            self.open = None
        del self.stack[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        names = [x[0] for x in self.stack]
        if "head" in names and (tag == "body" or names[-1] == "head" and tag not in IN_HEAD):
            self._pop_to(names.index("head"))  # its end tag is optional
        closes, stop = CLOSES.get(tag, ()), SCOPE.get(tag, ())
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in closes:
                self._pop_to(k)
                if tag not in ("tr", "td", "th"):
                    break
            elif name in stop or (tag not in SCOPE and name in BREAKS):
                break
        if tag in BREAKS:
            self.open = None
        if tag in VOID:
            return
        above = self.stack[-1] if self.stack else TOP
        self.count += 1
        a = {k: (v or "").lower() for k, v in attrs}
        weight = TAG_WEIGHT.get(tag, 0.0) + ROLE_WEIGHT.get(a.get("role", ""), 0.0)
        if tag == "header" and any(x[0] in ("article", "main") for x in self.stack):
            weight = 0.0  # the head of the article itself: its title
        penalty = above[5]
        if tag == "main" or tag == "article" and self.only_article:
            weight, penalty = weight - penalty, 0.0  # the classes of a wrapper don't outweigh what it is there for
        if tag not in ("html", "body", "article", "main"):
            mark = STATE.sub("", f"{a.get('class', '')} {a.get('id', '')}").strip()
            if mark and NEGATIVE.search(mark):
                weight += NEGATIVE_WEIGHT
                penalty += NEGATIVE_WEIGHT
            elif mark and POSITIVE.search(mark):
                weight += POSITIVE_WEIGHT
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
            weight += HIDDEN_WEIGHT
        element = above[6]
        if weight:
            element = self.count
            self.elements[element] = (above[2] + weight, above[6])
        signature = hash((above[7], tag, a.get("class", ""))) if tag in BREAKS else above[7]
        self.stack.append((tag, self.count, above[2] + weight, above[3] or tag == "a", above[4] or tag in SKIPPED, penalty, element, signature))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash at the end closes void elements only

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop_to(k)
                return
        if tag in BREAKS:
            self.open = None

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._pop_to(len(self.stack) - 1)
        _, _, weight, link, skipped, _, element, signature = self.stack[-1] if self.stack else TOP
        if skipped:
            return
        # A block ends where another begins, and at inline elements whose evidence is quite another one.
        if (self.open is None or abs(weight - self.open.score) > 4) and data.strip():
            tag = next((x[0] for x in reversed(self.stack) if x[0] in BREAKS), "")
            self.open = Block(tuple(x[1] for x in self.stack if x[0] in BREAKS), weight, element, tag, signature)
            self.blocks.append(self.open)
        if self.open is None or abs(weight - self.open.score) > 4:
            return
        self.open.text.append(data)
        if link:
            self.open.links += len(data)


class Page:
    """What the graph of a page is made from: texts and blocks that have some, and the elements with evidence."""

    def __init__(self, html: str):
        reader = _Reader(len(re.findall(r"<article[\s>]", html, re.IGNORECASE)) == 1)
        reader.feed(html)
        reader.close()
        both = [(b, text) for b in reader.blocks if (text := " ".join("".join(b.text).split()))]
        self.blocks, self.texts, self.elements = [b for b, _ in both], [t for _, t in both], reader.elements

    def features(self) -> np.ndarray:
        """A row per block, in the order of ``FEATURES``."""
        longest = max(map(len, self.texts), default=1)
        rows = []
        for b, text in zip(self.blocks, self.texts, strict=True):
            n = len(text)
            words = text.count(" ") + 1
            rows.append((
                1.0, min(3.0, math.log2(1 + n / 40)), float(n < 25), min(1.0, b.links / n), float(text[-1] in ".!?:;…。"), min(1.0, 5 * text.count(",") / words),
                sum(map(str.isupper, text)) / n, n / longest,
            ))
        return np.array(rows, np.float64).reshape(-1, len(FEATURES))

    def costs(self, model: np.ndarray) -> np.ndarray:
        """Log-odds that each block is content, by its text and its own element."""
        own = np.array([OWN_TAG.get(b.tag, 0.0) for b in self.blocks])
        return np.clip(self.features() @ model + own, -MOST_BLOCK, MOST_BLOCK)

    def graph(self, model: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
        """Cost per node (blocks, then elements) and the smoothness edges."""
        n = len(self.blocks)
        number = {e: n + i for i, e in enumerate(self.elements)}
        costs = [*self.costs(model).tolist(), *(max(-MOST_ELEMENT, min(MOST_ELEMENT, x)) for x, _ in self.elements.values())]
        edges = [(number[e], number[up], AMONG_ELEMENTS) for e, (_, up) in self.elements.items() if up]
        parents: dict[int, int] = {}
        alike: dict[int, int] = {}
        for i, b in enumerate(self.blocks):
            if b.element:
                edges.append((i, number[b.element], TO_ELEMENT))
            if i:
                x, y = self.blocks[i - 1].path, b.path
                same = next((k for k, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
                edges.append((i - 1, i, NEXT * same / max(1, len(x), len(y))))
            for seen, key, weight in ((parents, b.path[-2] if len(b.path) > 1 else 0, SAME_PARENT), (alike, b.signature, SAME_SIGNATURE)):
                if key in seen:
                    edges.append((seen[key], i, weight))
                seen[key] = i
        return costs, edges

    def labels(self) -> np.ndarray:
        """1 where elements clearly say content, 0 where they clearly say boilerplate, else -1."""
        said = np.array([b.score for b in self.blocks])
        return np.where(said >= CLEAR, 1, np.where(said <= -CLEAR, 0, -1)).astype(np.int64)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of most posterior probability: logistic loss, classes weighing alike, normal prior around ``PRIOR``; Newton's method."""
    w = PRIOR.copy()
    if not len(y) or y.min() == y.max():
        return w
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(rounds):
        z = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (z - y)) + PRIOR_PRECISION * (w - PRIOR)
        curve = (x * (each * z * (1 - z))[:, None]).T @ x + PRIOR_PRECISION * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(pages: DataFrame) -> np.ndarray:
    """The block classifier of a table of pages."""
    hashed = pages.select(F.xxhash64("page_id", "url").alias("hash"), F.coalesce("html", F.lit("")).alias("html"))
    last = hashed.select("hash").orderBy("hash").limit(TRAIN_PAGES).agg(F.max("hash")).first()[0]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, html in zip(b.column("hash").to_pylist(), b.column("html"), strict=True):
                page = Page(html.as_py())
                y = page.labels()
                own = np.flatnonzero(y >= 0)
                flat = page.features()[own].ravel()
                x = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, len(FEATURES)), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(own.size, h)), pa.array(own), pa.array(y[own]), x], ["hash", "at", "y", "x"])

    rows = hashed.where(F.col("hash") <= F.lit(last)).mapInArrow(of, "hash long, at long, y long, x array<double>")
    got = rows.orderBy(F.xxhash64("hash", "at"), "hash", "at", "x").limit(TRAIN_BLOCKS).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got.column("y").to_numpy())


class Flow:
    """Maximum flow by shortest augmenting levels (Dinic), on adjacency arrays."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, forth: float, back: float = 0.0) -> None:
        for x, y, room in ((a, b, forth), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(room)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def cut(self, s: int, t: int) -> list[bool]:
        """After the maximum flow from s to t: which nodes s still reaches."""
        while (level := self.levels(s))[t] >= 0:
            at = [0] * len(self.out)
            while True:  # depth first along levels, without recursion
                path: list[int] = []
                x = s
                while x != t:
                    while at[x] < len(self.out[x]):
                        e = self.out[x][at[x]]
                        if self.room[e] > 1e-9 and level[self.to[e]] == level[x] + 1:
                            break
                        at[x] += 1
                    if at[x] < len(self.out[x]):
                        path.append(self.out[x][at[x]])
                        x = self.to[path[-1]]
                    elif path:
                        x = self.to[path.pop() ^ 1]
                        at[x] += 1
                    else:
                        break
                if x != t:
                    break
                least = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= least
                    self.room[e ^ 1] += least
        return [x >= 0 for x in self.levels(s)]


def kept_blocks(page: Page, model: np.ndarray) -> list[bool]:
    """Which blocks the minimum cut leaves on the content's side."""
    costs, edges = page.graph(model)
    n = len(costs)
    flow = Flow(n + 2)
    for i, c in enumerate(costs):
        if c > 0:
            flow.edge(n, i, c)
        else:
            flow.edge(i, n + 1, -c)
    for i, j, w in edges:
        flow.edge(i, j, w, w)
    return flow.cut(n, n + 1)[: len(page.blocks)]


def main_text(html: str, model: np.ndarray = PRIOR) -> str:
    """The main text of a page."""
    page = Page(html)
    return " ".join(t for t, k in zip(page.texts, kept_blocks(page, model), strict=True) if k) if page.blocks else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = train(pages)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h.as_py(), model) for h in b.column("html")]
            cols = [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    kind = dict(rows.dtypes)
    return rows.mapInArrow(of, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
