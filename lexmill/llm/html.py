"""HTML extraction by minimum-cut labelling of text blocks.

A page is cut into blocks of text with their place in the element tree. A logistic classifier gives each block a
probability of being content; its two log costs are the block's capacities from the source and to the sink. Blocks
next to each other and blocks of one parent are joined by smoothness edges, and the minimum cut (by maximum flow) is
the labelling with the least total cost.

The classifier is fitted on about ``FIT_PAGES`` of the pages, chosen by hash, whose blocks label themselves: those in an
article or main element and in nothing that names itself otherwise are content, those in navigation, footers, forms and
the like aren't. Each is also shown without these marks, so that words, links and sentence ends get weights of their own. Where few
blocks label themselves, the weights stay near ``PRIOR``.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title select button textarea iframe svg math object canvas audio video".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "template")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|disqus|footer|form|header|login|menu|modal|nav\w*|newsletter|notices?|pagination|popup|promo\w*"
    r"|related|repl(?:y|ies)|search|share|sharing|side-?bar|signup|skip|social|sponsor\w*|subscribe|tags?|toolbar|widget)(?:$|[\s_-]|\d)",
    re.I,
)
#: On an element of running text only a whole name tells noise: a "share-price" is none.
WHOLE = re.compile(NOISE.pattern.replace(r"[\s_-]", r"\s"), re.I)
#: The head of an article is no page header.
HEAD = re.compile(r"\b(?:article|content|entry|main|post|story)[_-]+header\b", re.I)
MAIN = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|body|text)(?:$|[\s_-]|\d)", re.I)
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
NOISY = frozenset("nav header footer aside form menu dialog fieldset".split())
#: Features of a block, the log odds that they are given before anything is seen, and how firmly.
FEATURES = "bias main article noise words links stop heading".split()
PRIOR, FIRM = np.array([-1.0, 2.0, 3.5, -9.0, 0.5, -4.0, 0.6, 1.0]), 20.0
FIT_PAGES = 2000
NEXT, SIBLING = 0.5, 0.4


class Block:
    __slots__ = ("tag", "parent", "parts", "linked", "main", "article", "noise")

    def __init__(self, tag, parent, main, article, noise):
        self.tag, self.parent, self.parts, self.linked, self.main, self.article, self.noise = tag, parent, [], 0, main, article, noise


def blocks(page: str) -> list[tuple[Block, str]]:
    """The blocks of a page that have text, with the text."""
    stack: list[tuple] = [("", 0, False, False, False, False, False)]  # tag, id, main, article, noise, hidden, link
    open_tags: dict[str, int] = {}
    owners = [0]  # places of block elements in the stack, below them the page's
    out, block, made, at = [], None, 0, 0

    def close(to: int) -> None:
        while len(stack) > to:
            open_tags[stack.pop()[0]] -= 1
        while owners[-1] >= to:
            owners.pop()

    while at < len(page):
        m = TOKEN.match(page, at)
        at, tag = m.end(), m[2]
        if tag is None:
            top = stack[-1]
            text = m[0]
            if text.startswith("<") and text != "<" or top[5]:
                continue
            if block is None:
                owner = stack[owners[-1]]
                block = Block(owner[0], owner[1], top[2], top[3], top[4])
                out.append(block)
            block.parts.append(text)
            if top[6]:
                block.linked += len(text)
            continue
        tag = tag.lower()
        if m[1]:
            if open_tags.get(tag):
                to = len(stack) - 1
                while stack[to][0] != tag:
                    to -= 1
                close(to)
        else:
            owner = stack[owners[-1]][0]
            if owner and (owner in CLOSES[tag].split() if tag in CLOSES else tag in BLOCK and owner == "p"):
                close(owners[-1])
            if tag == "br" and block is not None:
                block.parts.append(" ")
            if tag not in VOID and not m[3].rstrip().endswith("/"):
                _, _, main, article, noise, hidden, link = stack[-1]
                names = " ".join(a or b or c for a, b, c in NAMED.findall(m[3])) if "=" in m[3] else ""
                made += 1
                article = article or tag == "article"
                told = names and (WHOLE.search(names) if tag in TEXT else NOISE.search(HEAD.sub(" ", names)))
                noise = noise or tag in NOISY or bool(told) and tag not in ("html", "body", "article", "main")
                main = main or tag == "main" or bool(names and MAIN.search(names))
                if tag in BLOCK:
                    owners.append(len(stack))
                stack.append((tag, made, main, article, noise, hidden or tag in HIDDEN, link or tag == "a"))
                open_tags[tag] = open_tags.get(tag, 0) + 1
                if tag in RAW:  # script and the like hold no tags and end only at their own end tag
                    end = RAW_END[tag].search(page, at)
                    at = end.start() if end else len(page)
        if tag in BLOCK or tag in HIDDEN:
            block = None
    found = []
    for b in out:
        text = "".join(b.parts)
        if text := " ".join((html.unescape(text) if "&" in text else text).split()):
            found.append((b, text))
    return found


def features(block: Block, text: str) -> list[float]:
    """FEATURES, in steps coarse enough to be counted."""
    words = text.count(" ") + 1
    return [
        1.0,
        float(block.main),
        float(block.article),
        float(block.noise),
        round(4 * min(math.log2(words), 6)) / 4,
        round(8 * min(1.0, block.linked / len(text))) / 8,
        float(text[-1] in ".!?…\"”»"),
        float(block.tag[:1] == "h" and block.tag[1:].isdigit()),
    ]


def log_odds(block: Block, text: str, weights: np.ndarray = PRIOR) -> float:
    return float(np.dot(weights, features(block, text)))


def fit(rows: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a logistic model by Newton's method, n rows of each kind, held near PRIOR as by FIRM rows."""
    w = PRIOR.copy()
    n = n * (min(1.0, 20_000 / max(1.0, float(n.sum()))))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (n * (label - p)) - (w - PRIOR) * FIRM
        step = np.linalg.solve((rows * (n * p * (1 - p))[:, None]).T @ rows + np.eye(len(w)) * FIRM, slope)
        w = w + step * min(1.0, 2 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w


def learnt(pages: DataFrame, limit: int = FIT_PAGES) -> np.ndarray:
    """Weights fitted on the blocks that label themselves of about limit pages; their counts by features are few rows."""

    def run(batches):
        for batch in batches:
            for page in (p for at in range(0, batch.num_rows, 64) for p in batch.column("html").slice(at, 64).to_pylist()):
                rows = []
                for block, text in blocks(page or ""):
                    if block.noise or block.main or block.article:
                        own, label = features(block, text), float(not block.noise)
                        rows += [[*own, label], [1.0, 0.0, 0.0, 0.0, *own[4:], label]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [*FEATURES, "label"])

    every = max(1, pages.count() // limit)
    some = pages.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(every)) == 0).select("html")
    seen = some.mapInArrow(run, ", ".join(f"{c} double" for c in [*FEATURES, "label"])).groupBy(*FEATURES, "label").agg(F.count("*").alias("n")).orderBy(*FEATURES, "label").toPandas()
    return fit(seen[FEATURES].to_numpy(), seen["label"].to_numpy(), seen["n"].to_numpy(np.float64)) if len(seen) else PRIOR


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay on the source's side; node i costs softplus(odds) off it and softplus(-odds) on it."""
    # what a node can send straight on is sent; the rest is its excess (over 0) or demand (under 0): just the log odds
    n, left = len(odds), list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), cap in edges.items():
        near[a][b] = near[a].get(b, 0.0) + cap
        near[b][a] = near[b].get(a, 0.0) + cap
    tiny = 1e-9
    while True:
        # distances to a demand over edges with room, then flow along them: Dinic's phases
        level = [-1] * n
        todo = deque(i for i in range(n) if left[i] < -tiny)
        for i in todo:
            level[i] = 0
        while todo:
            j = todo.popleft()
            for i in near[j]:
                if level[i] < 0 and near[i][j] > tiny:
                    level[i] = level[j] + 1
                    todo.append(i)
        sources = [i for i in range(n) if left[i] > tiny and level[i] > 0]
        if not sources:
            break
        ways, arc = [list(x) for x in near], [0] * n
        for s in sources:
            path = [s]
            while path and left[s] > tiny:
                i = path[-1]
                if left[i] < -tiny:
                    room = min(left[s], -left[i], *(near[a][b] for a, b in zip(path, path[1:])))
                    for a, b in zip(path, path[1:]):
                        near[a][b] -= room
                        near[b][a] += room
                    left[s] -= room
                    left[i] += room
                    path = [s]
                    continue
                while arc[i] < len(ways[i]):
                    j = ways[i][arc[i]]
                    if level[j] == level[i] - 1 and near[i][j] > tiny:
                        path.append(j)
                        break
                    arc[i] += 1
                else:
                    level[i] = -2
                    path.pop()
    # the source's side: what excess can still reach
    on = [x > tiny for x in left]
    todo = deque(i for i in range(n) if on[i])
    while todo:
        i = todo.popleft()
        for j, room in near[i].items():
            if room > tiny and not on[j]:
                on[j] = True
                todo.append(j)
    return on


def extract(page: str, weights: np.ndarray = PRIOR) -> str:
    found = blocks(page)
    if not found:
        return ""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, (block, _) in enumerate(found):
        if i:
            edges[i - 1, i] = NEXT
        if block.parent in last:
            edges[last[block.parent], i] = edges.get((last[block.parent], i), 0.0) + SIBLING
        last[block.parent] = i
    on = minimum_cut([log_odds(*b, weights) for b in found], edges)
    return "\n\n".join(text for (_, text), keep in zip(found, on, strict=True) if keep)


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null or empty html, and pages without content, give an empty text; cut-off pages are read as far as they go;
    repeated rows are read alike. Extra columns are ignored; an empty table gives no rows.
    """
    pages = pages.select("page_id", "url", "html")
    weights = learnt(pages)

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(at, 64) for at in range(0, whole.num_rows, 64)):
                text = [extract(h or "", weights) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
