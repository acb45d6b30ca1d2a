"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded along the tree."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import Scratch, joined, slices, text_of

#: Elements by their role, and attribute words that speak for or against main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp".split())
NEVER = RAW | set("head svg canvas object audio video select button".split())
HEAD = set("base basefont bgsound link meta noscript script style template title".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "summary", "figcaption"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
BARRIERS = ("ul", "ol", "dl", "table", "div", "article", "section")
#: Elements that a paragraph opened outside them isn't closed from within.
SCOPES = ("td", "th", "caption", "table", "object", "button")
MAIN, BOILER = {"article", "main"}, {"nav", "aside", "footer", "header", "form", "menu", "dialog", "search"}
PRO = set("article content main post entry body story text page".split())
CONTRA = set(
    "nav navbar navigation menu ad ads advert advertisement sponsor sponsored banner promo footer header masthead sidebar side aside comment comments reply replies disqus cookie cookies consent gdpr notice popup modal overlay share sharing social related recommended subscribe newsletter signup login search form breadcrumb breadcrumbs pagination pager widget toolbar copyright legal disclaimer".split()
)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^"'>]|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>""", re.DOTALL)
_NAMED = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

FEATURES = (
    "log_text", "density", "link_share", "page_share", "depth", "siblings", "place", "parent_share", "stops", "paragraphs", "pro", "contra", "pro_above", "contra_above", "is_main", "is_boiler", "is_prose", "is_list", "in_main", "in_boiler", "words",
    "before", "twins", "children", "headed", "is_head",
)
#: In the same order: what tags say, and what attributes say.
_SEMANTIC, _TOKENS = [FEATURES.index(x) for x in ("is_main", "is_boiler", "in_main", "in_boiler")], [FEATURES.index(x) for x in ("pro", "contra", "pro_above", "contra_above")]
#: Marks of the guises that pages are trained in; no feature reads them.
_INNER, _OUTER = "zzinner", "zzouter"
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Bounds of the fit: pages drawn for training.
TRAIN_PAGES = 240
ROOT, LOOSE = "#root", "#text"


@dataclass
class Page:
    """Nodes in page order: a root, the block elements, and one for each run of text that stands in none, with the index of
    the node it stands in (the root's: -1); text runs as (node, block number, raw text, in a link)."""

    tags: list[str]
    parents: list[int]
    words: list[list[str]]
    runs: list[tuple[int, int, str, bool]]


class _Builder:
    """The open elements.  For each tag the places where it is open are kept, so no step walks the whole stack."""

    def __init__(self):
        self.page, self.block = Page([ROOT], [-1], [[]], []), 0
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, its node or the one above, left out, in a link
        self.open: dict[str, list[int]] = {}
        self.loose = -1

    def top(self) -> tuple[int, bool, bool]:
        return self.stack[-1][1:] if self.stack else (0, False, False)

    def last(self, tags: Iterable[str]) -> int:
        """The innermost place where one of the tags is open, else -1."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def node(self, tag: str, parent: int, words: list[str]) -> int:
        self.page.tags.append(tag)
        self.page.parents.append(parent)
        self.page.words.append(words)
        return len(self.page.tags) - 1

    def pop(self, to: int, counts: bool = True) -> None:
        """Closes all elements from that place on."""
        while len(self.stack) > to:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            if counts and tag in BLOCK:
                self.next_block()

    def next_block(self) -> None:
        self.block += 1
        self.loose = -1

    def text(self, piece: str) -> None:
        node, out, link = self.top()
        if out and self.stack[-1][0] == "head" and piece.strip():  # text ends the head
            self.pop(len(self.stack) - 1)
            node, out, link = self.top()
        if not piece or out:
            return
        if self.page.tags[node] in (ROOT, "html", "body"):
            if self.loose < 0 and piece.strip():
                self.loose = self.node(LOOSE, node, [])
            node = self.loose if self.loose >= 0 else node
        self.page.runs.append((node, self.block, piece, link))

    def start(self, tag: str, attrs: str | None) -> None:
        if tag not in HEAD and tag != "head" and (at := self.last(("head",))) >= 0:
            self.pop(at)
        if tag in CLOSES_P and (at := self.last(("p",))) > self.last(SCOPES):
            self.pop(at)
        ends = ENDS.get(tag)
        if ends and (at := self.last(ends)) > self.last(BARRIERS):
            self.pop(at, counts=False)
        if tag in BLOCK:
            self.next_block()
        if tag in VOID:
            return
        node, out, link = self.top()
        if tag in BLOCK and not out:
            named = " ".join(a or b or c for a, b, c in _NAMED.findall(attrs)) if attrs else ""
            node = self.node(tag, node, [x.lower() for x in _PART.findall(named)])
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, node, out or tag in NEVER, link or tag == "a"))

    def end(self, tag: str) -> None:
        if (at := self.last((tag,))) >= 0:
            self.pop(at)


def parse(html: str) -> Page:
    """Elements nest as HTML's implied ends have it; what never holds main text is left out.  One pass."""
    page, at, n = _Builder(), 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            page.text(html[at:])
            break
        page.text(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if tag == "br":
            page.text(" ")
        elif m["end"] or m["end2"]:
            page.end(tag)
        elif tag:
            page.start(tag, m["attrs"])
            if tag in RAW:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else n
                page.end(tag)
    return page.page


_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in RAW}


def node_features(page: Page) -> np.ndarray:
    n = len(page.tags)
    own, linked, stops, spaces = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    begin, seen = np.full(n, -1.0), 0
    for node, _, raw, link in page.runs:
        own[node] += len(raw)
        linked[node] += len(raw) * link
        stops[node] += raw.count(".") + raw.count(",")
        spaces[node] += raw.count(" ")
        if begin[node] < 0:
            begin[node] = seen
        seen += len(raw)
    paragraphs = np.array([t in ("p", LOOSE) for t in page.tags], float)
    heads = np.array([t in ("h1", "h2") for t in page.tags], float)
    text, links, dots, inner, ps, gaps, headed = own.copy(), linked.copy(), stops.copy(), np.ones(n), paragraphs.copy(), spaces.copy(), heads.copy()
    parent, children = page.parents, np.zeros(n)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        children[p] += 1
        for a in (text, links, dots, inner, ps, gaps, headed):
            a[p] += a[i]
        if begin[i] >= 0 and (begin[p] < 0 or begin[i] < begin[p]):
            begin[p] = begin[i]
    depth, place, count = [0] * n, [0] * n, {}
    above, own_flags = np.zeros((n, 4)), np.zeros((n, 4))
    shapes: dict[tuple, int] = {}
    shape = []
    for i, (tag, p, words) in enumerate(zip(page.tags, parent, page.words, strict=True)):
        depth[i] = depth[p] + 1 if p >= 0 else 0
        place[i] = count.get(p, 0)
        count[p] = place[i] + 1
        within = p >= 0 and (own_flags[p][2] + above[p][2]) > 0
        own_flags[i] = (sum(x in PRO for x in words), sum(x in CONTRA for x in words), tag in MAIN, tag in BOILER and not (tag == "header" and within))
        if p >= 0:
            above[i] = above[p] + own_flags[p]
        shape.append((p, tag, int(children[i])))
        shapes[shape[i]] = shapes.get(shape[i], 0) + 1
    total = max(1.0, float(own.sum()))
    siblings = np.array([count[p] for p in parent], float)
    prose, lists = HEADS | {"p", LOOSE, "blockquote", "pre"}, {"ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th"}
    share = np.array([text[i] / max(1.0, text[p]) if p >= 0 else 1.0 for i, p in enumerate(parent)])
    twins = np.array([shapes[x] if x[2] else 0 for x in shape], float)
    return np.column_stack([
        np.log1p(text), text / inner, links / np.maximum(1, text), text / total, np.array(depth, float), siblings, np.array(place) / np.maximum(1, siblings), share, dots / np.maximum(1, text) * 100, ps,
        own_flags[:, 0], own_flags[:, 1], above[:, 0], above[:, 1], own_flags[:, 2], own_flags[:, 3], np.array([t in prose for t in page.tags], float), np.array([t in lists for t in page.tags], float), above[:, 2] > 0, above[:, 3] > 0, gaps,
        np.maximum(begin, 0) / total, twins, children, headed, np.array([t in HEADS for t in page.tags], float),
    ])


def weak_labels(page: Page, x: np.ndarray) -> np.ndarray | None:
    """1 for nodes in an article or main element and none of the known surroundings, and for the nodes above; None without."""
    tags = x[:, [FEATURES.index(c) for c in ("is_main", "in_main", "is_boiler", "in_boiler", "contra", "contra_above")]]
    inside, outside = tags[:, 0] + tags[:, 1] > 0, tags[:, 2:].sum(axis=1) > 0
    for i, (words, p) in enumerate(zip(page.words, page.parents, strict=True)):
        inside[i] |= _INNER in words or p >= 0 and inside[p]
        outside[i] |= _OUTER in words or p >= 0 and outside[p] and _INNER not in words
    inside &= ~outside
    if not inside.any():
        return None
    label = inside.astype(float)
    for i in range(len(page.tags) - 1, -1, -1):
        if label[i] and page.parents[i] >= 0:
            label[page.parents[i]] = 1.0
    return label


_ARTICLE = re.compile(r"<(article|main)\b[^>]*>(.*)</\1\s*>", re.DOTALL | re.IGNORECASE)
_SEMANTIC_TAG = re.compile(r"<(/?)(?:nav|footer|header|aside|section)\b[^>]*>", re.IGNORECASE)
_SENTENCE = re.compile(r"[^.<>&]{4,}\.")


def _guises(html: str) -> list[tuple[str, bool]]:
    """The page without tags that mean anything, and whether all of it is main text: as it is; with readers' comments, a side
    column and a form beside or within what holds the article, under some more levels; all in one form; the article's inside
    alone; and some of its sentences as bare text.  Words of the added parts are the page's own; comments are short and alike."""
    m = _ARTICLE.search(html)
    if not m:
        return []
    plain = lambda t: "</div>" if t[1] else f"<div class={_OUTER}>"
    before, after = (_SEMANTIC_TAG.sub(plain, x) for x in (html[: m.start()], html[m.end() :]))
    said = [x.strip() for x in _SENTENCE.findall(m[2])[:40]] or ["So it is."]
    seed = zlib.crc32(html.encode())
    pick = lambda k: said[(7 * k + seed) % len(said)]
    few = lambda k, n: " ".join(pick(k).split()[:n])

    def comments(n: int, way: int) -> str:
        name, item, whole = (("<h4>{}</h4>", "div", "div"), ("<div>{}</div>", "li", "ol"), ("<b>{}</b>", "div", "section"), ("<p>{}</p>", "li", "ul"), ("<b>{}</b>", "div", "div"))[way % 5]
        each = "".join(f"<{item}>{name.format(few(k, 2))}<p>{pick(k + 3)}</p></{item}>" for k in range(n))
        return f"<{whole} class={_OUTER}><h3>{few(1, 2)}</h3>{each}</{whole}>"

    def under(levels: int, x: str) -> str:
        return "<div>" * levels + x + "</div>" * levels

    links = "".join(f"<li><a href=x>{few(k, 3)}</a></li>" for k in range(2 + seed % 5))
    side = f"<div class={_OUTER}><h3>{few(2, 2)}</h3><ul>{links}</ul></div>"
    notice = f"<div class={_OUTER}><p>{few(6, 12)} <a href=x>{few(7, 1)}</a></p></div>"
    form = f"<form class={_OUTER}><p>{few(4, 6)}</p><label>{few(5, 1)}</label><input><button>Go</button></form>"
    inner = f"<div class={_INNER}>{m[2]}</div>"
    head, _, rest = before.partition("<body>")
    part = lambda bit, x: x if seed >> bit & 1 else ""
    one = before + part(1, side) + under(seed % 3, inner + part(2, form) + comments(1 + seed % 7, seed)) + part(3, side) + after
    two = head + "<body>" + under(1 + seed % 2, rest + under(1 + seed // 8 % 3, inner + comments(1 + seed // 64 % 4, seed + 1)) + side) + part(4, notice) + after
    three = f"{head}<body><form action=x>{under(seed // 4 % 2, rest + part(5, side) + inner + part(6, comments(2, seed + 2)))}{after}"
    four = f"<body>{part(7, notice)}<div class={_OUTER}><ul>{links}</ul></div>{under(seed % 2, inner)}{part(2, side)}<div class={_OUTER}>&copy; {few(8, 5)}</div></body>"
    five = f"<body><form action=x>{part(8, side)}<div class={_OUTER}><ul>{links}</ul></div>{under(seed % 2, inner)}<div class={_OUTER}>&copy; {few(8, 5)}</div></form></body>"
    bare = (m[2], f"{pick(1)} {pick(2)}", f"{few(3, 4)}", f"<span>{few(4, 2 + seed % 9)}</span><p>{pick(5)}", f"{pick(6)}<p>{few(7, 1 + seed % 5)}</p>{pick(8)}", f"<div><p>{pick(9)}</p></div>")
    return [(before + inner + after, False), *((x, False) for x in (one, two, three, four, five)), *((x, True) for x in bare)]


@dataclass
class Trees:
    """Arrays of a boosted ensemble: for each node its feature (-1: leaf), threshold, children and value."""

    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    value: list[np.ndarray]

    @staticmethod
    def of(model) -> Trees:
        out = Trees([], [], [], [], [])
        for tree, weight in zip(model.trees, model.treeWeights, strict=True):
            lines = [x.strip() for x in tree.toDebugString.splitlines() if x.strip().startswith(("If", "Else", "Predict"))]
            rows: list[list] = []
            at = 0

            def read() -> int:
                nonlocal at
                line, me = lines[at], len(rows)
                at += 1
                if line.startswith("Predict"):
                    rows.append([-1, 0.0, 0, 0, float(line.split(":")[1]) * weight])  # noqa: B023
                    return me
                m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
                rows.append([int(m[1]), float(m[2]), 0, 0, 0.0])
                rows[me][2] = read()
                at += 1  # the Else line
                rows[me][3] = read()
                return me

            read()
            for name, column in zip(("feature", "threshold", "left", "right", "value"), zip(*rows, strict=True), strict=True):
                getattr(out, name).append(np.array(column))
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, t, a, b, v in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            at = np.zeros(len(x), int)
            while (f[at] >= 0).any():
                inner = f[at] >= 0
                goes = x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at]
                at = np.where(inner, np.where(goes, a[at], b[at]), at)
            total += v[at]
        return 2 * total


def prior_log_odds(x: np.ndarray) -> np.ndarray:
    """Without a trained model: what the tags and attribute words say."""
    c = {name: x[:, i] for i, name in enumerate(FEATURES)}
    return np.where(c["contra"] + c["contra_above"] + c["is_boiler"] + c["in_boiler"] > 0, -2.0, np.where(c["is_main"] + c["in_main"] + c["pro"] + c["is_prose"] > 0, 2.0, 0.5 - 2.0 * c["link_share"]))


def decode(parents: list[int], score: np.ndarray) -> np.ndarray:
    """The best consistent choice: a kept node stands in kept nodes only, and the kept nodes' log odds sum to the most."""
    n = len(parents)
    gain = score.astype(float).copy()
    for i in range(n - 1, -1, -1):
        if parents[i] >= 0:
            gain[parents[i]] += max(0.0, gain[i])
    keep = np.zeros(n, bool)
    for i in range(n):
        keep[i] = gain[i] > 0 and (parents[i] < 0 or keep[parents[i]])
    return keep


_BLANKS = re.compile(r"\s+")


def main_text(page: Page, keep: np.ndarray) -> str:
    blocks: dict[int, list[str]] = {}
    for node, block, raw, _ in page.runs:
        if keep[node]:
            blocks.setdefault(block, []).append(raw)
    clean = (_BLANKS.sub(" ", unescape("".join(parts))).strip() for _, parts in sorted(blocks.items()))
    return "\n\n".join(x for x in clean if x)


def fit(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES, trees: int = 24, depth: int = 5, seed: int = 3) -> Trees | None:
    """Trees learned from about train_pages pages, drawn evenly from those that mark their article themselves.

    The marks are the labels.  So that the trees learn density, attributes, depth and siblings too, each drawn page comes in
    several guises: as it is, without the tags' meaning, without the attributes' words, without either, with attribute words
    in place of the tags, and in the guises of _guises, where nothing but the nodes' shapes tells.

    Defined results: None where no page marks its article, or nothing but it; null and empty pages aren't drawn; repeated
    rows may each be drawn; other columns aren't read.
    """

    def rows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            xs, ys = [], []
            for html in frame["html"]:
                page = parse(html)
                x = node_features(page)
                y = weak_labels(page, x)
                if y is not None:
                    for masked in ([], _SEMANTIC, _TOKENS, _SEMANTIC + _TOKENS):
                        z = x.copy()
                        z[:, masked] = 0
                        xs.append(z)
                        ys.append(y)
                    z = x.copy()
                    z[:, _TOKENS] = np.maximum(z[:, _TOKENS], z[:, _SEMANTIC])
                    z[:, _SEMANTIC] = 0
                    xs.append(z)
                    ys.append(y)
                    for guise, whole in _guises(html):
                        other = parse(guise)
                        z = node_features(other)
                        y = np.ones(len(z)) if whole else weak_labels(other, z)
                        if y is not None:
                            z[:, _SEMANTIC + _TOKENS] = 0
                            xs.append(z)
                            ys.append(y)
            yield pd.DataFrame({"x": list(np.concatenate(xs)) if xs else [], "label": np.concatenate(ys) if ys else np.zeros(0)})

    marked = pages.select(text_of(html_col).alias("html")).where(F.col("html").rlike(r"(?i)<(?:article|main)[\s>]"))
    drawn = marked.sample(min(1.0, train_pages / max(1, marked.count())), seed)
    work = Scratch(pages.sparkSession, "html")
    known = work.table(drawn.mapInPandas(rows, "x array<double>, label double"), "nodes")
    if known.select("label").distinct().count() < 2:
        work.drop()
        return None
    known = known.select(array_to_vector("x").alias("features"), "label").coalesce(4).cache()
    try:
        return Trees.of(GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, minInstancesPerNode=4, seed=seed).fit(known))
    finally:
        known.unpersist()
        work.drop()


def extract(pages: DataFrame, html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """pages with `main_text`: the article's blocks in page order, joined by two newlines.

    Method: every block element is scored by the boosted trees on subtree density, link share, attribute words, depth,
    siblings and place; the scores are decoded along the tree, so that no kept node stands in a dropped one.  Scripts, styles
    and controls are never read.  Each page is parsed whole, in its own row.  Without trees the tags and attribute words
    score by themselves.

    Defined results: a null or empty page, and one with no main text, give the empty text; an empty table gives no rows;
    repeated rows get the same answer each; other columns stay, one named main_text is replaced.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield joined((pd.Series(texts(part["text"]), dtype=object) for part in slices(batch.to_frame("text"))), pd.Series([], dtype=object))

    def texts(htmls: Iterable[str]) -> list[str]:
        parsed = [parse(h) for h in htmls]
        x = [node_features(p) for p in parsed]
        flat = np.concatenate(x)
        score = trees.log_odds(flat) if trees else prior_log_odds(flat)
        ends = np.cumsum([len(a) for a in x]).tolist()
        return [main_text(p, decode(p.parents, score[e - len(a) : e])) for p, a, e in zip(parsed, x, ends, strict=True)]

    return pages.withColumn("main_text", F.pandas_udf(run, "string")(text_of(html_col)))
