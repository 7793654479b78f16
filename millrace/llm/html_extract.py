"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree; each is content or not. Unary potentials read the
element (its tag, class, id and role words, the length, links and punctuation of its own text);
pairwise potentials tie a child to its parent, by the kind of the child. On a tree, sum-product
message passing upward and downward gives exact marginals, which decide the blocks and also give
the gradient that trains the weights to maximum likelihood on labelled pages.

Text runs between block boundaries are blocks; character references are decoded, white space is
one space, and kept blocks are joined in page order. Pages are judged one by one, whole.

Defined cases: a null or empty page, or one without content, has an empty text; malformed markup
is read as far as it goes (unclosed elements end with their parent); rows that repeat are judged
each; only ``page_id``, ``url`` and ``html`` are read; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace import runtime

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|[^<]+|<", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is not text of the page.
_RAW = frozenset("script style template noscript title textarea iframe noembed noframes xmp svg math object audio video canvas select datalist".split())
#: Elements that start and end a block.
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tr td th thead tbody", "tfoot": "tr td th thead tbody"}
_SCOPE = frozenset("table ul ol menu dl body html article section div main td th".split())
_KIND = {**dict.fromkeys("nav header footer aside form button label menu dialog search".split(), 1), **dict.fromkeys("article main".split(), 2), **dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt figure".split(), 3), **dict.fromkeys("ul ol li dl option".split(), 4), **dict.fromkeys("table tr td th tbody thead tfoot caption".split(), 5), "": 6}
_KINDS = 7


class Node:
    __slots__ = ("tag", "names", "parent", "runs", "chars", "linked", "stops")

    def __init__(self, tag: str, names: list[str], parent: int):
        self.tag, self.names, self.parent = tag, names, parent
        self.runs: list[int] = []
        self.chars = self.linked = self.stops = 0


def parse(page: str) -> tuple[list[Node], list[str]]:
    """The block tree (parents come first) and the text runs in page order.

    A block with text beside child blocks gets one anonymous child a run, so that every run is
    judged by a node of its own.
    """
    nodes = [Node("html", [], -1)]
    stack = [0]
    runs: list[str] = []
    buffer: list[str] = []
    links = linked = 0
    at, size = 0, len(page)
    match = _TOKEN.match

    def flush() -> None:
        nonlocal linked
        text = " ".join(_html.unescape("".join(buffer)).split()) if buffer else ""
        buffer.clear()
        if text:
            top = nodes[stack[-1]]
            if top.runs or top.tag in ("html", "body", "div", "section", "article", "main", "td", "aside", "header", "footer", "nav", "form"):
                nodes.append(Node("", [], stack[-1]))
                top = nodes[-1]
            top.runs.append(len(runs))
            top.chars, top.linked = len(text), min(linked, len(text))
            top.stops = text.count(". ") + text.count(", ") + text.count("! ") + text.count("? ") + text.endswith((".", "!", "?"))
            runs.append(text)
        linked = 0

    while at < size:
        m = match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            s = m[0]
            if s[0] != "<" or len(s) == 1:
                buffer.append(s)
                if links:
                    linked += len(s)
            continue
        tag = tag.lower()
        closing = (m[1] or m[4]) == "/"
        if tag in _RAW:
            if not closing and not m[0].endswith("/>"):
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = page.find(">", end.start()) + 1 or size if end else size
            buffer.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            buffer.append(" ")
        if tag not in _BLOCK:
            continue
        flush()
        links = 0
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ("html", "body") and len(stack) == 1 and tag == "html":
            continue
        if nodes[stack[-1]].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and tag not in ("button", "label", "option"):
            stack.pop()
        elif tag in _CLOSES:
            ends = _CLOSES[tag].split()
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]].tag
                if t in ends:
                    del stack[k:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif t in _SCOPE:
                    break
        names = []
        rest = m[3] or m[6]
        if rest and "=" in rest:
            for key, value in _ATTR.findall(rest):
                names += [("r:" if key.lower() == "role" else "c:") + w.lower() for w in _PART.findall(value)]
        nodes.append(Node(tag, names, stack[-1]))
        if tag not in _VOID:
            stack.append(len(nodes) - 1)
    flush()
    return nodes, runs


def features(n: Node) -> list[str]:
    out = ["bias", "t:" + n.tag, *(n.names or ["bare:" + n.tag])]
    if n.chars:
        out.append("len" + str(min(4, n.chars.bit_length() // 2)))
        share = n.linked / n.chars
        out.append("link" + ("0" if share == 0 else "1" if share < 0.4 else "2"))
        out.append("stop" + str(min(3, n.stops)))
    return out


class Model:
    """Weights of the unary features, and log potentials [kind][parent][child]."""

    def __init__(self) -> None:
        self.unary: dict[str, float] = {}
        self.pair = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(_KINDS)]

    def marginals(self, nodes: list[Node], pairs: list | None = None) -> list[float]:
        """P(content) of every node; ``pairs`` also gets each node's joint with its parent."""
        w = self.unary
        own = [sum([w.get(f, 0.0) for f in features(n)]) for n in nodes]
        psi = [[[math.exp(v) for v in row] for row in k] for k in self.pair]
        up = own[:]  # log odds of the subtree under each node
        said = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            n = nodes[i]
            p = psi[_KIND.get(n.tag, 0)]
            e = math.exp(max(-30.0, min(30.0, up[i])))
            said[i] = math.log((p[1][1] * e + p[1][0]) / (p[0][1] * e + p[0][0]))
            up[n.parent] += said[i]
        belief = up[:]
        for i in range(1, len(nodes)):
            n = nodes[i]
            p = psi[_KIND.get(n.tag, 0)]
            rest = math.exp(max(-30.0, min(30.0, belief[n.parent] - said[i])))
            belief[i] += math.log((p[1][1] * rest + p[0][1]) / (p[1][0] * rest + p[0][0]))
            if pairs is not None:
                e = math.exp(max(-30.0, min(30.0, up[i])))
                j = [p[0][0], p[0][1] * e, p[1][0] * rest, p[1][1] * rest * e]
                z = sum(j)
                pairs.append((i, [x / z for x in j]))
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, b)))) for b in belief]


def train(labelled: list[tuple[str, list[bool]]], *, rounds: int = 40, rate: float = 0.8, decay: float = 0.0005) -> Model:
    """Maximum likelihood on (HTML, label of each text run); an element is content if most of its runs are.

    An element without text takes the label that most of the characters below it have.
    """
    model = Model()
    pages = []
    for source, labels in labelled:
        nodes, runs = parse(source)
        if len(runs) != len(labels):
            raise ValueError("a labelled page has one label for each text run")
        good, all_ = [0] * len(nodes), [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            for r in nodes[i].runs:
                good[i] += len(runs[r]) * labels[r]
                all_[i] += len(runs[r])
            if i:
                good[nodes[i].parent] += good[i]
                all_[nodes[i].parent] += all_[i]
        pages.append((nodes, [2 * g > a for g, a in zip(good, all_, strict=True)], [features(n) for n in nodes]))
    total = sum(len(n) for n, _, _ in pages) or 1
    square: dict = {}
    for _ in range(rounds):
        grad: dict = {}
        for nodes, y, feats in pages:
            pairs: list = []
            p = model.marginals(nodes, pairs)
            for i, names in enumerate(feats):
                g = y[i] - p[i]
                for f in names:
                    grad[f] = grad.get(f, 0.0) + g
            for i, joint in pairs:
                kind = _KIND.get(nodes[i].tag, 0)
                seen = 2 * y[nodes[i].parent] + y[i]
                for s in range(4):
                    grad[kind, s] = grad.get((kind, s), 0.0) + (s == seen) - joint[s]
        for f, g in grad.items():
            pair = isinstance(f, tuple)
            now = model.pair[f[0]][f[1] >> 1][f[1] & 1] if pair else model.unary.get(f, 0.0)
            g = g / total * 100 - decay * now
            square[f] = square.get(f, 1e-8) + g * g
            now += rate * g / math.sqrt(square[f])
            if pair:
                model.pair[f[0]][f[1] >> 1][f[1] & 1] = now
            else:
                model.unary[f] = now
    return model


def built_in(pages: int = 240) -> Model:
    """The model trained on ``pages`` composed pages (a bounded, documented sample; see html_pages)."""
    from millrace.llm import html_pages

    labelled = []
    for seed in range(pages):
        source, labels = html_pages.page(seed)
        _, runs = parse(source)
        plain = [(" ".join(_html.unescape(re.sub(r"<[^>]*>", "", t)).split()), c) for t, c in labels]
        if [t for t, _ in plain] == runs:
            labelled.append((source, [c for _, c in plain]))
    return train(labelled)


def main_text(model: Model, page: str | None) -> str:
    if not page:
        return ""
    nodes, runs = parse(page)
    if not runs:
        return ""
    keep = set()
    for n, p in zip(nodes, model.marginals(nodes), strict=True):
        if p > 0.5:
            keep.update(n.runs)
    return " ".join(t for i, t in enumerate(runs) if i in keep)


def _extract(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            text = [main_text(model, x.as_py()) for x in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Every page's page_id, url, main text and its length in code points."""
    spark = pages.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast(model or built_in())
    rows = runtime.pick(pages, page_id="long", url="string", html="string")
    return rows.mapInArrow(lambda it: _extract(it, shared.value), "page_id long, url string, text string, n_chars long")
