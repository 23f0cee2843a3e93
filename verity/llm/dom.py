"""Block tree of an HTML page and the features of its nodes.

Inline markup is text; block elements are nodes, and each run of inline text
in a block is a leaf below it. Scripts, styles and other unrendered elements
leave no trace; one that is never closed ends with the block around it. White
space in a run becomes one space.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from html.parser import HTMLParser

import numpy as np

# HTML element names by how they are laid out.
UNRENDERED = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "canvas", "audio", "video",
              "annotation", "annotation-xml"}
#: Unrendered elements whose slash ends them at once (SVG and MathML); all elements inside svg are such.
FOREIGN = {"svg", "annotation", "annotation-xml"}
#: Unrendered elements whose content is not markup: only their own end tag ends them.
RAW = {"script", "style", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "legend",
         "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody",
         "textarea", "tfoot", "thead", "tr", "ul"}
#: An opening tag closes an open element of the set, up to the nearest boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"optgroup", "option"}, {"select"}),
          "body": ({"head"}, set())}

RUN = "#run"
#: Attribute by which generated training pages carry their labels.
LABEL = "x-label"

_TOKEN = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")


class Stack:
    """Names of open elements; the place of the innermost one of a name is kept, not searched for."""

    def __init__(self):
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}

    def __len__(self):
        return len(self.names)

    def push(self, name: str):
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def last(self, *names: str) -> int:
        """Place of the innermost element of one of the names, -1 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def cut(self, place: int):
        """Close the element at the place and all inside it."""
        while len(self.names) > place:
            self.places[self.names.pop()].pop()


class Tree(HTMLParser):
    """Nodes as parallel lists; children come after their parents."""

    def __init__(self, html: str, generated: bool = False):
        super().__init__(convert_charrefs=True)
        self.generated = generated  # a training layout, not a page
        self.tag, self.parent, self.tokens, self.text, self.links, self.label = ["#root"], [-1], [()], [""], [0], [None]
        self.open = [0]  # indexes of open block nodes
        self.names = Stack()  # their names
        self.names.push("#root")
        self.skip = Stack()  # open unrendered elements, and the blocks inside them
        self.anchors = 0
        self.words: list[str] = []
        self.linked = 0
        self.feed(html)
        self.close()
        self._flush()

    def _add(self, tag, tokens, text="", links=0, label=None):
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.tokens.append(tokens)
        self.text.append(text)
        self.links.append(links)
        self.label.append(label)
        return len(self.tag) - 1

    def _flush(self):
        text = " ".join("".join(self.words).split())
        if text:
            self._add(RUN, (), text, min(self.linked, len(text)))
        self.words, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag in UNRENDERED and tag != "head" and tag not in VOID:
                self.skip.push(tag)
            elif self.skip.names == ["head"] and (tag in BLOCK or tag == "body"):  # an unclosed head
                self.skip.cut(0)
            else:
                if tag in BLOCK and self.skip.last(*RAW) < 0:
                    self.skip.push(tag)
                return
            if self.skip:
                return
        if tag in UNRENDERED:
            self.skip.push(tag)
            return
        if tag in ("td", "th", "br", "hr", "img", "input", "wbr"):
            self.words.append(" " if tag != "wbr" else "")
        if tag == "a":
            self.anchors += 1
        if tag not in BLOCK:
            return
        self._flush()
        if tag not in ("option", "button"):
            self._pop({"p"}, {"button", "td", "table"})
        if tag in CLOSES:
            self._pop(*CLOSES[tag])
        found, label = [], None
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label", "itemprop", "data-component") and value:
                found.extend(t.lower() for t in _TOKEN.findall(value))
            elif name == "hidden" or (name == "style" and value and re.search(r"display\s*:\s*none", value)):
                found.append("hidden")
            elif name == LABEL:
                label = value
        self.open.append(self._add(tag, tuple(dict.fromkeys(found)), label=label))
        self.names.push(tag)

    def handle_startendtag(self, tag, attrs):
        if tag not in FOREIGN and self.skip.last("svg") < 0:  # HTML ignores the slash
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skip:
            if (place := self.skip.last(tag)) >= 0:
                self.skip.cut(place)
                return
            if tag not in BLOCK or self.names.last(tag) < 0 or self.skip.last(*RAW) >= 0:
                return
            self.skip.cut(0)  # never closed inside the block that ends here
        if tag == "a":
            self.anchors = max(0, self.anchors - 1)
        elif tag in ("td", "th"):
            self.words.append(" ")
        elif tag in BLOCK and self.names.last(tag) >= 0:
            self._flush()
            self._pop({tag}, set())

    def _pop(self, names, boundary):
        place = self.names.last(*names)
        if place > self.names.last(*boundary):
            self.names.cut(place)
            del self.open[place:]
            self.anchors = 0

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)
            if self.anchors:
                self.linked += len(data.strip())

    def labels(self) -> np.ndarray:
        """1 for runs below a label 1 and for every node above such a run."""
        n = len(self.tag)
        near = [self.label[0]] * n
        out = np.zeros(n, np.int8)
        for i in range(1, n):
            near[i] = self.label[i] if self.label[i] is not None else near[self.parent[i]]
            out[i] = self.tag[i] == RUN and near[i] == "1"
        for i in range(n - 1, 0, -1):
            out[self.parent[i]] |= out[i]
        return out


@functools.cache
def _classes() -> np.ndarray:
    """Per code point: 1 a space, 2 punctuation, 4 a digit, 8 a capital, 16 a symbol, added up."""
    points = [chr(i) for i in range(0x110000)]
    out = 4 * np.fromiter(map(str.isdigit, points), np.uint8) + 8 * np.fromiter(map(str.isupper, points), np.uint8)
    out += 16 * np.fromiter((unicodedata.category(c)[0] == "S" for c in points), np.uint8)
    out[[ord(c) for c in ".,;:!?"]] += 2
    out[ord(" ")] += 1
    return out


def character_counts(texts: list[str]) -> np.ndarray:
    """Spaces, punctuation marks, digits, capitals and symbols (rows) of every whole text (columns)."""
    lengths = np.array([len(t) for t in texts])
    out = np.zeros((5, len(texts)))
    some = np.flatnonzero(lengths)
    if len(some):
        classes = _classes()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
        for bit in range(5):
            out[bit, some] = np.add.reduceat(classes >> bit & 1, starts, dtype=np.int64)
    return out


def features(tree: Tree, score: dict[str, float]) -> np.ndarray:
    """One row per node; ``score`` has the learned log odds of tags (``<tag``) and attribute tokens."""
    n = len(tree.tag)
    parent = np.array(tree.parent)
    run = np.array([t == RUN for t in tree.tag])
    own_tag = np.array([score.get("<" + t, 0.0) for t in tree.tag])
    each = [[score.get(t, 0.0) for t in ts] for ts in tree.tokens]
    own_sum = np.array([max(-8.0, min(8.0, sum(s))) for s in each])
    own_min, own_max = np.array([min(s, default=0.0) for s in each]), np.array([max(s, default=0.0) for s in each])
    chars = np.array([len(t) for t in tree.text], float)
    links = np.array(tree.links, float)
    spaces, marks, digit, upper, symbols = character_counts(tree.text)
    words = spaces + run
    linky = ((links > 0.5 * chars) & run).astype(float)
    long = ((chars > 120) & (links < 0.3 * chars)).astype(float)
    counts = {name: np.array([t == name for t in tree.tag], float) for name in ("p", "li")}
    inputs = np.array([t in ("form", "button", "select", "option", "textarea", "fieldset", "legend") for t in tree.tag], float)
    blocks, runs = (~run).astype(float), run.astype(float)
    low, high = np.minimum(own_tag, own_min).tolist(), np.maximum(own_tag, own_max).tolist()
    below_low, below_high = low.copy(), high.copy()
    depth, up_low, up_high = [0] * n, [0.0] * n, [0.0] * n
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        p = tree.parent[i]
        depth[i] = depth[p] + 1
        up_low[i], up_high[i] = min(up_low[p], low[p]), max(up_high[p], high[p])
        kids[p].append(i)
    sums = np.column_stack([chars, links, marks, words, digit, upper, symbols, linky, long, counts["p"], counts["li"], inputs, blocks, runs])
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        sums[p] += sums[i]
        below_low[p], below_high[p] = min(below_low[p], below_low[i]), max(below_high[p], below_high[i])
    chars, links, marks, words, digit, upper, symbols, linky, long, counts["p"], counts["li"], inputs, blocks, runs = sums.T
    size = np.log1p(chars)
    density = links / np.maximum(chars, 1)
    sizes, densities = size.tolist(), density.tolist()
    siblings, alike, prev_size, prev_link, next_size, next_link, around = ([0.0] * n for _ in range(7))
    for ks in kids:
        m = len(ks)
        if not m:
            continue
        mean = sum(sizes[k] for k in ks) / m
        many = math.log1p(m)
        tags: dict[str, int] = {}
        for k in ks:
            tags[tree.tag[k]] = tags.get(tree.tag[k], 0) + 1
        for at, k in enumerate(ks):
            siblings[k], alike[k], around[k] = many, tags[tree.tag[k]] / m, mean
            if at:
                prev_size[k], prev_link[k] = sizes[ks[at - 1]], densities[ks[at - 1]]
            if at + 1 < m:
                next_size[k], next_link[k] = sizes[ks[at + 1]], densities[ks[at + 1]]
    depth = np.array(depth, float)
    above = np.maximum(parent, 0)
    total, c = max(1.0, chars[0]), np.maximum(chars, 1)
    heading = np.array([t in ("h1", "h2", "h3", "h4", "h5", "h6") for t in tree.tag], float)
    heading_above = heading[above]
    columns = [
        run, own_tag, own_sum, own_min, own_max, up_low, up_high, own_tag[above], own_sum[above], below_low, below_high,
        size, density, chars / total, chars / np.maximum(chars[above], 1), np.log1p(blocks), chars / np.maximum(blocks + runs, 1),
        marks / c, chars / np.maximum(runs, 1), depth, depth / max(1.0, depth.max()),
        siblings, alike, prev_size, prev_link, next_size, next_link, around, np.log1p(counts["p"]), linky / np.maximum(runs, 1),
        digit / c, upper / c, symbols / c, np.log1p(words), c / np.maximum(words, 1), np.log1p(counts["li"]), np.log1p(inputs), np.log1p(long),
        heading, heading_above, size[above], density[above],
    ]
    return np.array(columns, np.float32).T
