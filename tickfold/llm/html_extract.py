"""HTML extraction by wrapper induction.

Pages of one host are written from one template. Every page is aligned with a central page of its host by simple
tree matching, which gives each of its blocks a place; the texts of every place, menus and footers included, are
counted over all pages of the host. A text that stays the same on most of the pages that have its place becomes
template, and so does a place outside articles whose texts come from a small stock that the host's pages share
(rotating adverts, menus of changing links). What varies is a slot, and slots are content unless the prior speaks
against them. The prior is evidence from tags, roles and whole class tokens; it alone decides on hosts of few pages:

- elements for menus, footers, forms, scripts and the like, and their roles, are never content;
- tokens of class or id that name such a part (``sidebar``, ``site-menu``, ``comments``; not ``has-sidebar``)
  count 4, vaguer ones (``widget``, ``social``) 2, and being outside of the page's article or main 2;
- prose that varies takes 2 away: over the host's pages, or the text's own length where nothing is known of
  the slot and it isn't outside. From 2 on, a block is left out.

A page isn't emptied by vague tokens or by the template alone: where nothing would stay, its article does, else its
prose and what has vague tokens.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Cache, by_group, sized, small_batches, utf8, written
from .url_filter import host_and_path

#: Pages of a host among which its central page is chosen, the first by a hash of the id. The central page only
#: names places; what is template is counted over all pages.
CENTRES = 6
#: Levels of the tree that are aligned; what is deeper has the place of its ancestor there.
DEEPEST = 120
#: A text is template if this share of the aligned pages, and at least so many of them, have it.
CONSTANT, LEAST_PAGES = 0.6, 4
#: Pages from which a text is template even where most other texts vary, and the mean length from which texts are prose.
SURE_PAGES, PROSE = 16, 60
#: A slot rotates if this share of its texts is on other pages too, on hosts where less than OFTEN of the prose is.
ROTATES, OFTEN = 0.9, 0.5
#: Templates hold what at least one in so many pages of the host has, so that they are as long as this many pages at most.
SUPPORT = 1_000
#: Counts that a task keeps before they go on.
KEPT_COUNTS = 100_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: Opening one of these closes an open p.
CLOSES_P = frozenset(
    "address article aside blockquote details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "li main nav ol p pre section table ul td tr".split()
)
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
SELF_CLOSING = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
FRAME_TAGS = frozenset("nav footer aside form head script style noscript template iframe button select dialog menu svg math textarea title object".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words in tokens of class and id that name a part of the frame, vaguer ones, and words that may stand beside them.
COMMENTS = frozenset("comment comments commentlist respond disqus".split())
FRAME_WORDS = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs consent cookie cookies footer menu menus modal nav navbar navigation newsletter "
    "notice popup sidebar sponsor sponsored subscribe".split()
)
VAGUE_WORDS = frozenset("banner header masthead promo related share sharing side social toolbar widget widgets".split())
BESIDE_WORDS = frozenset("area bar block bottom box column container footer global group inner item left links list main page primary right secondary section site thread top wrap wrapper".split())
#: Points of a block for its tokens (comments can't be a wrapper) and for being outside the article; what prose takes away.
COMMENT, NAMED, VAGUE, OUTSIDE, VARIED = 5, 4, 2, 2, 2
#: Points from which a block is left out.
LEFT_OUT = 2


class Node:
    """An element: its tag, its name (with class and id), whether its tag or role makes it part of the frame, the
    points of its tokens, and its children (nodes and texts)."""

    __slots__ = ("tag", "name", "frame", "mark", "children")

    def __init__(self, tag: str, name: str, frame: bool, mark: int = 0):
        self.tag, self.name, self.frame, self.mark, self.children = tag, name, frame, mark, []


def _points(token: str) -> int:
    words = [w for w in re.split(r"[-_]+|\d+", token.lower()) if w]
    if not all(w in FRAME_WORDS or w in VAGUE_WORDS or w in BESIDE_WORDS for w in words):
        return 0
    return max((COMMENT if w in COMMENTS else NAMED if w in FRAME_WORDS else VAGUE if w in VAGUE_WORDS else 0 for w in words), default=0)


_POINTS = Cache(_points, 10_000)


def _element(tag: str, attributes: str, article: bool) -> Node:
    name, frame, points = tag, tag in FRAME_TAGS or tag == "header" and not article, 0
    if attributes:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        mark = f"{found.get('class', '')} {found.get('id', '')}".strip()
        if mark and tag not in ("article", "main", "body", "html"):
            name = f"{tag}.{mark.replace('/', '|')}"
            points = max((_POINTS[t] for t in mark.split() if not (article and t.lower() == "header")), default=0)
        frame = frame or found.get("role", "").lower() in FRAME_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    return Node(tag, name, frame, points)


def parse(page: str) -> Node:
    """The tree of a page; unclosed and misnested tags are closed where HTML's own rules close them."""
    root = Node("#root", "#root", False)
    stack = [root]
    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth and not (tag in INLINE and any(n.tag not in INLINE for n in stack[depth + 1 :])):
                del stack[depth:]
            continue
        if tag in CLOSES_P:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
            if depth and all(n.tag == "p" or n.tag in INLINE for n in stack[depth:]):
                del stack[depth:]
        if stack[-1].tag == "head" and tag not in HEAD_TAGS:
            stack.pop()  # </head> may be left out
        if tag in SELF_CLOSING:
            ends = SELF_CLOSING[tag].split()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        article = any(n.tag in ("article", "main") for n in stack)
        if tag in ("article", "main"):
            for above in stack:  # what holds the article is a wrapper, whatever its class
                above.mark = above.mark if above.mark == COMMENT else 0
        node = _element(tag, m[3], article)
        stack[-1].children.append(node)
        if tag in VOID or m[4] and tag in ("svg", "math"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def decoded(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def blocks(root: Node) -> list[tuple[tuple[Node, ...], str]]:
    """(path of block elements from the root, text) of all non-empty blocks in page order. Inline elements
    are part of their block; a line break is white space."""
    out: list[tuple[tuple[Node, ...], str]] = []
    run: list[str] = []

    def end(path: tuple[Node, ...]) -> None:
        text = " ".join(decoded("".join(run)).split()) if run else ""
        run.clear()
        if text:
            out.append((path, text))

    todo: list[tuple[Node, tuple[Node, ...], int]] = [(root, (), 0)]  # pages may nest deeper than calls can
    while todo:
        node, path, i = todo.pop()
        inline = node.tag in INLINE and not node.frame
        while i < len(node.children):
            child = node.children[i]
            i += 1
            if isinstance(child, str):
                run.append(child)
            elif child.tag == "br":
                run.append(" ")
            else:
                todo.append((node, path, i))
                if child.tag in INLINE and not child.frame:
                    todo.append((child, path, 0))
                else:
                    end(path)
                    todo.append((child, (*path, child), 0))
                break
        else:
            if not inline:
                end(path)
    return out


def skeleton(root: Node) -> tuple:
    """Nested tuples (children as (name, node), texts) of the block elements that hold texts."""
    return _tree([(path, text) for path, text in blocks(root) if not any(node.tag in RAW for node in path)])


def _tree(found: list[tuple[tuple[Node, ...], object]]) -> tuple:
    top: tuple[dict, list] = ({}, [])
    for path, text in found:
        at = top
        for node in path[:DEEPEST]:
            at = at[0].setdefault(id(node), (node.name, ({}, [])))[1]
        at[1].append(text)

    def fixed(node: tuple[dict, list]) -> tuple:
        return tuple((name, fixed(below)) for name, below in node[0].values()), tuple(node[1])

    return fixed(top)


class Shapes:
    """Shapes of trees as numbers: equal numbers, equal trees of names. ``size`` matches two of them."""

    def __init__(self, of: Shapes | None = None):
        self.number: dict[tuple, int] = dict(of.number) if of else {}
        self.parts: list[tuple] = list(of.parts) if of else []
        self.nodes: list[int] = list(of.nodes) if of else []
        self.memo: dict[tuple[int, int], int] = {}

    def add(self, children: tuple) -> int:
        """The number of a node whose children are (name, number of shape)."""
        if (n := self.number.get(children)) is None:
            n = self.number[children] = len(self.parts)
            self.parts.append(children)
            self.nodes.append(1 + sum(self.nodes[c] for _, c in children))
        return n

    def size(self, a: int, b: int) -> int:
        """Simple tree matching of two nodes of one name: the largest number of pairs that keep order and parents."""
        x, y = self.parts[a], self.parts[b]
        if a == b or not x or not y:
            return self.nodes[a] if a == b else 1
        if (found := self.memo.get((a, b))) is None:
            # Equal children at either end match each other in a best matching.
            head, tail = _ends(x, y, lambda i, j: x[i] == y[j])
            found = 1 + sum(self.nodes[c] for _, c in x[:head] + x[len(x) - tail :])
            x, y = x[head : len(x) - tail], y[head : len(y) - tail]
            if x and y:
                found += int(_last_row(self.rows(x, y), 0, len(x), 0, len(y))[-1])
            self.memo[a, b] = found
        return found

    def rows(self, x: tuple, y: tuple) -> Callable[[int], np.ndarray]:
        """The sizes of child i of x with every child of y."""
        kinds = {k: n for n, k in enumerate(dict.fromkeys(y))}
        at, made = np.array([kinds[k] for k in y]), {}

        def row(i: int) -> np.ndarray:
            name, shape = x[i]
            if x[i] not in made:
                made[x[i]] = np.array([self.size(shape, other) if name == n else 0 for n, other in kinds], float)
            return made[x[i]][at]

        return row


def _ends(x: Sequence, y: Sequence, same: Callable[[int, int], bool]) -> tuple[int, int]:
    """How many children at the start, and then at the end, are the same in both."""
    most, head, tail = min(len(x), len(y)), 0, 0
    while head < most and same(head, head):
        head += 1
    while tail < most - head and same(len(x) - 1 - tail, len(y) - 1 - tail):
        tail += 1
    return head, tail


def _next(before: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.concatenate(([0.0], np.maximum(before[1:], before[:-1] + weights))))


def _last_row(row: Callable[[int], np.ndarray], top: int, end: int, left: int, right: int, back: bool = False) -> np.ndarray:
    """Sizes of the best order-keeping pairs of rows top to end with each prefix (``back``: suffix) of columns."""
    line = np.zeros(right - left + 1)
    for i in reversed(range(top, end)) if back else range(top, end):
        weights = row(i)[left:right]
        line = _next(line, weights[::-1] if back else weights)
    return line


#: Cells of a table of siblings whose choices are held at once, a bit each; larger tables are halved first.
CELLS = 1 << 24


def _pairs(row: Callable[[int], np.ndarray], top: int, end: int, left: int, right: int) -> Iterator[tuple[int, int]]:
    """The pairs of a best order-keeping choice. Memory is linear: a larger table is cut at a row and the column
    where the best choice crosses it."""
    if top == end or left == right:
        return
    if (end - top) * (right - left) > CELLS and end - top > 1:
        mid = (top + end) // 2
        both = _last_row(row, top, mid, left, right) + _last_row(row, mid, end, left, right, back=True)[::-1]
        cut = left + int(both.argmax())
        yield from _pairs(row, top, mid, left, cut)
        yield from _pairs(row, mid, end, cut, right)
        return
    line, up, back = np.zeros(right - left + 1), [], []
    for i in range(top, end):
        below = _next(line, row(i)[left:right])
        up.append(np.packbits(below[1:] == line[1:]))
        back.append(np.packbits(below[1:] == below[:-1]))
        line = below
    i, j, found = end - top - 1, right - left - 1, []
    while i >= 0 and j >= 0:
        if up[i][j >> 3] >> (7 - (j & 7)) & 1:
            i -= 1
        elif back[i][j >> 3] >> (7 - (j & 7)) & 1:
            j -= 1
        else:
            found.append((top + i, left + j))
            i, j = i - 1, j - 1
    yield from reversed(found)


class Part(NamedTuple):
    """A node to align: its shape, its children's names and parts, its own texts, and all digests below it."""

    shape: int
    names: tuple[str, ...]
    parts: tuple
    texts: tuple
    all: frozenset


def _part(node: tuple, shapes: Shapes, digest: Callable = lambda text: text) -> Part:
    names = tuple(name for name, _ in node[0])
    parts = tuple(_part(below, shapes, digest) for _, below in node[0])
    return Part(shapes.add(tuple(zip(names, (p.shape for p in parts)))), names, parts, tuple(node[1]), frozenset(map(digest, node[1])).union(*(p.all for p in parts)))


def match(a: tuple, b: tuple) -> int:
    """Simple tree matching: the largest number of node pairs that keep order and parents."""
    shapes = Shapes()
    return shapes.size(_part(a, shapes).shape, _part(b, shapes).shape)


def _partners(c: Part, p: Part, shapes: Shapes) -> dict[int, int]:
    """The child of c for each child of p in a best matching; of equal ones, that with more children that share texts."""
    if not c.parts or not p.parts:
        return {}
    x, y = (tuple(zip(q.names, (k.shape for k in q.parts))) for q in (c, p))
    apart = c.all.isdisjoint(p.all)
    head, tail = _ends(x, y, lambda i, j: x[i] == y[j] and (apart or not c.parts[i].all.isdisjoint(p.parts[j].all)))
    found = {i: i for i in range(head)} | {len(y) - 1 - k: len(x) - 1 - k for k in range(tail)}
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if not x or not y:
        return found
    size, having = shapes.rows(x, y), {}
    for j in range(len(y)):
        for d in p.parts[head + j].all:
            having.setdefault(d, []).append(j)

    def row(i: int) -> np.ndarray:
        weights = size(i)
        if shared := [having[d] for d in c.parts[head + i].all if d in having]:
            bonus = np.zeros(len(y))
            for js in shared:
                bonus[js] = ALIKE
            weights = weights + bonus * (weights > 0)
        return weights

    if len(x) == 1 or len(y) == 1:  # the first of the best
        weights = row(0) if len(x) == 1 else np.array([row(i)[0] for i in range(len(x))])
        best = int(weights.argmax())
        pair = (best, 0) if len(x) == 1 else (0, best)
        return found | ({head + pair[0]: head + pair[1]} if weights[best] > 0 else {})
    return found | {head + j: head + i for i, j in _pairs(row, 0, len(x), 0, len(y))}


#: Less than one node in all, and exact in sums.
ALIKE = 2.0**-20


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def all_blocks(page: str) -> list[tuple[tuple[Node, ...], str]]:
    """The blocks of a page that a reader could see: those of menus and footers too, but no scripts or styles."""
    return [(path, text) for path, text in blocks(parse(page)) if not any(n.tag in RAW or n.tag == "head" for n in path)]


def central_of(pages: list[tuple]) -> tuple:
    """The page that most of the others match best relative to their sizes; of equal ones, the first."""
    shapes = Shapes()
    of = [_part(p, shapes).shape for p in pages]
    return pages[max(range(len(of)), key=lambda i: sum(shapes.size(of[i], b) / (shapes.nodes[of[i]] + shapes.nodes[b]) for b in of))]


class Central:
    """A host's central page, ready to be aligned with others."""

    def __init__(self, tree: str):
        self.shapes = Shapes()
        self.top = _part(json.loads(tree), self.shapes)


def places(found: list[tuple[tuple[Node, ...], str]], central: Central) -> list[tuple[str, str, int]]:
    """(place, path of names, digest of the text) of each block. A place numbers the central page's nodes; below
    a node that has no partner there, it has the names of the page's own nodes with a ``+``."""
    digests = [_digest(text) for _, text in found]
    shapes = Shapes(central.shapes)
    page = _part(_tree([(path, i) for i, (path, _) in enumerate(found)]), shapes, digests.__getitem__)
    out: list = [None] * len(found)
    todo: list = [(central.top, page, "", "")]
    while todo:
        c, node, place, names = todo.pop()
        for i in node.texts:
            out[i] = place, names, digests[i]
        partner = _partners(c, node, shapes) if c is not None else {}
        for j, (name, below) in enumerate(zip(node.names, node.parts)):
            i = partner.get(j)
            todo.append((c.parts[i] if i is not None else None, below, f"{place}/{name}{'+' if i is None else f'[{i}]'}", f"{names}/{name}"))
    return out


class Template(NamedTuple):
    """What a host's pages share: the central page, its constant texts (place, digest), and paths of names whose
    texts rotate or are prose that varies."""

    central: Central
    constant: frozenset[tuple[str, int]]
    rotates: frozenset[str]
    prose: frozenset[str]


KEPT, BY_TEMPLATE, BY_PRIOR = range(3)


def judged(page: str, template: Template | None = None) -> list[tuple[str, int]]:
    """(text, decision) of all blocks in page order: kept, left out by the host's template, or by the prior."""
    found = all_blocks(page)
    inner = [any(n.tag in ("article", "main") for n in path) for path, _ in found]
    frame = [any(n.frame for n in path) for path, _ in found]
    mark = [max((n.mark for n in path), default=0) for path, _ in found]
    own = [i and not f for i, f in zip(inner, frame)]
    at = places(found, template.central) if template else [("", "", 0)] * len(found)
    out = []
    for i, ((_, text), (place, names, digest)) in enumerate(zip(found, at)):
        outside = OUTSIDE if any(own) and not inner[i] else 0
        varied = template and names in template.prose or not outside and len(text) >= PROSE
        if template and ((place, digest) in template.constant or names in template.rotates):
            out.append(BY_TEMPLATE)
        else:
            out.append(BY_PRIOR if frame[i] or mark[i] + outside - (VARIED if varied else 0) >= LEFT_OUT else KEPT)
    # Many copies of one page look like a template: an article of which nothing would be left stays, and so does
    # prose without an article on hosts where no prose varies.
    lost = not any(o == KEPT and (mine or not any(own)) for o, mine in zip(out, own))
    copies = template and not template.prose and not any(own) and not any(o == KEPT and len(text) >= PROSE for (_, text), o in zip(found, out))
    if lost or copies:
        for i, (_, text) in enumerate(found):
            spared = own[i] if any(own) else len(text) >= PROSE or lost and out[i] == BY_PRIOR
            if spared and not frame[i] and mark[i] <= VAGUE:
                out[i] = KEPT
    return [(text, o) for (_, text), o in zip(found, out)]


def main_text(page: str, template: Template | None = None) -> str:
    """The content of a page: the blocks that its host's template and the prior leave, joined by a line break."""
    return "\n".join(text for text, o in judged(page, template) if o == KEPT)


def _central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for host, run in by_group(batches, "host"):
        pages = [_tree([(path, _digest(text)) for path, text in all_blocks(t.decode("utf-8", "replace"))]) for b in run for t in utf8(b, "html")]
        yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps(central_of(pages))])], ["host", "central"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages by (host, place, names, text) and their characters; without text: pages that have the place, and
    without place: pages that have the path of names."""
    trees, pages, chars = Cache(Central, 64), Counter(), Counter()

    def made() -> pa.RecordBatch:
        keys = list(pages)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        out = [*(pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)), *(pa.array([c[k] for k in keys], pa.int64()) for c in (pages, chars))]
        pages.clear()
        chars.clear()
        return pa.RecordBatch.from_arrays(out, ["host", "place", "names", "text", "n", "chars"])

    for batch in batches:
        hosts, centrals = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("host", "central"))
        for host, central, t in zip(hosts, centrals, utf8(batch, "html")):
            found = all_blocks(t.decode("utf-8", "replace"))
            own = {}
            for (place, names, digest), (_, text) in zip(places(found, trees[central]), found):
                own |= {(host, place, names, digest): len(text), (host, place, names, None): 0, (host, None, names, None): 0}
            pages.update(own.keys())
            chars.update(own)
            if len(pages) > KEPT_COUNTS:
                yield made()
    yield made()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Template | None] = {}
    for batch in batches:
        columns = {n: batch.column(batch.schema.get_field_index(n)) for n in ("host", "central", "places", "texts", "rotates", "prose")}
        hosts, out = columns["host"].to_pylist(), []
        for i, t in enumerate(utf8(batch, "html")):
            if (host := hosts[i]) not in known:
                if len(known) >= 64:
                    known.clear()
                central, at, texts, rotates, prose = (columns[n][i].as_py() for n in list(columns)[1:])
                known[host] = Template(Central(central), frozenset(zip(at or (), texts or ())), frozenset(rotates or ()), frozenset(prose or ())) if central else None
            blocks_of = judged((t or b"").decode("utf-8", "replace"), known[host])
            out.append(("\n".join(text for text, o in blocks_of if o == KEPT), *(sum(o == kind for _, o in blocks_of) for kind in (BY_TEMPLATE, BY_PRIOR))))
        text, *numbers = ([row[k] for row in out] for k in range(3))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(text, pa.string()), *(pa.array(n, pa.int64()) for n in numbers)], ["id", "url", "text", "n_by_template", "n_by_prior"]
        )


def _templates(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, places, texts) of the template's constant texts, and (host, rotates, prose) of its paths of names."""
    texts = counts.where("text is not null")
    there = counts.where("text is null and place is not null").select("host", "place", F.col("n").alias("there"))
    paths = counts.where("place is null").select("host", "names", F.col("n").alias("pages"))
    constant = texts.where(F.col("n") >= LEAST_PAGES).join(there, ["host", "place"]).where(F.col("n") >= CONSTANT * F.col("there"))
    fixed = constant.groupBy("host", "names").agg(F.sum("n").alias("fixed"))
    again = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again")
    slots = texts.groupBy("host", "names").agg(F.sum("n").alias("total"), F.sum("chars").alias("chars"), again).join(paths, ["host", "names"]).join(fixed, ["host", "names"], "left")
    is_prose = F.col("chars") >= PROSE * F.col("total")
    hosts = slots.groupBy("host").agg(
        F.max("pages").alias("of"), (F.sum(F.when(is_prose, F.col("again"))) < OFTEN * F.sum(F.when(is_prose, F.col("total")))).alias("varied")
    )
    varies = F.coalesce("fixed", F.lit(0)) < CONSTANT * F.col("total")
    turning = (F.col("total") >= SURE_PAGES) & (F.col("again") >= ROTATES * F.col("total")) & ~F.col("names").rlike("/(article|main)(/|$)")
    slots = slots.join(hosts, "host").where(F.col("pages") * SUPPORT >= F.col("of"))
    slots = written(slots.select("host", "names", "pages", "of", "total", varies.alias("varies"), is_prose.alias("prose"), (turning & F.coalesce("varied", F.lit(False))).alias("rotates")))
    # Where most texts vary, the place is a slot, and a text that a few pages repeat there is content.
    sure = (F.col("n") >= SURE_PAGES) & (F.col("n") >= CONSTANT * F.col("pages"))
    kept = constant.join(slots, ["host", "names"]).where((~F.col("varies") | sure) & (F.col("n") * SUPPORT >= F.col("of")))
    template = kept.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("t")).select("host", F.col("t.place").alias("places"), F.col("t.text").alias("texts"))
    prose = F.col("varies") & F.col("prose") & ~F.col("rotates") & (F.col("total") >= LEAST_PAGES)
    lists = (F.sort_array(F.collect_list(F.when(w, F.col("names")))).alias(name) for name, w in (("rotates", F.col("rotates")), ("prose", prose)))
    return template, slots.groupBy("host").agg(*lists)


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (content blocks in page order, joined by a line break; empty if none), n_chars, and
    how many blocks the host's template and the prior left out.

    White space inside a block is one space, and character references are decoded. Null pages count as
    empty; pages without a host (null urls too) share a template. A host of few pages has no template,
    so only the prior speaks. Repeated rows stay, and count as pages of their own. Of equal alignments, the one
    with more equal texts is taken. Whole pages are read, however long; one is in memory at a time with its host's
    central page, and siblings are aligned in memory linear in their number. An empty table gives an empty one.
    Other columns are not looked at.
    """
    small_batches(df.sparkSession)
    host = host_and_path(F.col(url_col))[0]
    base = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    order = F.xxhash64("id", "html")
    # Spark cuts each task's rows of a host to the limit before it deals them by host.
    pages = base.where("html is not null").select("host", order.alias("o")).distinct()
    place = F.row_number().over(Window.partitionBy("host").orderBy("o"))
    chosen = pages.withColumn("place", place).where(F.col("place") <= CENTRES)
    enough = chosen.groupBy("host").agg(F.max("place").alias("most")).where(F.col("most") >= LEAST_PAGES)
    chosen = chosen.join(enough, "host", "left_semi").select("host", "o")
    few = base.where("html is not null").withColumn("o", order).join(sized(chosen), ["host", "o"], "left_semi").select("host", "o", "html").dropDuplicates(["host", "o"])
    central = sized(few.repartition("host").sortWithinPartitions("host", "o").select("host", "html").mapInArrow(_central, "host string, central string"))
    shape = "host string, place string, names string, text long, n long, chars long"
    counts = base.where("html is not null").select("host", "html").join(central, "host").mapInArrow(_counts, shape)
    counts = written(counts.groupBy("host", "place", "names", "text").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")))
    template, slots = _templates(counts)
    fitted = sized(central.join(template, "host", "left").join(slots, "host", "left"))
    made = base.join(fitted, "host", "left").select("id", "url", "html", "host", "central", "places", "texts", "rotates", "prose")
    out = made.mapInArrow(_extract, f"id {dict(base.dtypes)['id']}, url string, text string, n_by_template long, n_by_prior long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_by_template", "n_by_prior")
