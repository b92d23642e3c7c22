"""HTML extraction by wrapper induction: the pages of a host are aligned by simple tree matching.

A page becomes a tree of its block elements; inline elements only add text to the block around them.  Elements
that by name, role or class are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
comments are left out of it.

Wrapper.  A page's like siblings become one, and what different shapes the pages of a host then have, all of them, are merged
into one tree of slots.  Simple tree matching aligns a tree with it top down: the children of matched nodes, like siblings as
one, are matched in order so that the most nodes match; what has no partner becomes a slot of its own.  About ``FAN`` shapes
are merged at a time in order of their hashes, then the trees that come of them, until a host has one; each shape's way through
these merges says for each block in which slot it stands.

Template and content.  Over all pages of a host, equal ones counted once, the pages that hold a block in its slot
are counted, and a block is constant if two pages and more than ``SHARE`` of all hold it, however many these are.  A slot of
which all text is constant is template; where a slot also has text that varies, what recurs in it may be the pages' own
words, and is kept.  The content slot is the deepest slot with nearly all of the host's varying text; its blocks are returned
without those of template slots, and so are headings that vary before it.  A heading in a template slot is kept if the next
block is.  Where content is nearly all constant, nothing says what is template, and nothing in it is dropped.

An article or main element settles where content is, if it has half of the varying text of the slot found: the slot is widened to
the article it is in, or narrowed to the articles in it.  Inside one, blocks of template slots go only at its edges, before the
first and behind the last block that is kept for itself, or where the same text stands outside it too.  A page with nothing in the
host's content slot gives its articles, or else all that varies.

Plans.  Pages are parsed once, and their blocks kept in a scratch table.  Shapes and counts are aggregated; no host's pages meet
in one task.  A host's slots are as many as its different structures have, and the last merge holds them; pages get the slots of
their own shape only.  What is known of shapes is broadcast while it is at most ``MAX_BROADCAST_BYTES`` and ``MAX_BROADCAST_IDS``
shapes, else joined by host and shape.

Defined cases: null html is empty and gives empty text; a null url's host is empty; a host's only page varies
everywhere; if nothing varies, everything counts as varying; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import html as _html
import json
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, materialise, only

MAX_BROADCAST_BYTES = 32_000_000
MAX_BROADCAST_IDS = 2_000_000
#: So many shapes of a host, on average at most, are merged at a time.
FAN = 64
#: A block is constant if more than this share of a host's different pages hold it.
SHARE = 0.5
#: Share of the varying text that the next slot down must hold to narrow the content slot.
NARROW = 0.8

# Element names of HTML, and names that mark what is not main text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript object ol option p pre search section select summary svg table tbody td template textarea tfoot th thead title tr ul video audio canvas label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
CLOSES_P = BLOCKS - frozenset("button label option select textarea svg iframe object video audio canvas template noscript".split())
CLOSED_BY_LIKE = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
LIKE = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}
NOT_MAIN = frozenset("head title nav header footer aside form script style noscript template iframe object svg button select option textarea menu dialog search canvas video audio fieldset label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs masthead header footer sidebar aside cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments discussion disqus replies respond related recommended recommendations pagination pager widget toolbar skip copyright".split())
#: Marks that elements around main text may bear too.
LAYOUT = frozenset("header masthead sidebar aside nav navbar menu footer banner widget".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_NAME = re.compile(r"(/?)([A-Za-z][^\s/><]*)")
_REST = re.compile(r"(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+>")
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"\d+")
_LONG_ZEROS, _LONG_NUMBER = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


class Tree:
    """Block elements in page order, 0 being the root, and blocks of text as (element, text)."""

    __slots__ = ("name", "label", "parent", "drop", "layout", "blocks")

    def __init__(self) -> None:
        self.name, self.label, self.parent, self.drop, self.layout = ["#root"], ["#root"], [0], [False], [False]
        self.blocks: list[tuple[int, str]] = []


def _attributes(name: str, text: str) -> tuple[str, bool, bool]:
    """The label of an element, whether it is marked as other than main text, and whether only by names that speak of layout."""
    if not text or text.isspace():
        return name, name in NOT_MAIN, False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(text)}
    marks = set(_SPLIT.split(found.get("class", ""))) | set(_SPLIT.split(found.get("id", "")))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    sure = name in NOT_MAIN or hidden or found.get("role") in ROLES
    named = marks & MARKS if name not in ("html", "body", "main") else set()
    # numbers in class names tell one page's element from the next page's: left out of labels
    classes = sorted(set(_DIGITS.sub("", found.get("class", "")).split()))
    return f"{name}.{'.'.join(classes)}", sure or bool(named), not sure and bool(named) and named <= LAYOUT


def _unescape(s: str) -> str:
    """Character references decoded; numbers beyond any character are replaced first, as they may be too long to convert."""
    if "&#" in s:
        s = _LONG_NUMBER.sub("\ufffd", _LONG_ZEROS.sub("&#", s))
    return _html.unescape(s)


def tags(text: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, and attributes of each tag; comments, scripts and the like have no name.

    Text is read a bounded number of times: a tag without an end is text, and no end is looked for twice.
    """
    at, close = text.find("<"), 0

    def next_close(start: int) -> int:
        nonlocal close
        if 0 <= close < start:
            close = text.find(">", start)
        return close

    while at >= 0:
        end, name, closes, attributes = -1, "", False, ""
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            end = len(text) if end < 0 else end + 3
        elif text[at : at + 9].upper() == "<![CDATA[":
            end = text.find("]]>", at + 9)
            end = len(text) if end < 0 else end + 3
        elif m := _NAME.match(text, at + 1):
            rest = _REST.match(text, m.end())
            end = rest.end() if rest else next_close(m.end()) + 1 or -1
            name, closes, attributes = m[2].lower(), bool(m[1]), text[m.end() : max(end - 1, m.end())]
            if end >= 0 and name in RAW and not closes:
                last = _RAW_END[name].search(text, end)
                end, name = last.end() if last else len(text), ""
        elif text[at + 1 : at + 2] in ("!", "?"):
            end = next_close(at + 2) + 1 or -1
        if end >= 0:
            yield at, end, name, closes, attributes
        at = text.find("<", max(at + 1, end))


def parse(text: str) -> Tree:
    """The tree of block elements and the blocks of text in it."""
    tree = Tree()
    stack = [0]
    places: dict[str, list[int]] = defaultdict(list)  # where on the stack elements of a name are open
    words: list[str] = []
    inline_drop: list[str] = []  # open inline elements whose text is left out
    at = 0

    def flush() -> None:
        if words:
            block = " ".join("".join(words).split())
            words.clear()
            if block:
                tree.blocks.append((stack[-1], block))

    def add(s: str) -> None:
        if s and not inline_drop:
            words.append(_unescape(s) if "&" in s else s)

    def last_open(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places[n]), default=0)

    def close(names: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        place = last_open(names)
        if place > last_open(stop):
            flush()
            while len(stack) > place:
                places[tree.name[stack.pop()]].pop()

    for start, end, name, closes, attributes in tags(text):
        add(text[at:start])
        at = end
        if not name:
            continue
        if name in BLOCKS:
            if closes:
                if name == "p" and not places["p"]:
                    flush()
                close((name,))
                inline_drop.clear()
                continue
            if name in CLOSES_P:
                close(("p",), ("table", "button"))
            if name in CLOSED_BY_LIKE:
                close(LIKE.get(name, (name,)), CLOSED_BY_LIKE[name])
            flush()
            inline_drop.clear()
            if name in VOID:
                continue
            label, drop, layout = _attributes(name, attributes)
            tree.name.append(name)
            tree.label.append(label)
            tree.parent.append(stack[-1])
            tree.drop.append(drop)
            tree.layout.append(layout)
            places[name].append(len(stack))
            stack.append(len(tree.name) - 1)
        elif closes:
            if inline_drop and inline_drop[-1] == name:
                inline_drop.pop()
        elif name in VOID:
            if name == "br":
                add(" ")
        elif inline_drop:
            inline_drop.append(name)
        elif attributes and _attributes(name, attributes)[1]:
            inline_drop.append(name)
    add(text[at:])
    flush()
    return tree


def kept(tree: Tree) -> list[bool]:
    """Which elements are not marked as other than main text, by themselves or by one around them.

    Of a marked element around the article only the marked parts go, and so they do where a name that also
    speaks of layout ("with-sidebar") is on an element with most of the page's text.  Headings in the header
    of an article stay.
    """
    n = len(tree.name)
    mass, holds, inside, state = [0] * n, [False] * n, [False] * n, [0] * n
    for i, block in tree.blocks:
        mass[i] += len(block)
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        mass[p] += mass[i]
        holds[p] = holds[p] or holds[i] or tree.name[i] in ("article", "main")
    for i in range(1, n):
        p, name = tree.parent[i], tree.name[i]
        inside[i] = inside[p] or name in ("article", "main")
        if state[p] == 1:  # gone
            state[i] = 1
        elif state[p] == 2:  # gone but for headings
            state[i] = 0 if name in HEADINGS else 2
        elif tree.drop[i] and (name in NOT_MAIN or not (holds[i] or (tree.layout[i] and not inside[p] and mass[i] > mass[0] / 2))):
            state[i] = 2 if inside[p] and (name == "header" or tree.layout[i]) else 1
    return [s == 0 for s in state]


class Shape:
    """Labels and parents of a tree's elements, parents first; what alignment needs of a page, and what a wrapper is kept as."""

    __slots__ = ("label", "parent", "children", "size", "mark")

    def __init__(self, label: list[str], parent: list[int], mark: list[str] | None = None, size: list[int] | None = None) -> None:
        self.label, self.parent = label, parent
        self.children: list[list[int]] = [[] for _ in label]
        for i in range(1, len(label)):
            self.children[parent[i]].append(i)
        if size is None:
            size = [1] * len(label)
            for i in range(len(label) - 1, 0, -1):
                size[parent[i]] += size[i]
        self.size = size
        # siblings are alike if they have the same label and the same first of their children's labels in order of letters
        self.mark = mark or [min((label[c] for c in some), default="") for some in self.children]


def shape_of(tree: Tree, keep: list[bool]) -> tuple[Shape, list[int]]:
    """The shape of what is kept of a page, and the shape's node for each of the page's elements."""
    label, parent, node = ["#root"], [0], [0] * len(tree.name)
    for i in range(1, len(tree.name)):
        node[i] = node[tree.parent[i]]
        if keep[i]:
            label.append(tree.label[i])
            parent.append(node[i])
            node[i] = len(label) - 1
    return Shape(label, parent), node


def _chain(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of pairs (i, j, weight) in order of i, the heaviest chain in which both i and j rise."""
    if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:])):
        return [(i, j) for i, j, _ in pairs]
    places = sorted({j for _, j, _ in pairs})
    best = [(0, -1)] * (len(places) + 1)  # a Fenwick tree of (weight, last pair) over places
    before, done = [-1] * len(pairs), 0
    weights = [0] * len(pairs)
    for k, (i, j, w) in enumerate(pairs):
        # pairs of one i don't follow each other
        x = at = bisect_left(places, j)
        top = (0, -1)
        while x > 0:
            top = max(top, best[x])
            x &= x - 1
        before[k], weights[k] = top[1], top[0] + w
        if k + 1 == len(pairs) or pairs[k + 1][0] != i:
            for q in range(done, k + 1):
                x = bisect_left(places, pairs[q][1]) + 1
                while x <= len(places):
                    best[x] = max(best[x], (weights[q], q))
                    x += x & -x
            done = k + 1
    k, out = max(range(len(pairs)), key=lambda q: weights[q], default=-1), []
    while k >= 0:
        out.append(pairs[k][:2])
        k = before[k]
    return out[::-1]


class Wrapper:
    """The slots of a host's pages: each has a label, a mark, a parent and an order among its siblings."""

    def __init__(self) -> None:
        self.label, self.mark, self.parent, self.size, self.children = ["#root"], [""], [0], [1], [[]]

    def number(self) -> list[int]:
        """Numbers the slots in the order of pages, those below a slot right behind it; the new number of each old one."""
        order, stack = [], [0]
        while stack:
            order.append(at := stack.pop())
            stack.extend(reversed(self.children[at]))
        new = [0] * len(order)
        for k, old in enumerate(order):
            new[old] = k
        self.label, self.mark, self.size = ([some[old] for old in order] for some in (self.label, self.mark, self.size))
        self.parent = [new[self.parent[old]] for old in order]
        self.children = [[new[c] for c in self.children[old]] for old in order]
        return new

    def shape(self) -> Shape:
        """Itself as something to be merged; slots must be numbered."""
        return Shape(self.label, self.parent, self.mark, self.size)

    def _match(self, slot: int, groups: list[tuple[tuple[str, str], list[int]]], sizes: list[int]) -> list[int]:
        """The slot of each group of like siblings, -1 for none: in order, so that the most nodes match."""
        kids = self.children[slot]
        if not kids or not groups:
            return [-1] * len(groups)
        places: dict[tuple[str, str], list[int]] = defaultdict(list)
        for j, kid in enumerate(kids):
            places[self.label[kid], self.mark[kid]].append(j)
        pairs = [(i, j, min(sizes[i], self.size[kids[j]])) for i, (key, _) in enumerate(groups) for j in places.get(key, ())]
        chain = _chain(pairs)
        out = [-1] * len(groups)
        for (i0, j0), (i1, j1) in zip([(-1, -1), *chain], [*chain, (len(groups), len(kids))]):
            # between two matches, elements of equal labels that are less alike
            free: dict[str, list[int]] = defaultdict(list)
            for j in range(j1 - 1, j0, -1):
                free[self.label[kids[j]]].append(j)
            least = j0
            for i in range(i0 + 1, i1):
                some = free.get(groups[i][0][0], [])
                while some and some[-1] <= least:
                    some.pop()
                if some:
                    least = some.pop()
                    out[i] = kids[least]
            if i1 < len(groups):
                out[i1] = kids[j1]
        return out

    def align(self, page: Shape, grow: bool = False) -> list[int]:
        """The slot of each of a page's nodes, -1 for none; with grow, nodes without one become slots."""
        slot = [-1] * len(page.label)
        slot[0] = 0
        for node, children in enumerate(page.children):
            if slot[node] < 0 or not children:
                continue
            like: dict[tuple[str, str], list[int]] = {}
            for c in children:
                like.setdefault((page.label[c], page.mark[c]), []).append(c)
            groups = list(like.items())
            found = self._match(slot[node], groups, [sum(page.size[c] for c in some) for _, some in groups])
            behind: dict[int, list[int]] = {}  # new slots, by the matched one before them
            last = -1
            for i, ((label, mark), some) in enumerate(groups):
                if found[i] < 0 and grow:
                    found[i] = len(self.label)
                    self.label.append(label)
                    self.mark.append(mark)
                    self.parent.append(slot[node])
                    self.size.append(0)
                    self.children.append([])
                    behind.setdefault(last, []).append(found[i])
                else:
                    last = found[i]
                if grow:
                    self.size[found[i]] = max(self.size[found[i]], sum(page.size[c] for c in some))
                for c in some:
                    slot[c] = found[i]
            if behind:
                kids = self.children[slot[node]]
                self.children[slot[node]] = [*behind.get(-1, ()), *(x for k in kids for x in (k, *behind.get(k, ())))]
        return slot


def _signed(n: int) -> int:
    return n - (n >> 63 << 64)


def copy_of(text: str) -> int:
    """What stands for a page's html: equal to xxhash64 in SQL."""
    return _signed(xxhash.xxh64_intdigest(text, 42))


class Block(NamedTuple):
    """A block of a page: its node of the page's shape, what it is and stands in, and its text with hash."""

    node: int
    kind: int
    hash: int
    text: str


H1, HEADING, IN_ARTICLE, IN_MAIN = 1, 2, 4, 8


class Page:
    """A page's shape, like siblings as one, as text and with its hash, and the blocks that are kept."""

    __slots__ = ("shape", "id", "blocks")

    def __init__(self, text: str) -> None:
        tree = parse(text)
        shape, node = shape_of(tree, keep := kept(tree))
        own = Wrapper()
        slot = own.align(shape, grow=True)
        new = own.number()
        self.shape = json.dumps([own.label, own.parent])
        self.id = copy_of(self.shape)
        kind = [0] * len(tree.name)
        for i, name in enumerate(tree.name):
            kind[i] = kind[tree.parent[i]] & (IN_ARTICLE | IN_MAIN) | (IN_ARTICLE if name == "article" else IN_MAIN if name == "main" else HEADING | (name == "h1") * H1 if name in HEADINGS else 0)
        self.blocks = [Block(new[slot[node[i]]], kind[i], copy_of(b), b) for i, b in tree.blocks if keep[i]]


class Known(NamedTuple):
    """What a page's text depends on beside the slots of its shape: what is known of its host."""

    n: int
    #: Whether the host's pages are copies, and whether article or main elements hold its content.
    copies: bool
    explicit: bool
    #: Where runs of content slots begin and, before the next begins, end.
    bounds: list[int]
    #: Constant blocks as (slot, hash), and those of template slots among them.
    common: frozenset[tuple[int, int]]
    template: frozenset[tuple[int, int]]

    def text(self, slots: list[int], blocks: list[Block]) -> str:
        """The main text of one of the host's pages."""
        at = [slots[b.node] for b in blocks]
        within = [bisect_right(self.bounds, s) % 2 == 1 for s in at]
        first = next((k for k, w in enumerate(within) if w), None)
        if first is None:
            return "\n".join(self._apart(at, blocks))
        fixed = [not self.copies and (s, b.hash) in self.template for s, b in zip(at, blocks)]
        if self.explicit:
            own = [k for k, w in enumerate(within) if w and not fixed[k]]
            outside = {b.text for w, b in zip(within, blocks) if not w}
            for k in range(own[0], own[-1]) if own else ():
                fixed[k] = fixed[k] and blocks[k].text in outside
        for k in range(len(fixed) - 2, -1, -1):
            # a heading goes with what it is above
            if fixed[k] and within[k] and within[k + 1] and not fixed[k + 1] and blocks[k].kind & HEADING:
                fixed[k] = False
        out = []
        for k, b in enumerate(blocks):
            if within[k]:
                if not fixed[k]:
                    out.append(b.text)
            elif k < first and b.kind & HEADING and (at[k], b.hash) not in self.common and (self.n > 1 or b.kind & H1):
                if not self.explicit:
                    out.append(b.text)
        return "\n".join(out)

    def _apart(self, at: list[int], blocks: list[Block]) -> list[str]:
        """Blocks of a page with nothing in the host's content slot."""
        varying = [b for s, b in zip(at, blocks) if (s, b.hash) not in self.common]
        for kind in (IN_ARTICLE, IN_MAIN):
            if own := [b.text for b in varying if b.kind & kind]:
                return own
        return [b.text for b in varying]


class Model:
    """What is known of a host: its number of pages, wrapper, text by slot as (slot, varying, all), constant blocks, and slots by shape."""

    def __init__(self, n: int, wrapper: Shape, masses: list[tuple[int, int, int]], common: set[tuple[int, int]], slots: dict[int, list[int]] | None = None) -> None:
        self.wrapper, self.slots = wrapper, slots or {}
        size = len(wrapper.label)
        own, every = [0] * size, [0] * size
        for slot, varying, all_ in masses:
            own[slot], every[slot] = varying, all_
        all_constant = not any(own)
        own = every if all_constant else own
        common = frozenset() if all_constant else frozenset(common)
        below, all_below, end = list(own), list(every), list(range(1, size + 1))
        for s in range(size - 1, 0, -1):
            p = wrapper.parent[s]
            below[p] += below[s]
            all_below[p] += all_below[s]
            end[p] = max(end[p], end[s])
        top, kids = 0, wrapper.children
        while kids[top]:
            inner = max(kids[top], key=lambda k: below[k])
            if below[inner] < NARROW * below[0] or not kids[inner]:
                break
            top = inner
        content = sorted(self._settled(top, below))
        bounds: list[int] = []
        for s in content:
            if bounds and bounds[-1] == s:
                bounds[-1] = end[s]
            else:
                bounds += [s, end[s]]
        # pages that are nearly the same all over are copies, not made from a template
        copies = sum(below[s] for s in content) < (1 - NARROW) * sum(all_below[s] for s in content)
        explicit = any(wrapper.label[s].split(".")[0] in ("article", "main") for s in content)
        self.known = Known(n, copies, explicit, bounds, common, frozenset(x for x in common if own[x[0]] == 0))

    def _settled(self, top: int, below: list[int]) -> set[int]:
        """The content slots: the one found, unless article or main elements settle it otherwise."""
        label, parent = self.wrapper.label, self.wrapper.parent
        for kind in ("article", "main"):
            marked = [label[s].split(".")[0] == kind for s in range(len(label))]
            if not any(marked):
                continue
            around = [False] * len(label)  # in an article
            for s in range(1, len(label)):
                around[s] = marked[parent[s]] or around[parent[s]]
            outer = {s for s in range(len(label)) if marked[s] and not around[s] and below[s]}
            if marked[top] or around[top]:
                while around[top]:
                    top = parent[top]
                return {top}
            within = set()
            for s in outer:
                up = s
                while up and up != top:
                    up = parent[up]
                if up == top:
                    within.add(s)
            if 2 * sum(below[s] for s in within) >= below[top] and within:
                return within
        return {top}

    def text(self, html: str) -> str:
        """The main text of one of the host's pages."""
        page = Page(html)
        return self.known.text(self.slots[page.id], page.blocks)


def merged(shapes: list[Shape]) -> tuple[Wrapper, list[list[int]]]:
    """One tree of slots of all shapes, and the slots of each shape's nodes."""
    out = Wrapper()
    slots = [out.align(s, grow=True) for s in shapes]
    new = out.number()
    return out, [[new[s] for s in some] for some in slots]


def merges(n: int) -> int:
    """How many times shapes are merged until n have become one."""
    k = 1
    while FAN**k < n:
        k += 1
    return k


def wrapper_of(shapes: dict[int, Shape]) -> tuple[Shape, dict[int, list[int]]]:
    """The wrapper of a host's shapes, in memory, and the slots of each."""
    slots = {i: list(range(len(s.label))) for i, s in shapes.items()}
    place = {i: i for i in shapes}
    for k in range(merges(len(shapes)) - 1, -1, -1):
        buckets = defaultdict(list)
        for i in sorted(shapes):
            buckets[i % FAN**k].append(i)
        made, found = {}, {}
        for bucket, ids in buckets.items():
            wrapper, each = merged([shapes[i] for i in ids])
            made[bucket] = wrapper.shape()
            found |= {i: (bucket, x) for i, x in zip(ids, each)}
        for i in slots:
            place[i], above = found[place[i]]
            slots[i] = [above[s] for s in slots[i]]
        shapes = made
    return shapes[0], slots


def learn(htmls: list[str]) -> Model:
    """The model of a host from all its pages, in memory."""
    pages = list({copy_of(x): Page(x) for x in htmls}.values())
    wrapper, slots = wrapper_of({p.id: Shape(*json.loads(p.shape)) for p in pages})
    held, n = Counter(), len(pages)
    for p in pages:
        held.update({(slots[p.id][b.node], b.hash, len(b.text)) for b in p.blocks})
    common, masses = set(), defaultdict(lambda: [0, 0])
    for (slot, key, size), k in held.items():
        constant = k >= 2 and k > SHARE * n
        masses[slot][1] += k * size
        if constant:
            common.add((slot, key))
        else:
            masses[slot][0] += k * size
    return Model(n, wrapper, [(s, a, b) for s, (a, b) in masses.items()], common, slots)


def extract(text: str, others: list[str]) -> str:
    """The main text of a page, given other pages of its host."""
    return learn([text, *others]).text(text)


def _host() -> Column:
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.lower(F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1))


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, copy, shape with its hash, and the blocks of each page, as a scratch table."""
    blocks = "shape string, shape_id long, nodes array<int>, kinds array<int>, hashes array<long>, lengths array<int>, texts array<string>"
    schema = T.StructType([pages.schema["page_id"], *T._parse_datatype_string(f"url string, host string, copy long, {blocks}")])
    types = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in as_text(batch.column("html")):
                page = Page(text)
                node, kind, hash_, words = zip(*page.blocks) if page.blocks else ((), (), (), ())
                made.append((page.shape, page.id, node, kind, hash_, tuple(map(len, words)), words))
            columns = [pa.array(x, t) for x, t in zip(zip(*made) if made else [()] * len(types), types)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), batch.column("host"), batch.column("copy"), *columns], names=schema.names)

    return materialise(pages.select("page_id", "url", "host", "copy", "html").mapInArrow(run, schema), "parsed-pages", compression="zstd")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the shapes of each host and bucket, which come in order of buckets and ids; only one's tree of slots is held."""
    names = ["host", "depth", "bucket", "shape", "ids", "slots"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]
    at, tree, ids, slots = None, Wrapper(), [], []

    def close() -> tuple:
        new = tree.number()
        return *at, json.dumps([tree.label, tree.parent, tree.mark, tree.size]), ids, [[new[s] for s in some] for some in slots]

    for batch in batches:
        done = []
        for host, depth, bucket, id_, shape in zip(*(batch.column(n).to_pylist() for n in ("host", "depth", "bucket", "id", "shape"))):
            if (host, depth, bucket) != at:
                if at:
                    done.append(close())
                at, tree, ids, slots = (host, depth, bucket), Wrapper(), [], []
            ids.append(id_)
            slots.append(tree.align(Shape(*json.loads(shape)), grow=True))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names=names)
    if at:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*[close()]), types)], names=names)


def _wrappers(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """host and its wrapper; host, shape_id and the slots of the shape's nodes."""
    shapes = materialise(parsed.select("host", F.col("shape_id").alias("id"), "shape").distinct(), "shapes")
    counts = shapes.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    steps = merges(counts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n)
    depth = sum(((F.col("n") > FAN**k).cast("int") for k in range(1, steps)), F.lit(1))
    rows = shapes.join(counts.select("host", depth.alias("depth")), "host")
    powers = F.array(*[F.lit(FAN**k).cast("long") for k in range(steps)])
    wrappers, placed = None, None
    for k in range(1, steps + 1):
        rows = rows.withColumn("bucket", F.pmod("id", F.element_at(powers, F.col("depth") - k + 1))).select("host", "depth", "bucket", "id", "shape")
        rows = rows.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "id")
        made = materialise(rows.mapInArrow(_merge, "host string, depth int, bucket long, shape string, ids array<long>, slots array<array<int>>"), "merged-shapes")
        each = made.select("host", "bucket", F.explode(F.arrays_zip("ids", "slots")).alias("x")).select("host", F.col("x.ids").alias("id"), "bucket", F.col("x.slots").alias("slots"))
        if placed is None:
            placed = each.withColumnRenamed("id", "shape_id")
        else:
            above = each.select("host", F.col("id").alias("bucket"), F.col("bucket").alias("next"), F.col("slots").alias("above"))
            composed = F.when(F.col("next").isNull(), F.col("slots")).otherwise(F.expr("transform(slots, s -> above[s])"))
            placed = placed.join(above, ["host", "bucket"], "left").select("host", "shape_id", F.coalesce("next", "bucket").alias("bucket"), composed.alias("slots"))
        done = made.where(F.col("depth") == k).select("host", F.col("shape").alias("wrapper"))
        wrappers = done if wrappers is None else wrappers.unionByName(done)
        rows = made.where(F.col("depth") > k).select("host", "depth", F.col("bucket").alias("id"), "shape")
    placed = placed.select("host", "shape_id", "slots")
    return wrappers, placed if steps == 1 else materialise(placed, "slots")


def _known(parsed: DataFrame, wrappers: DataFrame, placed: DataFrame) -> DataFrame:
    """What is known of each host, as a scratch table."""
    # a table of its own, so that Spark broadcasts it while it is small and no host's counts are dealt to one task
    sizes = materialise(parsed.select("host", "copy").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size")), "sizes")
    found = parsed.select("host", "copy", "shape_id", F.explode(F.arrays_zip("nodes", "hashes", "lengths")).alias("x")).join(placed, ["host", "shape_id"])
    held = found.select("host", "copy", F.col("slots")[F.col("x.nodes")].alias("slot"), F.col("x.hashes").alias("key"), F.col("x.lengths").alias("length")).distinct()
    # a table of its own, so that Spark can split the join's partition of a host with a third of all rows
    held = materialise(held.groupBy("host", "slot", "key", "length").agg(F.count(F.lit(1)).alias("n")), "slot-counts")
    n, size = F.col("n"), F.col("size")
    constant = (n >= 2) & (n > SHARE * size)
    judged = held.join(sizes, "host").withColumn("constant", constant)
    mass = F.col("n") * F.col("length")
    masses = judged.groupBy("host", "slot").agg(F.sum(F.when(~F.col("constant"), mass).otherwise(0)).alias("varying"), F.sum(mass).alias("every"))
    masses = masses.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "varying", "every"))).alias("masses"))
    # half of a host's pages hold each of these blocks, so there are at most twice as many as a page has blocks
    common = judged.where("constant").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "key"))).alias("common"))
    pairs = "array<struct<slot:int,key:long>>"
    of_pair = pa.list_(pa.struct([("slot", pa.int32()), ("key", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for size, wrapper, masses, common in zip(*(batch.column(n).to_pylist() for n in ("size", "wrapper", "masses", "common"))):
                masses = [(m["slot"], m["varying"], m["every"]) for m in masses or ()]
                known = Model(size, Shape(*json.loads(wrapper)), masses, {(c["slot"], c["key"]) for c in common or ()}).known
                made.append((*known[:4], *([{"slot": s, "key": k} for s, k in sorted(some)] for some in known[4:])))
            types = [pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), of_pair, of_pair]
            columns = [pa.array(x, t) for x, t in zip(zip(*made) if made else [()] * len(types), types)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), *columns], names=["host", *Known._fields])

    hosts = wrappers.join(sizes, "host").join(masses, "host", "left").join(common, "host", "left")
    return materialise(hosts.mapInArrow(run, f"host string, n long, copies boolean, explicit boolean, bounds array<int>, common {pairs}, template {pairs}"), "known")


def _beside(rows: DataFrame, placed: DataFrame, known: DataFrame) -> tuple[DataFrame, Callable]:
    """The rows, and a function from a batch of them to each row's slots and what is known of its host."""
    names = list(Known._fields)
    # about what these take in Python
    shapes = placed.agg(F.coalesce(F.sum(8 * F.size("slots") + 200), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    hosts = known.agg(F.coalesce(F.sum(8 * F.size("bounds") + 200 * (F.size("common") + F.size("template")) + 800), F.lit(0)).alias("bytes")).first()
    if shapes.bytes + hosts.bytes <= MAX_BROADCAST_BYTES and shapes.rows <= MAX_BROADCAST_IDS:
        slots = {(r.host, r.shape_id): r.slots for r in placed.collect()}
        held = rows.sparkSession.sparkContext.broadcast((slots, {r.host: tuple(r[n] for n in names) for r in known.collect()}))

        def of(batch: pa.RecordBatch) -> list[tuple]:
            return [(held.value[0][k], *held.value[1][k[0]]) for k in zip(batch.column("host").to_pylist(), batch.column("shape_id").to_pylist())]

        return rows, of
    joined = rows.join(placed.join(known, "host"), ["host", "shape_id"], "left")
    return joined, lambda batch: list(zip(*(batch.column(n).to_pylist() for n in ("slots", *names))))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, per page."""
    slim = only(pages, "page_id", "url", "html")
    parsed = _parsed(slim.withColumn("host", _host()).withColumn("copy", F.xxhash64(F.coalesce("html", F.lit("")))))
    schema = T.StructType([slim.schema["page_id"], *T._parse_datatype_string("url string, text string, n_chars long")])
    wrappers, placed = _wrappers(parsed)
    rows = parsed.select("page_id", "url", "host", "shape_id", "nodes", "kinds", "hashes", "texts")
    rows, of = _beside(rows, placed, _known(parsed, wrappers, placed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, Known] = {}
        for batch in batches:
            out = []
            columns = (batch.column(n).to_pylist() for n in ("host", "nodes", "kinds", "hashes", "texts"))
            for host, *blocks, (slots, *known) in zip(*columns, of(batch)):
                if host not in cache:
                    if len(cache) > 512:
                        cache.clear()
                    common, template = (frozenset((c["slot"], c["key"]) for c in some) for some in known[4:])
                    cache[host] = Known(*known[:4], common, template)
                out.append(cache[host].text(slots, [Block(*b) for b in zip(*blocks)]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, schema)
