"""Main text of HTML pages by wrappers: union-free regular expressions inferred per host.

Pages become streams of block-level tags and texts, properly nested. The streams of all pages
of a host are aligned one after the other: equal tags merge, neighbours that repeat fold into a
repeated group ``( ... )+``, what only some pages have becomes optional ``( ... )?``, and texts
become slots. Every text of every page then falls to a place of the host's wrapper, and what
fills a place is counted over all pages with different texts: a place that one text fills
on nearly all pages that have it is the template's, any other is a slot, and each part of the wrapper
has the mean length of what its slots hold outside links.

The wrapper then decides a page's main text: from the root down, the part that holds most of the
slots' text (of those that the page has) is followed, whatever its name; the last one, or the article around
it, is the core. Blocks are the core's texts in slots. Of what is around the core, up to a part with a
title where the core has none, only what isn't named like boilerplate counts. Navigation,
footers, asides, forms, hidden parts and comments never do. Hosts with fewer than TEMPLATE_PAGES different pages are
judged by their pages' own structure (``article``, ``main``, names of classes). Blocks
have their white space collapsed and are joined by line feeds in page order.

Scale: equal structures of a host are one row, so aligning costs by the host's number of structures; they are
merged in buckets by hash and levels, FAN to a task's group, in an order that doesn't depend on the
layout. Places' texts travel as hashes, counted by partial aggregates, so a host with a third of
all pages is many tasks' work. Wrappers are broadcast while their measured size is small; beyond that they
join on the host and a share of its pages. Pages are then worked on one by one.

Defined results: null or empty html has an empty text; a page without a host shares the wrapper of the
empty host; broken or cut-off markup never fails (tags left open end where their parent
ends); very long pages and any depth are worked on whole; repeated rows give equal results and count once;
an empty table gives an empty result; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import json
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.url_filter import host_and_path
from textloom.session import lean, materialize, ship

#: A text is the template's that fills a place on so many differing pages, and on this percentage of those that have the place.
TEMPLATE_PAGES, TEMPLATE_PERCENT = 3, 90
#: A part with this share of the slots' text of the part around it is followed to the core.
CORE_SHARE = 0.7
#: So many structures of a host are merged by one group's task at a time; more take further levels.
FAN = 256
#: Outside an article a list, and inside one a part with a word of DROP_WORDS, whose text is links to this share or more is a menu.
LINK_SHARE = 0.8
#: Wrappers are broadcast up to so many bytes in all; beyond, they join on the host and one of SHARES shares of its pages.
BROADCAST_BYTES, SHARES = 16 << 20, 16
#: An alignment keeps all its rows of bits up to so many cells; beyond, it makes them again in groups. The result is the same.
MAX_CELLS = 250_000

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title noframes noembed xmp canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends an open element of these names, up to the nearest container.
ENDS = {
    **dict.fromkeys(("li",), ("li",)),
    **dict.fromkeys(("dt", "dd"), ("dt", "dd")),
    **dict.fromkeys(("option", "optgroup"), ("option",)),
    **dict.fromkeys(("td", "th"), ("td", "th")),
    "tr": ("td", "th", "tr"),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ("td", "th", "tr", "tbody", "thead", "tfoot")),
    "body": ("head",),
}
CONTAINERS = frozenset("article aside body div footer form header main nav ol section table ul dl blockquote details".split())
#: Parts that are never main text: by element, by role, and by a word of class or id.
DROP_TAGS = frozenset("nav footer aside form menu dialog select button dir".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside widget widgets header masthead topbar "
    "footer copyright cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist respond replies reply disqus discussion share sharing social related recommended recommendations trending "
    "skip search toolbar hidden".split()
)
#: Inside an article words of an id, or parts of a class, may name its content; only these whole classes, and ids of comments, drop there.
CLEAR_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsored promo navbar menubar breadcrumb breadcrumbs pagination pager "
    "sidebar widget widgets topbar gdpr newsletter subscribe signup comments commentlist respond disqus share sharing hidden".split()
)
CLEAR_IDS = frozenset("comments respond disqus_thread".split())
#: Readers' comments, and adverts by their whole class, are never main text; elements that can hold one.
COMMENT_WORDS = frozenset("comment comments commentlist respond replies reply disqus".split())
ADVERT_CLASSES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsored".split())
#: A class one of whose ends is such a word names an advert or a notice, inside an article too.
PART_WORDS = ADVERT_CLASSES | frozenset("sponsor promo promotion promotions cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal".split())
HOLDERS = frozenset("#root html body div section main article center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ARTICLE_TAGS, ARTICLE_WORDS = frozenset(("article", "main")), frozenset("articlebody".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z0-9]+")


def _ends(token: str) -> set[str]:
    """The first and the last word of a class or id, numbers aside."""
    words = [w for w in _WORDS.findall(token) if not w.isdigit()]
    return {words[0], words[-1]} if words else set()


@dataclass(slots=True)
class Node:
    """An element (``tag`` and its words) with its children, or a text (tag ``#``) with the share of it in links."""

    label: str
    children: list[Node] = field(default_factory=list)
    text: str | None = None
    linked: int = 0
    drop: bool = False
    unclear: bool = False
    barred: bool = False
    article: bool = False
    plus: bool = False
    optional: bool = False
    heading: bool = False
    total: int = 0
    links: int = 0
    part: list | None = None


def _deep(f: Callable) -> Callable:
    """A recursive function, written as a generator that yields its calls' ``steps``, at any depth."""

    def run(*args):
        stack, value = [f(*args)], None
        while stack:
            try:
                call = stack[-1].send(value)
            except StopIteration as e:
                stack.pop()
                value = e.value
            else:
                stack.append(call)
                value = None
        return value

    run.steps, run.__doc__ = f, f.__doc__
    return run


@lru_cache(maxsize=4096)
def _element(name: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """Label of an element, whether it is no main text, whether an article's content can be so named, whether it never is any, and whether it is an article."""
    found = {a.lower(): html_lib.unescape(b or c or d or "") for a, b, c, d in _ATTRIBUTE.findall(attributes)} if attributes.strip(" \t\r\n/") else {}
    words = _WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}".lower())
    role = found.get("role", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    article = name in ARTICLE_TAGS or role in ("main", "article") or found.get("itemprop", "").lower() in ARTICLE_WORDS
    plain = name in ("html", "body") or article
    sure = not plain and (name in DROP_TAGS or role in DROP_ROLES) or hidden
    drop = sure or not plain and not DROP_WORDS.isdisjoint(words)
    classes, ident = found.get("class", "").lower().split(), found.get("id", "").strip().lower()
    ends = set().union(*map(_ends, classes))
    # an id is short where it numbers or places comments, and longer where it names what a part is about
    commented = not COMMENT_WORDS.isdisjoint(ends) or not COMMENT_WORDS.isdisjoint(_ends(ident)) and sum(not w.isdigit() for w in _WORDS.findall(ident)) <= 2
    named = commented or not CLEAR_CLASSES.isdisjoint(classes) or not PART_WORDS.isdisjoint(ends) or ident in CLEAR_IDS
    unclear = drop and not sure and (not named or name in HEADINGS)
    barred = sure or drop and not unclear and not (COMMENT_WORDS.isdisjoint(words) and ADVERT_CLASSES.isdisjoint(ends))
    # words with digits tell pages and comments apart, and so do the ids of headings: they would never align
    shown = words if name not in HEADINGS else _WORDS.findall(found.get("class", "").lower())
    return ".".join([name, *sorted({w for w in shown if w.isalpha()})]), drop, unclear, barred, article


def parse(page: str) -> Node:
    """The block-level tree of a page; inline tags only add to the text around them."""
    root = Node("#root")
    stack: list[tuple[str, Node]] = [("#root", root)]
    opened: dict[str, int] = {}
    text: list[str] = []
    state = {"links": 0, "linked": 0}

    def flush() -> None:
        if text:
            words = " ".join("".join(text).split())
            if words:
                stack[-1][1].children.append(Node("#", text=words, linked=min(state["linked"], len(words))))
            text.clear()
        state["linked"] = 0

    def close(names: tuple[str, ...], stop: frozenset[str]) -> None:
        while True:
            for name in names:
                if opened.get(name):
                    break
            else:
                return
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    for name, _ in stack[k:]:
                        opened[name] -= 1
                    del stack[k:]
                    break
                if stack[k][0] in stop:
                    return
            if len(names) == 1:
                return

    def add(piece: str) -> None:
        if piece:
            piece = html_lib.unescape(piece)
            text.append(piece)
            if state["links"]:
                state["linked"] += len(piece)

    at, size = 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        ends, name, attributes = found.groups()
        if name is None:
            continue
        name = name.lower()
        if not ends and name in RAW and not attributes.rstrip().endswith("/"):
            stop = _raw_end(name).search(page, at)
            at = stop.end() if stop else size
            if name in ("audio", "video", "object", "iframe", "svg", "math", "canvas"):
                text.append(" ")
        elif name == "br":
            text.append(" ")
        elif name == "a":
            state["links"] = 0 if ends else 1
        elif name in BLOCK:
            flush()
            if ends:
                close((name,), frozenset())
            else:
                if name != "option":
                    close(("p",), CONTAINERS | {"td", "th", "li", "dd"})
                if name in ENDS:
                    close(ENDS[name], frozenset(("table", "ol", "ul", "dl", "menu", "select")))
                label, drop, unclear, barred, article = _element(name, attributes)
                node = Node(label, drop=drop, unclear=unclear, barred=barred, article=article)
                stack[-1][1].children.append(node)
                if name not in VOID:
                    stack.append((name, node))
                    opened[name] = opened.get(name, 0) + 1
    flush()
    return root


@lru_cache(maxsize=64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE)


@_deep
def merge(a: Node, b: Node) -> Node:
    """The wrapper of two nodes with one label: their children aligned."""
    out = Node(a.label, plus=a.plus or b.plus, optional=a.optional or b.optional)
    aligned = yield align.steps(a.children, b.children)
    out.children = yield fold.steps(aligned)
    return out


@_deep
def align(x: list[Node], y: list[Node]) -> list[Node]:
    """One stream of children that has both: matching labels merge, the rest is optional."""
    out, i, j = [], 0, 0
    for a, b in [*_matches([n.label for n in x], [n.label for n in y]), (len(x), len(y))]:
        for node in (*x[i:a], *y[j:b]):
            node.optional = True
            out.append(node)
        if a < len(x):
            out.append((yield merge.steps(x[a], y[b])))
        i, j = a + 1, b + 1
    return out


def _matches(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence: the ends that agree, and a longest one between."""
    first, n, m = 0, len(x), len(y)
    while first < min(n, m) and x[first] == y[first]:
        first += 1
    while n > first and m > first and x[n - 1] == y[m - 1]:
        n, m = n - 1, m - 1
    out = [(k, k) for k in range(first)]
    out += [(first + i, first + j) for i, j in _longest(x[first:n], y[first:m])]
    return [*out, *((n + k, m + k) for k in range(len(x) - n))]


def _longest(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, from rows of bits.

    Bit k of row i says whether the longest one of x[i:] and y[m - 1 - k:] is longer than without y[m - 1 - k].
    """
    n, m = len(x), len(y)
    every, step = (1 << m) - 1, 1 if n * m <= MAX_CELLS else math.isqrt(n) + 1
    places: dict[str, int] = {}
    for j, label in enumerate(y):
        places[label] = places.get(label, 0) | 1 << (m - 1 - j)

    def row(i: int, below: int) -> int:
        v = every ^ below
        u = v & places.get(x[i], 0)
        return every ^ ((v + u | v - u) & every)

    kept, bits = {n: 0}, 0
    for i in range(n - 1, -1, -1):
        bits = row(i, bits)
        if i % step == 0:
            kept[i] = bits
    made: dict[int, int] = {}

    def bits_of(i: int) -> int:
        if i not in made:
            made.clear()
            made[min((i // step + 1) * step, n)] = bits = kept[min((i // step + 1) * step, n)]
            for k in range(min((i // step + 1) * step, n) - 1, i // step * step - 1, -1):
                made[k] = bits = row(k, bits)
        return made[i]

    out: list[tuple[int, int]] = []
    i = j = 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        here, rest = bits_of(i), every >> j
        below = (bits_of(i + 1) & rest).bit_count() if i + 1 < n else 0
        if below == (here & rest).bit_count():  # x[i] adds nothing
            i += 1
        else:
            j += 1
    return out


@_deep
def fold(nodes: list[Node]) -> list[Node]:
    """Neighbouring groups of one to three equal labels become one repeated group."""
    for width in (1, 2, 3):
        out: list[Node] = []
        i = 0
        while i < len(nodes):
            here = [n.label for n in nodes[i : i + width]]
            stop = i + width
            group = nodes[i:stop]
            while len(here) == width and [n.label for n in nodes[stop : stop + width]] == here:
                merged = []
                for a, b in zip(group, nodes[stop : stop + width], strict=True):
                    merged.append((yield _repeat.steps(a, b)))
                group = merged
                stop += width
            if stop > i + width:
                out += group
                i = stop
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


@_deep
def _repeat(a: Node, b: Node) -> Node:
    out = yield merge.steps(a, b)
    out.plus, out.optional = True, a.optional and b.optional
    return out


def folded(root: Node) -> Node:
    """The structure of a page: its labels, with neighbours that repeat as groups."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.children
    shapes: dict[tuple, int] = {}  # equal structures have one number
    done: dict[int, tuple[Node, int]] = {}
    for node in reversed(order):
        children: list[Node] = []
        numbers: list[int] = []
        for child in node.children:
            out, number = done.pop(id(child))
            if numbers and numbers[-1] == number:  # as a merge of equal ones would have it
                children[-1].plus = True
                continue
            children.append(out)
            numbers.append(number)
        labels = [c.label for c in children]
        if any(a in labels[i + 1 : i + 4] for i, a in enumerate(labels)):
            children, shape = fold(children), (node.label, id(node))  # of its own
        else:
            shape = (node.label, *((n, c.plus) for n, c in zip(numbers, children, strict=True)))
        done[id(node)] = Node(node.label, children), shapes.setdefault(shape, len(shapes))
    return done[id(root)][0]


def skeleton(root: Node) -> str:
    """A structure as JSON without nesting: its nodes in order, each with the number of its children."""
    flat, stack = [], [root]
    while stack:
        node = stack.pop()
        flat.append([node.label, int(node.plus), int(node.optional), len(node.children)])
        stack += reversed(node.children)
    return json.dumps(flat, separators=(",", ":"))


def structure(data: str) -> Node:
    """The structure of a :func:`skeleton`."""
    done: list[Node] = []
    for label, plus, optional, n in reversed(json.loads(data)):
        children = [done.pop() for _ in range(n)]
        done.append(Node(label, children, plus=bool(plus), optional=bool(optional)))
    return done[0]


def places(root: Node) -> list:
    """A structure for :func:`walk`: label, repeated, template's text, mean text, place's number, children."""
    done, order, stack = {}, [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += reversed(node.children)
    for number in range(len(order) - 1, -1, -1):
        node = order[number]
        done[id(node)] = [node.label, int(node.plus), None, 0, number, [done.pop(id(c)) for c in node.children]]
    return done[id(root)]


def dumps(wrapper: list) -> str:
    """A wrapper as JSON without nesting."""
    flat, stack = [], [wrapper]
    while stack:
        *own, children = stack.pop()
        flat.append([*own, len(children)])
        stack += reversed(children)
    return json.dumps(flat, separators=(",", ":"))


def loads(data: str) -> list:
    done: list[list] = []
    for *own, n in reversed(json.loads(data)):
        children = [done.pop() for _ in range(n)]
        done.append([*own, children])
    return done[0]


def walk(root: Node, wrapper: list) -> None:
    """Lay a page along its wrapper: every node gets its ``part``, if it has one."""
    root.part = wrapper
    stack = [root]
    while stack:
        node = stack.pop()
        parts = node.part[5]
        if not parts or not node.children:
            continue
        where: dict[str, list[int]] = {}
        for k, part in enumerate(parts):
            where.setdefault(part[0], []).append(k)
        at = start = stop = 0  # the repeated parts from start to stop may come again
        for child in node.children:
            there = where.get(child.label)
            if there is None:
                continue
            i = bisect_left(there, at)
            if start < stop and (i == len(there) or there[i] >= stop):
                again = bisect_left(there, start)
                i = again if again < len(there) and there[again] < stop else i
            if i == len(there):
                continue  # not in the wrapper
            k = there[i]
            child.part = parts[k]
            if not parts[k][1]:
                at, start, stop = k + 1, 0, 0
            else:
                if not start <= k < stop:
                    start, stop = k, k + 1
                    while start and parts[start - 1][1]:
                        start -= 1
                    while stop < len(parts) and parts[stop][1]:
                        stop += 1
                at = k
            if child.children:
                stack.append(child)


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def filled(root: Node) -> dict[int, tuple[int, int]]:
    """What a page has in its wrapper's places: the hash of the texts there, and their length outside links and what is never main text."""
    texts: dict[int, list[str]] = {}
    lengths: dict[int, int] = {}
    stack = [(c, False) for c in reversed(root.children)]
    while stack:
        node, barred = stack.pop()
        if node.label != "#":
            barred = barred or node.barred
            stack += [(c, barred) for c in reversed(node.children)]
        elif node.part is not None:
            number = node.part[4]
            texts.setdefault(number, []).append(node.text)
            lengths[number] = lengths.get(number, 0) + (0 if barred else len(node.text) - node.linked)
    return {k: (text_hash("\n".join(t)), lengths[k]) for k, t in texts.items()}


def decided(wrapper: list, pages: int, found: dict[int, tuple[int, int, int, int]]) -> list:
    """The wrapper with the template's texts (as hashes) and the mean lengths of what slots hold.

    ``found`` has for each place the pages with it, the length of their texts, and the
    most common text's pages and hash. With too few pages nothing is known.
    """
    order, stack = [], [(wrapper, False, None)]
    while stack:
        part, repeated, above = stack.pop()
        repeated = repeated or bool(part[1])
        order.append((part, repeated, above))
        stack += [(c, repeated, part) for c in part[5]]
    mass: dict[int, int] = {}
    seen: dict[int, int] = {}
    for part, repeated, above in reversed(order):
        number = part[4]
        if number in found:
            total, length, most, top = found[number]
            constant = most >= TEMPLATE_PAGES and 100 * most >= TEMPLATE_PERCENT * total
            part[2] = top if constant and not repeated and pages >= TEMPLATE_PAGES else None
            mass[number], seen[number] = 0 if constant else length, total
        on = seen.get(number, 0)
        part[3] = round(mass.get(number, 0) / on, 1) if on and pages >= TEMPLATE_PAGES else 0
        if above is not None:
            mass[above[4]] = mass.get(above[4], 0) + mass.get(number, 0)
            seen[above[4]] = max(seen.get(above[4], 0), on)
    return wrapper


def own_texts(root: Node) -> int:
    """A hash of all that can be main text; pages that agree in it count once."""
    texts, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.text is not None:
            texts.append(node.text)
        elif not node.barred:
            stack += node.children
    return text_hash("\n".join(texts))


@dataclass
class Inferred:
    """The structure of some pages, their wrapper, and by place the texts that all pages share."""

    root: Node
    wrapper: list
    shared: dict[int, str]


def infer(pages: list[str]) -> Inferred:
    """What :func:`wrappers` does, for a few pages of one host."""
    trees: dict[int, Node] = {}
    for page in pages:
        tree = parse(page)
        trees.setdefault(own_texts(tree), tree)
    root = None
    for tree in trees.values():
        root = folded(tree) if root is None else merge(root, folded(tree))
    wrapper = places(root)
    each: dict[int, list[tuple[int, int]]] = {}
    texts: dict[int, set[str]] = {}
    for tree in trees.values():
        walk(tree, wrapper)
        for number, one in filled(tree).items():
            each.setdefault(number, []).append(one)
        stack = [tree]
        while stack:
            node = stack.pop()
            stack += node.children
            if node.label == "#" and node.part is not None:
                texts.setdefault(node.part[4], set()).add(node.text)
    found = {}
    for number, some in each.items():
        most, top = max((n, h) for h, n in Counter(h for h, _ in some).items())
        found[number] = len(some), sum(n for _, n in some), most, top
    return Inferred(root, decided(wrapper, len(trees), found), {k: min(t) for k, t in texts.items() if len(t) == 1})


def pack(inferred: Inferred) -> list:
    return inferred.wrapper


def expression(inferred: Inferred) -> str:
    """The wrapper as a union-free regular expression over tags and texts."""
    return _expression(inferred.root, inferred.wrapper, inferred.shared)


@_deep
def _expression(node: Node, part: list, texts: dict[int, str]) -> str:
    if node.label == "#":
        out = json.dumps(texts[part[4]], ensure_ascii=False) if part[4] in texts else "#" if part[2] is None else f"#{part[2] & (1 << 64) - 1:016x}"
    else:
        parts = []
        for c, p in zip(node.children, part[5], strict=True):
            parts.append((yield _expression.steps(c, p, texts)))
        inner = " ".join(parts)
        out = inner if node.label == "#root" else f"<{node.label}> {inner} </>" if inner else f"<{node.label}/>"
    return f"({out}){'+' if node.plus else ''}{'?' if node.optional else ''}" if node.plus or node.optional else out


def _sum_up(root: Node) -> bool:
    """Set whether parts hold a heading, and their lengths; whether there is an article."""
    nodes, article = [root], False
    for node in nodes:
        nodes += node.children
        article = article or node.article and not node.drop
    for node in reversed(nodes):
        node.heading = any(c.heading or c.article or c.label.partition(".")[0] == "h1" for c in node.children)
        node.total = len(node.text or "") + sum(c.total for c in node.children)
        node.links = node.linked + sum(c.links for c in node.children)
    return article


def _menu(node: Node) -> bool:
    """Whether a part with children is links, headings aside."""
    if node.label.partition(".")[0] in HEADINGS or not node.children:
        return False
    return node.links >= LINK_SHARE * node.total


def _core(root: Node) -> list[Node]:
    """The way from the root to the part that holds most of the text in slots."""
    way = [root]
    while True:
        weights: dict[int, float] = {}
        best = None
        for child in way[-1].children:
            if child.part is None:
                weights[-id(child)] = 0.0 if child.barred else float(child.total - child.links)
                continue
            weights[child.part[4]] = child.part[3]
            name = child.label.partition(".")[0]
            if name in HOLDERS and not child.barred and not child.part[1] and (best is None or child.part[3] > best.part[3]):
                best = child
        if best is None or not best.part[3] or best.part[3] < CORE_SHARE * sum(weights.values()):
            return way
        way.append(best)


def _has_title(node: Node) -> bool:
    stack = [node]
    while stack:
        node = stack.pop()
        if node.label.partition(".")[0] == "h1":
            return True
        stack += node.children
    return False


def extract(page: str, wrapper: list | None = None) -> str:
    """The main text of a page."""
    return _text(parse(page), wrapper)


def _text(root: Node, wrapper: list | None = None) -> str:
    article, blocks = _sum_up(root), []
    if wrapper is None or not wrapper[3]:
        _collect(root, article, False, None, blocks)
        return "\n".join(blocks)
    walk(root, wrapper)
    way = _core(root)
    within = next((k for k in range(len(way) - 1, 0, -1) if way[k].article), None)
    if within is not None:
        _collect(way[within], False, True, None, blocks)
    elif _holds_article(way[-1]):
        _collect(way[-1], True, False, None, blocks)
    else:
        k = len(way) - 1
        while k and not _has_title(way[k]):
            k -= 1
        start = way[k] if _has_title(way[k]) else way[-1]
        _collect(start, False, start is way[-1] and len(way) > 1, way[-1], blocks, frozenset(map(id, way)))
    return "\n".join(blocks)


def _holds_article(node: Node) -> bool:
    stack = list(node.children)
    while stack:
        node = stack.pop()
        if node.article and not node.drop:
            return True
        stack += node.children
    return False


def _collect(root: Node, article: bool, inside: bool, core: Node | None, out: list[str], way: frozenset[int] = frozenset()) -> None:
    """Texts of the articles below, if these are what counts, else all; ``inside`` an article or the core only clear boilerplate goes."""
    stack = [(iter(root.children), inside, root.label.partition(".")[0] in HEADINGS)]
    while stack:
        children, inside, heading = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            continue
        if child.label == "#":
            template = child.part is not None and child.part[2] is not None and child.part[2] == text_hash(child.text)
            if (inside or not article) and not (template and not (inside and heading)):
                out.append(child.text)
            continue
        name = child.label.partition(".")[0]
        if id(child) not in way:
            if child.drop and not (inside and child.unclear and not _menu(child)) and not (name not in DROP_TAGS and child.heading):
                continue
            if name == "header" and not inside and not (core is not None and child.heading):
                continue
            if not inside and not article and name in ("ul", "ol") and child.children and _menu(child):
                continue
        stack.append((iter(child.children), inside or article and child.article or child is core, heading or name in HEADINGS))


RESULT = "page_id long, url string, text string, n_chars long"


def _batches(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names.split())


def structures(pages: DataFrame) -> DataFrame:
    """``host, skeleton`` of ``host, html``: the structures of all pages of a host, aligned one after the other."""

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        for batch in batches:
            rows = {(h, skeleton(folded(parse(x)))) for h, x in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)}
            rows -= seen  # copies within a task need to travel once
            seen = seen | rows if len(seen) < 10_000 else rows
            yield _batches("host skeleton", pa.array([h for h, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string()))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, root = None, None
        for batch in batches:
            for host, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("host", "bucket", "skeleton")), strict=True):
                if (host, bucket) != now:
                    if now is not None:
                        yield _batches("host key skeleton", pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([skeleton(root)]))
                    now, root = (host, bucket), structure(data)
                else:
                    root = merge(root, structure(data))
        if now is not None:
            yield _batches("host key skeleton", pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([skeleton(root)]))

    rows = pages.select("host", "html").mapInArrow(lean(skeletons), "host string, skeleton string").distinct()
    rows = materialize(rows.select("host", F.xxhash64("skeleton").alias("key"), "skeleton"), "skeletons")
    most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    level = 0
    while FAN ** (level + 1) < most:
        level += 1
    for step in range(level, -1, -1):
        dealt = rows.select("host", F.pmod("key", F.lit(FAN**step)).alias("bucket"), "key", "skeleton")
        rows = dealt.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "key", "skeleton").mapInArrow(lean(merged), "host string, key long, skeleton string")
    return rows.select("host", "skeleton")


def _with(pages: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Join ``host`` and ``name`` of ``known`` to the pages."""
    size = known.agg(F.sum(F.octet_length("host") + F.octet_length(name))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(known), "host", "left")
    known = known.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    share = F.pmod(F.xxhash64("page_id", "url"), F.lit(SHARES)).cast("int")
    return pages.withColumn("share", share).join(known, ["host", "share"], "left").drop("share")


_PLACES = "host string, main long, places array<struct<number: int, hash: long, length: long>>"


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper, expression`` for the hosts of ``host, page_id, url, html``."""
    ship(pages.sparkSession)
    known = materialize(structures(pages), "structures")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            main, rows, ends = [], [], [0]
            for html, data in zip(batch.column("html").to_pylist(), batch.column("skeleton").to_pylist(), strict=True):
                root = parse(html)
                main.append(own_texts(root))
                walk(root, _shaped(data))
                rows.append((-1, 0, 0))  # the page itself
                rows += sorted((number, *one) for number, one in filled(root).items())
                ends.append(len(rows))
            number, hashes, length = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int32(), pa.int64(), pa.int64()), strict=True))
            each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([number, hashes, length], names=["number", "hash", "length"]))
            yield _batches("host main places", batch.column("host"), pa.array(main, pa.int64()), each)

    some = _with(pages, known, "skeleton").select("host", "html", "skeleton").mapInArrow(lean(fill), _PLACES)
    once = some.groupBy("host", "main").agg(F.min("places").alias("places"))
    each = once.select("host", F.explode("places").alias("p")).groupBy("host", "p.number", "p.hash").agg(F.count(F.lit(1)).alias("n"), F.sum("p.length").alias("length"))
    each = each.groupBy("host", "number").agg(F.sum("n").alias("total"), F.sum("length").alias("length"), F.max(F.struct("n", "hash")).alias("top"))
    found = each.groupBy("host").agg(F.collect_list(F.struct("number", "total", "length", "top.n", "top.hash")).alias("found"))  # one for each place of the wrapper

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, said = [], []
            for data, found in zip(batch.column("skeleton").to_pylist(), batch.column("found").to_pylist(), strict=True):
                root = structure(data)
                counts = {r["number"]: (r["total"], r["length"], r["n"], r["hash"]) for r in found}
                wrapper = decided(places(root), counts.pop(-1)[0], counts)
                done.append(dumps(wrapper))
                said.append(_expression(root, wrapper, {}))
            yield _batches("host wrapper expression", batch.column("host"), pa.array(done, pa.string()), pa.array(said, pa.string()))

    return known.join(found, "host").mapInArrow(lean(decide), "host string, wrapper string, expression string")


@lru_cache(maxsize=1024)
def _loaded(wrapper: str) -> list:
    return loads(wrapper)


@lru_cache(maxsize=1024)
def _shaped(data: str) -> list:
    return places(structure(data))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``page_id, url, html``."""
    ship(pages.sparkSession)
    host, _ = host_and_path(F.col("url"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(host, F.lit("")).alias("host"))
    known = materialize(wrappers(pages).select("host", "wrapper"), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h, None if w is None else _loaded(w)) for h, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True)]
            yield _batches("page_id url text n_chars", batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64()))

    return _with(pages, known, "wrapper").select("page_id", "url", "html", "wrapper").mapInArrow(lean(run), RESULT)
