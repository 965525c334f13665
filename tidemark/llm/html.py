"""Main text of web pages by wrappers inferred from all pages of the same host.

A page is read as a tree of elements and blocks of text; neighbours of equal shape form a run. A wrapper is such
a tree for many pages, a union-free expression: a block whose text is the same everywhere is a constant, another
one a slot; a run whose length differs is a repeated group; what some pages lack is an optional group. Wrappers
of equal shape are merged place by place (in any order, with the same result); those of different shapes are
aligned one after the other, in order of their shapes' hashes, and what does not align becomes optional.

The wrapper decides what the main text is. Each page is aligned with its host's wrapper, from the root down: the
child whose slots hold at least ``SHARE`` of the slots' text is entered, until none does. Constants and links
count for nothing there. On a host of fewer than ``SOME`` differing pages, where the wrapper has little to go by,
what the markup declares (an article, a menu, an advert) weighs a child's text up or down, and a declared article is
entered no further; elsewhere the slots alone decide. From the part that is found, forms, menus, comments and the like are left out, and what class names mark is left out only if the
wrapper has little text there; so are texts that all of ``CERTAIN`` or more differing pages repeat,
unless they stand in a declared article.

All pages take part in the wrappers. Each task merges its own pages; the partial wrappers of a host are merged
in buckets of some 64 shapes, level by level, so no task gets a large host whole. A tree wider than ``WIDEST``
runs is matched by names without order, and one deeper than ``DEEPEST`` is read as flat from there: wrappers get
coarser by that, and the pages' text stays whole. Wrappers are broadcast only up to ``broadcast_bytes``, counted
first; beyond that, pages join them by host, and adaptive execution splits a host with a large share of all pages.

Edge cases: null HTML and pages without text give an empty text; a null or hostless URL falls under an empty
host; unclosed elements, tags cut off by the end of the page and unknown references are tolerated; a host with
one distinct page has slots only; repeated rows give a row each, and add nothing that turns a slot into a
constant; if nothing of the part found is left, the page's text without menus and the like is given.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slim, small_batches
from tidemark.llm.urlfilter import host_and_path
from tidemark.session import discard, materialize

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never text of the page.
RAW = frozenset("script style template noscript svg math iframe object canvas audio video head title".split())
#: Elements that are not part of an article.
ASIDE = frozenset("nav footer aside form button select textarea input dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id names that mark what is not part of an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist commentform replies reply respond "
    "disqus consent cookie cookies gdpr notice notices notification alert footer sidebar menu nav navbar navigation newsletter popup modal overlay promo promotion "
    "related recommended share sharing social sponsor sponsored subscribe subscription signup login search pagination pager toolbar topbar widget widgets masthead skip".split()
)
#: Marks that count only outside an article, where they mean the page's own header.
OUTER = frozenset("header".split())
#: Marks of reader comments, which no share of the text makes part of an article.
COMMENTS = frozenset("comment comments commentlist commentform respond disqus".split())
#: Class and id names of a declared article, without an element of its own.
ARTICLE = frozenset("article articlebody article-body article-content post-body post-content entry-content main-content maincontent main-text content story-body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in page order; kind is open, close or text. Raw elements are skipped whole."""
    at = 0
    while at < len(page):
        found = TOKEN.search(page, at)
        if not found:
            yield "text", page[at:], ""
            return
        if found.start() > at:
            yield "text", page[at : found.start()], ""
        at = found.end()
        name = found["name"] or found["name2"]
        if found["data"]:
            yield "text", found["data"], ""
        if not name:
            continue
        name = name.lower()
        closing = found["close"] or found["close2"]
        if name in RAW:
            if not closing and not (found["attrs"] or "").rstrip().endswith("/"):
                end = RAW_END[name].search(page, at)
                body = re.compile(r"<body\b", re.I).search(page, at) if name == "head" else None
                at = min([x for x in (end and end.end(), body and body.start()) if x] or [len(page) if name != "head" else at])
            continue
        yield ("close" if closing else "open"), name, found["attrs"] or found["attrs2"] or ""


def marks(name: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is no part of an article; whether it declares one."""
    if name in ASIDE or (name == "header" and not inside):
        return True, False
    if name in ("html", "body"):
        return False, False
    declared = name in ("article", "main")
    if not attrs or "=" not in attrs:
        return False, declared
    for key, *values in ATTRIBUTE.findall(attrs):
        value = html.unescape("".join(values))
        if key.lower() == "role":
            if value.lower() in ROLES:
                return True, False
            declared |= value.lower() in ("main", "article")
            continue
        if key.lower() == "itemprop":
            declared |= value == "articleBody"
            continue
        for word in value.split():
            parts = {x.lower() for x in NAME_PART.findall(word)} | {word.lower()}
            if name != "main" and (parts & MARKS or (not inside and parts & OUTER)) and not (name == "article" and "article" in parts):
                return True, False
            declared |= word.lower() in ARTICLE and name in ("div", "section", "td")
    return False, declared

#: Elements that only name the block of text in them.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre dt figcaption caption summary legend option th address".split())
#: Elements that an open one of the same group ends.
PEERS = {"li": {"li"}, "dd": {"dd"}, "tr": {"tr", "td"}, "td": {"td"}, "tbody": {"tbody", "tr", "td"}}
SHARE, UP, DOWN = 0.6, 30.0, 0.03
WIDEST, DEEPEST, SEEN, CERTAIN, SOME = 64, 40, 8, 8, 3


class Leaf:
    """A block of text, in one page or in many: ``mark`` is the hash of its text, or None where texts differ (a slot)."""

    __slots__ = ("label", "n", "chars", "links", "mark", "text", "aside", "declared")

    def __init__(self, label: str, n: int, chars: int, links: int, mark: int | None, text: str = "", aside: int = 0) -> None:
        self.label, self.n, self.chars, self.links, self.mark, self.text, self.aside, self.declared = label, n, chars, links, mark, text, aside, 0


class Node:
    """An element with its runs of children. ``seen`` has the smallest hashes of its contents, so it tells few from many."""

    __slots__ = ("label", "n", "seen", "runs", "mixed", "aside", "declared", "content", "pairs")

    def __init__(self, label: str, n: int, seen: list[int], runs: list[Run], mixed: bool = False, aside: int = 0, declared: int = 0) -> None:
        self.label, self.n, self.seen, self.runs, self.mixed, self.aside, self.declared = label, n, seen, runs, mixed, aside, declared
        self.content, self.pairs = 0.0, {}


class Run:
    """Neighbours of one name: as many as there are items, or any number of the only item (``repeated``)."""

    __slots__ = ("items", "repeated")

    def __init__(self, items: list, repeated: bool = False) -> None:
        self.items, self.repeated = items, repeated

    @property
    def label(self) -> str:
        return self.items[0].label


# Pages as trees


def label_of(name: str, attrs: str) -> str:
    """Element name, role and class words without digits: what pages of one layout have in common."""
    words = [name]
    if "=" in attrs:
        for key, *values in ATTRIBUTE.findall(attrs):
            if key.lower() in ("class", "role"):
                words += sorted(w for w in "".join(values).split() if w.isascii() and not any(c.isdigit() for c in w))
    return ".".join(words)[:120]


def grown(page: str) -> Node:
    """The tree of a page. Texts stay in its leaves; inline elements add nothing but their text."""
    root: list = ["page", [], 0, 0]  # label, children, aside, declared
    stack: list[tuple[str, list]] = [("page", root)]
    held: list[str] = []
    leaf: tuple[str, str, int] | None = None  # element, label and mark of the leaf that is open
    linked, in_link, inside = 0, 0, 0

    def end() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                label, aside = (leaf[1], leaf[2]) if leaf else (stack[-1][0], 0)
                stack[-1][1][1].append(Leaf("=" + label, 1, len(text), min(linked, len(text)), xxhash.xxh64_intdigest(text) >> 1, text, aside))
        linked = 0

    def close(count: int) -> None:
        nonlocal inside
        for _ in range(count):
            name, found = stack.pop()
            inside -= found[3]
            stack[-1][1][1].append(finished(found))

    for kind, name, attrs in tokens(page):
        if kind == "text":
            held.append(name)
            if in_link:
                linked += len(name.strip())
            continue
        if name == "a":
            in_link = int(kind == "open")
        if name == "br":
            held.append(" ")
        if name not in BLOCKS and name not in ASIDE:
            continue
        end()
        if name in LEAVES:
            leaf = None
            if kind == "open":
                aside, declared = marked(name, attrs, inside)
                leaf = (name, label_of(name, attrs), aside)
            continue
        leaf = None
        if kind == "close":
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if at:
                close(len(stack) - at)
            continue
        if name in VOID or name in ("html", "body") or (len(stack) > DEEPEST and name not in ASIDE):
            continue
        peers = PEERS.get(name)
        if peers:
            while stack[-1][0] in peers:
                close(1)
        if len(stack) > 4 * DEEPEST:
            continue
        aside, declared = marked(name, attrs, inside)
        inside += declared
        stack.append((name, [label_of(name, attrs), [], aside, declared]))
    end()
    close(len(stack) - 1)
    return finished(root)


def marked(name: str, attrs: str, inside: int) -> tuple[int, int]:
    """What markup declares: 2 for what is no part of an article, 1 for what a class name says so of, else 0; and 1 for an article."""
    aside, declared = marks(name, attrs, bool(inside))
    if not aside:
        return 0, int(declared)
    words = {x.lower() for key, *values in ATTRIBUTE.findall(attrs) for x in NAME_PART.findall("".join(values))} if "=" in attrs else set()
    sure = name in ASIDE or name == "header" or words & COMMENTS or any(k.lower() == "role" and "".join(v).lower() in ROLES for k, *v in ATTRIBUTE.findall(attrs))
    return (2 if sure else 1), 0


def finished(found: list) -> Node:
    """A node of a page from its children: runs of equal shape."""
    label, children, aside, declared = found
    runs: list[Run] = []
    last, content = None, xxhash.xxh64()
    for child in children:
        shape = shape_of(child)
        content.update((child.mark if isinstance(child, Leaf) else child.seen[0]).to_bytes(8, "little"))
        if shape == last:
            runs[-1].items.append(child)
        else:
            runs.append(Run([child]))
        last = shape
        declared |= 2 * bool(child.declared and not child.aside)
    node = Node(label, 1, [content.intdigest() >> 1], runs, len(runs) > WIDEST, aside, declared)
    if node.mixed:
        node.runs = by_name([Run([x]) for x in children])
    return node


def by_name(runs: list[Run]) -> list[Run]:
    """A run for each name, sorted, of the items of all runs of that name."""
    found: dict[str, list] = {}
    for run in runs:
        found.setdefault(run.label, []).extend(run.items)
    return [Run(found[name]) for name in sorted(found)]


def shape_of(item: Leaf | Node) -> str:
    """The shape of a page's item: names of its runs, however long they are."""
    if isinstance(item, Leaf):
        return item.label
    if item.mixed:
        return f"{item.label}{{{' '.join(r.label for r in item.runs)}}}"
    return f"{item.label}({' '.join([shape_of(r.items[0]) for r in item.runs])})"


# Wrappers


def of_page(item: Leaf | Node) -> Leaf | Node:
    """A page's tree as a wrapper: without texts, and without what is in the elements of a tree that is too wide."""
    if isinstance(item, Leaf):
        return Leaf(item.label, 1, item.chars, item.links, item.mark)
    if item.mixed:
        runs = []
        for run in item.runs:
            flat = [x if isinstance(x, Leaf) else Leaf(x.label, 1, *totals(x), None) for x in run.items]
            runs.append(Run([Leaf(run.label, len(flat), sum(x.chars for x in flat), sum(x.links for x in flat), flat[0].mark if len({x.mark for x in flat}) == 1 else None)], True))
        return Node(item.label, 1, item.seen, runs, True)
    return Node(item.label, 1, item.seen, [Run([of_page(x) for x in run.items]) for run in item.runs])


def totals(item: Leaf | Node) -> tuple[int, int]:
    """Characters and linked characters of a page's item."""
    if isinstance(item, Leaf):
        return item.chars, item.links
    parts = [totals(x) for run in item.runs for x in run.items]
    return sum(c for c, _ in parts), sum(k for _, k in parts)


def merged(a: Leaf | Node, b: Leaf | Node) -> Leaf | Node:
    """The wrapper of both: texts that differ become slots, runs whose lengths differ repeat, other mismatches are optional."""
    if isinstance(a, Leaf) or isinstance(b, Leaf):
        if not (isinstance(a, Leaf) and isinstance(b, Leaf)):
            a, b = (x if isinstance(x, Leaf) else Leaf(x.label, x.n, *totals(x), None) for x in (a, b))
        return Leaf(a.label, a.n + b.n, a.chars + b.chars, a.links + b.links, a.mark if a.mark == b.mark else None)
    runs = merged_runs(a, b)
    wide = a.mixed or b.mixed or len(runs) > WIDEST
    if wide and not (a.mixed and b.mixed):
        runs = [collapsed(r) for r in by_name(runs)]
    return Node(a.label, a.n + b.n, sorted({*a.seen, *b.seen})[:SEEN], runs, wide)


def collapsed(run: Run) -> Run:
    item = run.items[0]
    for x in run.items[1:]:
        item = merged(item, x)
    return Run([item], True)


def joined(a: Run, b: Run) -> Run:
    if not a.repeated and not b.repeated and len(a.items) == len(b.items):
        return Run([merged(x, y) for x, y in zip(a.items, b.items, strict=True)])
    return collapsed(Run(a.items + b.items))


def merged_runs(a: Node, b: Node) -> list[Run]:
    if a.mixed or b.mixed:
        found = {r.label: collapsed(r) for r in by_name(a.runs)}
        for run in by_name(b.runs):
            found[run.label] = collapsed(Run(found[run.label].items + run.items)) if run.label in found else collapsed(run)
        return [found[name] for name in sorted(found)]
    left, right = [r.label for r in a.runs], [r.label for r in b.runs]
    if left == right:
        return [joined(x, y) for x, y in zip(a.runs, b.runs, strict=True)]
    out: list[Run] = []
    for how, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        more = [joined(x, y) for x, y in zip(a.runs[i:j], b.runs[k:m], strict=True)] if how == "equal" else a.runs[i:j] + b.runs[k:m]
        for run in more:
            if out and out[-1].label == run.label:
                out[-1] = collapsed(Run(out[-1].items + run.items))
            else:
                out.append(run)
    return out


def packed(item: Leaf | Node) -> list:
    if isinstance(item, Leaf):
        return [item.label, item.n, item.chars, item.links, item.mark]
    return [item.label, item.n, item.seen, item.mixed, [[int(r.repeated), *map(packed, r.items)] for r in item.runs]]


def unpacked(row: list) -> Leaf | Node:
    if not isinstance(row[2], list):
        return Leaf(*row)
    return Node(row[0], row[1], row[2], [Run([unpacked(x) for x in r[1:]], bool(r[0])) for r in row[4]], row[3])


def expression(item: Leaf | Node) -> str:
    """A wrapper written out: ``#`` is a slot, ``=`` a constant, ``( )+`` repeats, ``( )?`` may be missing."""
    if isinstance(item, Leaf):
        return f"{item.label[1:]}{'#' if item.mark is None else '='}"
    out = []
    for run in item.runs:
        for x in run.items:
            text = expression(x)
            out.append(f"( {text} )+" if run.repeated else f"( {text} )?" if x.n < item.n else text)
    return f"<{item.label}> {' '.join(out)} </{item.label}>"


def weighed(item: Leaf | Node, sure: bool) -> float:
    """Slot text of an item (kept with nodes): neither links nor, if enough pages were ``sure`` to differ, constants."""
    if isinstance(item, Leaf):
        return 0.0 if sure and item.mark is not None else float(max(0, item.chars - 2 * item.links))
    item.content = sum((weighed(x, sure) for r in item.runs for x in r.items), 0.0)
    return item.content


def ready(wrapper: Node) -> Node:
    weighed(wrapper, len(wrapper.seen) >= SOME)
    return wrapper


# Pages by wrappers


def matched(node: Node, wrapper: Node | None) -> list[tuple[Leaf | Node, Leaf | Node | None, bool]]:
    """Each child of a page's node in page order, the wrapper's item that it aligns with, and whether that repeats."""
    items = [(i, run) for i, run in enumerate(node.runs)]
    if not isinstance(wrapper, Node):
        return [(x, None, False) for _, run in items for x in run.items]
    if wrapper.mixed or node.mixed:
        named = {r.label: r for r in wrapper.runs}
        return [(x, named[run.label].items[0] if run.label in named else None, True) for _, run in items for x in run.items]
    labels = tuple(r.label for r in node.runs)
    places = wrapper.pairs.get(labels)
    if places is None:
        places = {}
        theirs = [r.label for r in wrapper.runs]
        for i, k, size in SequenceMatcher(None, labels, theirs, autojunk=False).get_matching_blocks():
            places |= {i + s: k + s for s in range(size)}
        for i, name in enumerate(labels):  # neighbours of one name may have become one group
            if i and i not in places and i - 1 in places and labels[i - 1] == name:
                places[i] = places[i - 1]
        if len(wrapper.pairs) > 1000:
            wrapper.pairs.clear()
        wrapper.pairs[labels] = places
    out = []
    for i, run in items:
        found = wrapper.runs[places[i]] if i in places else None
        fixed = found is not None and not found.repeated and len(found.items) == len(run.items)
        out += [(x, None if found is None else found.items[s] if fixed else found.items[0], not fixed) for s, x in enumerate(run.items)]
    return out


def mean(item: Leaf | Node, other: Leaf | Node | None, sure: bool) -> float:
    """Slot text of an item for each time that the host's pages have it; without a wrapper, of the page itself."""
    if other is None:
        chars, links = totals(item)
        return float(max(0, chars - 2 * links))
    return (other.content if isinstance(other, Node) else weighed(other, sure)) / max(1, other.n)


def main_blocks(page: Node, wrapper: Node) -> list[str]:
    """The blocks of the part that the wrapper's slots point to."""
    node, other, before, article = page, wrapper, [], False
    sure = len(wrapper.seen) >= SOME
    while True:
        pairs = matched(node, other)
        article |= node.declared == 1
        if article and not sure:
            break
        weights = [mean(x, o, sure) * (1.0 if sure else UP if x.declared and (not x.aside or x.declared & 2) else DOWN if x.aside else 1.0) for x, o, _ in pairs]
        groups: dict[object, list[int]] = {}  # repeated elements are one candidate
        for i, (x, o, repeats) in enumerate(pairs):
            if isinstance(x, Node):
                groups.setdefault(id(o) if repeats and o is not None else (x.label, "declared") if x.declared & 1 and not sure else (id(x), i), []).append(i)
        if not groups:
            break
        best = max(groups.values(), key=lambda g: (sum(weights[i] for i in g), -g[0]))
        if sum(weights[i] for i in best) < SHARE * sum(weights) or not sum(weights):
            break
        before += [x.text for x, o, _ in pairs[: best[0]] if isinstance(x, Leaf) and x.label[:3] in ("=h1", "=h2") and not x.aside and not (sure and o is not None and o.mark is not None)]
        if len(best) > 1:
            return before + [text for i in best for text in kept(pairs[i][0], pairs[i][1], article)]
        node, other, _ = pairs[best[0]]
    return before + kept(node, other, article)


def kept(region: Node, wrapper: Node | None, article: bool = False) -> list[str]:
    """Blocks of a part: without what markup declares to be something else, and, outside a declared article, without constants that are certain."""
    out: list[str] = []
    whole = mean(region, wrapper, False) if wrapper is None else wrapper.content / max(1, wrapper.n)
    certain = isinstance(wrapper, Node) and len(wrapper.seen) >= CERTAIN

    def visit(node: Node, other: Node | None, article: bool) -> None:
        article = article or node.declared == 1
        for x, o, repeats in matched(node, other):
            if x.aside == 2 or (x.aside == 1 and mean(x, o, False) < 0.5 * SHARE * whole):
                continue
            if isinstance(x, Node):
                visit(x, o if isinstance(o, Node) else None, article)
            elif article or not (certain and isinstance(o, Leaf) and o.mark is not None and not repeats and o.n >= wrapper.n):
                out.append(x.text)

    visit(region, wrapper, article)
    return out


def main_text(page: str | None, wrapper: Node | None = None) -> str:
    """The main text of a page by its host's wrapper; without one, the page itself is the wrapper."""
    if not page:
        return ""
    tree = grown(page)
    wrapper = wrapper or ready(of_page(tree))
    return "\n\n".join(main_blocks(tree, wrapper) or kept(tree, None))


# Tables


def page_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, shape, wrapper: the pages of a task, merged where host and shape are equal."""
    held: dict[tuple[str, int], Node] = {}
    size = 0

    def flushed() -> pa.RecordBatch:
        rows = [(host, shape, json.dumps(packed(w), separators=(",", ":"))) for (host, shape), w in sorted(held.items(), key=lambda x: x[0])]
        held.clear()
        return rows_of(rows)

    for batch in small_batches(batches, "html"):
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not page:
                continue
            tree = grown(page)
            key = host, xxhash.xxh64_intdigest(shape_of(tree)) >> 1
            own = of_page(tree)
            if key in held:
                held[key] = merged(held[key], own)
            else:
                held[key] = own
                size += sum(len(r.items) for r in own.runs) + len(page) // 256
            if size > 50_000:
                yield flushed()
                size = 0
    yield flushed()


def rows_of(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["host", "shape", "wrapper"])


def merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host and bucket, of rows that arrive in order of host, bucket and shape."""
    key, shape, same, whole = None, None, None, None
    for batch in batches:
        out = []
        for host, bucket, number, text in zip(*(batch.column(c).to_pylist() for c in ("host", "bucket", "shape", "wrapper")), strict=True):
            found = unpacked(json.loads(text))
            if (host, bucket) == key and number == shape:
                same = merged(same, found)
                continue
            if same is not None:
                whole = merged(whole, same) if whole is not None else same
            if (host, bucket) != key:
                if whole is not None:
                    out.append((*key, json.dumps(packed(whole), separators=(",", ":"))))
                key, whole = (host, bucket), None
            shape, same = number, found
        if out:
            yield rows_of(out)
    if same is not None:
        yield rows_of([(*key, json.dumps(packed(merged(whole, same) if whole is not None else same), separators=(",", ":")))])


def host_wrappers(pages: DataFrame, bucket_shapes: int = 64) -> DataFrame:
    """host, wrapper: one for each host with a page, from columns host, html."""
    rows = materialize(pages.mapInArrow(page_wrappers, "host string, shape bigint, wrapper string"), "page-wrappers")
    while True:
        shapes = materialize(rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n")).groupBy("host").agg(F.count(F.lit(1)).alias("shapes"), F.sum("n").alias("n")), "shapes")
        if shapes.where("n > 1").isEmpty():
            discard(shapes)
            return rows.select("host", "wrapper")
        buckets = shapes.select("host", F.ceil(F.col("shapes") / bucket_shapes).alias("buckets"))
        dealt = rows.join(buckets, "host").select("host", F.pmod(F.xxhash64("shape"), "buckets").alias("bucket"), "shape", "wrapper")
        order = ["host", "bucket", "shape"]
        after = materialize(dealt.repartition("host", "bucket").sortWithinPartitions(*order).mapInArrow(merged_rows, "host string, shape bigint, wrapper string"), "wrappers")
        discard(rows)
        discard(shapes)
        rows = after


def extract_text(pages: DataFrame, broadcast_bytes: int = 32 << 20, page_id: str = "page_id", url: str = "url", page_html: str = "html") -> DataFrame:
    """page_id, url, text of every row."""
    source = slim(pages, page_id=page_id, url=url, html=page_html)
    host, _ = host_and_path(F.col("url"))
    hosted = source.select("page_id", "url", host.alias("host"), "html")
    wrappers = host_wrappers(hosted.select("host", "html"))
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    small = size <= broadcast_bytes
    known = pages.sparkSession.sparkContext.broadcast(dict(map(tuple, wrappers.select("host", "wrapper").collect()))) if small else None
    joined_rows = hosted if small else hosted.join(wrappers, "host", "left")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, Node] = {}
        for batch in small_batches(batches, "html"):
            found = []
            texts = [known.value.get(h) for h in batch.column("host").to_pylist()] if small else batch.column("wrapper").to_pylist()
            for name, text, page in zip(batch.column("host").to_pylist(), texts, batch.column("html").to_pylist(), strict=True):
                if text is not None and name not in parsed:
                    if len(parsed) > 500:
                        parsed.clear()
                    parsed[name] = ready(unpacked(json.loads(text)))
                found.append(main_text(page, parsed.get(name) if text is not None else None))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    return joined_rows.mapInArrow(extracted, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string")
