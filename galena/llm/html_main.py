"""Main text of web pages by wrapper induction: pages of a host are aligned as trees, what stays the same is template."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, slices
from .urlfilter import host_of

#: The slots of a host's wrapper come from as many of its different pages at most, taken by a hash, and from as many more of
#: each layout that LAYOUT_PERCENT of its different pages have; a host with one page has none, as nothing can be compared.
SAMPLE_PAGES, LAYOUT_PAGES, LAYOUT_PERCENT, LEAST_PAGES = 8, 4, 5, 2
#: A text at a path is template if at least this percentage of all different pages of the host hold it, or of those of its
#: pages that have one layout, LEAST_LAYOUT at least.
CONSTANT_PERCENT, LEAST_LAYOUT = 95, 5
#: Hashes of pages that a task remembers to read copies once.
SEEN_PAGES = 100_000
#: Wrappers up to as many bytes in all are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

#: Template may make up this part of a main element's text.
MOST_FIXED = 0.25
#: Deeper elements count as beside what they contain, as in browsers, which stop at some depth too.
MOST_DEPTH = 150
#: Beyond as many pairs of siblings, order and sign alone pair them.
MOST_PAIRS = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|svg|math|object|textarea|select|title|xmp|noembed|noframes"
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends the open elements of these kinds, down to the scope.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("html body table td th caption button object article section div main aside nav header footer li dd dt blockquote form".split())
#: Elements that hold no main text, and words of classes, ids and roles that mark such elements. Fixed values.
ASIDE = frozenset("nav header footer aside form head button label menu dialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar header masthead footer "
    "cookie cookies consent notice notices alert popup modal overlay comment comments disqus respond reply replies share sharing social newsletter subscribe signup related".split()
)
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre a b i em strong span code".split())
MAIN_WORDS = frozenset("article main content post entry story".split())
#: Parts of a class, id or role that make the rest of it a state of the element, as in no-sidebar or header-fixed.
STATE_WORDS = frozenset("no not non without has have with is hide show open opened closed fixed sticky left right top bottom hidden visible on off enabled disabled active collapsed expanded free layout".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_END = re.compile("[>\"']")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW.split("|")}
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element. kids holds elements and texts in order; mark the words of its class, id and role. aside says whether it
    holds no main text: 2 if its tag or a whole class, id or role says so, 1 if a part of one does."""

    __slots__ = ("aside", "constant", "kids", "mark", "tag")

    def __init__(self, tag: str, mark: str = "", aside: int = 0):
        self.tag, self.mark, self.kids, self.constant, self.aside = tag, mark, [], False, aside

    @property
    def sign(self) -> str:
        return f"{self.tag}.{self.mark}" if self.mark else self.tag

    def elements(self) -> list[Node]:
        return [k for k in self.kids if k.__class__ is Node]

    def text(self) -> str:
        """Its own text, with single spaces."""
        return _SPACE.sub(" ", entities.unescape(" ".join(k for k in self.kids if k.__class__ is str))).strip()


def aside_by(tag: str, tokens: list[list[str]]) -> int:
    """What the tag, and the classes, ids and roles as lists of their parts, say; see Node. Elements that hold a line of text
    are asides only if all their marks say so."""
    if tag in ASIDE:
        return 1 if tag == "form" else 2
    if tag in ("html", "body", "main"):
        return 0
    if tag in LINES:
        return 2 if tokens and all(not ASIDE_WORDS.isdisjoint(t) and STATE_WORDS.isdisjoint(t) for t in tokens) else 0
    if any(len(t) == 1 and t[0] in ASIDE_WORDS for t in tokens):
        return 2
    if any(len(t) == 1 and t[0] in MAIN_WORDS for t in tokens):
        return 0
    return int(any(not ASIDE_WORDS.isdisjoint(t) and STATE_WORDS.isdisjoint(t) for t in tokens))


def clear_asides(root: Node) -> None:
    """A form, or an element that is an aside by a part of a mark only, is none if it holds most of the page's text and is
    an article, or holds a main element, a first heading, an article that is no aside, or an element marked as main."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.elements() if k.aside < 2]
    if not any(n.aside for n in order):
        return
    held: dict[int, tuple[int, bool]] = {}
    for n in reversed(order):
        below = [held[id(k)] for k in n.elements() if id(k) in held]
        size = sum(len(k) for k in n.kids if k.__class__ is str) + sum(h[0] for h in below)
        held[id(n)] = size, n.tag in ("main", "h1") or not n.aside and (n.tag == "article" or not MAIN_WORDS.isdisjoint(n.mark.split())) or any(h[1] for h in below)
    for n in order:
        size, marked = held[id(n)]
        if n.aside and (marked or n.tag == "article") and 2 * size > held[id(root)][0]:
            n.aside = 0


def tag_end(source: str, at: int, missing: set[str]) -> int:
    """Where the > of a tag is, outside of quotes; -1 if it never ends. A quote that is not closed is a character like others.
    missing: the quotes that do not occur behind where they were last looked for, so that no text is searched twice."""
    while m := _TAG_END.search(source, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if m[0] not in missing:
            if (end := source.find(m[0], at)) < 0:
                missing.add(m[0])
            else:
                at = end + 1
    return -1


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """The markup as (kind, what, marks): a text, an opening or closing tag's name, or an element that leaves nothing ("raw").
    What a comment, a raw element or a tag that never ends swallows is left out, up to the end of the page. One pass."""
    at, begun, n = 0, 0, len(source)
    missing: set[str] = set()
    while (at := source.find("<", at)) >= 0:
        after = source[at + 1 : at + 2]
        closing = after == "/"
        m = _NAME.match(source, at + 1 + closing)
        if not m and after not in ("!", "?", "/"):
            at += 1
            continue
        if at > begun:
            yield "text", source[begun:at], ""
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            begun = at = n if end < 0 else end + 3
            continue
        end = tag_end(source, m.end(), missing) if m and not closing else source.find(">", at)
        if end < 0:
            return
        begun = at = end + 1
        if not m:
            continue
        tag = m[0].lower()
        if closing:
            yield "close", tag, ""
            continue
        marks = source[m.end() : end]
        if tag in _RAW_END:
            if not (tag in ("svg", "math") and marks.endswith("/")):
                over = _RAW_END[tag].search(source, at)
                begun = at = over.end() if over else n
            yield "raw", tag, ""
            continue
        yield "open", tag, marks
    if begun < n:
        yield "text", source[begun:], ""


def parse(source: str) -> Node:
    """The tree of a page. Scripts, styles, comments and the like leave nothing; unclosed elements end where HTML ends them."""
    root = Node("html")
    stack = [root]
    for kind, tag, marks in tokens(source):
        if kind == "text":
            stack[-1].kids.append(tag)
            continue
        if kind == "close":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if kind == "raw" or tag == "html":
            continue
        ends, scope = CLOSES.get(tag, (None, None))
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in scope:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
                    if tag != "tr":
                        break
        elif tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE:
                    break
            if tag == "body" and stack[-1].tag == "head":
                stack.pop()
        words = [_PARTS.findall(w) for x in _MARK.finditer(marks) for w in (x[1] or x[2] or x[3] or "").lower().split()] if marks else []
        node = Node(tag, " ".join(sorted({w for t in words for w in t})), aside_by(tag, words))
        stack[-1].kids.append(node)
        if tag not in VOID and not marks.endswith("/") and len(stack) < MOST_DEPTH:
            stack.append(node)
    clear_asides(root)
    return root


def runs(nodes: list[Node]) -> list[list[Node]]:
    """Neighbours that look alike are one slot that repeats."""
    out: list[list[Node]] = []
    for n in nodes:
        if out and out[-1][0].tag == n.tag and out[-1][0].mark == n.mark:
            out[-1].append(n)
        else:
            out.append([n])
    return out


class Slot:
    """A node of a wrapper: its sign and its slots."""

    __slots__ = ("sign", "slots")

    def __init__(self, sign: str, slots: list[Slot]):
        self.sign, self.slots = sign, slots

    def plain(self) -> list:
        return [self.sign, [s.plain() for s in self.slots]]

    @classmethod
    def of(cls, plain: list) -> Slot:
        return cls(plain[0], [cls.of(p) for p in plain[1]])


class Wrapper(NamedTuple):
    """slots: the aligned tree of a sample of a host's pages. constant: the hashes of paths and texts that are template,
    counted over all pages of the host."""

    slots: Slot
    constant: frozenset[int]


def slot_of(run: list[Node]) -> Slot:
    return Slot(run[0].sign, [slot_of(r) for r in runs(run[0].elements())])


def step(path: bytes, node: Node) -> bytes:
    """The path of signs that leads to a node, as a hash."""
    return hashlib.blake2b(path + node.sign.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def held_at(path: bytes, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(path + text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def layout_of(root: Node) -> int:
    """A hash of what stands side by side in the body, without asides and without order."""
    body = next((k for k in root.elements() if k.tag == "body"), root)
    return held_at(b"", "|".join(sorted({k.sign for k in body.elements() if not is_aside(k)})))


def holds(source: str) -> tuple[int, set[int]]:
    """The layout of a page, and the hashes of all its paths and texts, without asides."""
    root = parse(source)
    out: set[int] = set()
    stack = [(root, step(b"", root))]
    while stack:
        node, path = stack.pop()
        if text := node.text():
            out.add(held_at(path, text))
        for run in runs([k for k in node.elements() if not is_aside(k)]):
            below = step(path, run[0])
            stack += [(k, below) for k in run]
    return layout_of(root), out


def match(run: list[Node], slot: Slot, memo: dict) -> int:
    """Simple tree matching: the most nodes of the two trees that correspond, with their order and their parents."""
    if run[0].sign != slot.sign:
        return 0
    key = (id(run), id(slot))
    if key not in memo:
        memo[key] = (run, 1 + align(runs(run[0].elements()), slot.slots, memo)[0])  # run is kept, so that its id stays its own
    return memo[key][1]


def align(page: list[list[Node]], slots: list[Slot], memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """The best order-preserving pairs of a page's runs and a wrapper's slots, and how many nodes they match."""
    if not page or not slots:
        return 0, []
    n, m = len(page), len(slots)
    if n == m and all(r[0].sign == s.sign for r, s in zip(page, slots, strict=True)) and len({s.sign for s in slots}) == m:
        return sum(match(r, s, memo) for r, s in zip(page, slots, strict=True)), [(i, i) for i in range(n)]
    if n * m > MOST_PAIRS:
        pairs, j, at = [], 0, defaultdict(list)
        for k, s in enumerate(slots):
            at[s.sign].append(k)
        for i, r in enumerate(page):
            later = at[r[0].sign]
            if (k := bisect_left(later, j)) < len(later):
                pairs.append((i, later[k]))
                j = later[k] + 1
        return len(pairs), pairs
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        above, row, run = best[i - 1], best[i], page[i - 1]
        for j in range(1, m + 1):
            w = match(run, slots[j - 1], memo)
            row[j] = max(above[j], row[j - 1], above[j - 1] + w if w else 0)
    pairs, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[n][m], pairs[::-1]


def merge(run: list[Node], slot: Slot, memo: dict) -> None:
    """Take another page's run into a slot; what has no counterpart becomes an optional slot."""
    page = runs(run[0].elements())
    pairs = align(page, slot.slots, memo)[1]
    paired = dict(pairs)
    out, j = [], 0
    for i, r in enumerate(page):
        if i in paired:
            out += slot.slots[j : paired[i]]
            j = paired[i] + 1
            merge(r, slot.slots[j - 1], memo)
            out.append(slot.slots[j - 1])
        else:
            out.append(slot_of(r))
    slot.slots = out + slot.slots[j:]


def skeleton(pages: list[str]) -> Slot | None:
    """The slots of different pages; None for fewer than LEAST_PAGES."""
    trees = [parse(p) for p in dict.fromkeys(pages)]
    if len(trees) < LEAST_PAGES:
        return None
    out = slot_of([trees[0]])
    for t in trees[1:]:
        merge([t], out, {})
    return out


def induce(pages: list[str]) -> Wrapper | None:
    """The wrapper of a host's pages, all aligned. Copies of a page count once; None for fewer than LEAST_PAGES different ones."""
    slots = skeleton(pages)
    if slots is None:
        return None
    found: dict[int | None, Counter] = defaultdict(Counter)
    total: Counter = Counter()
    for p in dict.fromkeys(pages):
        layout, held = holds(p)
        for group in (None, layout):
            total[group] += 1
            found[group].update(held)
    return Wrapper(slots, frozenset(x for g, c in found.items() if g is None or total[g] >= LEAST_LAYOUT for x, n in c.items() if 100 * n >= CONSTANT_PERCENT * total[g]))


def apply(run: list[Node], slot: Slot, path: bytes, constant: frozenset[int], memo: dict) -> None:
    """Mark the nodes of a page that have a slot and whose text is template."""
    path = step(path, run[0])
    for node in run:
        text = node.text()
        node.constant = bool(text) and held_at(path, text) in constant
        page = runs(node.elements())
        for i, j in align(page, slot.slots, memo)[1]:
            apply(page[i], slot.slots[j], path, constant, memo)


def is_aside(node: Node) -> bool:
    return node.aside > 0


def text_size(node: Node) -> int:
    """Characters of text outside asides."""
    total, stack = 0, [node]
    while stack:
        for k in stack.pop().kids:
            if k.__class__ is str:
                total += len(k)
            elif not is_aside(k):
                stack.append(k)
    return total


def main_roots(root: Node) -> list[Node]:
    """The elements whose tag or marks say that they hold the main text: all articles, else all main elements, else all
    marked ones; the main elements also where they hold more than twice the articles' text. None may stand in another."""
    ranked: list[list[Node]] = [[], [], []]
    stack: list[tuple[Node, tuple[bool, ...]]] = [(root, (False, False, False))]
    while stack:
        node, under = stack.pop()
        for k in reversed(node.elements()):
            if is_aside(k):
                continue
            r = 0 if k.tag == "article" else 1 if k.tag == "main" or "main" in k.mark.split() else 2 if k.mark and not MAIN_WORDS.isdisjoint(k.mark.split()) else 3
            if r < 3 and not under[r] and text_size(k):
                ranked[r].append(k)
            stack.append((k, tuple(u or i == r for i, u in enumerate(under))))
    articles, mains, marked = ranked
    if articles and sum(map(text_size, mains)) > 2 * sum(map(text_size, articles)):
        return mains
    return articles or mains or marked or [root]


def blocks(root: Node, roots: list[Node]) -> list[tuple[str, bool, bool]]:
    """The text of each block in page order, whether all of it is template, and whether it stands in one of roots.
    Asides are left out."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    fixed = True
    main = {id(r) for r in roots}
    inside = id(root) in main

    def end() -> None:
        nonlocal parts, fixed
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append((text, fixed, inside))
        parts, fixed = [], True

    stack: list = [(root, iter(root.kids))]
    while stack:
        node, kids = stack[-1]
        for k in kids:
            if k.__class__ is str:
                text = entities.unescape(k) if "&" in k else k
                parts.append(text)
                if not node.constant and text.strip():
                    fixed = False
            elif k.tag == "br":
                parts.append(" ")
            elif not is_aside(k):
                if k.tag in BLOCK or id(k) in main:
                    end()
                inside = inside or id(k) in main
                stack.append((k, iter(k.kids)))
                break
        else:
            if node.tag in BLOCK or id(node) in main:
                end()
            stack.pop()
            if id(node) in main:
                inside = any(id(n) in main for n, _ in stack)
    end()
    return out


def extract(source: str | None, wrapper: Wrapper | None) -> str:
    """The main text: the blocks of the page that vary within the host, wherever they stand. Where more than MOST_FIXED of
    the text of the main elements would be template, the host has copies of the page, and all of that is the text. Without a
    wrapper, the text is that of the main elements."""
    if not source:
        return ""
    root = parse(source)
    if wrapper:
        apply([root], wrapper.slots, b"", wrapper.constant, {})
    found = blocks(root, main_roots(root))
    if not wrapper:
        return "\n\n".join(t for t, _, inside in found if inside)
    fixed = sum(len(t) for t, f, inside in found if f and inside)
    drop = fixed <= MOST_FIXED * sum(len(t) for t, _, inside in found if inside)
    return "\n\n".join(t for t, f, inside in found if not f or inside and not drop)


def different_pages(pages: DataFrame) -> DataFrame:
    """host, at (a hash of html), page_id (of one row), layout and held (see holds) for each different page of each host."""
    rows = pages.where("html <> ''").select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("at"), F.col("page_id").cast("long").alias("page_id"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for b in slices(batches):
            hosts, ats = b.column("host").to_pylist(), b.column("at").to_pylist()
            new = []
            for i, key in enumerate(zip(hosts, ats, strict=True)):
                if key not in seen:
                    if len(seen) >= SEEN_PAGES:
                        seen.clear()
                    seen.add(key)
                    new.append(i)
            b = b.take(pa.array(new, pa.int64()))
            found = [holds(h) for h in b.column("html").to_pylist()]
            held = pa.array([sorted(h) for _, h in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("at"), b.column("page_id"), pa.array([x for x, _ in found], pa.int64()), held], ["host", "at", "page_id", "layout", "held"])

    rows = rows.mapInArrow(run, "host string, at long, page_id long, layout long, held array<long>")
    return rows.groupBy("host", "at").agg(F.min("page_id").alias("page_id"), F.first("layout").alias("layout"), F.first("held").alias("held"))


def constants(different: DataFrame) -> DataFrame:
    """host, constant (comma-separated) for each host with enough different pages, counted over all of them."""
    def often(*group: str, least: int) -> DataFrame:
        total = different.groupBy(*group).agg(F.count("*").alias("total")).where(F.col("total") >= least)
        counts = different.select(*group, F.explode("held").alias("x")).groupBy(*group, "x").agg(F.count("*").alias("n")).where(100 * F.col("n") >= CONSTANT_PERCENT * least)
        return counts.join(total, list(group)).where(100 * F.col("n") >= CONSTANT_PERCENT * F.col("total")).select("host", "x")

    found = often("host", least=LEAST_PAGES).union(often("host", "layout", least=LEAST_LAYOUT)).distinct()
    return found.groupBy("host").agg(F.concat_ws(",", F.array_sort(F.collect_list("x")).cast("array<string>")).alias("constant"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) for each host with enough different pages."""
    different = materialize(different_pages(pages), "html-pages")
    some = different.select("host", "at", "page_id", "layout")
    first = lambda n, *by: some.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).where(F.col("_n") <= n).drop("_n")
    total = some.groupBy("host").agg(F.count("*").alias("_all"))
    often = some.groupBy("host", "layout").agg(F.count("*").alias("_n")).join(total, "host").where(100 * F.col("_n") >= LAYOUT_PERCENT * F.col("_all")).where(F.col("_n") >= LEAST_LAYOUT)
    picked = first(SAMPLE_PAGES, "host").union(first(LAYOUT_PAGES, "host", "layout").join(often.select("host", "layout"), ["host", "layout"]).select(*some.columns)).distinct()
    picked = materialize(picked.select(F.col("host").alias("_host"), F.col("at").alias("_at"), F.col("page_id").alias("_page")), "html-sample")
    rows = pages.where("html <> ''").select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("at"), F.col("page_id").cast("long").alias("page_id"), "html")
    rows = rows.join(picked, (F.col("host") == F.col("_host")) & (F.col("at") == F.col("_at")) & F.col("page_id").eqNullSafe(F.col("_page")))
    rows = rows.groupBy("host", "at").agg(F.first("html").alias("html"))

    def run(t: pa.Table) -> pa.Table:
        pages = sorted(zip(t.column("at").to_pylist(), t.column("html").to_pylist(), strict=True))
        slots = skeleton([h for _, h in pages])
        return pa.table({"host": pa.array(t.column("host").to_pylist()[: slots is not None], pa.string()), "slots": pa.array([json.dumps(slots.plain())] if slots else [], pa.string())})

    found = rows.groupBy("host").applyInArrow(run, "host string, slots string").join(constants(different), "host", "left")
    return found.select("host", F.concat(F.lit("["), "slots", F.lit(",["), F.coalesce("constant", F.lit("")), F.lit("]]")).alias("wrapper"))


def extract_main(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> a row per row: page_id, url, text, n_chars.

    A null or empty html has an empty text. A null url counts as of the host with the empty name; a null page_id stays
    null. Repeated rows give repeated results, and an empty table an empty one. What is template on a host is
    counted over all its different pages; a bounded sample of them gives the slots that each page is aligned with.
    """
    found = materialize(wrappers(pages), "html-wrappers")
    size = found.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()[0]
    found = found.select(F.col("host").alias("_host"), "wrapper")
    rows = pages.select("page_id", "url", "html").withColumn("_key", host_of(F.col("url")))
    rows = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, F.col("_key") == F.col("_host"), "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for b in slices(batches):
            texts = []
            for source, w in zip(b.column("html").to_pylist(), b.column("wrapper").to_pylist(), strict=True):
                if w and w not in known:
                    if len(known) > 200:
                        known.clear()
                    slots, constant = json.loads(w)
                    known[w] = Wrapper(Slot.of(slots), frozenset(constant))
                texts.append(extract(source, known[w] if w else None))
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(pages: DataFrame) -> DataFrame:
    return extract_main(pages)
