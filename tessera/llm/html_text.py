"""Main text of pages by wrapper induction.

The pages of a host are aligned, tree against tree, with one page of the host
by simple tree matching; runs of equal siblings count as one repeated node.
Over all pages of the host, a node whose text stays the same is template, one
whose text varies is a slot; of a repeated node whose text varies as a whole,
single elements that most pages have are template too. The main text is the slot
of the article, or of the element that holds most of what varies. Template whose
text in the page is the template's is left out, within the article as outside of
it; but where most of an article would go, its pages are copies of one another
rather than framed alike, and it stays whole. Menus, adverts and the like, which vary
too, are told by their elements and class names. Pages of one host with the same
text count once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import renamed, small_side, written
from tessera.llm.html_tree import BLOCK, Node, parse
from tessera.llm.url_rules import host_of

# Elements and class words of what isn't main text.
ELEMENTS = frozenset(
    "head nav header footer aside form script style noscript template iframe svg math object canvas audio video button select textarea dialog menu dir search".split()
)
CLASS_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer foot header masthead topbar comment comments respond replies reply disqus "
    "share sharing social related recommended newsletter subscribe signup popup modal overlay login widget pagination pager skip hidden toolbar "
    "complementary contentinfo search form".split()
)
#: A node is template if so many pages were aligned with it and this share of them has its text.
PAGES, SAME = 3, 0.8
#: An element is gone into while one child holds this share of what varies.
MOST = 0.6
REFERENCE_BYTES = 64 << 20
#: The page as a whole, which is never template.
WHOLE = frozenset(["#root", "html", "body"])
#: Markup and what isn't text, for telling whether two pages have the same text.
MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|\s+"


def aside(node: Node) -> bool:
    """Is an element no part of the main text, by its kind or class names? Those of a page as a whole say nothing about it."""
    if node.tag in ELEMENTS:
        return True
    return bool(node.marks) and node.tag not in ("html", "body", "main") and not CLASS_WORDS.isdisjoint(node.marks.split())


def text_of(node: Node) -> str:
    parts: list[str] = []
    todo = [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            parts.append(item)
        else:
            todo.extend(reversed(item.children))
    return " ".join(" ".join(parts).split())


class Shape:
    """A page's tree with runs of equal siblings as one node, numbered from the root on."""

    def __init__(self, root: Node) -> None:
        self.labels: list[str] = []
        self.children: list[list[int]] = []
        self.nodes: list[list[Node]] = []
        self._add([root])
        self.key = tuple(zip(self.labels, map(len, self.children), strict=True))

    def _add(self, run: list[Node]) -> None:
        """Adds a run of siblings and what is below it, level by level."""
        todo: deque[tuple[list[Node], int | None]] = deque([(run, None)])
        while todo:
            nodes, parent = todo.popleft()
            number = len(self.labels)
            self.labels.append(f"{nodes[0].tag} {nodes[0].marks}")
            self.children.append([])
            self.nodes.append(nodes)
            if parent is not None:
                self.children[parent].append(number)
            widest = max(nodes, key=lambda node: len(node.children))
            for node in nodes:
                node.number = number
            runs: list[list[Node]] = []
            for child in widest.children:
                if not isinstance(child, str):
                    if runs and runs[-1][0].tag == child.tag and runs[-1][0].marks == child.marks:
                        runs[-1].append(child)
                    else:
                        runs.append([child])
            todo += [(same, number) for same in runs]


def matched(a: Shape, b: Shape) -> list[int]:
    """For each node of a, the node of b that simple tree matching pairs it with, or -1."""
    if a.key == b.key:
        return list(range(len(a.labels)))
    # only nodes whose ancestors have equal labels can be paired; their children come later in the list
    reached = [(0, 0)] if a.labels[0] == b.labels[0] else []
    for i, j in reached:
        reached += [(x, y) for x in a.children[i] for y in b.children[j] if a.labels[x] == b.labels[y]]
    sizes: dict[tuple[int, int], int] = {}
    for i, j in reversed(reached):
        sizes[i, j] = 1 + _align(a.children[i], b.children[j], sizes)[-1][-1]
    pairs, todo = [-1] * len(a.labels), [(0, 0)] if (0, 0) in sizes else []
    while todo:
        i, j = todo.pop()
        pairs[i] = j
        mine, its = a.children[i], b.children[j]
        best = _align(mine, its, sizes)
        x, y = len(mine), len(its)
        while x and y:
            if best[x][y] == best[x - 1][y]:
                x -= 1
            elif best[x][y] == best[x][y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                todo.append((mine[x], its[y]))
    return pairs


def _align(mine: list[int], its: list[int], sizes: dict[tuple[int, int], int]) -> list[list[int]]:
    """Largest total of matched subtrees for each pair of beginnings of two rows of children."""
    best = [[0] * (len(its) + 1)]
    for i in mine:
        above, row = best[-1], [0]
        for y, j in enumerate(its):
            row.append(max(above[y + 1], row[y], above[y] + sizes.get((i, j), 0)))
        best.append(row)
    return best


@lru_cache(maxsize=2000)
def _reference(page: str) -> tuple[Shape, list[int], dict[int, dict[int, int]]]:
    """Shape of a host's page, the hash of each node's text, and the elements of repeated nodes: node to {hash of text: number}.

    These are numbered on from the last node; elements of a node with the same text are one, those without text none.
    """
    shape = Shape(parse(page))
    hashes, elements, number = [], {}, len(shape.labels)
    for node, nodes in enumerate(shape.nodes):
        texts = list(map(text_of, nodes))
        hashes.append(hash("\n".join(texts)))
        if len(nodes) > 1:
            different = dict.fromkeys(hash(text) for text in texts if text)
            elements[node] = {value: number + i for i, value in enumerate(different)}
            number += len(different)
    return shape, hashes, elements


class _Keyed:
    """A shape that is equal to others with the same key, so that pairings are found once."""

    __slots__ = ("shape", "key")

    def __init__(self, shape: Shape) -> None:
        self.shape, self.key = shape, shape.key

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other: object) -> bool:
        return self.key == other.key


@lru_cache(maxsize=20_000)
def _pairs(keyed: _Keyed, reference: str) -> list[int]:
    return matched(keyed.shape, _reference(reference)[0])


def observed(page: str, reference: str) -> Iterator[tuple[int, bool, int]]:
    """(node or element of the reference, same text, characters) for each node that the page is aligned with."""
    shape = Shape(parse(page))
    _, hashes, elements = _reference(reference)
    for number, other in enumerate(_pairs(_Keyed(shape), reference)):
        if other >= 0:
            texts = list(map(text_of, shape.nodes[number]))
            text = "\n".join(texts)
            yield other, hash(text) == hashes[other], len(text)
            if other in elements:
                here = set(map(hash, texts))
                for value, element in elements[other].items():
                    yield element, value in here, 0


def _template(shape: Shape, seen: dict[int, tuple[int, int, int]]) -> set[int]:
    """Nodes whose text stays the same and that hold no node whose text varies."""
    fixed, slots = set(), set()
    for node in reversed(range(len(shape.labels))):  # children come after their parents
        pages, same, _ = seen.get(node, (0, 0, 0))
        if not slots.isdisjoint(shape.children[node]) or (pages >= PAGES and same < SAME * pages):
            slots.add(node)
        elif pages >= PAGES and shape.labels[node].split()[0] not in WHOLE:
            fixed.add(node)
    return fixed


def induce(reference: str, seen: dict[int, tuple[int, int, int]]) -> tuple[list[int], int]:
    """(template nodes and elements, node of the main slot) from {node: (pages, pages with the same text, characters)}."""
    shape, _, elements = _reference(reference)
    fixed, at = _template(shape, seen), 0
    for element in (x for some in elements.values() for x in some.values()):
        pages, same, _ = seen.get(element, (0, 0, 0))
        if pages >= PAGES and same >= SAME * pages:
            fixed.add(element)
    while True:  # down from the root, where most of what varies is
        varying = {}
        for child in shape.children[at]:
            if child in seen and child not in fixed and not any(map(aside, shape.nodes[child])):
                varying[child] = seen[child][2]
        total = sum(varying.values())
        largest = max(varying, key=varying.get, default=None)
        if largest is None or varying[largest] < MOST * total or shape.labels[largest].split()[0] not in BLOCK - {"p"} | {"#root"}:
            return sorted(fixed), at
        at = largest


def _regions(root: Node, template: set[int], slot: int, pairs: list[int]) -> list[Node]:
    """The outermost articles or main element outside of what is left out, else the wrapper's slot, else the page."""
    for name in ("article", "main"):
        # a wrapper named after a sidebar may hold the article too: class names are overruled if nothing else is found
        for left_out in (aside, lambda node: node.tag in ELEMENTS):
            found, todo = [], [root]
            while todo:
                node = todo.pop()
                if node.tag == name and not aside(node):
                    found.append(node)
                elif not left_out(node):
                    todo.extend(child for child in reversed(node.children) if not isinstance(child, str))
            if found:
                return found
    slots, todo = [], [root]
    while todo and slot > 0:
        node = todo.pop()
        if 0 <= node.number < len(pairs) and pairs[node.number] == slot:
            slots.append(node)
        else:
            todo.extend(child for child in reversed(node.children) if not isinstance(child, str))
    return slots or [root]


def extract(page: str, reference: str | None = None, template: list[int] | None = None, slot: int = -1) -> str:
    """Blocks of the main text, joined by an empty line."""
    root = parse(page)
    pairs: list[int] = []
    same: set[int] = set()  # template nodes that have the template's text in this page
    alike: set[Node] = set()  # and single elements of repeated nodes that have it
    fixed = set(template or ())
    if reference is not None:
        shape = Shape(root)
        pairs = _pairs(_Keyed(shape), reference)
        _, hashes, elements = _reference(reference)
        for i, other in enumerate(pairs):
            known = {value for value, element in elements.get(other, {}).items() if element in fixed}
            if other in fixed or known:
                texts = list(map(text_of, shape.nodes[i]))
                if other in fixed and hash("\n".join(texts)) == hashes[other]:
                    same.add(i)
                alike.update(node for node, text in zip(shape.nodes[i], texts, strict=True) if hash(text) in known)
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    def template_parts(region: Node) -> set[Node]:
        """The outermost elements of a region that are template; none if they are most of an article."""
        parts, going, staying = set(), 0, 0
        todo: list[Node | str] = [region]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                staying += len(item.strip())
            elif item is not region and (item.number in same or item in alike):
                parts.add(item)
                going += len(text_of(item))
            elif item is region or not aside(item):
                todo.extend(item.children)
        return set() if going > staying and region.tag in ("article", "main") else parts

    for region in _regions(root, fixed, slot, pairs):
        gone = template_parts(region)
        todo: list[Node | str | None] = [region]
        while todo:
            item = todo.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                line.append(item)
            elif item.tag == "br":
                line.append(" ")
            elif item is not region and aside(item):
                end()
            elif item in gone:
                end()
            else:
                if item.tag in BLOCK or item is region:
                    end()
                    todo.append(None)
                todo.extend(reversed(item.children))
        end()
    return "\n\n".join(blocks)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    A null or empty html has an empty text. Pages without a host are a host of
    their own. Repeated rows are read alike; an empty table gives an empty one.
    """
    rows = renamed(pages, page_id=page_id, url=pages[url].cast("string"), html=F.coalesce(pages[html].cast("string"), F.lit("")))
    rows = rows.withColumn("host", host_of(F.col("url")))
    first = written(rows.where("html <> '' and page_id is not null").groupBy("host").agg(F.min("page_id").alias("page_id")))
    chosen = rows.join(small_side(first, REFERENCE_BYTES, 80), ["host", "page_id"]).groupBy("host").agg(F.min("html").alias("reference"))
    references = written(chosen)
    size = (references.agg(F.avg(F.octet_length("reference"))).first()[0] or 0) + 100
    # copies of a page say nothing about what its host's pages have in common
    distinct = rows.where("html <> ''").groupBy("host", F.md5(F.regexp_replace("html", MARKUP, "")).alias("content")).agg(F.min("html").alias("html"))
    aligned = distinct.select("host", "html").join(small_side(references, REFERENCE_BYTES, int(size)), "host")
    seen = aligned.mapInArrow(_observe, "host string, node int, pages long, same long, chars long")
    seen = seen.groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"), F.sum("chars").alias("chars"))
    # one entry per node of one page
    gathered = seen.groupBy("host").agg(F.collect_list(F.struct("node", "pages", "same", "chars")).alias("seen"))
    wrappers = written(references.join(gathered, "host").mapInArrow(_induce, "host string, reference string, template array<int>, slot int"))
    joined = rows.join(small_side(wrappers, REFERENCE_BYTES, int(size) + 500), "host", "left")
    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "reference", "template", "slot").mapInArrow(
        _extract, f"page_id {kind}, url string, text string, n_chars long"
    )


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per host and node, added up before the shuffle."""
    totals: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for host, page, reference in zip(*(batch.column(x).to_pylist() for x in ("host", "html", "reference")), strict=True):
            for node, same, chars in observed(page, reference):
                total = totals.setdefault((host, node), [0, 0, 0])
                total[0] += 1
                total[1] += same
                total[2] += chars
        if len(totals) > 200_000:
            yield _totals(totals)
            totals = {}
    yield _totals(totals)


def _totals(totals: dict[tuple[str, int], list[int]]) -> pa.RecordBatch:
    columns = [pa.array([host for host, _ in totals], pa.string()), pa.array([node for _, node in totals], pa.int32())]
    columns += [pa.array([x[i] for x in totals.values()], pa.int64()) for i in range(3)]
    return pa.RecordBatch.from_arrays(columns, ["host", "node", "pages", "same", "chars"])


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for reference, seen in zip(batch.column("reference").to_pylist(), batch.column("seen").to_pylist(), strict=True):
            made.append(induce(reference, {x["node"]: (x["pages"], x["same"], x["chars"]) for x in seen}))
        columns = [batch.column("host"), batch.column("reference"), pa.array([x[0] for x in made], pa.list_(pa.int32())), pa.array([x[1] for x in made], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "reference", "template", "slot"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = zip(*(batch.column(x).to_pylist() for x in ("html", "reference", "template", "slot")), strict=True)
        texts = [extract(page or "", reference, template, -1 if slot is None else slot) for page, reference, template, slot in values]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])
