"""Main text of web pages by wrapper induction.

Each layout of a host, told by the outer nodes' labels, has a wrapper: the tree of
one of its pages, runs of alike siblings folded into one node. Layouts of too few
pages share the wrapper of the host's main layout. Every page is aligned with its
wrapper by simple tree matching. A text that
stands in a wrapper node on most of the distinct pages aligned with it is
constant, so template; what else the node holds is its slot. Counts of all
pages of a wrapper decide, gathered as sums per wrapper node. A page's content is
then what its slots hold, less what its marks say is not the article: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments.
Where a page marks its article, the content is that element, less the constant
texts in there, unless these are over half of it: then near copies repeat it.

Pages are read three times, for layouts, for counts and for texts, and are not
shuffled: wrappers reach the workers as files (see shelves).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, text_chunks
from .dom import BLOCK, RAW, VOID, Element, parse
from .shelves import KEPT, Shelf, put_on_shelf

#: Elements that are no part of an article.
OUTSIDE = frozenset("nav footer aside form script style noscript template head iframe svg math button select option input textarea dialog menu object embed canvas audio video map".split())
#: Words in class, id and role values that mark what is no part of an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notification alert popup modal "
    "newsletter subscribe signup login comment comments discussion disqus respond reply replies share sharing social related recommended widget toolbar pagination pager search skip complementary contentinfo".split()
)
HEADER_MARKS = frozenset("header masthead banner".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of distinct pages that a constant node's text is the same in, and how many distinct pages have to be aligned.
CONSTANT_SHARE = 0.6
LEAST_PAGES = 3
#: ASCII white space and the no-break space.
SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case; the empty string where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def is_header(e: Element) -> bool:
    return e.tag == "header" or bool(e.attributes) and e.tag in BLOCK and not HEADER_MARKS.isdisjoint(re.split(r"[^a-z0-9]+", e.attribute("class", "id", "role")))


def is_outside(e: Element) -> bool:
    if e.tag in OUTSIDE:
        return True
    if not e.attributes:
        return False
    if e.attribute("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|$)", e.attributes.lower()) or "display:none" in e.attribute("style").replace(" ", ""):
        return True
    return e.tag not in ("html", "body", "article", "main") and not MARKS.isdisjoint(re.split(r"[^a-z0-9]+", e.attribute("class", "id", "role")))


def is_landmark(e: Element) -> bool:
    return e.tag in ("article", "main") or "role" in e.attributes and e.attribute("role") in ("article", "main") or "itemprop" in e.attributes and e.attribute("itemprop") == "articlebody"


@dataclass(slots=True)
class Fold:
    """A node of a wrapper: a label, the digest of its own text, its children, and the elements folded into it, with the digest of each one's text."""

    label: str
    text: int
    children: tuple
    elements: list
    texts: list


def fold(e: Element) -> Fold:
    """The wrapper tree of an element: neighbours of equal label and equal shape below become one node."""
    own, children = [], []
    for c in e.children:
        if isinstance(c, str):
            own.append(c)
        elif c.tag in RAW or c.tag in VOID:
            continue
        elif c.tag not in BLOCK and not any(isinstance(x, Element) for x in c.children):
            own += [x for x in c.children if isinstance(x, str)]  # plain inline text belongs to its block
        else:
            node = fold(c)
            if children and children[-1].label == node.label and _shape(children[-1]) == _shape(node):
                last = children[-1]
                last.elements += node.elements
                last.texts += node.texts
                last.text = xxhash.xxh64_intdigest(f"{last.text} {node.text}".encode())
            else:
                children.append(node)
    kind = e.attribute("class", "id") if e.attributes else ""
    text = SPACE.sub(" ", "".join(own)).strip()
    digest = xxhash.xxh64_intdigest(text.encode()) if text else 0
    return Fold(f"{e.tag}.{kind}" if kind else e.tag, digest, tuple(children), [e], [digest])


def _shape(node: Fold) -> tuple:
    return tuple(c.label for c in node.children)


def body_of(root: Element) -> Element:
    """The body, or the whole where a page has none."""
    todo = [root]
    while todo:
        e = todo.pop()
        if e.tag == "body":
            return e
        todo += [c for c in e.children if isinstance(c, Element)]
    return root


def flat(node: Fold) -> tuple:
    return (node.label, node.text, tuple(flat(c) for c in node.children))


def packed(node: Fold) -> str:
    """A wrapper as text: depth, label and text digest of each node, in document order."""
    out: list[str] = []

    def walk(n: Fold, depth: int) -> None:
        out.append(f"{depth}\t{n.text:x}\t{re.sub(chr(10) + '|' + chr(9), ' ', n.label)}")
        for c in n.children:
            walk(c, depth + 1)

    walk(node, 0)
    return "\n".join(out)


def unpacked(text: str) -> list[tuple[str, int, list[int]]]:
    """(label, text digest, children) of each node of a packed wrapper; the first is the root."""
    nodes: list[tuple[str, int, list[int]]] = []
    path: list[int] = []
    for line in text.split("\n"):
        depth, digest, label = line.split("\t")
        del path[int(depth) :]
        if path:
            nodes[path[-1]][2].append(len(nodes))
        path.append(len(nodes))
        nodes.append((label, int(digest, 16), []))
    return nodes


def match(wrapper: list[tuple[str, int, list[int]]], page: Fold) -> dict[int, Fold]:
    """Simple tree matching: the largest order-keeping alignment of two trees' nodes with equal labels."""
    weights: dict[tuple[int, int], tuple[int, list]] = {}

    def weigh(a: int, b: Fold) -> int:
        label, _, children = wrapper[a]
        if label != b.label:
            return 0
        if not children or not b.children:
            return 1
        key = (a, id(b))
        if key not in weights:
            m, n = len(children), len(b.children)
            table = [[0] * (n + 1)]
            inner = [[weigh(x, y) for y in b.children] for x in children]
            for i in range(m):
                row, last, w = [0], table[-1], inner[i]
                for j in range(n):
                    row.append(max(last[j + 1], row[j], last[j] + w[j]))
                table.append(row)
            weights[key] = (table[m][n] + 1, [table, inner])
        return weights[key][0]

    out: dict[int, Fold] = {}
    todo = [(0, page)] if weigh(0, page) else []
    while todo:
        a, b = todo.pop()
        out[a] = b
        if (a, id(b)) in weights:
            table, inner = weights[a, id(b)][1]
            children = wrapper[a][2]
            i, j = len(children), len(b.children)
            while i and j:
                if inner[i - 1][j - 1] and table[i][j] == table[i - 1][j - 1] + inner[i - 1][j - 1]:
                    todo.append((children[i - 1], b.children[j - 1]))
                    i, j = i - 1, j - 1
                elif table[i][j] == table[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
    return out


def _texts(e: Element, skip: set[int], blocks: list[list[str]], in_article: bool) -> None:
    """Append the blocks of an element in page order."""
    for c in e.children:
        if isinstance(c, str):
            blocks[-1].append(c)
        elif id(c) in skip or is_outside(c):
            if c.tag in BLOCK:
                blocks.append([])
        elif is_header(c) and c.tag not in HEADINGS:
            # In an article a header has its headings; a page's own header is outside.
            if in_article:
                for h in (x for x in _walk(c) if x.tag in HEADINGS):
                    blocks.append([])
                    _texts(h, skip, blocks, True)
                blocks.append([])
        elif c.tag == "br":
            blocks[-1].append(" ")
        elif c.tag in BLOCK:
            blocks.append([])
            _texts(c, skip, blocks, in_article)
            blocks.append([])
        elif c.tag not in VOID:
            _texts(c, skip, blocks, in_article)


def _walk(e: Element):
    todo = [e]
    while todo:
        x = todo.pop()
        yield x
        todo += [c for c in reversed(x.children) if isinstance(c, Element)]


def _landmarks(e: Element) -> list[Element]:
    """Outermost marked articles that are not within something outside."""
    found = []
    for c in e.children:
        if isinstance(c, Element) and not is_outside(c):
            if is_landmark(c):
                inner = _landmarks(c) if c.tag == "main" else []
                found += inner or [c]
            else:
                found += _landmarks(c)
    return found


def main_text(root: Element, template: set[int] = frozenset()) -> str:
    """The article's blocks, joined by empty lines. template: ids of elements that the wrapper knows as constant.

    A marked article that would lose over half of its text is itself repeated on
    the host, by near copies of the page, and is kept whole.
    """
    body = body_of(root)
    marked = _landmarks(body)

    def text(skip: set[int]) -> str:
        blocks: list[list[str]] = [[]]
        for e in marked or [body]:
            blocks.append([])
            _texts(e, skip, blocks, bool(marked))
        texts = (SPACE.sub(" ", "".join(b)).strip() for b in blocks)
        return "\n\n".join(t for t in texts if t)

    left = text(template)
    if marked and template and 2 * len(left) < len(whole := text(set())):
        return whole
    return left


def _decoded(texts: list[bytes]) -> list[Element]:
    return [parse(t.decode("utf-8", "replace")) for t in texts]


def layout_of(page: Fold) -> int:
    """A number that pages of equal layout share: the labels down to the first node with several children, and theirs. Zero if there is nothing."""
    if not page.children and not page.text:
        return 0
    path = [page.label]
    while len(page.children) == 1:
        page = page.children[0]
        path.append(page.label)
    return int(np.uint64(xxhash.xxh64_intdigest("\n".join([*path, "", *_shape(page)]).encode())).astype(np.int64)) or 1


SURVEY = "host string, layout long, page long, wrapper string"
#: Bytes of wrappers that a task gathers before it hands them on.
GATHERED = 16 << 20


def _survey(batches):
    """(host, layout, page) of each page, and for each layout that a task meets the wrapper of its page with the least number."""
    import pyarrow as pa

    best: dict[tuple[str, int], tuple[int, str]] = {}
    held = 0

    def out(hosts, layouts, pages, wrappers):
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(layouts, pa.int64()), pa.array(pages, pa.int64()), pa.array(wrappers, pa.string())], ["host", "layout", "page", "wrapper"])

    def gathered():
        found = out([h for h, _ in best], [x for _, x in best], [p for p, _ in best.values()], [w for _, w in best.values()])
        best.clear()
        return found

    for batch in batches:
        hosts, pages = batch.column("host").to_pylist(), batch.column("page").to_pylist()
        for first, last, texts in text_chunks(batch, "html"):
            layouts = []
            for k, root in enumerate(_decoded(texts), first):
                tree = fold(body_of(root))
                layouts.append(layout_of(tree))
                key = hosts[k], layouts[-1]
                if key not in best or pages[k] < best[key][0]:
                    best[key] = pages[k], packed(tree)
                    held += len(best[key][1])
            yield out(hosts[first:last], layouts, pages[first:last], [None] * len(layouts))
            if held > GATHERED:
                yield gathered()
                held = 0
    if best:
        yield gathered()


class Wrappers:
    """A worker's view of shelved wrappers; those unpacked last are kept."""

    def __init__(self, shelf: Shelf):
        self.shelf, self.unpacked_, self.hosts = shelf, {}, {}

    def find(self, bucket: int, host: str, page: Fold):
        """(layout of the wrapper, its nodes, its constant texts) for a page of a host; None where the host has none."""
        if (rows := self.shelf.rows(bucket)) is not self.hosts.get(bucket, (None,))[0]:
            by_host: dict[str, tuple[dict[int, int], int]] = {}
            for k, (h, layout, main, _, _) in enumerate(rows):
                layouts = by_host.setdefault(h, ({}, []))
                layouts[0][layout] = k
                if main:
                    layouts[1].append(k)
            self.hosts = {b: x for b, x in self.hosts.items() if self.shelf.holds(b)} | {bucket: (rows, by_host)}
        found = self.hosts[bucket][1].get(host)
        if found is None:
            return None
        k = found[0].get(layout_of(page), found[1][0])
        key = bucket, k
        if key not in self.unpacked_:
            if len(self.unpacked_) >= 500:
                self.unpacked_.clear()
            _, layout, _, wrapper, constant = rows[k]
            self.unpacked_[key] = layout, unpacked(wrapper), frozenset((c["node"], c["digest"] % (1 << 64)) for c in constant or ())
        return self.unpacked_[key]


COUNTED = "host string, layout long, page long, node array<int>, digest array<long>"


def _count(shelf: Shelf):
    """Per page, the texts that stand in wrapper nodes, each node also with digest zero."""

    def run(batches):
        import pyarrow as pa

        wrappers = Wrappers(shelf)
        for batch in batches:
            hosts, buckets, pages = (batch.column(c).to_pylist() for c in ("host", "bucket", "page"))
            for first, _, texts in text_chunks(batch, "html"):
                found = []
                for k, root in enumerate(_decoded(texts), first):
                    tree = fold(body_of(root))
                    layout, wrapper, _ = wrappers.find(buckets[k], hosts[k], tree)
                    pairs = [(node, d) for node, at in match(wrapper, tree).items() if not at.children and any(at.texts) for d in sorted({0, *at.texts})]
                    found.append((hosts[k], layout, pages[k], [n for n, _ in pairs], np.array([d for _, d in pairs], np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], ["host", "layout", "page", "node", "digest"])

    return run


def _near(pages: DataFrame, shelf: Shelf) -> DataFrame:
    """Pages with the bucket of their host's wrappers; where a worker can't keep all buckets, pages of one bucket come together, however many tasks they take."""
    marked = pages.withColumn("bucket", shelf.bucket(F.col("host")))
    return marked if shelf.size <= KEPT else marked.repartitionByRange("bucket", "page")


def induce(pages: DataFrame) -> Shelf:
    """The wrappers of all hosts on a shelf: rows (host, layout, main, wrapper, constant), from all distinct pages.

    pages: host, html (binary), page (a number that equal pages share). A wrapper's
    tree is that of its layout's page with the least number. Layouts of fewer than
    LEAST_PAGES pages share the wrapper of the host's main layout.
    """
    survey = materialize(pages.select("host", "page", "html").mapInArrow(_survey, SURVEY), "page-survey")
    sizes = survey.select("host", "layout", "page").distinct().groupBy("host", "layout").agg(F.count("*").alias("n"))
    trees = survey.filter("wrapper IS NOT NULL").groupBy("host", "layout").agg(F.min_by("wrapper", "page").alias("wrapper"))
    layouts = materialize(sizes.join(trees.select(F.col("host").alias("t_host"), F.col("layout").alias("t_layout"), "wrapper"), (F.col("host") == F.col("t_host")) & (F.col("layout") == F.col("t_layout"))).select("host", "layout", "n", "wrapper"), "page-layouts")
    # A page without content is no host's main layout while there is another.
    main = layouts.groupBy("host").agg(F.max(F.struct(F.col("layout") != 0, "n", "layout")).alias("main")).select(F.col("host").alias("m_host"), F.col("main.layout").alias("m_layout"))
    chosen = layouts.join(main, F.col("host") == F.col("m_host")).withColumn("main", F.col("layout") == F.col("m_layout"))
    chosen = materialize(chosen.filter(F.col("main") | (F.col("n") >= LEAST_PAGES) & (F.col("layout") != 0)).select("host", "layout", "main", "wrapper"), "wrappers")
    none = F.lit(None).cast("array<struct<node:int,digest:bigint>>")
    shelf = put_on_shelf(chosen.withColumn("constant", none), "wrappers-plain")
    texts = _near(pages.select("host", "page", "html"), shelf).mapInArrow(_count(shelf), COUNTED).dropDuplicates(["host", "layout", "page"])  # copies of a page count once
    sums = texts.select("host", "layout", F.explode(F.arrays_zip("node", "digest")).alias("x")).groupBy("host", "layout", F.col("x.node").alias("node"), F.col("x.digest").alias("digest")).agg(F.count("*").alias("n"))
    sums = materialize(sums.filter("n > 1"), "wrapper-texts")
    whole = sums.filter((F.col("digest") == 0) & (F.col("n") >= LEAST_PAGES)).select(F.col("host").alias("a_host"), F.col("layout").alias("a_layout"), F.col("node").alias("a_node"), F.col("n").alias("aligned"))
    same = sums.filter("digest != 0").join(whole, (F.col("host") == F.col("a_host")) & (F.col("layout") == F.col("a_layout")) & (F.col("node") == F.col("a_node")))
    constant = same.filter(F.col("n") >= CONSTANT_SHARE * F.col("aligned")).groupBy(F.col("host").alias("c_host"), F.col("layout").alias("c_layout")).agg(F.collect_list(F.struct("node", "digest")).alias("constant"))  # what most pages of one layout share
    marked = chosen.join(constant, (F.col("host") == F.col("c_host")) & (F.col("layout") == F.col("c_layout")), "left")
    return put_on_shelf(marked.select("host", "layout", "main", "wrapper", "constant"), "wrappers-marked")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null or empty html has an empty text; pages without a host share the
    wrappers of the empty host; rows of equal or null page_id are each extracted;
    an empty table gives an empty result. Copies of a page count once for what
    is constant on a host. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    ready = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), html.cast("binary").alias("html"), F.xxhash64(html).alias("page"))
    shelf = induce(ready)

    def run(batches):
        import pyarrow as pa

        wrappers = Wrappers(shelf)
        for batch in batches:
            hosts, buckets = batch.column("host").to_pylist(), batch.column("bucket").to_pylist()
            for first, last, texts in text_chunks(batch, "html"):
                found = []
                for k, root in enumerate(_decoded(texts), first):
                    tree, template = fold(body_of(root)), set()
                    _, wrapper, constant = wrappers.find(buckets[k], hosts[k], tree)
                    if constant:
                        template = {id(e) for n, at in match(wrapper, tree).items() if not at.children for e, digest in zip(at.elements, at.texts) if (n, digest) in constant}
                    found.append(main_text(root, template))
                rows = slice(first, last)
                yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id")[rows], "url": batch.column("url")[rows], "text": pa.array(found, pa.string()), "n_chars": pa.array(np.array([len(t) for t in found], np.int64))})

    kind = pages.schema["page_id"].dataType.simpleString()
    return _near(ready, shelf).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
