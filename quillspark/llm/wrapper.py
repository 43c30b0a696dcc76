"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each page becomes a tree of its block elements, in which like siblings are one
repeating node. Every tree is aligned with the host's most frequent tree, its pivot, by simple tree matching (Yang
1991), which gives each node a slot; a node that has no partner takes the slot of the nearest node above that has one.

Over all different pages of the host each slot is rated. A slot whose texts mostly recur on other pages of the host,
and far more often than those of its richest slot, is constant: template. What varies is content: from the root of the pivot the wrapper goes down to the innermost
container that still holds most of the varying text, and keeps the slots in it that vary. Only where that leaves a
choice does markup speak: a varying slot below a name such as comments or sidebar is no article text, and an article
element or a first heading next to the container belongs to it. All blocks take part, whatever their names.

Statistics are sums over all pages, keyed by host and slot, so that a hot host is summed in parts; no host's
pages meet in one task.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialise, table


@dataclass(frozen=True)
class Settings:
    pages: int = 5  # different pages a host must have for anything to be constant
    recurring: float = 0.5  # a constant slot: share of its different texts that other pages have there too ...
    again: float = 2.0  # ... and how many times the uses of a text of the richest slot its texts have
    constant: float = 0.8  # a constant text: share of the host's different pages that have it in a slot
    most: float = 0.6  # share of the varying text that the container of the content holds
    links: float = 0.8  # share of a slot's text in links that makes it a list of links


TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of HTML: elements whose content is no markup, that have no content, that are part of a line.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start of the key closes an open element of the values, up to the nearest of the last.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that hold no text of an article in any case.
NO_TEXT = set("form script style noscript template head title button select option textarea input iframe svg canvas object embed audio video dialog".split())
BOILERPLATE = NO_TEXT | {"nav", "footer", "aside", "menu"}
#: Text that flows: like siblings of these kinds are one node, whatever stands between them.
FLOW = set("p ul ol dl h1 h2 h3 h4 h5 h6 blockquote pre table figure hr address".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark what is no article text.
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion "
    "sidebar side sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations comment comments respond reply replies disqus discussion "
    "widget widgets pagination pager login search skip tags tagcloud byline meta hidden".split()
)
#: Words that show an article element to be one, whatever else its names say.
TEXTUAL = set("article post entry content story hentry main body text".split())


class Page:
    """nodes: (parent, label) in document order; blocks: (node, text, share of it in links). doubtful: whether the
    markup says of a node that it is no article text; never: whether it can be none."""

    def __init__(self, source: str):
        self.parent, self.tag, self.label, self.boiler, self.never = [-1], ["#"], ["#"], [False], [False]
        self.blocks: list[tuple[int, str, float]] = []
        self._read(source)
        main = [t in ("article", "main") and not b for t, b in zip(self.tag, self.boiler)]
        # Without either, a first heading shows that an element with a doubtful name holds the text.
        holds = list(main) if any(main) else [t == "h1" for t in self.tag]
        for i in range(len(self.tag) - 1, 0, -1):
            if holds[i]:
                holds[self.parent[i]] = True
        found, inside = any(main), [False] * len(self.tag)
        self.doubtful = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            up = self.parent[i]
            inside[i] = inside[up] or main[i]
            header = not inside[i] and (self.tag[i] == "header" or "header" in self.label[i].partition(".")[2].split("-"))
            self.doubtful[i] = self.doubtful[up] or (self.boiler[i] or header) and not (holds[i] and (found or self.tag[i] in ("div", "section")))
            self.never[i] = self.never[up] or self.tag[i] in NO_TEXT

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        words = [w.lower() for k in ("class", "id") for w in WORDS.findall(found.get(k, ""))]
        marked = bool(MARKS.intersection(words)) and not (tag == "article" and TEXTUAL.intersection(words))
        boiler = tag in BOILERPLATE or tag not in ("html", "body", "main") and (marked or found.get("role", "").lower() in ROLES or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower())
        self.parent.append(parent)
        self.tag.append(tag)
        self.label.append(tag + "." + "-".join(words) if words else tag)
        self.boiler.append(boiler)
        self.never.append(False)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack, inline = [0], []  # open block elements; open inline elements that hide or link
        opened: dict[str, int] = {}  # how many elements of a name are open
        buffer: list[str] = []
        size = [0, 0]  # characters, characters in links

        def flush() -> None:
            if buffer:
                text = " ".join(html.unescape("".join(buffer)).split())
                if text:
                    self.blocks.append((stack[-1], text, size[1] / max(1, size[0])))
                buffer.clear()
            size[:] = 0, 0

        def add(text: str) -> None:
            if text and not any(hides for _, hides in inline):
                buffer.append(text)
                size[0] += len(text)
                size[1] += len(text) * any(t == "a" for t, _ in inline)

        def close(tags: set[str], until: set[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in tags:
                    flush()
                    for i in stack[k:]:
                        opened[self.tag[i]] -= 1
                    del stack[k:]
                    return
                if self.tag[stack[k]] in until:
                    return

        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            if not m:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            closing, tag, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                if tag in INLINE:
                    for k in range(len(inline) - 1, -1, -1):
                        if inline[k][0] == tag:
                            del inline[k]
                            break
                elif opened.get(tag):
                    flush()
                    inline.clear()
                    while True:
                        last = self.tag[stack.pop()]
                        opened[last] -= 1
                        if last == tag:
                            break
                continue
            if tag in RAW:
                stop = re.compile(f"</{tag}", re.I).search(source, at)
                at = source.find(">", stop.start()) + 1 or end if stop else end
                continue
            if tag == "br" or tag == "wbr":
                add(" " if tag == "br" else "")
            elif tag in INLINE:
                if tag not in VOID and not attributes.endswith("/"):
                    i = self._open(0, tag, attributes)
                    inline.append((tag, self.boiler[i]))
                    for row in (self.parent, self.tag, self.label, self.boiler, self.never):
                        row.pop()
            else:
                close({"p"}, {"table", "button", "object"})
                if tag in CLOSES:
                    close(*CLOSES[tag])
                flush()
                inline = [x for x in inline if x[0] == "a"]
                i = self._open(stack[-1], tag, attributes)
                if tag not in VOID and not attributes.rstrip().endswith("/"):
                    stack.append(i)
                    opened[tag] = opened.get(tag, 0) + 1
        flush()

    def skeleton(self) -> tuple[list[tuple[int, str]], list[int]]:
        """(parent, label) of the tree with each run of like siblings as one node, and each node's place in it. Like
        siblings of text that flows are one node wherever they stand."""
        children: list[list[int]] = [[] for _ in self.tag]
        for i in range(1, len(self.tag)):
            children[self.parent[i]].append(i)
        tree, place, todo = [(-1, "#")], [0] * len(self.tag), [[0]]
        while todo:
            run = todo.pop()
            here, last, group = place[run[0]], None, []
            flow: dict[str, list[int]] = {}
            for c in (c for i in run for c in children[i]):
                label = self.label[c]
                if label in flow:
                    group = flow[label]
                elif label != last:
                    tree.append((here, label))
                    group = []
                    todo.append(group)
                    if self.tag[c] in FLOW:
                        flow[label] = group
                place[c] = place[group[0]] if group else len(tree) - 1
                group.append(c)
                last = label
        return tree, place


def encode_tree(tree: list[tuple[int, str]]) -> str:
    return "\n".join(f"{p} {label}" for p, label in tree)


def decode_tree(text: str) -> list[tuple[int, str]]:
    return [(int(p), label) for p, _, label in (x.partition(" ") for x in text.split("\n"))]


def match(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> dict[int, int]:
    """Simple tree matching: the order-preserving mapping of most nodes of a into b, roots and parents matched first."""
    below = []
    for tree in (a, b):
        children: list[list[int]] = [[] for _ in tree]
        for i, (p, _) in enumerate(tree):
            if p >= 0:
                children[p].append(i)
        below.append(children)
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    met, todo = [(0, 0)], [(0, 0)]  # pairs of like nodes below like parents, parents first
    seen = {(0, 0)}
    while todo:
        x, y = todo.pop()
        for c in below[0][x]:
            for d in below[1][y]:
                if a[c][1] == b[d][1] and (c, d) not in seen:
                    seen.add((c, d))
                    met.append((c, d))
                    todo.append((c, d))
    for x, y in reversed(met):
        xs, ys = below[0][x], below[1][y]
        rows = [[0] * (len(ys) + 1)]
        for i, c in enumerate(xs):
            row = [0]
            for j, d in enumerate(ys):
                row.append(max(row[j], rows[i][j + 1], rows[i][j] + (known[c, d][0] if (c, d) in known else 0)))
            rows.append(row)
        pairs, i, j = [], len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
        known[x, y] = 1 + rows[-1][-1], pairs
    out, todo = {}, [(0, 0)]
    while todo:
        pair = todo.pop()
        out[pair[0]] = pair[1]
        todo += known[pair][1]
    return out


def slots(tree: list[tuple[int, str]], pivot: list[tuple[int, str]]) -> tuple[list[int], list[bool]]:
    """For each node its slot in the pivot, that of the nearest node above that has one, and whether it has its own."""
    if tree == pivot:
        return [*range(len(tree))], [True] * len(tree)
    found, out = match(tree, pivot), []
    for i, (p, _) in enumerate(tree):
        out.append(found.get(i, out[p] if p >= 0 else 0))
    return out, [i in found for i in range(len(tree))]


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


@dataclass(frozen=True)
class Wrapper:
    """Slots in the content's container, and those of them that are no content."""

    inside: frozenset[int]
    dropped: frozenset[int]

    def keeps(self, slot: int, own: bool, doubtful: bool) -> bool:
        return slot in self.inside and (slot not in self.dropped if own else not doubtful)


class Rating(NamedTuple):
    """Of a slot's different texts over a host's different pages: how many there are, how many of them several pages
    have, how many the markup makes doubtful; their characters, and those in links; and over all their uses, each once
    for a page: how many, their characters, and the characters of constant texts."""

    texts: float
    recurring: float
    doubtful: float
    chars: float
    linked: float
    uses: float
    used_chars: float
    constant_chars: float


def wrapper(pivot: list[tuple[int, str]], rated: dict[int, Rating], pages: int, s: Settings = Settings()) -> Wrapper:
    """What is content in a host's pages, given their pivot, the ratings of the slots with text, and how many pages differ."""
    children: list[list[int]] = [[] for _ in pivot]
    for i in range(1, len(pivot)):
        children[pivot[i][0]].append(i)
    usual = max(rated.values(), key=lambda x: (x.chars - x.linked, -x.uses), default=None)
    constant = {k for k, x in rated.items() if pages >= s.pages and x.recurring >= s.recurring * x.texts and x.uses * usual.texts >= s.again * usual.uses * x.texts}
    doubtful = {k for k, x in rated.items() if x.doubtful * 2 > x.texts}
    listed = {k for k, x in rated.items() if x.linked >= s.links * x.chars}

    def amounts(out: set[int]) -> list[float]:
        own = [0.0] * len(pivot)
        for k, x in rated.items():
            own[k] = 0.0 if k in out else x.chars - x.linked
        return own

    # Constancy first, markup where much varies; if that leaves nothing, all there is.
    for own in (amounts(constant | listed | doubtful), amounts(constant | listed), amounts(set())):
        if any(own):
            break
    mass = list(own)
    for i in range(len(pivot) - 1, 0, -1):
        mass[pivot[i][0]] += mass[i]
    best = 0
    while True:
        inner = max(children[best], key=lambda c: (mass[c], -c), default=None)
        if inner is None or mass[inner] < s.most * mass[0] or own[inner] * 2 > mass[inner]:
            break
        best = inner

    def below(node: int) -> set[int]:
        out, todo = set(), [node]
        while todo:
            i = todo.pop()
            out.add(i)
            todo += children[i]
        return out

    kind = lambda i: pivot[i][1].partition(".")[0]
    headings = [int(kind(i) == "h1" and i in rated and i not in constant and i not in doubtful) for i in range(len(pivot))]
    for i in range(len(pivot) - 1, 0, -1):
        headings[pivot[i][0]] += headings[i]
    up = best
    while up > 0 and kind(best) != "article":
        up = pivot[up][0]
        if headings[up] > headings[best] or kind(up) in ("article", "main"):
            best = up
    inside = below(best)
    return Wrapper(frozenset(inside), frozenset((constant | doubtful | listed) & inside))


BLOCKS = "array<struct<node:int,links:double,doubtful:boolean,text:string>>"


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (a digest of html), tree and blocks; null html counts as empty."""
    kinds = pa.list_(pa.struct([("node", pa.int32()), ("links", pa.float64()), ("doubtful", pa.bool_()), ("text", pa.string())]))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("page", T.LongType()), T.StructField("tree", T.StringType()), T.StructField("blocks", T._parse_datatype_string(BLOCKS))])

    def run(batches):
        for batch in batches:
            digests, trees, blocks = [], [], []
            for source in batch.column("html").to_pylist():
                page = Page(source)
                tree, place = page.skeleton()
                digests.append(digest(source))
                trees.append(encode_tree(tree))
                blocks.append([{"node": place[n], "links": links, "doubtful": page.doubtful[n], "text": text} for n, text, links in page.blocks if not page.never[n]])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(digests, pa.int64()), pa.array(trees), pa.array(blocks, kinds)], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def induce(parsed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """host, pivot (a tree), inside and dropped (see Wrapper) and constant (array of slot and digest of a text): one row
    for each host.

    The pivot is the tree that most rows have, of several the greatest text. Equal pages count once in the ratings.
    Lists are no longer than the pivot, or 1 / settings.constant texts for each of its slots.
    """
    trees = parsed.groupBy("host", F.xxhash64("tree").alias("h")).agg(F.count("*").alias("n"), F.max("tree").alias("tree"))
    pivots = materialise(trees.groupBy("host").agg(F.max_by("tree", F.struct("n", "tree")).alias("pivot")), "pivots")
    columns = {"host": pa.string(), "page": pa.int64(), "slot": pa.int32(), "text": pa.int64(), "chars": pa.int32(), "links": pa.float64(), "doubtful": pa.bool_()}

    def run(batches):
        trees = {}
        for batch in batches:
            out = []
            for host, page, tree, pivot, blocks in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "tree", "pivot", "blocks"))):
                slot = _placed(trees, tree, pivot)[0]
                found = {}
                for b in blocks:
                    found.setdefault((slot[b["node"]], digest(b["text"])), (len(b["text"]), b["links"], b["doubtful"]))
                out += [(host, page, *k, *v) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(columns), columns.values())], names=list(columns))

    seen = parsed.join(pivots, "host").select("host", "page", "tree", "pivot", "blocks").mapInArrow(lean(run), "host string, page long, slot int, text long, chars int, links double, doubtful boolean")
    often = seen.groupBy("host", "slot", "text", "page").agg(F.first("chars").alias("chars"), F.first("links").alias("links"), F.first("doubtful").alias("doubtful"))
    often = often.groupBy("host", "slot", "text").agg(F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("links").alias("links"), F.max("doubtful").alias("doubtful"))
    total = materialise(parsed.groupBy("host").agg(F.countDistinct("page").alias("pages")), "totals")
    often = often.join(total, "host")
    common = (F.col("pages") >= settings.pages) & (F.col("n") >= settings.constant * F.col("pages"))
    often = materialise(often.select("host", "slot", "text", "n", "chars", "links", "doubtful", common.alias("common")), "texts")
    one, used = F.lit(1), F.col("chars") * F.col("n")
    sums = Rating(one, (F.col("n") > 1).cast("int"), F.col("doubtful").cast("int"), F.col("chars"), F.col("chars") * F.col("links"), F.col("n"), used, F.when(F.col("common"), used).otherwise(0))
    rated = often.groupBy("host", "slot").agg(*(F.sum(x).cast("double").alias(name) for name, x in zip(Rating._fields, sums)))
    rated = rated.groupBy("host").agg(F.collect_list(F.struct("slot", F.array(*Rating._fields).alias("x"))).alias("rated"))
    constant = often.where("common").groupBy("host").agg(F.collect_list(F.struct("slot", "text")).alias("constant"))
    kinds = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.int64())]))

    def decide(batches):
        for batch in batches:
            inside, dropped, texts = [], [], []
            for pivot, rows, common, pages in zip(*(batch.column(c).to_pylist() for c in ("pivot", "rated", "constant", "pages"))):
                ratings = {r["slot"]: Rating(*r["x"]) for r in rows or ()}
                found = wrapper(decode_tree(pivot), ratings, pages, settings)
                inside.append(sorted(found.inside))
                dropped.append(sorted(found.dropped))
                # Where constant texts make up most of a slot, the pages are copies of one another.
                texts.append([x for x in common or () if 2 * ratings[x["slot"]].constant_chars < ratings[x["slot"]].used_chars])
            lists = [pa.array(inside, pa.list_(pa.int32())), pa.array(dropped, pa.list_(pa.int32())), pa.array(texts, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("pivot"), *lists], names=["host", "pivot", "inside", "dropped", "constant"])

    rows = pivots.join(total, "host").join(rated, "host", "left").join(constant, "host", "left").select("host", "pivot", "rated", "constant", "pages")
    return rows.mapInArrow(lean(decide), "host string, pivot string, inside array<int>, dropped array<int>, constant array<struct<slot:int,text:long>>")


def _placed(known: dict, tree: str, pivot: str) -> tuple[list[int], list[bool]]:
    """`slots`, remembered for trees that come again."""
    if (tree, pivot) not in known:
        if len(known) > 2000:
            known.clear()
        known[tree, pivot] = slots(decode_tree(tree), decode_tree(pivot))
    return known[tree, pivot]


def own_wrapper(tree: list[tuple[int, str]], blocks: list[dict], s: Settings = Settings()) -> Wrapper:
    """For a page in which the host's wrapper finds nothing: what the page alone tells."""
    rated: dict[int, list[float]] = {}
    for b in blocks:
        x, n = rated.setdefault(b["node"], [0.0] * len(Rating._fields)), len(b["text"])
        for i, v in enumerate(Rating(1, 0, b["doubtful"], n, n * b["links"], 1, n, 0)):
            x[i] += v
    return wrapper(tree, {k: Rating(*v) for k, v in rated.items()}, 1, s)


def content(tree: list[tuple[int, str]], slot: list[int], own: list[bool], blocks: list[dict], found: Wrapper, constant: set[tuple[int, int]], s: Settings = Settings()) -> str:
    """The texts that the wrapper keeps, joined by an empty line."""
    kept = [b["text"] for b in blocks if found.keeps(slot[b["node"]], own[b["node"]], b["doubtful"]) and not (constant and (slot[b["node"]], digest(b["text"])) in constant)]
    if not kept and blocks:
        alone = own_wrapper(tree, blocks, s)
        kept = [b["text"] for b in blocks if alone.keeps(b["node"], True, b["doubtful"]) and not (constant and (slot[b["node"]], digest(b["text"])) in constant)]
    return "\n\n".join(kept)


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, url, text and n_chars (long): one row for each row of pages (page_id, url, html).

    text is the main content's blocks, joined by an empty line; empty if there is none or html is null or empty.
    Null or odd urls share the host "". Repeated pages count once in ratings and each keep their row; of equally
    frequent trees the greatest text is the pivot, of equally rich containers the first is entered. Pages of any
    length and depth are taken whole; an empty table gives an empty result. Other columns of pages are ignored.
    """
    parsed = materialise(parse(pages), "pages", scan=True)
    wrappers = materialise(induce(parsed, settings), "wrappers")
    return apply_wrappers(parsed, wrappers, settings)


def apply_wrappers(parsed: DataFrame, wrappers: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The result of `extract` from those of `parse` and `induce`; without a wrapper of its host a page keeps all blocks."""
    rows = parsed.join(wrappers, "host", "left").select("page_id", "url", "tree", "pivot", "inside", "dropped", "constant", "blocks")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        trees = {}
        for batch in batches:
            texts = []
            for tree, pivot, inside, dropped, constant, blocks in zip(*(batch.column(c).to_pylist() for c in ("tree", "pivot", "inside", "dropped", "constant", "blocks"))):
                if pivot is None:
                    texts.append("\n\n".join(b["text"] for b in blocks))
                    continue
                found = Wrapper(frozenset(inside), frozenset(dropped))
                texts.append(content(decode_tree(tree), *_placed(trees, tree, pivot), blocks, found, {(x["slot"], x["text"]) for x in constant or ()}, settings))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
