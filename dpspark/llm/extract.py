"""Main text of web pages by template deduction.

Over all pages of a host, tokens (elements by the path of tags and names that
leads to them, elements by their place below that, and whole blocks of text)
are grouped by their occurrence vector: how often each page has them. The vector
is a checksum that is summed up in any order, so no page's tokens are brought
together with another page's. Classes that nearly every page of the host has are
valid; their elements nest by their places into the template, whose texts go.

What the texts left over are in are slots. The main slot is the innermost
element of the template, with elements of its own, that holds most of what is
left over on the host's pages, with the headings beside the elements that lead
to it. An article that a page marks is taken as it is marked; elements and names
of navigation, adverts, forms or comments go on any page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpspark.llm.common import shared_dir, written

#: Pages a host needs for a template, and the share of them that has to have a class.
LEAST_PAGES, LEAST_SHARE, MAIN_SHARE = 5, 0.9, 0.7
BROADCAST_BYTES = 16 << 20
BROADCAST_HOSTS = 200_000
#: Tokens that a task holds before it hands them on.
ROWS = 8192

# Elements of HTML by what they mean here.
_RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|canvas|select|audio|video|xmp"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_DROPPED = frozenset("aside button dialog footer form head menu nav search".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright discussion disclaimer disqus footer form gdpr login menu modal nav navbar navigation navi newsletter notice notices notification overlay pager pagination popup promo promoted promotion related reply replies respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
#: What such a name is joined with where it names the same thing: inside an article all parts have to be of either kind.
_SHAPES = frozenset("area bar block body bottom box btn button buttons card container content count field group head header icon inline inner item items left link links list listing main mobile nested node outer panel post posts region right row section slot text thread title top unit wrap wrapper zone".split())
_LAYOUT = frozenset("has with no without".split())
_CLOSED_BY = {"p": _BLOCK - {"br"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "head": {"body"}}

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What a tag holds up to its end. A tag that another one, or the page's end, cuts short ends there, so that no character is looked at twice.
_INSIDE = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({_RAW})(?=[\s/>]){_INSIDE}>(?:.*?</\1\s*>|.*\Z)|<(/?)([a-z][^\s<>/]*)({_INSIDE})(?:>|(?=[<\"'])|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _named(attributes: str) -> tuple[set[str], bool, str, bool]:
    """(parts of class and id, whether one of these names nothing but what is dropped, role, hidden)."""
    parts, plain, role, hidden = set(), False, "", False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role":
            role = value.lower()
        elif name in ("class", "id"):
            for word in value.split():
                bits = [x.lower() for x in _PART.findall(word)]
                if not _LAYOUT.intersection(bits[:1]):
                    parts.update(bits)
                    plain |= bool(_NAMES.intersection(bits)) and all(x in _NAMES or x in _SHAPES or x.isdigit() for x in bits)
        else:
            hidden |= name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", "")
    return parts, plain, role, hidden


@dataclass
class Tree:
    """The block elements of a page in page order, the page itself first: by element its parent, tag, path and place as hashes, depth, and whether it has elements."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    path: list[int] = field(default_factory=lambda: [0])
    place: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    holds: list[bool] = field(default_factory=lambda: [False])
    _often: Counter = field(default_factory=Counter)

    def add(self, above: int, tag: str, names: set[str]) -> int:
        """A new element; of those with one name below one element, its place has the number too."""
        name = ".".join((tag, *sorted(names)))
        self._often[above, name] += 1
        self.holds[above] = True
        self.parent.append(above)
        self.tag.append(tag)
        self.path.append(_hash(f"{self.path[above]} {name}"))
        self.place.append(_hash(f"{self.place[above]} {name} {self._often[above, name]}"))
        self.depth.append(self.depth[above] + 1)
        self.holds.append(False)
        return len(self.parent) - 1


@dataclass
class Block:
    """A block of text, and the element that it is in; links: mostly links."""

    element: int
    text: str
    dropped: bool
    article: bool
    links: bool


def blocks(page: str) -> tuple[list[Block], Tree]:
    """The blocks of a page, and its elements. Takes as long as the page, however its elements nest or end."""
    out, tree, text = [], Tree(), []
    # tag, element, dropped, in an article
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    opened: Counter = Counter()
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                _, element, dropped, article = stack[-1]
                out.append(Block(element, joined, dropped, article, linked * 2 > len(joined)))
            text, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            linked += len(plain) if in_link else 0

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if m[1]:
            tag = ""
        if not tag:
            continue
        block = tag in _BLOCK
        if block:
            flush()
        if tag == "a":
            in_link = max(0, in_link + (-1 if m[2] else 1))
        if m[2]:
            if opened[tag]:
                flush()
                while True:
                    ended = stack.pop()[0]
                    opened[ended] -= 1
                    if ended == tag:
                        break
            continue
        if tag in _VOID:
            continue
        parts, plain, role, hidden = _named(m[4]) if m[4] else (set(), False, "", False)
        bad = tag in _DROPPED or role in _ROLES or hidden or plain
        if tag in ("html", "body", "main"):
            bad = hidden
        if block:
            while len(stack) > 1 and tag in _CLOSED_BY.get(stack[-1][0], ()):
                opened[stack.pop()[0]] -= 1
        elif not bad:
            continue
        above = stack[-1]
        article = above[3] or tag in ("article", "main") or role in ("article", "main")
        if tag == "header" or parts & {"header", "masthead"}:
            bad |= not article
        flush()
        stack.append((tag, tree.add(above[1], tag, parts), above[2] or bad, article))
        opened[tag] += 1
    add(page[at:])
    flush()
    return out, tree


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def text_token(path: int, text: str) -> int:
    return _hash(f"{path}\n{text}")


#: Kinds of tokens: paths of elements, texts, places of elements that hold others; and a page's own.
PATH, TEXT, PLACE, PAGE = range(4)


def _page_tokens(page: str) -> Iterator[tuple[int, int, int]]:
    """Of each token: its hash, how often the page has it, its kind."""
    found, tree = blocks(page)
    for path, n in Counter(tree.path[1:]).items():
        yield path, n, PATH
    for token, n in Counter(text_token(tree.path[b.element], b.text) for b in found).items():
        yield token, n, TEXT
    for place, holds in zip(tree.place, tree.holds, strict=True):
        if holds:
            yield place, 1, PLACE
    yield 0, 1, PAGE


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each page with its host and a number that no other page has, in batches of about ROWS."""
    types = {"host": pa.string(), "page": pa.int64(), "token": pa.int64(), "n": pa.int64(), "kind": pa.int64()}

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types.values(), strict=True)], names=list(types))

    number, rows = TaskContext.get().partitionId() << 40, []
    for batch in batches:
        for host, page in zip(batch["host"], batch["html"], strict=True):
            host = host.as_py()
            rows += [(host, number, *token) for token in _page_tokens(page.as_py())]
            number += 1
            if len(rows) >= ROWS:
                yield table(rows)
                rows = []
    yield table(rows)


def different(pages: DataFrame, folder: str) -> DataFrame:
    """(host, html): each host's different pages, once. Of pages only those that are repeated are shuffled, one for each task at most."""
    rows = pages.select("host", "html", F.xxhash64("html").alias("same"))
    copies = written(rows.groupBy("host", "same").agg(F.count("*").alias("copies")).where("copies > 1").select("host", "same"), folder, "copies")
    met = F.broadcast(copies) if copies.count() <= BROADCAST_HOSTS else copies
    once = rows.join(met, ["host", "same"], "left_anti").select("host", "html")
    return once.unionByName(rows.join(met, ["host", "same"], "left_semi").groupBy("host", "same").agg(F.first("html").alias("html")).select("host", "html"))


def templates(pages: DataFrame, folder: str) -> DataFrame:
    """(host, drop, frame): the text tokens of each host's template, and the places of its elements. Copies of a page count as one. pages: (host, html)."""
    hashed = different(pages, folder).mapInArrow(_tokens, "host string, page long, token long, n long, kind long")
    vector = F.bit_xor(F.xxhash64("page", "n")).alias("vector")
    seen = written(hashed.groupBy("host", "token", "kind").agg(F.count("*").alias("pages"), vector), folder, "tokens")
    size = seen.where(f"kind = {PAGE}").select("host", F.col("pages").alias("of")).where(f"of >= {LEAST_PAGES} AND host <> ''")
    # few hosts go to the tokens, of which a large host has very many; beyond that bound the join is shuffled
    known = seen.where(f"kind <> {PAGE}").join(F.broadcast(size) if size.count() <= BROADCAST_HOSTS else size, "host").where(F.col("pages") >= LEAST_SHARE * F.col("of"))
    # an equivalence class: tokens that the same pages have as often; a text needs another token in its class
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("token")))
    classes = known.groupBy("host", "vector").agg(of(TEXT).alias("texts"), of(PLACE).alias("places"), F.count("*").alias("size")).where("size >= 2")
    together = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    return written(classes.groupBy("host").agg(together("texts").alias("drop"), together("places").alias("frame")), folder, "templates")


def with_template(pages: DataFrame, model: DataFrame) -> DataFrame:
    """``pages`` with what is known of their host: broadcast if it is small, else shuffled."""
    size = model.agg(F.sum(sum((F.size(c) * 8 for c, t in model.dtypes if t.startswith("array")), F.length("host") + 100))).first()[0] or 0
    return pages.join(F.broadcast(model) if size <= BROADCAST_BYTES else model, "host", "left")


def left_over(found: list[Block], tree: Tree, drop: frozenset) -> list[Block]:
    """Blocks that are neither the template's nor dropped by their elements and names."""
    return [b for b in found if not b.dropped and text_token(tree.path[b.element], b.text) not in drop]


def slot_sizes(page: str, drop: frozenset, frame: frozenset) -> Iterator[tuple[int, int, int]]:
    """(place, depth, characters left over) of the template's elements on a page; of the page itself at depth 0."""
    found, tree = blocks(page)
    chars = [0] * len(tree.parent)
    for b in left_over(found, tree, drop):
        if not b.links:
            chars[b.element] += len(b.text)
    # elements come after their parents
    for k in range(len(chars) - 1, 0, -1):
        chars[tree.parent[k]] += chars[k]
    yield 0, 0, chars[0]
    for k in range(1, len(chars)):
        if chars[k] and tree.holds[k] and tree.place[k] in frame:
            yield tree.place[k], tree.depth[k], chars[k]


class _Sets:
    """The arrays of a host as sets, made once for a host of a task."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[frozenset, ...]] = {}

    def of(self, host: str, *arrays: pa.Scalar) -> tuple[frozenset, ...]:
        if host not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            self.known[host] = tuple(frozenset(a.as_py() or ()) for a in arrays)
        return self.known[host]


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Characters by host and place, added up over a task's pages."""
    sets, total = _Sets(), Counter()

    def table() -> pa.RecordBatch:
        rows = [(*k, n) for k, n in total.items()]
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["host", "place", "depth", "chars"])

    for batch in batches:
        for host, page, drop, frame in zip(batch["host"], batch["html"], batch["drop"], batch["frame"], strict=True):
            host = host.as_py()
            for place, depth, chars in slot_sizes(page.as_py(), *sets.of(host, drop, frame)):
                total[host, place, depth] += chars
        if len(total) >= ROWS:
            yield table()
    yield table()


def main_slots(pages: DataFrame, model: DataFrame, folder: str) -> DataFrame:
    """(host, drop, main): of each host's template the innermost element that holds most of what is left over."""
    rows = with_template(pages.select("host", "html"), model).where("frame IS NOT NULL")
    sizes = rows.select("host", "html", "drop", "frame").mapInArrow(_slots, "host string, place long, depth long, chars long").groupBy("host", "place", "depth").agg(F.sum("chars").alias("chars"))
    sizes = written(sizes, folder, "slots")
    most = sizes.where("depth > 0").join(sizes.where("depth = 0").select("host", F.col("chars").alias("whole")), "host").where(F.col("chars") >= MAIN_SHARE * F.col("whole"))
    inner = most.groupBy("host").agg(F.max(F.struct("depth", "place")).alias("inner")).select("host", F.col("inner.place").alias("main"))
    return written(model.select("host", "drop").join(inner, "host", "left"), folder, "main")


def main_text(page: str, drop: frozenset, main: int | None) -> str:
    """What is left of a page without its host's template and what is no article."""
    found, tree = blocks(page)
    kept = left_over(found, tree, drop)
    article = [b for b in kept if b.article]
    if article:
        return " ".join(b.text for b in article)
    kept = [b for b in kept if not b.links]
    inside, leads = [False] * len(tree.parent), [False] * len(tree.parent)
    if main is not None:
        for k in range(1, len(inside)):
            inside[k] = inside[tree.parent[k]] or tree.place[k] == main
        for k in range(len(inside) - 1, 0, -1):
            leads[tree.parent[k]] |= leads[k] or inside[k]
    slot = [b for b in kept if inside[b.element] or tree.tag[b.element] in _HEADINGS and leads[tree.parent[b.element]]]
    return " ".join(b.text for b in (slot if any(inside[b.element] for b in slot) else kept))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = _Sets()
    for batch in batches:
        texts = []
        for host, page, drop, main in zip(batch["host"], batch["html"], batch["drop"], batch["main"], strict=True):
            texts.append(main_text(page.as_py(), *sets.of(host.as_py(), drop), main.as_py()))
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    Character references are decoded; white space in a block becomes one space;
    blocks are trimmed and joined in page order by one space. Inline markup
    leaves no trace.

    A null or empty html, or one without an article, gives an empty text. Pages
    without a host (a null url too) and hosts of fewer than five different pages have
    no template; what their elements and names say still holds. Repeated rows and
    null ids are kept row by row; other columns are ignored; an empty table
    gives no row. Unclosed elements end with what holds them.
    """
    folder = shared_dir(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    model = main_slots(rows, templates(rows, folder), folder)
    return with_template(rows, model).select("page_id", "url", "host", "html", "drop", "main").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
