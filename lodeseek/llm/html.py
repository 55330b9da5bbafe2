"""Main text of pages by site style trees.

Pages of a host are merged into a style tree: an element is named by its path of tags and classes, and the tree counts
in how many pages each sequence of children (presentation) and each text (content) occurs there. Presentation
importance is the entropy of the sequences, content importance one less the entropy of texts over pages; both by
logarithms to the base of the number of pages that hold the element, so 0 is the same on every page and 1 different on
each. An element with several texts or sequences on a page has their mean. An element's importance is the larger of its
own and its branches', 0 if it is empty; branches of low importance go. What the tags and classes state
outright goes with them or stays with them: menus, forms, comments and the like are of importance 0, and where a page
marks its article, the rest of the page is. Hosts with few pages have only that to go by.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

#: Pages from which on an element of a host's tree counts, and the importance below which a branch goes.
MIN_PAGES, LOW = 5, 0.3
#: Elements of all hosts' trees that may be broadcast.
TREE_ROWS = 100_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "source", "nobr"}
_NOISE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "input", "fieldset", "head", "svg", "canvas", "audio", "video", "object", "map", "datalist"} | _RAW
_MAIN_TAGS = {"article", "main"}
_NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager "
    "header masthead footer sidebar sidebars aside widget widgets related recommended recommendations cookie cookies consent gdpr notice notices alert banner banners popup modal overlay toast "
    "comment comments commentlist disqus reply replies respond discussion share sharing social newsletter subscribe subscription signup login search form forms toolbar skip hidden print".split()
)
_NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "html", "nav", "footer", "aside", "form", "blockquote"}


class Element:
    __slots__ = ("children", "key", "main", "noise", "parent", "tag")

    def __init__(self, tag: str, parent: Element | None, name: str, main: bool, noise: bool):
        self.tag, self.parent, self.main, self.noise = tag, parent, main, noise
        self.key = zlib.crc32(name.encode("utf-8", "replace"), parent.key if parent else 0)
        self.children: list[Element | str] = []


def _words(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w]


def _element(tag: str, attributes: str, parent: Element) -> Element:
    main, noise, name = tag in _MAIN_TAGS, tag in _NOISE_TAGS, f">{tag}"
    if attributes.strip(" /\t\r\n"):
        got = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        named = [*_words(got.get("class", "")), *_words(got.get("id", ""))]
        name += "." + ".".join(sorted(set(named)))
        main |= got.get("role") in ("main", "article") or got.get("itemprop") == "articleBody"
        if not main and tag not in ("html", "body"):
            noise |= not _NOISE_WORDS.isdisjoint(named) or got.get("role") in _NOISE_ROLES or "hidden" in got or got.get("aria-hidden") == "true"
            noise |= "display:none" in got.get("style", "").replace(" ", "").lower()
    if tag == "header" and not _inside(parent):
        noise = True
    if tag == "article" and _comment(parent):
        main, noise = False, True
    return Element(tag, parent, name, main, noise)


def _inside(e: Element | None) -> bool:
    while e:
        if e.main:
            return True
        e = e.parent
    return False


def _comment(e: Element | None) -> bool:
    while e:
        if e.noise:
            return True
        e = e.parent
    return False


def parsed(page: str) -> Element:
    """The page's tree; unclosed and stray tags are repaired as browsers do in the common cases."""
    root = at = Element("", None, "", False, False)
    pos = 0
    while True:
        m = _TAG.search(page, pos)
        if not m:
            at.children.append(page[pos:])
            return root
        if m.start() > pos:
            at.children.append(page[pos : m.start()])
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            e = at
            while e.parent and e.tag != tag and not (tag in _INLINE | {"p", "li"} and e.tag in ("article", "main", "body", "td")):
                e = e.parent
            if e.tag == tag and e.parent:
                at = e.parent
            continue
        if tag not in _INLINE and tag not in _VOID:
            closing = _CLOSES.get(tag, set())
            e = at
            while e.parent and e.tag != "p" and e.tag not in closing and (e.tag in _INLINE or closing and e.tag not in _SCOPE):
                e = e.parent
            if e.parent and (e.tag == "p" or e.tag in closing):
                at = e.parent
        new = _element(tag, m[3] or m[6] or "", at)
        at.children.append(new)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
            new.noise, pos = True, end.end() if end else len(page)
        elif tag not in _VOID:
            at = new


def _flat(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def own_text(e: Element) -> str:
    """Text of the element itself and of inline elements in it."""
    out, todo = [], list(reversed(e.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag in _INLINE and not c.noise:
            todo += reversed(c.children)
        elif c.tag in ("br", "hr"):
            out.append(" ")
    return "".join(out)


def branches(e: Element) -> list[Element]:
    """The block elements right below, those in inline elements included."""
    out, todo = [], list(reversed(e.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            continue
        if c.tag not in _INLINE:
            out.append(c)
        elif not c.noise:
            todo += reversed(c.children)
    return out


def elements(root: Element) -> Iterator[Element]:
    """All block elements, a parent before its children."""
    todo = [root]
    while todo:
        e = todo.pop()
        yield e
        todo += reversed(branches(e))


def style_facts(page: str) -> list[tuple[int, int, int]]:
    """(element, kind, hash) of a page: kind 0 is a sequence of children, kind 1 a text, kind 2 the element itself."""
    out = []
    for e in elements(parsed(page)):
        out.append((e.key, 2, 0))
        kids = [c.key for c in branches(e)]
        runs = [k for i, k in enumerate(kids) if not i or kids[i - 1] != k]
        if runs:
            out.append((e.key, 0, zlib.crc32(repr(runs).encode())))
        if text := _flat(own_text(e)):
            out.append((e.key, 1, zlib.crc32(text.encode("utf-8", "replace"))))
    return out


def main_text(page: str, importance: dict[int, float] | None = None) -> str:
    """Blocks of the page's important branches, in page order, two line feeds between them.

    Of marked articles, branches of low importance go too, unless no text in them would be left.
    """
    root, seen = parsed(page), importance or {}
    kept: dict[int, float] = {}
    order = list(elements(root))
    for e in reversed(order):
        below = branches(e)
        if e.main:
            own = 1.0
        else:
            own = seen.get(e.key, 1.0) if below or _flat(own_text(e)) else 0.0
        kept[id(e)] = max([own, *(kept[id(c)] for c in below if not c.noise)])

    def read(low: float) -> list[tuple[bool, str]]:
        """Blocks, and whether they are in a main element; branches there go below ``low``."""
        blocks: list[tuple[bool, str]] = []
        pending: list[str] = []

        def flush(main: bool) -> None:
            if text := _flat("".join(pending)):
                blocks.append((main, text))
            pending.clear()

        todo: list = [(root, False, False)]
        while todo:
            e, main, leaving = todo.pop()
            if isinstance(e, str):
                pending.append(e)
            elif e.tag in ("br",):
                pending.append(" ")
            elif leaving:
                flush(main)
            elif e.noise or kept.get(id(e), 1.0) < (low if main else LOW):
                if e.tag not in _INLINE:
                    flush(main)
            elif e.tag in _INLINE:
                todo += [(c, main, False) for c in reversed(e.children)]
            else:
                flush(main)
                inside = main or e.main
                todo.append((e, inside, True))
                todo += [(c, inside, False) for c in reversed(e.children)]
        flush(False)
        return blocks

    blocks = read(LOW)
    if not any(main for main, _ in blocks) and any(e.main for e in order):
        blocks = read(0.0)  # nothing of what is marked differs between pages
    if any(main for main, _ in blocks):
        blocks = [b for b in blocks if b[0]]
    return "\n\n".join(t for _, t in blocks)


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def style_trees(pages: DataFrame) -> DataFrame:
    """host, element, importance of every element on MIN_PAGES pages of a host or more (url, html; nulls count as empty).

    Pages of a host with the same facts are copies and count once.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, codes, hashes = [], [], []
            for page in b.column(1).to_pylist():
                facts = sorted(set(style_facts(page or "")))
                names.append(hashlib.md5(repr(facts).encode()).digest())
                codes.append([element << 2 | kind for element, kind, _ in facts])
                hashes.append([h for _, _, h in facts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), pa.array(codes, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))], ["host", "page", "code", "hash"])

    rows = pages.select(_host().alias("host"), F.col("html").cast("string")).mapInArrow(task, "host string, page binary, code array<long>, hash array<long>")
    facts = rows.dropDuplicates(["host", "page"]).select("host", F.explode(F.arrays_zip("code", "hash")).alias("f"))
    facts = facts.select("host", F.shiftright("f.code", 2).alias("element"), F.col("f.code").bitwiseAND(F.lit(3)).alias("kind"), "f.hash")
    counted = facts.groupBy("host", "element", "kind", "hash").agg(F.count("*").alias("n"))
    n = F.col("n")

    def of(kind: int):
        """One less the mean, over the facts of a kind, of log c / log m, for a fact on c of the element's m pages."""
        mine = F.when(F.col("kind") == kind, n)
        return 1 - F.sum(mine * F.log(n.cast("double"))) / F.sum(mine) / F.log(F.max(F.when(F.col("kind") == 2, n)).cast("double"))

    kinds = counted.groupBy("host", "element").agg(F.max(F.when(F.col("kind") == 2, n)).alias("pages"), of(0).alias("shown"), of(1).alias("said"))
    return kinds.where(F.col("pages") >= MIN_PAGES).select("host", "element", F.coalesce(F.greatest("shown", "said"), F.lit(0.0)).alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html; other columns are ignored).

    A null html or one without article text gives an empty text; pages of null or odd urls share the empty host. Long
    pages are read whole. White space is what Unicode calls so, no-break spaces included.
    """
    trees = runtime.written(style_trees(pages), "trees")
    hosts = trees.where(F.col("importance") < LOW).groupBy(F.col("host").alias("_host")).agg(F.map_from_entries(F.collect_list(F.struct("element", "importance"))).alias("_tree"))
    if runtime.small(trees, TREE_ROWS):
        hosts = F.broadcast(hosts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page or "", dict(tree or ())) for page, tree in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host().alias("_h"))
    joined = rows.join(hosts, F.col("_h") == F.col("_host"), "left").select("page_id", "url", "html", "_tree")
    return joined.mapInArrow(task, "page_id long, url string, text string, n_chars long")


def op9_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(runtime.table(spark, sf_dir, "pages"))
