"""Main text of web pages: the template of each site is found in Spark and taken out.

Each element subtree of a page is hashed (name, attributes that style it, text, subtrees). The hashes are counted per host over
*different* articles, so that copies of one article count once; a subtree that recurs in more than ``ratio`` of a host's articles,
and in ``MIN_PAGES`` at least, belongs to the site's template and is deleted. What has a declared role is taken out on every
page: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments, by element name, role or the
words of its class and id. Of what stays, the text of the page's article elements is returned, else that of its main element,
else all; running text inside an article (paragraphs, headings, list items, cells, quotations) is never taken for template,
as articles may share passages.

Two passes over the pages; only hashes are shuffled, distinct per batch, and counted with partial aggregation, so a host
with a third of all pages is no hot group. A host has fewer than (mean subtrees of a page / ``ratio``) template subtrees; they
are gathered per host and joined by broadcast where their measured size allows it, else by a shuffle join on host and salt.

Defined results: a null page is empty; pages whose URL has no host form one host; repeated rows are extracted alike; an
empty table gives an empty table; other columns are carried along. Cells of a table are separated by spaces, rows by line feeds;
a line break is white space; elements that were never closed end where the elements around them do.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import Scratch, Shipped, free_column, returns_memory
from .line_dedup import url_host

#: Share of a host's different articles above which a recurring subtree is template, and their least number.
RATIO = 0.5
MIN_PAGES = 3
#: Largest measured size of the template table that is broadcast.
BROADCAST_BYTES = 32 << 20
SALTS = 64

# Element names and words of roles and classes below are fixed values of HTML and of common usage.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li dt dd blockquote pre tr td th thead tbody tfoot caption figcaption summary".split())
CELLS = frozenset(("td", "th"))
ROOTS = frozenset(("article", "main"))
WHOLE = frozenset(("html", "body", "article", "main"))
#: Always taken out.
GONE = frozenset("head script style noscript template iframe object embed svg canvas audio video map nav aside footer dialog menu button select textarea datalist title".split())
#: Taken out unless an article is inside.
GONE_AROUND = frozenset(("form", "fieldset", "search"))
GONE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar tablist".split())
GONE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav footer ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor "
    "sponsored promo promotion banner cookie cookies consent gdpr notice notices notification disclaimer newsletter subscribe subscription signup popup modal paywall share "
    "sharing social related recommended recommendations comment comments commentlist respond disqus replies pagination pager toolbar login".split()
)
#: Words that mark a page's head, outside its article.
HEAD_WORDS = frozenset("header masthead topbar".split())
COMMENT_WORDS = frozenset("comment comments respond disqus replies".split())
HEAD_ONLY = frozenset("head base link meta title style script noscript template".split())
#: Elements that a start tag closes if they are open, up to an element that keeps them apart.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
TABLE_SCOPE = frozenset("table td th caption".split())
TABLE_PARTS = frozenset("table td th caption tr thead tbody tfoot body html".split())
PARAGRAPH_SCOPE = frozenset("article aside blockquote body dd details dialog div dl dt figure footer form header html li main nav ol section table td th tr ul button".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z]+")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Element:
    """An open element: where its text begins in the output, and what its hash is made of."""

    __slots__ = ("name", "label", "gone", "comment", "mark", "roots", "parts", "inside")

    def __init__(self, name: str, label: str, gone: int, comment: bool, mark: int, roots: int, inside: bool) -> None:
        self.name, self.label, self.gone, self.comment, self.mark, self.roots, self.inside = name, label, gone, comment, mark, roots, inside
        self.parts: list[bytes] = []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")).lower())
    return out


def _judged(name: str, raw: str, inside: bool) -> tuple[str, int, bool]:
    """Label for the hash; 2 if the element goes, 1 if it goes unless an article is inside; whether it holds comments."""
    gone = 2 if name in GONE or (name == "header" and not inside) else 1 if name in GONE_AROUND else 0
    if not raw or not TELLING.search(raw):
        return name, gone, False
    attributes = _attributes(raw)
    styled = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    words = set(WORD.findall(styled))
    comment = bool(words & COMMENT_WORDS)
    if not gone and (name not in WHOLE or (name == "article" and comment)):
        if words & GONE_WORDS or (not inside and words & HEAD_WORDS):
            gone = 1
        elif attributes.get("role", "") in GONE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN_STYLE.search(attributes.get("style", "")):
            gone = 1
    return f"{name} {styled} {attributes.get('role', '')}", gone, comment


class Page:
    """One walk over a page's tags: text with block breaks (None), the places of its articles, and, where asked for, hashes of its subtrees."""

    def __init__(self, source: str, template: frozenset[bytes] = frozenset(), count: bool = False) -> None:
        self.template, self.hashing = template, count or bool(template)
        self.out: list[str | None] = []
        self.open: list[Element] = []
        self.regions: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
        self.subtrees: set[bytes] = set()
        at = 0
        while (m := TAG.search(source, at)) is not None:
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                self._end(name)
                continue
            self._start(name, m[3])
            if name in RAW and self.open and self.open[-1].name == name:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                self._text(source[at : stop.start() if stop else len(source)])
                at = stop.start() if stop else len(source)
        self._text(source[at:])
        while self.open:
            self._close()

    def _text(self, raw: str) -> None:
        if not raw:
            return
        if self.open and self.open[-1].name == "head" and not raw.isspace():
            self._close()
        text = html.unescape(raw) if "&" in raw else raw
        self.out.append(text)
        if self.hashing and self.open and not text.isspace():
            self.open[-1].parts.append(b"t" + " ".join(text.split()).encode("utf-8", "replace"))

    def _close_to(self, names, scope) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].name in names:
                while len(self.open) > k:
                    self._close()
                return
            if self.open[k].name in scope:
                return

    def _start(self, name: str, raw: str) -> None:
        if self.open and self.open[-1].name == "head" and name not in HEAD_ONLY:
            self._close()
        if name == "body":
            self._close_to(("head",), ("body",))
        if name in CLOSES:
            self._close_to(*CLOSES[name])
        elif name in BLOCKS:
            self._close_to(("p",), PARAGRAPH_SCOPE)
        if name in VOID:
            self.out.append(None if name == "hr" else " " if name == "br" else "")
            return
        if raw.endswith("/") and name in ("svg", "path", "circle", "rect", "use", "line", "polygon", "g"):
            return
        inside = bool(self.open) and (self.open[-1].inside or self.open[-1].name in ROOTS)
        label, gone, comment = _judged(name, raw, inside)
        if name in BLOCKS:
            self.out.append(None)
        elif name in CELLS:
            self.out.append(" ")
        self.open.append(Element(name, label, gone, comment, len(self.out), sum(map(len, self.regions.values())), inside))

    def _end(self, name: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            held = self.open[k].name
            if held == name:
                while len(self.open) > k:
                    self._close()
                return
            if name not in BLOCKS and name not in CELLS and held in BLOCKS:
                return  # an inline end tag does not close a block
            if held in TABLE_SCOPE and name not in TABLE_PARTS:
                return  # nor does one inside a table close what is around it
            if name == "p" and held in PARAGRAPH_SCOPE or name == "li" and held in ("ul", "ol"):
                return

    def _close(self) -> None:
        e = self.open.pop()
        digest = b""
        if self.hashing:
            digest = hashlib.blake2b(b"\0".join([e.label.encode("utf-8", "replace"), *e.parts]), digest_size=16).digest()
            if self.open:
                self.open[-1].parts.append(digest)
        counted = e.name not in WHOLE and e.name in BLOCKS and not (e.inside and e.name in RUNNING)
        holds_article = sum(map(len, self.regions.values())) > e.roots
        if e.gone == 2 or (e.gone or (counted and digest in self.template)) and not holds_article:
            del self.out[e.mark :]
            for places in self.regions.values():
                while places and places[-1][1] > e.mark:
                    places.pop()
        else:
            if counted and e.parts and not holds_article:
                self.subtrees.add(digest)
            if e.name in ROOTS and not (e.comment and e.inside):
                places = self.regions[e.name]
                while places and places[-1][0] >= e.mark:  # the outermost one counts
                    places.pop()
                places.append((e.mark, len(self.out)))
        if e.name in BLOCKS:
            self.out.append(None)
        elif e.name in CELLS:
            self.out.append(" ")

    def text(self) -> str:
        """Blocks of the article, else of the main element, else of the page, a line each."""
        for name in ("article", "main"):
            text = "\n".join(filter(None, (blocks(self.out[a:b]) for a, b in self.regions[name])))
            if text:
                return text
        return blocks(self.out)


def blocks(pieces: list[str | None]) -> str:
    """White space within a block is one space; blocks without text go."""
    lines, block = [], []
    for piece in [*pieces, None]:
        if piece is not None:
            block.append(piece)
        elif block:
            line = " ".join("".join(block).split())
            if line:
                lines.append(line)
            block = []
    return "\n".join(lines)


COUNTED = T.StructType([T.StructField("host", T.StringType()), T.StructField("subtree", T.BinaryType()), T.StructField("article", T.BinaryType())])


def subtree_rows(pages: DataFrame, *, source: str = "html", url: str = "url") -> DataFrame:
    """``host, subtree, article`` (hashes), distinct per batch; an empty ``subtree`` stands for the page itself."""

    def run(batches):
        for batch in batches:
            rows = {}
            for host, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(value.as_py() or "", count=True)
                article = hashlib.blake2b(page.text().encode("utf-8", "replace"), digest_size=16).digest()
                for subtree in (b"", *page.subtrees):
                    rows[host, subtree, article] = None
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)], names=COUNTED.names)

    return pages.select(url_host(F.col(url)).alias("host"), F.col(source).alias("source")).mapInArrow(returns_memory(run), COUNTED)


def templates(pages: DataFrame, *, source: str = "html", url: str = "url", ratio: float = RATIO, min_pages: int = MIN_PAGES, scratch: Scratch | None = None) -> DataFrame:
    """``host``, and the array ``subtrees`` of the hashes of its template, for hosts that have one; ``scratch`` holds the counts."""
    counted = subtree_rows(pages, source=source, url=url).distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    counted = (scratch or Scratch(pages.sparkSession, "html")).keep(counted, "subtrees")
    whole = counted.where(F.length("subtree") == 0).select(F.col("host").alias("h"), F.col("n").alias("articles"))
    found = counted.where(F.length("subtree") > 0).join(whole, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.lit(ratio) * F.col("articles"))
    return found.groupBy("host").agg(F.collect_list("subtree").alias("subtrees"))


def extract_text(pages: DataFrame, *, source: str = "html", url: str = "url", out: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with the main text in ``out`` (with underscores in front if that is taken)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    found = scratch.keep(templates(pages, source=source, url=url, ratio=ratio, min_pages=min_pages, scratch=scratch), "templates")
    scratch.clear("subtrees")
    size = found.agg(F.sum(F.size("subtrees") * 48 + 128)).first()[0] or 0
    host, subtrees, salt, added = (free_column(pages, c) for c in ("host", "subtrees", "salt", out))
    hosted = pages.withColumn(host, url_host(F.col(url)))
    known = None
    if size <= BROADCAST_BYTES:
        by_host: dict[str | None, frozenset[bytes]] = {r.host: frozenset(map(bytes, r.subtrees)) for r in found.toLocalIterator()}
        known = Shipped(spark, by_host)
        scratch.clear()
    else:
        copies = found.select(F.col("host").alias(host + "_found"), F.col("subtrees").alias(subtrees), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt + "_found"))
        salted = hosted.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        same: Column = F.col(host).eqNullSafe(F.col(host + "_found")) & (F.col(salt) == F.col(salt + "_found"))
        hosted = salted.join(copies, same, "left").drop(host + "_found", salt, salt + "_found")
    kept = [c for c in hosted.columns if c not in (host, subtrees)]

    def run(batches):
        for batch in batches:
            hosts = batch.column(0).to_pylist()
            of_row = [known.value.get(h, frozenset()) for h in hosts] if known else [frozenset(x or ()) for x in batch.column(2).to_pylist()]
            texts = [Page(v.as_py() or "", t).text() for v, t in zip(batch.column(1), of_row, strict=True)]
            arrays = [*batch.columns[2 + (known is None) :], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    fields = [*[pages.schema[c] for c in kept], T.StructField(added, T.StringType())]
    read = [F.col(host).alias("h"), F.col(source).alias("s"), *([] if known else [F.col(subtrees).alias("t")]), *[F.col(c).alias(f"c{k}") for k, c in enumerate(kept)]]
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])
    return hosted.select(*read).mapInArrow(returns_memory(run), schema).toDF(*[f.name for f in fields])


def text_report(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html", **options) -> DataFrame:
    """Per page: key, URL, main text and its code points."""
    picked = pages.select(pages[key].alias("page_id"), pages[url].alias("url"), pages[source].alias("html"))
    texts = extract_text(picked, **options)
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
