"""Sections to chunks: texts are cut by patterns, paths and links come from windows and joins over their pieces.

A section row is one of ``SECTION``. Within a section, patterns cut a text into fenced blocks, tables and lines, and
arrays of these pieces become parts under headings, blocks and token windows; nothing leaves the row for that. Across the
sections of a (document, version), open headings are running values of windows, and parents and children are found by
joins on paths. Identities are digests of canonical JSON. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.functions import text as X
from corvid.tables import materialise

SECTION = (
    "document_id string, version string, pos int, text string, heading string, level int, section_path array<string>, page_number int, "
    "page_metadata map<string,string>, metadata map<string,string>, section_id string, parent_section_id string, source string, kind string, lineage_key string"
)
CHUNK = (
    "chunk_id string, document_id string, version string, ordinal int, kind string, text string, section_path array<string>, section_id string, lineage_key string, "
    "parent_id string, child_ids array<string>, parent_text string, page_number int, page_metadata map<string,string>, metadata map<string,string>, content_hash string"
)
# What a heading, a fence and a table's rule look like, and the names under which a mapping may give a part.
ATX = r"^\s{0,3}(#{1,6})\s+(.+?)\s*$"
RULE = r"[^\S\n]*\|?[^\S\n]*:?-{3,}:?[^\S\n]*(?:\|[^\S\n]*:?-{3,}:?[^\S\n]*)+\|?[^\S\n]*"
FENCE_MARK = r"^\s*(?:```|~~~)"
ALIASES = {"text": ("text", "content", "body"), "heading": ("heading", "title"), "section_path": ("section_path", "path"), "page_number": ("page_number", "page")}
PLAIN = ("level", "page_metadata", "metadata", "section_id", "parent_section_id", "source", "children", "lineage_key", "kind")

#: A fenced block up to the line that begins with its own mark, or to the end.
_FENCE = r"[^\S\n]*(```|~~~)[^\n]*(?:\n(?![^\S\n]*\1)[^\n]*)*+(?:\n[^\n]*\n?|\z)"
#: A line, its rule, and the rows that follow: lines with a bar.
_TABLE = rf"[^\n]*\n{RULE}(?=\n|\z)(?:\n(?=[^\n]*\|)[^\n]*)*+\n?"
_LINE = r"[^\n]*\n|[^\n]+"
#: The last paragraph of a stretch of prose, with the blank lines after it.
_CAPTION = r"(?dm)(?:^[^\n]*\S[^\n]*\n?)*+(?:^[^\S\n]*\n)*+\z"
#: Levels of headings that are told apart; deeper ones count as the deepest.
DEPTH = 8


# --- identity -----------------------------------------------------------------------------------
def canonical(**parts: Column) -> Column:
    """JSON of the parts with sorted names and no spaces; control characters are escaped in lower case."""
    out = F.to_json(F.struct(*[parts[name].alias(name) for name in sorted(parts)]))
    odd = out
    for digit in "ABCDEF":
        odd = F.regexp_replace(odd, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return F.when(out.rlike(r"\\u00[01][A-F]"), odd).otherwise(out)


def sha(**parts: Column) -> Column:
    return F.sha2(canonical(**parts), 256)


def _hashed(prefix: str, **parts: Column) -> Column:
    return F.concat(F.lit(prefix), sha(**parts))


def content_identity(text: Column, kind: Column | None = None) -> Column:
    """Digest of kind and text; line ends count as one."""
    return sha(kind=F.lit("text") if kind is None else kind, text=F.replace(text, F.lit("\r\n"), F.lit("\n")))


def sections_identity(sections: DataFrame) -> DataFrame:
    """``document_id, version, identity``: digest of the digests of a document's sections in order, over all that decides chunks."""
    kept = ("heading", "level", "page_number", "page_metadata", "metadata", "section_id", "parent_section_id", "source", "kind", "lineage_key", "section_path")
    one = sha(**{c: F.col(c) for c in kept}, text=F.regexp_replace("text", "\r\n?", "\n"))
    rows = sections.select("document_id", "version", "pos", one.alias("h")).groupBy("document_id", "version").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("all"))
    return rows.select("document_id", "version", F.sha2(F.array_join(F.col("all.h"), "\n"), 256).alias("identity"))


# --- sections -----------------------------------------------------------------------------------
def _strings(value: Column) -> Column:
    """A JSON list of strings, or one string, as an array; null is empty."""
    listed = F.from_json(value, "array<string>")
    return F.when(value.isNull(), F.array().cast("array<string>")).when(F.startswith(value, F.lit("[")) & listed.isNotNull(), listed).otherwise(F.array(value))


def coerce_sections(raw: DataFrame, column: str = "section") -> DataFrame:
    """Rows of ``SECTION`` from ``document_id, version, pos`` and a JSON mapping of any of the accepted shapes.

    The first alias that is there counts; keys that are not known become metadata, unless the mapping's own metadata has them.
    """
    m = F.col("m")
    known = F.array(*[F.lit(k) for k in [*[a for names in ALIASES.values() for a in names], *PLAIN]])

    def part(name: str) -> Column:
        held = [F.when(F.map_contains_key(m, F.lit(a)), F.struct(m[a].alias("v"))) for a in ALIASES[name]]
        return F.coalesce(*held)["v"]

    flat = lambda name: F.coalesce(F.from_json(m[name], "map<string,string>"), F.create_map().cast("map<string,string>"))
    own = flat("metadata")
    more = F.map_filter(m, lambda k, _: ~F.array_contains(known, k) & ~F.map_contains_key(own, k))
    source = F.when(F.startswith(m["source"], F.lit("{")), F.coalesce(F.get_json_object(m["source"], "$.uri"), F.lit(""))).otherwise(m["source"])
    columns = {
        "text": F.coalesce(part("text"), F.lit("")), "heading": part("heading"), "level": F.coalesce(m["level"].cast("int"), F.lit(0)), "section_path": _strings(part("section_path")),
        "page_number": part("page_number").cast("int"), "page_metadata": flat("page_metadata"), "metadata": F.map_concat(own, more), "section_id": m["section_id"],
        "parent_section_id": m["parent_section_id"], "source": source, "kind": F.coalesce(F.nullif(m["kind"], F.lit("")), F.lit("text")), "lineage_key": m["lineage_key"],
    }
    read = raw.select("document_id", "version", F.col("pos").cast("int").alias("pos"), F.from_json(column, "map<string,string>").alias("m"))
    return read.select("document_id", "version", "pos", *[columns[c].alias(c) for c in [f.split(" ")[0] for f in SECTION.split(", ")[3:]]])


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _pieces(text: Column, pattern: str) -> Column:
    """All of a text, cut by a pattern; line ends other than a line feed count as one."""
    return F.regexp_extract_all(F.regexp_replace(text, r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", "\n"), F.lit(pattern), F.lit(0))


def _bound(x: Column, use) -> Column:
    """``use(x)`` with ``x`` computed once."""
    return F.transform(F.array(x), use)[0]


def heading_parts(text: Column, heading: Column, level: Column) -> Column:
    """``heading, level, text`` of a section's parts: itself if it has a heading or no line is one, else what is under each line.

    Lines inside fences are no headings; a heading without a body stands for itself, and a beginning without text goes.
    """
    bare = lambda x: F.regexp_replace(x, r"\n$", "")
    is_heading = lambda x: x.contains("#") & ~x.rlike(FENCE_MARK) & bare(x).rlike(ATX)
    whole = F.array(F.struct(heading.alias("heading"), level.alias("level"), text.alias("text")))

    def cut(pieces: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(pieces)), lambda i: (i < F.size(pieces)) & is_heading(F.get(pieces, i)))

        # what a step uses more than once is an element of the step before: an expression in a function is computed at each use
        def parts_of(starts: Column) -> Column:
            def part(start: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(starts, k + 1), F.size(pieces))
                body = _bare(F.array_join(F.slice(pieces, start + 2, F.greatest(stop - start - 1, F.lit(0))), ""))
                return F.struct(F.when(start >= 0, bare(F.get(pieces, start))).alias("line"), body.alias("body"))

            def titled(p: Column) -> Column:
                title = _bare(F.regexp_extract(p["line"], ATX, 2))
                return F.struct(title.alias("heading"), F.when(p["line"].isNull(), level).otherwise(F.length(F.regexp_extract(p["line"], ATX, 1))).alias("level"), F.when(p["body"] == "", F.coalesce(title, F.lit(""))).otherwise(p["body"]).alias("text"))

            return F.filter(F.transform(F.transform(starts, part), titled), lambda p: (p["text"] != "") | p["heading"].isNotNull())

        parts = _bound(F.concat(F.array(F.lit(-1)), at), parts_of)
        return _bound(parts, lambda found: F.when(F.size(found) > 0, found).otherwise(whole))

    return F.when(heading.isNotNull() | ~text.rlike(r"(?m)^[^\S\n]{0,3}#{1,6}[^\S\n]+[^\n]"), whole).otherwise(_bound(_pieces(text, f"{_FENCE}|{_LINE}"), cut))


def _windowed(text: Column, size: int | None, overlap: int) -> Column:
    """Token windows of prose without white space at their ends; all of it where there is no size."""
    if size is None:
        return F.filter(F.array(_bare(text)), lambda x: x != "")
    return F.transform(X.windows(text, size, overlap), _bare)


def structured_windows(text: Column, kind: Column, size: int | None, overlap: int) -> Column:
    """``kind, text`` of a text's windows in order: prose cut to size, tables with the paragraph before them and fenced blocks whole.

    Texts of another kind than prose stay whole; without structure a text is one stretch of prose.
    """
    item = lambda k, x: F.struct(k.alias("kind"), x.alias("text"))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    prose = lambda x: F.transform(_windowed(x, size, overlap), lambda w: item(F.lit("text"), w))
    is_code = lambda x: (x.contains("```") | x.contains("~~~")) & x.rlike(FENCE_MARK)
    is_table = lambda x: x.contains("---") & ~is_code(x) & x.rlike(rf"^[^\n]*\n{RULE}(?:\n|\z)")

    def cut(pieces: Column) -> Column:
        found = F.filter(F.sequence(F.lit(0), F.size(pieces)), lambda i: (i < F.size(pieces)) & (is_code(F.get(pieces, i)) | is_table(F.get(pieces, i))))

        def blocks_of(at: Column) -> Column:
            def block(stop: Column, k: Column) -> Column:
                start, piece = F.coalesce(F.get(at, k - 1) + 1, F.lit(0)), F.get(pieces, stop)

                def with_prose(before: Column) -> Column:
                    def with_caption(caption: Column) -> Column:
                        left = F.substring(before, F.lit(1), F.length(before) - F.length(caption))
                        own = F.array(item(F.when(is_code(piece), "code").otherwise("table"), _bare(F.concat(caption, piece))))
                        return F.concat(prose(left), F.when(piece.isNull(), none).otherwise(own))

                    return _bound(F.when(is_table(piece), F.regexp_extract(before, _CAPTION, 0)).otherwise(""), with_caption)

                return _bound(F.array_join(F.slice(pieces, start + 1, stop - start), ""), with_prose)

            return F.flatten(F.transform(F.concat(at, F.array(F.size(pieces))), block))

        return _bound(found, blocks_of)

    whole = F.when(_bare(text) == "", none).otherwise(F.array(item(kind, _bare(text))))
    plain = ~text.rlike("```|~~~|-{3,}")
    return F.when(kind != "text", whole).when(plain, prose(text)).otherwise(_bound(_pieces(text, f"{_FENCE}|{_TABLE}|{_LINE}"), cut))


DOCUMENT = ["document_id", "version"]


def _paths(parts: DataFrame) -> DataFrame:
    """``parts`` with ``path``: a part's own path, which also closes all headings, or the headings that are open at it.

    A heading is open until one of its level or above comes; of an own path those entries stay that no later heading has closed.
    """
    order = Window.partitionBy(*DOCUMENT).orderBy("o")
    own = F.filter(F.coalesce("section_path", F.array().cast("array<string>")), lambda p: _bare(p) != "")
    resets = F.size(F.coalesce("section_path", F.array().cast("array<string>"))) > 0
    level = F.when(~resets & (F.col("heading") != ""), F.least(F.coalesce(F.nullif(F.col("level"), F.lit(0)), F.lit(1)), F.lit(DEPTH)))
    rows = parts.withColumn("_era", F.sum(resets.cast("int")).over(order)).withColumn("_level", level)
    w = Window.partitionBy(*DOCUMENT, "_era").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    base = F.first(F.when(resets, own), ignorenulls=True).over(w)
    least = F.min("_level").over(w)
    held = []
    for d in range(1, DEPTH + 1):
        last = F.last(F.when(F.col("_level") == d, F.struct("o", _bare(F.col("heading")).alias("t"))), ignorenulls=True).over(w)
        closed = F.max(F.when(F.col("_level") < d, F.col("o"))).over(w)
        held.append(F.when(closed.isNull() | (last["o"] > closed), last["t"]))
    none = F.array().cast("array<string>")
    kept = F.slice(F.coalesce(base, none), F.lit(1), F.coalesce(least - 1, F.lit(2**31 - 1)))
    return rows.withColumn("path", F.concat(kept, F.array_compact(F.array(*held)))).drop("_era", "_level")


def page_of(number: Column, metadata: Column) -> Column:
    """Page number: the section's own, else that of its metadata if it is a positive number."""
    held = [F.when(F.try_element_at(metadata, F.lit(k)).rlike(r"^\d+$"), F.nullif(F.try_element_at(metadata, F.lit(k)).cast("int"), F.lit(0))) for k in ("page_number", "page")]
    return F.coalesce(number, *held)


def chunk_sections(sections: DataFrame, size: int = 200, overlap: int = 20) -> DataFrame:
    """Rows of ``CHUNK`` of every (document, version), in the order of ``pos``.

    A chunk's parent is the first chunk of the nearest path above it whose last section comes before it; a parent's
    children are the first chunks of the sections right below it.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller than it")
    columns = [f.split(" ")[0] for f in SECTION.split(", ")]
    cut = sections.select(*columns, F.posexplode(heading_parts(F.coalesce("text", F.lit("")), F.col("heading"), F.coalesce("level", F.lit(0)))).alias("part", "p"))
    parts = cut.select(*[c for c in columns if c not in ("text", "heading", "level")], "part", "p.heading", "p.level", "p.text").withColumn("o", F.row_number().over(Window.partitionBy(*DOCUMENT).orderBy("pos", "part")))
    rows = _paths(parts).withColumn("n", F.row_number().over(Window.partitionBy(*DOCUMENT, "path").orderBy("o")) - 1)
    shown = F.when((_bare(F.col("text")) == "") & (F.coalesce("heading", F.lit("")) != ""), F.col("heading")).otherwise(F.col("text"))
    names = {"document_id": F.col("document_id"), "section_path": F.col("path"), "occurrence": F.col("n")}
    rows = rows.withColumns({
        "text": shown,
        "section_id": F.coalesce(F.nullif("section_id", F.lit("")), _hashed("section-", version=F.col("version"), **names)),
        "lineage_key": F.coalesce(F.nullif("lineage_key", F.lit("")), _hashed("lineage-", **names)),
    }).withColumn("windows", structured_windows(F.col("text"), F.coalesce(F.nullif("kind", F.lit("")), F.lit("text")), size, overlap))
    chunk = lambda index, text: _hashed("chunk-", document_id=F.col("document_id"), version=F.col("version"), section_path=F.col("path"), section_id=F.col("section_id"), chunk_index=index, text=text)
    rows = rows.withColumn("first", F.when(F.size("windows") > 0, chunk(F.lit(0), F.get("windows", F.lit(0))["text"])))
    rows = materialise(rows.drop("n", "part"), "sections")  # read four times below
    narrow = rows.select(*DOCUMENT, "path", "o", "first")
    # of each path the last section stands for it
    heads = narrow.groupBy(*DOCUMENT, F.col("path").alias("above")).agg(F.max("o").alias("head_o"), F.max_by("first", "o").alias("head")).where("head is not null")
    up = narrow.where(F.size("path") > 1).select(*DOCUMENT, "o", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k"), "path").withColumn("above", F.slice("path", F.lit(1), F.col("k")))
    parents = up.join(heads, [*DOCUMENT, "above"]).where("head_o < o").groupBy(*DOCUMENT, "o").agg(F.max_by("head", "k").alias("parent"))
    below = narrow.where((F.size("path") > 0) & F.col("first").isNotNull()).withColumn("above", F.slice("path", F.lit(1), F.size("path") - 1))
    children = below.join(heads, [*DOCUMENT, "above"]).groupBy(*DOCUMENT, F.col("head_o").alias("o")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("o", "first"))), lambda c: c["first"])).alias("children"))
    linked = rows.join(parents, [*DOCUMENT, "o"], "left").join(children, [*DOCUMENT, "o"], "left")
    out = linked.select("*", F.posexplode("windows").alias("index", "w"))
    return out.select(
        chunk(F.col("index"), F.col("w.text")).alias("chunk_id"), *DOCUMENT, (F.row_number().over(Window.partitionBy(*DOCUMENT).orderBy("o", "index")) - 1).alias("ordinal"), "w.kind", "w.text",
        F.col("path").alias("section_path"), "section_id", "lineage_key", F.coalesce("parent", "parent_section_id").alias("parent_id"),
        F.when(F.col("index") == 0, F.coalesce("children", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("child_ids"),
        F.col("text").alias("parent_text"), page_of(F.col("page_number"), F.col("metadata")).alias("page_number"), "page_metadata", "metadata", content_identity(F.col("w.text"), F.col("w.kind")).alias("content_hash"),
    )


def link_children(chunks: DataFrame) -> DataFrame:
    """Chunks with ``parent_row``, the row id of their parent: the back-fill of a store, by a self-join."""
    rows = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("id").alias("parent_row"))
    return chunks.join(rows, "parent_id", "left")


def nearest_ancestor(paths: DataFrame, represented: DataFrame) -> DataFrame:
    """``key, ancestor``: for each path the longest proper prefix that is represented (``path, ancestor``)."""
    up = paths.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda n: F.struct(n.alias("n"), F.slice("path", F.lit(1), n).alias("path")))).alias("p"), F.size("path").alias("size"))
    up = up.where("p.n < size").select("key", "p.n", "p.path")
    return up.join(represented, "path").groupBy("key").agg(F.max_by("ancestor", "n").alias("ancestor"))


def rechunk(chunks: DataFrame, size: int, overlap: int = 20) -> DataFrame:
    """Chunks made anew from the section texts that chunks keep: one section for each section id, in order."""
    first = chunks.groupBy("document_id", "version", "section_id").agg(F.min_by(F.struct("ordinal", "parent_text", "section_path", "page_number", "page_metadata", "metadata", "lineage_key", "kind"), "ordinal").alias("s"))
    kind = F.when(F.col("s.kind") == "text", "text").otherwise(F.lit("text"))
    rows = first.select("document_id", "version", F.col("s.ordinal").alias("pos"), F.col("s.parent_text").alias("text"), F.lit(None).cast("string").alias("heading"), F.lit(0).alias("level"), F.col("s.section_path").alias("section_path"), F.col("s.page_number").alias("page_number"), F.col("s.page_metadata").alias("page_metadata"), F.col("s.metadata").alias("metadata"), "section_id", F.lit(None).cast("string").alias("parent_section_id"), F.lit(None).cast("string").alias("source"), kind.alias("kind"), F.col("s.lineage_key").alias("lineage_key"))
    return chunk_sections(rows, size, overlap)


def corpus_metrics(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Sections, chunks, tables and code blocks of each group."""
    count = lambda k: F.sum((F.col("kind") == k).cast("long"))
    return chunks.groupBy(*by).agg(F.countDistinct("section_id").alias("sections"), F.count("*").alias("chunks"), count("table").alias("tables"), count("code").alias("code"))
