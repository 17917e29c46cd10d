"""Line dedup by site-relative frequency.

Pages are grouped by host. A line is boilerplate on a host if the pages of the host that contain it
number at least ``min_pages`` and exceed ``max_ratio`` of the host's pages; its occurrences there are
dropped. Lines are compared after trimming; blank lines are never boilerplate. A page counts once
for a line that it repeats.

With ``long_words``, a line of at least that many words is boilerplate on a host as soon as ``min_pages``
of its pages contain it: a long passage does not recur by chance, however large the host is.

Lines are counted by host and 128 bits of hash with partial aggregation, so a host that holds a third
of all pages is summed on the map side. A host has fewer than (mean lines of a page / ``max_ratio``)
boilerplate lines; they are gathered per host and joined to the pages, by broadcast where their
measured size allows it, else by a shuffle join on host and salt. Repeated long lines have no such bound,
so they are gathered per text, not per host.

Defined results: a null text stays null; a page of nothing but boilerplate stays with an empty text;
null hosts form one host; repeated rows are separate pages; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import free_column

MAX_RATIO = 0.1
MIN_PAGES = 3
#: Words from which a line is a passage that no ratio protects, where that rule is asked for.
LONG_WORDS = 50
#: Largest measured size of the boilerplate table that is broadcast.
BROADCAST_BYTES = 32 << 20
SALTS = 64


def url_host(url: Column | str) -> Column:
    """Host of a URL, lower-cased; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def html_lines(html: Column | str) -> Column:
    """Text of an HTML page with a line for each block element; scripts, styles and comments go."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<(?:br|/?(?:p|div|li|ul|ol|nav|article|section|header|footer|table|tr|h[1-6]|title))\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _keys(lines: Column) -> Column:
    """Distinct 128-bit keys of the trimmed lines that are not blank."""
    trimmed = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(trimmed, _key))


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(pages: DataFrame, *, text: str = "text", host: str = "host", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host``, and the array ``keys`` of its boilerplate lines, for hosts that have any."""
    hosted = pages.select(F.col(host).alias("host"), F.split(F.col(text), "\n").alias("lines"))
    totals = hosted.groupBy("host").agg(F.count("*").alias("pages"))
    lines = hosted.select("host", F.explode(_keys(F.col("lines"))).alias("key")).select("host", "key.a", "key.b")
    counted = lines.groupBy("host", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return (
        counted.withColumnRenamed("host", "h")
        .join(totals, F.col("h").eqNullSafe(F.col("host")))
        .where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list(F.struct("a", "b")).alias("keys"))
    )


def _sited(host: Column, text: Column) -> Column:
    """128-bit key of a host, which may be null, and a text."""
    return F.struct(F.xxhash64(host.isNull(), host, text).alias("a"), F.xxhash64(F.lit(1), host.isNull(), host, text).alias("b"))


def _is_long(line: Column, words: int) -> Column:
    """Whether a line has ``words`` words; they need ``2 * words - 1`` characters, which is tested first."""
    return (F.length(line) >= 2 * words - 1) & (F.regexp_count(line, F.lit(r"\S+")) >= words)


def long_boilerplate(pages: DataFrame, long_words: int, *, text: str = "text", host: str = "host", min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_a, page_b`` (key of host and text), and the array ``keys`` of its long lines on ``min_pages`` pages of the host."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: _is_long(x, long_words))
    keys = F.array_distinct(F.transform(lines, lambda x: _sited(F.col(host), x)))
    rows = pages.select(_sited(F.col(host), F.col(text)).alias("page"), F.explode(keys).alias("key")).select("page", "key.a", "key.b")
    repeated = rows.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("a", "b").persist()
    rows = rows.distinct()
    if repeated.count() * 32 <= BROADCAST_BYTES:
        found = rows.join(F.broadcast(repeated), ["a", "b"])
    else:
        copies = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        found = rows.withColumn("salt", F.pmod(F.col("page.a"), F.lit(SALTS))).join(copies, ["a", "b", "salt"])
    per_page = found.groupBy("page").agg(F.collect_list(F.struct("a", "b")).alias("keys"))
    return per_page.select(F.col("page.a").alias("page_a"), F.col("page.b").alias("page_b"), "keys")


def _attached(pages: DataFrame, found: DataFrame, same: Column, size: int) -> DataFrame:
    """Left join to ``found``, by broadcast or by a salt, as many pages may have one host or one text."""
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(found), same, "left")
    salt = free_column(pages, "salt")
    salted = pages.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = found.withColumn(salt + "_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, same & (F.col(salt) == F.col(salt + "_copy")), "left")


def drop_boilerplate(pages: DataFrame, *, text: str = "text", host: str = "host", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, dropped: str | None = None, long_words: int | None = None) -> DataFrame:
    """``pages`` without the boilerplate lines of their hosts; ``dropped`` names a column for their number."""
    found = boilerplate(pages, text=text, host=host, max_ratio=max_ratio, min_pages=min_pages).persist()
    size = found.agg(F.sum(16 * F.size("keys") + 64)).first()[0] or 0
    h, keys = (free_column(pages, c) for c in ("found_host", "found_keys"))
    found = found.select(F.col("host").alias(h), F.col("keys").alias(keys))
    joined = _attached(pages, found, F.col(host).eqNullSafe(F.col(h)), size)
    lines = F.split(F.col(text), "\n")
    gone_by = lambda x: F.coalesce(F.array_contains(F.col(keys), _key(F.trim(x))), F.lit(False))
    untouched = F.col(keys).isNull() | F.col(text).isNull()
    is_gone = gone_by
    if long_words:
        a, b, long_keys = (free_column(pages, c) for c in ("page_a", "page_b", "long_keys"))
        long = long_boilerplate(pages, long_words, text=text, host=host, min_pages=min_pages).persist()
        size = long.agg(F.sum(16 * F.size("keys") + 64)).first()[0] or 0
        long = long.select(F.col("page_a").alias(a), F.col("page_b").alias(b), F.col("keys").alias(long_keys))
        page = _sited(F.col(host), F.col(text))
        joined = _attached(joined, long, (page["a"] == F.col(a)) & (page["b"] == F.col(b)), size)
        is_gone = lambda x: gone_by(x) | F.coalesce(F.array_contains(F.col(long_keys), _sited(F.col(host), F.trim(x))), F.lit(False))
        untouched = (F.col(keys).isNull() & F.col(long_keys).isNull()) | F.col(text).isNull()
    kept = F.filter(lines, lambda x: ~is_gone(x))
    cleaned = F.when(untouched, F.col(text)).otherwise(F.array_join(kept, "\n"))
    out = [cleaned.alias(text) if c == text else F.col(c) for c in pages.columns]
    if dropped:
        gone = F.when(untouched, F.lit(0)).otherwise(F.size(lines) - F.size(kept))
        out.append(gone.cast("long").alias(dropped))
    return joined.select(*out)


def line_report(pages: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "host", **options) -> DataFrame:
    """Per page: lines, lines dropped, and the digest of the text that stays."""
    counted = pages.select(key, host, text, F.coalesce(F.size(F.split(F.col(text), "\n")), F.lit(0)).cast("long").alias("n_lines"))
    counted = counted.withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
    cleaned = drop_boilerplate(counted, text=text, host=host, dropped="n_dropped", **options)
    return cleaned.select(key, "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("text_sha256"))


#: DuckDB SQL for ``line_report`` over ``documents`` with ``source`` as the host.
REPORT_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
exploded AS (SELECT row_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM docs),
totals AS (SELECT source, count(*) AS pages FROM docs GROUP BY source),
counted AS (
  SELECT source, trim(line, ' ') AS line, count(DISTINCT row_id) AS n FROM exploded
  WHERE trim(line, ' ') <> '' GROUP BY ALL
),
bad AS (
  SELECT c.source, c.line FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {MIN_PAGES} AND c.n > CAST({MAX_RATIO} AS DOUBLE) * t.pages
),
marked AS (
  SELECT e.row_id, e.line, e.place, b.line IS NOT NULL AS gone
  FROM exploded e LEFT JOIN bad b ON e.source IS NOT DISTINCT FROM b.source AND trim(e.line, ' ') = b.line
),
cleaned AS (
  SELECT row_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY row_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_dropped, 0)::BIGINT AS n_dropped,
       length(c.text)::BIGINT AS kept_chars, sha256(c.text) AS text_sha256
FROM docs d LEFT JOIN cleaned c USING (row_id)
"""
