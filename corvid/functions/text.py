"""Text expressions; all are built-in functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token, stop-word and instruction patterns that decide results.
TOKEN = r"(?i)[a-z0-9]+(?:[-_/.][a-z0-9]+)*(?:\(\d+\))?"
SUPPORT_STOPWORDS = "a an the is are was were be to of in on for and or as by with it its this that from at which what how does do can have has will".split()
NEGATIONS = ["not", "no", "never", "cannot", "without", "disabled"]
INJECTION = (
    r"(?i)(?:ignore\s+(?:all|any|the|previous|prior)\s+instructions?|system\s+prompt|developer\s+message|reveal\s+(?:the|your)\s+prompt"
    r"|you\s+are\s+now\s+|fake\s+citation|citation\s+override|disregard\s+(?:all|previous)\s+|jailbreak)"
)
REFERENCE_ONLY = r"(?s)^(?:see|refer to|xref|cross-reference)\b.*$"
VERSION_MENTION = r"(?i)\b(?:postgresql[\s-]*|pg[\s-]*|version\s+|v)(\d+(?:\.\d+)*)\b"
IGNORED_TERM = r"^(?:pg|postgresql|v)[-_.]?\d+(?:[-_.]\d+)*$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokenize(text: Column | str) -> Column:
    """Whole identifiers, each followed by its parts; a plain word is its own part and so comes twice."""
    whole = F.regexp_extract_all(_c(text), F.lit(TOKEN), F.lit(0))
    parts = lambda t: F.concat(F.array(F.lower(t)), F.filter(F.split(F.lower(t), r"[-_/.()]+"), lambda p: p != ""))
    return F.flatten(F.transform(whole, lambda t: F.when(t.rlike(r"[-_/.()]"), parts(t)).otherwise(F.array(F.lower(t), F.lower(t)))))


def normalize(text: Column | str) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def spaced(text: Column | str) -> Column:
    """The words of a normalised text, without normalising it first; one that begins with white space has an empty word too."""
    return F.split(_c(text), r"(?U)\s+")


def query_terms(text: Column | str) -> Column:
    """Distinct terms in order of first use, compounds whole."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(text), F.lit(r"(?i)[a-z0-9]+(?:[_./-][a-z0-9]+)*"), F.lit(0)), F.lower))


def split_identifiers(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"[_./-]", " ")


def or_query(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), " | ")


def support_words(text: Column | str) -> Column:
    """Distinct words without stop words, for claim support."""
    found = F.transform(F.regexp_extract_all(_c(text), F.lit(r"(?U)\w+(?:\.\w+)*"), F.lit(0)), F.lower)
    return F.array_except(F.array_distinct(found), _strings(SUPPORT_STOPWORDS))


def lexical_support(claim: Column | str, evidence: Column | str) -> Column:
    """Share of the claim's words found in the evidence; 0 if an identifier, number or the polarity differs."""
    terms, source = support_words(claim), support_words(evidence)
    required = F.filter(terms, lambda t: t.contains("_") | t.rlike(r"(?U)\d"))
    negations = _strings(NEGATIONS)
    bad = (F.size(terms) == 0) | (F.size(F.array_except(required, source)) > 0) | (F.arrays_overlap(terms, negations) != F.arrays_overlap(source, negations))
    return F.when(bad, F.lit(0.0)).otherwise(F.size(F.array_intersect(terms, source)) / F.size(terms))


def has_injection(text: Column | str) -> Column:
    x = _c(text)
    return x.rlike(INJECTION) | x.contains("<|") | x.contains("|>")


def sanitize(text: Column | str) -> Column:
    """Delimiters and instructions replaced by fixed strings."""
    cut = F.replace(F.replace(_c(text), F.lit("<<<"), F.lit("[delimiter]")), F.lit(">>>"), F.lit("[delimiter]"))
    return F.regexp_replace(cut, INJECTION, "[redacted untrusted instruction]")


def sentences(text: Column | str) -> Column:
    parts = F.split(_c(text), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def claims(answer: Column | str) -> Column:
    """Atomic sentences of an answer."""
    return F.filter(F.transform(F.split(_c(answer), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def citation_markers(answer: Column | str) -> Column:
    """Numbers of bracketed markers that stand on their own, not inside words."""
    return F.regexp_extract_all(_c(answer), F.lit(r"(?U)(?<!\w)\[(\d+)\](?!\w)"), F.lit(1))


def best_sentence(text: Column | str, terms: Column) -> Column:
    """Sentence with most query terms, then the shortest, then the first."""
    parts = sentences(text)
    keyed = F.transform(parts, lambda s, i: F.struct((-F.size(F.array_intersect(F.array_distinct(tokenize(s)), terms))).alias("miss"), F.length(s).alias("n"), i.alias("i"), s.alias("s")))
    return F.coalesce(F.array_min(keyed)["s"], F.trim(_c(text)))


def windows(text: Column | str, size: int = 220, overlap: int = 35) -> Column:
    """Sliding windows of non-blank runs with the white space between them; the last stops at the end."""
    pieces = F.regexp_extract_all(_c(text), F.lit(r"(\s*\S+)"), F.lit(1))
    step = max(1, size - overlap)
    n = F.size(pieces)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step))).cast("int"))
    spans = F.transform(F.sequence(F.lit(0), last), lambda i: F.trim(F.array_join(F.slice(pieces, i * step + 1, F.lit(size)), "")))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<string>"))


def digest(*parts: Column | str) -> Column:
    """sha256 of the parts joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *[_c(p).cast("string") for p in parts]), 256)


def split_bucket(family: Column | str) -> Column:
    """0-99 from the first 8 hex digits of sha256."""
    return F.conv(F.substring(F.sha2(_c(family), 256), 1, 8), 16, 10).cast("long") % 100


def split_name(family: Column | str, refresh: bool = False) -> Column:
    """Split of a new family: 10/30/30/30, or thirds without ``blind`` when earlier assignments exist (fixed bounds)."""
    b = split_bucket(family)
    if refresh:
        return F.element_at(_strings(["train", "dev", "test"]), (b % 3 + 1).cast("int"))
    return F.when(b < 10, "blind").when(b < 40, "train").when(b < 70, "dev").otherwise("test")


def version_key(label: Column | str) -> Column:
    """Natural order of version labels: texts and numbers in turn, beginning with a text that may be empty.

    A number is compared by its digits without leading zeros, first by how many there are, so any length will do.
    """
    runs = F.split(_c(label), r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")
    number, none = lambda p: p.rlike(r"^\d+$"), F.array().cast("array<string>")
    blank = F.array(F.lit(""))
    runs = F.concat(F.when(number(F.element_at(runs, 1)), blank).otherwise(none), runs, F.when(number(F.element_at(runs, -1)), blank).otherwise(none))
    bare = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    one = lambda p: F.struct(F.when(number(p), F.length(bare(p))).otherwise(0).alias("digits"), F.when(number(p), bare(p)).otherwise(F.lower(p)).alias("text"))
    return F.transform(runs, one)


def mentioned_versions(query: Column | str, labels: Column) -> Column:
    """Labels that the query names, alone or after a product word."""
    q = _c(query)
    found = F.regexp_extract_all(q, F.lit(VERSION_MENTION), F.lit(1))
    bare = lambda v: F.regexp_replace(v, r"(?i)^(?:postgresql[\s-]*|pg[\s-]*|v)", "")
    quoted = lambda v: F.concat(F.lit(r"(?iU)(?<!\w)\Q"), v, F.lit(r"\E(?!\w)"))
    return F.array_sort(F.filter(labels, lambda v: F.regexp_like(q, quoted(v)) | F.array_contains(found, bare(v))))


def markdown_table(rows: Column) -> Column:
    """Rows of cells as lines of a pipe table with a rule under the first; short rows are padded."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    full = F.transform(rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.array_join(F.concat(F.slice(full, 1, 1), F.array(rule), F.slice(full, F.lit(2), F.size(full))), "\n")


def is_reference_only(text: Column | str) -> Column:
    low = F.lower(normalize(text))
    return (low == "") | low.rlike(REFERENCE_ONLY)


def qualifying_passage(text: Column | str, kind: Column | None = None, reference: Column | None = None) -> Column:
    """Length, kind (text or table) and not a mere reference; ``reference`` marks rows that are known to be one."""
    ok = F.length(_c(text)).between(200, 1800) & ~is_reference_only(text)
    ok = ok if kind is None else ok & kind.isin("text", "table")
    return ok if reference is None else ok & ~F.coalesce(reference, F.lit(False))


def reference_record(metadata: Column, lineage: Column) -> Column:
    """Rows known to be references: flagged, or restored from one (fixed prefix)."""
    flag = F.lower(F.coalesce(F.try_element_at(metadata, F.lit("reference_only")), F.lit("")))
    return ~flag.isin("", "false", "0") | F.startswith(lineage, F.lit("pg-section:xref-restored-"))


def embedding_text(title: Column | str, version: Column | str, path: Column) -> Column:
    return F.concat(F.lit("Document: "), _c(title), F.lit("\nProduct version: "), _c(version), F.lit("\nSection: "), F.array_join(path, " / "))
