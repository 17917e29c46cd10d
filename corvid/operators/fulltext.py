"""Full-text search over positional postings, ranked by cover density.

A chunk's lexemes are its runs of letters and digits, lower-cased and numbered from 1 (an approximation of a database's
parser, which also knows hosts, paths and hyphenated words). A query is a set of units; a unit is a lexeme or a phrase of
lexemes that follow each other. A cover is a stretch of a chunk that satisfies the query and holds no smaller one; each
adds 0.1 / (1 + other words inside) to the score. ``any`` is satisfied by one unit, ``all`` needs every unit.

Texts are read twice: once for document frequencies, of which only counts are shuffled, and once for the postings of
lexemes that are asked for, which are written, counted and dealt by chunk to as many tasks as ``POSTINGS`` a task need. Phrases are found by joining postings on (place - offset), and covers
by running maxima within (query, side, chunk), on the same partitioning; token arrays stay in the scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.functions import text as X
from corvid.operators import ranking as R
from corvid.tables import materialise

WORD = r"[\p{L}\p{N}]+"
#: Fixed by the semantics of such indexes: the last place, places kept of a lexeme, the weight of a word.
LAST_PLACE, MOST_PLACES, WEIGHT = 16383, 256, 0.1
#: Postings of a task: what it sorts and groups stays the same however many chunks there are.
POSTINGS = 200_000


def lexemes(text: Column | str) -> Column:
    """Lexemes of a text in order."""
    x = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)), F.lower)


def phrase(term: Column) -> Column:
    """Lexemes of a query term; those of a compound follow each other in a text."""
    return F.regexp_extract_all(term, F.lit(WORD), F.lit(0))


def document_frequencies(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``lexeme, df`` of the wanted lexemes; each chunk adds one before anything is shuffled."""
    held = chunks.select(F.explode(F.array_distinct(lexemes("text"))).alias("lexeme"))
    return held.join(R.small(wanted.select("lexeme").distinct()), "lexeme", "left_semi").groupBy("lexeme").agg(F.count("*").alias("df"))


def postings(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``chunk_id, lexeme, place`` of the wanted lexemes, partitioned by chunk; at most ``MOST_PLACES`` of a lexeme."""
    # a generator of one row keeps the lexemes from being made once for each use
    found = chunks.select("chunk_id", F.explode(F.array(lexemes("text"))).alias("all")).select("chunk_id", F.posexplode("all").alias("place", "lexeme"))
    found = found.join(R.small(wanted.select("lexeme").distinct()), "lexeme", "left_semi")
    found = materialise(found.select("chunk_id", "lexeme", F.least(F.col("place") + 1, F.lit(LAST_PLACE)).alias("place")), "fts-posted")
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, math.ceil(found.count() / POSTINGS))
    found = found.repartition(tasks, "chunk_id").distinct()
    order = F.row_number().over(Window.partitionBy("chunk_id", "lexeme").orderBy("place"))
    return found.withColumn("n", order).where(F.col("n") <= MOST_PLACES).drop("n")


def unit_words(units: DataFrame) -> DataFrame:
    """``qid, side, unit, size, offset, lexeme`` of units given as arrays ``words``."""
    return units.where(F.size("words") > 0).select("qid", "side", "unit", F.size("words").alias("size"), F.posexplode("words").alias("offset", "lexeme"))


def unit_matches(posted: DataFrame, words: DataFrame) -> DataFrame:
    """``qid, side, chunk_id, unit, first, last``: where each unit stands; the words of a phrase share (place - offset)."""
    met = posted.join(R.small(words), "lexeme").withColumn("first", F.col("place") - F.col("offset"))
    one = met.where("size = 1").select("qid", "side", "chunk_id", "unit", "first", F.col("place").alias("last"))
    several = met.where("size > 1").groupBy("qid", "side", "chunk_id", "unit", "size", "first").agg(F.count("*").alias("n")).where("n = size")
    return one.unionByName(several.select("qid", "side", "chunk_id", "unit", "first", (F.col("first") + F.col("size") - 1).alias("last")))


GROUP = ["qid", "side", "chunk_id"]


def _minimal(stretches: DataFrame) -> DataFrame:
    """Distinct stretches that hold no other: the next smaller end has an earlier begin."""
    order = Window.partitionBy(*GROUP).orderBy("last", F.desc("first"))
    inside = F.max("first").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return stretches.select(*GROUP, "first", "last").distinct().withColumn("inside", inside).where(F.col("inside").isNull() | (F.col("first") > F.col("inside"))).drop("inside")


def any_covers(matches: DataFrame) -> DataFrame:
    """``qid, side, chunk_id, first, last, others``: covers where one unit suffices; they hold nothing but its words."""
    return _minimal(matches).withColumn("others", F.lit(0))


def all_covers(matches: DataFrame, posted: DataFrame, words: DataFrame) -> DataFrame:
    """``qid, side, chunk_id, first, last, others``: covers that hold every unit.

    A stretch that ends with a match begins where the least recent of the units last began; chunks without one of the units go
    before that. ``others`` are the places inside that no word of the query takes.
    """
    needed = R.small(words.groupBy("qid", "side").agg(F.collect_set("unit").alias("needed")))
    whole = matches.groupBy(*GROUP).agg(F.collect_set("unit").alias("had")).join(needed, ["qid", "side"]).where(F.size("had") == F.size("needed")).select(*GROUP, "needed")
    ends = matches.join(whole, GROUP).select(*GROUP, "unit", "first", "last", F.explode("needed").alias("other"))
    recent = Window.partitionBy(*GROUP, "other").orderBy("last").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    began = F.max(F.when(F.col("unit") == F.col("other"), F.col("first"))).over(recent)
    # a unit that has not been met yet makes the minimum null
    stretches = ends.withColumn("began", began).groupBy(*GROUP, "last").agg(F.min("began").alias("first"), F.count_if(F.col("began").isNull()).alias("missing")).where("missing = 0")
    covers = _minimal(stretches)
    own = posted.join(R.small(words.select("qid", "side", "lexeme").distinct()), "lexeme").select(*GROUP, "place").distinct()
    inside = covers.join(own, GROUP).where(F.col("place").between(F.col("first"), F.col("last"))).groupBy(*GROUP, "first", "last").agg(F.count("*").alias("n"))
    return inside.withColumn("others", F.col("last") - F.col("first") + 1 - F.col("n")).drop("n")


def cover_density(covers: DataFrame) -> DataFrame:
    """``qid, chunk_id, score``: the sum over covers, the greatest of the sides."""
    sides = covers.groupBy(*GROUP).agg(F.sum(WEIGHT / (1 + F.col("others"))).alias("score"))
    return sides.groupBy("qid", "chunk_id").agg(F.round(F.max("score"), R.DIGITS).alias("score"))


def rank(chunks: DataFrame, units: DataFrame, mode: str = "any") -> DataFrame:
    """``qid, chunk_id, score`` of the chunks that satisfy queries of ``units`` (``qid, side, unit, words``)."""
    words = materialise(unit_words(units), "fts-words")
    posted = postings(chunks, words)
    matches = unit_matches(posted, words)
    if mode == "any":
        return cover_density(any_covers(matches))
    return cover_density(all_covers(matches, posted, words))


def asked_terms(queries: DataFrame) -> DataFrame:
    """``qid, side, place, term``: prose terms, and identifier terms with separators as spaces."""
    plain = queries.select("qid", F.lit("plain").alias("side"), F.posexplode(X.query_terms("query")).alias("place", "term"))
    return plain.unionByName(queries.select("qid", F.lit("identifiers").alias("side"), F.posexplode(X.query_terms(X.split_identifiers("query"))).alias("place", "term")))


def judged_terms(queries: DataFrame, chunks: DataFrame, stopwords: list[str], max_share: float = 0.05) -> DataFrame:
    """``asked_terms`` with ``kept``: no stop word, number or version word; compounds and words that few enough chunks have."""
    asked = asked_terms(queries)
    t = F.col("term")
    df = document_frequencies(chunks, asked.where(~t.rlike(r"[_./-]")).select(t.alias("lexeme"))).withColumnRenamed("lexeme", "term")
    total = chunks.agg(F.count("*").alias("n"))
    ignored = t.isin(stopwords) | t.rlike(r"^\d+$") | t.rlike(X.IGNORED_TERM)
    keep = ~ignored & (t.rlike(r"[_./-]") | (F.col("n") == 0) | (F.coalesce("df", F.lit(0)) / F.col("n") <= max_share))
    return asked.join(df, "term", "left").crossJoin(F.broadcast(total)).select("qid", "side", "place", "term", keep.alias("kept"))


def pair_units(terms: DataFrame) -> DataFrame:
    """Each two kept prose terms that follow each other in their question, as a phrase."""
    kept = terms.where("kept and side = 'plain'").select("qid", "side", "place", "term").distinct()
    after = kept.select("qid", (F.col("place") - 1).alias("place"), F.col("term").alias("next"))
    return kept.join(after, ["qid", "place"]).select("qid", "side", F.concat_ws(" ", "term", "next").alias("unit"), F.concat(phrase(F.col("term")), phrase(F.col("next"))).alias("words"))


def query_units(terms: DataFrame) -> DataFrame:
    """Units of judged terms; a compound of the prose side is a phrase on both sides, whether it was kept or not."""
    compound = terms.where((F.col("side") == "plain") & F.col("term").rlike(r"[_./-]")).select("qid", F.lit("identifiers").alias("side"), "term")
    kept = terms.where("kept").select("qid", "side", "term").unionByName(compound).distinct()
    return kept.select("qid", "side", F.col("term").alias("unit"), phrase(F.col("term")).alias("words"))


def diagnostic(chunks: DataFrame, queries: DataFrame, stopwords: list[str], gold: DataFrame, k: int = 3) -> DataFrame:
    """What the search of each query did: both OR queries, dropped terms, matches, first ids, ranks of gold chunks (``qid, chunk_id``)."""
    terms = materialise(judged_terms(queries, chunks, stopwords), "fts-terms")
    asked = terms.where("kept").select("qid", "side", "place", "term")
    compounds = terms.where((F.col("side") == "plain") & F.col("term").rlike(r"[_./-]")).select("qid", F.lit("identifiers").alias("side"), (F.col("place") + (1 << 20)).alias("place"), "term")
    said = asked.unionByName(compounds).groupBy("qid", "side").agg(X.or_query(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda s: s["term"])).alias("q"))
    said = said.groupBy("qid").agg(F.max(F.when(F.col("side") == "plain", F.col("q"))).alias("plain_query"), F.max(F.when(F.col("side") == "identifiers", F.col("q"))).alias("identifier_query"))
    dropped = terms.where("not kept").groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("dropped_terms"))
    scored = materialise(rank(chunks, query_units(terms)), "fts-scored")
    first = R.top_k(scored, k, ["qid"], [F.desc("score"), F.asc("chunk_id")]).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]).alias("top_ids"))
    top = scored.groupBy("qid").agg(F.count("*").alias("n_matching")).join(first, "qid", "left")
    # a gold chunk may stand at any place: those before it are counted, and no query's matches are sorted as a whole
    met = gold.select("qid", "chunk_id").join(scored, ["qid", "chunk_id"]).select("qid", F.col("chunk_id").alias("gold"), F.col("score").alias("own"))
    before = (F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("chunk_id") <= F.col("gold")))
    places = scored.join(R.small(met), "qid").where(before).groupBy("qid", F.col("gold").alias("chunk_id")).agg(F.count("*").cast("int").alias("rank"))
    placed = gold.join(places, ["qid", "chunk_id"], "left").groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("chunk_id").cast("string"), "rank")))).alias("gold_ranks"))
    return queries.select("qid").join(said, "qid", "left").join(dropped, "qid", "left").join(top, "qid", "left").join(placed, "qid", "left").fillna(0, ["n_matching"])


def scores(chunks: DataFrame, queries: DataFrame, stopwords: list[str], max_share: float = 0.05) -> DataFrame:
    """``qid, chunk_id, score`` of an OR query of each question's kept terms, the greater of prose and identifiers."""
    terms = materialise(judged_terms(queries, chunks, stopwords, max_share), "fts-terms")
    return rank(chunks, query_units(terms))


def reference_density(text: str, units: list[list[str]], mode: str = "any") -> float | None:
    """Brute force over all stretches of a text, for tests; None where nothing satisfies the query."""
    import re

    found = [w.lower() for w in re.findall(r"[^\W_]+", text)]
    holds = lambda a, b, u: any(found[k : k + len(u)] == u for k in range(a, b - len(u) + 2))
    ask = any if mode == "any" else all
    good = [(a, b) for a in range(len(found)) for b in range(a, len(found)) if ask(holds(a, b, u) for u in units)]
    covers = [(a, b) for a, b in good if not any((c, d) != (a, b) and a <= c and d <= b for c, d in good)]
    own = {w for u in units for w in u}
    return sum(0.1 / (1 + sum(w not in own for w in found[a : b + 1])) for a, b in covers) if covers else None
