"""Retrieval over batches of queries: sparse and dense scores, fusion, reranking, expansion.

Frames carry ids and scores only; texts join last. Scores are rounded before they order rows, so sums
that differ in their last bits after a shuffle give the same ranks. Ties go to the smaller chunk id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.functions import text as X

K1, B = 1.2, 0.75
DIGITS = 6
#: A side is broadcast only below this many rows and bytes, measured first.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes (as JSON), else as it is."""
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def top_k(scored: DataFrame, k: int, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; partial limits run before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def ranked(scored: DataFrame, k: int, score: str = "score", by: str = "qid", tie: str = "chunk_id") -> DataFrame:
    rounded = scored.withColumn(score, F.round(score, DIGITS))
    return top_k(rounded, k, [by], [F.desc(score), F.asc(tie)])


def term_counts(chunks: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``chunk_id, term, tf, length`` (and the scope columns), one tokenising pass."""
    keep = ["chunk_id", *(group or [])]
    # a generator of one row keeps the tokens from being computed once for each use
    tokens = chunks.select(*keep, F.explode(F.array(X.tokenize("text"))).alias("tokens"))
    return tokens.select(*keep, F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy(*keep, "term", "length").agg(F.count("*").alias("tf"))


def corpus_stats(chunks: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``n, avgdl`` of the corpus, or of each scope; an all-empty corpus has length 1."""
    sized = chunks.select(*(group or []), F.size(X.tokenize("text")).alias("length"))
    return sized.groupBy(*(group or [])).agg(F.count("*").alias("n"), F.avg("length").alias("avgdl")).withColumn("avgdl", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(chunks: DataFrame, queries: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``qid, chunk_id, score`` of chunks with a query term; statistics are those of ``chunks`` per scope.

    Query terms are a set and are matched to postings before anything is summed, so only postings of
    terms that are asked for are shuffled.
    """
    group = group or []
    asked = queries.select("qid", *group, F.explode(F.array_distinct(X.tokenize("query"))).alias("term"))
    wanted = small(asked.select(*group, "term").distinct())
    # the semi-join stands before the counts, so terms that nobody asks for are never shuffled
    tokens = chunks.select("chunk_id", *group, F.explode(F.array(X.tokenize("text"))).alias("tokens"))
    terms = tokens.select("chunk_id", *group, F.size("tokens").alias("length"), F.explode("tokens").alias("term")).join(wanted, [*group, "term"], "left_semi")
    postings = terms.groupBy("chunk_id", *group, "term", "length").agg(F.count("*").alias("tf"))
    frequency = postings.groupBy(*group, "term").agg(F.count("*").alias("df"))
    stats = corpus_stats(chunks, group)
    hits = postings.join(frequency, [*group, "term"]).join(small(asked), [*group, "term"])
    hits = hits.join(stats, group) if group else hits.crossJoin(F.broadcast(stats))
    tf = F.col("tf")
    part = idf(F.col("n"), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    return hits.groupBy("qid", "chunk_id").agg(F.sum(part).alias("score")).where(F.col("score") > 0)


def fuse(dense_list: DataFrame, sparse_list: DataFrame, method: str = "rrf", alpha: float = 0.5, rrf_k: int = 60) -> DataFrame:
    """Full outer join of two ranked lists by reciprocal ranks, or by weights over scores scaled to their maximum."""
    d = dense_list.select("qid", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse_list.select("qid", "chunk_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    both = d.join(s, ["qid", "chunk_id"], "full_outer")
    if method == "rrf":
        hybrid = F.coalesce(1.0 / (rrf_k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1.0 / (rrf_k + F.col("sparse_rank")), F.lit(0.0))
    else:
        hybrid = alpha * _scaled("dense_score") + (1 - alpha) * _scaled("sparse_score")
    # weighted sums of six digits have more, and may lie half way between two roundings
    digits = DIGITS if method == "rrf" else DIGITS + 3
    out = both.withColumn("hybrid_score", F.round(hybrid, digits)).withColumn("dense_score", F.coalesce("dense_score", F.lit(0.0))).withColumn("sparse_score", F.coalesce("sparse_score", F.lit(0.0)))
    return top_k(out, 2**31 - 1, ["qid"], [F.desc("hybrid_score"), F.asc("chunk_id")]).select("qid", "chunk_id", "dense_score", "sparse_score", "hybrid_score", "rank")


def _scaled(score: str) -> Column:
    """A list's scores over their maximum, negatives as 0; all 0 where the maximum is."""
    x = F.greatest(F.coalesce(F.col(score), F.lit(0.0)), F.lit(0.0))
    most = F.max(x).over(Window.partitionBy("qid"))
    return F.when(most > 0, x / most).otherwise(F.lit(0.0))


def zero_fill(fused: DataFrame, chunk_ids: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query; short lists are filled with the smallest unseen ids at score 0.

    Only the ``k`` smallest ids beyond those already listed can fill a list, so ``2k`` ids suffice.
    """
    first = chunk_ids.select("chunk_id").distinct().orderBy("chunk_id").limit(2 * k)
    fill = fused.select("qid").distinct().crossJoin(F.broadcast(first)).join(fused.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    both = fused.select("qid", "chunk_id", "hybrid_score").unionByName(fill.withColumn("hybrid_score", F.lit(0.0)))
    return top_k(both, k, ["qid"], [F.desc("hybrid_score"), F.asc("chunk_id")])


def rerank_overlap(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, top_n: int, weight: float = 0.65) -> DataFrame:
    """The first ``top_n`` by hybrid score blended with query-term overlap; the tail follows in its order.

    The blend has three digits more than the score in it, so that no product of both lies half way between two roundings.
    """
    texts = candidates.join(chunks.select("chunk_id", "text"), "chunk_id").join(small(queries.select("qid", "query")), "qid")
    terms, found = F.array_distinct(X.tokenize("query")), F.array_distinct(X.tokenize("text"))
    overlap = F.size(F.array_intersect(terms, found)) / F.greatest(F.size(terms), F.lit(1))
    head = F.col("rank") <= top_n
    scored = texts.withColumn("rerank_score", F.when(head, F.round(weight * F.col("hybrid_score") + (1 - weight) * overlap, DIGITS + 3)))
    order = [F.asc(F.when(head, 0).otherwise(1)), F.desc("rerank_score"), F.desc(F.when(head, F.col("sparse_score"))), F.asc(F.when(head, F.lit(0)).otherwise(F.col("rank"))), F.asc("chunk_id")]
    return scored.withColumn("final_rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).select("qid", "chunk_id", "hybrid_score", "rerank_score", F.col("final_rank").alias("rank"))


def expand_parents(matches: DataFrame, parents: DataFrame, k: int, decay: float = 0.95) -> DataFrame:
    """Each match is followed by its parent at ``decay`` times its score; a chunk keeps its first place."""
    own = matches.select("qid", "chunk_id", "hybrid_score", (F.col("rank") * 2).alias("place"))
    up = matches.join(parents, "chunk_id").select("qid", F.col("parent_id").alias("chunk_id"), F.round(F.col("hybrid_score") * decay, DIGITS + 3).alias("hybrid_score"), (F.col("rank") * 2 + 1).alias("place"))
    first = top_k(own.unionByName(up), 1, ["qid", "chunk_id"], [F.asc("place")], "n").drop("n")
    return top_k(first, k, ["qid"], [F.asc("place")]).drop("place")


def kept_terms(queries: DataFrame, chunks: DataFrame, stopwords: list[str], max_share: float = 0.05) -> DataFrame:
    """``qid, term, kept``: query terms after the stop list, version words, and the document-share limit."""
    asked = queries.select("qid", F.posexplode(X.query_terms("query")).alias("place", "term"))
    df = chunks.select("chunk_id", F.explode(F.array_distinct(F.concat(X.query_terms("text"), X.query_terms(X.split_identifiers("text"))))).alias("term"))
    df = df.join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.countDistinct("chunk_id").alias("df"))
    total = chunks.agg(F.count("*").alias("n"))
    t = F.col("term")
    ignored = t.isin(stopwords) | t.rlike(r"^\d+$") | t.rlike(X.IGNORED_TERM)
    keep = ~ignored & (t.rlike(r"[_./-]") | (F.col("n") == 0) | (F.coalesce("df", F.lit(0)) / F.col("n") <= max_share))
    return asked.join(df, "term", "left").crossJoin(F.broadcast(total)).select("qid", "place", "term", F.coalesce("df", F.lit(0)).alias("df"), keep.alias("kept"))
