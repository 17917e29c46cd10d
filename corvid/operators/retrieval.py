"""Staged retrieval for batches of requests: filters, scopes, searches, fusion, reranking, expansion, traces.

A request row has ``qid, query, embedding`` and the filters ``principal, groups, document_ids,
product_version, scopes, metadata`` (see ``REQUEST``). Requests with the same filters share a signature,
and everything that depends on filters alone (what may be read, corpus statistics) is made once a
signature over (document, version) units, not once a query and chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.functions import text as X
from corvid.functions import vectors as V
from corvid.operators import access as A
from corvid.operators import nearest as M
from corvid.operators import postings as B
from corvid.operators import ranking as R
from corvid.tables import materialise

REQUEST = "qid long, query string, embedding array<double>, principal string, groups array<string>, document_ids array<string>, product_version string, scopes array<struct<document_id:string,version:string>>, metadata map<string,string>"
FILTERS = ["principal", "groups", "document_ids", "product_version", "scopes", "metadata"]
UNIT = ["document_id", "version"]


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


# --- filters ------------------------------------------------------------------------------------
def with_signature(requests: DataFrame) -> DataFrame:
    """Requests with ``sig``, equal for equal filters; groups and ids are sets."""
    parts = [
        F.coalesce(F.col("principal"), F.lit("\x00")),
        F.array_join(F.array_sort(F.array_distinct(F.coalesce("groups", _empty("string")))), "\x1f"),
        F.array_join(F.array_sort(F.array_distinct(F.coalesce("document_ids", _empty("string")))), "\x1f"),
        F.coalesce(F.col("product_version"), F.lit("\x00")),
        F.coalesce(F.array_join(F.transform(F.array_sort(F.array_distinct("scopes")), lambda s: F.concat_ws("\x1d", s["document_id"], s["version"])), "\x1f"), F.lit("\x00")),
        F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("\x1d", e["key"], e["value"])), "\x1f"), F.lit("")),
    ]
    return requests.withColumn("sig", F.sha2(F.concat_ws("\x1e", *parts), 256))


def in_documents(ids: Column | str, document_id: Column | str = "document_id") -> Column:
    """Whether the document is one of ``ids``; null or no ids mean every document."""
    ids, document_id = (F.col(x) if isinstance(x, str) else x for x in (ids, document_id))
    return ids.isNull() | (F.size(ids) == 0) | F.array_contains(ids, document_id)


def in_scopes(scopes: Column | str, document_id: Column | str = "document_id", version: Column | str = "version") -> Column:
    """Whether (document, version) is one of ``scopes``; null scopes mean every one, an empty list none."""
    scopes, document_id, version = (F.col(x) if isinstance(x, str) else x for x in (scopes, document_id, version))
    return scopes.isNull() | F.exists(scopes, lambda s: (s["document_id"] == document_id) & (s["version"] == version))


def has_metadata(asked: Column | str, metadata: Column | str = "metadata", page_metadata: Column | str = "page_metadata") -> Column:
    """Whether every asked key has the asked value; a page's entry stands before the chunk's, also if it is null."""
    asked, metadata, page = (F.col(x) if isinstance(x, str) else x for x in (asked, metadata, page_metadata))
    held = lambda k: F.when(F.coalesce(F.map_contains_key(page, k), F.lit(False)), F.try_element_at(page, k)).otherwise(F.try_element_at(metadata, k))
    return asked.isNull() | F.forall(F.map_entries(asked), lambda e: F.coalesce(held(e["key"]) == e["value"], F.lit(False)))


def scope_matches(product_version: Column, scopes: Column) -> Column:
    """Whether a chunk survives a resolved scope."""
    return F.coalesce(product_version == F.col("version"), product_version.isNull()) & in_scopes(scopes)


def eligible_units(signatures: DataFrame, units: DataFrame, grants: DataFrame) -> DataFrame:
    """``sig, document_id, version`` that a signature may read and asks for.

    ``grants``: ``document_id, version, kind, grantee`` rows. Grants are met by equi-joins; the filters on ids
    and versions then only compare columns of the joined row.
    """
    asked = signatures.select("sig", *FILTERS).dropDuplicates(["sig"])
    keyed = grants.select(F.struct(*UNIT).alias("unit"), "kind", "grantee")
    who = asked.select(F.col("sig").alias("requester"), "principal", F.coalesce("groups", _empty("string")).alias("groups"))
    seen = A.visible(keyed, who, "unit").select(F.col("requester").alias("sig"), "unit.*")
    kept = seen.join(R.small(asked.select("sig", "document_ids", "product_version", "scopes")), "sig")
    kept = kept.where(in_documents("document_ids") & scope_matches(F.col("product_version"), F.col("scopes")))
    return kept.select("sig", *UNIT).join(units.select(*UNIT).distinct(), UNIT, "left_semi")


def eligible_chunks(chunks: DataFrame, units: DataFrame, signatures: DataFrame) -> DataFrame:
    """``sig`` and the columns of the chunks that each signature reaches, metadata filters included."""
    asked = signatures.select("sig", F.col("metadata").alias("_asked")).dropDuplicates(["sig"])
    rows = chunks.join(units, UNIT).join(R.small(asked), "sig")
    return rows.where(_metadata_ok(chunks)).drop("_asked")


def _metadata_ok(chunks: DataFrame) -> Column:
    none = F.lit(None).cast("map<string,string>")
    own, page = (F.col(c) if c in chunks.columns else none for c in ("metadata", "page_metadata"))
    return has_metadata(F.col("_asked"), own, page)


def public_recheck(matches: DataFrame, chunks: DataFrame, units: DataFrame, grants: DataFrame) -> DataFrame:
    """Matches whose chunk is still there, still readable and explicitly public, with its text as it is now."""
    public = grants.where("kind = 'public'").select(*UNIT).distinct()
    current = chunks.select("chunk_id", *UNIT, F.col("text").alias("current_text")).join(public, UNIT, "left_semi")
    return matches.join(current, "chunk_id").join(units, ["sig", *UNIT], "left_semi")


# --- searches -----------------------------------------------------------------------------------
def scoped_bm25(chunks: DataFrame, requests: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """``qid, chunk_id, score, rank``: the first ``k`` by BM25 whose corpus is what each request's signature reaches.

    Chunks are counted once. Those of a (document, version) that meet the same metadata filters are a unit, and a signature
    reaches whole units, so nothing is made once a signature and chunk but scores inside a task.
    """
    sigs = requests.select("sig", F.col("metadata").alias("_asked")).dropDuplicates(["sig"]).withColumn("n", F.when(F.col("_asked").isNotNull(), F.col("sig")))
    name, reach = F.to_json(F.struct(*UNIT)), units.join(R.small(sigs.select("sig", "n")), "sig")
    if not sigs.where("n is not null").take(1):
        return B.Corpus(chunks, requests, unit=name, reach=reach.select("sig", name.alias("unit"))).top(k)
    every = sigs.where("n is not null").agg(F.collect_list(F.struct("n", "_asked")).alias("_every"))
    own, page = (F.col(c) if c in chunks.columns else F.lit(None).cast("map<string,string>") for c in ("metadata", "page_metadata"))
    met = F.transform(F.filter("_every", lambda x: has_metadata(x["_asked"], own, page)), lambda x: x["n"])
    chunks = chunks.crossJoin(F.broadcast(every)).withColumn("met", F.array_sort(met)).drop("_every")
    name = F.to_json(F.struct(*UNIT, "met"))
    reach = chunks.select(*UNIT, "met").distinct().join(reach, UNIT).where(F.col("n").isNull() | F.array_contains("met", F.col("n")))
    return B.Corpus(chunks, requests, unit=name, reach=reach.select("sig", name.alias("unit"))).top(k)


#: Bytes of a block of query vectors that is broadcast.
QUERY_BYTES = 16 << 20
#: Scores of a batch that are held at once.
SCORES = 1 << 21


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, *, cosine: bool = True, allowed: str | None = None) -> DataFrame:
    """``qid, chunk_id, score, rank``: the ``k`` nearest chunks of each query, by matrix products over Arrow batches.

    Vectors are scaled once a batch and only ``k`` rows a query and batch are shuffled. Queries are broadcast in
    blocks of ``QUERY_BYTES``, so any number can be asked. With ``allowed``, a column of both frames, a query
    meets only the vectors that have its value. Vectors of another length, null or not finite score 0 by cosine
    and are left out by dot product. Scores are rounded before they order; ties go to the smaller id.
    """
    cols = ["qid", "q"] + ([allowed] if allowed else [])
    asked = queries.select(F.col("qid").cast("long"), F.col("embedding").cast("array<double>").alias("q"), *([F.col(allowed)] if allowed else []))
    spark, found, block, size = vectors.sparkSession, [], [], 0

    def parts(every: list[int], mine: list[tuple], own: list | None):
        """Rows of a batch and queries that meet, in parts of at most ``SCORES`` pairs."""
        for value in {r[2] for r in mine} if allowed else [None]:
            fit = [i for i in every if own[i] == value] if allowed else every
            asking = [r for r in mine if r[2] == value] if allowed else mine
            step = max(1, SCORES // max(1, len(fit)))
            yield from ((fit, asking[i : i + step]) for i in range(0, len(asking) if fit else 0, step))

    def search(rows) -> DataFrame:
        held = spark.sparkContext.broadcast(rows)

        def run(batches):
            rows = held.value
            lengths = {len(r[1]) for r in rows if r[1] is not None}
            for batch in batches:
                ids = batch.column("chunk_id").to_pylist()
                own = batch.column("allowed").to_pylist() if allowed else None
                values = batch.column("embedding")
                sizes = np.diff(values.offsets.to_numpy()) if len(values) else np.zeros(0, int)
                out_q, out_c, out_s = [], [], []
                lists = values.to_pylist()
                for n in sorted(lengths):
                    every = [i for i in range(len(lists)) if lists[i] is not None and sizes[i] == n and None not in lists[i]]
                    mine = [r for r in rows if r[1] is not None and len(r[1]) == n]
                    for fit, part in parts(every, mine, own) if n else []:
                        v, q = np.array([lists[i] for i in fit]), np.array([r[1] for r in part], float)
                        score = q @ v.T
                        if cosine:
                            scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
                            with np.errstate(divide="ignore", invalid="ignore"):
                                score = np.where(scale > 0, score / scale, 0.0)
                        score = np.round(score, R.DIGITS) + 0.0
                        for r, s in zip(part, score, strict=True):
                            ok = np.isfinite(s)
                            where = np.flatnonzero(ok)
                            if len(where) > k:
                                least = np.partition(-s[where], k - 1)[k - 1]
                                where = where[-s[where] <= least]
                            best = sorted(where.tolist(), key=lambda j: (-s[j], ids[fit[j]]))[:k]
                            out_q += [r[0]] * len(best)
                            out_c += [ids[fit[j]] for j in best]
                            out_s += [float(s[j]) for j in best]
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_c, batch.column("chunk_id").type), pa.array(out_s, pa.float64())], names=["qid", "chunk_id", "score"])

        kind = dict(vectors.dtypes)["chunk_id"]
        read = vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), *([F.col(allowed).alias("allowed")] if allowed else []))
        return read.mapInArrow(run, f"qid long, chunk_id {kind}, score double")

    for row in asked.select(*cols).toLocalIterator():
        block.append(tuple(row))
        size += 8 * len(row[1] or [])
        if size >= QUERY_BYTES:
            found.append(search(block))
            block, size = [], 0
    found.append(search(block))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return R.top_k(every, k, ["qid"], [F.desc("score"), F.asc("chunk_id")])


# --- the staged retriever -----------------------------------------------------------------------
@dataclass(frozen=True)
class RetrievalConfig:
    """How a batch is answered; the values are fixed by the semantics of the service."""

    top_k: int = 5
    candidate_k: int = 30
    alpha: float = 0.55
    fusion: str = "rrf"
    rerank_top_n: int = 30
    search_mode: str = "hybrid"
    parent_expansion: bool = True
    version_mode: str = "none"

    def __post_init__(self) -> None:
        if self.search_mode not in {"hybrid", "dense", "sparse"}:
            raise ValueError("search_mode must be hybrid, dense, or sparse")
        if self.top_k < 1 or self.candidate_k < self.top_k:
            raise ValueError("candidate_k must be at least top_k, and both must be positive")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be between zero and one")


STAGES = ("scope_auth", "dense", "sparse", "fusion", "rerank", "parent_context")


class StagedRetriever:
    """Scope, dense and sparse lists, fusion, reranking, parents and traces over one corpus.

    ``chunks``: ``chunk_id, document_id, version, text, embedding`` and, where there are any, ``parent_id,
    metadata, page_metadata``. ``grants``: ``document_id, version, kind, grantee``. ``reranker`` and ``encoder``
    are ports: functions from frames to frames that take the place of token overlap and of given vectors.
    """

    def __init__(self, chunks: DataFrame, grants: DataFrame, config: RetrievalConfig = RetrievalConfig(), *, reranker=None, encoder=None) -> None:
        self.chunks, self.grants, self.config = chunks, grants, config
        self.reranker, self.encoder = reranker or R.rerank_overlap, encoder
        self.units = chunks.select(*UNIT).distinct()
        self.ready = False

    def prepare(self) -> None:
        """Write units and grants once: every measure and join of the filters reads them."""
        if not self.ready:
            self.units, self.grants, self.ready = materialise(self.units, "units"), materialise(self.grants, "grants"), True

    def scoped(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Requests with their resolved filters, ``status, versions`` and signature, and the units of each signature."""
        cleared = with_signature(requests.withColumn("product_version", F.lit(None).cast("string")).withColumn("scopes", F.lit(None).cast(A.SCOPES)))
        reach = eligible_units(cleared, self.units, self.grants)
        seen = cleared.select("qid", "sig").join(reach, "sig").select("qid", *UNIT)
        out = with_signature(A.resolve_scope(requests, seen, self.config.version_mode))
        return out, eligible_units(out, self.units, self.grants)

    def dense_list(self, requests: DataFrame, units: DataFrame, k: int) -> DataFrame:
        reach = eligible_chunks(self.chunks.select("chunk_id", *UNIT, "embedding", *[c for c in ("metadata", "page_metadata") if c in self.chunks.columns]), units, requests)
        return dense_top(reach, requests, k, allowed="sig")

    def sparse_list(self, requests: DataFrame, units: DataFrame, k: int) -> DataFrame:
        return scoped_bm25(self.chunks, requests, units, k)

    def retrieve(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Matches (``qid, chunk_id, dense_score, sparse_score, hybrid_score, rerank_score, final_score, rank``) and traces.

        Stages are written to shared storage, as the traces read each of them again.
        """
        c = self.config
        if self.encoder is not None:
            requests = self.encoder(requests)
        self.prepare()
        asked, units = self.scoped(materialise(requests, "asked"))
        asked, units = materialise(asked, "requests"), materialise(units, "reach")
        self.asked, self.reach = asked, units
        none = asked.sparkSession.createDataFrame([], f"qid long, chunk_id {dict(self.chunks.dtypes)['chunk_id']}, score double, rank int")
        dense = materialise(self.dense_list(asked, units, c.candidate_k), "dense") if c.search_mode != "sparse" else none
        sparse = materialise(self.sparse_list(asked, units, c.candidate_k), "sparse") if c.search_mode != "dense" else none
        fused = R.fuse(dense, sparse, c.fusion, c.alpha).where(F.col("rank") <= c.candidate_k)
        if c.search_mode != "hybrid":  # the list itself, by the score of the mode that is asked for
            fused = fused.withColumn("hybrid_score", F.col(f"{c.search_mode}_score"))
            fused = R.top_k(fused.drop("rank"), c.candidate_k, ["qid"], [F.desc("hybrid_score"), F.asc("chunk_id")])
        fused = materialise(fused, "fused")
        reranked = self.reranker(fused, asked, self.chunks, min(c.candidate_k, c.rerank_top_n))
        reranked = materialise(reranked.join(fused.select("qid", "chunk_id", "dense_score", "sparse_score"), ["qid", "chunk_id"]), "reranked")
        final = reranked
        if c.parent_expansion and "parent_id" in self.chunks.columns:
            final = self.expand(reranked, asked, units)
        final = final.withColumn("final_score", F.coalesce("rerank_score", "hybrid_score")).where(F.col("rank") <= c.top_k)
        final = materialise(final, "matches")
        return final, self.traces(asked, dense, sparse, fused, reranked, final)

    def expand(self, matches: DataFrame, asked: DataFrame, units: DataFrame, decay: float = 0.95) -> DataFrame:
        """Each match is followed by its parent, if the request reaches it, at ``decay`` of its hybrid score and without
        a rerank score; a chunk keeps its first place."""
        sig = asked.select("qid", "sig")
        links = self.chunks.select("chunk_id", "parent_id").where("parent_id is not null")
        own = matches.select("qid", "chunk_id", "dense_score", "sparse_score", "hybrid_score", "rerank_score", (F.col("rank") * 2).alias("place"))
        up = matches.join(links, "chunk_id").select("qid", F.col("parent_id").alias("chunk_id"), "dense_score", "sparse_score", F.round(F.col("hybrid_score") * decay, R.DIGITS + 3).alias("hybrid_score"), F.lit(None).cast("double").alias("rerank_score"), (F.col("rank") * 2 + 1).alias("place"))
        meta = [c for c in ("metadata", "page_metadata") if c in self.chunks.columns]
        may = up.join(self.chunks.select("chunk_id", *UNIT, *meta), "chunk_id").join(sig, "qid").join(units, ["sig", *UNIT], "left_semi")
        may = may.join(asked.select("qid", F.col("metadata").alias("_asked")), "qid").where(_metadata_ok(self.chunks)).select(*own.columns)
        first = R.top_k(own.unionByName(may), 1, ["qid", "chunk_id"], [F.asc("place")], "n").drop("n")
        return R.top_k(first, 2**31 - 1, ["qid"], [F.asc("place")]).drop("place")

    def traces(self, asked: DataFrame, dense: DataFrame, sparse: DataFrame, fused: DataFrame, reranked: DataFrame, final: DataFrame) -> DataFrame:
        """``qid, stage, place, candidates, details``: the candidates of each stage in order, ids and scores only."""
        c, zero = self.config, F.lit(None).cast("double")
        score = {
            "dense": dense.select("qid", "chunk_id", "rank", F.col("score").alias("dense_score"), zero.alias("sparse_score"), zero.alias("hybrid_score"), zero.alias("rerank_score")),
            "sparse": sparse.select("qid", "chunk_id", "rank", zero.alias("dense_score"), F.col("score").alias("sparse_score"), zero.alias("hybrid_score"), zero.alias("rerank_score")),
            "fusion": fused.select("qid", "chunk_id", "rank", "dense_score", "sparse_score", "hybrid_score", zero.alias("rerank_score")),
            "rerank": reranked.select("qid", "chunk_id", "rank", "dense_score", "sparse_score", "hybrid_score", "rerank_score"),
            "parent_context": final.select("qid", "chunk_id", "rank", "dense_score", "sparse_score", "hybrid_score", "rerank_score"),
        }
        rows = None
        for stage, df in score.items():
            one = df.withColumn("stage", F.lit(stage))
            rows = one if rows is None else rows.unionByName(one)
        item = F.struct("rank", "chunk_id", "dense_score", "sparse_score", "hybrid_score", "rerank_score")
        listed = rows.groupBy("qid", "stage").agg(F.array_sort(F.collect_list(item)).alias("candidates"))
        details = {"scope_auth": F.to_json(F.struct("status")), "dense": F.to_json(F.struct(F.lit(c.candidate_k).alias("candidate_k"), F.lit(c.search_mode != "sparse").alias("enabled"))), "sparse": F.to_json(F.struct(F.lit(c.candidate_k).alias("candidate_k"), F.lit(c.search_mode != "dense").alias("enabled"))), "fusion": F.to_json(F.struct(F.lit(c.fusion).alias("method"), F.lit(c.alpha).alias("alpha"))), "rerank": F.to_json(F.struct(F.lit(min(c.candidate_k, c.rerank_top_n)).alias("top_n"))), "parent_context": F.to_json(F.struct(F.lit(c.parent_expansion).alias("enabled")))}
        every = asked.select("qid", F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), details[s].alias("details")) for s in STAGES])).alias("place", "s")).select("qid", "place", "s.stage", "s.details")
        return every.join(listed, ["qid", "stage"], "left")


def citations(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Matches with a ``citation`` struct: ids, version, path and the whole chunk as excerpt."""
    path = F.col("section_path") if "section_path" in chunks.columns else F.array().cast("array<string>")
    cited = chunks.select("chunk_id", F.struct("chunk_id", "document_id", "version", path.alias("section_path"), F.col("text").alias("excerpt")).alias("citation"))
    return matches.join(cited, "chunk_id")


def confidence(matches: DataFrame) -> DataFrame:
    """``qid, confidence``: the first final score, held between 0 and 1."""
    return matches.where("rank = 1").select("qid", V.clamp(F.col("final_score")).alias("confidence"))


def accepted_in_union(rankings: DataFrame, limit: int = 200) -> DataFrame:
    """``qid, chunk_id`` that any ranker (column ``ranker``) has at or before ``limit``."""
    return rankings.where(F.col("rank") <= limit).select("qid", "chunk_id").distinct()


def evaluate_arms(chunks: DataFrame, grants: DataFrame, requests: DataFrame, arms: dict[str, RetrievalConfig]) -> DataFrame:
    """``arm, qid, chunk_id, rank``: the matches of every arm for every request."""
    out = None
    for name, config in arms.items():
        one = StagedRetriever(chunks, grants, config).retrieve(requests)[0].select(F.lit(name).alias("arm"), "qid", "chunk_id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


#: Hash tables of the approximate search, and sign bits of each.
ANN_TABLES, ANN_BITS = 24, 5


def ann_top(vectors: DataFrame, queries: DataFrame, k: int, tables: int = ANN_TABLES, bits: int = ANN_BITS, seed: int = 7) -> DataFrame:
    """``qid, chunk_id, score, rank``: approximate nearest chunks by cosine.

    Signs of random projections are keys; a query meets the vectors of its key in any table, and of the key with its least
    certain bit flipped, and those are scored exactly, bucket by bucket (``nearest``).
    """
    return M.nearest(vectors, queries, k, M.hashed(tables, bits, seed))


def ann_recall(found: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """``qid, recall``: share of the exact first ``k`` that an approximate search found."""
    hits = truth.where(F.col("rank") <= k).join(found.where(F.col("rank") <= k).select("qid", "chunk_id", F.lit(1).alias("hit")), ["qid", "chunk_id"], "left")
    return hits.groupBy("qid").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), R.DIGITS).alias("recall"))
