"""The service as library functions: ports, settings and limits, and what a request does from end to end, in batches."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.operators import access as A
from corvid.operators import analysis as N
from corvid.operators import chunking as C
from corvid.operators import retrieval as T
from corvid.operators import store as S
from corvid.operators import verification as V


class Parser(Protocol):
    """Files to section rows (``corvid.operators.chunking.SECTION``)."""

    def __call__(self, files: DataFrame) -> DataFrame: ...


class Embedder(Protocol):
    """Rows with ``chunk_id, text`` to ``chunk_id, embedding``."""

    def __call__(self, chunks: DataFrame) -> DataFrame: ...


class Encoder(Protocol):
    """Requests to requests with ``embedding``."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


class Reranker(Protocol):
    """Candidates, requests, chunks and the number to rerank to ``qid, chunk_id, hybrid_score, rerank_score, rank``."""

    def __call__(self, candidates: DataFrame, requests: DataFrame, chunks: DataFrame, top_n: int) -> DataFrame: ...


class AnswerGenerator(Protocol):
    """Prompts (``qid, prompt``) to ``qid, text`` in the answer schema of ``verification.answer_of``."""

    def __call__(self, prompts: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Settings:
    """Defaults of the service and the ranges that they may have."""

    chunk_size: int = 220
    chunk_overlap: int = 35
    retrieval: T.RetrievalConfig = field(default_factory=T.RetrievalConfig)
    max_context_chars: int = 18_000
    least_score: float = 0.12
    stopwords: tuple[str, ...] = ("the", "of", "and", "to", "is", "in", "a", "what", "how")
    mode: str = "extractive"
    query_chars: int = 4_000
    sections: int = 10_000
    section_chars: int = 1_000_000
    document_chars: int = 20_000_000
    metadata_keys: int = 64
    metadata_depth: int = 4
    requests_a_minute: int = 60

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")
        if self.mode not in {"extractive", "verified", "unverified"}:
            raise ValueError("mode must be extractive, verified or unverified")
        if not 0 <= self.least_score <= 1 or self.max_context_chars < 1:
            raise ValueError("least_score is between zero and one, and the context has room")


def payload_errors(payload: dict, settings: Settings = Settings()) -> list[str]:
    """What is wrong with the shape of a document's payload: sizes of sections and text, keys and depth of metadata."""

    def depth(v) -> int:
        inner = v.values() if isinstance(v, dict) else v if isinstance(v, list) else None
        return 0 if inner is None else 1 + max(map(depth, inner), default=0)

    sections, errors = payload.get("sections") or [], []
    sizes = [len(str(s.get("text", ""))) for s in sections]
    if len(sections) > settings.sections:
        errors.append("too many sections")
    if max(sizes, default=0) > settings.section_chars:
        errors.append("section too long")
    if sum(sizes) > settings.document_chars:
        errors.append("document too long")
    for held in [payload.get("metadata") or {}, *[s.get("metadata") or {} for s in sections]]:
        if len(held) > settings.metadata_keys:
            errors.append("too many metadata keys")
        if depth(held) > settings.metadata_depth:
            errors.append("metadata too deep")
    return list(dict.fromkeys(errors))


CHUNK_TABLE = C.CHUNK + ", revision long, embedding array<double>"


class Service:
    """Ingest, ask, observe and delete over one store."""

    def __init__(self, store: S.Store, embedder: Embedder, settings: Settings = Settings(), *, encoder: Encoder | None = None, reranker: Reranker | None = None, generator: AnswerGenerator | None = None) -> None:
        self.store, self.embedder, self.settings = store, embedder, settings
        self.encoder, self.reranker, self.generator = encoder, reranker, generator

    def ingest(self, sections: DataFrame, policies: DataFrame, parser_hash: str = "parser", embedder_id: str = "embedder") -> DataFrame:
        """Chunk, embed what has no vector yet and publish; returns the plan. Documents without chunks are an error."""
        s = self.settings
        chunks = C.chunk_sections(sections, s.chunk_size, s.chunk_overlap)
        content = chunks.groupBy("document_id", "version").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id"))), lambda r: r["chunk_id"]), "\x1f"), 256).alias("content_hash"))
        empty = sections.select("document_id", "version").distinct().join(content, ["document_id", "version"], "left_anti").limit(1).collect()
        if empty:
            raise ValueError(f"document {empty[0].document_id} has no chunks")
        incoming = content.select("document_id", "version", "content_hash", F.lit(parser_hash).alias("parser_hash"), F.sha2(F.lit(f"{s.chunk_size}\x1f{s.chunk_overlap}"), 256).alias("chunker_hash"), F.lit(embedder_id).alias("embedder_id"))
        held = self.store.read("embeddings", "content_hash string, embedding array<double>")
        fresh = chunks.join(held.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])
        made = self.embedder(fresh.select("chunk_id", "text")).join(fresh.select("chunk_id", "content_hash"), "chunk_id").select("content_hash", F.col("embedding").cast("array<double>").alias("embedding"))
        vectors = S.insert_absent(held, made)
        with_vectors = chunks.join(vectors, "content_hash", "left").select(*[f.split(" ")[0] for f in C.CHUNK.split(", ")], "embedding")
        plan = S.ingest(self.store, incoming, with_vectors, S.policy_grants(policies))
        self.store.publish(embeddings=vectors)
        return plan

    def chunks(self) -> DataFrame:
        """Chunks of active revisions."""
        live = self.store.read("versions", S.VERSIONS).where("status = 'active'").select("document_id", "version", "revision")
        return self.store.read("chunks", CHUNK_TABLE).join(live, ["document_id", "version", "revision"], "left_semi")

    def ask(self, requests: DataFrame) -> DataFrame:
        """``qid, answer, abstained, reason, answered_version, confidence, citations`` of a batch; traces are saved."""
        s, grants = self.settings, self.store.read("grants", S.GRANTS)
        asked = requests.withColumn("query", F.when(F.trim("query") == "", F.raise_error(F.lit("query cannot be empty"))).otherwise(F.col("query")))
        retriever = T.StagedRetriever(self.chunks(), grants, s.retrieval, **({"reranker": self.reranker} if self.reranker else {}), encoder=self.encoder)
        matches, traces = retriever.retrieve(asked)
        scoped, units = retriever.asked, retriever.reach
        evidence = matches.join(self.chunks().select("chunk_id", "document_id", "version", "section_path", "text", "metadata", "page_metadata"), "chunk_id")
        sig = scoped.select("qid", "sig")
        allowed = evidence.select("qid", "chunk_id", "document_id", "version").join(sig, "qid").join(units, ["sig", "document_id", "version"], "left_semi").select("qid", "chunk_id")
        public = T.public_recheck(evidence.join(sig, "qid").select("qid", "sig", "chunk_id"), self.chunks(), units, grants).select("chunk_id").distinct() if self.generator and s.mode != "extractive" else None
        usable = V.authorised(evidence, scoped.withColumn("answered_version", F.lit(None).cast("string")), limit=s.max_context_chars, allowed=allowed, public=public, public_only=public is not None)
        if self.generator and s.mode != "extractive":
            raw = self.generator(V.grounded_prompts(scoped, usable))
            given = V.parse_answers(raw)
            checked = V.verify(given.where("error is null").drop("error"), scoped, usable) if s.mode == "verified" else given.select("qid", "answer", (F.lower(F.trim("answer")) == V.DENIAL).alias("abstained"), F.lit(None).cast("string").alias("reason"), "answered_version", F.lit(None).cast("double").alias("confidence"))
            answers = checked.select("qid", "answer", "abstained", "reason", "answered_version", "confidence")
        else:
            found = N.extractive_answers(usable.withColumn("score", F.col("final_score")), scoped, list(s.stopwords), s.least_score)
            conf = T.confidence(matches)
            answers = scoped.select("qid").join(found, "qid", "left").join(conf, "qid", "left").select("qid", F.coalesce("answer", F.lit(V.DENIAL)).alias("answer"), F.col("answer").isNull().alias("abstained"), F.when(F.col("answer").isNull(), "insufficient_evidence").alias("reason"), F.lit(None).cast("string").alias("answered_version"), F.when(F.col("answer").isNotNull(), F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"))
        cited = T.citations(usable.select("qid", "rank", "chunk_id"), self.chunks()).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "citation"))), lambda r: r["citation"]).alias("citations"))
        self.trace(asked, traces, answers)
        return answers.join(cited, "qid", "left")

    def trace(self, asked: DataFrame, traces: DataFrame, answers: DataFrame) -> None:
        """Save a trace a request: its stages as JSON and the outcome."""
        stages = traces.groupBy("qid").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", "stage", "details", "candidates"))), lambda r: F.struct(r["stage"].alias("stage"), r["details"].alias("details"), r["candidates"].alias("candidates")))).alias("stages"))
        new = asked.select("qid", "query").join(stages, "qid").join(answers.select("qid", "abstained"), "qid", "left")
        rows = new.select(F.sha2(F.concat_ws("\x1f", F.col("qid").cast("string"), "query"), 256).alias("trace_id"), "query", "stages", F.lit(self.settings.retrieval.search_mode).alias("mode"), F.lit(None).cast("double").alias("latency_ms"), F.lit(None).cast("decimal(18,8)").alias("cost_usd"), "abstained", F.current_timestamp().alias("created_at"))
        self.store.publish(traces=S.save_traces(self.store.read("traces", S.TRACE), rows))

    def delete(self, document_ids: list[str]) -> int:
        return S.delete_documents(self.store, document_ids, CHUNK_TABLE)

    def coverage(self) -> DataFrame:
        """Chunks, contents, linked and missing vectors of the active corpus."""
        vectors = self.store.read("embeddings", "content_hash string, embedding array<double>")
        return S.coverage(self.chunks(), vectors.select("content_hash", F.col("content_hash").alias("vec_id")), vectors.select(F.col("content_hash").alias("vec_id")))

    def trace_summary(self) -> DataFrame:
        t = self.store.read("traces", S.TRACE)
        return t.agg(F.count("*").alias("traces"), F.sum("cost_usd").alias("cost_usd"), F.avg("latency_ms").alias("mean_ms"), F.percentile("latency_ms", 0.5).alias("p50_ms"), F.percentile("latency_ms", 0.95).alias("p95_ms"), F.coalesce(F.sum(F.col("abstained").cast("long")), F.lit(0)).alias("abstained"))

    def health(self) -> dict:
        now = self.store.current()
        return {"status": "ok", "snapshot": now["number"] if now else 0}

    def enqueue(self, rows: list[tuple[str, str, dict]]) -> None:
        """Queue jobs (id, kind, payload)."""
        spark = self.store.spark
        new = spark.createDataFrame([(i, k, json.dumps(p)) for i, k, p in rows], "id string, kind string, payload string")
        self.store.publish(jobs=S.enqueue(self.store.read("jobs", S.JOB), new, F.current_timestamp()))


def visible_documents(grants: DataFrame, requesters: DataFrame) -> DataFrame:
    """``requester, document_id, version`` that may be read."""
    keyed = grants.select(F.struct("document_id", "version").alias("unit"), "kind", "grantee")
    return A.visible(keyed, requesters, "unit").select("requester", "unit.*")
