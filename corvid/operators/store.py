"""The versioned store: sets of tables published at once, revisions, grants, vectors, jobs, traces and snapshots.

A store is a folder of snapshots. A snapshot is a folder with a Parquet table each; a pointer file names the current
one and is replaced by a rename, so readers see whole snapshots only and a failed write changes nothing. Operators
take the frames of a snapshot and return those of the next; ``Store.publish`` writes them.
"""

from __future__ import annotations

import hashlib
import json
import tarfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators import ingest as I
from corvid.operators.ranking import small

VERSIONS = "document_id string, version string, revision long, status string, content_hash string, parser_hash string, chunker_hash string, embedder_id string"
GRANTS = "document_id string, version string, kind string, grantee string"
JOB = "id string, kind string, payload string, status string, attempts int, lease string, locked_at timestamp, created_at timestamp, error string, result string"
TRACE = "trace_id string, query string, stages string, mode string, latency_ms double, cost_usd decimal(18,8), abstained boolean, created_at timestamp"
#: After so long a lease counts as lost.
LEASE = "5 minutes"
KEY = ["document_id", "version"]


# --- files --------------------------------------------------------------------------------------
def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small JSON file, sorted and without NaN, written beside and renamed over the old one."""
    body = json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n"
    target, fs = _path(spark, path)
    beside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(body.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), fs.makeQualified(target), options)


def read_json(spark: SparkSession, path: str):
    """A JSON file's value, or None if there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode())
    finally:
        source.close()


def folder_bytes(spark: SparkSession, path: str) -> int:
    p, fs = _path(spark, path)
    return fs.getContentSummary(p).getLength()


def write_gzip_lines(df: DataFrame, path: str, limit: int = 40 << 20) -> int:
    """Gzip JSON lines with keys in order; more than ``limit`` bytes are deleted again and an error."""
    df.select(*sorted(df.columns)).write.option("compression", "gzip").json(path)
    size = folder_bytes(df.sparkSession, path)
    if size > limit:
        p, fs = _path(df.sparkSession, path)
        fs.delete(p, True)
        raise ValueError(f"{path}: {size} bytes, more than {limit}")
    return size


def write_artifact(spark: SparkSession, folder: str, config: dict, result: dict) -> str:
    """An experiment's result in a file named by the hash of its configuration; returns the path."""
    name = hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    write_json(spark, f"{folder}/{name}.json", {"config": config, "config_hash": name, "result": result})
    return f"{folder}/{name}.json"


def reusable(held: dict | None, wanted: dict, keys: list[str]) -> bool:
    """Whether a cached artifact was made from equal configuration and inputs."""
    return held is not None and all(held.get(k) == wanted.get(k) for k in keys)


def package_vectors(vectors: DataFrame, folder: str, archive: str, limit: int = 256 << 20) -> str:
    """Vectors as Parquet with an index of counts, dimension and checksum, in a local tar file of at most ``limit`` bytes; returns its sha256."""
    vectors.orderBy("key").coalesce(1).write.mode("overwrite").parquet(f"{folder}/vectors.parquet")
    if folder_bytes(vectors.sparkSession, f"{folder}/vectors.parquet") > limit:
        raise ValueError(f"more than {limit} bytes of vectors; hand over the folder instead")
    n, least, most, check = vectors.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding")), F.bit_xor(F.xxhash64("key", "embedding"))).first()
    if least != most:
        raise ValueError("vectors differ in length")
    local = Path(folder.removeprefix("file://"))
    (local / "index.json").write_text(json.dumps({"count": n, "dimensions": most, "checksum": check}, sort_keys=True))
    with tarfile.open(archive, "w") as tar:
        for p in sorted([local / "index.json", *(local / "vectors.parquet").glob("*.parquet")]):
            tar.add(p, arcname=str(p.relative_to(local)))
    return hashlib.sha256(Path(archive).read_bytes()).hexdigest()


class Store:
    """Snapshots under one folder and a pointer to the current one. One writer at a time, as a job queue has."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def current(self) -> dict | None:
        return read_json(self.spark, f"{self.folder}/CURRENT.json")

    def read(self, table: str, schema: str) -> DataFrame:
        """A table of the current snapshot; empty if there is none."""
        now = self.current()
        if not now or table not in now["tables"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(now["tables"][table])

    def publish(self, **tables: DataFrame) -> int:
        """Write the tables as the next snapshot and switch the pointer; tables not given are carried over. Returns its number."""
        now = self.current() or {"number": 0, "tables": {}}
        number, held = now["number"] + 1, dict(now["tables"])
        for name, df in tables.items():
            held[name] = f"{self.folder}/{number:08d}-{uuid.uuid4().hex[:8]}/{name}"
            df.write.parquet(held[name])
        write_json(self.spark, f"{self.folder}/CURRENT.json", {"number": number, "tables": held})
        return number


# --- revisions ----------------------------------------------------------------------------------
def ingest(store: Store, incoming: DataFrame, chunks: DataFrame, grants: DataFrame) -> DataFrame:
    """Publish new revisions of documents; returns ``document_id, version, action, revision``.

    ``incoming``: a row a (document, version) with its four hashes. Unchanged ones keep their revision, chunks and
    vectors, though their grants are replaced. New ones become active and the former superseded, in one switch.
    """
    versions = store.read("versions", VERSIONS)
    plan = I.plan_revisions(versions, incoming)
    after = I.apply_revisions(versions, plan, incoming.select(*[c for c in versions.columns if c not in ("revision", "status")])).select(*versions.columns)
    new = plan.where("action = 'insert'").select(*KEY, "revision")
    held = store.read("chunks", ", ".join(f"{n} {t}" for n, t in chunks.dtypes) + ", revision long")
    store.publish(versions=after, chunks=held.unionByName(chunks.join(new, KEY)), grants=replace_grants(store.read("grants", GRANTS), grants, incoming.select(*KEY)))
    return plan


def delete_documents(store: Store, document_ids: list[str], chunks_schema: str) -> int:
    """Mark all revisions of documents deleted, drop their chunks and grants, cancel their jobs; returns how many revisions."""
    versions = store.read("versions", VERSIONS)
    gone = F.col("document_id").isin(document_ids)
    n = versions.where(gone & (F.col("status") != "deleted")).count()
    jobs = store.read("jobs", JOB)
    named = F.get_json_object("payload", "$.document_id").isin(document_ids) & F.col("status").isin("queued", "running")
    tables = {"versions": versions.withColumn("status", F.when(gone, "deleted").otherwise(F.col("status"))), "chunks": store.read("chunks", chunks_schema).where(~gone), "grants": store.read("grants", GRANTS).where(~gone), "jobs": jobs.withColumn("status", F.when(named, "cancelled").otherwise(F.col("status"))).withColumn("lease", F.when(~F.coalesce(named, F.lit(False)), F.col("lease")))}
    if "embeddings" in (store.current() or {"tables": {}})["tables"]:
        vectors = store.read("embeddings", "content_hash string, embedding array<double>")
        tables["embeddings"] = vectors.join(tables["chunks"].select("content_hash"), "content_hash", "left_semi")
    store.publish(**tables)
    return n


def policy_grants(policies: DataFrame) -> DataFrame:
    """Grants of ``document_id, version, public, principals, groups``: none given or public is one public row; a private
    policy leaves a row that lets nobody in, besides its grants."""
    none = F.array().cast("array<struct<kind:string,grantee:string>>")
    one = lambda kind, who: F.struct(F.lit(kind).alias("kind"), who.alias("grantee"))
    open_ = F.col("public").isNull() | F.col("public")
    rows = F.when(open_, F.array(one("public", F.lit("*")))).otherwise(F.array(one("nobody", F.lit(""))))
    rows = F.concat(rows, F.transform(F.coalesce("principals", F.array().cast("array<string>")), lambda p: one("principal", p)), F.transform(F.coalesce("groups", F.array().cast("array<string>")), lambda g: one("group", g)), none)
    return policies.select(*KEY, F.explode(rows).alias("r")).select(*KEY, "r.*").distinct()


def replace_grants(grants: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Grants in which those of the touched (document, version)s are the new ones."""
    return grants.join(touched.select(*KEY).distinct(), KEY, "left_anti").unionByName(new.select(*grants.columns))


def insert_absent(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors and those new ones whose content has none yet, the first of each."""
    fresh = new.join(vectors.select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.min("embedding").alias("embedding"))
    return vectors.unionByName(fresh.select(*vectors.columns))


def import_vectors(store: Store, new: DataFrame, wanted: int) -> bool:
    """Replace the vectors unless as many as are wanted are there; returns whether anything was written."""
    if store.read("embeddings", "content_hash string, embedding array<double>").count() == wanted:
        return False
    bad = F.raise_error(F.lit("vector is empty or not finite"))
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("embedding") > 0)
    store.publish(embeddings=new.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(bad.cast("array<double>"))))
    return True


def unit_vectors(vectors: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Vectors whose length is not one; must be empty for encoders that give unit vectors."""
    size = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return vectors.withColumn("norm", size).where((F.abs(F.col("norm") - 1) > tolerance) | F.col("norm").isNull())


def vectors_of(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vector, by content hash, else by the hash of their text."""
    v = vectors.select(F.col("key"), "embedding")
    first = chunks.join(v.withColumnRenamed("key", "content_hash"), "content_hash", "left")
    second = v.select(F.col("key").alias("_h"), F.col("embedding").alias("_e"))
    return first.withColumn("_h", F.sha2("text", 256)).join(second, "_h", "left").withColumn("embedding", F.coalesce("embedding", "_e")).drop("_h", "_e")


def linked_vectors(chunks: DataFrame, links: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with ``embedding``, over links ``chunk_id, content_hash, embedder_id`` to vectors of the same content and encoder."""
    return chunks.join(links.select("chunk_id", "content_hash", "embedder_id"), "chunk_id").join(vectors.select("content_hash", "embedder_id", "embedding"), ["content_hash", "embedder_id"])


def reuse_vectors(snapshot: DataFrame, live: DataFrame, vectors: DataFrame) -> DataFrame:
    """``chunk_id, embedding`` of snapshot chunks that the live corpus has under the same id and content."""
    return snapshot.select("chunk_id", "content_hash").join(live.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi").join(vectors, "content_hash").select("chunk_id", "embedding")


def snapshot(store: Store, name: str, tables: dict[str, str]) -> dict[str, str]:
    """Copies of tables (name to schema) of the current snapshot under a name of their own; returns their folders."""
    out = {}
    for table, schema in tables.items():
        out[table] = f"{store.folder}/snapshots/{name}/{table}"
        store.read(table, schema).write.mode("overwrite").parquet(out[table])
    return out


def acl_views(versions: DataFrame) -> DataFrame:
    """Each row twice, as an open and as a restricted variant of the corpus."""
    return versions.withColumn("restricted", F.explode(F.array(F.lit(False), F.lit(True))))


def exact_cover(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, side`` of ids that only one of two sets has; empty where they cover each other."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


# --- jobs ---------------------------------------------------------------------------------------
def enqueue(jobs: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Jobs and the new ones (``id, kind, payload``), queued."""
    null = lambda t: F.lit(None).cast(t)
    rows = new.select("id", "kind", "payload", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), null("string").alias("lease"), null("timestamp").alias("locked_at"), now.cast("timestamp").alias("created_at"), null("string").alias("error"), null("string").alias("result"))
    return jobs.unionByName(rows.join(jobs.select("id"), "id", "left_anti"))


def claim(jobs: DataFrame, kind: str, now: Column, lease: str) -> DataFrame:
    """Jobs after one of a kind is claimed: leases older than ``LEASE`` are lost and their jobs queued again, then the
    oldest queued one (by time, then id) runs under the lease with one attempt more."""
    stale = (F.col("status") == "running") & (F.col("locked_at") < now.cast("timestamp") - F.expr(f"INTERVAL {LEASE}"))
    back = jobs.withColumn("_s", stale).withColumn("status", F.when(F.col("_s"), "queued").otherwise(F.col("status"))).withColumn("lease", F.when(~F.col("_s"), F.col("lease"))).withColumn("locked_at", F.when(~F.col("_s"), F.col("locked_at"))).drop("_s")
    first = back.where((F.col("status") == "queued") & (F.col("kind") == kind)).orderBy("created_at", "id").limit(1).select("id", F.lit(True).alias("_mine"))
    mine = F.coalesce("_mine", F.lit(False))
    out = back.join(F.broadcast(first), "id", "left")
    return out.select("id", "kind", "payload", F.when(mine, "running").otherwise(F.col("status")).alias("status"), (F.col("attempts") + mine.cast("int")).alias("attempts"), F.when(mine, F.lit(lease)).otherwise(F.col("lease")).alias("lease"), F.when(mine, now.cast("timestamp")).otherwise(F.col("locked_at")).alias("locked_at"), "created_at", "error", "result")


def finish(jobs: DataFrame, job: str, lease: str, *, result: str | None = None, error: str | None = None) -> DataFrame:
    """Jobs after one has succeeded or failed; a worker whose lease is lost changes nothing. Payloads are blanked."""
    mine = (F.col("id") == job) & (F.col("status") == "running") & (F.col("lease") == lease)
    mine = F.coalesce(mine, F.lit(False))
    put = lambda c, v: F.when(mine, F.lit(v)).otherwise(F.col(c)).alias(c)
    return jobs.select("id", "kind", put("payload", "{}"), put("status", "failed" if error is not None else "done"), "attempts", put("lease", None), put("locked_at", None), "created_at", put("error", error), put("result", result)).select(*jobs.columns)


def work(store: Store, kind: str, run, now: Column, lease: str | None = None) -> str | None:
    """Claim a job, run it on its payload and record the outcome; an exception is the job's error. Returns its id."""
    lease = lease or uuid.uuid4().hex
    store.publish(jobs=claim(store.read("jobs", JOB), kind, now, lease))
    mine = store.read("jobs", JOB).where(F.col("lease") == lease).first()
    if mine is None:
        return None
    try:
        outcome = {"result": json.dumps(run(json.loads(mine.payload)))}
    except Exception as failure:  # noqa: BLE001  a job's failure is a result of the queue
        outcome = {"error": str(failure)}
    store.publish(jobs=finish(store.read("jobs", JOB), mine.id, lease, **outcome))
    return mine.id


# --- traces and coverage ------------------------------------------------------------------------
def save_traces(traces: DataFrame, new: DataFrame) -> DataFrame:
    """Traces with those of the same id replaced; columns that a later outcome leaves null keep their value."""
    both = traces.alias("o").join(new.alias("n"), "trace_id", "full_outer")
    return both.select("trace_id", *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in traces.columns if c != "trace_id"])


def coverage(chunks: DataFrame, links: DataFrame, vectors: DataFrame) -> DataFrame:
    """``chunks, contents, linked, missing``: a chunk is linked if its content has a link to a vector that is there."""
    there = links.join(vectors.select("vec_id").distinct(), "vec_id", "left_semi").select("content_hash").distinct().withColumn("_l", F.lit(1))
    c = chunks.select("chunk_id", "content_hash").join(there, "content_hash", "left")
    linked = F.count("_l")
    return c.agg(F.count("*").alias("chunks"), F.countDistinct("content_hash").alias("contents"), linked.alias("linked"), (F.count("*") - linked).alias("missing"))


def version_counts(chunks: DataFrame, versions: DataFrame, grants: DataFrame) -> DataFrame:
    """``version, active, public``: chunks of active revisions, and those of public documents among them."""
    live = versions.where("status = 'active'").select(*KEY).distinct()
    open_ = grants.where("kind = 'public'").select(*KEY).distinct().withColumn("_p", F.lit(1))
    return chunks.join(small(live), KEY, "left_semi").join(small(open_), KEY, "left").groupBy("version").agg(F.count("*").alias("active"), F.count("_p").alias("public"))


def fingerprints(rows: DataFrame, by: str, key: str) -> DataFrame:
    """``by, n, fingerprint``: order-free fingerprint of the ids of each group, in constant memory a group: the number of
    rows and the sums of two 64-bit hashes, hashed together."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col(key).cast("string")).cast("decimal(38,0)"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.md5(F.concat_ws(":", F.count("*").cast("string"), h(1).cast("string"), h(2).cast("string"))).alias("fingerprint"))


def ordered_fingerprints(rows: DataFrame, by: str, key: str, slices: int = 64) -> DataFrame:
    """``by, fingerprint``: md5 over the ids of a group in order, made of the md5 of ``slices`` ranges of ids, so that no
    row holds all ids of a large group. Ids are integers; a slice is ``key div width`` with the width from their range."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // slices))
    part = F.floor((F.col(key) - F.lit(low or 0)) / width).cast("int")
    per = rows.groupBy(by, part.alias("slice")).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",")).alias("m"))
    return per.groupBy(by).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "m"))), lambda s: s["m"]), ",")).alias("fingerprint"))
