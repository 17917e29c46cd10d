"""File scans and writes, each with an explicit schema or none to infer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.functions import text as X
from corvid.functions import vectors as V

SOURCE_RECORD = "version string, lineage_key string, section_id string, section_path array<string>, title string, text string, kind string, source_file string, source_line int, table_rows array<array<string>>, metadata map<string,string>, caption string"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One section per UTF-8 file, with its name and type."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.text(path, wholetext=True).select(name.alias("file_name"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("file_type"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType = SOURCE_RECORD) -> DataFrame:
    """JSON lines, plain or gzip; a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str, gzip: bool = False) -> None:
    """JSON lines with keys in order of name."""
    df.select(*sorted(df.columns)).write.option("compression", "gzip" if gzip else "none").json(path)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgements: tab-separated query, document and grade under a header."""
    return spark.read.schema("qid string, chunk_id string, grade int").csv(path, sep="\t", header=True)


def with_grades(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    return ranked.join(judged, ["qid", "chunk_id"], "left").fillna(0, ["grade"])


def vectors(spark: SparkSession, path: str, dimensions: int | None = None) -> DataFrame:
    """Vectors from parquet; one that is not finite or of another dimension fails the read."""
    ok = V.is_usable("embedding", dimensions)
    return spark.read.parquet(path).withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.lit("bad vector"))))


def active_chunks(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks of active revisions in order of key."""
    live = versions.where("status = 'active'").select("document_id", "version", "revision")
    return chunks.join(live, ["document_id", "version", "revision"], "left_semi").orderBy("chunk_id")


def decode_payload(rows: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    return rows.withColumn("_p", F.from_json(payload, schema, {"mode": "FAILFAST"})).select(*[c for c in rows.columns if c != payload], "_p.*")


def encode_payload(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.to_json(F.struct(*sorted(df.columns))).alias("payload"))


def flatten_metadata(df: DataFrame, column: str = "metadata", prefix: str = "meta_") -> DataFrame:
    """A JSON object's scalars under prefixed keys, as a map; nulls, lists and objects go."""
    names, text = F.json_object_keys(column), F.col(column)
    value = lambda k: F.call_function("get_json_object", text, F.concat(F.lit("$['"), k, F.lit("']")))
    scalar = F.filter(names, lambda k: value(k).isNotNull() & ~F.regexp_like(value(k), F.lit(r"^\s*[\[{]")))
    return df.withColumn(column, F.map_from_entries(F.transform(scalar, lambda k: F.struct(F.concat(F.lit(prefix), k).alias("key"), value(k).alias("value")))))


def rebuild_metadata(df: DataFrame, column: str = "metadata", prefix: str = "meta_") -> DataFrame:
    """Prefixed keys back to a map of plain keys; other keys go."""
    held = F.map_filter(column, lambda k, v: F.startswith(k, F.lit(prefix)))
    return df.withColumn(column, F.transform_keys(held, lambda k, v: F.substring(k, len(prefix) + 1, 2**31 - 1)))


def evaluation_records(chunks: DataFrame) -> DataFrame:
    """Chunks as evaluation reads them: ids, version, lineage, place, text, and the text with white space squeezed."""
    return chunks.select("chunk_id", "document_id", "version", "lineage_key", "ordinal", "text", X.normalize("text").alias("normalized_text"))


def query_records(queries: DataFrame, families: DataFrame) -> DataFrame:
    """``qid, text, family_key`` of queries; a lineage without a family is its own."""
    return queries.join(families.select(F.col("lineage").alias("lineage_key"), "family"), "lineage_key", "left").select("qid", F.col("query").alias("text"), F.coalesce("family", "lineage_key").alias("family_key"))


def load_corpus(spark: SparkSession, path: str, fallback: str, schema: str) -> DataFrame:
    """The corpus as Parquet, or where there is none, from a JSON-lines export; content hashes are made anew."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    rows = spark.read.schema(schema).parquet(path) if there else json_lines(spark, fallback, schema)
    body = F.regexp_replace("text", "\r\n", "\n")
    return rows.withColumn("content_hash", F.sha2(F.concat_ws("\n", F.coalesce("kind", F.lit("text")), body), 256))


def beir(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """An unpacked collection: corpus, queries and judgements."""
    corpus = json_lines(spark, f"{folder}/corpus.jsonl", "_id string, title string, text string")
    queries = json_lines(spark, f"{folder}/queries.jsonl", "_id string, text string")
    return {
        "chunks": corpus.select(F.col("_id").alias("chunk_id"), F.concat_ws(" ", "title", "text").alias("text")),
        "queries": queries.select(F.col("_id").alias("qid"), F.col("text").alias("query")),
        "qrels": qrels(spark, f"{folder}/qrels/test.tsv"),
    }
