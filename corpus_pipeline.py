"""Training-corpus pipeline: each stage calls one operator of ``corvid.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
back as the next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import byte_bpe, decontaminate, line_dedup, parity_join, quality
from corvid.llm.cluster import free_column, materialise


#: Rows of an Arrow batch, where the session sets no number: texts are long, and every batch is held twice.
BATCH_ROWS = 1000


def _batches(spark: SparkSession) -> None:
    """The pipeline's session reads texts in batches of ``BATCH_ROWS``; plans take the number when they run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_ROWS))


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` of the text as it is now, where the column is there."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have the score of empty features and stay or go by it; repeated rows share their fate; rows with
    null ids are scored and not learned from; an empty table, or one without labels, stays as it is scored.
    """
    _batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(quality.fold("doc_id", 3) == 1, F.lit(False))
    return quality.keep_good(docs, labels, held_out=held_out)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their site, and passages repeated on it, go; documents stay.

    The site is the host of the URL where there is one, else the source. Null texts stay null, and a text of nothing but
    boilerplate becomes empty; null sites are one site; repeated rows are separate pages; an empty table stays empty.
    """
    _batches(spark)
    site = free_column(docs, "site")
    by = F.coalesce(line_dedup.url_host("url"), F.col("source")) if "url" in docs.columns else F.col("source")
    cleaned = line_dedup.drop_boilerplate(docs.withColumn(site, by), host=site, long_words=line_dedup.LONG_WORDS)
    return _counted(cleaned.drop(site))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays: the one of smallest id.

    Null ids and texts without words stay; of rows that repeat an id one stays; an empty table stays empty.
    """
    _batches(spark)
    return parity_join.keep_representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark spans are cut out of the others.

    Null and empty texts stay as they are; repeated rows are judged alike; without benchmark items nothing changes.
    """
    _batches(spark)
    return _counted(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokenise_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, their number, and the digest of what they decode to.

    Null and empty texts have no ids; repeated rows are each encoded; an empty table gives an empty result.
    """
    _batches(spark)
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.tokenised(docs, ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", tokenise_stage),
]

#: A learned classifier has no SQL form, so the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
