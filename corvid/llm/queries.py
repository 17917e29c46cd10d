"""Contract queries of the operators: each reads whole tables and returns one row per entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, decontaminate, fill_middle, forest_search, html_extract, katz, language, license_scan, line_dedup, parity_join, periodic_runs, quality


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are the pages, and ``source`` is their site."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"), host="source")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.hit_report(docs, table(spark, sf_dir, "benchmark"))


def op3_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_search.neighbour_report(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = license_scan.document_paths(spark, table(spark, sf_dir, "documents"))
    return license_scan.license_report(files)


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_report(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back_report(chat.format_turns(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.run_report(docs, text=periodic_runs.planted(F.col("doc_id"), F.col("text")))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.middle_report(table(spark, sf_dir, "documents"))


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.text_report(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_forest_search": op3_forest_search,
    "op4_license_scan": op4_license_scan,
    "op5_katz": op5_katz,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_language": op7_language,
    "op8_chat": op8_chat,
    "op9_quality": op9_quality,
    "op10_parity_join": op10_parity_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_middle": op12_fill_middle,
    "op13_html_extract": op13_html_extract,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.REPORT_SQL,
    "op4_license_scan": license_scan.REPORT_SQL,
    "op12_fill_middle": fill_middle.REPORT_SQL,
}
