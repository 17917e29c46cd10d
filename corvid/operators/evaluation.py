"""Scores of ranked answers to questions, cohorts of them, comparisons, failures and reports.

Questions: ``qid, type, target_version, version_independent, gold_versions, lineage_key, acl_allowance``. Spans:
``qid, quote, version, lineage_key``. Ranked lists: ``qid, rank, chunk_id, version, lineage_key, ordinal, text``,
no longer than a result list, so pairs of spans and chunks of a question stay few.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.functions import text as X
from corvid.operators import analysis as N
from corvid.operators import retrieval as T

# Cut-offs, scored types and failure words.
KS = (1, 3, 5, 10)
SCORED = ["factoid", "exact_identifier", "table", "multi_hop", "version_specific", "unchanged_control"]
CONTROL, SPECIFIC = "unchanged_control", "version_specific"
QUANTILES = {"min": 0.0, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}
LENGTHS = [("under_50", 50), ("50_99", 100), ("100_299", 300), ("300_1499", 1500), ("1500_plus", 2**62)]


def allowed_versions() -> Column:
    """Versions in which a question's evidence counts: those of its spans for a control, the gold ones if it does
    not depend on the version, else the target."""
    independent = F.col("version_independent") & (F.col("type") != SPECIFIC)
    return F.when(F.col("type") == CONTROL, F.col("span_versions")).when(independent, F.col("gold_versions")).otherwise(F.array("target_version"))


def _with_versions(questions: DataFrame, spans: DataFrame) -> DataFrame:
    per = spans.groupBy("qid").agg(F.collect_set("version").alias("span_versions"), F.collect_set(F.coalesce("lineage_key", F.lit(""))).alias("span_lineages"))
    q = questions.join(per, "qid", "left").withColumn("versions", allowed_versions())
    return q.withColumn("lineages", F.array_distinct(F.concat(F.array(F.coalesce("lineage_key", F.lit(""))), F.coalesce("span_lineages", F.array().cast("array<string>")))))


def _quotes(spans: DataFrame) -> DataFrame:
    return spans.select("qid", X.normalize("quote").alias("unit"), "version", "lineage_key").where("unit <> ''")


def covered(questions: DataFrame, spans: DataFrame, ranked: DataFrame) -> DataFrame:
    """``qid, rank, unit``: normalised quotes that each ranked chunk of an allowed version holds; lineage does not matter."""
    q = _with_versions(questions, spans).select("qid", "versions")
    chunks = ranked.select("qid", "rank", F.col("version").alias("chunk_version"), X.normalize("text").alias("body")).join(q, "qid").where(F.array_contains("versions", F.col("chunk_version")))
    return chunks.join(_quotes(spans).select("qid", "unit").distinct(), "qid").where(F.contains("body", F.col("unit"))).select("qid", "rank", "unit")


def windowed_units(questions: DataFrame, spans: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """``qid, unit`` of quotes that stand in the first ``k`` chunks of a (version, lineage) put in order."""
    place = F.struct(F.coalesce(F.col("ordinal").cast("long"), F.lit(2**62)), F.col("chunk_id").cast("string").alias("c"), "text")
    joined = ranked.where(F.col("rank") <= k).groupBy("qid", "version", "lineage_key").agg(X.normalize(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda r: r["text"]), " ")).alias("window"))
    q = _with_versions(questions, spans).select("qid", "type", "versions")
    met = joined.withColumnRenamed("version", "v").drop("lineage_key").join(q, "qid").join(_quotes(spans).select("qid", "unit", "version"), "qid")
    ok = F.when(F.col("type") == CONTROL, F.col("v") == F.col("version")).otherwise(F.array_contains("versions", F.col("v")))
    return met.where(ok & F.contains("window", F.col("unit"))).select("qid", "unit").distinct()


def family(key: Column | str) -> Column:
    """A lineage without its block suffix."""
    return F.substring_index(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")), "#", 1)


def score_questions(questions: DataFrame, spans: DataFrame, ranked: DataFrame, relevant: DataFrame | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """A row of metrics for each scored question; those of other kinds are null.

    ``relevant``: ``qid, document_id, version`` of accessible correct chunks and ``scopes``: ``qid, product_version,
    scopes`` give ``false_exclusion`` of controls. A scored question without evidence is an error.
    """
    scored = questions.where(F.col("type").isin(SCORED) | ((F.col("type") == "acl") & F.col("acl_allowance")))
    q = _with_versions(scored, spans)
    total = _quotes(spans).groupBy("qid").agg(F.countDistinct("unit").alias("total"))
    base = q.join(total, "qid", "left").withColumn("total", F.when(F.col("total").isNull(), F.raise_error(F.concat(F.lit("scored question has no evidence: "), F.col("qid").cast("string")))).otherwise(F.col("total")))
    hits = covered(scored, spans, ranked)
    basic = N.question_metrics(hits, base.select("qid", "total"), KS)
    windows = windowed_units(scored, spans, ranked).groupBy("qid").agg(F.count("*").alias("w"))
    own = q.select("qid", "type", "versions", "lineages", "target_version")
    near = ranked.withColumnRenamed("version", "v").join(own, "qid")
    same_family = F.array_contains(F.transform("lineages", family), family("lineage_key")) & F.array_contains("versions", F.col("v"))
    families = near.where((F.col("rank") <= 5) & same_family).select("qid").distinct().withColumn("f", F.lit(1.0))
    first = hits.groupBy("qid").agg(F.min("rank").alias("first"))
    wrong = near.where((F.col("type") == SPECIFIC) & F.array_contains("lineages", F.col("lineage_key")) & (F.col("v") != F.col("target_version"))).join(first, "qid", "left")
    wrong = wrong.where(F.col("first").isNull() | (F.col("rank") < F.col("first"))).groupBy("qid").agg(F.min("rank").alias("wrong"))
    top = near.where("rank = 1").select("qid", (~F.array_contains("lineages", F.coalesce("lineage_key", F.lit("")))).cast("double").alias("other"))
    out = base.select("qid", "type", "total").join(basic, "qid").join(windows, "qid", "left").join(families, "qid", "left").join(wrong, "qid", "left").join(top, "qid", "left")
    specific = F.col("type") == SPECIFIC
    cols = ["qid", "type", *[c for c in basic.columns if c != "qid"], F.round(F.coalesce("w", F.lit(0)) / F.col("total"), 6).alias("windowed_recall_5"), F.coalesce("f", F.lit(0.0)).alias("section_family_recall_5")]
    cols += [F.when(specific, F.col("recall_1")).alias("correct_version_recall_1"), F.when(specific, F.coalesce("other", F.lit(0.0))).alias("top1_different_lineage_1")]
    cols += [F.when(specific, F.coalesce((F.col("wrong") <= k).cast("int"), F.lit(0))).alias(f"version_confusion_{k}") for k in KS]
    out = out.select(*cols)
    if relevant is None:
        return out
    kept = relevant.join(scopes, "qid", "left").select("qid", T.scope_matches(F.col("product_version"), F.col("scopes")).cast("int").alias("ok"))
    lost = kept.groupBy("qid").agg((1 - F.max("ok")).cast("double").alias("lost"))
    return out.join(lost, "qid", "left").withColumn("false_exclusion", F.when(F.col("type") == CONTROL, F.col("lost"))).drop("lost")


def guard_nonzero(rows: DataFrame, metric: str, by: str = "arm") -> DataFrame:
    """``rows``; reading them fails if an arm scored exactly zero on all of its scored questions."""
    most = rows.groupBy(by).agg(F.max(F.abs(F.col(metric))).alias("_most"))
    silent = F.raise_error(F.concat(F.lit("retrieval arm scored exactly zero: "), F.col(by)))
    return rows.join(F.broadcast(most), by).withColumn(metric, F.when(F.col("_most") == 0, silent).otherwise(F.col(metric))).drop("_most")


def distribution(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Number, mean and quantiles of the values of each group, nulls left out."""
    mean = rows.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"))
    return N.percentiles(rows, by, value, quantiles or QUANTILES).join(mean, by)


def cohort_metrics(rows: DataFrame, metrics: list[str], latency: str = "latency_ms") -> DataFrame:
    """Means over eligible rows, leaks and latency of each cohort of each split, in one pass of grouping sets.

    Cohorts: all, type, paraphrased, both, review method, and human or owner-written. A row is eligible for a metric
    that it has a value of.
    """
    r = rows.withColumn("by_people", F.col("review_method").isin("human", "owner_written"))
    columns = ["split", "type", "paraphrased", "review_method", "by_people"]
    sets = [["split"], ["split", "type"], ["split", "paraphrased"], ["split", "type", "paraphrased"], ["split", "review_method"], ["split", "by_people"]]
    agg = [F.count("*").alias("n"), F.sum("leakage_count").alias("leaks"), *[F.round(F.avg(m), 6).alias(m) for m in metrics], *[F.count(m).alias(f"n_{m}") for m in metrics]]
    agg += [F.round(F.percentile(latency, q), 6).alias(f"latency_p{int(q * 100)}") for q in (0.5, 0.95)]
    return N.cohorts(r, sets, columns, agg).where("not (by_people <=> false)")


def quote_share(rows: DataFrame, by: list[str], recall: str, units: str) -> DataFrame:
    """Share of all quotes of a group that were found: recall weighted by the number of quotes; null without any."""
    return rows.groupBy(*by).agg(F.round(F.sum(F.col(recall) * F.col(units)) / F.sum(units), 6).alias("share"))


def seed_average(rows: DataFrame, by: list[str], question: str, seed: str, value: str) -> DataFrame:
    """Mean over questions of the mean over seeds, and the spread of the seeds' own means."""
    per = rows.groupBy(*by, question).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.round(F.avg("m"), 6).alias("mean"))
    seeds = rows.groupBy(*by, seed).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.round(F.stddev_pop("m"), 6).alias("spread"))
    return per.join(seeds, by)


def select_best(rows: DataFrame, by: list[str], choice: str, score: str) -> DataFrame:
    """The choice of best rounded mean score in each group; the smaller one on a tie."""
    m = rows.groupBy(*by, choice).agg(F.round(F.avg(score), 6).alias("score"))
    return m.groupBy(*by).agg(F.min_by(choice, F.struct(-F.col("score"), F.col(choice))).alias(choice), F.max("score").alias("score"))


def paired(left: DataFrame, right: DataFrame, metric: str) -> DataFrame:
    """``qid, lineage_key, difference``; questions or lineages that the two sides do not share are an error."""
    a, b = (df.where(F.col(metric).isNotNull()).select("qid", F.col("lineage_key").alias(f"l{s}"), F.col(metric).alias(s)) for df, s in ((left, "a"), (right, "b")))
    both = a.join(b, "qid", "full_outer")
    same = F.col("la").isNotNull() & F.col("lb").isNotNull() & (F.col("la") == F.col("lb"))
    value = F.when(same, F.col("a") - F.col("b")).otherwise(F.raise_error(F.lit("paired comparison requires identical questions and lineages")).cast("double"))
    return both.select("qid", F.col("la").alias("lineage_key"), value.alias("difference"))


def compare(left: DataFrame, right: DataFrame, metric: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """Mean difference of two systems, its interval over resampled lineages, and whether it is within noise."""
    out = N.cluster_bootstrap(paired(left, right, metric), "lineage_key", "difference", draws, seed)
    return out.withColumn("within_noise", F.lit(0.0).between(F.col("low"), F.col("high")))


def simple_harness(cases: DataFrame, relevant: DataFrame, ranked: DataFrame) -> DataFrame:
    """``qid, recall, reciprocal_rank, abstention_hit, missed`` of regression cases (``qid, expected_abstain``).

    A case without relevant ids is right if nothing is returned. Duplicated ids in a list count once.
    """
    got = ranked.groupBy("qid").agg(F.count("*").alias("returned"))
    want = relevant.select("qid", "chunk_id").distinct()
    hits = ranked.join(want, ["qid", "chunk_id"]).groupBy("qid").agg(F.countDistinct("chunk_id").alias("found"), F.min("rank").alias("first"))
    r = cases.join(got, "qid", "left").join(want.groupBy("qid").agg(F.count("*").alias("total")), "qid", "left").join(hits, "qid", "left").fillna(0, ["returned", "total", "found"])
    labelled, empty = F.col("total") > 0, F.col("returned") == 0
    recall = F.when(labelled, F.col("found") / F.col("total")).otherwise(empty.cast("double"))
    return r.select("qid", F.round(recall, 6).alias("recall"), F.round(F.when(labelled, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).otherwise(0.0), 6).alias("reciprocal_rank"), (empty == F.col("expected_abstain")).alias("abstention_hit"), (labelled & (F.col("found") == 0)).alias("missed"))


def harness_summary(scored: DataFrame) -> DataFrame:
    """Cases, mean recall and reciprocal rank, abstention accuracy and the number of misses; zeros without cases."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return scored.agg(F.count("*").alias("cases"), mean(F.col("recall")).alias("recall_at_k"), mean(F.col("reciprocal_rank")).alias("mean_reciprocal_rank"), mean(F.col("abstention_hit").cast("double")).alias("abstention_accuracy"), F.coalesce(F.sum(F.col("missed").cast("long")), F.lit(0)).alias("misses"))


def failure_category(confusion: Column, relevant: Column, kind: Column, expected: Column, top_text: Column) -> Column:
    """Wrong version, then text gap, then identifier not matched, then other."""
    named = F.transform(F.regexp_extract_all(expected, F.lit("[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+"), F.lit(0)), F.lower)
    missing = (F.size(named) > 0) & ~F.exists(named, lambda i: F.contains(F.lower(F.coalesce(top_text, F.lit(""))), i))
    return F.when(F.coalesce(confusion, F.lit(0)) > 0, "wrong version").when(relevant == 0, "text gap").when((kind == "exact_identifier") & missing, "identifier not matched").otherwise("other")


def worst(rows: DataFrame, limit: int = 30) -> DataFrame:
    """The worst failures: any of completeness, reciprocal rank and nDCG below one, in order of these and recall."""
    bad = rows.where("ndcg_10 is not null and (all_10 < 1 or mrr < 1 or ndcg_10 < 1)")
    return bad.orderBy("all_10", "recall_10", "ndcg_10", "mrr", "qid").limit(limit)


def length_histogram(rows: DataFrame, length: str) -> DataFrame:
    """``bucket, n`` over fixed bounds of text length; empty buckets too."""
    kind = F.lit(LENGTHS[-1][0])
    for name, end in reversed(LENGTHS[:-1]):
        kind = F.when(F.col(length) < end, name).otherwise(kind)
    names = rows.sparkSession.createDataFrame([(n,) for n, _ in LENGTHS], "bucket string")
    return names.join(rows.groupBy(kind.alias("bucket")).agg(F.count("*").alias("n")), "bucket", "left").fillna(0, ["n"])


def findings(metrics: DataFrame, arm: str, baseline: str, columns: list[str]) -> DataFrame:
    """``metric, arm, baseline, difference`` of two arms' means over the questions that both answered."""
    a, b = (metrics.where(F.col("arm") == n).select("qid", *[F.col(c).alias(f"{c}_{s}") for c in columns]) for n, s in ((arm, "a"), (baseline, "b")))
    means = a.join(b, "qid").agg(*[F.avg(f"{c}_{s}").alias(f"{c}_{s}") for c in columns for s in "ab"])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.round(f"{c}_a", 6).alias("arm"), F.round(f"{c}_b", 6).alias("baseline"), F.round(F.col(f"{c}_a") - F.col(f"{c}_b"), 6).alias("difference")) for c in columns])
    return means.select(F.explode(rows).alias("r")).select("r.*")


def markdown_report(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A small result as a Markdown table; a larger one than ``limit`` is an error, as reports hold aggregates."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report holds at most {limit} rows")
    show = lambda v: "—" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def check_arms(arms: dict[str, dict], parents: dict[str, str]) -> None:
    """Every arm differs from its parent by exactly one setting."""
    for name, parent in parents.items():
        changed = {k for k in arms[name].keys() | arms[parent].keys() if arms[name].get(k) != arms[parent].get(k)}
        if len(changed) != 1:
            raise ValueError(f"arm {name} must differ from {parent} by one setting, not by {sorted(changed)}")


def load_config(path: str, required: list[str]) -> dict:
    """A JSON configuration, or a YAML one where a reader is installed; missing keys are an error."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as absent:
            raise ValueError(f"{path} is not JSON, and no YAML reader is installed") from absent
        value = yaml.safe_load(text)
    missing = [k for k in required if k not in value]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return value


def occurrences(rows: DataFrame, by: list[str], order: list[Column], name: str = "occurrence") -> DataFrame:
    """Rows numbered from 0 within each group: ordinals, repeats of a path, slots of a line and kind."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
