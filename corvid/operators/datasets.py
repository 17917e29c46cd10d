"""Benchmark and training sets: families and splits, drafts, validation, gold, passages, generated queries, negatives.

Source records: ``version, lineage, section_id, section_path, text, kind, line, metadata``. Every rule is a column;
the first that fails is a draft's reason, and a validator collects all of them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.window import Window

from corvid.functions import text as X
from corvid.operators import analysis as N
from corvid.operators.ranking import small
from corvid.tables import Scratch

# Question types with their targets, methods, styles, and the patterns that drafts are judged by.
TARGETS = {"factoid": 35, "exact_identifier": 35, "table": 25, "multi_hop": 12, "version_specific": 50, "unchanged_control": 25, "version_unavailable": 10, "unanswerable": 18, "acl": 8}
METHODS = ["human", "model_audit", "owner_written"]
FLAGS = ["answerability", "acl_allowance", "validated", "paraphrased", "version_independent"]
NAMES = ["id", "question", "target_version", "requester", "lineage_key", "author"]
META = r"(?i)\b(?:the|this|given|provided|above)\s+(?:passage|text|section)\b"
FILLER = (
    r"(?i)\b(?:placeholder|TODO|TBD|lorem ipsum|variant\s*\d+)\b|what (?:does .* (?:say|state)|is (?:stated|mentioned|documented))\??$"
    r"|which (?:exact )?identifier is (?:named|shown)|what (?:row is listed|changed in)"
)
VAGUE = r"(?i)^(?:what is (?:the (?:default )?value|it|this|that)|how does (?:it|this|that) work|what can you tell me about (?:it|this|that))\?$"
NO_ANSWER = "Not answerable"
NEGATIVE = ["unanswerable", "version_unavailable"]
DIFFERENT = ["version_specific", "unchanged_control", "version_unavailable"]
NAME = r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?\b"
CALL = r"\b([A-Za-z_][A-Za-z0-9_]*\s*)\("


# --- families and splits ------------------------------------------------------------------------
def section_family() -> Column:
    """Family of a record: the lineage that its metadata names, else that of its section."""
    return F.coalesce(F.try_element_at("metadata", F.lit("section_lineage")), F.concat(F.lit("pg-section:"), "section_id"))


def family_map(records: DataFrame) -> DataFrame:
    """``lineage, family``; a lineage of several families is an error."""
    r = records.select("lineage", section_family().alias("family")).groupBy("lineage").agg(F.min("family").alias("family"), F.max("family").alias("most"))
    clash = F.raise_error(F.concat(F.lit("conflicting family identity: "), "lineage"))
    return r.select("lineage", F.when(F.col("family") == F.col("most"), F.col("family")).otherwise(clash).alias("family"))


def isolation_errors(assignments: DataFrame, families: DataFrame, components: DataFrame | None = None, exposed: DataFrame | None = None) -> DataFrame:
    """``error, key``: lineages without a family, families or components of several splits, exposed blind families."""
    joined = assignments.join(families, "lineage", "left")
    out = joined.where("family is null").select(F.lit("lineage missing family metadata").alias("error"), F.col("lineage").alias("key"))
    per = joined.where("family is not null").groupBy("family").agg(F.collect_set("split").alias("splits"))
    out = out.unionByName(per.where(F.size("splits") > 1).select(F.lit("section family spans splits").alias("error"), F.col("family").alias("key")))
    if components is not None:  # family, component
        met = components.join(per, "family", "left")
        lost = met.where("splits is null").select(F.lit("connected family missing from assignments").alias("error"), F.col("family").alias("key"))
        mixed = met.where("splits is not null").groupBy("component").agg(F.size(F.array_distinct(F.flatten(F.collect_list("splits")))).alias("n")).where("n > 1")
        out = out.unionByName(lost).unionByName(mixed.select(F.lit("family component spans splits").alias("error"), F.col("component").cast("string").alias("key")))
    if exposed is not None:
        bad = per.where(F.array_contains("splits", "blind")).join(exposed.select("family"), "family", "left_semi")
        out = out.unionByName(bad.select(F.lit("exposed question family in blind").alias("error"), F.col("family").alias("key")))
    return out


def assign_splits(records: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """``lineage, split``: families keep their split, new blocks inherit it, new families are dealt by hash; lineages
    that have gone stay only if they are blind. With earlier assignments the blind pool never grows."""
    current = family_map(records)
    if previous is None:
        return current.select("lineage", X.split_name("family").alias("split"))
    known = previous.join(current, "lineage", "left").select("lineage", "split", F.coalesce("family", "lineage").alias("family"))
    kept = known.groupBy("family").agg(F.min("split").alias("kept"), F.max("split").alias("most"))
    clash = F.raise_error(F.concat(F.lit("family split migration required: "), "family"))
    kept = kept.select("family", F.when(F.col("kept") == F.col("most"), F.col("kept")).otherwise(clash).alias("kept"))
    now = current.join(kept, "family", "left").select("lineage", F.coalesce("kept", X.split_name("family", refresh=True)).alias("split"))
    return now.unionByName(previous.where("split = 'blind'").select("lineage", "split").join(current, "lineage", "left_anti"))


def record_splits(records: DataFrame, assignments: DataFrame, families: DataFrame) -> DataFrame:
    """Records with ``family`` and ``split``: by the lineage's family, else that of the parent named in its metadata, else itself."""
    split = families.join(assignments, "lineage", "right").select(F.coalesce("family", "lineage").alias("family"), "split").distinct()
    parent = F.try_element_at("metadata", F.lit("section_lineage"))
    f = small(families.select(F.col("lineage").alias("_l"), F.col("family").alias("_f")))
    g = small(families.select(F.col("lineage").alias("_p"), F.col("family").alias("_g")))
    r = records.join(f, F.col("lineage") == F.col("_l"), "left").join(g, parent == F.col("_p"), "left")
    r = r.withColumn("family", F.coalesce("_f", "_g", "lineage")).drop("_l", "_f", "_p", "_g")
    own = assignments.select("lineage", F.col("split").alias("_own"))
    return r.join(small(split), "family", "left").join(small(own), "lineage", "left").withColumn("split", F.coalesce("split", "_own")).drop("_own")


def train_only(records: DataFrame) -> DataFrame:
    """``records`` as they are; reading them fails if one is not of the train split."""
    bad = F.raise_error(F.concat(F.lit("record does not belong to train: "), "lineage"))
    return records.withColumn("split", F.when(F.col("split") == "train", F.col("split")).otherwise(bad))


def refresh_manifest(records: DataFrame, assignments: DataFrame, previous: DataFrame) -> DataFrame:
    """Manifest ``lineage, family, section_id, versions, kinds, active``: current lineages anew, assigned former ones inactive."""
    now = records.withColumn("family", section_family()).groupBy("lineage").agg(F.min("family").alias("family"), F.min("section_id").alias("section_id"), F.array_sort(F.collect_set("version")).alias("versions"), F.array_sort(F.collect_set("kind")).alias("kinds")).withColumn("active", F.lit(True))
    old = previous.join(assignments.select("lineage"), "lineage", "left_semi").join(now, "lineage", "left_anti").withColumn("active", F.lit(False))
    return now.unionByName(old.select(*now.columns))


def manifest_errors(manifest: DataFrame, assignments: DataFrame, records: DataFrame) -> DataFrame:
    """``error, key``: manifest and assignments that do not cover each other, identities and records that disagree."""
    a, m = assignments.select("lineage"), manifest.select("lineage")
    one = lambda df, text, key="lineage": df.select(F.lit(text).alias("error"), F.col(key).cast("string").alias("key"))
    out = one(a.join(m, "lineage", "left_anti").unionByName(m.join(a, "lineage", "left_anti")), "manifest does not cover exactly the assigned lineages")
    met = records.select("lineage", "version", "kind", section_family().alias("own")).distinct().join(manifest, "lineage", "left")
    out = out.unionByName(one(met.where(F.col("family").isNull() | (F.col("family") != F.col("own"))), "source record family mismatch"))
    absent = ~F.array_contains("versions", F.col("version")) | ~F.array_contains("kinds", F.col("kind"))
    out = out.unionByName(one(met.where((F.col("family") == F.col("own")) & absent), "source record absent from manifest"))
    return out.unionByName(isolation_errors(assignments, manifest.select("lineage", "family")))


# --- evidence -----------------------------------------------------------------------------------
def span_pattern(quote: Column) -> Column:
    """Pattern of a quote in which any white space stands for any other."""
    words = F.filter(F.split(quote, r"(?U)\s+"), lambda w: w != "")
    return F.concat(F.lit("(?U)"), F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), r"\s+"))


def exact_span(text: Column, quote: Column) -> Column:
    """``quote, start, end`` of the first place where the text has the quote but for white space; null if none."""
    pattern = span_pattern(quote)
    found = F.regexp_substr(text, pattern)
    start = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
    ok = F.regexp_like(quote, F.lit(r"(?U)\S")) & found.isNotNull()
    return F.when(ok, F.struct(found.alias("quote"), start.alias("start"), (start + F.length(found)).alias("end")))


def common_versions(spans: DataFrame) -> DataFrame:
    """``qid, gold_versions``: versions in which all spans of a question hold, sorted."""
    lists = spans.groupBy("qid").agg(F.collect_list("gold_versions").alias("g"))
    return lists.select("qid", F.array_sort(F.aggregate("g", F.get("g", F.lit(0)), lambda a, b: F.array_intersect(a, b))).alias("gold_versions"))


def question_texts(raw: DataFrame, column: str = "value") -> DataFrame:
    """Every ``question`` at any depth of JSON rows, normalised, once each, sorted."""

    def walk(value):
        if isinstance(value, dict):
            for k, v in value.items():
                if k == "question" and isinstance(v, str):
                    yield v
                yield from walk(v)
        elif isinstance(value, list):
            for v in value:
                yield from walk(v)

    found = F.pandas_udf(lambda s: s.map(lambda t: list(walk(json.loads(t))) if t else []), Y.ArrayType(Y.StringType()))
    return raw.select(F.explode(found(F.col(column))).alias("q")).select(X.normalize("q").alias("question")).where("question <> ''").distinct().orderBy("question")


def exclusions(quotes: DataFrame, questions: DataFrame) -> DataFrame:
    """Texts that training must not come near: gold quotes and questions, normalised, once each, sorted."""
    both = quotes.select(X.normalize("quote").alias("text")).unionByName(questions.select(X.normalize("question").alias("text")))
    return both.where("text <> ''").distinct().orderBy("text")


# --- drafts and gold ----------------------------------------------------------------------------
def judge_drafts(drafts: DataFrame, records: DataFrame, assignments: DataFrame, diffs: DataFrame, gold: DataFrame, stable: DataFrame, acl: dict, seen: DataFrame | None = None) -> DataFrame:
    """``n, reason, id, split, spans, gold_versions, acl_allowance`` of every draft; ``reason`` is null where it is accepted.

    ``drafts``: ``n, question, type, lineage_key, target_version, paraphrased, version_independent, expected_answer,
    evidence (array of lineage_key, version, quote), diff_id, invented_identifier, unavailable_identifier, requester``.
    Rules are tried in a fixed order and the first that fails is the reason; of equal questions the first accepted one
    stays, so repeats are judged after everything else.
    """
    allowed_groups, restricted = acl.get("restricted_allowed_groups", []), [t.lower() for t in acl.get("restricted_section_titles", [])]
    principals = {p["id"]: bool(set(p.get("groups", [])) & set(allowed_groups)) for p in acl.get("principals", [])}
    denied = acl.get("restricted_requesters", [])
    d = drafts.withColumn("question", F.trim("question")).withColumn("key", F.lower(X.normalize("question")))
    split = assignments.select(F.col("lineage").alias("lineage_key"), "split")
    d = d.join(small(split), "lineage_key", "left")
    answerable = ~F.col("type").isin(NEGATIVE)
    none = F.array().cast("array<struct<lineage_key:string,version:string,quote:string>>")
    d = d.withColumn("evidence", F.coalesce("evidence", none))
    spans = d.select("n", "type", "version_independent", F.col("split").alias("own"), "target_version", F.col("lineage_key").alias("primary"), F.posexplode("evidence").alias("p", "e"))
    spans = spans.select("n", "type", "version_independent", "own", "target_version", "p", F.coalesce("e.lineage_key", "primary").alias("lineage"), F.coalesce("e.version", "target_version").alias("version"), F.col("e.quote").alias("asked"))
    spans = spans.join(small(assignments.select("lineage", F.col("split").alias("there"))), "lineage", "left").join(small(stable.withColumn("is_stable", F.lit(True))), "lineage", "left")
    found = spans.join(records.select("lineage", "version", "line", F.col("kind").alias("source_kind"), "section_path", "text"), ["lineage", "version"], "left").withColumn("at", exact_span(F.col("text"), F.col("asked")))
    first = found.groupBy("n", "p").agg(F.min_by(F.struct("at", "source_kind", "section_path", "line"), F.struct(F.col("at").isNull(), "line", "source_kind")).alias("hit"))
    spans = spans.join(first, ["n", "p"]).join(gold.select("lineage", "version", "versions"), ["lineage", "version"], "left")
    joined = F.lower(F.array_join("hit.section_path", " / "))
    hidden = F.exists(F.array(*[F.lit(t) for t in restricted]), lambda t: F.contains(joined, t)) if restricted else F.lit(False)
    trouble = (
        F.when(~F.coalesce(F.col("there").isin("dev", "test"), F.lit(False)), "evidence lineage is not dev/test")
        .when(F.col("there") != F.col("own"), "evidence crosses dev/test split")
        .when((F.col("type") != "unchanged_control") & (F.col("version") != F.col("target_version")), "evidence version differs from target")
        .when(F.col("hit.at").isNull(), "quote absent from full source")
        .when((F.col("type") == "table") & (F.col("hit.source_kind") != "table"), "table question requires a table source")
        .when((F.col("type") == "acl") & ~F.coalesce(hidden, F.lit(False)), "ACL source is not restricted")
        .when(F.col("version_independent") & F.col("is_stable").isNull(), "version-independent source has changed")
    )
    held = F.struct("p", F.col("lineage").alias("lineage_key"), "version", F.col("hit.at.quote").alias("quote"), F.col("hit.at.start").alias("start_char"), F.col("hit.at.end").alias("end_char"), F.when(F.col("version_independent"), F.coalesce("versions", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("gold_versions"))
    per = spans.withColumn("trouble", trouble).groupBy("n").agg(F.min_by("trouble", F.when(F.col("trouble").isNotNull(), F.col("p"))).alias("trouble"), F.array_sort(F.collect_list(held)).alias("spans"))
    d = d.join(per, "n", "left").withColumn("spans", F.coalesce("spans", F.array().cast(per.schema["spans"].dataType)))
    real = diffs.where(F.exists("changes", lambda c: c["kind"] != "text_changed")).select(F.col("id").alias("diff_id"), F.col("lineage").alias("diff_lineage"))
    d = d.join(small(real), "diff_id", "left")
    # absence checks: a name is looked up in each version's texts
    asked = d.where(F.col("type").isin(NEGATIVE)).select(F.explode(F.array_compact(F.array("invented_identifier", "unavailable_identifier"))).alias("name")).where("name <> ''").distinct()
    where = records.select("version", F.lower("text").alias("low")).join(small(asked), F.contains(F.col("low"), F.lower(F.col("name")))).groupBy("name").agg(F.collect_set("version").alias("in_versions"))
    for c in ("invented_identifier", "unavailable_identifier"):
        d = d.join(where.select(F.col("name").alias(c), F.col("in_versions").alias(f"{c}_in")), c, "left")
    low, blank = F.lower("question"), lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    names = lambda c: F.contains(low, F.lower(F.col(c)))
    kinds = lambda f: F.size(F.array_distinct(F.transform("spans", lambda s: s[f])))
    n_lineages, n_versions, n_quotes = kinds("lineage_key"), kinds("version"), kinds("quote")
    words = F.size(F.filter(F.split("question", r"(?U)\s+"), lambda w: w != ""))
    number = F.regexp_replace("target_version", "^[a-z]+-", "")
    requester = F.col("requester")
    policy = F.when(requester.isin(denied), False) if denied else F.when(F.lit(False), False)
    for p, ok in principals.items():
        if ok:
            policy = policy.when(requester == p, True)
    reason = (
        F.when(F.col("question").rlike(META), "question refers to passage/text/section")
        .when(F.col("question").rlike(FILLER) | F.col("question").rlike(VAGUE) | (words < 5) | ~F.endswith("question", F.lit("?")), "placeholder or vague question")
        .when(~F.coalesce(F.col("type").isin(list(TARGETS)), F.lit(False)), "unknown question type")
        .when(~F.coalesce(F.col("split").isin("dev", "test"), F.lit(False)), "primary lineage is not dev/test")
        .when(~F.coalesce(F.col("target_version").isin([r for r in acl.get("versions", ["pg-15", "pg-16", "pg-17"])]), F.lit(False)), "unsupported target version")
        .when(F.col("paraphrased").isNull(), "paraphrased must be boolean").when(F.col("version_independent").isNull(), "version_independent must be boolean")
        .when(F.trim(F.coalesce("expected_answer", F.lit(""))) == "", "missing expected answer")
        .when(F.col("trouble").isNotNull(), F.col("trouble"))
        .when(answerable & (F.size("spans") == 0), "answerable question requires evidence")
        .when((F.col("type") == "multi_hop") & ((F.size("spans") != 2) | (n_lineages != 2)), "multi-hop requires two distinct sections")
        .when(~F.col("version_independent") & answerable & ~F.regexp_like("question", F.concat(F.lit(r"(?U)\bPostgreSQL "), number, F.lit(r"\b"))), "version-dependent question must name its version")
        .when(F.col("type").isin(DIFFERENT) & (F.col("diff_lineage").isNull() | (F.col("diff_lineage") != F.col("lineage_key"))), "missing specialized diff provenance")
        .when((F.col("type") == "unchanged_control") & ((F.size("spans") != 2) | (n_versions != 2) | (n_quotes != 1)), "control needs identical evidence in two versions")
        .when(~answerable & ((F.col("expected_answer") != NO_ANSWER) | (F.size("spans") > 0)), "unanswerable requires Not answerable and empty evidence")
        .when(~answerable & ~blank("invented_identifier") & ~names("invented_identifier"), "invented identifier absent from question")
        .when(~answerable & ~blank("invented_identifier") & F.col("invented_identifier_in").isNotNull(), "invented identifier occurs in corpus")
        .when(~answerable & blank("invented_identifier") & ~blank("unavailable_identifier") & ~names("unavailable_identifier"), "unavailable identifier absent from question")
        .when(~answerable & blank("invented_identifier") & ~blank("unavailable_identifier") & F.col("unavailable_identifier_in").isNull(), "unavailable identifier does not exist in any version")
        .when(~answerable & blank("invented_identifier") & F.array_contains("unavailable_identifier_in", F.col("target_version")), "unavailable identifier exists in requested version")
        .when(~answerable & blank("invented_identifier") & blank("unavailable_identifier"), "unanswerable requires an absence-check identifier")
        .when((F.col("type") == "acl") & policy.isNull(), "ACL requester has no configured policy")
    )
    d = d.withColumn("reason", reason)
    known = seen.select(F.lower(X.normalize("question")).alias("key")).distinct().withColumn("known", F.lit(True)) if seen is not None else None
    d = d.join(small(known), "key", "left") if known is not None else d.withColumn("known", F.lit(None).cast("boolean"))
    earlier = F.min(F.when(F.col("reason").isNull(), F.col("n"))).over(Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("reason", F.when(F.col("known") | earlier.isNotNull(), "duplicate question").otherwise(F.col("reason")))
    versions = F.aggregate("spans", F.when(F.size("spans") > 0, F.get("spans", F.lit(0))["gold_versions"]), lambda a, s: F.array_intersect(a, s["gold_versions"]))
    shared = F.when(F.col("version_independent") & (F.size("spans") > 0), F.array_sort(versions)).otherwise(F.array().cast("array<string>"))
    return d.select("n", "type", "reason", F.concat(F.lit("draft-"), F.substring(F.sha2("key", 256), 1, 16)).alias("id"), "question", "split", "spans", shared.alias("gold_versions"), F.when(F.col("type") == "acl", policy).otherwise(F.lit(True)).alias("acl_allowance"))


def draft_report(judged: DataFrame) -> DataFrame:
    """``type, accepted, discarded`` and for each reason its number: counts of an import."""
    return judged.groupBy("type").agg(F.sum(F.col("reason").isNull().cast("long")).alias("accepted"), F.sum(F.col("reason").isNotNull().cast("long")).alias("discarded"))


def refresh_drafts(drafts: DataFrame, revisions: DataFrame) -> DataFrame:
    """Drafts without the removed ones and with the replacements of a revision list (``n, action, question``)."""
    r = drafts.join(revisions.select("n", "action", F.col("question").alias("new_question")), "n", "left")
    return r.where("action is null or action <> 'remove'").withColumn("question", F.when(F.col("action") == "replace", F.col("new_question")).otherwise(F.col("question"))).drop("action", "new_question")


def unreviewed(rows: DataFrame, reviewed: DataFrame) -> DataFrame:
    return rows.join(reviewed.select("id"), "id", "left_anti")


def build_gold(candidates: DataFrame, audit: DataFrame, reviewed: DataFrame, changed_quotes: DataFrame) -> DataFrame:
    """Accepted candidates as gold: the human review where there is one whose quotes still stand, else the model's audit.

    ``candidates``, ``reviewed``: ``id, quotes`` (and for reviews ``review_status, validated``); ``audit``: ``id,
    decision``; ``changed_quotes``: ``id``. The audit must cover exactly the candidates, and reviews be among them.
    """
    c = candidates.select("id", F.col("quotes").alias("own")).groupBy("id").agg(F.first("own").alias("own"), F.count("*").alias("copies"))
    a = audit.groupBy("id").agg(F.first("decision").alias("decision"), F.count("*").alias("audits"))
    r = reviewed.groupBy("id").agg(F.first("quotes").alias("theirs"), F.first("review_status").alias("status"), F.first("validated").alias("ok"), F.count("*").alias("reviews"))
    j = c.join(a, "id", "full_outer").join(r, "id", "full_outer").join(changed_quotes.select("id").distinct().withColumn("moved", F.lit(True)), "id", "left")
    fault = (
        F.when(F.col("copies") > 1, "candidate IDs are not unique").when(F.col("reviews") > 1, "reviewed IDs are not unique")
        .when(F.col("own").isNull() & F.col("decision").isNull(), "reviewed row is not present in candidates")
        .when(F.col("own").isNull() | F.col("decision").isNull(), "model audit IDs must exactly cover candidates")
    )
    j = j.withColumn("decision", F.when(fault.isNotNull(), F.raise_error(F.coalesce(fault, F.lit("")))).otherwise(F.col("decision"))).where("decision = 'accept'")
    repaired = F.col("reviews").isNotNull() & (F.coalesce("moved", F.lit(False)) | ~F.col("theirs").eqNullSafe(F.col("own")))
    human = F.col("reviews").isNotNull() & ~repaired
    j = j.withColumn("repaired", repaired).withColumn("human", human).where(~F.col("human") | ((F.col("status") == "accepted") & F.col("ok")))
    return j.select("id", F.when(F.col("human"), "human").otherwise("model_audit").alias("review_method"), F.col("repaired").alias("repaired_review"))


def final_gold() -> Column:
    return F.coalesce((F.col("validated") == F.lit(True)) & (F.col("review_status") == "accepted"), F.lit(False))


def validate_rows(rows: DataFrame, sources: DataFrame, assignments: DataFrame, gold: DataFrame, require_final: bool = False) -> DataFrame:
    """``line, id, error``: everything that is wrong with each row of a dataset.

    ``rows``: ``line``, the names and flags above, ``type, split, review_status, review_method, drafted_by,
    gold_versions, evidence (lineage_key, version, quote, gold_versions)``. ``sources``: ``lineage, version, text``.
    """
    bad = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), text if isinstance(text, Column) else F.lit(text))
    question = F.lower(X.normalize("question"))
    r = rows.withColumn("_q", F.coalesce(question, F.lit(""))).withColumn("_before", F.row_number().over(Window.partitionBy("_q").orderBy("line")) - 1)
    r = r.join(small(assignments.select(F.col("lineage").alias("lineage_key"), F.col("split").alias("_split"))), "lineage_key", "left")
    by_people = F.lit(require_final) & (F.col("split") == "blind") & F.coalesce(F.col("review_method").isin("human", "owner_written"), F.lit(False))
    checks = [bad(F.coalesce(F.trim(n), F.lit("")) == "", f"{n} must be a non-empty string") for n in NAMES] + [bad(F.col(f).isNull(), f"{f} must be boolean") for f in FLAGS]
    checks += [
        bad(~F.col("review_status").isin("accepted", "rejected"), "unknown review_status"), bad(~F.col("review_method").isin(METHODS), "unknown review_method"),
        bad(F.lit(require_final) & ~final_gold(), "final gold requires validated accepted review"), bad(F.lit(require_final) & F.col("review_method").isNull(), "final gold requires a valid review_method"),
        bad(F.col("_q") == "", "question is empty"), bad((F.col("_q") != "") & (F.col("_before") > 0), "duplicate question"),
        bad(~F.coalesce(F.col("type").isin(list(TARGETS)), F.lit(False)), "unknown type"), bad(F.col("type").isin(NEGATIVE) & F.col("answerability"), "unavailable/unanswerable type must be answerability=false"),
        bad(~F.col("_split").eqNullSafe(F.col("split")), "lineage does not have its persisted split"), bad(~F.coalesce(F.col("split").isin("dev", "test"), F.lit(False)) & ~by_people, "non-dev/test lineage appears in dataset"),
        bad(F.col("author").isin("generated", "llm_drafted") & F.col("validated") & ~(F.lit(require_final) & F.col("review_method").eqNullSafe(F.lit("model_audit"))), "draft row cannot be validated"),
        bad((F.col("author") == "llm_drafted") & (F.coalesce("drafted_by", F.lit("")) == ""), "drafted_by is required"),
    ]
    own = r.select("line", "id", F.explode(F.array_compact(F.array(*checks))).alias("error"))
    spans = r.select("line", "id", "split", "version_independent", "lineage_key", "gold_versions", F.explode("evidence").alias("e")).select("line", "id", "split", "version_independent", F.coalesce("e.lineage_key", "lineage_key").alias("lineage"), F.col("e.version").alias("version"), F.col("e.quote").alias("quote"), F.col("e.gold_versions").alias("stated"))
    spans = spans.join(sources, ["lineage", "version"], "left").join(small(assignments.select("lineage", F.col("split").alias("there"))), "lineage", "left").join(gold.select("lineage", "version", "versions"), ["lineage", "version"], "left")
    empty = F.array().cast("array<string>")
    expected = F.coalesce("versions", empty)
    wrong = F.array_compact(F.array(
        bad((F.coalesce("quote", F.lit("")) == "") | ~F.coalesce(F.contains("text", F.col("quote")), F.lit(False)), F.concat(F.lit("evidence quote absent for "), "lineage", F.lit("/"), "version")),
        bad(~F.col("there").eqNullSafe(F.col("split")), "evidence crosses lineage split"), bad(F.col("version_independent") & (F.coalesce("stated", empty) != expected), "evidence gold_versions mismatch"),
    ))
    of_spans = spans.select("line", "id", F.explode(wrong).alias("error"))
    per = spans.groupBy("line").agg(F.collect_list(expected).alias("g"), F.collect_set("lineage").alias("held"))
    whole = r.where("version_independent").select("line", "id", "lineage_key", "gold_versions").join(per, "line", "left")
    both = F.coalesce(F.array_sort(F.aggregate("g", F.get("g", F.lit(0)), lambda a, b: F.array_intersect(a, b))), empty)
    of_rows = whole.select("line", "id", F.explode(F.array_compact(F.array(bad((F.size(both) == 0) | (F.coalesce("gold_versions", empty) != both), "missing or incorrect gold_versions"), bad(~F.coalesce(F.array_contains("held", F.col("lineage_key")), F.lit(False)), "primary lineage absent from evidence")))).alias("error"))
    return own.unionByName(of_spans).unionByName(of_rows)


def target_warnings(rows: DataFrame) -> DataFrame:
    """``type, n, target`` of types with fewer dev and test rows than asked for."""
    want = rows.sparkSession.createDataFrame(list(TARGETS.items()), "type string, target int")
    return want.join(rows.where(F.col("split").isin("dev", "test")).groupBy("type").agg(F.count("*").alias("n")), "type", "left").fillna(0, ["n"]).where("n < target")


def spot_check(rows: DataFrame, kind: str, key: str, per: int = 5, seed: str = "spot", forced: DataFrame | None = None) -> DataFrame:
    """``per`` rows of each kind in order of a seeded hash, and the forced ids."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    picked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(order, key))).where(F.col("_n") <= per).drop("_n")
    return picked if forced is None else picked.unionByName(rows.join(small(forced.select(key)), key, "left_semi")).dropDuplicates([key])


# --- training sets ------------------------------------------------------------------------------
def passage_identifiers(text: Column | str) -> Column:
    """Lower-cased names with an underscore or a digit, and names that are called."""
    t = F.col(text) if isinstance(text, str) else text
    names = F.filter(F.regexp_extract_all(t, F.lit(NAME), F.lit(0)), lambda v: F.contains(v, F.lit("_")) | v.rlike(r"\d"))
    return F.array_distinct(F.transform(F.concat(names, F.regexp_extract_all(t, F.lit(CALL), F.lit(1))), F.lower))


def names_identifier(query: Column | str, passage: Column | str) -> Column:
    """Whether a query about behaviour names an identifier of its passage, which it must not."""
    return F.arrays_overlap(passage_identifiers(query), passage_identifiers(passage))


def negative_allowed(a: str = "p", b: str = "n") -> Column:
    """Whether passage ``b`` may be a negative for ``a``: another text, another content hash and another family."""
    same = lambda f: F.col(f"{a}_{f}") == F.col(f"{b}_{f}")
    text = F.lower(X.normalize(f"{a}_text")) == F.lower(X.normalize(f"{b}_text"))
    return ~F.coalesce(text, F.lit(False)) & ~F.coalesce(same("content_hash") & (F.col(f"{a}_content_hash") != ""), F.lit(False)) & ~F.coalesce(same("family"), F.lit(False))


def train_passages(records: DataFrame, quotes: DataFrame) -> DataFrame:
    """One train passage for each content, first in order of lineage and line, that qualifies and holds no gold quote.

    ``records`` carry ``split`` (see ``record_splits``), ``lineage, line, kind, text, metadata, content_hash``.
    """
    ok = X.qualifying_passage("text", F.col("kind"), X.reference_record(F.col("metadata"), F.col("lineage")))
    kept = records.where((F.col("split") == "train") & ok)
    first = kept.withColumn("_n", F.row_number().over(Window.partitionBy("content_hash").orderBy("lineage", "line"))).where("_n = 1").drop("_n")
    leaks = N.leaking(first.select(F.col("content_hash").alias("chunk_id"), "text"), quotes).select(F.col("chunk_id").alias("content_hash")).distinct()
    return first.join(leaks, "content_hash", "left_anti")


def filter_generated(queries: DataFrame, passages: DataFrame, excluded: DataFrame, ranks: DataFrame, limit: int = 200) -> DataFrame:
    """``n, outcome`` of generated queries: the first that applies of unanswerable, names_identifier, exclusion,
    not_top_200_union, near_duplicate, else kept.

    ``queries``: ``n, content_hash, text, style, answerable``. ``excluded``: ``text``. ``ranks``: ``n, rank`` of the
    query's own passage in any ranking. Near duplicates are dropped in order of ``n`` against kept ones, in groups
    that share a length band, with the bands beside.
    """
    q = queries.join(passages.select("content_hash", F.col("text").alias("passage")), "content_hash", "left")
    best = ranks.groupBy("n").agg(F.min("rank").alias("best"))
    near = near_pairs(q.select(F.col("n").alias("key"), "text"), excluded.select(F.lit(None).cast("long").alias("key"), "text")).select(F.col("a").alias("n")).distinct().withColumn("hit", F.lit(True))
    q = q.join(best, "n", "left").join(near, "n", "left")
    outcome = (
        F.when(~F.col("answerable"), "unanswerable").when((F.col("style") == "behavior") & names_identifier("text", "passage"), "names_identifier")
        .when(F.col("hit"), "exclusion").when(F.coalesce(F.col("best") > limit, F.lit(True)), "not_top_200_union")
    )
    q = q.withColumn("outcome", outcome)
    open_rows = q.where("outcome is null").select(F.col("n").alias("key"), "text")
    dropped = greedy_drop(near_pairs(open_rows, open_rows).where("a > b").select("a", "b"), open_rows.select("key"))
    return q.join(dropped.select(F.col("key").alias("n"), F.lit("near_duplicate").alias("late")), "n", "left").select("n", "style", F.coalesce("outcome", "late", F.lit("kept")).alias("outcome"))


#: Rows of a length band beyond which pairs are not made: the measure has no key that all near pairs share.
BAND_ROWS = 100_000


def near_pairs(left: DataFrame, right: DataFrame, ratio: float = 0.92) -> DataFrame:
    """``a, b, text_b``: pairs of texts (``key, text``) that are near duplicates by matching blocks.

    For sets of questions, not for corpora: a ratio of 0.92 leaves room for an edit every few characters, so no word or
    cut need survive, and only lengths bound a pair. Texts meet in bands of length, each with itself and its neighbours;
    a band of more than ``BAND_ROWS`` rows is an error. Blank texts pair with nothing.
    """
    reach = (2 - ratio) / ratio  # the longer text over the shorter, at most

    def banded(df: DataFrame, name: str) -> DataFrame:
        t = F.lower(X.normalize("text"))
        band = F.floor(F.log(F.length(t)) / F.log(F.lit(reach))).cast("int")
        return df.withColumn("_t", t).where("_t <> ''").select(F.col("key").alias(name), F.col("_t").alias(f"t_{name}"), F.length("_t").alias(f"n_{name}"), band.alias("band"))

    a, b = banded(left, "a"), banded(right, "b")
    full = b.groupBy("band").count().where(F.col("count") > BAND_ROWS).limit(1).collect()
    if full:
        raise ValueError(f"more than {BAND_ROWS} texts of about one length")
    b = b.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    met = a.join(b, "band").where((2 * low >= ratio * (low + high)) & (F.col("a").isNull() | F.col("b").isNull() | (F.col("a") != F.col("b"))))
    alike = F.pandas_udf(lambda x, y: x.combine(y, lambda p, q: N.near_duplicate(p, q, ratio)).astype(bool), Y.BooleanType())
    return met.where(alike("t_a", "t_b")).select("a", "b", F.col("t_b").alias("text_b"))


def greedy_distinct(rows: DataFrame, key: str, text: str, ratio: float = 0.92) -> DataFrame:
    """``key, kept``: in order of key, a text stays unless it is nearly one that stays."""
    own = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    dropped = greedy_drop(near_pairs(own, own, ratio).where("a > b").select("a", "b"), own.select("key"))
    return own.select("key").join(dropped.withColumn("gone", F.lit(True)), "key", "left").select(F.col("key").alias(key), F.col("gone").isNull().alias("kept"))


def greedy_drop(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``key`` of rows that a kept earlier row (``b < a``) is like, in order of key.

    A row is dropped if an earlier one that stays is like it. Rows without an undecided earlier partner are decided each
    round, so chains are resolved as one pass in order would, in as many rounds as the longest chain.
    """
    scratch = Scratch(pairs.sparkSession, "greedy")
    pairs = scratch.keep(pairs, "pairs")
    state = scratch.keep(rows.join(pairs.select(F.col("a").alias("key")).distinct().withColumn("open", F.lit(True)), "key", "left").select("key", F.when(F.col("open"), F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("kept")), "state")
    while state.where("kept is null").take(1):
        near = pairs.join(state.select(F.col("key").alias("b"), "kept"), "b").groupBy(F.col("a").alias("key")).agg(F.max(F.coalesce(F.col("kept"), F.lit(False)).cast("int")).alias("hit"), F.max(F.col("kept").isNull().cast("int")).alias("wait"))
        new = state.join(near, "key", "left").select("key", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit") == 1, F.lit(False)).when(F.col("wait") == 0, F.lit(True)).alias("kept"))
        state = scratch.keep(new, "state")
    scratch.clear("pairs")
    return state.where("not kept").select("key")


def triplets(positives: DataFrame, negatives: DataFrame, first: int = 4) -> DataFrame:
    """``i, qid, positive, negative``: the i-th training row takes its negative number ``i mod min(first, n)``.

    ``positives``: ``i, qid, chunk_id``; ``negatives``: ``qid, n, chunk_id`` numbered from 1. A question without
    negatives is an error.
    """
    lists = negatives.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))).alias("l"))
    r = positives.join(lists, "qid", "left")
    k = F.least(F.size("l"), F.lit(first))
    lost = F.raise_error(F.concat(F.lit("no negatives for question "), F.col("qid").cast("string")))
    picked = F.when(F.col("l").isNull(), lost.cast("long")).otherwise(F.element_at("l", (F.col("i") % k + 1).cast("int"))["chunk_id"])
    return r.select("i", "qid", F.col("chunk_id").alias("positive"), picked.alias("negative"))


def positive_passages(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """Queries with the text of their passage; a missing passage is an error."""
    lost = F.raise_error(F.concat(F.lit("positive passage is missing: "), "content_hash"))
    return queries.join(passages.select("content_hash", F.col("text").alias("positive_text")), "content_hash", "left").withColumn("positive_text", F.coalesce("positive_text", lost.cast("string")))


def generation_gate(trials: DataFrame) -> DataFrame:
    """``generator, valid_ratio, median_seconds, opening_diversity, passed`` of trial runs: at least .9 valid, under
    30 seconds at the median, and at least half of the openings (first three words) different."""
    opening = F.array_join(F.slice(F.split(F.lower("text"), r"\s+"), 1, 3), " ")
    g = trials.groupBy("generator").agg(F.avg(F.col("valid").cast("int")).alias("v"), F.percentile("seconds", 0.5).alias("m"), (F.countDistinct(opening) / F.count("text")).alias("o"))
    return g.select("generator", F.round("v", 6).alias("valid_ratio"), F.round("m", 6).alias("median_seconds"), F.round("o", 6).alias("opening_diversity"), ((F.col("v") >= 0.9) & (F.col("m") < 30) & (F.col("o") >= 0.5)).alias("passed"))
