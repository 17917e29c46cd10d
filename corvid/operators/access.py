"""Who sees what, and which versions a query means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.functions import text as X
from corvid.operators.ranking import small


def explode_grants(policies: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, kind, grantee`` rows from ``public, principals, groups``; a null policy is public, an empty one nobody's."""
    grants = F.concat(
        F.when(F.col("public").isNull() | F.col("public"), F.array(F.struct(F.lit("public").alias("kind"), F.lit("*").alias("grantee")))).otherwise(F.array().cast("array<struct<kind:string,grantee:string>>")),
        F.transform(F.coalesce("principals", F.array().cast("array<string>")), lambda p: F.struct(F.lit("principal").alias("kind"), p.alias("grantee"))),
        F.transform(F.coalesce("groups", F.array().cast("array<string>")), lambda g: F.struct(F.lit("group").alias("kind"), g.alias("grantee"))),
    )
    return policies.select(key, F.explode(grants).alias("g")).select(key, "g.kind", "g.grantee").distinct()


def visible(grants: DataFrame, requesters: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``requester, key`` pairs that may be read: equi-joins on grantees instead of one OR condition.

    What is open to everybody is kept apart: it meets all requesters without a shuffle on the one key ``*``.
    """
    everybody = F.col("grantee") == "*"
    open_ = grants.where(everybody & F.col("kind").isin("public", "principal", "group")).select(key).distinct().crossJoin(small(requesters.select("requester").distinct())).select("requester", key)
    own = F.concat(F.array(F.struct(F.lit("principal").alias("kind"), F.col("principal").alias("grantee"))), F.transform("groups", lambda g: F.struct(F.lit("group").alias("kind"), g.alias("grantee"))))
    identity = requesters.select("requester", F.explode(own).alias("g")).select("requester", "g.kind", "g.grantee").where("grantee is not null").distinct()
    named = grants.where(~everybody).join(small(identity), ["kind", "grantee"]).select("requester", key)
    return open_.union(named).distinct()


def readable(policies: DataFrame, requesters: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``requester, key`` pairs that may be read, by the policies as they stand: the OR condition over few
    requesters, that shares nothing with ``explode_grants``, ``visible`` or ``SecuredTable`` and so can judge them."""
    who = requesters.select("requester", F.col("principal").alias("_principal"), F.col("groups").alias("_groups"))
    may = F.col("public").isNull() | F.col("public")
    for given in (F.array_contains("principals", F.col("_principal")), F.arrays_overlap("groups", F.col("_groups"))):
        may = may | F.coalesce(given, F.lit(False))
    return policies.crossJoin(F.broadcast(who)).where(may).select("requester", key)


class SecuredTable:
    """A table that can only be read through its grants: the row-level-security form of ``visible``."""

    def __init__(self, rows: DataFrame, grants: DataFrame, key: str = "chunk_id") -> None:
        self.__rows, self.__grants, self.__key = rows, grants, key

    def read(self, principal: str | None, groups: list[str]) -> DataFrame:
        mine = (F.col("grantee") == "*") | ((F.col("kind") == "principal") & (F.col("grantee") == F.lit(principal))) | ((F.col("kind") == "group") & F.col("grantee").isin(groups))
        return self.__rows.join(self.__grants.where(mine).select(self.__key).distinct(), self.__key, "left_semi")


def restricted(path: Column, titles: list[str]) -> Column:
    """Whether a restricted title is part of the joined section path, case aside."""
    joined = F.lower(F.array_join(path, " / "))
    return F.exists(F.array(*[F.lit(t.lower()) for t in titles]), lambda t: F.contains(joined, t))


def leaked(results: DataFrame, allowed: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Results that their requester may not read; must be empty."""
    return results.join(allowed, ["requester", key], "left_anti")


def available_versions(rows: DataFrame) -> DataFrame:
    """``document_id, versions``: active labels of each document in natural order."""
    return rows.groupBy("document_id").agg(F.collect_set("version").alias("v")).select("document_id", F.transform(F.array_sort(F.transform("v", lambda x: F.struct(X.version_key(x).alias("k"), x.alias("x")))), lambda s: s["x"]).alias("versions"))


def latest_versions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("document_id").agg(F.max_by("version", X.version_key("version")).alias("version"))


SCOPES = "array<struct<document_id:string,version:string>>"


def resolve_scope(requests: DataFrame, seen: DataFrame, default_mode: str = "none") -> DataFrame:
    """Requests with ``product_version, scopes`` as resolved, and ``status, versions``.

    ``seen``: ``qid, document_id, version`` that each request may read; only their labels count. The mode is the
    request's ``version_mode``, else explicit where it names a ``product_version``, else the default: ``none`` and an
    explicit ``all`` clear the filters; an explicit ``latest`` takes each document's newest version; an explicit version
    that cannot be read gives no scopes and is not echoed; ``auto`` takes the one label that the query names and is
    ambiguous, and unscoped, where it names none or several of several.
    """
    per = seen.groupBy("qid").agg(F.collect_set(F.struct(X.version_key("version").alias("k"), F.col("version").alias("v"))).alias("l"))
    newest = seen.groupBy("qid", "document_id").agg(F.max_by("version", X.version_key("version")).alias("version"))
    newest = newest.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("document_id", "version"))).alias("_latest"))
    q = requests.join(per, "qid", "left").join(newest, "qid", "left")
    empty, none = F.array().cast("array<string>"), F.array().cast(SCOPES)
    q = q.withColumn("_labels", F.coalesce(F.transform(F.array_sort("l"), lambda x: x["v"]), empty)).withColumn("_latest", F.coalesce("_latest", none)).drop("l")
    held = lambda c, kind: F.col(c) if c in requests.columns else F.lit(None).cast(kind)
    wanted = held("product_version", "string")
    q = q.withColumn("_mode", F.coalesce(held("version_mode", "string"), F.when(wanted.isNotNull(), "explicit"), F.lit(default_mode))).withColumn("_pick", F.coalesce(held("version_selector", "string"), F.lit("exact")))
    q = q.withColumn("_named", F.when(F.col("_mode") == "auto", X.mentioned_versions("query", F.col("_labels"))).otherwise(empty))
    mode = lambda m, pick=None: (F.col("_mode") == m) & (F.lit(True) if pick is None else F.col("_pick") == pick)
    exact, there = mode("explicit") & ~F.col("_pick").isin("all", "latest"), F.coalesce(F.array_contains("_labels", wanted), F.lit(False))
    one = mode("auto") & (F.size("_named") == 1)
    missing = F.raise_error(F.lit("explicit exact scope requires product_version")).cast("string")
    version = F.when(exact & wanted.isNull(), missing).when(exact, wanted).when(one, F.get("_named", F.lit(0)))
    scopes = F.when(mode("explicit", "latest"), F.col("_latest")).when(exact & ~there, none)
    ambiguous = mode("auto") & ~one & ((F.size("_named") > 1) | (F.size("_labels") > 1))
    labels_of = lambda s: F.array_distinct(F.transform(s, lambda x: x["version"]))
    newest_labels = F.filter("_labels", lambda v: F.array_contains(labels_of(F.col("_latest")), v))
    versions = F.when(mode("explicit", "latest"), newest_labels).when(exact, F.when(there, F.array(wanted)).otherwise(empty)).when(mode("auto") & (F.size("_named") > 0), F.col("_named")).otherwise(F.col("_labels"))
    out = q.withColumn("_v", version).withColumn("_s", scopes).withColumn("status", F.when(ambiguous, "ambiguous").otherwise("resolved")).withColumn("versions", versions)
    return out.withColumn("product_version", F.col("_v")).withColumn("scopes", F.col("_s")).drop("_v", "_s", "_labels", "_latest", "_mode", "_pick", "_named")


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
