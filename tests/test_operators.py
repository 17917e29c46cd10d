"""Small cases of operators that SQL does not express, and of expressions."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.functions import text as X
from corvid.operators import access as A
from corvid.operators import analysis as N
from corvid.operators import ingest as I
from corvid.operators import ranking as R
from corvid.plans import catalogue as Q
from corvid.sources import files
from corvid.streaming import jobs

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, X.tokenize(F.lit("Disk/IO, by X_1 in fs.open(3)!"))) == ["disk/io", "disk", "io", "by", "by", "x_1", "x", "1", "in", "in", "fs.open(3)", "fs", "open", "3"]


def test_windows(spark):
    assert one(spark, X.windows(F.lit("a  b c d e f"), 4, 1)) == ["a  b c d", "d e f"]
    assert one(spark, X.windows(F.lit("  "), 4, 1)) == []


def test_support(spark):
    assert one(spark, X.lexical_support(F.lit("the work_mem is 4MB"), F.lit("work_mem defaults to 4MB"))) == 1.0
    assert one(spark, X.lexical_support(F.lit("work_mem is not 4MB"), F.lit("work_mem defaults to 4MB"))) == 0.0


def test_versions(spark):
    labels = F.array(F.lit("16"), F.lit("17"))
    assert one(spark, X.mentioned_versions(F.lit("What changed in PostgreSQL 17?"), labels)) == ["17"]
    rows = spark.createDataFrame([("d", "9.6"), ("d", "10"), ("d", "v2")], "document_id string, version string")
    assert A.latest_versions(rows).first().version == "v2"
    rows = spark.createDataFrame([("d", "9.6"), ("d", "10"), ("d", "9.10"), ("e", "1" * 30), ("e", "9" * 29), ("f", "r007"), ("f", "R8")], "document_id string, version string")
    assert {r.document_id: r.version for r in A.latest_versions(rows).collect()} == {"d": "10", "e": "1" * 30, "f": "R8"}


def test_weighted_fusion(spark):
    """Scores 4 and 2 of one list, -1 (held at 0), 8 and 6 of the other: scaled to 1 and .5, and to 0, 1 and .75."""
    d = spark.createDataFrame([(7, 10, 4.0, 1), (7, 11, 2.0, 2)], "qid int, chunk_id int, score double, rank int")
    s = spark.createDataFrame([(7, 10, -1.0, 3), (7, 11, 6.0, 2), (7, 12, 8.0, 1)], "qid int, chunk_id int, score double, rank int")
    got = [(r.chunk_id, r.hybrid_score) for r in R.fuse(d, s, "weighted", 0.4).orderBy("rank").collect()]
    assert got == [(11, 0.65), (12, 0.6), (10, 0.4)]


def test_acl_policies(spark):
    rows = [(1, None, None, None), (2, False, [], []), (3, False, ["bob"], []), (4, False, [], ["sre"]), (5, False, ["*"], [])]
    p = spark.createDataFrame(rows, "chunk_id int, public boolean, principals array<string>, groups array<string>")
    r = spark.createDataFrame([("bob", "bob", []), ("eve", "eve", ["sre"])], "requester string, principal string, groups array<string>")
    seen = {(x.requester, x.chunk_id) for x in A.visible(A.explode_grants(p), r).collect()}
    assert seen == {("bob", 1), ("bob", 3), ("bob", 5), ("eve", 1), ("eve", 4), ("eve", 5)}
    secured = A.SecuredTable(p.select("chunk_id"), A.explode_grants(p))
    assert {x.chunk_id for x in secured.read("eve", ["sre"]).collect()} == {1, 4, 5}


def test_html_and_markdown(spark):
    html = (
        "<title>T</title><h1>Top <i>rest</i></h1><p>one <b>two</b></p><li>three<p>four</p>"
        "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td></tr>stray</table><table><tr><th>h</th></tr><tr><td>x</td></tr></table>"
        "<table summary='Navigation bar'><tr><td>skip</td></tr></table><pre>  y = 1\n<pre>z</pre></pre><h2>Sub</h2><p>end"
    )
    got = [(r.heading, r.level, r.kind, r.text) for r in I.html_sections(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("pos").collect()]
    assert got == [
        (None, 0, "text", "T"), ("Top", 1, "text", "Top"), (None, 0, "text", "one two"), (None, 0, "text", "three four"), (None, 0, "table", "| a | b |\n| 1 |  |"),
        (None, 0, "table", "| h |\n| --- |\n| x |"), (None, 0, "code", "y = 1\nz"), ("Sub", 2, "text", "Sub"), (None, 0, "text", "end"),
    ]
    md = "intro\n# A\nhi\n## B\ncap\n\n| x | y |\n| --- | --- |\n| 1 | 2 |\n\n~~~\n# no\n~~~\n# C"
    rows = I.markdown_sections(spark.createDataFrame([(1, md)], "doc_id int, text string")).orderBy("pos").collect()
    assert [(r.heading, r.kind, r.text) for r in rows] == [(None, "text", "intro"), ("A", "text", "hi"), ("B", "table", "cap\n\n| x | y |\n| --- | --- |\n| 1 | 2 |"), ("B", "code", "~~~\n# no\n~~~"), ("C", "text", "C")]


def test_heading_paths(spark):
    rows = [(1, 1, 1, "A"), (1, 2, 2, "B"), (1, 3, 3, "C"), (1, 4, 2, "D"), (1, 5, 1, "E")]
    df = spark.createDataFrame(rows, "doc int, pos int, level int, title string")
    got = [r.section_path for r in I.section_paths(df, "doc", "pos", "level", "title").orderBy("pos").collect()]
    assert got == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"], ["E"]]


def test_revisions(spark):
    columns = "document_id string, version string, revision int, status string, content_hash string, parser_hash string, chunker_hash string, embedder_id string"
    versions = spark.createDataFrame([("d", "1", 1, "active", "x", "p", "c", "e"), ("d", "2", 1, "active", "y", "p", "c", "e")], columns)
    incoming = spark.createDataFrame([("d", "1", "x", "p", "c", "e"), ("d", "2", "z", "p", "c", "e"), ("n", "1", "q", "p", "c", "e")], "document_id string, version string, content_hash string, parser_hash string, chunker_hash string, embedder_id string")
    plan = I.plan_revisions(versions, incoming)
    assert {(r.document_id, r.version, r.action, r.revision) for r in plan.collect()} == {("d", "1", "unchanged", 1), ("d", "2", "insert", 2), ("n", "1", "insert", 1)}
    after = I.apply_revisions(versions, plan, incoming)
    assert {(r.document_id, r.version, r.revision, r.status) for r in after.collect()} == {("d", "1", 1, "active"), ("d", "2", 1, "superseded"), ("d", "2", 2, "active"), ("n", "1", 1, "active")}


def test_split_migration(spark):
    rows = [("a", "dev", False, False), ("b", "test", True, False), ("c", "train", False, False), ("d", "train", False, False), ("e", "blind", False, False), ("f", "test", False, False)]
    labelled = spark.createDataFrame(rows, "key string, split string, protected boolean, exposed boolean")
    comp = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("f", 2), ("e", 3)], "key string, component int")
    assert {(r.component, r.split) for r in N.migrate_splits(labelled, comp).collect()} == {(1, "dev"), (2, "train"), (3, "blind")}


def test_near_duplicates_and_embedding():
    assert N.near_duplicate("The same Words here", "the  same words here") and not N.near_duplicate("abc def", "xyz uvw")
    assert not N.near_duplicate(" ", "") and not N.near_duplicate("", "a")
    v = I.hash_embed(["a", "a"], 16)
    assert abs(sum(x * x for x in v) - 1) < 1e-12 and I.hash_embed([], 8) == [0.0] * 8


def test_files_and_stream(spark, tmp_path):
    df = spark.createDataFrame([("j1", "ingest", "{}", None)], jobs.JOB)
    files.write_json_lines(df, str(tmp_path / "jobs"), gzip=True)
    assert files.json_lines(spark, str(tmp_path / "jobs"), jobs.JOB).count() == 1
    for _ in range(2):
        jobs.run_jobs(jobs.job_stream(spark, str(tmp_path / "jobs")), lambda b: b.withColumn("done", F.lit(True)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_readable_by_policy(spark):
    policies = spark.createDataFrame([(1, True, None, None), (2, None, None, None), (3, False, ["ann"], None), (4, False, None, ["g", "h"]), (5, False, [], [])], "chunk_id long, public boolean, principals array<string>, groups array<string>")
    people = spark.createDataFrame([("a", "ann", ["x"]), ("b", None, ["h"]), ("c", "cy", [])], "requester string, principal string, groups array<string>")
    got = sorted(map(tuple, A.readable(policies, people).collect()))
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 4), ("c", 1), ("c", 2)]
    assert got == sorted(map(tuple, A.visible(A.explode_grants(policies), people).collect()))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_leakage_check_finds_grants_that_are_too_wide(spark, monkeypatch):
    assert Q.QUERIES["leakage_check"](spark, TABLES).first().leaked == 0
    exact = A.explode_grants
    monkeypatch.setattr(A, "explode_grants", lambda policies: exact(policies.withColumn("public", F.lit(True))))
    assert Q.QUERIES["leakage_check"](spark, TABLES).first().leaked > 0


def interval(groups, draws=2000):
    """Mean and interval by the reference's way of drawing: all clusters' indices at once."""
    keys = sorted(groups)
    sums, counts = np.array([sum(groups[k]) for k in keys]), np.array([len(groups[k]) for k in keys])
    picks = np.random.default_rng(42).integers(0, len(keys), (draws, len(keys)))
    return [sums.sum() / counts.sum(), *np.quantile(sums[picks].sum(axis=1) / counts[picks].sum(axis=1), [0.025, 0.975])]


def test_paired_bootstrap(spark):
    data = [(f"c{k % 7}", float(k % 5) + 1, float(k % 3)) for k in range(40)] + [("c1", None, 1.0), ("c9", 1.0, None)]
    got = N.paired_bootstrap(spark.createDataFrame(data, "c string, a double, b double"), "c", "a", "b").first()
    groups = {}
    for c, a, b in data[:40]:
        groups.setdefault(c, []).append(a - b)
    assert [got.mean, got.low, got.high] == pytest.approx(interval(groups), abs=1e-9)
    assert got.clusters == 7 and got.within_noise == (got.low <= 0 <= got.high)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_cluster_bootstrap_query_draws_as_often_as_the_reference(spark):
    groups = {}
    for r in spark.read.parquet(f"{TABLES}/events.parquet").select("user_id", "value").collect():
        groups.setdefault(str(r.user_id), []).append(r.value)
    got = Q.QUERIES["cluster_bootstrap"](spark, TABLES).first()
    assert [got.mean, got.low, got.high] == pytest.approx(interval(groups), abs=1e-9)


@pytest.mark.parametrize("size", [1 << 18, 7])
def test_bootstrap_over_buckets_equals_numpy_with_the_same_draws(spark, monkeypatch, size):
    monkeypatch.setattr(N, "BUCKET_CLUSTERS", size)
    data = [(f"c{k % 23}", float(k % 7)) for k in range(200)] + [(None, 3.0), ("c1", None)]
    df = spark.createDataFrame(data, "c string, v double").repartition(3)
    got = N.cluster_bootstrap(df, "c", "v", draws=300, seed=9).first()
    sums = {}
    for c, v in data:
        held = sums.setdefault(c, [0.0, 0])
        held[0] += v or 0.0
        held[1] += v is not None
    where = {r.c: r.b for r in df.select("c", F.pmod(F.xxhash64("c"), F.lit(-(-24 // size))).alias("b")).distinct().collect()}
    order = sorted(set(where.values()))
    own = {b: sorted((c for c in sums if where[c] == b), key=lambda c: (c is not None, c or "")) for b in order}
    taken = N.bucket_draws(9, [len(own[b]) for b in order], 300)
    assert (taken.sum(axis=1) == 24).all()
    top, rows = np.zeros(300), np.zeros(300)
    for k, b in enumerate(order):
        s, n = (np.array([sums[c][i] for c in own[b]], float) for i in (0, 1))
        t, r = N.drawn_sums(9, b, taken[:, k], s, n)
        top, rows = top + t, rows + r
    low, high = np.percentile(top / rows, [2.5, 97.5])
    assert (got.mean, got.low, got.high) == pytest.approx((sum(v[0] for v in sums.values()) / 201, low, high)) and got.clusters == 24
    # and the interval is that of the usual draws, but for chance
    s, n = (np.array([v[i] for v in sums.values()], float) for i in (0, 1))
    rng = np.random.default_rng(1)
    usual = [s[p].sum() / n[p].sum() for p in (rng.integers(0, 24, 24) for _ in range(4000))]
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(usual, [2.5, 97.5])), abs=0.12)
    assert N.cluster_bootstrap(df.limit(0), "c", "v").collect() == []
