import hashlib
import random

import duckdb
import pytest

import corpus_pipeline
from corvid.llm import line_dedup
from corvid.llm.line_dedup import drop_boilerplate, html_lines, line_report, url_host


def rows(seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(120):
        host = rng.choice(["a", "a", "a", "b", None])
        lines = [f"own {i}"] + rng.choices([" menu ", "menu", "foot", "", f"rare {i % 40}"], k=rng.randint(0, 5))
        out.append((i, "\n".join(lines), host))
    return out + [(500, None, "a"), (501, "", "b"), (3, out[3][1], out[3][2]), (502, "menu\n" * 30_000 + "end", "a"), (503, "menu", "a")]


def reference(data, ratio, least):
    pages, having = {}, {}
    for _, text, host in data:
        pages[host] = pages.get(host, 0) + 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            having[host, line] = having.get((host, line), 0) + 1
    out = []
    for i, text, host in data:
        if text is None:
            out.append((i, 0, 0, None, None))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not (having.get((host, x.strip(" ")), 0) >= least and having[host, x.strip(" ")] > ratio * pages[host])]
        t = "\n".join(kept)
        out.append((i, len(lines), len(lines) - len(kept), len(t), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_matches_reference_and_sql(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, host string").repartition(3)
    got = sorted((tuple(r) for r in line_report(df).collect()), key=str)
    assert got == reference(data, line_dedup.MAX_RATIO, line_dedup.MIN_PAGES)
    assert any(r[2] for r in got)
    con = duckdb.connect()
    documents = df.withColumnRenamed("host", "source").toPandas()  # noqa: F841
    assert sorted((tuple(r) for r in con.sql(line_dedup.REPORT_SQL).fetchall()), key=str) == got


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x", "h", 5)], "doc_id long, text string, host string, found_host int")
    assert drop_boilerplate(df).columns == df.columns
    assert line_report(df.limit(0)).count() == 0


def test_html(spark):
    html = "<title>T</title><script>var t='</p>';</script><nav><ul><li><a href='x'>Home</a></li></ul></nav><p>A <b>b</b><br>c</p><!-- ad -->"
    row = spark.createDataFrame([("https://M.example.com/en/25#top", html)], "url string, html string").select(url_host("url"), html_lines("html")).first()
    assert row[0] == "m.example.com" and row[1] == "T\nHome\nA b\nc"


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_stage_drops_passages_repeated_on_a_hot_site(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
    passage, near, short = (" ".join(f"{p}{k}" for k in range(n)) for p, n in (("p", 50), ("n", 50), ("s", 49)))
    data = [(i, f"own {i}\n{passage if i % 50 == 0 else 'x'}\n{short if i % 50 == 1 else 'y'}", "hot") for i in range(0, 200)]
    data += [(300 + i, f"own\n {near} \nend", "b") for i in range(2)] + [(310 + i, f"{near}\nz{i}", None) for i in range(3)] + [(320, None, "b")]
    data += data[:1]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    got = {r.doc_id: r.text for r in stage(spark, docs, "").collect()}
    # four pages of 200 are far below the ratio, but the passage goes; a line of 49 words and one on two pages of its site stay
    assert not any(passage in (t or "") for t in got.values())
    assert sum(short in (t or "") for t in got.values()) == 4
    assert got[0] == "own 0" and got[300] == f"own\n {near} \nend" and got[310] == "z0" and got[320] is None


def test_stage_takes_the_url_host(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    data = [(i, f"{passage}\nown {i}", "one", f"https://{h}.org/{i}") for i, h in enumerate("aaab")] + [(9, f"{passage}\nlast", "one", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, url string")
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()}
    assert got[0] == "own 0" and got[3] == f"{passage}\nown 3" and got[9] == f"{passage}\nlast"
