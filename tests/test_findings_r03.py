"""Cases that a review of the third round brought up: odd texts, and tables that are held against themselves."""

import datetime

import duckdb
import numpy as np
import pytest

from corvid.operators import analysis as N
from corvid.operators import fulltext as L
from corvid.operators import nearest as M
from corvid.operators import postings as B
from corvid.operators import retrieval as T
from corvid.operators import sgml
from corvid.plans import catalogue as Q


def same_as_sql(spark, name, folder, **tables):
    """The query over ``tables`` gives the rows of its SQL."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = Q.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({Q.ORACLES[name]})").fetchall()
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("name", ["verify_answers", "answer_metrics"])
def test_turns_of_stop_words_alone(spark, tmp_path, name):
    rows = [(c, t, "assistant" if t % 2 else "user", "Something was said." if t % 2 else "The a for an of.") for c in range(8) for t in range(4)]
    same_as_sql(spark, name, tmp_path, conversations=(rows, "conv_id long, turn long, role string, text string"))


def test_neighbours_of_a_whole_table(spark, monkeypatch):
    """Exact neighbours over several blocks and tiles are those of brute force; copies are ordered by id."""
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((300, 6)), 2)
    x[40:90], x[7] = x[40], 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [1.0, 2.0]), (903, [float("nan")] * 6)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    monkeypatch.setattr(M, "VECTORS", 100)
    monkeypatch.setattr(M, "FEWEST", 100)
    size = np.linalg.norm(x, axis=1)
    s = np.round(np.where(np.outer(size, size) > 0, x @ x.T / np.where(np.outer(size, size) > 0, np.outer(size, size), 1), 0.0), 6)
    want = {i: np.lexsort((np.arange(300), -s[i]))[:5].tolist() for i in range(300)} | {902: [902]}
    got = M.nearest(v, v.withColumnRenamed("chunk_id", "qid"), 5).orderBy("qid", "rank").collect()
    for i, ids in want.items():
        assert [r.chunk_id for r in got if r.qid == i] == ids


def test_hashed_search_makes_no_row_of_a_pair(spark):
    """Whatever meets by a key, only ``k`` rows a query leave a task; copies alone are found among copies."""
    v = spark.createDataFrame([(i, [1.0, 2.0, 3.0] if i < 200 else [-3.0, 1.0, float(-i)]) for i in range(300)], "chunk_id long, embedding array<double>")
    out = T.ann_top(v, v.withColumnRenamed("chunk_id", "qid"), 3)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.chunk_id for r in out.where("qid = 150").orderBy("rank").collect()] == [0, 1, 2]


def labelled(n):
    x = np.random.default_rng(5).standard_normal((n, 4)).round(2)
    x[10:30] = x[10]
    return [(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", ["score_recall_mrr_ndcg", "version_confusion"])
def test_neighbours_among_copies(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(M, "VECTORS", 25)
    same_as_sql(spark, name, tmp_path, embeddings=labelled(60))


def test_dense_scores_are_held_in_parts(spark, monkeypatch):
    """However many queries a block has, no more than ``SCORES`` scores of a batch are held."""
    rows, _ = labelled(40)
    v = spark.createDataFrame([r[:2] for r in rows], "chunk_id long, embedding array<double>")
    q = v.withColumnRenamed("chunk_id", "qid")
    want = T.dense_top(v, q, 3).orderBy("qid", "rank").collect()
    monkeypatch.setattr(T, "SCORES", 100)
    assert T.dense_top(v, q, 3).orderBy("qid", "rank").collect() == want


DOCUMENTS = [(i, f"{'alpha ' * (i % 4)}beta max_size_{i % 3} {'gamma delta ' * (i % 5)}" if i % 9 else "", ["de", "en"][i % 2], f"src{i % 7}") for i in range(60)] + [(60 + i, "alpha beta max_size_1", "en", "src1") for i in range(30)]
CORPUS = {"documents": (DOCUMENTS, "doc_id long, text string, lang string, source string"), "benchmark": ([(0, "alpha gamma?"), (1, "max_size_1 delta"), (2, "nothing there"), (3, "?!")], "item_id long, text string"), "embeddings": labelled(60)}


@pytest.mark.parametrize("name", ["bm25_topk", "hybrid_onepass", "leakage_check", "fusion_rrf", "parent_expand", "rerank_token_overlap", "mined_negatives"])
def test_counted_corpus(spark, tmp_path, monkeypatch, name):
    """Rows as the SQL has them, with empty texts, copies, questions without any term, and few rows and cells at a time."""
    monkeypatch.setattr(B, "CELLS", 50)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        same_as_sql(spark, name, tmp_path, **CORPUS)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_counts_are_those_of_the_tokens(spark):
    """Counts by bytes are those of ``tokenize``: compounds, suffixes, odd marks, capitals beyond ASCII, and empty texts; no token is a row."""
    texts = ["max_size(3)4-5 Max_Size a(3)(4) x(3 a-b(3)-c a-b-c", "İx ſtop Kelvin_K é-a a-é ü", "", None, "a.b..c/d_-e (7) 7(7)7 -a- a_(3)", "plain Plain PLAIN plain-plain", "1\n2\t3 4 5"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    rows = chunks.select("chunk_id", B.X.tokenize("text").alias("t")).collect()
    every = sorted({t for r in rows for t in r.t or []})
    terms = spark.createDataFrame([(t, i) for i, t in enumerate(every)], "term string, tid long")
    got = {r.chunk_id: (r.length, {every[t]: n for t, n in zip(r.tids, r.tfs, strict=True)}) for r in B.counted(chunks, terms, []).collect()}
    assert got == {r.chunk_id: (len(r.t or []), {t: r.t.count(t) for t in r.t or []}) for r in rows}


def test_scoped_scores_with_metadata(spark):
    """Scopes of units and metadata filters have their own statistics, found without a row a signature, chunk and term."""
    words = ["alpha beta", "alpha", "beta beta gamma", "", "alpha alpha delta", "gamma"]
    data = [(i, f"d{i % 3}", f"v{i % 2}", words[i % 6], {"k": str(i % 4)} if i % 5 else None) for i in range(36)]
    chunks = spark.createDataFrame(data, "chunk_id long, document_id string, version string, text string, metadata map<string,string>")
    asked = [(1, "alpha gamma", "a", None), (2, "beta", "a", None), (3, "alpha beta", "b", {"k": "1"}), (4, "alpha", "c", {"k": "9"})]
    requests = spark.createDataFrame(asked, "qid long, query string, sig string, metadata map<string,string>")
    may = {"a": {("d0", "v0"), ("d1", "v1")}, "b": {("d0", "v0"), ("d1", "v1"), ("d2", "v1")}, "c": {("d0", "v0")}}
    units = spark.createDataFrame([(s, *u) for s, us in may.items() for u in us], "sig string, document_id string, version string")
    want = {}
    for qid, query, sig, meta in asked:
        held = [(i, t.split()) for i, d, v, t, m in data if (d, v) in may[sig] and (not meta or (m or {}).get("k") == meta["k"])]
        avg = sum(2 * len(t) for _, t in held) / max(1, len(held)) or 1.0
        idf = {w: np.log(1 + (len(held) - n + 0.5) / (n + 0.5)) for w in set(query.split()) for n in [sum(w in t for _, t in held)]}
        score = {i: round(sum(x * 4.4 * t.count(w) / (2 * t.count(w) + 1.2 * (0.25 + 0.75 * 2 * len(t) / avg)) for w, x in idf.items()), 6) for i, t in held}
        want |= {(qid, i): n + 1 for n, i in enumerate(sorted((i for i in score if score[i] > 0), key=lambda i: (-score[i], i))[:4])}
    found = T.scoped_bm25(chunks, requests, units, 4)
    assert {(r.qid, r.chunk_id): r["rank"] for r in found.collect()} == want and {q for q, _ in want} == {1, 2, 3}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name, reads", [("diff_defaults", ["default_values"]), ("diff_identifiers", ["context_identifiers"]), ("diff_tables", [])])
def test_differences_read_what_is_asked(spark, tmp_path, name, reads):
    """Each text is read once, and only for the kind of change that is asked for; versions with a gap between them give none."""
    day = lambda y: datetime.date(y, 3, 1)
    rows = [(o, o * 7 % 50, s, 1 + o % 3, float(o), "ANR"[o % 3], "OF"[o % 2], day(1992 + (o * 3 + s) % (4 if s % 2 else 7) * (2 if s == 4 else 1))) for s in range(1, 6) for o in range(40) if not (s == 3 and o % 3)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate date"
    same_as_sql(spark, name, tmp_path, lineitem=(rows, schema))
    plan = Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert [w for w in ("default_values", "context_identifiers", "first_change") if f"{w}(" in plan] == reads and "Join" not in plan


def test_postings_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, "alpha beta " * 3) for i in range(50)], "chunk_id long, text string")
    wanted = spark.createDataFrame([("alpha",)], "lexeme string")
    monkeypatch.setattr(L, "POSTINGS", 10)
    found = L.postings(chunks, wanted)
    assert found.count() == 150 and "RepartitionByExpression [chunk_id" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and ", 15" in plan


@pytest.mark.parametrize("name", ["fts_diagnostic", "fts_all_terms"])
def test_full_text_in_small_tasks(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(L, "POSTINGS", 20)
    same_as_sql(spark, name, tmp_path, **CORPUS)


def test_sparse_encode_by_blocks(spark, tmp_path, monkeypatch):
    """Weights as the SQL has them over blocks of few texts, with copies and empty texts; a term is a row of a block, not of a chunk."""
    monkeypatch.setattr(B, "BLOCK", 200)
    same_as_sql(spark, "sparse_encode", tmp_path, **CORPUS)
    texts = ["max_size(3)4-5 Max_Size a(3)(4) x(3 a-b(3)-c", "İx ſtop é-a a-é", "", None, "a.b..c/d_-e (7)", "max_size alpha"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    tokens = {r.chunk_id: r.t for r in chunks.select("chunk_id", B.X.tokenize("text").alias("t")).collect() if r.t}
    out = B.sparse_encode(chunks)
    assert {r.chunk_id: set(r.weights) for r in out.collect()} == {k: set(t) for k, t in tokens.items()}
    weights = out.where("chunk_id = 5").first().weights
    n, avgdl, df = 6, sum(map(len, tokens.values())) / 5, sum("max" in t for t in tokens.values())
    assert weights["max"] == pytest.approx(np.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / avgdl)))
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_markdown_places_are_found_once(spark, tmp_path):
    """A text's headings and blocks are searched for once, not again for each part; orders are dealt to all cores."""
    same_as_sql(spark, "markdown_blocks", tmp_path, orders=([(i, "OFP"[i % 3]) for i in range(30)], "o_orderkey long, o_orderstatus string"))
    plan = Q.QUERIES["markdown_blocks"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(sequence(0, size(") == 2 and "Repartition" in plan


def test_manual_texts_stay_out_of_the_readings(spark, tmp_path):
    """Records of manuals as the SQL has them, blank and marked texts included; the readings are joined without their texts."""
    texts = ["plain words", "", " \n ", "a < b & c > d", "two\nlines  here", "x" * 60]
    rows = [(i, t, ["de", "en"][i % 2], "src1") for i, t in enumerate(texts)]
    same_as_sql(spark, "manual_sections", tmp_path, documents=(rows, "doc_id long, text string, lang string, source string"))
    files = spark.createDataFrame([("v", "f", '<chapter id="c"><title>T</title><para>some prose</para><screen>x</screen></chapter>')], "version string, source_file string, text string")
    met, _, _, contents = sgml._readings(files)
    assert not {"text", "data", "table_rows"} & set(met.columns) and sorted(r.text for r in contents.collect()) == ["some prose", "x"]


def test_quotes_are_searched_once(spark, tmp_path):
    """Quotes of any length over odd white space, null and empty texts, as brute force finds them; one search, not one for each use of it."""
    texts = ["one two three four", " one\ttwo three \n four five", "onetwo three fourx", "zone two threes", "", None, "two", "  ", "the one two three", "three four\u00a0five six"]
    quotes = ["one two three", "two  three four", "ne two thr", "two", "e t", " ", "absent words here now", "three four\tfive", "one two three four"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    found = N.leaking(chunks, spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string"))
    norm = lambda t: " ".join(t.split())
    assert sorted(map(tuple, found.collect())) == [(i, j) for i, t in enumerate(texts) for j, q in enumerate(quotes) if t is not None and norm(q) and norm(q) in norm(t)]
    same_as_sql(spark, "simple_harness", tmp_path, **CORPUS)
    assert "regexp_replace" not in Q.QUERIES["simple_harness"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_a_million_postings_are_five_tasks(spark):
    """A task takes 200,000 postings, which keeps what it sorts and groups under a gigabyte."""
    chunks = spark.range(4000).select(B.F.col("id").alias("chunk_id"), B.F.repeat(B.F.lit("alpha "), 250).alias("text"))
    found = L.postings(chunks, spark.createDataFrame([("alpha",)], "lexeme string"))
    assert ", 5" in next(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x)
