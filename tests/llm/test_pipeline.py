"""The pipeline's rows against a brute-force version of its stages."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from corvid.llm import line_dedup, quality
from corvid.llm.byte_bpe import load_ranks
from corvid.llm.decontaminate import reference_hits


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("str", "br", "cl", "pl", "m", "n") for b in ("ate", "ong", "ink", "use", "eam", "orn", "ip")]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, sentence(20)) for i in range(3)]
    docs = []
    for i in range(160):
        body = sentence(60) if i % 5 else sentence(60).upper().replace(" ", "!! ")
        docs.append([i, body + "\nshared footer of the site\n" + sentence(10), "en", f"s{i % 2}"])
    docs[11][1] = docs[6][1] + " extra"
    docs[12][1] = items[0][1] + " " + sentence(30)
    docs[13][1] = sentence(900) + "\n" + items[1][1]
    docs[14][1] = None
    rows = [(*d, len(d[1] or "")) for d in docs]
    labels = [(i, int(i % 5 != 0), 0) for i in range(160) if i % 3]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows, items


def brute_force(spark, out, rows, items):
    docs, labels = (spark.read.parquet(f"{out}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(quality.fold("doc_id", 3) == 1, F.lit(False))
    model = quality.train(docs.where(~held), labels.where(~held))
    scores = np.concatenate([model.score(m) for m in quality.Featurizer()(pa.array([r[1] for r in rows], pa.string()))])
    kept = {r[0]: (r[1], r[3]) for r, s in zip(rows, scores, strict=True) if s >= 0.5}
    count, pages = {}, {}
    for text, host in kept.values():
        pages[host] = pages.get(host, 0) + 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            count[host, line] = count.get((host, line), 0) + 1
    bad = {k for k, n in count.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.MAX_RATIO * pages[k[0]]}
    texts = {i: None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in bad) for i, (t, h) in kept.items()}
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    group = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    texts = {i: t for i, t in texts.items() if group[i] == i}
    return {i: t for i, t in texts.items() if not reference_hits(t, [(str(k), x) for k, x in items])[4]}


def test_pipeline_equals_brute_force(spark, tables):
    out, rows, items = tables
    want = brute_force(spark, out, rows, items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, out).collect()}
    assert set(got) == set(want)
    assert not {0, 5, 10, 11, 12} & set(got) and {6, 13, 14} <= set(got)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, t in want.items():
        if i == 13:  # the benchmark span is cut out of it
            t = t[: t.index(items[1][1])]
        assert got[i].ids == library.encode_ordinary(t or "")
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_stages_keep_columns(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(5), tables[0]).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]


def test_odd_rows_and_clashing_columns_through_run(spark, tables, tmp_path):
    """Null ids and texts, repeated rows, a very long text, and columns named as the stages name theirs."""
    out, rows, items = tables
    long = "\n".join(r[1] for r in rows[6:9]) + " and more words " * 40_000
    odd = [(None, "a text without an id " * 9, "en", "s0", 3), (900, None, None, None, None), (901, "", "en", "s0", 0), (902, long, "en", "s1", len(long)), (902, long, "en", "s1", len(long)), (903, rows[7][1], "en", "s1", 5)]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("score", "hits", "site", "order", "ids", "grams", "component", "found_keys", "page_a")
    df = df.selectExpr("*", *[f"'{c}' as `{c}`" for c in names])
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{out}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    got = [r.doc_id for r in corpus_pipeline.run(spark, folder).collect()]
    assert got.count(902) <= 1 and got.count(903) == 0 and len([i for i in got if i is not None]) == len({i for i in got if i is not None})
    plain = {r.doc_id for r in corpus_pipeline.run(spark, out).collect()}
    assert len(plain ^ {i for i in got if i is not None and i < 900}) <= 3


def test_empty_documents_through_run(spark, tables, tmp_path):
    out, _, _ = tables
    spark.read.parquet(f"{out}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{out}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
