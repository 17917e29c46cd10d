import random

import pytest
from pyspark.sql import Row

from corvid.llm.decontaminate import decontaminate, find_benchmark_hits, hit_report, reference_hits

WORDS = ["a", "b", "c", "Ä", "x9"]


def cases(seed=3):
    rng = random.Random(seed)
    items = [(str(i), " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 3, 4, 6, 9])))) for i in range(8)] + [("n", None)]
    docs = [(i, "  ,".join(rng.choices([*WORDS, "zz", "A"], k=rng.choice([0, 2, 10, 40])))) for i in range(40)]
    return items, docs + [(40, None), (41, ""), (3, docs[3][1]), (42, "q " * 50_000 + "a b c")]


@pytest.mark.parametrize("block_words", [500_000, 12])
def test_matches_brute_force(spark, block_words):
    items, docs = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id string, text string")
    got = hit_report(d, b, window=4, block_words=block_words).collect()
    assert len(got) == len(docs)
    want = sorted((i, *reference_hits(t, items, 4)) for i, t in docs)
    assert sorted(tuple(r) for r in got) == want
    assert any(w[2] for w in want) and any(w[2] and not w[5] for w in want)


def test_stage_drops_and_cuts(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [
        Row(doc_id=1, text=item, hits=7),
        Row(doc_id=2, text="clean text here", hits=7),
        Row(doc_id=3, text="y " * 600 + item.upper() + ". z", hits=7),
        Row(doc_id=4, text=None, hits=7),
    ]
    docs = spark.createDataFrame(rows)
    bench = spark.createDataFrame([Row(item_id=5, text=item)])
    out = {r.doc_id: r for r in decontaminate(docs, bench).collect()}
    assert sorted(out) == [2, 3, 4]
    assert out[2].text == "clean text here" and out[4].text is None
    assert out[3].text == "y " * 600 + ". z" and out[3].hits == 7


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_benchmark_hits(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = hit_report(one, bench).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)


def test_several_blocks_cut_alike(spark):
    from corvid.llm.decontaminate import decontaminate

    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(words[k * 20 : k * 20 + 20])) for k in range(12)]
    clean = " ".join(f"c{k}" for k in range(600))
    docs = [(1, clean), (2, clean + " " + items[3][1]), (3, items[5][1] + " tail"), (4, None), (5, ""), (6, f"{items[0][1]} {clean} {items[11][1]}")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, hits string")
    it = spark.createDataFrame(items, "item_id long, text string")
    one = {r.doc_id: r for r in decontaminate(d, it).collect()}
    many = {r.doc_id: r for r in decontaminate(d, it, block_words=45).collect()}
    assert one == many and set(one) == {1, 2, 4, 5} | ({6} if 20 * 40 < 640 else set())
    assert one[2].text.strip() == clean and one[4].text is None and one[2].hits == "x"
