import numpy as np
import pytest

from corvid.llm.forest_search import Forest, ForestSettings, grow_tree, nearest, neighbour_report
from pyspark.sql import functions as F


def brute(rows, queries, k=5):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    norms = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i, v in ok:
        if queries(i):
            s = (x * v).sum(axis=1) / (norms * np.sqrt((v * v).sum()))
            out[i] = [(int(j), float(c)) for c, j in sorted(((c, j) for c, j in zip(s, ids, strict=True) if j != i), key=lambda t: (-t[0], t[1]))[:k]]
    return out


def collect(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def vectors(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("chunk_rows", [8192, 100])
def test_recall_and_scores(spark, chunk_rows):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = collect(neighbour_report(df, settings=ForestSettings(sample=600, leaf=30, chunk_rows=chunk_rows)))
    want = brute(rows, lambda i: i % 50 == 0)
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    exact = {q: dict(brute(rows, lambda i, q=q: i == q, len(rows))[q]) for q in list(want)[:5]}
    for q, all_scores in exact.items():
        for j, s in got[q]:
            assert s == pytest.approx(all_scores[j], abs=1e-15)


def test_edge_cases(spark):
    a, b = [1.0, 0.0, 0.5, 2.0], [0.0, 1.0, 0.25, 1.0]
    rows = [(i, a) for i in range(0, 400)] + [(500, b), (550, [2.0, 0.0, 1.0, 4.0])]
    rows += [(600, None), (650, [0.0] * 4), (700, [float("nan"), 1.0, 1.0, 1.0]), (750, [1.0, None, 1.0, 1.0]), (800, [1.0]), (0, a)]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, rep int")
    got = collect(neighbour_report(df))
    want = brute([(i, v) for i, v in dict(rows).items() if v is None or len(v) == 4], lambda i: i % 50 == 0)
    assert set(got) == set(want)
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
    few = spark.createDataFrame([(0, a), (1, b)], "vec_id long, embedding array<float>")
    assert [j for j, _ in collect(nearest(few, F.lit(True)))[0]] == [1]
    assert neighbour_report(df.limit(0)).count() == 0


def test_all_leaves_are_every_row():
    x = np.random.default_rng(0).normal(size=(300, 8))
    forest = Forest([grow_tree(x, 20, np.random.default_rng(s)) for s in range(3)])
    total = sum(t.leaves for t in forest.trees)
    leaves = forest.nearest_leaves(x[0], total + 5)
    assert len(leaves) == len(set(leaves)) == total
    assert leaves[0][1] == forest.trees[leaves[0][0]].assign(x[:1])[0]


def test_very_large_and_very_small_components(spark):
    rows = [(0, [1e300, 1e300]), (50, [3e-300, 4e-300]), (1, [2e300, 1e300]), (2, [3e-320, 4e-320]), (3, [-1e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in neighbour_report(df).collect()}
    assert len(got) == 8
    assert abs(got[0, 1] - 3 / 10**0.5) < 1e-12 and abs(got[50, 0] - 7 / (5 * 2**0.5)) < 1e-12 and got[50, 2] > 0.99 and abs(got[0, 3] + 0.5**0.5) < 1e-12
