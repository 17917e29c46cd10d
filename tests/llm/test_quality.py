import random

import numpy as np
import pyarrow as pa

from corvid.llm.quality import Featurizer, PuSettings, estimate_prior, fit_pu, keep_good, pu_gradient, pu_risk, quality_report, score


def rows(n=240, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = [rng.choice(["the", "river", "and", "bridge", "walks", "slowly", "over"]) for _ in range(60)]
        docs.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        if i % 2 or i % 8 == 0:
            labels.append((i, int(good), 0))
    return docs, labels


def test_separates_held_out_rows_and_handles_empty_text(spark):
    docs, labels = rows()
    docs += [(1000, None), (1001, ""), (5, docs[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_report(d, lab).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].score == by_id[1001].score and 0 <= by_id[1000].score <= 1
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert held and all(r.predicted == int(r.doc_id % 4 != 0) for r in held)
    assert {tuple(r) for r in quality_report(d, lab).collect()} == {tuple(r) for r in got}


def test_stage_keeps_columns_and_clean_documents(spark):
    docs, labels = rows()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = keep_good(d, lab)
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == [i for i, _ in docs if i % 4]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_report(d, lab).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert quality_report(one, lab).first().score == 0.5


def test_features_do_not_depend_on_blocks():
    texts = ["one two\nthree", "", "x" * 10, "# | é"]
    whole = np.concatenate(list(Featurizer()(pa.array(texts))))
    alone = np.concatenate([m for t in texts for m in Featurizer()(pa.array([t]))])
    assert np.allclose(whole, alone)


def test_risk_and_gradient_equal_brute_force():
    rng = np.random.default_rng(3)
    xp, xu, w = rng.normal(size=(40, 6)), rng.normal(size=(70, 6)), rng.normal(size=6)
    for prior in (0.3, 0.95):

        def parts(w, prior=prior):
            loss = lambda z: float(np.log1p(np.exp(-z)))
            positives = [prior * loss(x @ w) / len(xp) for x in xp]
            negatives = [loss(-(x @ w)) / len(xu) for x in xu] + [-prior * loss(-(x @ w)) / len(xp) for x in xp]
            return sum(positives), sum(negatives)

        assert np.allclose(parts(w), pu_risk(xp @ w, xu @ w, prior))
        negative = parts(w)[1]
        target = (lambda v: sum(parts(v))) if negative >= 0 else (lambda v: -parts(v)[1])
        step = 1e-6
        slope = [(target(w + step * e) - target(w - step * e)) / (2 * step) for e in np.eye(6)]
        assert np.allclose(slope, pu_gradient(w, xp, xu, prior), atol=1e-5)


def test_negative_risk_below_zero_is_raised():
    """With far too high a prior both branches of the gradient are met."""
    rng = np.random.default_rng(5)
    xp, xu = rng.normal(1, 1, (50, 3)), rng.normal(-1, 1, (50, 3))
    w = np.array([-2.0, -2.0, -2.0])
    assert pu_risk(xp @ w, xu @ w, 0.9)[1] >= 0
    assert pu_risk(-(xp @ w), xu @ -w, 0.99)[1] < 0


def test_prior_from_positives_alone():
    rng = np.random.default_rng(7)
    side = lambda n, m: np.hstack([rng.normal(m, 1, (n, 4)), np.ones((n, 1))]).astype(np.float32)
    for share in (0.3, 0.7):
        p, u = side(3000, 2.0), np.vstack([side(int(4000 * share), 2.0), side(4000 - int(4000 * share), -2.0)])
        assert abs(estimate_prior(p, u[rng.permutation(4000)]) - share) < 0.08
    assert estimate_prior(p[:2], u) == PuSettings().default_prior


def test_equal_texts_score_equal_whatever_shares_their_block():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["one", "two", "three", "|", "!!"], k=rng.randint(0, 40))) for _ in range(60)]
    matrix = np.concatenate(list(Featurizer()(pa.array(texts))))
    model = fit_pu(matrix[:20], matrix, 0.6)
    assert [model.score(matrix[k : k + 1])[0] for k in range(60)] == model.score(matrix).tolist()


def test_odd_rows(spark):
    """Null ids, ids that repeat, labels that disagree, only positive labels, a score column, a very long text."""
    docs, labels = rows(120)
    docs += [(None, "the river"), (3, docs[3][1]), (2000, "the bridge " * 60_000)]
    d = spark.createDataFrame([(i, t, 0.25) for i, t in docs], "doc_id long, text string, score double")
    both = spark.createDataFrame([*labels, (3, 0, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_report(d, both)
    assert out.count() == len(docs)
    assert len({r.score for r in out.where("doc_id = 3").collect()}) == 1
    only = both.where("quality = 1")
    good = {r.doc_id: r.score for r in quality_report(d, only).collect()}
    assert np.mean([good[i] for i in range(120) if i % 4]) > np.mean([good[i] for i in range(120) if i % 4 == 0]) + 0.3
    model = fit_pu(np.zeros((0, Featurizer.size), np.float32), np.zeros((0, Featurizer.size), np.float32))
    assert {r.score for r in score(d, model).collect()} == {0.5}
    assert score(d, model).columns == ["doc_id", "text", "score"]
    assert keep_good(d, both).columns == d.columns
