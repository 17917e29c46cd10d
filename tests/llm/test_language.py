import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from corvid.llm.language import LanguageSettings, Words, fit_kneser_ney, identify, language_report, letter_table, train

ALPHABETS = {"aa": "abcde", "bb": "abxyé", "cc": "привет"}


def rows(seed=2, n=240):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = sorted(ALPHABETS)[i % 3]
        out.append((i, " ".join("".join(rng.choices(ALPHABETS[lang], k=rng.randint(2, 7))) for _ in range(30)) + "!? 12", lang))
    return out


def naive_probabilities(texts, order):
    """Interpolated Kneser-Ney by dictionaries: probability of a character after a context."""
    import re
    from collections import Counter

    raw = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            s = "^" * (order - 1) + w + "$"
            for i in range(order - 1, len(s)):
                raw[s[i - order + 1 : i + 1]] += 1
    counts = {order: raw}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts = {}
    for n, c in counts.items():
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discounts[n] = one / (one + 2 * two) if one and two else 0.5

    def p(context, ch, n):
        if n == 0:
            return None
        c, d = counts[n], discounts[n]
        same = [(g, v) for g, v in c.items() if g[:-1] == context]
        total = sum(v for _, v in same)
        if not total:
            return p(context[1:], ch, n - 1)
        low = p(context[1:], ch, n - 1) if n > 1 else 1.0 / (len(counts[1]) + 1)
        return max(c[context + ch] - d, 0) / total + d * len(same) / total * low

    return p


def test_probabilities_equal_dictionaries():
    texts = [t for _, t, lang in rows(n=30) if lang == "aa"]
    words = Words(letter_table())
    model = fit_kneser_ney({"aa": texts}, words, LanguageSettings(order=3))
    p = naive_probabilities(texts, 3)
    for word in ("abc", "edcba", "aq", "z"):
        _, _, points, starts, ends, _ = next(words.blocks([word], 100))
        got = model.log_probabilities(points, starts, ends)[0, 0]
        s = "^^" + word + "$"
        want = sum(np.log(p(s[i - 2 : i], s[i], 3)) for i in range(2, len(s)))
        assert got == pytest.approx(want)
    # the model of a context sums to one, with the mass of characters never seen
    chars = [*"abcde$"]
    assert sum(p("ab", c, 3) for c in chars) < 1.0


def test_held_out_rows_and_edge_cases(spark):
    data = rows() + [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "aa"), (903, "abcde " * 40_000, None), (3, rows()[3][1], "aa")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    got = language_report(docs, settings=LanguageSettings(documents=50)).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (900, 901, 902))
    assert by[903].lang_pred == "aa"
    held = [(r, lang) for r, (_, _, lang) in ((by[i], row) for i, row in enumerate(rows())) if r.held_out]
    assert len(held) > 30 and np.mean([r.lang_pred == lang for r, lang in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_report(docs).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_report(one).first().lang_pred == "und"


def test_ties_clashing_names_null_ids_and_repeats(spark):
    texts = [("a", "the water and the river run over the old stone bridge"), ("b", "das wasser und der fluss laufen unter der alten steinbruecke")]
    rows = [(k, texts[k % 2][1] + f" {k}", texts[k % 2][0], "old", 1.5, True) for k in range(60)] + [(None, "the river", "a", "x", 0.0, False), (3, "the river runs", "b", "x", 0.0, False), (3, "the river runs", "b", "x", 0.0, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, rejected boolean")
    model = train(docs)
    out = identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"] and out.count() == len(rows)
    assert {r.lang_pred for r in out.where("doc_id is null").collect()} == {"a"}
    same = train(docs.select("doc_id", "text", "lang").withColumn("lang", F.lit("z")).unionByName(docs.select("doc_id", "text", F.lit("y").alias("lang"))))
    picks = {r.lang_pred for r in identify(docs.select("doc_id", "text"), same).collect()}
    assert len(picks) == 1 and picks <= {"y", "z"}
