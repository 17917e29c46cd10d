import hashlib
import random
import re
import zlib

import numpy as np
import pyspark.sql.functions as F
import pytest

from corvid.llm.periodic_runs import collapse_runs, lyndon_runs, planted, reference_runs, run_report, windows


def sequence(rng):
    kind, out = rng.choice("rpmf"), []
    if kind == "r":
        return rng.choices(range(rng.choice([1, 2, 3, 9])), k=rng.choice([0, 5, 6, 7, 30, 120]))
    for _ in range(rng.choice([1, 2, 5])):
        out += rng.choices(range(9), k=rng.choice([0, 2, 10]))
        root = rng.choices(range(3 if kind == "p" else 9), k=rng.choice([1, 2, 3, 5, 11]))
        body = root * rng.choice([2, 4, 5, 9]) + root[: rng.randrange(len(root) + 1)]
        out += body * rng.choice([1, 1, 4]) if kind == "m" else body
    return out


@pytest.mark.parametrize("seed", range(4))
def test_scan_and_windows_match_brute_force(seed):
    rng, found = random.Random(seed), 0
    for _ in range(400):
        texts = [sequence(rng) for _ in range(rng.choice([1, 3]))]
        first = np.cumsum([0, *map(len, texts)])
        words = [w for t in texts for w in t]
        hashes = np.array([zlib.crc32(str(w).encode()) for w in words], np.uint64)
        got = [[] for _ in texts]
        for a, b in windows(hashes, first):
            k = int(np.searchsorted(first, a, side="right")) - 1
            got[k] += [(a - first[k] + s, m, q) for s, m, q in lyndon_runs(words[a:b])]
        want = [reference_runs(t) for t in texts]
        assert got == want
        assert [lyndon_runs(t) for t in texts] == want
        found += sum(map(len, want))
    assert found > 300


def test_feigned_equality_is_verified():
    words = [0, 1, 2, 3, 0, 1, 2, 3] * 40 + [5, 4] * 30
    assert lyndon_runs(words, base=1) == reference_runs(words)  # sums of words are no hashes


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = reference_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def rows():
    rng = random.Random(8)
    word = lambda w: "äb"[w % 2] * (w + 1)
    out = [(i, rng.choice([" ", "\n", " \t"]).join(map(word, sequence(rng)))) for i in range(250)]
    return [*out, (7, out[7][1]), (None, "a b " * 9), (900, None), (901, ""), (902, " \n "), (903, "x " * 700), (904, "    " * 8), (905, "the same line of words\n" * 6)]


def test_report_matches_brute_force(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    report = run_report(docs, text=planted(F.col("doc_id"), F.col("text")))
    assert report.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted((tuple(r) for r in report.collect()), key=str)
    assert got == sorted((brute(*r) for r in rows()), key=str)
    assert run_report(docs.limit(0)).collect() == []


def test_collapsed_texts_keep_one_period_and_columns(spark):
    docs = spark.createDataFrame([(1, "say a b a b a b a b now", 5), (2, None, 6), (3, "plain  text", 7)], "id int, text string, Runs int")
    out = {r.id: r for r in collapse_runs(docs).collect()}
    assert collapse_runs(docs).columns == ["id", "text", "Runs", "_runs"]
    assert out[1].text == "say a b now" and [tuple(r) for r in out[1]._runs] == [(1, 8, 2)] and out[1].Runs == 5
    assert out[2].text == "" and out[2]._runs == [] and out[3].text == "plain text"


def test_long_texts_of_one_word(spark):
    docs = spark.createDataFrame([(1, "a " * 20_000), (2, "a b c " * 5_000)], "doc_id long, text string")
    assert {(r.n_runs, r.length, r.period) for r in run_report(docs).collect()} == {(1, 20_000, 1), (1, 15_000, 3)}
