import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvid.llm import katz
from corvid.llm.katz import CUTOFF, Discounts, pack, score_report, unpack


def rows(n=120, seed=6):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    out = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60))).title()) for i in range(n)]
    out += [(1000 + i, " ".join([f"new{i}", "w1", "w2", "w1", "w59"])) for i in range(20)]
    return out + [(2000, None), (2001, ""), (3, out[3][1]), (2002, "w0 w1 " * 20_000)]


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


class Reference:
    """Katz backoff by dictionaries."""

    def __init__(self, texts):
        self.uni, self.bi, self.hist = Counter(), Counter(), Counter()
        for t in texts:
            last = "<s>"
            for w in tokens(t):
                self.uni[w] += 1
                self.bi[last, w] += 1
                self.hist[last] += 1
                last = w
        self.n = sum(self.uni.values())
        self.d2, self.d1 = (Discounts.good_turing(np.array([sum(v == r for v in c.values()) for r in range(1, CUTOFF + 2)])) for c in (self.bi, self.uni))
        seen = sum(self.d1[v - 1] * v if v <= CUTOFF else v for v in self.uni.values())
        self.rest = 1 - seen / self.n

    def p1(self, w):
        c = self.uni[w]
        return self.rest if not c else (self.d1[c - 1] if c <= CUTOFF else 1.0) * c / self.n

    def p2(self, h, w):
        c, ch = self.bi[h, w], self.hist[h]
        if not ch:
            return self.p1(w)
        after = {x: v for (g, x), v in self.bi.items() if g == h}
        plain = any(v <= CUTOFF for v in after.values())

        def seen(v):
            return ((self.d2[v - 1] if v <= CUTOFF else 1.0) * v / ch) if plain else v / (ch + 1)

        if c:
            return seen(c)
        return (1 - sum(map(seen, after.values()))) / (1 - sum(map(self.p1, after))) * self.p1(w)


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


@pytest.mark.parametrize("block_bytes", [8 << 20, 700])
def test_scores_equal_dictionaries(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(katz, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(katz, "PARTITION_BYTES", 20_000)
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in score_report(df).collect()}
    assert len(got) == len({i for i, _ in data})
    ref = Reference([t for i, t in data if not held(i)])
    vocabulary = list(ref.uni)
    for h in ("<s>", "w0", "w7", "unknown"):
        assert sum(ref.p2(h, w) for w in vocabulary) + ref.p2(h, "?") == pytest.approx(1)
    assert any(held(i) for i, _ in data)
    cache = {}
    for i, t in data:
        score, last = 0.0, "<s>"
        for w in tokens(t):
            if (last, w) not in cache:
                cache[last, w] = math.log10(ref.p2(last, w))
            score += cache[last, w]
            last = w
        base = sum(math.log10((ref.uni[w] + 0.1) / (ref.n + 0.1 * (len(ref.uni) + 1))) for w in tokens(t))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens(t)), sum(ref.uni[w] > 0 for w in tokens(t)), ref.n)
        assert r.score == pytest.approx(score, rel=1e-9) and r.base_score == pytest.approx(base, rel=1e-9)


def test_null_ids_and_clashing_columns(spark):
    data = rows()[:120]
    plain = {r.doc_id: r.score for r in score_report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    odd = [(i, t, 1.0, "k") for i, t in data]
    df = spark.createDataFrame(odd, "doc_id long, text string, score double, kind string")
    assert {r.doc_id: r.score for r in score_report(df).collect()} == pytest.approx(plain)
    # a row without an id is learned from and scored
    more = spark.createDataFrame([*data, (None, data[0][1])], "doc_id long, text string")
    got = [r for r in score_report(more).collect() if r.doc_id is None]
    assert len(got) == 1 and not got[0].held_out and got[0].train_tokens > next(iter(score_report(spark.createDataFrame(data, "doc_id long, text string")).limit(1).collect())).train_tokens


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert score_report(df).count() == 0
    only = next(i for i in range(100) if held(i))
    row = score_report(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert row.score == 0 and row.n_known == 0 and row.train_tokens == 0


def test_pack_round_trip():
    arrays = [np.array([3, 1 << 60], np.uint64), np.zeros(0, np.int64), np.array([1.5, -2.0]), np.array([7], np.uint8)]
    for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and np.array_equal(a, b)
