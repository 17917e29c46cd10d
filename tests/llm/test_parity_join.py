import random

import numpy as np
import pyarrow as pa
import pytest

from corvid.llm import parity_join
from corvid.llm.components import connected_components
from corvid.llm.parity_join import Rule, Shingler, Sketcher, keep_representatives, near_duplicates


def reference(data, rule):
    import re

    sets = {}
    for i, t in data:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        n = min(rule.width, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                common = len(sets[x] & sets[y])
                if rule.over * common >= rule.share * (len(sets[x]) + len(sets[y]) - common):
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def rows(seed, families=14, copies=7, words=400):
    rng = random.Random(seed)
    out, vocabulary = [], [f"w{k}" for k in range(words)]
    for f in range(families):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 4, 6, 12, 25, 60, 150]))
        for c in range(copies):
            doc = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                k = rng.randrange(len(doc) + 1)
                rng.choice([lambda: doc.insert(k, "NEW"), lambda: doc.pop(min(k, len(doc) - 1)) if doc else None])()
            out.append((1000 - (f * copies + c) * 3, "  ".join(doc)))
    return out


@pytest.mark.parametrize("seed,rule", [(1, Rule()), (2, Rule(5, 80)), (3, Rule())])
def test_components_equal_brute_force(spark, seed, rule):
    data = rows(seed) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "the same " * 9000), (5004, "the same " * 9001)]
    df = spark.createDataFrame(data + data[:3], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, rule).collect()}
    assert got == reference(data, rule)


def test_chain_in_one_bucket_needs_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 4)
    base = [f"w{k}" for k in range(100)]
    data = [(k, " ".join(base[: 100 - k] + [f"x{k}_{j}" for j in range(k // 2)])) for k in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == reference(data, Rule())


def test_hamming_distance_bounds_difference():
    rng = np.random.default_rng(0)
    rule = Rule()
    sketcher = Sketcher(rule)
    for _ in range(200):
        base = rng.integers(0, 2**63, 200, dtype=np.uint64)
        other = np.concatenate((base[rng.integers(0, 9) :], rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)))
        a, b = np.unique(base), np.unique(other)
        level = sketcher.level(max(len(a), len(b)))
        sketches = []
        for s in (a, b):
            part, word, _, parts = sketcher.sketch(s, level)
            full = np.zeros(parts, np.uint64)
            full[part.astype(np.int64)] = word
            sketches.append(full)
        difference = len(np.setxor1d(a, b))
        assert int(np.bitwise_count(sketches[0] ^ sketches[1]).sum()) <= difference
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            assert difference <= rule.distance(level)
            (ka, na), (kb, nb) = sketcher.keys(a), sketcher.keys(b)
            _, x, y = np.intersect1d(ka, kb, return_indices=True)
            assert (1.0 / np.maximum(na[x] >> 1, nb[y] >> 1)).sum() >= 1 - 1e-6
            # the short sketches bound the difference as well, also where the wider one is folded
            u, v = (np.frombuffer(sketcher.short(s), np.uint64) for s in (a, b))
            while len(u) != len(v):
                u, v = (h[: len(h) // 2] ^ h[len(h) // 2 :] if len(h) == max(len(u), len(v)) else h for h in (u, v))
            assert int(np.bitwise_count(u ^ v).sum()) <= difference


def test_levels():
    rule = Rule()
    sketcher = Sketcher(rule)
    for n in range(1, 300):
        assert sketcher.level(n) == rule.level(n)
        for m in range(n, min(n * 100 // 85, 299) + 1):
            assert rule.level(m) - rule.level(n) in (0, 1)


def test_stage_keeps_one_of_each(spark):
    text = " ".join(f"t{k}" for k in range(80))
    data = [(3, text, 1), (2, text + " more", 1), (9, "else entirely here now ok", 1), (None, text, 1), (4, None, 1), (5, None, 1), (9, "else entirely here now ok", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, order int")
    out = keep_representatives(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 2, 4, 5, 9]
    assert keep_representatives(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(100, 160)]
    other = [(rng.randrange(50), rng.randrange(50)) for _ in range(40)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain + other, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in chain + [x for x in other if x[0] != x[1]]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}


def test_short_text_is_one_shingle():
    assert [len(s) for s in Shingler(Rule())(pa.array(["a b", None, "a b c d", "a b c d e"]))] == [1, 0, 1, 2]


def linked(data, rule):
    """All linked pairs of the smallest ids of distinct sets, by brute force."""
    shingles = dict(zip([i for i, _ in data], [frozenset(x.tolist()) for x in Shingler(rule)(pa.array([t for _, t in data], pa.string()))], strict=True))
    rep = {i: min(j for j in shingles if shingles[j] == s) if s else i for i, s in shingles.items()}
    reps = sorted({r for r in rep.values() if shingles[r]})
    alike = lambda x, y: rule.over * len(x & y) >= rule.share * len(x | y)
    pairs = {(a, b) for a in reps for b in reps if a < b and alike(shingles[a], shingles[b])}
    return rep, pairs


@pytest.mark.parametrize("at_once,shingles,few", [(512, 1 << 17, 2_000_000), (3, 500, 0)])
def test_links_equal_brute_force(spark, monkeypatch, at_once, shingles, few):
    monkeypatch.setattr(parity_join, "BLOCK", at_once)
    monkeypatch.setattr(parity_join, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(parity_join, "BROADCAST_IDS", few)
    base = [f"b{k}" for k in range(120)]
    group = [(2000 + k, " ".join([*base[:k], f"x{k}", *base[k:]])) for k in range(9)]
    data = rows(1) + group + [(3000, group[0][1]), (3001, ""), (3002, None)]
    rep, pairs = linked(data, Rule())
    assert sum(2000 <= a and b < 2009 for a, b in pairs) == 36
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in parity_join.linked_pairs(df).collect()} == pairs
    got = {r.doc_id: r.n_links for r in near_duplicates(df).collect()}
    assert got == {i: sum(r in p for p in pairs) for i, r in rep.items()}


def test_components_alone_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 4)
    base = [f"w{k}" for k in range(100)]
    data = rows(2) + [(2000 + k, " ".join(base[: 100 - k] + [f"x{k}_{j}" for j in range(k // 2)])) for k in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.near_components(df).collect()} == reference(data, Rule())


def test_repeated_ids_with_other_texts_stand_by_their_smallest_set(spark):
    w, x = (" ".join(f"{c}{k}" for k in range(30)) for c in "wx")
    df = spark.createDataFrame([(1, w), (1, x), (2, w + " more"), (3, x + " more"), (4, "a b c d e")], "doc_id long, text string")
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    assert len(got) == 4
    chosen = min((len(s), parity_join.signature(s), k) for k, s in enumerate(Shingler(Rule())(pa.array([w, x]))))[2]
    partner, other = (2, 3) if chosen == 0 else (3, 2)
    assert got[partner].component_id == 1 and got[other].component_id == other
    assert got[1].n_links == 1 and got[other].n_links == 0


def test_large_bucket_that_does_not_link(spark, monkeypatch):
    """Documents that all share half of their words fall in common buckets, and only the planted pair links."""
    monkeypatch.setattr(parity_join, "BLOCK", 16)
    rng = random.Random(4)
    common = [f"c{k}" for k in range(80)]
    data = [(k, " ".join(common + [f"d{k}_{j}" for j in range(rng.randint(18, 30))])) for k in range(150)]
    data.append((500, data[7][1] + " z"))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == reference(data, Rule())
    assert got[500][1] == 7


def test_null_ids_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, None), (2, "a b c d"), (3, "A b  c d")], "doc_id long, text string").selectExpr("*", "1 as id", "2 as n", "'x' as sketch")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in near_duplicates(df).collect()}
    assert got == {1: (0, 1, 0), 2: (1, 2, 0), 3: (1, 2, 0)}
    assert near_duplicates(df.limit(0)).count() == 0
