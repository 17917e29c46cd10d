"""Positional full-text search: covers against brute force, compounds as phrases, the diagnostic."""

import random

import pytest

from corvid.operators import fulltext as FT

UNITS = "qid long, side string, unit string, words array<string>"


def random_case(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "ä9", "x", "y"]
    texts = [(k, rng.choice([" ", ", ", "_"]).join(rng.choices(words, k=rng.choice([0, 1, 4, 12, 25])))) for k in range(40)]
    units = {q: [rng.choices(words[:4], k=rng.choice([1, 1, 2, 3])) for _ in range(rng.choice([1, 2, 3]))] for q in range(12)}
    return texts, units


@pytest.mark.parametrize("mode", ["any", "all"])
def test_density_matches_brute_force(spark, mode):
    texts, units = random_case(11 if mode == "any" else 12)
    chunks = spark.createDataFrame([*texts, (99, None)], "chunk_id long, text string").repartition(3)
    rows = [(q, "plain", " ".join(u), u) for q, us in units.items() for u in us]
    got = {(r.qid, r.chunk_id): r.score for r in FT.rank(chunks, spark.createDataFrame(rows, UNITS).distinct(), mode).collect()}
    want = {(q, k): FT.reference_density(t, us, mode) for q, us in units.items() for k, t in texts}
    assert got == {key: round(v, 6) for key, v in want.items() if v is not None}
    assert len(got) > 50
    if mode == "all":
        assert any(v * 10 != int(v * 10) for v in got.values())  # covers with other words inside


def test_compounds_are_phrases_and_covers_are_minimal(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["set max_size and max_size", "max of size", "the size", *["filler"] * 60])], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "what is max_size"), (2, "pg-16 max_size pg-16"), (3, "what is")], "qid long, query string")
    got = {(r.qid, r.chunk_id): r.score for r in FT.scores(docs, q, ["what", "is"]).collect()}
    # prose: two phrases; identifiers: four words, each of which is a cover inside the phrases
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {0: 0.4, 1: 0.2, 2: 0.1}
    assert {k[0] for k in got} == {1, 2}


def test_diagnostic_names_queries_drops_and_ranks(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["max_wal senders", "senders senders", "wal", *["common"] * 60])], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "common max_wal-senders pg16"), (2, "nothing")], "qid long, query string")
    gold = spark.createDataFrame([(1, 1), (1, 7), (2, 0)], "qid long, chunk_id long")
    got = {r.qid: r for r in FT.diagnostic(docs, q, [], gold).collect()}
    assert got[1].plain_query == "'max_wal-senders'" and got[1].identifier_query == "'max' | 'wal' | 'senders' | 'max_wal-senders'"
    assert got[1].dropped_terms == ["common", "pg16"] and got[1].n_matching == 3 and got[1].top_ids == [0, 1, 2]
    assert got[1].gold_ranks == {"1": 2, "7": None} and got[2].gold_ranks == {"0": None}
    assert got[2].n_matching == 0 and got[2].plain_query == "'nothing'"


def test_places_of_a_lexeme_are_bounded_as_in_an_index(spark):
    docs = spark.createDataFrame([(1, "w " * 400), (2, "x " * 20_000 + "w w")], "chunk_id long, text string")
    units = spark.createDataFrame([(1, "plain", "w", ["w"])], UNITS)
    assert {r.chunk_id: r.score for r in FT.rank(docs, units).collect()} == {1: 25.6, 2: 0.1}
    assert FT.rank(docs.limit(0), units).collect() == []
