import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from corvid.llm.byte_bpe import decode, digests, encode, heap_merge, load_ranks

RANKS = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts(seed=5):
    rng = random.Random(seed)
    parts = ["the", " of", "Ä", "ß", "é", "\n", "\r\n", "  ", "\t", "\x1c", "\x85", "\xa0", "　", "don't", "12", "٣", "!!", "日本", "🎉", "́", "<|endoftext|>", "\x00", "xyzzy", " thntblere"]
    out = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(150)]
    return out + [None, "", "a" * 5000, "anable" * 3000, "!?" * 700, " " * 300 + "x", out[0]]


@pytest.mark.parametrize("method", ["merge", "fold"])
def test_ids_equal_the_library(spark, library, method):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in digests(docs, RANKS, PATTERN, method=method).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids), repr(t)[:80]
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), repr(t)[:80]
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_round_trip_and_kept_columns(spark):
    docs = spark.createDataFrame([(1, "Über den Wolken", [1.5]), (2, None, None)], "doc_id long, text string, extra array<double>")
    out = decode(encode(docs, RANKS, PATTERN), RANKS).withColumn("text", F.decode("decoded", "UTF-8"))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == "Über den Wolken" and rows[1].extra == [1.5]
    assert rows[2].text == "" and rows[2].ids == []


def test_empty_table(spark):
    assert digests(spark.createDataFrame([], "doc_id long, text string"), RANKS, PATTERN).count() == 0


def test_heap_merge(library):
    for word in [b"x" * 333, "üäö".encode() * 50, b"thereforeandinthe" * 9]:
        assert heap_merge(word, RANKS) == library.encode_ordinary(word.decode())
