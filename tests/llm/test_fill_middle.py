import hashlib
import random
import re

import numpy as np
import pytest

from corvid.llm.fill_middle import CODE_POINT, END, SENTINEL, UNIT, Automaton, Settings, fill_in_middle, middle_report, restore


def brute(doc_id, text, spm=50, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < spm
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


def texts():
    rng = random.Random(5)
    pieces = ["a", "\n", "ä", "語", "𝄞", "<", "P", "S", "M", ">", " ", "\r\n", "<P", "<<", "é\n"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.choice([0, 1, 3, 20, 200])))) for i in range(300)]
    return [*rows, (300, None), (301, ""), (302, "x" * 300_000 + "\n" + "𝄞" * 90_000), (302, "again"), (None, "k\nl"), (303, "\n\n\n"), (304, "<<P>>"), (305, "y\n" * 50_000)]


def test_report_matches_brute_force(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in middle_report(docs).collect()), key=str)
    assert got == sorted((brute(*x) for x in texts()), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_restore_and_columns_are_carried(spark):
    docs = spark.createDataFrame([(i, t, i, "f") for i, t in texts()], "doc_id long, text string, n long, Form string")
    out = fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "n", "Form", "_n", "_form", "prefix_chars", "middle_chars"]
    rows = out.collect()
    assert sorted(((r.doc_id, restore(r.text, r._form)) for r in rows), key=str) == sorted(((i, t or "") for i, t in texts()), key=str)
    assert all(r.n == r.doc_id and r.Form == "f" for r in rows)
    assert middle_report(docs.limit(0)).collect() == []


def test_rate_and_form_are_parameters(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    got = {tuple(r) for r in middle_report(docs, settings=Settings(rate=30, spm=0)).collect()}
    assert got == {brute(i, t, spm=0, rate=30) for i, t in texts()}


@pytest.mark.parametrize("marks", [("<P>", "<S>", "<M>"), ("aab", "b", "abaab"), ("ä", "ß", "<|end|>")])
def test_automaton_counts(marks):
    automaton = Automaton(marks)
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choices([*"aabß<|>\n𝄞", *marks], k=rng.choice([1, 5, 900])))
        emitted = automaton.scan(np.array([*text.encode(), END], np.int32))
        ends = sum(text.encode().endswith(m.encode(), 0, k) for k in range(1, len(text.encode()) + 1) for m in marks[:1])
        assert (emitted & CODE_POINT).astype(bool).sum() == len(text)
        assert (emitted & UNIT).astype(bool).sum() == len(re.findall(r"[^\n]*\n|[^\n]+", text))
        assert ((emitted & SENTINEL) > 0).any() == any(m in text for m in marks)
        assert ((emitted & SENTINEL) > 0).sum() >= ends


def test_lanes_with_wrong_guesses_are_walked_again():
    automaton = Automaton(("<" * 40 + "P>", "<S>", "<M>"))
    automaton.memory = 1  # makes guesses fail
    data = np.array([*(b"<" * 255 + b"<" * 100 + b"P>" + "ä𝄞".encode() * 400), END], np.int32)
    emitted = automaton.scan(data)
    assert ((emitted & SENTINEL) > 0).sum() == 1 and (emitted & CODE_POINT).sum() == 357 + 800
