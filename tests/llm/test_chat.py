import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from corvid.llm.chat import ESCAPE, TURN, escape, format_conversation, format_turns, read_back, read_back_report, unescape, with_probe

TRICKY = st.lists(st.sampled_from(["<|turn|>", "<|end|>\n", "</s>", "[INST]", "[/INST]", ESCAPE, "-", "n", "\n", "<", "|", ">", "<<|", "<|image_1|>", "é", "a"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(TRICKY)
def test_escape_is_reversible_and_leaves_no_control(text):
    out = escape(text)
    assert unescape(out) == text and unescape(escape(text, True)) == text
    assert not any(c in out for c in ("<|", "[INST]", "[/INST]", "</s>"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=5))
def test_conversation_reads_back(turns):
    text, _, _ = format_conversation([(r, [{"type": "text", "text": t}]) for r, t in turns])
    assert [(r, "".join(v for _, v in p)) for r, p in read_back(text)] == turns


def test_parts_become_placeholders():
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 600, "height": 100}, {"type": "text", "text": "<|image_9|>"}, {"type": "audio", "ref": "b", "seconds": 1.5}, {"type": "pdf", "ref": "c", "pages": 2}]
    text, spans, attachments = format_conversation([("user", parts), ("assistant", [{"type": "text", "text": "ok"}])])
    assert [(a.number, a.kind, a.ref, a.tokens) for a in attachments] == [(1, "image", "a.png", 512), (2, "audio", "b", 38), (3, "document", "c", 2048)]
    assert [p for _, p in read_back(text)][0] == [("text", "see "), ("image", "1"), ("text", "<|image_9|>"), ("audio", "2"), ("document", "3")]
    assert [text[s:e] for s, e in spans] == ["ok"]


def expected(rows):
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    out = {}
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_report(spark):
    rows = [(1, 1, "assistant", "b <|end|>\n" + TURN), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (3, None, "assistant", "é" * 10), (None, 0, "user", "q")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"t{k}" * 50) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    probe = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns = format_turns(with_probe(df))
    got = {r[0]: r for r in read_back_report(turns).collect()}
    want = expected(rows + probe)
    assert {k: tuple(v)[1:5] for k, v in got.items()} == want
    sizes = {r[0]: r[1] for r in turns.selectExpr("conv_id", "length(formatted) n").groupBy("conv_id").sum("n").collect()}
    assert {k: v.formatted_chars for k, v in got.items()} == sizes


def test_typed_rows_and_empty_table(spark):
    content = json.dumps([{"type": "image", "ref": "z"}, {"type": "text", "text": "hi"}])
    df = spark.createDataFrame([("k", 0, "user", content), ("k", 1, "user", content)], "conv_id string, turn int, role string, text string")
    out = format_turns(df, typed=True).orderBy("position").collect()
    assert [r.attachments[0].number for r in out] == [1, 2] and out[1].char_from == len(out[0].formatted)
    assert read_back_report(format_turns(df.limit(0))).count() == 0


def test_typed_content_of_odd_shapes(spark):
    rows = [
        (1, 1, "user", "not json </s>"), (1, 2, "user", '["plain", {"type": "image", "width": "1030px", "height": null, "ref": "a"}, 7, null]'), (1, 3, "assistant", '{"type": "audio", "seconds": "x", "ref": 5}'),
        (1, 4, "assistant", '[{"type": "text", "text": {"k": 1}}, {"type": ["odd"], "pages": true}]'), (1, 5, "assistant", "[]"),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, position int")
    out = format_turns(df, typed=True).orderBy("position").collect()
    text = "".join(r.formatted for r in out)
    parts = [p for _, p in read_back(text)]
    assert parts[0] == [("text", "not json </s>")] and parts[1][0] == ("text", "plain") and parts[1][1][0] == "image" and parts[1][2] == ("text", "7")
    assert [k for k, _ in parts[2]] == ["audio"] and parts[3][0] == ("text", '{"k": 1}') and parts[3][1][0] == "document" and parts[4] == []
    tokens = [a.tokens for r in out for a in r.attachments]
    assert tokens == [3 * 256, 0, 1024]
