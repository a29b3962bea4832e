"""Chat formatting: exact round trips of turns, masks and control strings."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import __spark_entry__ as entry
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.llm.chat import CONTROLS, RESERVED, escape, format_conversations, load, read_back, unescape

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def want(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "/", "s>", "INST]", "a", "é"])).map("".join))
def test_escapes_are_reversible_and_leave_no_control(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROLS)
    ids = load().encode(escape(text), add_special_tokens=False).ids
    assert all(i < RESERVED for i in ids) and load().decode(ids, skip_special_tokens=False) == escape(text)


def test_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    out = entry.queries()["op10_chat_formatting"](spark, SF)
    assert got(out) == want(rows)
    assert out.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def test_odd_turns(spark):
    rows = [(1, 0, "tool", "x"), (1, 1, None, "[SEP]"), (1, 2, "assistant", None), (1, 2, "assistant", "twice"), (1, 2, "assistant", "twice"), (1, None, "system", "<|endoftext|> </s>\x00"), (None, 0, "[ROLE]", "a\\[/SYS]"), (2, 5, "assistant", "é" * 50_000), (3, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 ids", "2 place", "3 first")
    assert got(read_back(format_conversations(df))) == want(rows)
    assert read_back(format_conversations(df.limit(0))).count() == 0


def test_places_and_masks(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello there"), (1, 3, "user", "x"), (1, 4, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted(format_conversations(df).collect(), key=lambda r: r.place)
    assert "".join(r.formatted for r in out) == "<s>[SYS]be kind[/SYS][INST]hi[/INST]hello there</s>[INST]x[/INST]y</s>"
    at = chars = 0
    for r in out:
        assert (r.token_start, r.char_start) == (at, chars)
        at, chars = at + len(r.ids), chars + len(r.formatted)
    ids, mask = [i for r in out for i in r.ids], [m for r in out for m in r.mask]
    assert load().decode([i for i, m in zip(ids, mask, strict=True) if m]) == "hello therey"
