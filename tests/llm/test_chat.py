import hashlib

import pytest

from foliant.llm.chat import BLOCK, chat_digests, escape, format_chats, locate, marked_turns, parse_marked, unescape

NASTY = ["", "</s>", "<|user|>\n", "\\", "\\\\</s>", "<\\/s>", "[INST][/INST]", "<", "</s", "|>", "ab", "\n", "[\\INST]"]


@pytest.mark.parametrize("text", NASTY)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text
    assert "</s>" not in escape(text) and "[INST]" not in escape(text)
    assert parse_marked(marked_turns([("user", text), (text, "x")], 0)) == [("user", text), (text, "x")]


def test_locate_and_rewrites():
    turns = [("user", "assistant"), ("assistant", "\n"), ("user", ""), ("assistant", "ü</s>")]
    out, spans, texts, rewrites = locate(turns, 0, marked_turns)
    assert not rewrites and spans[0][0] == 0 and spans[-1][1] == len(out)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert [unescape(out[a:b]) for a, b in texts] == [t for _, t in turns]
    last = lambda ts, first: "".join(t if i == len(ts) - 1 else "…" for i, (_, t) in enumerate(ts))
    assert locate(turns, 0, last)[3]


def test_conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} </s>", 5) for i in range(2 * BLOCK + 3)]
    rows += [(None, None, None, None, 5), (2, 1, "assistant", None, 5), (2, 0, "user", NASTY[2], 5), (2, 0, "user", NASTY[2], 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat_digests(format_chats(df)).collect()}
    assert set(got) == {1, 2, None}
    own = [r for r in rows if r[0] == 1]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest()
    loss = "".join(r[3] for r in own if r[2] == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].formatted_chars == len(marked_turns([r[2:4] for r in own], 0)) and not got[1].rewrites
    assert got[2].n_turns == 3 and got[2].loss_chars == 0
    assert format_chats(df.limit(0)).count() == 0
