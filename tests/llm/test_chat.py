import hashlib
import random

import pytest

from fringework.llm import chat as C

ODD = ["", "a", "<|im_end|>", "<\\|im_start|>x<\\\\|", "ends with <", "|x", "\\n \\", "line\nline", "\x01a", "\U0001f600<|"]


def brute(rows):
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, _, role, text in sorted(rows, key=key):
        out.setdefault(conv, []).append((role or "", text or ""))
    for conv, turns in out.items():
        said = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        yield (conv, len(turns), sha(whole), len(said), sha(said), len(C.marked_turns(turns)), False)


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "<|x|>\n\\"]), rnd.choice(ODD)) for c in range(12) for t in range(rnd.randint(1, 6))]
    rows += [(50, t, "assistant" if t % 2 else "user", rnd.choice(ODD)) for t in range(200)]
    rows += [(None, None, None, None), (None, 1, "assistant", "x"), (60, 1, "user", "tie"), (60, 1, "user", "tie"), (61, 0, "user", "z" * 100_000)]
    spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, piece string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = "<|im_end|><|im_start|>assistant ok"
    want = sorted(brute([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]), key=repr)
    got = sorted(map(tuple, C.op6_chat(spark, str(tmp_path)).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("text", ODD)
def test_escaping_is_reversible(text):
    assert C.unescaped(C.escaped(text)) == text and "<|" not in C.escaped(text)
    assert C.parsed(C.marked_turns([(text, text)])) == (text, text)


def strips_earlier_thoughts(messages, prompt=False):
    last = len(messages) - 1
    return "".join(f"[{r}]{t if i == last else t.partition('#')[0]};" for i, (r, t) in enumerate(messages)) + ("[assistant]" if prompt else "")


def numbered(messages, prompt=False):
    return "BOS" + "".join(f"({i}:{r}){t}|" for i, (r, t) in enumerate(messages)) + (f"({len(messages)}:assistant)" if prompt else "")


def test_rewriting_templates_are_found():
    state = C.Incremental(strips_earlier_thoughts)
    got = [state.turn(*m) for m in [("user", "q"), ("assistant", "a#why"), ("user", "r")]]
    assert [t.rewrites for t in got] == [False, False, True]
    state = C.Incremental(numbered, prefix=4)
    got = [state.turn("user", "q") for _ in range(6)]
    assert [t.rewrites for t in got][:4] == [False] * 4 and any(t.rewrites for t in got)


def test_mask_of_an_unknown_template():
    state = C.Incremental(numbered)
    got = [state.turn(*m) for m in [("user", "q"), ("assistant", "hello"), ("assistant", "")]]
    assert state.opening == "BOS" and [t.piece[t.low : t.high] for t in got[1:]] == ["hello", ""]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in C.op6_chat(spark, str(tmp_path)).collect()] == [-1]


def keeps_the_last_40(messages, prompt=False):
    return C.marked_turns(messages[-40:], prompt)


def test_long_conversations_are_rendered_in_true_context(spark):
    turns = [("assistant" if i % 2 else "user", f"text {i}") for i in range(60)]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = sorted(C.formatted(rows, numbered).collect(), key=lambda r: r.seq)
    assert "".join(r.piece for r in got) == numbered(turns) and not any(r.rewrites for r in got)
    assert [r.piece[r.low : r.high] for r in got if r.low >= 0] == [t for r, t in turns if r == "assistant"]
    got = sorted(C.formatted(rows, keeps_the_last_40).collect(), key=lambda r: r.seq)
    assert [r.rewrites for r in got] == [i >= 40 for i in range(60)]


def test_four_hundred_turns_of_both_templates():
    turns = [("assistant" if i % 2 else "user", f"text {i}") for i in range(400)]
    state = C.Incremental(numbered)
    got = [state.turn(*m) for m in turns]
    assert state.opening + "".join(t.piece for t in got) == numbered(turns) and not any(t.rewrites for t in got)
    state = C.Incremental(keeps_the_last_40)
    assert [state.turn(*m).rewrites for m in turns] == [i >= 40 for i in range(400)]
