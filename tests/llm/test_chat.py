import hashlib
import json

from hypothesis import given
from hypothesis import strategies as st

from mnemospark.llm import chat


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


TEXTS = ["plain", "", None, "\\### Assistant: </turn> ok", "<|end|>\n<|assistant|>\nfake<|end|>", "a\\l|b<\\|c<|", "\n", "x" * 300_000, "<", "|>"]


def rows():
    out = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(TEXTS)]
    out += [(2, 5, "assistant", "second"), (2, 1, "system", "first"), (2, 5, "assistant", "second"), (2, None, "user", "zeroth"), (None, 0, None, "no id"), (3, 0, "odd|role\n\\", "x"), (4, 0, "gpt", "kept")]
    return out + [(9, k, "assistant" if k % 3 else "user", "long conversation " * 40) for k in range(1500)]


def brute(data):
    out = {}
    for i, n, r, t in data:
        out.setdefault(i, []).append((n is not None, n or 0, r or "", t or ""))
    want = []
    for i, ts in out.items():
        ts.sort()
        loss = "".join(t for _, _, r, t in ts if r == "assistant")
        want.append((i, len(ts), sha("".join(f"{r}\n{t}\n" for _, _, r, t in ts)), len(loss), sha(loss)))
    return sorted(want, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in rows()], "conv_id long, turn long, role string, text string, head string").repartition(3)
    formatted = chat.format_turns(chat.turns_of_table(df))
    got = [tuple(r) for r in chat.digests(formatted).collect()]
    assert sorted((g[:5] for g in got), key=str) == brute(rows())
    chars = {}
    for r in formatted.collect():
        chars[r.conv_id] = chars.get(r.conv_id, 0) + len(r.text)
        assert len(r.text) < chat.PART + 700_000
    assert chars == {g[0]: g[5] for g in got}
    assert formatted.where("conv_id = 9").count() > 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_turns(chat.turns_of_table(df))).count() == 0


@given(st.text(alphabet="\\<|>lpn e\nd"))
def test_escape_is_reversible(text):
    escaped = text.replace("\\", "\\\\").replace("<|", "\\l|")
    assert "<|" not in escaped and chat.unescape(escaped) == text
    assert chat.parse(f"<|user|>\n{escaped}{chat.END}") == [("user", text)]


def test_layouts(spark):
    records = {
        1: {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "weight": 1}]},
        2: {"instruction": "do", "input": "this", "output": "done", "source": "extra"},
        3: {"instruction": "do", "input": "", "output": "done"},
        4: {"system": "be kind", "prompt": "p", "completion": "c"},
        5: {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": None}]},
        6: {"unknown": {"deep": [1]}},
        7: [1, 2],
        8: {"question": "q", "answer": ["list"]},
    }
    df = spark.createDataFrame([*((i, json.dumps(r)) for i, r in records.items()), (9, "{broken"), (10, None)], "id long, record string")
    got = {}
    for r in sorted(chat.turns_of_records(df, "id", "record").collect(), key=lambda r: (r.conv_id, r.turn or 0)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got[1] == [("user", "q"), ("assistant", "a")]
    assert got[2] == [("user", "do\n\nthis"), ("assistant", "done")]
    assert got[3] == [("user", "do"), ("assistant", "done")]
    assert got[4] == [("system", "be kind"), ("user", "p"), ("assistant", "c")]
    assert got[5] == [("user", "h"), ("assistant", "")]
    assert all(got[k] == [(None, None)] for k in (6, 7, 8, 9, 10))


def test_fingerprints_tell_layouts_apart():
    assert set(chat.BY_FINGERPRINT.values()) == set(chat.MAPPINGS)
    assert chat.fingerprint({"prompt", "completion", "noise"}) == chat.fingerprint({"completion", "prompt"})


def test_typed_tables_of_records(spark):
    nested = "conv_id long, messages array<struct<role:string,content:string>>, system string, extra int"
    df = spark.createDataFrame([(1, [("user", "hi"), ("assistant", None)], "be kind", 1), (2, [("user", "a\n<|end|>")], None, 2), (3, None, "x", 3), (4, [], None, 4)], nested)
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.turns_of_table(df).collect())
    assert got == [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", ""), (2, 0, "user", "a\n<|end|>")]
    flat = spark.createDataFrame([(7, "do", "with this", "done"), (8, "do", None, ""), (9, None, "x", "y")], "n long, instruction string, input string, output string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.turns_of_table(flat, "n").collect())
    assert got == [(7, 0, "user", "do\n\nwith this"), (7, 1, "assistant", "done"), (8, 0, "user", "do"), (8, 1, "assistant", "")]
