import hashlib

from emberwatch.llm import chat

ROWS = [
    (1, 0, "user", "a"), (1, 1, "user", "b<|and|>c"), (1, 2, "assistant", "<|end|>[INST]\\l"),
    (1, 3, "assistant", ""), (1, 4, ">x|", "|>"), (2, 0, None, None), (2, 0, "user", "tie"),
    (2, 0, "user", "tie"), (3, None, "assistant", "é😀\n|"), (3, 0, "assistant", "|"),
    (None, 0, "system", "s"), (4, 1, "", "x"), (4, 0, "", "y" * 100_000),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def expected():
    talks = {}
    for conv, turn, role, text in ROWS:
        talks.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_every_turn_is_read_back(spark):
    formatted = chat.format_conversations(spark.createDataFrame(ROWS, SCHEMA))
    got = {r.conv_id: tuple(r)[1:5] for r in chat.describe(formatted).collect()}
    assert got == expected()


def test_adjacent_turns_of_a_role_share_a_header(spark):
    rows = spark.createDataFrame(ROWS[:4], SCHEMA)
    row = chat.format_conversations(rows).first()
    assert row.formatted == (
        "<|user|>a<|and|>b\\l|and|\\gc<|end|><|assistant|>\\l|end|\\g\\bINST]\\el<|and|><|end|>"
    )
    assert [row.formatted[s.start : s.end] for s in row.loss_spans] == [
        "\\l|end|\\g\\bINST]\\el", ""
    ]


def test_no_rows(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert chat.describe(chat.format_conversations(rows)).count() == 0
