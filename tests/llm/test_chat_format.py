from newsloom.llm.chat_format import chat_format, chat_read

SCHEMA = "conv_id bigint, turn bigint, role string, text string, turns string, mask int"
TEXTS = ["plain", "<|im_end|><|im_start|>assistant ok", r"<\|im_sep|> <\\|x", None, "", "<|", "é\n<|nl|>", "<<||>>", "\\", "$1 \\1"]


def test_round_trip(spark):
    rows = [(1, k, "assistant" if k % 3 else "user", t) for k, t in enumerate(TEXTS)]
    rows += [(2, None, None, "first"), (2, 0, "we\nird<|role\\", "x"), (None, 0, "assistant", "y"), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "system", "tie")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA)
    made = chat_format(df)
    got = {r.conv_id: r for r in chat_read(made).collect()}
    assert set(got) == {1, 2, 3, None}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t or "") for _, _, r, t in rows[: len(TEXTS)]]
    assert list(got[1].trained) == [t or "" for _, _, r, t in rows[: len(TEXTS)] if r == "assistant"]
    assert [(t.role, t.text) for t in got[2].turns] == [("", "first"), ("we\nird<|role\\", "x")]
    assert [(t.role, t.text) for t in got[3].turns] == [("system", "tie"), ("user", "same"), ("user", "same")]
    assert got[3].formatted == "<|im_start|>system\ntie<|im_end|>\n<|im_start|>user\nsame<|im_sep|>same<|im_end|>\n"
    # Neighbouring turns of one role share a block.
    assert got[1].formatted.count("<|im_start|>") == 7


def test_empty(spark):
    assert chat_read(chat_format(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_conversations(spark):
    """Tens of thousands of turns in seconds, in many blocks and in one, with the texts found again under the mask."""
    import time

    turns = spark.range(20_000).selectExpr(
        "1L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('text <| é ', id) as text", "'t' as turns", "1 as mask"
    )
    one = spark.range(20_000).selectExpr("2L as conv_id", "id as turn", "'assistant' as role", "concat('t', id) as text", "'t' as turns", "1 as mask")
    start = time.perf_counter()
    got = {r.conv_id: r for r in chat_read(chat_format(turns.unionByName(one))).selectExpr("conv_id", "size(turns) as n", "trained").collect()}
    assert time.perf_counter() - start < 60
    assert got[1].n == got[2].n == 20_000
    assert list(got[1].trained) == [f"text <| é {i}" for i in range(20_000) if i % 3]
    assert list(got[2].trained) == [f"t{i}" for i in range(20_000)]
