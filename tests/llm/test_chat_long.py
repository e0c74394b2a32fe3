"""Conversations beyond the limits of Spark's JSON parser and of one variant."""

import hashlib

from pyspark.sql import functions as F

from millrace.llm import chat


def digest(turns):
    held = hashlib.sha256()
    for role, text in turns:
        held.update(f"{role}\n{text}\n".encode())
    return held.hexdigest()


def test_long_texts(spark):
    long, part = 20_000_001, 14_000_000
    wanted = {
        1: [("user", "a" * long), ("assistant", "b")],
        2: [("user" if k % 2 == 0 else "assistant", chr(97 + k) * part) for k in range(10)],
    }
    sizes = [(i, k, role, text[0], len(text)) for i, turns in wanted.items() for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(sizes, "conv_id long, turn long, role string, c string, n int").withColumn("text", F.expr("repeat(c, n)"))
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    for i, turns in wanted.items():
        said = [text for role, text in turns if role == "assistant"]
        assert got[i].n_turns == len(turns) and got[i].turns_sha256 == digest(turns)
        assert got[i].loss_chars == sum(map(len, said)) and got[i].loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()


def test_layouts_in_parts(spark, monkeypatch):
    """Records that one variant can't hold get the turns that a variant would give; the limits are lowered to see it on short ones."""
    records = [
        '{"messages":[{"role":"user","content":"[1]"},null,{"role":"model"},{"role":null,"content":2.50}]}',
        '{"messages":[{"role":"user","content":[{"type":"image"}]}]}',
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"{}"}]}',
        '{"conversations":[]}',
        '{"completion":"c","prompt":null}',
        '{"input":"n","instruction":"i","output":"o"}',
        '{"prompt":"p","completion":["c"]}',
        '{"prompt":"p","completion":"c","more":1}',
        '{"other":1}',
        "no json",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(records)), "k long, record string")
    whole = chat.canonical_turns(df).orderBy("k").collect()
    assert [r.layout for r in whole] == ["messages", None, "conversations", None, "prompt", "instruction_input", *[None] * 5]
    monkeypatch.setattr(chat, "_SMALL", -1)
    monkeypatch.setattr(chat.F, "try_parse_json", lambda c: F.lit(None).cast("variant"))
    from_json = F.from_json
    monkeypatch.setattr(chat.F, "from_json", lambda c, schema, options: F.lit(None).cast("variant") if schema == "variant" else from_json(c, schema, options))
    assert chat.canonical_turns(df).orderBy("k").collect() == whole
