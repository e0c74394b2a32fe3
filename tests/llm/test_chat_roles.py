"""Roles of conversation rows stay as given; only the layout with other names for roles has them renamed."""

import hashlib
import json

from millrace.llm.chat import canonical_turns, chat_digests

ROWS = [
    (1, 0, "human", "q"), (1, 1, "model", "r"), (1, 2, "user", "s"),
    (2, 0, "gpt", "a"), (2, 1, "bot", "b"), (2, 2, "assistant", "c"), (2, 3, None, None),
    (3, 0, "user", "x"), (3, 1, "assistant", "yz"),
    (4, 0, "Assistant", "no"), (4, 1, "assistant ", "no"), (4, 2, "assistant", "##</turn>\\"),
]


def test_roles_stay(spark):
    docs = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_digests(docs).collect()}
    for conv in (1, 2, 3, 4):
        turns = [(role or "", text or "") for c, _, role, text in ROWS if c == conv]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_shared_layout_has_its_roles_renamed(spark):
    said = [{"from": r, "value": r.upper()} for r in ("system", "human", "gpt", "bot", "model", "tool")]
    records = spark.createDataFrame([(json.dumps({"conversations": said}),), (json.dumps({"messages": [{"role": "human", "content": "x"}]}),)], "record string")
    for flag in (True, False):
        a, b = canonical_turns(records, long_records=flag).orderBy("layout").collect()
        assert [t.role for t in a.turns] == ["system", "user", "assistant", "assistant", "assistant", "tool"]
        assert [t.role for t in b.turns] == ["human"]
