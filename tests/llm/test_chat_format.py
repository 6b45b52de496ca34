import json
import random

from pyspark.sql import functions as F

from rankforge.llm import chat_format as c

RECORDS = [
    (1, {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    (2, {"conversations": [{"from": "human", "value": "q"}, {"value": None, "from": "gpt"}], "system": "be kind"}, [("system", "be kind"), ("user", "q"), ("assistant", "")]),
    (3, {"prompt": "q", "response": "a", "id": 7}, [("user", "q"), ("assistant", "a")]),
    (4, {"prompt": "q", "completion": "a"}, [("user", "q"), ("assistant", "a")]),
    (5, {"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    (6, {"instruction": "do", "output": "done", "input": ""}, [("user", "do"), ("assistant", "done")]),
    (7, {"question": "q", "answer": "a", "context": "c"}, [("user", "c\n\nq"), ("assistant", "a")]),
    (8, {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, [("user", "ab")]),
    (9, {"messages": []}, []),
    (10, {"something": {"else": 1}}, []),
]


def test_layouts_become_turns(spark):
    rows = spark.createDataFrame([(k, json.dumps(r), "z") for k, r, _ in RECORDS], "conv_id long, j string, text string").select("conv_id", "text", F.parse_json("j").alias("body"))
    got = {}
    for t in c.canonical_turns(rows).orderBy("conv_id", "turn").collect():
        got.setdefault(t.conv_id, []).extend([(t.role, t.text)] if t.role is not None else [])
    assert got == {k: want for k, _, want in RECORDS}
    assert [r.n for r in c.unknown_layouts(rows).collect()] == [1]
    shapes = rows.select("conv_id", c.fingerprint(F.col("body")).alias("f")).collect()
    assert len({r.f for r in shapes}) == len(RECORDS) - 1  # two share a layout


def test_control_strings_come_back(spark):
    r = random.Random(8)
    parts = ["<|im_start|>", "<|im_end|>\n", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<", "\\", "|", "[", "INST]", "s>", "\n", "é", "%0A", "%"]
    turns = [(i // 3, i % 3, r.choice(["user", "assistant", "".join(r.choice(parts) for _ in range(3))]), "".join(r.choice(parts) for _ in range(r.randint(0, 9)))) for i in range(1500)]
    made = c.format_turns(spark.createDataFrame([(*t, None) for t in turns], "conv_id long, turn long, role string, text string, layout string"))
    back = made.select("conv_id", "formatted", "loss_spans", c.read_turns(F.col("formatted")).alias("turns"), c.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for row in back:
        own = [(x[2], x[3]) for x in turns if x[0] == row.conv_id]
        assert [tuple(t) for t in row.turns] == own
        assert row.loss == "".join(t for role, t in own if role == "assistant")
        assert row.formatted.count("<|im_start|>") == row.formatted.count("<|im_end|>\n") == 3
        for piece in row.formatted.split("<|im_end|>\n")[:-1]:
            inside = piece.removeprefix("<|im_start|>")
            assert not any(s in inside for s in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<SYS>", "</SYS>"))
