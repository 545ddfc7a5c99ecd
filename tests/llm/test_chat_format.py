import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from quarry.llm import chat_format, registry
from quarry.llm.chat_format import Template
from tests.llm.oracle import assert_same

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, turns string"
NASTY = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "\\</s>", "<", "[", "<s", "</s", "[TURN]", "[TURN][TURN]", "\\\\<s>\\", "[[INST]]", "<</s>>", "é\n\U0001f600 $1 \\$1", "", None]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    convs = {}
    for k, r in enumerate(rows):
        convs.setdefault((r[0], k if r[0] is None else None), []).append(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
    out = []
    for (conv, _), turns in convs.items():
        turns.sort()
        learned = "".join(t for _, role, t in turns if role == "assistant")
        blocks = len(list(itertools.groupby(turns, lambda t: t[1])))
        out.append((conv, len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(learned), sha(learned), blocks))
    return sorted(out, key=repr)


def run(spark, rows):
    found = chat_format.digests(spark.createDataFrame(rows, SCHEMA))
    return sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_blocks) for r in found.collect()), key=repr)


ROLES = ["user", "assistant", "assistant", "system", None, "[INST]", "a</s>\\"]
ROWS = (
    [(1, i, ROLES[i % len(ROLES)], t, "x") for i, t in enumerate(NASTY * 3)]
    + [(2, None, "user", "first", None), (2, 1, "assistant", "b", None), (2, 1, "assistant", "a", None), (2, 1, "assistant", "a", None)]
    + [(None, 0, "user", "lone", None), (None, 0, "user", "lone", None), (3, 0, None, None, None), (4, 0, "assistant", "z" * 300_000 + "</s>", None)]
    + [(5, i, "assistant" if i // 3 % 2 else "user", f"t{i}", None) for i in range(1500)]
)


def test_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_one_block_of_a_role(spark):
    rows = [(1, 0, "user", "a", ""), (1, 1, "user", "b</s>", ""), (1, 2, "assistant", "c", ""), (1, 3, "assistant", "d", "")]
    r = chat_format.formatted(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.formatted == "<s>[INST]user[/INST]a[TURN]b<\\/s></s><s>[INST]assistant[/INST]c[TURN]d</s>"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss] == ["c", "d"]


def test_other_marks(spark):
    template = Template("<|begin|>", "<|role|>", "<|text|>", "<|next|>", "<|end|>")
    rows = [(1, i, r, t, "") for i, (r, t) in enumerate(itertools.product(["user", "assistant"], ["<|end|>", "<|<|end|>|>", "\\<|role|>"]))]
    docs = spark.createDataFrame(rows, SCHEMA)
    text = chat_format.formatted(docs, template).select(chat_format.read_back(F.col("formatted"), template).alias("b")).first().b
    assert [(b.role, t) for b in text for t in b.texts] == [r[2:4] for r in rows]
    with pytest.raises(ValueError):
        Template(role="<s>").checked()
    with pytest.raises(ValueError):
        Template(end="</<>").checked()


def test_running_sums(spark):
    df = spark.createDataFrame([([],), ([5],), (list(range(1000)),)], "x array<bigint>")
    want = [list(itertools.accumulate([0, *r.x]))[:-1] for r in df.collect()]
    assert [r[0] for r in df.select(chat_format.running_sums(F.col("x"))).collect()] == want


def test_empty(spark):
    assert run(spark, []) == []


def test_no_python_in_the_plan(spark):
    plan = chat_format.digests(spark.createDataFrame(ROWS[:3], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_matches_sql(spark):
    assert_same(registry.QUERIES["op12_chat_format"](spark, SF), registry.ORACLES["op12_chat_format"], SF)
