"""Chat windows against a slow version that reads each conversation from its start."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lemmata.llm import chat, registry

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"
CONTROL = re.compile(r"<\||</?s>|<</?SYS>>|\[/?INST\]")


def cost(text):
    return len(re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20\x7f]", text)) + chat.FRAME


def slow_windows(turns, rule):
    """[(own turns, context turns)] of one conversation with distinct turn numbers."""
    rows = sorted(((t, r or "", x or "") for t, r, x in turns), key=lambda y: (y[0] is not None, y[0] or 0))
    head = rows[0] if rows[0][1] == "system" and cost(rows[0][2]) <= rule.budget // 4 else None
    out, used = [], 0
    for i, row in enumerate(rows):
        room = rule.budget if len(out) == 1 else rule.budget - rule.history - (cost(head[2]) if head else 0)
        new = not out or used + cost(row[2]) > room or (row[0] is None) != (rows[i - 1][0] is None) or row[0] is not None and row[0] // chat.BLOCK != rows[i - 1][0] // chat.BLOCK
        if new:
            context, left = [], rule.history
            for old in reversed(rows[:i]):
                left -= cost(old[2])
                near = old[0] is not None and row[0] is not None and old[0] >= row[0] - rule.back
                if left < 0 or not near or old is head:
                    break
                context.insert(0, old)
            out.append(([row], [head, *context] if head and i else context))
            used = cost(row[2])
        else:
            out[-1][0].append(row)
            used += cost(row[2])
    return out


def shown(turn):
    esc = lambda x: CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], x.replace("\\", "\\\\"))
    return f"<|turn|>{esc(turn[1])}<|says|>{esc(turn[2])}<|end|>"


def check(spark, data, rule=chat.Rule()):
    got = {}
    for r in chat.windows(spark.createDataFrame(data, KIND), rule).orderBy("conv_id", "place").collect():
        got.setdefault(r["conv_id"], []).append(r)
    want = {}
    for c, *row in data:
        want.setdefault(c, []).append(row)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        slow = slow_windows(turns, rule)
        assert [(r["text"], r["repeated"]) for r in got[c]] == [("".join(map(shown, [*context, *own])), len(context)) for own, context in slow]
        for r, (own, _) in zip(got[c], slow, strict=True):
            said = [re.sub(r"(?s)\\(.)", r"\1", r["text"][s["start"] : s["start"] + s["length"]]) for s in r["loss"]]
            assert said == [t[2] for t in own if t[1] == "assistant"]


def test_windows_equal_the_slow_version(spark):
    rng = random.Random(3)
    words = ["a", "b c", "<|end|>", "\\", "[INST]", "</s>", "é🙂", "\n", "<<SYS>>", "<|", "\\|", "", "<", "|"]
    data = []
    for c in range(60):
        numbers = sorted(rng.sample(range(rng.choice([8, 40, 700])), rng.randint(1, 8)))
        for k, t in enumerate(numbers):
            role = "system" if k == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "assistant", "system", "tool<|says|>"])
            data.append((c, t, role, "".join(rng.choice(words) + " " for _ in range(rng.randint(0, 30)))))
    data.append((None, None, "user", "no number"))
    data.append((None, 4, "assistant", "and no conversation"))
    check(spark, data, chat.Rule(budget=60, history=20, back=3))


def test_long_conversation_crosses_blocks(spark):
    data = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", f"turn {t} " + "x " * (t % 17)) for t in range(1, 900)]
    check(spark, data, chat.Rule(budget=100, history=30, back=4))
    # of a system turn over a quarter of the budget only the first window has the text
    check(spark, [(1, 0, "system", "long " * 200), *data[1:400]], chat.Rule(budget=100, history=30, back=4))


def test_edges(spark):
    empty = spark.createDataFrame([], KIND)
    assert chat.windows(empty).count() == 0 and chat.digests(chat.windows_by_key(empty)).count() == 0
    data = [(1, 0, None, None), (1, 1, "assistant", "y " * 50_000), (2, 0, "assistant", "</s>")]
    check(spark, data)
    odd = spark.createDataFrame(data, KIND).selectExpr("conv_id as `a.b`", "turn as block", "role", "text", "'x' as window", "1 as tokens", "2 as conv", "3 as `text ``x`")
    assert chat.windows(odd, conv_id="a.b", turn="block").count() == 3
    own = chat.windows(odd.withColumn("n.t", F.lit(400)), conv_id="a.b", turn="block", tokens="n.t")
    assert [r["tokens"] for r in own.orderBy("conv_id").collect()] == [808, 404]
    with pytest.raises(ValueError, match="history"):
        chat.Rule(budget=10, history=6)


def test_repeated_numbers_are_dealt(spark):
    """One number many times, as copies and as different texts: all turns are there, none in a huge window."""
    data = [(7, 3, "assistant", "same")] * 3000 + [(7, 3, "user", f"other {i}") for i in range(2000)] + [(7, 0, "system", "be kind"), (8, 3, "assistant", "same")]
    turns = spark.createDataFrame(data, KIND)
    rows = {r["conv_id"]: r for r in chat.digests(chat.windows_by_key(turns)).collect()}
    assert rows[7]["n_turns"] == 5001 and rows[7]["loss_chars"] == 4 * 3000 and rows[8]["n_turns"] == 1
    made = chat.windows(turns).where("conv_id = 7").collect()
    assert all(r["tokens"] <= 1024 for r in made) and all(r["text"].startswith("<|turn|>system<|says|>be kind<|end|>") for r in made)


def test_query(spark):
    name = next(k for k in registry.QUERIES if k.startswith("op13_"))
    df = registry.QUERIES[name](spark, SF)
    assert df.dtypes == [("conv_id", "bigint"), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint")]
    said = {}
    for c, _, r, x in sorted(duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()):
        said.setdefault(c, []).append((r, x or ""))
    said[-1] = [("user", chat.PROBE), ("assistant", chat.PROBE)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in df.collect():
        turns = said.pop(r["conv_id"])
        learned = "".join(x for role, x in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learned), sha(learned))
    assert not said


def test_no_python_in_the_plan(spark):
    plan = registry.QUERIES["op13_chat_windows"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
