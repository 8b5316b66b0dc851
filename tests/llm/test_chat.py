import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string, at string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def conversations(seed=1):
    rng = random.Random(seed)
    bits = ["hello ", "<|im_end|>", "<|", "<\\|", "\\", "<\\\\|x", "é🙂", "\n", "<|im_start|>assistant<|im_sep|>", "word " * 50]
    rows = []
    for c in range(25):
        roles = (["system"] if c % 2 else []) + [rng.choice(["user", "assistant", "tool\n<|im_sep|>"]) for _ in range(rng.randint(1, 30))]
        rows += [(c, t, r, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for t, r in enumerate(roles)]
    return [*rows, (100, 0, None, None), (100, 0, None, None), (101, None, "assistant", "no turn"), (None, 1, "assistant", "no id"), (102, 0, "assistant", "y" * 9000), (102, 1, "assistant", "z")]


def key(r):
    return (r[1] is not None, r[1], r[2] or "", r[3] or "")


@pytest.mark.parametrize("budget, history", [(1024, 2), (64, 3), (200, 0)])
def test_turns_and_targets_come_back(spark, budget, history):
    rows = conversations()
    out = chat.windows(frame(spark, rows), budget, history)
    read = {}
    for r in chat.read_turns(out).orderBy("conv_id", "window").collect():
        turns, loss = read.setdefault(r["conv_id"], ([], []))
        turns += [tuple(t) for t in r["turns"]]
        loss += r["loss"]
    want = {c: sorted((r for r in rows if r[0] == c), key=key) for c in {r[0] for r in rows}}
    assert {c: t for c, (t, _) in read.items()} == {c: [(r[2] or "", r[3] or "") for r in own] for c, own in want.items()}
    assert {c: x for c, (_, x) in read.items()} == {c: [r[3] or "" for r in own if r[2] == "assistant"] for c, own in want.items()}


def cost(text):
    return -(-len(text.encode()) // 4) + 4


def told(w):
    """(role, text) of all turns of a window, repeated ones first."""
    return [(chat_unescape(p.split(chat.SEP)[0].removeprefix(chat.START)), chat_unescape(p.split(chat.SEP, 1)[1])) for p in w["formatted"].split(chat.END)[:-1]]


def chat_unescape(t):
    return re.sub(r"<\\\\(\\\\*)\|", r"<\1|", t)


@pytest.mark.parametrize("budget, history", [(256, 2), (64, 3), (1024, 2), (200, 0)])
def test_whole_windows_keep_the_budget(spark, budget, history):
    rng = random.Random(7)
    rows = []
    for c in range(30):  # system turns from short to over the budget, turns from short to far over it
        opening = [(c, 0, "system", "s" * rng.choice([10, 400, 2000, 6000]))] if c % 3 else []
        rows += opening + [(c, i, rng.choice(["user", "assistant"]), f"{i} " + "w" * rng.choice([5, 50, 150, 900, 4000])) for i in range(1, 40)]
    by = {}
    for w in chat.windows(frame(spark, rows), budget, history).orderBy("conv_id", "window").collect():
        by.setdefault(w["conv_id"], []).append(w)
    for c, out in by.items():
        turns = [(r[2], r[3]) for r in rows if r[0] == c]
        system = turns[:1] if turns[0][0] == "system" else []
        at = 0
        for w in out:
            got, n = told(w), w["n_repeated"]
            own = got[n:]
            assert w["units"] == sum(cost(t) for _, t in got) and own == turns[at : at + len(own)]
            assert w["units"] <= budget or len([x for x in own if x not in system]) == 1 and n <= len(system)
            before = got[:n]
            if at and system:
                assert before[:1] == system
                before = before[1:]
            assert before == turns[at - len(before) : at] and len(before) <= history  # the nearest turns, in order
            nxt = at - len(before) - 1  # one more would not have fitted
            if len(before) < history and nxt >= len(system):
                assert w["units"] + cost(turns[nxt][1]) > budget
            masked = "".join(w["formatted"][t["start"] : t["start"] + t["size"]] for t in w["targets"])
            assert masked == "".join(t for r, t in own if r == "assistant")
            at += len(own)
        assert at == len(turns)
    if history:
        assert any(w["n_repeated"] > 1 for out in by.values() for w in out)


def test_a_very_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} of many") for i in range(3000)] + [(2, 0, "user", "x" * 3_000_000), (2, 1, "assistant", "y<|" * 300_000)]
    got = chat.windows(frame(spark, rows)).groupBy("conv_id").agg(F.sum(F.col("n_turns") - F.col("n_repeated")).alias("n"), F.max("units").alias("most")).collect()
    assert {r["conv_id"]: r["n"] for r in got} == {1: 3000, 2: 2} and max(r["most"] for r in got if r["conv_id"] == 1) <= chat.BUDGET


def test_escapes_are_reversible(spark):
    texts = ["", "<|", "<\\|", "<\\\\|", "a<|b<||<\\|", "<<|", "\\<|\\", "<|im_end|>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("*", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(r["t"] == r["u"] and "<|" not in r["e"] for r in rows)


def test_no_conversations(spark):
    assert chat.read_turns(chat.windows(frame(spark, []))).collect() == []


def test_no_python_on_the_executors(spark):
    plan = chat.op7_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("arrow", "")
