import random

import numpy as np
import pytest

from docquarry.llm import chat


def slowly(tokens, system, budget, turns, history):
    """Windows by trying every history and every end."""
    out, at = [], 0
    while at < len(tokens):
        first = at
        for h in range(max(0, at - turns), at + 1):
            past = sum(tokens[h:at])
            if h == at or past <= history and system + past + tokens[at] <= budget:
                first = h
                break
        end = at + 1
        while end < len(tokens) and system + sum(tokens[first : end + 1]) <= budget:
            end += 1
        out.append((first, at, end))
        at = end
    return out


@pytest.mark.parametrize("seed", range(20))
def test_spans_against_brute_force(seed):
    rng = random.Random(seed)
    tokens = [rng.choice([0, 1, 5, 30, 90, 300]) for _ in range(rng.randint(0, 40))]
    system = rng.choice([0, 7, 120, 400])
    assert chat.spans(np.array(tokens, np.int64), system) == slowly(tokens, system, chat.BUDGET, chat.HISTORY_TURNS, chat.HISTORY_TOKENS)


@pytest.mark.parametrize("held", [0, 300, 5000])
def test_a_long_conversation_in_pieces(spark, monkeypatch, held):
    """Windows don't depend on when turns are let go; few turns are held."""
    rng = random.Random(held)
    turns = [(i, rng.choice(["user", "assistant", "system"]), "w " * rng.choice([0, 1, 5, 30, 90, 300])) for i in range(400)]
    rows = [(c, i, r, t) for c in (1, 2) for i, r, t in turns[: 400 if c == 1 else 3]] + [(3, 0, "system", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    expected = sorted(map(tuple, chat.format_chats(df).collect()))
    name, most = chat.Conversation(1, chat.BUDGET, chat.HISTORY_TURNS, chat.HISTORY_TOKENS), 0
    monkeypatch.setattr(chat, "HELD_BYTES", held)
    name.lead = next((r, t, len(t.split())) for _, r, t in turns if r == "system")
    got = []
    for _, r, t in turns:
        got += name.add(r, t, len(t.split()))
        most = max(most, len(name.turns))
    got += name.windows(last=True)
    assert got == [r for r in expected if r[0] == 1] and len(got) > 20
    assert most < (40 if held < 1000 else 200)


def test_targets_once_and_repeats_masked(spark):
    turns = [("system", "be kind")] + [("user" if i % 2 == 0 else "assistant", f"turn{i} " * 60) for i in range(12)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn int, role string, text string")
    rows = sorted(chat.format_chats(df).collect(), key=lambda r: r["window"])
    learnt = [r["text"][int(a) : int(b)] for r in rows for a, b in (s.split(":") for s in r["loss_spans"].split(",") if s)]
    assert learnt == [t + "<|end|>" for r, t in turns if r == "assistant"]
    assert all(r["text"].startswith("<|system|>\nbe kind<|end|>\n") and r["n_tokens"] <= chat.BUDGET for r in rows)
    assert any(r["n_repeated"] for r in rows)


def test_messy_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, 1, "user", "lost"), (2, 0, "system", "alone"), (3, 0, "assistant", "w " * 50_000), (3, 0, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 as window", "2 as turns", "3 as n_tokens")
    got = {(r["conv_id"], r["window"]): r for r in chat.format_chats(df).collect()}
    assert got[1, 0]["text"] == "<|user|>\nhi<|end|>\n" * 2 + "<|unknown|>\n<|end|>\n"
    assert got[2, 0]["n_new"] == 0 and got[2, 0]["loss_spans"] == ""
    assert got[3, 0]["over_budget"] and got[3, 0]["n_tokens"] == 50_000
    assert {k[0] for k in got} == {1, 2, 3} and chat.format_chats(df.limit(0)).count() == 0
