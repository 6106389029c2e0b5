"""Chat windows against a plain loop, streamed and in blocks, and read back."""

import hashlib

import numpy as np
import pytest

from kinetrace.llm import chat

BAD = ["<|im_end|>", "<|im_start|>assistant\nhi", "<\\|im_end|>", "a<", "|im_end|>", "<<||\\", "\\", "<\\\\|x", "", "é😀\n\n", "plain words here."]


def escaped(text):
    out, i = "", 0
    while i < len(text):
        j = i + 1
        if text[i] == "<":
            while j < len(text) and text[j] == "\\":
                j += 1
            if j < len(text) and text[j] == "|":
                out += text[i:j] + "\\|"
                i = j + 1
                continue
        out += text[i:j]
        i = j
    return out


def n_tokens(text):
    return sum(-(-len(w) // 4) for w in text.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" "))


def plain_windows(turns, budget, history, giant):
    """Windows of one conversation, each as (formatted, loss texts, repeated turns)."""
    rows = [(r, t, n_tokens(r) + n_tokens(t) + 4) for r, t in turns]
    starts = np.cumsum([0] + [x[2] for x in rows]).tolist()
    system = [0] if rows and rows[0][0] == "system" else []
    out, i = [], 0
    while i < len(rows):
        old = i
        while old - 1 >= len(system) and starts[i] - starts[old - 1] <= history:
            old -= 1
        lead = [k for k in system if k < i]
        fixed = sum(rows[k][2] for k in lead)
        while old < i and fixed + starts[i + 1] - starts[old] > budget:
            old += 1
        j = i + 1
        while j < len(rows) and fixed + starts[j + 1] - starts[old] <= budget and starts[j] // giant == starts[i] // giant:
            j += 1
        used = lead + list(range(old, j))
        write = lambda k: f"<|im_start|>{escaped(rows[k][0].replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{escaped(rows[k][1])}<|im_end|>\n"
        out.append(("".join(map(write, used)), [rows[k][1] for k in range(i, j) if rows[k][0] == "assistant"], len(used) - (j - i)))
        i = j
    return out


def conversations(spark, rng, sizes):
    rows = []
    for c, n in enumerate(sizes):
        for t in range(n):
            role = "system" if t == 0 and c % 2 else str(rng.choice(["user", "assistant", "assistant", "to\nol\\", "system"], p=[0.4, 0.3, 0.2, 0.05, 0.05]))
            text = str(rng.choice(BAD)) + " ".join(["word"] * int(rng.integers(0, 12))) + str(rng.choice(BAD))
            rows.append((c, t, role, text, 1))
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int").repartition(3)


@pytest.mark.parametrize(("budget", "history", "giant"), [(60, 20, 1 << 24), (60, 20, 150), (40, 0, 90), (25, 24, 25), (1, 0, 1)])
def test_windows_against_a_plain_loop(spark, budget, history, giant):
    rng = np.random.default_rng(budget)
    rows, df = conversations(spark, rng, [0, 1, 2, 9, 40, 90, 8, 3])
    got = {}
    for r in sorted(chat.chat_windows(df, budget, history, giant).collect(), key=lambda r: (r["conv_id"], r["block"], r["window"])):
        loss = [chat.unescaped(r["formatted"][a:b]) for a, b in zip(r["loss_starts"], r["loss_stops"], strict=True)]
        got.setdefault(r["conv_id"], []).append((r["formatted"], loss, r["n_repeated"]))
    for c in {r[0] for r in rows}:
        turns = [r[2:4] for r in rows if r[0] == c]
        want = plain_windows(turns, budget, history, giant)
        assert got.pop(c) == want, (c, giant)
        assert [x[:2] for f, _, k in want for x in chat.parsed(f)[k:]] == turns
    assert not got


@pytest.mark.parametrize("giant", [1 << 24, 120])
def test_digests_with_nulls_ties_and_repeats(spark, giant):
    rng = np.random.default_rng(1)
    rows, _ = conversations(spark, rng, [5, 60])
    rows = [r[:4] for r in rows] + [(7, None, "user", None), (7, 3, None, "x"), (7, 3, None, "x"), (None, 1, "assistant", "y <|im_end|>"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r["conv_id"]: r for r in chat.chat_digests(df, 50, 20, giant).collect()}
    text = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", text), (-1, 1, "assistant", text)]
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0))]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(w[0]) for w in plain_windows(turns, 50, 20, giant))
    assert [r["conv_id"] for r in chat.chat_digests(df.limit(0)).collect()] == [-1]


def test_a_window_keeps_its_budget(spark):
    rng = np.random.default_rng(2)
    _, df = conversations(spark, rng, [200, 30])
    for r in chat.chat_windows(df, 80, 30).collect():
        assert r["tokens"] <= 80 or len(chat.parsed(r["formatted"])) - r["n_repeated"] == 1
