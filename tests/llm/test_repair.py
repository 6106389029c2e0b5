"""Conversation repair against an exhaustive search over edits."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from kinetrace.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")


def exhaustive(turns):
    """(cost, audit, repaired) of turns (role, text): all edits, cheapest first, whole audits as tie-break."""
    seen, faults = set(), []
    for role, text in turns:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        again = (role, text) in seen
        seen.add((role, text))
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append((blank, not blank and again, not blank and not again and body[-1] not in ".!?"))
    heap = [(0, "", 0, ())]
    done = set()
    while heap:
        cost, audit, i, said = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in said)
        if i == len(turns) and LEGAL.fullmatch(initials):
            return cost, audit, list(said), faults
        state = (i, "" if not initials else initials[-1] if initials != "s" else "s1")
        if (state, audit) in done:
            continue
        done.add((state, audit))
        if cost > 3 * len(turns):
            continue
        for name in ("user", "assistant"):
            if audit[-2:] != "II":
                grown = initials + name[0]
                if any(LEGAL.fullmatch(grown + rest) for rest in ("", "a", "ua")):
                    heapq.heappush(heap, (cost + 2, audit + "I", i, (*said, (name, ""))))
        if i < len(turns):
            (role, text), (blank, dup, cut) = turns[i], faults[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, said))
            if not blank and not dup:
                for edit, name, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if name and any(LEGAL.fullmatch(initials + name[0] + rest) for rest in ("", "a", "ua")):
                        heapq.heappush(heap, (cost + price + cut, audit + edit, i + 1, (*said, (name, text))))


def random_conversation(rng):
    roles, texts = ["user", "assistant", "system", "tool", "", "umpire"], ["hi.", "what now?", "no end", "", " \t", "yes!  ", "é."]
    return [(str(rng.choice(roles, p=[0.35, 0.35, 0.12, 0.08, 0.05, 0.05])), str(rng.choice(texts))) for _ in range(int(rng.integers(0, 8)))]


@pytest.mark.parametrize("piece", [1, 3, 1 << 16])
def test_repair_against_exhaustive_search(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rng = np.random.default_rng(piece % 97)
    conversations = [random_conversation(rng) for _ in range(60)]
    rows = [(c, t, role, text, "x", 1) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string, piece int").repartition(3)
    ids = spark.createDataFrame([(c,) for c in range(60)], "conv_id long")
    got: dict = {c: {"audit": "", "said": []} for c in range(60)}
    for r in repair.repair(df, also=ids).collect():
        mine = got[r["conv_id"]]
        if r["piece"] is not None:
            mine["audit"] += r["piece"]
        elif r["at"] is not None:
            assert r["at"] == len(mine["said"])
            mine["said"].append((r["role"], r["text"]))
        elif r["edit"] is None:
            assert "cost" not in mine
            mine.update(cost=r["cost"], faults=(r["blank"], r["duplicate"], r["truncated"]))
    for c, turns in enumerate(conversations):
        cost, audit, said, faults = exhaustive(turns)
        assert (got[c]["cost"], got[c]["audit"], got[c]["said"]) == (cost, audit, said), turns
        assert got[c]["faults"] == tuple(sum(f[k] for f in faults) for k in range(3))


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if way:
            row = (conv, turn, "user" if way == 4 else role, "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text)
            yield from [row] * (2 if way == 3 else 1)


def test_digests_with_nulls_ties_and_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(c, t, *x) for c in range(40) for t, x in enumerate(random_conversation(rng))]
    rows += [(100, None, "user", "a."), (100, None, None, None), (100, 4, "assistant", "b."), (100, 9, "user", "c"), (100, 9, "user", "c"), (None, 0, "user", "q?"), (None, 1, "assistant", "a."), (101, None, "user", "z.")]
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(gone + 1000 * k, 0, "user", "x.") for k in range(1) if gone > 40 or True]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r["conv_id"]: r for r in repair.repair_digests(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        hurt = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()))
        cost, audit, said, faults = exhaustive([r[2:] for r in hurt])
        turns = [r[1] for r in hurt if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(hurt, hurt[1:], strict=False)]
        r = got[conv]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"]) == (gaps, *(sum(f[k] for f in faults) for k in range(3))), conv
        assert r["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)
        assert (r["cost"], r["audit"]) == (cost, audit)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest()
    assert repair.repair_digests(df.limit(0)).collect() == []


def test_one_long_conversation():
    """Layers repeat: 200,000 turns take a number each and few different steps."""
    layers = repair.Layers()
    now = repair.Repair(layers)
    for i in range(200_000):
        now.add(i, ("user", "assistant", "user", "system", "x")[i * i % 5], str(i).encode(), False, False, i % 7 == 0)
    rows = list(now.rows())
    assert len(rows) == 4 and all(r[4] is None for r in rows[:-1]) and len(layers.steps) < 500
    assert sum(c != "I" for r in rows for c in r[3]) == 200_000
