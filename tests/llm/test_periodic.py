"""Periodic runs against a plain search, in one window and in many."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.llm import periodic


def plain_runs(x, least=6, turns=4):
    """Every maximal stretch of each period, unless a smaller period holds in it."""
    n, out = len(x), []
    for q in range(1, n // turns + 1):
        i = 0
        while i < n - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            a, b = i, j + q
            if b - a >= max(least, turns * q) and not any(x[a : b - d] == x[a + d : b] for d in range(1, q)):
                out.append((a, b - a, q))
            i = j
    return sorted(out)


def random_words(rng):
    n = int(rng.integers(0, 150))
    x = rng.integers(0, int(rng.integers(1, 5)), n).tolist()
    for _ in range(int(rng.integers(0, 4))):
        if n > 10:
            a, p, k = int(rng.integers(0, n - 5)), int(rng.integers(1, 12)), int(rng.integers(4, 60))
            x = (x[:a] + (x[a : a + p] * 30)[:k] + x[a + k :])[:n]
    return x


@pytest.mark.parametrize("first_lag", [1, 2, 3, 1024])
def test_runs_against_a_plain_search(first_lag):
    rng = np.random.default_rng(first_lag)
    for _ in range(300):
        x = random_words(rng)
        assert periodic.runs(np.array(x, np.int64), first_lag=first_lag) == plain_runs(x)


def test_lag_counts_of_frequent_and_rare_words():
    rng = np.random.default_rng(7)
    p = 1 / np.arange(1, 301)
    x = rng.choice(300, 3000, p=p / p.sum())
    for width, most in ((3000, 700), (1000, 300)):
        got = periodic.lag_counts(x[: width + most], width, most)
        want = [0] + [sum(x[i] == x[i + q] for i in range(width) if i + q < len(x[: width + most])) for q in range(1, 40)]
        assert got[:40].tolist() == want


def test_long_texts():
    """300,000 words with runs of large periods, planted; and one word only."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 50_000, 300_000)
    for at, period, length in ((1000, 9000, 36_000), (100_000, 30_000, 125_000), (250_000, 3, 40)):
        x[at : at + length] = np.resize(x[at : at + period], length)
    got = periodic.runs(x)
    assert [(a, p) for a, _, p in got] == [(1000, 9000), (100_000, 30_000), (250_000, 3)] and [n for _, n, _ in got][1:] == [125_000, 40]
    assert periodic.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def test_a_short_last_window_with_a_frequent_word(spark):
    """Texts a little longer than a window, whose rest is one word or two in turn: the rest has fewer words than there are lags."""
    for rest in (65, 128, 129, 200, 256, 257, 512, 513):
        for period in (1, 2, 3):
            x = np.concatenate((np.arange(16_384) + 3, np.resize(np.arange(period), rest)))
            assert periodic.runs(x) == [(16_384, rest, period)]
    counts = periodic.lag_counts(np.zeros(100, np.int64), 100, 1024)
    assert counts.tolist() == [0, *range(99, 0, -1), *[0] * 925]
    docs = spark.createDataFrame([(1, " ".join([f"w{i}" for i in range(16_384)] + ["|", "x"] * 100)), (2, "so it goes")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in periodic.run_digests(docs).collect()}
    assert tuple(rows[1])[1:7] == (16_584, 1, 16_384, 200, 2, 100_000) and rows[2]["n_runs"] == 0


TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a a a a a a"), (6, "a b a b a b a b c c c c c c c"), (7, "x y z " * 4 + "x y"), (8, "the end of it . " * 50),
    (None, "b b b b b b b"), (None, None), (6, "a b a b a b a b c c c c c c c"), (12, "é😀 é😀 é😀 é😀 é😀 é😀 é😀   q"), (14, " ".join(f"w{i % 37}" for i in range(500))),
]


def test_digests_against_a_plain_search(spark):
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0][:20]
    texts = TEXTS + [(i, " ".join(f"v{j * j % 97}" for j in range(i % 300))) for i in ids]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in texts], "doc_id long, text string, n_runs int, words string").repartition(3)

    def told(doc_id, text):
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        n = len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        gone = {i for a, k, q in found for i in range(a + q, a + k)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        listed = "".join("{},{},{}\n".format(*r) for r in found)
        return doc_id, n, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()

    got = sorted((tuple(r) for r in periodic.run_digests(docs).collect()), key=str)
    assert got == sorted((told(*t) for t in texts), key=str)
    assert any(r[2] for r in got if r[0] in ids)
    assert periodic.run_digests(docs.limit(0)).collect() == []


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "so so so so so so it goes"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in periodic.periodic_runs(docs).collect()}
    assert rows[1]["collapsed"] == "so it goes" and [tuple(r) for r in rows[1]["runs"]] == [(0, 6, 1)]
    assert (rows[2]["n_words"], rows[2]["runs"], rows[2]["collapsed"]) == (0, [], "")


def test_a_row_group_is_dealt_to_many_tasks(spark, tmp_path):
    """One row group, with ids and without, is one task's scan but many tasks' work; rows that repeat stay."""
    texts = [(i if i % 2 else None, f"w{i} go go go go go go {i}") for i in range(200)] + [(5, "w5 go go go go go go 5")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for told in (periodic.run_digests(docs), periodic.periodic_runs(docs)):
        rows = told.withColumn("task", F.spark_partition_id()).collect()
        assert len(rows) == 201 and sum(r["doc_id"] is None for r in rows) == 100 and sum(r["doc_id"] == 5 for r in rows) == 2
        for some in ([r for r in rows if r["doc_id"] is None], [r for r in rows if r["doc_id"] is not None]):
            assert len({r["task"] for r in some}) > 1
