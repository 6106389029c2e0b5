"""Periodic runs of words: heavy and light lag counting, then island scans of the lags that can hold a run.

A run of period q and at least ``least`` words (and ``turns`` * q) has a stretch of
word pairs (i, i + q) that are equal, so a lag with fewer equal pairs than that
stretch is long can't have a run. Pairs are counted for all lags at once: words that
are frequent in a window by autocorrelation of their indicator (an FFT; counts are
rounded to whole numbers, which is exact for windows of less than 10^8 words), rare
ones by the differences of their positions. Only lags with enough pairs are scanned.

Long texts are counted in windows that grow with the lags, four times from class to
class, so the pairs of a lag are only looked for within 16 times the class's largest
lag. Of a stretch that two windows share one has half, which is the windows' threshold.

Lags go upwards. Pairs that a run of period p makes equal for a multiple of p are
taken off the counts and left out of the scans: a stretch that such a run covers has
the smaller period p, and by the periodicity lemma no other stretch is touched.

Defined cases: a null or blank text has no words and no run; a null doc_id leaves the
text as it is. Rows that repeat are rows of their own. Extra columns are ignored.
A text is held whole in a worker, as its row is; nothing else grows with the table.
Rows are dealt to all shuffle partitions by id and text, since a row group of the input
is else one task, that keeps it in memory for as long as numpy takes for all its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.shingles import utf8
from kinetrace.llm.words import WORD, sql_crc32

#: A run has at least so many words, and so many times its period.
LEAST, TURNS = 6, 4
#: The largest lag of the first class; windows have SPAN times their class's largest lag.
FIRST_LAG, SPAN = 1024, 16


def lag_counts(ids: np.ndarray, width: int, most: int) -> np.ndarray:
    """Equal pairs (i, i + q) with i < width, at place q for each lag q of 0..most (0 at place 0)."""
    counts = np.zeros(most + 1, np.int64)
    if most < 1 or len(ids) < 2:
        return counts
    size = 1 << int(len(ids) + width - 1).bit_length()
    heavy = max(64.0, np.sqrt(size * np.log2(size)))
    order = np.argsort(ids, kind="stable")
    word = ids[order]
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    n = np.diff(np.append(first, len(ids)))
    frequent = n > heavy
    total = None
    for begin, k in zip(first[frequent].tolist(), n[frequent].tolist(), strict=True):
        at = order[begin : begin + k]
        whole = np.zeros(size)
        whole[at] = 1.0
        b = np.fft.rfft(whole)
        if at[-1] >= width:
            whole[width:] = 0.0
            a = np.fft.rfft(whole)
        else:
            a = b
        total = a.conj() * b if total is None else total + a.conj() * b
    if total is not None:
        some = min(most + 1, len(ids))  # no pairs of larger lags; a short last window's transform can have fewer places than most + 1
        counts[:some] += np.rint(np.fft.irfft(total, size)[:some]).astype(np.int64)
    last = np.repeat(first + n - 1, n)  # the place of each word's last one
    places = np.flatnonzero((order < width) & (np.repeat(n, n) > 1) & ~np.repeat(frequent, n))
    step = 1
    while len(places):
        places = places[places + step <= last[places]]
        lags = order[places + step] - order[places]
        near = lags <= most
        counts += np.bincount(lags[near], minlength=most + 1)
        places = places[near]
        step += 1
    counts[0] = 0
    return counts


class _Runs:
    """The runs of one text so far, as (first, stop, period)."""

    def __init__(self) -> None:
        self.found: list[tuple[int, int, int]] = []

    def covered(self, lag: int, begin: int, stop: int) -> Iterator[tuple[int, int]]:
        """Where pairs of this lag are equal because of a run of a period that divides it."""
        for a, b, p in self.found:
            if lag % p == 0 and b - a > lag and a < stop and b - lag > begin:
                yield max(a, begin), min(b - lag, stop)


def runs(ids: np.ndarray, least: int = LEAST, turns: int = TURNS, first_lag: int = FIRST_LAG) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of whole numbers, by start, then period."""
    n, known, low = len(ids), _Runs(), 0
    longest = n // turns
    while low < longest and n >= least:
        high = min(max(first_lag, low * 4), longest)
        width = SPAN * high if n > SPAN * high else n
        starts = range(0, n, width)
        counts = np.stack([lag_counts(ids[s : s + width + high], min(width, n - s), high) for s in starts])
        lags = np.arange(high + 1)
        need = np.maximum(least - lags, (turns - 1) * lags)
        enough = need if len(starts) == 1 else (need + 1) // 2
        counts[:, : low + 1] = 0

        def explained(run: tuple[int, int, int], counts: np.ndarray = counts, low: int = low, high: int = high, width: int = width) -> None:
            a, b, p = run
            multiples = np.arange(max(2, low // p + 1) * p, min(high, b - a) + 1, p)
            if len(multiples):
                for w in range(a // width, (b - 1) // width + 1):
                    counts[w, multiples] -= np.maximum(np.minimum(b - multiples, (w + 1) * width) - max(a, w * width), 0)

        for run in known.found:
            explained(run)
        enough[0] = n + 1
        for lag in np.flatnonzero((counts >= enough).any(axis=0)).tolist():
            passing = np.flatnonzero(counts[:, lag] >= enough[lag]).tolist()  # again: runs found meanwhile are taken off
            ranges: list[list[int]] = []
            for w in passing:
                begin, stop = max(w - 1, 0) * width, min((w + 2) * width, n - lag)
                if ranges and begin <= ranges[-1][1]:
                    ranges[-1][1] = stop
                else:
                    ranges.append([begin, stop])
            for begin, stop in ranges:
                same = np.zeros(stop - begin + 2, np.int8)
                same[1:-1] = ids[begin:stop] == ids[begin + lag : stop + lag]
                for a, b in known.covered(lag, begin, stop):
                    same[a - begin + 1 : b - begin + 1] = 0
                edges = np.flatnonzero(np.diff(same))
                long = edges[1::2] - edges[::2] >= need[lag]
                for a, b in zip((edges[::2][long] + begin).tolist(), (edges[1::2][long] + begin + lag).tolist(), strict=True):
                    known.found.append((a, b, lag))
                    explained((a, b, lag))
        low = high
    return sorted((a, b - a, p) for a, b, p in known.found)


def numbered(words: Iterable[bytes]) -> np.ndarray:
    """A number for every word, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def looped(words: list[bytes], h: int | None) -> list[bytes]:
    """The words from a place on replaced by a loop of the first of them, for a tenth of the hashes."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def kept_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run has after its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    gone = np.cumsum(depth)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def periodic_runs(docs: DataFrame, least: int = LEAST, turns: int = TURNS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of whole texts: every run as (start, length, period), and the words without what repeats."""
    return _scanned(docs, least, turns, edited=False)


def run_digests(docs: DataFrame, least: int = LEAST, turns: int = TURNS) -> DataFrame:
    """The runs of every whole text after :func:`looped`: their number, the longest, and hashes of all of them and of the collapsed text."""
    return _scanned(docs, least, turns, edited=True)


def _scanned(docs: DataFrame, least: int, turns: int, edited: bool) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.crc32(doc_id.cast("string").cast("binary")).alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", F.xxhash64("text"))
    numbers = ["n_words", "n_runs", "start", "length", "period", "exponent_milli"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, text in zip(batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                words = text.split()
                words = looped(words, h) if edited else words
                found = runs(numbered(words), least, turns)
                collapsed = b" ".join(kept_words(words, found))
                if not edited:
                    out.append((len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], collapsed.decode("utf-8", "replace")))
                    continue
                best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                listed = "".join(f"{a},{n},{p}\n" for a, n, p in found).encode()
                longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                out.append((len(words), len(found), *longest, hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [()] * (8 if edited else 3)
            if edited:
                types, names = [pa.int64()] * 6 + [pa.string()] * 2, [*numbers, "runs_sha256", "collapsed_sha256"]
            else:
                run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
                types, names = [pa.int64(), pa.list_(run), pa.string()], ["n_words", "runs", "collapsed"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", *names])

    if edited:
        return rows.mapInArrow(told, f"doc_id long, {', '.join(f'{c} long' for c in numbers)}, runs_sha256 string, collapsed_sha256 string")
    return rows.mapInArrow(told, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def oracle_sql() -> str:
    """Every pair of equal words, islands of each lag, runs that no run of a smaller period covers."""
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, {sql_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents
), cut AS (
  SELECT k, doc_id, w, len(w) AS n, coalesce(h % 10 = 0 AND len(w) > 0, false) AS looped, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM texts
), edited AS (
  SELECT k, doc_id, n, CASE WHEN looped THEN list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[CAST(a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1 AS BIGINT)] ELSE w[i + 1] END) ELSE w END AS w FROM cut
), placed AS (
  SELECT k, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM edited
), pairs AS (
  SELECT x.k, x.i, y.i - x.i AS q FROM placed x JOIN placed y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // {TURNS}
), numbered AS (
  SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM pairs
), candidates AS (
  SELECT k, q, min(i) AS a, max(i) + q + 1 AS b FROM numbered GROUP BY k, q, island HAVING count(*) + q >= greatest({LEAST}, {TURNS} * q)
), runs AS (
  SELECT c.k, c.q, c.a, c.b FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates d WHERE d.k = c.k AND d.q < c.q AND d.a <= c.a AND d.b >= c.b)
), told AS (
  SELECT k, count(*) AS n_runs, arg_max(struct_pack(a := a, b := b, q := q), (b - a, -a, -q)) AS best, string_agg(concat(a, ',', b - a, ',', q, chr(10)), '' ORDER BY a, q) AS listed FROM runs GROUP BY k
), gone AS (
  SELECT DISTINCT k, unnest(range(a + q, b)) AS i FROM runs
), kept AS (
  SELECT p.k, string_agg(p.word, ' ' ORDER BY p.i) AS collapsed FROM placed p LEFT JOIN gone g ON g.k = p.k AND g.i = p.i WHERE g.i IS NULL GROUP BY p.k
)
SELECT e.doc_id, e.n AS n_words, coalesce(t.n_runs, 0) AS n_runs, t.best.a AS start, t.best.b - t.best.a AS length, t.best.q AS period,
  1000 * (t.best.b - t.best.a) // t.best.q AS exponent_milli, sha256(coalesce(t.listed, '')) AS runs_sha256, sha256(coalesce(c.collapsed, '')) AS collapsed_sha256
FROM edited e LEFT JOIN told t ON t.k = e.k LEFT JOIN kept c ON c.k = e.k"""
