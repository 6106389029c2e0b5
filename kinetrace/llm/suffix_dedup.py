"""Repeated passages by a prefix-free parse of the corpus.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere
else: such strings are neighbours in the suffix order of the corpus with a common
prefix of LENGTH bytes or more. The order comes from the orders of the dictionary and
of the parse, and only where texts repeat:

* Parse. A rolling hash of ``GRAM`` bytes triggers at a position that is the least
  (rightmost on ties) among the ``REACH`` grams from some start; every start belongs to
  its trigger, and the starts of one trigger are the suffixes of one phrase. Which
  trigger a start has depends on the string of LENGTH bytes from it alone, so equal
  strings are in phrases of equal triggers: phrases never match in part, at any
  distance, in any document. (A fixed threshold for triggers has no such guarantee.)
* Dictionary. A phrase with what its strings cover behind it is known by 128 bits of two
  hashes. Phrases whose look-ahead is unique in the corpus (LENGTH - REACH + 1 bytes from
  the trigger, common to all their strings) hold no repeat; phrases found twice as a
  whole hold nothing else.
* Order. Where the look-ahead repeats but the phrase doesn't (the first and last phrase
  of a repeated passage), the phrases' bytes meet by look-ahead. Their beginnings, up to
  the trigger, are put in the order of the dictionary's suffixes (sorted from the trigger
  backwards), and what follows the trigger in the order of the parse's suffixes, each
  with the common lengths of neighbours. A string that starts d bytes before the trigger
  repeats if another phrase is within d bytes in the first order and LENGTH - d in the
  second: both are runs of neighbours, so the answer is exact, on the bytes themselves.
* Hot look-aheads. A look-ahead of more than ``HOT`` different phrases (a passage that a
  good part of all documents share) doesn't meet in one place: each of its strings goes
  by itself, by 128 bits of hashes, after equal ones of a task have been merged.

Entries travel as packed arrays, a few for each task and bucket, after equal phrases
of a task have been merged, so a passage that a third of all documents share is sent
once per task. There are as many buckets as the corpus has parts of ``PART`` bytes.
Long texts are parsed in slices.

Texts are known by 96 bits of hashes of id and text, so repeated rows and null ids do
no harm. Defined cases: a null text is empty; texts under LENGTH bytes keep all.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.llm.shingles import mixed, utf8
from kinetrace.storage import keep

LENGTH = 200
GRAM = 16
#: Grams from a start among which its trigger is, a power of two.
REACH = 128
#: Different phrases of one look-ahead that still meet in one place.
HOT = 20_000
#: Bytes of the corpus for each bucket.
PART = 32 << 20
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
#: A phrase: hashes of its look-ahead and of the whole, its text, its first start, last start and trigger from there, and if it stands for several.
_PHRASE = np.dtype([("ahead", "u8"), ("whole", "u8"), ("whole2", "u8"), ("k1", "i8"), ("k2", "i4"), ("s", "i4"), ("run", "u1"), ("off", "u1"), ("many", "u1")])
_RUN = np.dtype([("k1", "i8"), ("k2", "i4"), ("s", "i4"), ("e", "i4")])
#: A phrase with its bytes from REACH - 1 before the trigger on (zero where it hasn't any), and if it is known to repeat.
_BYTES = np.dtype([("k1", "i8"), ("k2", "i4"), ("s", "i4"), ("run", "u1"), ("off", "u1"), ("known", "u1"), ("data", "u1", REACH - 1 + LENGTH)])
#: A suffix: hashes of its string, its text and start, and if it is known to repeat.
_SUFFIX = np.dtype([("string", "u8"), ("string2", "u8"), ("k1", "i8"), ("k2", "i4"), ("i", "i4"), ("known", "u1")])


class Rolling:
    """Hashes of any substring of a byte array in constant time: mixed polynomials modulo 2^64."""

    def __init__(self) -> None:
        self.value = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
        self.inverse = pow(_BASE, -1, 2**64)
        self.up = self.down = np.ones(1, _U)

    def read(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(self.up) < n:
            for name, step in (("up", _BASE), ("down", self.inverse)):
                powers = np.full(2 * n, step, _U)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        self.sums = np.zeros(n, _U)
        np.cumsum(self.value[data] * self.up[: n - 1], out=self.sums[1:])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        """Of all substrings of one length, in order."""
        return mixed((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])


def chunks(texts: list[bytes], least: int = _CHUNK) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Runs of texts joined: their numbers, their bytes, their ends. Texts too short to repeat are left out; a long one stands alone."""
    at: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if len(t) >= least:
            yield [i], np.frombuffer(t, np.uint8), np.array([len(t)])
            continue
        at.append(i)
        size += len(t)
        if size >= least:
            yield at, np.frombuffer(b"".join([texts[j] for j in at]), np.uint8), np.cumsum([len(texts[j]) for j in at])
            at, size = [], 0
    if at:
        yield at, np.frombuffer(b"".join([texts[j] for j in at]), np.uint8), np.cumsum([len(texts[j]) for j in at])


def slices(data: np.ndarray, ends: np.ndarray, roll: Rolling) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First starts, last starts and triggers of the phrases of some joined texts, a bounded slice of starts at a time with its offset; no phrase is cut."""
    begin = 0
    while len(data) - begin >= LENGTH:
        part = data[begin : begin + 2 * _CHUNK + LENGTH]
        whole = begin + len(part) == len(data)
        roll.read(part)
        trigger = triggers(roll, len(part))
        start = np.arange(len(trigger)) + begin
        inside = start + LENGTH <= ends[np.searchsorted(ends, start, side="right")]
        change = trigger[1:] != trigger[:-1]
        first = np.flatnonzero(inside & np.concatenate([[True], change | ~inside[:-1]]))
        last = np.flatnonzero(inside & np.concatenate([change | ~inside[1:], [True]]))
        if not whole:  # the last phrase may go on: it begins the next slice
            again = first[-1] if len(first) and last[-1] == len(trigger) - 1 else len(trigger)
            first, last = first[first < again], last[last < again]
            yield begin, first, last, trigger
            begin += int(again)
        else:
            yield begin, first, last, trigger
            break


def triggers(roll: Rolling, n: int) -> np.ndarray:
    """The trigger of every start in ``n`` bytes: a position, rightmost least of REACH grams."""
    grams = roll.every(GRAM)
    least = (grams & _U(0xFFFFFFFF00000000)) | (_U(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
    step = 1
    while step < REACH:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return (_U(0xFFFFFFFF) - (least & _U(0xFFFFFFFF))).astype(np.int64)[: n - LENGTH + 1]


def parse(texts: list[bytes], k1: np.ndarray, k2: np.ndarray, roll: Rolling) -> np.ndarray:
    """All phrases of the texts."""
    found = [np.empty(0, _PHRASE)]
    for at, data, ends in chunks(texts):
        begins = np.concatenate([[0], ends[:-1]])
        raw = data.data
        for base, first, last, trigger in slices(data, ends, roll):
            t = trigger[first]
            out = np.empty(len(first), _PHRASE)
            out["ahead"] = roll.at(t, LENGTH - REACH + 1)
            out["whole"] = roll.at(first, last - first + LENGTH) ^ ((t - first) * 256 + last - first).astype(np.uint64)
            out["whole2"] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((first + base).tolist(), (last + base + LENGTH).tolist(), strict=True)]
            text = np.searchsorted(ends, first + base, side="right")
            number = np.asarray(at)[text]
            out["k1"], out["k2"] = k1[number], k2[number]
            out["s"] = first + base - begins[text]
            out["run"], out["off"], out["many"] = last - first, t - first, 0
            found.append(out)
    return np.concatenate(found)


def _equal_runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each entry is in; the keys are sorted."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _joined(runs: np.ndarray) -> np.ndarray:
    """Runs of starts of the same text that touch, made one."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs["s"], runs["k2"], runs["k1"]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs["k1"][1:] != runs["k1"][:-1]) | (runs["k2"][1:] != runs["k2"][:-1]) | (runs["s"][1:] > runs["e"][:-1] + 1)
    out = runs[new].copy()
    out["e"] = np.maximum.reduceat(runs["e"], np.flatnonzero(new))
    return out


def _as_runs(p: np.ndarray) -> np.ndarray:
    out = np.empty(len(p), _RUN)
    for c in ("k1", "k2", "s"):
        out[c] = p[c]
    out["e"] = p["s"] + p["run"]
    return out


def _blobs(entries: np.ndarray, bucket: np.ndarray, extra: list[tuple[int, np.ndarray]] = ()) -> pa.RecordBatch:
    """A row for each bucket with entries: (bucket, packed entries)."""
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*cuts[1:], len(entries)][: len(cuts)]
    rows = [(int(bucket[a]), entries[a:b].tobytes()) for a, b in zip(cuts, ends, strict=True)] + [(b, x.tobytes()) for b, x in extra if len(x)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])


def _unpacked(table: pa.Table, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column("blob")), dtype)


def _runs_table(runs: np.ndarray, kind: int | np.ndarray, bucket: int = 0, off: np.ndarray | None = None) -> pa.Table:
    n = len(runs)
    return pa.table({
        "k1": pa.array(runs["k1"]), "k2": pa.array(runs["k2"]), "kind": pa.array(np.broadcast_to(kind, n).astype(np.int32)), "s": pa.array(runs["s"]), "e": pa.array(runs["e"]),
        "off": pa.array(np.zeros(n, np.int32) if off is None else off.astype(np.int32)), "home": pa.array(np.full(n, bucket, np.int32)),
    })


_RUNS = "k1 long, k2 int, kind int, s int, e int, off int, home int"
#: Kinds of rows: starts that repeat; phrases to be ordered, and those known to repeat that they are ordered among; the same of a hot look-ahead.
REPEATS, OPEN, KNOWN, HOT_OPEN, HOT_KNOWN = range(5)


def _parsed(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        for batch in batches:
            texts = list(utf8(batch.column(2)))
            p = parse(texts, batch.column(0).to_numpy(), batch.column(1).to_numpy(), roll)
            p = p[np.lexsort((p["whole2"], p["whole"], p["ahead"]))]
            g = _equal_runs(p["whole2"], p["whole"], p["ahead"])
            size = np.bincount(g) if len(g) else np.empty(0, np.int64)
            again = size[g] > 1
            lead = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else again
            sent = p[lead].copy()
            sent["many"] = size > 1
            repeats = _joined(_as_runs(p[again]))
            # what is settled here only has to reach the end: any bucket of the second kind will do
            parts = np.array_split(repeats, 4) if len(repeats) else []
            extra = [(buckets + int(len(texts) * 7 + i) % buckets, x) for i, x in enumerate(parts)]
            yield _blobs(sent, (sent["ahead"] % _U(buckets)).astype(np.int64), extra)

    return run


def _settled(buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:
            return _runs_table(_joined(_unpacked(table, _RUN)), REPEATS)
        p = _unpacked(table, _PHRASE)
        p = p[np.lexsort((p["whole2"], p["whole"], p["ahead"]))]
        ahead, whole = _equal_runs(p["ahead"]), _equal_runs(p["whole2"], p["whole"], p["ahead"])
        weight = 1 + p["many"].astype(np.int64)
        n_ahead, n_whole = np.bincount(ahead, weight)[ahead], np.bincount(whole, weight)[whole]
        lead = np.concatenate([[True], whole[1:] != whole[:-1]])
        open_ = (n_ahead > 1) & (n_whole == 1)
        with_open = np.bincount(ahead, open_)[ahead] > 0
        repeats, known = (n_whole > 1) & (p["many"] == 0), with_open & (n_whole > 1) & lead
        hot = 2 * (np.bincount(ahead, lead)[ahead] > HOT)
        return pa.concat_tables([
            _runs_table(_joined(_as_runs(p[repeats])), REPEATS),
            _runs_table(_as_runs(p[open_]), (OPEN + hot)[open_], key[0].as_py(), p["off"][open_]),
            _runs_table(_as_runs(p[known]), (KNOWN + hot)[known], key[0].as_py(), p["off"][known]),
        ])

    return run


def _common(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before, from the front."""
    different = rows[1:] != rows[:-1]
    return np.concatenate([[0], np.where(different.any(axis=1), different.argmax(axis=1), rows.shape[1])])


def _order(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def repeated_strings(x: np.ndarray) -> np.ndarray:
    """Of phrases with bytes, the (phrase, start) pairs [n, 2] of open ones whose string another phrase has too.

    Zero bytes past what a phrase has never count: a string lies within its phrase's bytes.
    """
    if len(x) < 2:
        return np.empty((0, 2), np.int64)
    back, ahead = x["data"][:, REACH - 2 :: -1], x["data"][:, REACH - 1 :]
    parse, dictionary = _order(ahead), _order(back)
    common_ahead, common_back = _common(ahead[parse]), _common(back[dictionary])
    out = []
    in_parse, in_dictionary = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for d in range(REACH):
        there = (x["off"] >= d) & (x["off"].astype(int) - x["run"] <= d)
        if there.sum() < 2:
            continue
        in_parse[parse], in_dictionary[dictionary] = np.cumsum(common_ahead < LENGTH - d), np.cumsum(common_back < d)
        at = np.flatnonzero(there)
        key = in_parse[at] * (len(x) + 1) + in_dictionary[at]
        by_key = np.argsort(key, kind="stable")
        g = _equal_runs(key[by_key])
        again = at[by_key[np.bincount(g)[g] > 1]]
        again = again[x["known"][again] == 0]
        out.append(np.column_stack([again, x["s"][again].astype(np.int64) + x["off"][again] - d]))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _phrases_and_suffixes(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bytes of the wanted phrases to their home bucket; strings of hot ones to a bucket of their own (beyond ``buckets``), equal ones merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            phrases, homes, suffixes = [np.empty(0, _BYTES)], [np.empty(0, np.int64)], [np.empty(0, _SUFFIX)]
            for row, text in enumerate(utf8(batch.column(2))):
                kind, s, e, off, home = (y.to_numpy() for y in batch.column(3)[row].values.flatten())
                cold = np.flatnonzero(kind <= KNOWN)
                out = np.zeros(len(cold), _BYTES)
                out["k1"], out["k2"], out["s"], out["run"], out["off"], out["known"] = k1[row], k2[row], s[cold], e[cold] - s[cold], off[cold], kind[cold] == KNOWN
                for j, (a, b, o) in enumerate(zip(s[cold].tolist(), e[cold].tolist(), off[cold].tolist(), strict=True)):
                    data = np.frombuffer(text, np.uint8, b + LENGTH - a, a)
                    out["data"][j, REACH - 1 - o : REACH - 1 - o + len(data)] = data
                phrases.append(out)
                homes.append(home[cold].astype(np.int64))
                for j in np.flatnonzero(kind > KNOWN).tolist():
                    i = np.arange(s[j], e[j] + 1)
                    out = np.empty(len(i), _SUFFIX)
                    strings = [xxhash.xxh3_128_intdigest(text[a : a + LENGTH]) for a in i.tolist()]
                    out["string"], out["string2"] = [x & (2**64 - 1) for x in strings], [x >> 64 for x in strings]
                    out["k1"], out["k2"], out["i"], out["known"] = k1[row], k2[row], i, kind[j] == HOT_KNOWN
                    suffixes.append(out)
            yield _blobs(np.concatenate(phrases), np.concatenate(homes))
            x = np.concatenate(suffixes)
            if len(x):
                # one of equal strings is sent for all, as known; the others' repeats are settled
                x = x[np.lexsort((x["known"], x["string2"], x["string"]))]
                g = _equal_runs(x["string2"], x["string"])
                again = np.bincount(g)[g] > 1
                lead = np.concatenate([[True], g[1:] != g[:-1]])
                sent, settled = x[lead].copy(), _suffix_runs(x[again & (x["known"] == 0)])
                sent["known"] |= again[lead]
                yield _blobs(sent, buckets + (sent["string"] % _U(buckets)).astype(np.int64))
                parts = np.array_split(_joined(settled), 4)
                yield _blobs(np.empty(0, _RUN), np.empty(0, np.int64), [(2 * buckets + (int(k1[0]) + i) % buckets, part) for i, part in enumerate(parts)])

    return run


def _suffix_runs(x: np.ndarray) -> np.ndarray:
    runs = np.empty(len(x), _RUN)
    for a, b in (("k1", "k1"), ("k2", "k2"), ("s", "i"), ("e", "i")):
        runs[a] = x[b]
    return runs


def _ordered(buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket >= 2 * buckets:
            return _runs_table(_joined(_unpacked(table, _RUN)), REPEATS)
        if bucket >= buckets:
            x = _unpacked(table, _SUFFIX)
            x = x[np.lexsort((x["string2"], x["string"]))]
            g = _equal_runs(x["string2"], x["string"])
            return _runs_table(_joined(_suffix_runs(x[(np.bincount(g)[g] > 1) & (x["known"] == 0)])), REPEATS)
        x = _unpacked(table, _BYTES)
        pairs = repeated_strings(x)
        runs = np.empty(len(pairs), _RUN)
        runs["k1"], runs["k2"], runs["s"], runs["e"] = x["k1"][pairs[:, 0]], x["k2"][pairs[:, 0]], pairs[:, 1], pairs[:, 1]
        return _runs_table(_joined(runs), REPEATS)

    return run


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64("doc_id", text).alias("k1"), F.hash("doc_id", text).alias("k2"), text.alias("text"), *columns)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(k1, k2, s, e): for each text the runs of starts whose string of LENGTH bytes starts anywhere else too."""
    spark = docs.sparkSession
    texts = _keyed(docs)
    size = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    blobs = texts.mapInArrow(_parsed(buckets), "bucket int, blob binary")
    settled = keep(blobs.groupBy("bucket").applyInArrow(_settled(buckets), _RUNS), "phrases")
    wanted = settled.where(F.col("kind") != REPEATS).groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "s", "e", "off", "home")).alias("wanted"))
    entries = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(_phrases_and_suffixes(buckets), "bucket int, blob binary")
    ordered = entries.groupBy("bucket").applyInArrow(_ordered(buckets), _RUNS)
    return settled.where(F.col("kind") == REPEATS).union(ordered).select("k1", "k2", "s", "e")


def spans(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """The maximal byte ranges that strings starting in the runs s to e cover."""
    if not len(s):
        return []
    order = np.argsort(s, kind="stable")
    s, e = s[order].astype(np.int64), np.maximum.accumulate(e[order].astype(np.int64)) + LENGTH
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return list(zip(s[new].tolist(), e[[*(new[1:] - 1), len(e) - 1]].tolist(), strict=True))


def with_spans(docs: DataFrame, *columns: str) -> DataFrame:
    """text and the given columns of every row, and ``runs``, its starts of repeated strings (null without any)."""
    runs = repeated_starts(docs).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    return _keyed(docs, *columns).join(runs, ["k1", "k2"], "left").select(*columns, "text", "runs")


def _row_spans(batch: pa.RecordBatch, column: int) -> Iterator[list[tuple[int, int]]]:
    for x in batch.column(column):
        yield spans(*(y.to_numpy() for y in x.values.flatten())) if x.is_valid else []


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per document its bytes, the bytes and spans removed, and the SHA-256 of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, cut in zip(utf8(batch.column(1)), _row_spans(batch, 2), strict=True):
                digest, at = hashlib.sha256(), 0
                for a, b in cut:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                rows.append((len(text), sum(b - a for a, b in cut), len(cut), digest.hexdigest()))
            n, removed, k, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n, removed, k)], pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_spans(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts; a character that is cut in part goes, n_chars follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = []
            for text, cut in zip(utf8(batch.column(1)), _row_spans(batch, 2), strict=True):
                parts, at = [], 0
                for a, b in [*cut, (len(text), len(text))]:
                    parts.append(text[at:a].decode("utf-8", "ignore"))
                    at = b
                left.append("".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], names)

    columns = docs.columns
    rows = with_spans(docs.select(F.struct(*[c for c in columns if c not in ("text", "n_chars")]).alias("_rest"), "text", "doc_id"), "_rest").select("_rest", "text", "runs")
    names = ["_rest", "_left"]
    cut = rows.mapInArrow(run, T.StructType([rows.schema["_rest"], T.StructField("_left", T.StringType())]))
    put = {"text": F.col("_left"), "n_chars": F.length("_left").cast("long")}
    return cut.select(*[put.get(c, F.col(f"_rest.{c}")).alias(c) for c in columns])
