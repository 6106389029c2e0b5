"""Quality classifier: random-indexing word vectors, pooled, in a two-layer network.

Words are runs of letters, of digits or of symbols, hashed to ``BUCKETS`` rows. Random
indexing over the whole corpus: each row has a sparse random index vector (``ONES``
entries of +1 or -1 in ``WIDTH``), and a word's vector is the sum of its neighbours'
index vectors, scaled to length one. Partial sums of the tasks are added up block by
block, in two levels, so no reducer has more than a bounded slice.

A document is the mean and the spread of its word vectors, with its length and the
share of distinct words. The network (one hidden layer, numpy, Adam) is fitted on a
bounded sample of labelled documents; a fifth of them is kept aside to set the
temperature that calibrates its probabilities.

Defined cases: null, empty and wordless texts have the zero vector and a score like any
other. Without labels of both kinds every score is the share of label 1, or 0.5.
Null ids are never held out. Repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.llm.sampling import MOST_LABELLED, held_out, labelled
from kinetrace.llm.shingles import utf8

BUCKETS, WIDTH, ONES = 1 << 15, 32, 4
BLOCKS = 64
THRESHOLD = 0.7
HIDDEN = 24
#: Fold of the labels that nothing is learnt from.
MODULUS, FOLD = 4, 2
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
_SLICE = 1 << 16


class Words(dict):
    """token -> row; words in capitals are one row, numbers another."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        first = token[:1]
        word = b"<UP>" if len(token) > 1 and token.isupper() else b"<NUM>" if first.isdigit() else token.lower()
        self[token] = row = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return row


def rows_of(texts: Iterator[bytes], memo: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word rows of some texts at a time, and the ends of the texts among them."""
    parts: list[np.ndarray] = []
    size = 0
    for t in texts:
        found = _TOKEN.findall(t)
        parts.append(np.fromiter(map(memo.__getitem__, found), np.int32, len(found)))
        size += len(found)
        if size >= _SLICE:
            yield np.concatenate(parts), np.cumsum([len(p) for p in parts])
            parts, size = [], 0
    if parts:
        yield np.concatenate(parts), np.cumsum([len(p) for p in parts])


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every row's index vector."""
    rng = np.random.default_rng(11)
    return np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :ONES].astype(np.int64), rng.choice([-1.0, 1.0], (BUCKETS, ONES))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The word vectors of the corpus, [BUCKETS, WIDTH], of length one (rows never seen are zero)."""
    rows = BUCKETS // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (place, sign) = Words(), index_vectors()
        total = np.zeros(BUCKETS * WIDTH)
        for batch in batches:
            for ids, ends in rows_of(utf8(batch.column(0)), memo):
                pair = np.ones(max(len(ids) - 1, 0), bool)
                inner = ends[:-1]
                pair[inner[(inner > 0) & (inner < len(ids))] - 1] = False
                a, b = ids[:-1][pair], ids[1:][pair]
                for word, other in ((a, b), (b, a)):
                    total += np.bincount((word.astype(np.int64)[:, None] * WIDTH + place[other]).ravel(), sign[other].ravel(), BUCKETS * WIDTH)
        part = TaskContext.get().partitionId() >> 7
        blocks = total.reshape(BLOCKS, rows * WIDTH)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(BLOCKS, part, np.int32)), pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([b.tobytes() for b in blocks])], ["part", "block", "sums"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table({"part": pa.array([0], pa.int32()), "block": pa.array([key[0].as_py()], pa.int32()), "sums": [total.tobytes()]})

    schema = "part int, block int, sums binary"
    partial = docs.select(F.col("text").cast("string")).mapInArrow(run, schema)
    blocks = partial.groupBy("block", "part").applyInArrow(added, schema).groupBy("block").applyInArrow(added, schema).collect()
    out = np.zeros((BUCKETS, WIDTH))
    for r in blocks:  # BLOCKS rows of a fixed size
        out[r["block"] * rows : (r["block"] + 1) * rows] = np.frombuffer(r["sums"]).reshape(rows, WIDTH)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(length, 1e-9)).astype(np.float32)


def pooled(texts: Iterator[bytes], vectors: np.ndarray, memo: Words) -> Iterator[np.ndarray]:
    """Feature rows of some texts at a time."""
    for ids, ends in rows_of(texts, memo):
        n = np.diff(ends, prepend=0)
        full = np.flatnonzero(n)
        out = np.zeros((len(n), 2 * WIDTH + 2), np.float32)
        if len(full):
            begin = (ends - n)[full]
            v = vectors[ids]
            mean = np.add.reduceat(v, begin, axis=0) / n[full, None]
            np.multiply(v, v, out=v)
            spread = np.sqrt(np.maximum(np.add.reduceat(v, begin, axis=0) / n[full, None] - mean * mean, 0))
            text = np.repeat(np.arange(len(n)), n)
            different = np.unique(text * BUCKETS + ids) // BUCKETS
            out[full, :WIDTH], out[full, WIDTH : 2 * WIDTH] = mean, spread
            out[:, -2] = np.log1p(n) / 10
            out[full, -1] = np.bincount(different, minlength=len(n))[full] / n[full]
        yield out


class Network:
    """Two layers and a temperature; fitted in a few seconds on the driver."""

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        keep, aside = order[len(x) // 5 :], order[: len(x) // 5]
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        self.p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        m, v, t = [0 * w for w in self.p], [0 * w for w in self.p], 0
        for epoch in range(epochs):
            rate = 0.01 * (1 - epoch / epochs)
            for part in np.array_split(rng.permutation(keep), max(1, len(keep) // 256)):
                h = np.tanh(z[part] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y[part]) / len(part)
                dh = d[:, None] * self.p[2] * (1 - h * h)
                grads = [z[part].T @ dh + 1e-4 * self.p[0], dh.sum(axis=0), h.T @ d + 1e-4 * self.p[2], d.sum(keepdims=True)]
                t += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(aside):
            logits, target = self.logits(x[aside]), y[aside]
            tries = np.geomspace(0.25, 8, 41)
            self.temperature = float(tries[np.argmin([np.mean(np.logaddexp(0, logits / t) - target * logits / t) for t in tries])])
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def constant(self, y: np.ndarray) -> Network:
        """What is left to say without labels of both kinds: their share, or 0.5, for every row."""
        share = np.clip(y.mean() if len(y) else 0.5, 1e-9, 1 - 1e-9)
        self.mean, self.scale, self.temperature = np.zeros(2 * WIDTH + 2), np.ones(2 * WIDTH + 2), 1.0
        self.p = [np.zeros((2 * WIDTH + 2, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(share / (1 - share))])]
        return self

    def state(self) -> tuple:
        """Plain arrays and numbers, which executors can read without this package."""
        return self.mean, self.scale, self.temperature, self.p

    @classmethod
    def of(cls, state: tuple) -> Network:
        model = cls()
        model.mean, model.scale, model.temperature, model.p = state
        return model


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[np.ndarray, Network]:
    """Word vectors of the whole corpus, and the network fitted on at most ``most`` labelled documents."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            x = [r.astype("<f4").tobytes() for part in pooled(utf8(batch.column(0)), shared.value, memo) for r in part]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], ["x", "y"])

    rows = labelled(docs, labels, "quality", MODULUS, FOLD, most).select("text", "y").mapInArrow(features, "x binary, y int").collect()
    rows = sorted((r["x"], r["y"]) for r in rows)  # the order of the tasks doesn't matter
    x = np.array([np.frombuffer(r[0], "<f4") for r in rows], float).reshape(len(rows), 2 * WIDTH + 2)
    y = np.array([r[1] for r in rows], float)
    model = Network().fit(x, y) if 0 < y.sum() < len(y) else Network().constant(y)
    return vectors, model


def scored(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...], most: int = MOST_LABELLED) -> DataFrame:
    """(row, score): the columns in ``carry`` as a struct, and the score, of every row of ``docs``. A text that is carried is sent once."""
    vectors, model = fitted(docs, labels, most)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model.state()))
    inside = carry.index("text") if "text" in carry else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (vectors, state) = Words(), shared.value
        model = Network.of(state)
        for batch in batches:
            texts = batch.column(1) if inside is None else batch.column(0).field(inside)
            scores = [model.probability(x.astype(float)) for x in pooled(utf8(texts), vectors, memo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*scores, np.empty(0)]), pa.float64())], ["row", "score"])

    own = [] if inside is not None else [F.col("text").cast("string").alias("text")]
    rows = docs.select(F.struct(*carry).alias("row"), *own)
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = scored(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels, ("doc_id",)).select("row.doc_id", "score")
    return out.select("doc_id", held_out(MODULUS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    return scored(docs, labels, tuple(docs.columns)).where(F.col("score") >= THRESHOLD).select("row.*")
