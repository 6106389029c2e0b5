"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words of letters in lower case (ASCII), known by 64-bit hashes; every term
of every example is indexed. A term weighs (1 + log tf) * idf * lift: document
frequencies count all documents, and lift is the squared ratio of the toxic examples
that have the term to those expected if it told nothing, both plus ``PRIOR`` (so a
rare or indifferent term has a lift near 1, and no term is left out). For the lift,
examples of one label with the same least five-word shingle count once: a term must
not look telling because one text was copied. Documents and examples are unit vectors.

The index is inverted and blocked: examples stand in blocks of ``BLOCK``, those with
the same heaviest terms together. The lists of frequent terms (in more than one of
``FREQUENT`` examples; they hold most postings) are cut into blocks, with the term's
greatest weight in each; the short lists of all other terms are read whole. A query's
bound for a block is the best sum over rare terms in it plus the weights of its frequent
terms times their block maxima; the blocks with the best bounds are opened first, then
all whose bound is not under the K-th best cosine so far, so the K nearest are exact.

The neighbours vote with their cosines. The share of toxic votes goes through a logistic
curve, fitted on the examples with themselves left out (a row that repeats with all its
repeats); documents that share no term with any example take the share of toxic examples.
The nearest examples are returned as evidence.

Defined cases: null, empty and wordless texts have no terms. Without labels of both
kinds every score is the share of label 1, or 0. Null ids are never held out. Equal
texts have equal scores. Ties between examples go to the earlier one in the index
(examples are ordered by heaviest term, then id, then text hash). Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.sampling import held_out, labelled
from kinetrace.llm.shingles import WordHashes, shingle_set, utf8
from kinetrace.storage import keep

K = 15
BLOCK = 64
#: A term is frequent if it is in more than one of so many examples.
FREQUENT = 20
#: Blocks that are opened before the others' bounds are looked at.
FIRST = 4
#: Bounds and cosines are single-precision sums; blocks this close to the K-th best are opened.
SLACK = 1e-5
#: Most labelled documents in the index.
MOST_EXAMPLES = 5_000
#: Examples that are added to both sides of a term's lift.
PRIOR = 5.0
THRESHOLD = 0.7
MODULUS, FOLD = 3, 1
#: Examples named as evidence.
EVIDENCE = 3
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Terms whose document frequencies travel together.
_SLICE = 1 << 14


class Terms(dict):
    """word -> hash of its lower case; forgets all when it has grown."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.lower())
        return h

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The distinct terms of a text, ascending, and how often each stands in it."""
        found = _TOKEN.findall(text)
        return np.unique(np.fromiter(map(self.__getitem__, found), np.uint64, len(found)), return_counts=True)


class Index:
    """The examples' weights as a blocked inverted index; made of plain arrays, which executors can read without this package."""

    def __init__(self, state: tuple) -> None:
        self.state = state
        self.vocabulary, self.weight, self.y, self.ids, self.entry, self.place, self.value, self.frequent, self.dense, self.top = state
        self.blocks = self.dense.shape[1]
        self.lists = self.dense.reshape(-1, BLOCK)

    @classmethod
    def built(cls, vocabulary: np.ndarray, weight: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, ids: np.ndarray) -> tuple[Index, np.ndarray]:
        """The index of ``examples`` (term numbers, times), each with a label and an id, and the examples' order in it."""
        vectors = [cls.unit(t, n, weight) for t, n in examples]
        size = np.array([len(t) for t, _ in examples], np.int64)
        in_examples = np.bincount(np.concatenate([t for t, _ in examples]), minlength=len(vocabulary))
        common = np.flatnonzero(in_examples * FREQUENT > len(examples))
        frequent = np.full(len(vocabulary), -1, np.int32)
        frequent[common] = np.arange(len(common))
        # examples with the same heaviest frequent term, then the same heaviest term, stand together: that makes bounds tight
        heaviest = np.full((2, len(examples)), -1, np.int64)
        for i, ((t, _), w) in enumerate(zip(examples, vectors, strict=True)):
            if len(t):
                heaviest[0, i] = t[np.argmax(w)]
                at = frequent[t] >= 0
                heaviest[1, i] = t[at][np.argmax(w[at])] if at.any() else -1
        order = np.lexsort(heaviest)
        terms, value = np.concatenate([examples[i][0] for i in order]), np.concatenate([vectors[i] for i in order])
        place = np.repeat(np.arange(len(order)), size[order])
        blocks = -(-len(order) // BLOCK)
        often = frequent[terms] >= 0
        dense = np.zeros((len(common), blocks, BLOCK), np.float32)
        dense[frequent[terms[often]], place[often] // BLOCK, place[often] % BLOCK] = value[often]
        terms, value, place = terms[~often], value[~often], place[~often]
        by_term = np.lexsort((place, terms))
        entry = np.searchsorted(terms[by_term], np.arange(len(vocabulary) + 1)).astype(np.int32)
        return cls((vocabulary, weight.astype(np.float32), y[order], ids[order], entry, place[by_term].astype(np.int32), value[by_term].astype(np.float32), frequent, dense, dense.max(axis=2))), order

    @staticmethod
    def unit(terms: np.ndarray, times: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A unit vector of TF-IDF weights."""
        w = (1 + np.log(times)) * weight[terms]
        return w / max(float(np.sqrt((w * w).sum())), 1e-300)

    def query(self, hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the terms that examples have too."""
        at = np.searchsorted(self.vocabulary, hashes)
        there = at < len(self.vocabulary)
        there[there] = self.vocabulary[at[there]] == hashes[there]
        return at[there], self.unit(at[there], times[there], self.weight)

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int = K, without: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples that share a term, best first; those at ``without`` are left out."""
        often = self.frequent[terms] >= 0
        rare, common = terms[~often], self.frequent[terms[often]]
        begin, size = self.entry[rare].astype(np.int64), (self.entry[rare + 1] - self.entry[rare]).astype(np.int64)
        at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        known = np.bincount(self.place[at], np.repeat(w[~often], size) * self.value[at], self.blocks * BLOCK).astype(float).reshape(self.blocks, BLOCK)
        for at in without:
            known[at // BLOCK, at % BLOCK] = -np.inf
        weights = w[often].astype(np.float32)
        bound = known.max(axis=1) + weights @ self.top[common]
        by_bound = np.argsort(-bound, kind="stable")
        place, cosine, least = np.empty(0, np.int64), np.empty(0), 0.0
        for some in (by_bound[:FIRST], by_bound[FIRST:]):
            some = some[(bound[some] > 0) & (bound[some] >= least - SLACK)]
            if not len(some):
                break
            lists = self.lists.take((common[:, None] * self.blocks + some).ravel(), axis=0)
            full = known[some] + (weights @ lists.reshape(len(common), len(some) * BLOCK)).reshape(-1, BLOCK)
            y, x = np.nonzero(full > max(0.0, least - SLACK))
            place, cosine = np.concatenate([place, some[y] * BLOCK + x]), np.concatenate([cosine, full[y, x]])
            best = np.lexsort((place, -np.round(cosine, 6)))[:k]
            place, cosine = place[best], cosine[best]
            if len(cosine) == k:
                least = cosine[-1]
        return place, cosine

    def features(self, hashes: np.ndarray, times: np.ndarray, without: tuple[int, ...] = ()) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """The share of toxic votes (None without neighbours), then the neighbours and their cosines."""
        place, cosine = self.nearest(*self.query(hashes, times), without=without)
        vote = np.array([(cosine * self.y[place]).sum() / cosine.sum()]) if len(place) else None
        return vote, place, cosine


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b)), x.T @ (y - p) - 0.1 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def lift(toxic: np.ndarray, all_: np.ndarray, share: float) -> np.ndarray:
    """How much more often a term is in toxic examples than expected, squared."""
    return np.square((toxic + PRIOR) / (all_ * share + PRIOR))


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each term of ``vocabulary`` is, and the number of documents. Tasks' counts are added slice by slice."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = Terms(), shared.value
        total = np.zeros(len(known) + 1, np.int32)
        for batch in batches:
            for text in utf8(batch.column(0)):
                h, _ = memo.of(text)
                at = np.searchsorted(known, h)
                at = at[at < len(known)]
                total[at[known[at] == h[: len(at)]]] += 1
                total[-1] += 1
        slices = [(i // _SLICE, total[i : i + _SLICE]) for i in range(0, len(total), _SLICE)] if total[-1] else []
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in slices], pa.int32()), pa.array([x.tobytes() for _, x in slices], pa.binary())], ["slice", "counts"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in table.column("counts"))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": [total.tobytes()]})

    schema = "slice int, counts binary"
    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, schema).groupBy("slice").applyInArrow(added, schema).collect()  # as long as the vocabulary
    total = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows:
        total[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.frombuffer(r["counts"], np.int64)
    shared.destroy()
    return total[:-1], int(total[-1])


def examples_of(sample: DataFrame) -> list[tuple]:
    """(doc_id, y, text hash, alike, terms, times) of every labelled row, in an order that doesn't depend on tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, words = Terms(), WordHashes()
        for batch in batches:
            found = [(t, *memo.of(t)) for t in utf8(batch.column(0))]
            alike = [int(s[0].view(np.int64)) if len(s := shingle_set(t, words)) else 0 for t, _, _ in found]
            hashes = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _, _ in found]
            columns = [pa.array(hashes, pa.int64()), pa.array(alike, pa.int64()), *[pa.array([f[i].astype(kind).tobytes() for f in found], pa.binary()) for i, kind in ((1, "<u8"), (2, "<i4"))]]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), *columns], ["doc_id", "y", "h", "alike", "terms", "times"])

    rows = sample.mapInArrow(run, "doc_id long, y int, h long, alike long, terms binary, times binary").collect()  # a bounded sample
    return sorted((r["doc_id"], r["y"], r["h"], r["alike"], np.frombuffer(r["terms"], "<u8"), np.frombuffer(r["times"], "<i4")) for r in rows) if rows else []


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES) -> tuple[Broadcast | None, np.ndarray | None, float]:
    """The index's state, sent out, and the curve (None without labels of both kinds), and the share of toxic examples."""
    sample = keep(labelled(docs, labels, "toxic", MODULUS, FOLD, most), "examples")
    examples = examples_of(sample)
    y = np.array([e[1] for e in examples], float)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < y.sum() < len(y):
        return None, None, share
    vocabulary = np.unique(np.concatenate([e[4] for e in examples]))
    if not len(vocabulary):
        return None, None, share
    numbered = [(np.searchsorted(vocabulary, e[4]), e[5]) for e in examples]
    once = {(e[3], e[1]): i for i, e in enumerate(examples)}.values()
    seen = np.zeros((2, len(vocabulary)))
    for i in once:
        seen[int(y[i]), numbered[i][0]] += 1
    frequency, n = document_frequencies(docs, vocabulary)
    weight = (np.log((1 + n) / (1 + frequency)) + 1) * lift(seen[1], seen.sum(axis=0), sum(y[i] for i in once) / len(once))
    index, order = Index.built(vocabulary, weight, numbered, y, np.array([e[0] for e in examples], np.int64))
    places: dict[tuple, tuple[int, ...]] = {}
    for at, i in enumerate(order.tolist()):
        known = examples[i][0], examples[i][2]
        places[known] = (*places.get(known, ()), at)
    shared = docs.sparkSession.sparkContext.broadcast((index.state, places))

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, places = shared.value
        index, memo = Index(state), Terms()
        for batch in batches:
            rows = []
            for text, y, doc in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x, _, _ = index.features(*memo.of(text), without=places[doc, xxhash.xxh3_64_intdigest(text) - (1 << 63)])
                if x is not None:
                    rows.append((*x.tolist(), float(y)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.float64()) for c in (zip(*rows, strict=True) if rows else [()] * 2)], ["vote", "y"])

    rows = sorted(tuple(r) for r in sample.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(left_out, "vote double, y double").collect())
    if not rows:
        return None, None, share
    x = np.array(rows)
    return shared, curve(x[:, :1], x[:, 1]), share


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every document; evidence: id, label and cosine of the nearest examples."""
    shared, b, share = fitted(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = Index(shared.value[0]) if shared else None, Terms()
        named = pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())])
        for batch in batches:
            scores, evidence = [], []
            for text in utf8(batch.column(1)):
                x, place, cosine = index.features(*memo.of(text)) if index else (None, (), ())
                scores.append(share if x is None else float(1 / (1 + np.exp(-np.clip(b[0] + b[1:] @ x, -30, 30)))))
                evidence.append([{"doc_id": int(index.ids[p]), "label": int(index.y[p]), "cosine": float(c)} for p, c in zip(place[:EVIDENCE], cosine[:EVIDENCE], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(named))], ["doc_id", "score", "evidence"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, label: int, cosine: double>>")
    return out.select("doc_id", held_out(MODULUS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
