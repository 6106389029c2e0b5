"""Near-duplicates by min-max hashing, banding and an exact check.

Signatures: each of ``PERMUTATIONS`` random permutations of the 64-bit shingle hashes
gives two values, the least and the greatest shingle under it, so a signature of 2 P
values takes P evaluations. A band is the two values of two permutations.
Two sets of similarity J share a band with a probability of about J^4; with 40 bands a
pair at J = 0.75 is missed once in 4 million times (sets of three or four shingles,
where minimum and maximum lean on each other: once in 100,000).

Links: equal sets are one node from the start. A bucket's members are compared with a
pivot, not with each other, and every comparison is exact, on the full sets. Where a
bucket still holds several components, two more pivots are tried against the members
outside their component; what can then still be a link, by rare first shingles and
positions, is compared pair by pair. So no link between buckets' members is lost, and a
group of many copies takes about as many comparisons as it has members.

Defined cases: a null text, an empty one and one without words have an empty set and
no links. A null id has no links, a null component and is kept. Rows that repeat an
id and text are one node and stay or go together; rows of one id with different texts
share that node's links, besides the copies of their own text. Extra columns are ignored. Empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.components import components
from kinetrace.llm.shingles import WordHashes, mixed, shingle_set, utf8
from kinetrace.storage import keep

PERMUTATIONS = 80
#: A link needs 100 * intersection >= LEAST * union.
LEAST = 75
SEED = 17
_BLOCK = 2048


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The keys of all bands of a set: one for each two permutations."""
    low, high = np.full(len(by), np.iinfo(np.uint64).max), np.zeros(len(by), np.uint64)
    for i in range(0, len(shingles), _BLOCK):
        under = by[:, None] * shingles[None, i : i + _BLOCK]
        np.minimum(low, under.min(axis=1), out=low)
        np.maximum(high, under.max(axis=1), out=high)
    key = mixed(low[::2] + np.arange(len(by) // 2, dtype=np.uint64))
    for values in (high[::2], low[1::2], high[1::2]):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values)
    return key.view(np.int64)


def signatures(docs: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands): equal sets have equal k1, k2; empty sets have no bands."""
    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, by = WordHashes(), _multipliers(permutations)
        for batch in batches:
            rows: list[tuple] = []
            for text in utf8(batch.column(1)):
                s = shingle_set(text, memo)
                k1, k2 = s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(s), dtype=np.uint64)
                rows.append((len(s), int(k1.view(np.int64)), int(np.uint64(k2).view(np.int64)), band_keys(s, by) if len(s) else np.empty(0, np.int64)))
            n, k1, k2, bands = zip(*rows, strict=True) if rows else ((), (), (), ())
            ends = np.cumsum([0, *map(len, bands)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*bands, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), lists], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with shared and joint, the sizes of the sets' intersection and union."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last, set_a = WordHashes(), None, None
        for batch in batches:
            shared, joint = [], []
            for a, b in zip(utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                if a != last:
                    last, set_a = a, shingle_set(a, memo)
                set_b = shingle_set(b, memo)
                n = len(np.intersect1d(set_a, set_b, assume_unique=True))
                shared.append(n)
                joint.append(len(set_a) + len(set_b) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(joint, pa.int64())], ["a", "b", "shared", "joint"])

    return both.mapInArrow(run, "a long, b long, shared long, joint long")


def _linked(df: DataFrame) -> DataFrame:
    return df.where(100 * F.col("shared") >= LEAST * F.col("joint")).select("a", "b")


def near_duplicates(docs: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    sig = keep(signatures(docs, permutations), "signatures")
    linkable = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    equal = keep(linkable.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "equal-sets")
    # every node once: the first of each group of equal sets
    s, e = linkable.alias("s"), equal.alias("e")
    same = (F.col("s.k1") == F.col("e.k1")) & (F.col("s.k2") == F.col("e.k2")) & (F.col("s.n_shingles") == F.col("e.n_shingles"))
    nodes = s.join(e, same, "left").where("e.first IS NULL OR e.first = s.doc_id").select("s.doc_id", "s.n_shingles", "s.bands")
    rows = nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).where("members > 1 ")
    members = keep(rows.join(buckets, "band").select("band", "pivot", "members", "node", "n"), "buckets")

    pairs = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = keep(_linked(compared(pairs, docs)), "links")
    labels = components(links)

    # buckets of two are settled; in larger ones other pivots see links that the first did not:
    # the member that meets most others, then one by chance
    for central in (True, False):
        open_ = _unsettled(members, labels)
        if not open_.head(1):
            break
        if central:
            meets = open_.groupBy("node").agg(F.sum("members").alias("meets"))
            ranked = open_.join(meets, "node").withColumn("rank", F.struct("meets", "node"))
        else:
            ranked = open_.withColumn("rank", F.struct(F.xxhash64("node"), F.col("node")))
        pivots = ranked.groupBy("band").agg(F.max(F.struct("rank", "node", "label")).alias("p")).select("band", F.col("p.node").alias("pivot2"), F.col("p.label").alias("label2"))
        again = open_.join(pivots, "band").where("label <> label2").select(F.least("node", "pivot2").alias("a"), F.greatest("node", "pivot2").alias("b")).distinct()
        found = keep(_linked(compared(again, docs)), "links")
        if found.head(1):
            links = links.union(found)
            labels = components(links)
    open_ = _unsettled(members, labels)
    if open_.head(1):
        found = keep(_linked(compared(_possible(open_, docs), docs)), "links")
        if found.head(1):
            labels = components(links.union(found))

    d = sig.select("doc_id", "n_shingles", "k1", "k2").alias("s")
    grouped = d.join(equal.alias("e"), same & F.col("s.doc_id").isNotNull(), "left").select("s.doc_id", "s.n_shingles", F.coalesce("e.first", "s.doc_id").alias("node"))
    out = grouped.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets of three or more that hold several components."""
    named = members.where("members > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_ = named.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("band")
    return keep(named.join(mixed_, "band", "left_semi"), "unsettled")


def _possible(open_: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): all pairs of different components among these nodes that can be links, by prefix and position.

    With shingles ordered from rare to frequent, two sets of similarity J share one of
    the first n - ceil(J n) + 1 of each, and from the first that they share on, each
    must have as many left as the intersection needs. A text that was edited in many
    places begins with shingles of its own, and falls out.
    """
    nodes = open_.select("node", "label", "n").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, memo).view(np.int64) for t in utf8(batch.column(3))]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["node", "label", "n", "s"])

    sets = keep(texts.join(nodes, "node").select("node", "label", "n", "text").mapInArrow(run, "node long, label long, n long, s array<long>"), "open-sets")
    rows = sets.select("node", "label", "n", F.explode("s").alias("g"))
    seen = rows.groupBy("g").agg(F.count("*").alias("seen")).where("seen > 1")
    shared = rows.join(seen, "g").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("seen", "g"))).alias("s"))
    own = F.col("n") - F.size("s")
    length = F.col("n") - F.expr(f"({LEAST} * n + 99) div 100") + 1
    prefix = keep(
        shared.where(length > own).select("node", "label", "n", own.alias("own"), F.posexplode(F.slice("s", F.lit(1), (length - own).cast("int"))).alias("i", "x"))
        .select("node", "label", "n", (F.col("n") - F.col("own") - F.col("i")).alias("left"), F.col("x.g").alias("g")), "prefixes",
    )
    # pairs within the most common component of a shingle are never formed
    most = prefix.groupBy("g", "label").agg(F.count("*").alias("k")).groupBy("g").agg(F.max_by("label", F.struct("k", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    mixed_ = prefix.join(most, "g")
    x, y = mixed_.where("label <> top").alias("x"), mixed_.alias("y")
    need = F.expr(f"({LEAST} * (x.n + y.n) + {LEAST + 99}) div {LEAST + 100}")
    fit = (100 * F.col("x.n") >= LEAST * F.col("y.n")) & (100 * F.col("y.n") >= LEAST * F.col("x.n")) & (F.least("x.left", "y.left") >= need)
    pairs = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.label") != F.col("y.label")) & fit)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without those that a near-duplicate of a smaller id stands for."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id").cast("long") == F.col("g.doc_id"), "left_anti")


def oracle_sql() -> str:
    """DuckDB SQL for the rows of :func:`near_duplicates` over ``documents``: all pairs that share a shingle."""
    return r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared WHERE 100 * k >= 75 * (na + nb - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.m, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(c.m, s.doc_id)) AS kept
FROM s LEFT JOIN c ON c.a = s.doc_id"""
