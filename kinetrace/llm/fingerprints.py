"""Document fingerprints by winnowing.

The words of a text give k-gram hashes; of every window of w neighbouring hashes the
least is chosen, the rightmost on ties, with its position. Any run of k + w - 1 words
that two texts share is sure to give them a common chosen hash. A text with fewer
words is one gram, or one window; without words its fingerprint is empty.

The window minimum is found by doubling: hash and position are packed in one long so
that least() prefers small hashes and then large positions, and minima over 1, 2, 4,
... neighbours follow from each other in log2(w) passes.

The next document of each is found without a global sort: ids are dealt into ranges
by quantiles, each range is ordered by itself, and the first document of a range is
copied behind the range before it. Only the ranges' heads (one id for each shuffle
partition) are sent around.

Defined cases: a null text is empty. Null ids come last. Equal ids follow each other by
the text's hash. One document alone is its own next. Two empty fingerprints have
likeness 1, an empty and another 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.llm.words import words

K = 5
#: Hashes in a window, a power of two.
WINDOW = 8


def chosen(docs: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``out``: the chosen hashes as longs ``hash << 32 | 2^31 - 1 - position``, in text order."""
    df = docs.withColumn("_w", words(F.col(text))).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    later = "".join(f", get(_h, i + {j})" for j in range(1, k))
    packed = f"shiftleft(xxhash64(h{later}) & 2147483647L, 32) | (2147483647L - i)"
    df = df.withColumn("_p", F.expr(f"transform(slice(_h, 1, CASE WHEN size(_h) = 0 THEN 0 ELSE greatest(size(_h) - {k - 1}, 1) END), (h, i) -> {packed})")).drop("_w", "_h")
    df = df.withColumn("_p", F.expr(f"CASE WHEN size(_p) BETWEEN 1 AND {window - 1} THEN array(array_min(_p)) ELSE _p END"))  # one window, not a full one
    step = 1
    while step < window:
        df = df.withColumn("_p", F.expr(f"transform(slice(_p, 1, CASE WHEN size(_p) = 0 THEN 0 ELSE greatest(size(_p) - {step}, 1) END), (p, i) -> least(p, get(_p, i + {step})))"))
        step *= 2
    return df.withColumn(out, F.array_distinct("_p")).drop("_p")


def hashes(packed: Column) -> Column:
    """The set of hashes in a fingerprint, in the order in which they first stand in the text."""
    return F.array_distinct(F.transform(packed, lambda p: F.shiftright(p, 32)))


def positions(packed: Column) -> Column:
    """The word positions of a fingerprint's grams."""
    return F.transform(packed, lambda p: (F.lit(2147483647) - p.bitwiseAND(F.lit(4294967295))).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared.cast("double") / union)


def spelled(h: Column) -> Column:
    """A fingerprint as a string: hexadecimal hashes in text order."""
    return F.array_join(F.transform(h, lambda x: F.lower(F.hex(x))), " ")


def with_next(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` for every carried column c: that of the next document, ids descending, round the end."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    quantiles = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"] if parts > 1 else None
    edges = sorted(set(quantiles or []))
    every = max(1, round(len(edges) ** 0.5))
    coarse, fine = F.array(*[F.lit(x).cast("long") for x in edges[::every]]), F.array(*[F.lit(x).cast("long") for x in edges])
    if edges:  # two short searches instead of one long one
        below = F.size(F.filter(coarse, lambda e: e < F.col("doc_id")))
        near = F.slice(fine, F.greatest(below - 1, F.lit(0)) * every + 1, every)
        at = F.greatest(below - 1, F.lit(0)) * every + F.size(F.filter(near, lambda e: e < F.col("doc_id")))
    else:
        at = F.lit(0)
    dealt = docs.withColumn("_range", F.coalesce(at, F.lit(-1)))
    heads = sorted((r["_range"], r["head"]) for r in dealt.groupBy("_range").agg(F.max("doc_id").alias("head")).collect())
    before = {r: heads[(i + 1) % len(heads)][0] for i, (r, _) in enumerate(heads)}
    rows = [(r, h, before[r]) for r, h in heads]
    known = spark.createDataFrame(rows, "_range int, _head long, _before int")
    d, h = dealt.alias("d"), F.broadcast(known).alias("h")
    marked = d.join(h, (F.col("d._range") == F.col("h._range"))).select("d.*", F.col("h._before"), F.col("d.doc_id").eqNullSafe(F.col("h._head")).alias("_is_head"))
    copies = marked.select(
        *docs.columns,
        F.inline(F.expr("CASE WHEN _is_head THEN array(struct(_range AS _at, 0 AS _copy), struct(_before AS _at, 1 AS _copy)) ELSE array(struct(_range AS _at, 0 AS _copy)) END")),
    )
    order = Window.partitionBy("_at").orderBy("_copy", F.desc_nulls_last("doc_id"), "_tie")
    following = copies.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry])
    return following.where("_copy = 0").drop("_at", "_copy")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, whose last third is the next document's start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = chosen(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_tie")), "text", "_fp", k, window)
    pair = with_next(own.withColumn("_set", hashes(F.col("_fp"))), ["text", "_set"])
    n = F.length("text")
    last = F.floor(n / 3).cast("int")
    edited = pair.withColumn("_edited", F.concat(F.expr("left(text, length(text) - CAST(floor(length(text) / 3) AS INT))"), F.substring(F.col("next_text"), F.lit(1), last)))
    slim = edited.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), "_fp", "_set", "next__set", "_edited")
    both = chosen(slim, "_edited", "_efp", k, window).withColumn("_eset", hashes(F.col("_efp")))
    return both.select(
        "doc_id", "n_chars", "edited_sha256",
        spelled(F.col("_set")).alias("fingerprint"), spelled(F.col("_eset")).alias("edited_fingerprint"),
        likeness(F.col("_set"), F.col("_eset")).alias("near_edited"), likeness(F.col("_set"), F.col("next__set")).alias("near_next"),
        positions(F.col("_fp")).alias("positions"),
    )
