"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Sources in code-point order weigh 5, 2, 1 in turn and share the words of the
   corpus; no target exceeds three times its source's words. The excess goes to the
   rest by weight (water filling, in closed form by one ordered pass over sources).
2. The corpus is cut in blocks of equal numbers of words. Sainte-Lague gives each
   source its number of blocks, and again each shard of a source (about
   ``SHARD_DOCS`` documents chosen by a seeded hash) its integer quota.
3. In each shard the documents stand in seeded order; the quota is so many whole
   passes over the shard's blocks plus a run of blocks from a seeded start, round
   the end. A document's words in the chosen blocks are taken.

Only seats that are in doubt are listed when apportioning: everything under a bound
on the final divisor is given at once, so the work follows the number of sources and
shards, never the number of blocks. Windows run over one shard of a source, so a hot
source is spread over many tasks; only tables of one row per source meet in one task.

Defined cases: null texts and texts without words have size 0 and nothing taken. A
null source is a source, the last. Null ids share one hash. Repeated rows are
separate documents; which one of two equal rows is taken from is not observable.
No words at all: all targets are 0. Extra columns are carried along if asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.llm.words import n_words
from kinetrace.storage import keep

WEIGHTS = (5, 2, 1)
#: No target is above so many times its source's words.
MAX_REPEATS = 3
#: Most words in a block; small sources make blocks smaller, so that each has BLOCKS of them at least.
BLOCK_WORDS, BLOCKS = 64, 64
SHARD_DOCS = 4096
SEED = 20240607


def _hash(*parts: str) -> str:
    """A seeded 32-bit number from SQL expressions, the same in any engine with md5."""
    joined = ", ':', ".join(f"coalesce(CAST({p} AS STRING), 'null')" for p in parts)
    return f"CAST(conv(substr(md5(concat('{SEED}:', {joined})), 1, 8), 16, 10) AS BIGINT)"


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: its place, weight, words, documents and target."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    ranked = totals.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") - 1) % len(WEIGHTS) + 1).cast("long"))
    everything = Window.partitionBy()
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    filling = (
        ranked.withColumn("words", F.sum("source_size").over(everything))
        .withColumn("room", MAX_REPEATS * F.col("source_size"))
        .withColumn("left", F.col("words") - F.coalesce(F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("full", F.col("room") * F.col("open") < F.col("left") * F.col("weight"))
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "place", "left", "open"))).over(everything))
    )
    spread = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.open")
    smallest = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(everything)
    return filling.select(
        "source", "place", "weight", "source_size", "source_docs", "words",
        F.when(F.col("full"), F.col("room").cast("double")).otherwise(spread).alias("target"),
        F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.coalesce(smallest, F.lit(0)) / BLOCKS))).cast("long").alias("block"),
    )


def sainte_lague(claims: DataFrame, group: str, item: str, votes: str, seats: str) -> DataFrame:
    """Seats of every (group, item) by highest quotients votes / (2 k - 1), lower items first on ties.

    ``seats`` is the group's number of seats, on each of its rows. With V the votes, N
    the seats and n the items of a group, an item with v votes surely gets
    v / V * (N - n / 2) - 1/2 seats and at most v / V * (N + n / 2) + 1/2, so only the
    few seats between are ranked: O(n) for a group, whatever N is.
    """
    of = Window.partitionBy(group)
    share = claims.withColumn("_v", F.sum(votes).over(of)).withColumn("_n", F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(of))
    at = lambda sign: F.col(votes) / F.col("_v") * (F.col(seats) + sign * F.col("_n") / 2)
    some = (F.col("_v") > 0) & (F.col(votes) > 0)
    bounds = share.withColumn("_sure", F.when(some, F.greatest(F.lit(0), F.ceil(at(-1) - 0.5) - 1)).otherwise(0).cast("long")).withColumn(
        "_most", F.when(some, F.floor(at(1) + 0.5) + 1).otherwise(0).cast("long")
    )
    doubt = bounds.select(group, item, votes, seats, "_sure", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_most")))).alias("_k"))
    # an item without seats in doubt keeps one row, ranked last
    ranked = doubt.withColumn("_q", F.coalesce(F.col(votes) / (2 * F.col("_k") - 1), F.lit(-1.0))).withColumn("_sole", F.when(F.coalesce(F.col("_k") == F.col("_sure") + 1, F.lit(True)), F.col("_sure")).otherwise(0))
    free = F.col(seats) - F.sum("_sole").over(of)
    won = ranked.withColumn("_won", (F.row_number().over(of.orderBy(F.desc("_q"), item)) <= free) & (F.col("_q") >= 0))
    return won.groupBy(group, item).agg((F.max("_sure") + F.sum(F.when(F.col("_won"), 1).otherwise(0))).alias("quota"))


def mix(sized: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """``sized`` (doc_id, source, size, payload...) with source_size, target, taken and how it was taken.

    ``passes`` is the number of whole repeats of the document and ``first``, ``last``
    the half-open range of its words that is taken once more (before the shard's end
    or, for the run that goes on at the start, the second range first2, last2).
    """
    targets = source_targets(sized.select("source", "size"))
    words = F.col("words")
    claims = targets.withColumn("_all", F.lit(0)).withColumn("_seats", F.floor((2 * words + F.col("block")) / (2 * F.col("block"))))
    quotas = sainte_lague(claims, "_all", "place", "target", "_seats").select("place", "quota")
    sources = keep(targets.join(quotas, "place", "left").withColumn("shards", F.ceil(F.col("source_docs") / SHARD_DOCS).cast("long")), "mix-sources")

    d, s = sized.alias("d"), sources.alias("s")
    placed = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        F.col("d.doc_id"), F.col("d.size"), *[F.col(f"d.{c}") for c in payload], *[F.col(f"s.{c}") for c in ("place", "source_size", "target", "block")],
        F.expr(f"pmod({_hash('d.doc_id')}, s.shards)").alias("shard"), F.expr(f"md5(concat('order:{SEED}:', coalesce(CAST(d.doc_id AS STRING), 'null')))").alias("_order"),
    )
    slim = sized.select("doc_id", "source", "size").alias("d").join(s, F.col("d.source").eqNullSafe(F.col("s.source")))
    shards = (
        slim.select("place", "quota", "block", "size", F.expr(f"pmod({_hash('doc_id')}, shards)").alias("shard"))
        .groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.max("quota").alias("source_quota"), F.max("block").alias("block"))
        .withColumn("blocks", F.ceil(F.col("shard_size") / F.col("block")))
    )
    shards = keep(shards, "mix-shards")
    given = sainte_lague(shards, "place", "shard", "blocks", "source_quota")
    plan = shards.join(given, ["place", "shard"]).select(
        "place", "shard", "blocks",
        F.least(F.col("quota"), MAX_REPEATS * F.col("blocks")).alias("quota"),
        F.expr(f"pmod({_hash('place', 'shard')}, greatest(blocks, 1))").alias("start"),
    )
    plan = plan.select(
        "place", "shard",
        F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long").alias("passes"),
        "blocks", "start", F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0).cast("long").alias("run"),
    )
    shard = Window.partitionBy("place", "shard").orderBy("_order", "size")
    upto = F.sum("size").over(shard.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stood = placed.withColumn("_end", upto).join(plan, ["place", "shard"])
    begin, end, block = F.col("_end") - F.col("size"), F.col("_end"), F.col("block")
    reach = F.col("start") + F.col("run")

    def cut(low, high):
        """The document's words between two words of the shard, counted from its own first."""
        a = F.least(F.greatest(low - begin, F.lit(0)), F.col("size"))
        return a, F.greatest(a, F.least(high - begin, F.col("size")))

    first, last = cut(F.col("start") * block, F.least(reach, F.col("blocks")) * block)
    first2, last2 = cut(F.lit(0), F.greatest(reach - F.col("blocks"), F.lit(0)) * block)
    return stood.select(
        "doc_id", *payload, "size", "source_size", "target", "passes",
        *[c.cast("long").alias(n) for n, c in (("first", first), ("last", last), ("first2", first2), ("last2", last2))],
    ).withColumn("taken", F.col("passes") * F.col("size") + F.col("last") - F.col("first") + F.col("last2") - F.col("first2"))


def mixture(docs: DataFrame) -> DataFrame:
    """Every document with its size, its source's size and target, and the words taken."""
    sized = keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", "passes")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole documents once per pass, then the part of one more.

    A part is its words joined by single spaces; n_chars, where present, follows the text.
    """
    columns = docs.columns
    packed = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*columns).alias("_row"))
    mixed = mix(packed, payload=("_row",))
    part = F.expr(
        "CASE WHEN last > first OR last2 > first2 THEN array(array_join(concat("
        r"slice(regexp_extract_all(_row.text, '[^\\x20\\x09-\\x0D]+', 0), CAST(first2 + 1 AS INT), CAST(last2 - first2 AS INT)), "
        r"slice(regexp_extract_all(_row.text, '[^\\x20\\x09-\\x0D]+', 0), CAST(first + 1 AS INT), CAST(last - first AS INT))), ' ')) "
        "ELSE array() END"
    )
    # a document without words adds nothing: it is there once, if at all
    copies_of = F.when(F.col("size") > 0, F.col("passes")).otherwise(F.least("passes", F.lit(1)))
    copies = mixed.select("_row", F.explode(F.concat(F.array_repeat(F.col("_row.text"), copies_of.cast("int")), part)).alias("_text"))
    out = []
    for c in columns:
        col = F.col("_text") if c == "text" else F.length("_text").cast("long") if c == "n_chars" else F.col("_row")[c]
        out.append(col.alias(c))
    return copies.select(*out)


def oracle_sql() -> str:
    """DuckDB SQL for the rows of :func:`mixture` over ``documents``; seats are dealt one by one, by highest quotients."""

    def number(*parts: str) -> str:
        joined = " || ':' || ".join(f"coalesce(CAST({p} AS VARCHAR), 'null')" for p in parts)
        return f"CAST('0x' || substr(md5('{SEED}:' || {joined}), 1, 8) AS BIGINT)"

    def cut(low: str, high: str) -> str:
        a = f"least(greatest({low} - (upto - size), 0), size)"
        return f"greatest({a}, least({high} - (upto - size), size)) - {a}"

    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(place - 1) % {len(WEIGHTS)} + 1] AS weight
      FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM t)),
f AS (SELECT *, CAST(sum(s) OVER () AS BIGINT) AS words, {MAX_REPEATS} * s AS room,
        CAST(sum(s) OVER () AS BIGINT) - CAST(coalesce(sum({MAX_REPEATS} * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
        CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS unfilled,
        greatest(1, least({BLOCK_WORDS}, coalesce(min(s) FILTER (s > 0) OVER (), 0) // {BLOCKS})) AS block
      FROM w WINDOW o AS (ORDER BY s / weight, place)),
l AS (SELECT *, room * unfilled < rest * weight AS filled FROM f),
v AS (SELECT rest, unfilled FROM l WHERE NOT filled ORDER BY s / weight, place LIMIT 1),
g AS (SELECT l.source, l.place, l.s, l.n, l.block, CAST(ceil(l.n / {SHARD_DOCS}) AS BIGINT) AS shards, (2 * l.words + l.block) // (2 * l.block) AS seats,
        CASE WHEN filled THEN CAST(l.room AS DOUBLE) ELSE CAST(l.weight * v.rest AS DOUBLE) / v.unfilled END AS target FROM l, v),
q AS (SELECT place, count(*) AS quota FROM (
        SELECT place, seats, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, place) AS won FROM g, range(1, (SELECT max(seats) + 1 FROM g)) r(k) WHERE target > 0)
      WHERE won <= seats GROUP BY place),
p AS (SELECT d.doc_id, d.size, g.place, g.s, g.target, g.block, {number("d.doc_id")} % g.shards AS shard, coalesce(q.quota, 0) AS source_quota
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN q ON q.place = g.place),
h AS (SELECT place, shard, any_value(source_quota) AS source_quota, CAST(ceil(sum(size) / any_value(block)) AS BIGINT) AS blocks FROM p GROUP BY place, shard),
hq AS (SELECT place, shard, count(*) AS quota FROM (
        SELECT place, shard, source_quota, row_number() OVER (PARTITION BY place ORDER BY blocks / (2 * k - 1) DESC, shard) AS won
        FROM h, range(1, (SELECT max(source_quota) + 1 FROM h)) r(k) WHERE blocks > 0)
      WHERE won <= source_quota GROUP BY place, shard),
plan AS (SELECT *, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS passes, CASE WHEN blocks > 0 THEN quota % blocks ELSE 0 END AS run FROM (
        SELECT h.place, h.shard, blocks, least(coalesce(hq.quota, 0), {MAX_REPEATS} * blocks) AS quota, {number("h.place", "h.shard")} % greatest(blocks, 1) AS start
        FROM h LEFT JOIN hq ON hq.place = h.place AND hq.shard = h.shard)),
o AS (SELECT p.*, plan.passes, plan.run, plan.start, plan.blocks,
        CAST(sum(size) OVER (PARTITION BY p.place, p.shard ORDER BY md5('order:{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
      FROM p JOIN plan ON p.place = plan.place AND p.shard = plan.shard)
SELECT doc_id, size, s AS source_size, target, CAST(passes AS BIGINT) AS passes,
       CAST(passes * size + {cut("start * block", "least(start + run, blocks) * block")} + {cut("0", "greatest(start + run - blocks, 0) * block")} AS BIGINT) AS taken
FROM o"""
