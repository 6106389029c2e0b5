"""Quality rules with thresholds learnt from the corpus itself.

Each document gets a few counts. Counts become integer ratios; per language and
source a histogram sketch of each ratio is kept (a count per bin: bins of width one
below 1000, of three significant digits above), so partial sketches merge by adding
counts and any order of merging gives the same sketch.

An upper fence is a quantile of the group's sketch, the share of documents that is
taken as normal (``RATIOS``), or the Tukey fence of its quartiles if that is further
out; word lengths have a lower Tukey fence as well. No fence is a fixed value. A group
of fewer than ``LEAST`` documents uses the sketch of its language, merged from its
groups, and a small language that of the corpus. Fences are joined back to filter.

Everything is a built-in expression; the text is read once, and the counts are kept
in the shared folder between the sketch and the filter.

Defined cases: a null or empty text has no words, so the base rules reject it. A null
language or source is a group of its own. Repeated rows count once each. An empty
table gives an empty result. Extra columns are ignored. A document at a fence stays,
so a corpus of one document keeps it if it passes the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.words import SPACE, words
from kinetrace.storage import keep

#: ratio -> (SQL of the integer ratio, thousandths of a group that are normal, has a lower fence)
#: (four lines more than there are: a short text with one line twice is no junk)
RATIOS: dict[str, tuple[str, int, bool]] = {
    "word_length": ("100 * word_chars div n_words", 900, True),
    "symbols": ("1000 * n_symbols div word_chars", 900, False),
    "dup_lines": ("1000 * n_dup_lines div (n_lines + 4)", 980, False),
    "repeats": ("1000 * n_repeat_words div n_words", 980, False),
}
#: A Tukey fence is this many interquartile ranges away from its quartile.
FENCE = 3
#: Documents that a group needs for thresholds of its own.
LEAST = 100
MIN_WORDS = 50


def _bin(value: str) -> str:
    """Bin of a non-negative integer: exact below 1000, three significant digits above."""
    return f"CASE WHEN {value} < 1000 THEN {value} ELSE {value} - {value} % CAST(pow(10, length(CAST({value} AS STRING)) - 3) AS BIGINT) END"


def document_counts(docs: DataFrame, carry: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The base counts of every whole text, beside the columns in ``carry``.

    ``n_repeat_words`` sorts the hashes of a document's three-word windows with their
    positions, so it takes n log n steps for any text; most documents have no
    repeated window and skip the sort.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        *carry,
        words(F.col("text")).alias("_words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, SPACE, "")) > 0).alias("_lines"),
    )
    grams = base.select(
        *carry,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2)))").alias("_grams"),
    )
    ordered = grams.withColumn(
        "_ordered",
        F.expr("CASE WHEN size(array_distinct(_grams)) = size(_grams) THEN NULL ELSE sort_array(transform(_grams, (g, i) -> struct(g AS g, i AS i))) END"),
    )
    repeated = ordered.withColumn(
        "_again", F.expr("filter(_ordered, (e, j) -> coalesce(get(_ordered, j - 1).g = e.g, false) OR coalesce(get(_ordered, j + 1).g = e.g, false))")
    )
    covered = F.expr("size(array_distinct(flatten(transform(_again, e -> array(e.i, e.i + 1, e.i + 2)))))")
    return repeated.select(
        *carry, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.col("_ordered").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """The fixed rules: too short, or mostly made of repeated three-word windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(counts: DataFrame) -> DataFrame:
    """One mergeable histogram per language, source and ratio: (lang, source, ratio, bin, n)."""
    good = counts.where(~base_failed())
    each = F.array(*[F.struct(F.lit(name).alias("ratio"), F.expr(_bin(f"({sql})")).alias("bin")) for name, (sql, _, _) in RATIOS.items()])
    return good.select("lang", "source", F.inline(each)).groupBy("lang", "source", "ratio", "bin").agg(F.count("*").alias("n"))


def fence_names() -> list[str]:
    return [f"max_{name}" for name in RATIOS] + [f"min_{name}" for name, x in RATIOS.items() if x[2]]


def fences_sql(sketch: str) -> str:
    """SQL (for Spark and DuckDB) for one row of fences per language and source, out of a table of sketches."""
    normal = " ".join(f"WHEN '{name}' THEN {level}" for name, (_, level, _) in RATIOS.items())
    upper = [f"max(CASE WHEN ratio = '{name}' THEN greatest(q, q3 + {FENCE} * (q3 - q1)) END) AS max_{name}" for name in RATIOS]
    lower = [f"max(CASE WHEN ratio = '{name}' THEN q1 - {FENCE} * (q3 - q1) END) AS min_{name}" for name, x in RATIOS.items() if x[2]]
    own = ", ".join(f"CASE WHEN g.total >= {LEAST} THEN g.{x} WHEN l.total >= {LEAST} THEN l.{x} ELSE c.{x} END AS {x}" for x in ("q1", "q3", "q"))
    return f"""
WITH merged AS (
  SELECT 0 AS level, lang, source, ratio, bin, n FROM {sketch}
  UNION ALL SELECT 1 AS level, lang, NULL AS source, ratio, bin, sum(n) AS n FROM {sketch} GROUP BY lang, ratio, bin
  UNION ALL SELECT 2 AS level, NULL AS lang, NULL AS source, ratio, bin, sum(n) AS n FROM {sketch} GROUP BY ratio, bin),
levels AS (
  SELECT level, lang, source, ratio, max(total) AS total, CAST(min(CASE WHEN 4 * upto >= total THEN bin END) AS BIGINT) AS q1,
         CAST(min(CASE WHEN 4 * upto >= 3 * total THEN bin END) AS BIGINT) AS q3,
         CAST(min(CASE WHEN 1000 * upto >= (CASE ratio {normal} END) * total THEN bin END) AS BIGINT) AS q
  FROM (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bin) AS upto,
               sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total FROM merged) t
  GROUP BY level, lang, source, ratio)
SELECT lang, source, {", ".join(upper + lower)}
FROM (SELECT g.lang, g.source, g.ratio, {own} FROM levels g
      JOIN levels l ON l.level = 1 AND l.ratio = g.ratio AND l.lang IS NOT DISTINCT FROM g.lang
      JOIN levels c ON c.level = 2 AND c.ratio = g.ratio WHERE g.level = 0) t
GROUP BY lang, source"""


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, base rules and adaptive verdict of every document.

    The fences are one row per language and source; the join leaves it to Spark's
    measured size whether that table is broadcast.
    """
    counts = keep(document_counts(docs), "quality-counts")
    limits = docs.sparkSession.sql(fences_sql("{sketch}"), sketch=keep(sketches(counts), "quality-sketches"))
    verdict = F.lit(True)
    for name, (sql, _, lower) in RATIOS.items():
        # a document that failed the base rules may have no words to divide by
        ratio = F.when(F.col("base_failed"), F.lit(None)).otherwise(F.expr(_bin(f"({sql})")))
        verdict = verdict & (ratio <= F.col(f"max_{name}"))
        if lower:
            verdict = verdict & (ratio >= F.col(f"min_{name}"))
    c, t = counts.withColumn("base_failed", base_failed()).alias("c"), limits.alias("t")
    joined = c.join(t, F.col("c.lang").eqNullSafe(F.col("t.lang")) & F.col("c.source").eqNullSafe(F.col("t.source")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(verdict, F.lit(False))).alias("kept"),
        *[t[x] for x in t.columns if x.startswith(("max_", "min_"))],
    )


def oracle_sql() -> str:
    """DuckDB SQL for the rows of :func:`quality_rules` over ``documents``."""

    def ratio(sql: str) -> str:
        return sql.replace(" div ", " // ")

    def bin_of(value: str) -> str:
        return f"CASE WHEN {value} < 1000 THEN {value} ELSE {value} - {value} % CAST(pow(10, length(CAST({value} AS VARCHAR)) - 3) AS BIGINT) END"

    bins = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{name}' AS ratio, {bin_of(f'({ratio(sql)})')} AS bin FROM good" for name, (sql, _, _) in RATIOS.items())
    names = fence_names()
    guard = {name: f"({bin_of(f'({ratio(sql)})')})" for name, (sql, _, _) in RATIOS.items()}
    verdict = " AND ".join([f"{guard[name]} <= max_{name}" for name in RATIOS] + [f"{guard[name]} >= min_{name}" for name, x in RATIOS.items() if x[2]])
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM gram) WHERE n > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
counts AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t) t
  LEFT JOIN covered USING (rid)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
good AS (SELECT * FROM judged WHERE NOT base_failed),
sketch AS (SELECT lang, source, ratio, bin, count(*) AS n FROM ({bins}) GROUP BY ALL),
fence AS ({fences_sql("sketch")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE coalesce({verdict}, false) END AS kept, {", ".join(names)}
FROM judged j LEFT JOIN fence f ON j.lang IS NOT DISTINCT FROM f.lang AND j.source IS NOT DISTINCT FROM f.source"""
