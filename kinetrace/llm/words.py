"""Words as every corpus operator counts them: runs of anything but ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word, for Java's and RE2's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: The six white-space characters between words.
SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """The number of words as a long; 0 for a null text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII string, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(8), lambda b: CAST((ascii(c) >> CAST(b AS INTEGER)) & 1 AS BIGINT))))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)), CAST(4294967295 AS BIGINT))"
