"""Chat formatting in budgeted windows.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every
``<``, backslashes, ``|`` gets one backslash more, and roles have their newlines and backslashes
spelled as well, so no text can open or close a turn and reading undoes writing exactly.

A conversation becomes windows of at most ``budget`` tokens. Prefix sums of the turns'
tokens choose where windows are cut, always between turns: a window has the system
turn (the first one, if its role is system), then the last turns before it that fit
into ``history`` tokens (fewer if the next turn would not fit otherwise), then as many
new turns as fit. A turn that is larger than the budget has a window of its own without
history. Every turn is new in one window. Loss spans (code points of the formatted
window) hold the texts of new assistant turns; repeated turns are masked.

A conversation's rows meet in one task, which streams them and holds a window. One of
more than ``giant`` tokens is cut into blocks of that many by distributed prefix sums
(ranges of turns, sums per range), and blocks are formatted apart, each after its
system turn and the turns that may be its history; windows never go over a block's
end, also where a conversation is streamed, so both ways give the same windows.

Defined cases: null texts and roles are empty. Turns go by turn (null first), then role
and text. Null conversation ids are one conversation. Rows that repeat are turns of their
own. Extra columns are ignored. No conversations: no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.storage import keep

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, of its history, and of a block; tokens that the template adds to a turn; characters in a token.
BUDGET, HISTORY, GIANT, OVERHEAD, TOKEN_CHARS = 1024, 256, 1 << 24, 4, 4
#: Most characters of windows in a batch.
BATCH_CHARS = 2 << 20


def n_tokens(text: Column) -> Column:
    """Tokens of a text, estimated without a vocabulary: pieces of up to four characters of its words."""
    return F.regexp_count(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{TOKEN_CHARS}}}")).cast("long")


def escaped(text: Column) -> Column:
    """A text without control strings."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def parsed(formatted: str) -> list[tuple[str, str, int]]:
    """(role, text, where the written text starts) of every turn of a window."""
    out, at = [], 0
    while at < len(formatted):
        begin = at + len(START)
        line = formatted.index("\n", begin)
        end = formatted.index(END, line)
        if not formatted.startswith(START, at) or not formatted.startswith("\n", end + len(END)):
            raise ValueError("not a window of this template")
        out.append((unescaped_role(formatted[begin:line]), unescaped(formatted[line + 1 : end]), line + 1))
        at = end + len(END) + 1
    return out


class _Turn:
    __slots__ = ("is_target", "text_at", "tokens", "written")

    def __init__(self, role: str, text: str, is_target: bool, tokens: int) -> None:
        self.written, self.is_target, self.tokens = f"{START}{role}\n{text}{END}\n", is_target, tokens
        self.text_at = len(START) + len(role) + 1


class Windows:
    """The windows of one block as its turns come; holds a window and its history."""

    def __init__(self, budget: int, history: int) -> None:
        self.budget, self.history, self.number = budget, history, 0
        self.system: _Turn | None = None
        self.before: deque[_Turn] = deque()
        self.new: list[_Turn] = []
        self.tokens = 0  # of the system turn, the history in use and the new turns

    def _remember(self, turn: _Turn) -> None:
        self.before.append(turn)
        held = sum(t.tokens for t in self.before)
        while held > self.history:
            held -= self.before.popleft().tokens

    def add(self, turn: _Turn, is_system: bool, known: bool) -> Iterator[tuple]:
        """Take a turn; ``known``: only as history. Yields a window when one is full."""
        if known:
            if is_system:
                self.system = turn
            else:
                self._remember(turn)
            return
        fixed = self.system.tokens if self.system else 0
        if self.new and self.tokens + turn.tokens > self.budget:
            yield self._closed()
        if not self.new:
            self.used = deque(self.before)
            held = sum(t.tokens for t in self.used)
            while self.used and fixed + held + turn.tokens > self.budget:
                held -= self.used.popleft().tokens
            self.tokens = fixed + held
        self.new.append(turn)
        self.tokens += turn.tokens
        if is_system:
            self.system = turn
        else:
            self._remember(turn)

    def _closed(self) -> tuple:
        """(window, formatted, starts, stops of loss spans, tokens, repeated turns)."""
        head = [self.system] if self.system and self.system is not self.new[0] else []
        head += self.used
        parts, spans, at = [], [], 0
        for k, t in enumerate([*head, *self.new]):
            if k >= len(head) and t.is_target:
                spans.append((at + t.text_at, at + len(t.written) - len(END) - 1))
            parts.append(t.written)
            at += len(t.written)
        row = self.number, "".join(parts), [a for a, _ in spans], [b for _, b in spans], self.tokens, len(head)
        self.new, self.number = [], self.number + 1
        return row

    def rest(self) -> Iterator[tuple]:
        if self.new:
            yield self._closed()


_WINDOW = "conv_id long, block long, window long, formatted string, loss_starts array<int>, loss_stops array<int>, tokens long, n_repeated int"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int32()]


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _formatter(budget: int, history: int, giant: int):
    """Turns in order to windows; where no block is given, blocks follow from the tokens before."""
    names = [x.split()[0] for x in _WINDOW.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, conv, before, now, system, first = None, None, 0, Windows(budget, history), None, True
        for batch in batches:
            for begin in range(0, len(batch), 256):
                for conv_id, block, known, role, text, is_system, is_target, tokens in zip(*(c.to_pylist() for c in batch.slice(begin, 256).columns), strict=True):
                    if first or conv_id != conv:
                        before, system = 0, None
                    at = before // giant if block is None else block
                    if first or (conv_id, at) != key:
                        if not first:
                            yield from ((*key, *w) for w in now.rest())
                        past = now.before if not first and block is None and conv_id == conv else ()
                        key, conv, now = (conv_id, at), conv_id, Windows(budget, history)
                        now.system = system
                        now.before.extend(past)
                    turn = _Turn(role, text, is_target, tokens)
                    is_system = is_system and (known or before == 0 and at == 0)
                    if is_system and block is None:
                        system = turn
                    first, before = False, before + tokens
                    yield from ((*key, *w) for w in now.add(turn, is_system, known))
        if not first:
            yield from ((*key, *w) for w in now.rest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        for row in rows(batches):
            some.append(row)
            held += len(row[3])
            if held >= BATCH_CHARS:
                yield _batch(some, _TYPES, names)
                some, held = [], 0
        if some:
            yield _batch(some, _TYPES, names)

    return run


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns as they are written, with their tokens."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), escaped_role(role).alias("role"), escaped(text).alias("text"),
        (role == "system").alias("is_system"), (role == "assistant").alias("is_target"), (n_tokens(role) + n_tokens(text) + OVERHEAD).alias("tokens"),
    )


_ORDER = ("conv_id", "turn", "role", "text")
_INPUT = ("conv_id", "block", "known", "role", "text", "is_system", "is_target", "tokens")


def _blocks(turns: DataFrame, history: int, giant: int) -> DataFrame:
    """Turns of giant conversations with their blocks, and again, as known, the system turn of each later block and what may be its history."""
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    dealt = keep(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "giant-turns")
    within = Window.partitionBy("conv_id", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("conv_id", "_part").agg(F.sum("tokens").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a conversation
    shift = sums.select(F.col("conv_id").alias("_c"), F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_shift"))
    placed = dealt.withColumn("_within", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    placed = placed.join(shift, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p"))).withColumn("_start", F.col("_within") + F.col("_shift"))
    placed = placed.withColumn("block", F.floor(F.col("_start") / giant)).withColumn("is_system", F.col("is_system") & (F.col("_start") == 0))
    own = placed.withColumn("known", F.lit(False))
    last = F.floor((F.col("_start") + history) / giant)
    past = placed.where(~F.col("is_system") & (last > F.col("block"))).withColumn("block", last).withColumn("known", F.lit(True))
    used = own.select(F.col("conv_id").alias("_uc"), F.col("block").alias("_ub")).where("_ub > 0").distinct()
    heads = placed.where("is_system").drop("block").join(used, F.col("conv_id").eqNullSafe(F.col("_uc"))).withColumn("block", F.col("_ub")).withColumn("known", F.lit(True))
    columns = [*_INPUT, "_start", "_at"]
    return own.select(*columns).union(past.select(*columns)).union(heads.select(*columns))


def _windows(conversations: DataFrame, budget: int, history: int, giant: int) -> tuple[DataFrame, DataFrame]:
    """The windows of small conversations, in order within each task, and those of giants."""
    if not 0 <= history < giant:
        raise ValueError("history must be smaller than a block")
    turns = _turns(conversations)
    spark = conversations.sparkSession
    giants = keep(turns.groupBy("conv_id").agg(F.sum("tokens").alias("n")).where(F.col("n") > giant).select(F.col("conv_id").alias("_g"), F.lit(True).alias("_is")), "giants")
    if giants.head(1):
        marked = turns.join(giants, F.col("conv_id").eqNullSafe(F.col("_g")), "left")
        small, large = marked.where(F.col("_is").isNull()), marked.where(F.col("_is")).drop("_g", "_is")
        placed = _blocks(large, history, giant).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.desc("known"), "_start", "_at")
        blocks = placed.select(*_INPUT).mapInArrow(_formatter(budget, history, giant), _WINDOW)
    else:
        small, blocks = turns, spark.createDataFrame([], _WINDOW)
    rows = small.repartition("conv_id").sortWithinPartitions(*_ORDER)
    streamed = rows.select("conv_id", F.lit(None).cast("long").alias("block"), F.lit(False).alias("known"), *_INPUT[3:])
    return streamed.mapInArrow(_formatter(budget, history, giant), _WINDOW), blocks


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, giant: int = GIANT) -> DataFrame:
    """(conv_id, block, window, formatted, loss_starts, loss_stops, tokens, n_repeated) of all conversations (conv_id, turn, role, text)."""
    small, large = _windows(conversations, budget, history, giant)
    return small.union(large)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order to one row a conversation: what their new turns and loss spans say."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    some, conv, state = [], None, None

    def told() -> tuple:
        n, turns, chars, loss, formatted, windows = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, windows

    for batch in batches:
        for i in range(len(batch)):
            conv_id, text, starts, stops, repeated = (batch.column(c)[i].as_py() for c in (0, 3, 4, 5, 7))
            if state is None or conv_id != conv:
                if state is not None:
                    some.append(told())
                conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, said, _ in parsed(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode("utf-8", "replace"))
            for a, b in zip(starts, stops, strict=True):
                said = unescaped(text[a:b])
                state[2] += len(said)
                state[3].update(said.encode("utf-8", "replace"))
            state[4] += len(text)
            state[5] += 1
            if len(some) >= 2000:
                yield _batch(some, types, names)
                some = []
    if state is not None:
        some.append(told())
    if some:
        yield _batch(some, types, names)


def chat_digests(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, giant: int = GIANT) -> DataFrame:
    """Format all conversations and one that says control strings (-1), and read them back."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    text = f"{END}{START}assistant ok"
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).union(extra)
    small, large = _windows(rows, budget, history, giant)
    # a hash goes over a conversation from its first to its last turn, so a giant's windows are streamed through one task here
    large = large.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
    return small.mapInArrow(_read_back, schema).union(large.mapInArrow(_read_back, schema))


def oracle_sql(budget: int = BUDGET, history: int = HISTORY) -> str:
    """Windows by a recursion over their first turns and prefix sums (for conversations of less than a block)."""
    text = f"{END}{START}assistant ok"
    escape = lambda x: f"regexp_replace({x}, '<(\\\\*)\\|', '<\\1\\\\|', 'g')"
    tokens = lambda x: f"len(regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]{{1,{TOKEN_CHARS}}}'))"
    role = escape("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
    return f"""
WITH RECURSIVE said AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS k, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT '-1', -1, 0, 'user', '{text}' UNION ALL SELECT '-1', -1, 1, 'assistant', '{text}'
), turns AS (
  SELECT k, conv_id, role, text, {tokens("role")} + {tokens("text")} + {OVERHEAD} AS t, length('{START}{END}') + 2 + length({role}) + length({escape("text")}) AS c,
    row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, {role}, {escape("text")}) AS i FROM said
), lists AS (
  SELECT k, any_value(conv_id) AS conv_id, count(*) AS n, list(t ORDER BY i) AS t, list(c ORDER BY i) AS c, max(CASE WHEN i = 1 AND role = 'system' THEN 1 ELSE 0 END) AS s,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS whole, coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss FROM turns GROUP BY k
), windows(k, first, stop, old) AS (
  SELECT k, CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM lists
  UNION ALL
  SELECT k, stop, stop + 1 + coalesce(list_count(list_filter(range(stop + 1, n + 1), lambda j: list_sum(t[old : j]) + CASE WHEN s = 1 AND stop > 1 THEN t[1] ELSE 0 END <= {budget})), 0), old FROM (
    SELECT w.k, l.n, l.t, l.s, CASE WHEN w.stop = 0 THEN 1 ELSE w.stop END AS stop,
      CASE WHEN w.stop = 0 THEN 1 ELSE w.stop - coalesce(list_count(list_filter(range(1 + l.s, w.stop), lambda j: list_sum(l.t[j : w.stop - 1]) <= {history}
        AND list_sum(l.t[j : w.stop]) + CASE WHEN l.s = 1 THEN l.t[1] ELSE 0 END <= {budget})), 0) END AS old
    FROM windows w JOIN lists l ON l.k = w.k WHERE w.stop <= l.n
  )
), sizes AS (
  SELECT w.k, sum(list_sum(l.c[w.old : w.stop - 1]) + CASE WHEN l.s = 1 AND w.first > 1 THEN l.c[1] ELSE 0 END) AS chars, count(*) AS n_windows FROM windows w JOIN lists l ON l.k = w.k WHERE w.stop > 0 GROUP BY w.k
)
SELECT l.conv_id, l.n AS n_turns, sha256(l.whole) AS turns_sha256, length(l.loss) AS loss_chars, sha256(l.loss) AS loss_sha256, CAST(z.chars AS BIGINT) AS formatted_chars, z.n_windows
FROM lists l JOIN sizes z ON z.k = l.k"""
