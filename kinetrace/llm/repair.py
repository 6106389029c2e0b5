"""Conversation structure repair: the cheapest edits that make roles alternate, by rank-compressed dynamic programming.

A repaired conversation is empty, or an optional system turn and then pairs of a user
and an assistant turn. Edits are Keep, Rerole, Delete and Insert; ties go to the least
string of their initials (the audit). A layer of the program is a turn, and a step is a
macro edit: a run of inserts and then what is done with the turn. Macros spell codes
like IK, of which none begins another, so the audits of one layer compare as the ranks
of their prefixes and then their last codes do. A layer therefore holds a cost and a
rank for each of the four grammar states and no string; with costs relative to the
layer's least there are few different layers, and steps between them are made once and
looked up (states that no cheapest repair can pass are left out, so costs stay small). Each turn leaves one number, from which the audit is read backwards.

Two passes, both streams over (conversation, turn) order. The first sees initials,
faults and digests, no text, and leaves audits in pieces of about ``PIECE`` turns. The
second lays the pieces beside the texts and writes the repaired turns one by one, so a
conversation of any length takes four bytes a turn and never its texts. Turns seen
before are found by a grouped least turn, not in a worker's memory.

Defined cases: null roles and texts are one space; turns go by turn (null first), then
role, then the digest of role and text. A role counts by its initial; an empty role has
none and can't be kept. Null conversation ids are one conversation. Rows that repeat
are duplicates. A conversation without turns (``also``) has an empty audit. Extra
columns are ignored. No conversations: no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.words import WORD, sql_crc32

#: Costs of the edits, of keeping a truncated turn, and the most inserts in a row that a cheapest repair can need.
RENAME, DELETE, INSERT, TRUNCATED, MOST_INSERTS = 2, 3, 2, 1, 2
#: Turns in a piece of an audit, and result rows in a batch.
PIECE, BATCH = 1 << 16, 2000
#: A state that costs so much more than the layer's cheapest is on no cheapest way: that one can do the same after
#: at most two inserts, and with the one system turn deleted that it may not keep.
SLACK = 2 * INSERT + DELETE
# The grammar: states are nothing yet, after system, after user, after assistant.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}


def filler(state: int) -> str:
    """The initial of the one role that a turn made or renamed in a state can have."""
    return "a" if state == 2 else "u"


def macros(state: int, initial: str, must_go: bool, truncated: bool) -> list[tuple[str, int, int]]:
    """(code, cost, next state) of every macro edit of a turn."""
    found, extra = [], TRUNCATED if truncated else 0
    for inserts in range(MOST_INSERTS + 1):
        run, cost = "I" * inserts, INSERT * inserts
        found.append((run + "D", cost + DELETE, state))
        if not must_go:
            if (state, initial) in STEPS:
                found.append((run + "K", cost + extra, STEPS[state, initial]))
            found.append((run + "R", cost + RENAME + extra, STEPS[state, filler(state)]))
        state = STEPS[state, filler(state)]
    return found


class Layers:
    """Steps between layers, each made once. A layer is (cost over the least, rank) or None for each state."""

    def __init__(self) -> None:
        self.steps: list[tuple[int, int, tuple]] = []  # (next layer, cost, (previous state, code) for each state)
        self.known: dict[tuple, int] = {}
        self.numbers: dict[tuple, int] = {}
        self.layers: list[tuple] = []
        self.start = self._number(((0, 0), None, None, None))

    def _number(self, layer: tuple) -> int:
        if layer not in self.numbers:
            self.numbers[layer] = len(self.layers)
            self.layers.append(layer)
        return self.numbers[layer]

    def step(self, layer: int, initial: str, must_go: bool, truncated: bool) -> int:
        """The number of the step from a layer over a turn."""
        key = (layer, initial, must_go, truncated)
        if key not in self.known:
            best: dict[int, tuple] = {}
            for state, at in enumerate(self.layers[layer]):
                if at is not None:
                    for code, cost, to in macros(state, initial, must_go, truncated):
                        found = (at[0] + cost, at[1], code, state)
                        best[to] = min(best.get(to, found), found)
            least = min(x[0] for x in best.values())
            best = {to: x for to, x in best.items() if x[0] - least <= SLACK}
            order = {to: rank for rank, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
            layer_after = tuple((best[s][0] - least, order[s]) if s in best else None for s in range(4))
            parents = tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))
            self.known[key] = len(self.steps)
            self.steps.append((self._number(layer_after), least, parents))
        return self.known[key]

    def end(self, layer: int) -> tuple[int, int, str]:
        """(cost, state, inserts) of the best end after the last turn."""
        found = []
        for state, at in enumerate(self.layers[layer]):
            if at is not None:
                to, run = state, ""
                for _ in range(MOST_INSERTS + 1):
                    if to in ENDS:
                        found.append((at[0] + INSERT * len(run), at[1], run, state))
                    to, run = STEPS[to, filler(to)], run + "I"
        cost, _, run, state = min(found)
        return cost, state, run


class Repair:
    """One conversation as its turns come, without their texts."""

    def __init__(self, layers: Layers) -> None:
        self.layers, self.layer, self.path, self.base = layers, layers.start, array("i"), 0
        self.cuts: list[tuple] = []  # (turns before, key) where pieces may begin
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first_turn = self.last_turn = self.key = self.initial = None

    def add(self, turn: int | None, role: str, digest: bytes, blank: bool, seen: bool, open_end: bool) -> None:
        key = (turn, role, digest)
        seen = seen or key == self.key
        if not self.cuts or (len(self.path) - self.cuts[-1][0] >= PIECE and key != self.key):
            self.cuts.append((len(self.path), key))
        if turn is not None:
            self.distinct += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.blank += blank
        self.duplicate += not blank and seen
        open_end = open_end and not blank and not seen
        self.truncated += open_end
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial, self.key = initial, key
        number = self.layers.step(self.layer, initial, blank or seen, open_end)
        self.path.append(number)
        self.layer, cost, _ = self.layers.steps[number]
        self.base += cost

    def rows(self) -> Iterator[tuple]:
        """(turn, role, digest, piece, None or the counts) for each piece of the audit; the counts go with the last."""
        cost, state, tail = self.layers.end(self.layer)
        cuts = self.cuts or [(0, (None, "", b""))]
        pieces, stop, steps = [], len(self.path), self.layers.steps
        for begin, key in reversed(cuts):
            codes = []
            for i in range(stop - 1, begin - 1, -1):
                state, code = steps[self.path[i]][2][state]
                codes.append(code)
            pieces.append((*key, "".join(reversed(codes)) + tail))
            stop, tail = begin, ""
        gaps = self.last_turn - self.first_turn + 1 - self.distinct if self.first_turn is not None else 0
        for n, row in enumerate(reversed(pieces)):
            counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.base + cost) if n == len(pieces) - 1 else (None,) * 6
            yield *row, *counts


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_KEY = (("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()))
_PIECES = (*_KEY, ("piece", pa.string()), *((c, pa.int64()) for c in COUNTS))
_TURNS = (("conv_id", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), *((c, pa.int64()) for c in COUNTS), ("piece", pa.string()))
_SQL_TYPES = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(fields: tuple) -> str:
    return ", ".join(f"{n} {_SQL_TYPES[t]}" for n, t in fields)


def _batched(rows: Iterator[tuple], fields: tuple, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, closed by their number or the size of their strings."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(some) >= BATCH or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*some, strict=True), fields, strict=True)], [n for n, _ in fields])
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*some, strict=True), fields, strict=True)], [n for n, _ in fields])


def _scalars(batches: Iterator[pa.RecordBatch], slice_rows: int = 1024) -> Iterator[tuple]:
    """Rows of Arrow batches as Python values, a slice at a time."""
    for batch in batches:
        for begin in range(0, len(batch), slice_rows):
            yield from zip(*(c.to_pylist() for c in batch.slice(begin, slice_rows).columns), strict=True)


def _in_order(df: DataFrame, *last: str) -> DataFrame:
    """A conversation in one task, its rows in order; nulls first."""
    return df.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "digest", *last)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Light rows in order to pieces of audits."""

    def rows() -> Iterator[tuple]:
        layers, conv, now = Layers(), None, None
        for conv_id, turn, role, digest, marker, blank, seen, open_end in _scalars(batches):
            if now is None or conv_id != conv:
                if now is not None:
                    yield from ((conv, *r) for r in now.rows())
                conv, now = conv_id, Repair(layers)
            if not marker:
                now.add(turn, role, digest, blank, seen, open_end)
        if now is not None:
            yield from ((conv, *r) for r in now.rows())

    yield from _batched(rows(), _PIECES)


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of audits and texts in order to repaired turns; the last row of a conversation has its counts."""

    def rows() -> Iterator[tuple]:
        conv, piece, used, at, state, counts = None, "", 0, 0, 0, None
        none = (None,) * 6

        def inserted() -> Iterator[tuple]:
            nonlocal used, at, state
            while used < len(piece) and piece[used] == "I":
                initial = filler(state)
                yield conv, at, None, "I", ROLES[initial], "", *none, None
                used, at, state = used + 1, at + 1, STEPS[state, initial]

        for conv_id, turn, role, _, is_text, text, found, *more in _scalars(batches):
            if not is_text:
                if counts is not None:  # the conversation before ends here
                    yield from inserted()
                    yield conv, None, None, None, None, None, *counts, None
                    counts, at, state = None, 0, 0
                else:
                    yield from inserted()
                conv, piece, used = conv_id, found, 0
                counts = tuple(more) if more[0] is not None else None
                yield conv, None, None, None, None, None, *none, piece
                continue
            yield from inserted()
            edit = piece[used]
            used += 1
            if edit == "D":
                yield conv, None, turn, "D", role, text, *none, None
                continue
            initial = filler(state) if edit == "R" else role[:1]
            yield conv, at, turn, edit, ROLES[initial] if edit == "R" else role, text, *none, None
            at, state = at + 1, STEPS[state, initial]
        if counts is not None:
            yield from inserted()
            yield conv, None, None, None, None, None, *counts, None

    yield from _batched(rows(), _TURNS)


def _identity(role: Column, text: Column) -> Column:
    """A digest that only equal roles with equal texts share."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def repair(turns: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """Repaired conversations (conv_id, turn, role, text) as rows in order within each task.

    Rows with an ``edit`` are turns: K, R and I with their place ``at``, D without; rows
    with a ``piece`` carry the next stretch of the audit, and a last row for each
    conversation its gaps, faults and cost. ``also``: conversations (conv_id) to report even without turns.
    """
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    known = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    known = known.withColumn("digest", _identity(F.col("role"), F.col("text")))
    faults = known.select(
        "conv_id", "turn", "role", "digest", F.lit(False).alias("marker"), (~F.col("text").rlike(WORD)).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open_end"),
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = faults.groupBy("conv_id", "digest").agg(F.min(place).alias("first")).select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    seen = faults.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left").withColumn("seen", place > F.col("first"))
    light = seen.select("conv_id", "turn", "role", "digest", "marker", "blank", "seen", "open_end")
    if also is not None:
        marks = also.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        no = F.lit(False)
        light = light.union(marks.select("conv_id", F.lit(None).cast("long"), F.lit(""), F.lit(b""), F.lit(True), no, no, no))
    audits = _in_order(light).mapInArrow(_audits, _ddl(_PIECES))
    counts = [F.lit(None).cast("long").alias(c) for c in COUNTS]
    texts = known.select("conv_id", "turn", "role", "digest", F.lit(True).alias("is_text"), "text", F.lit(None).cast("string").alias("piece"), *counts)
    both = audits.select("conv_id", "turn", "role", "digest", F.lit(False).alias("is_text"), F.lit(None).cast("string").alias("text"), "piece", *COUNTS).union(texts)
    return _in_order(both, "is_text").mapInArrow(_mended, _ddl(_TURNS))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with a fifth of a fourth of their turns broken in five ways, by a hash of conversation and turn."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_way"))
    way = F.col("_way")
    hurt = rows.where(way != 0).select(
        "conv_id", "turn", F.when(way == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(way == 1, "").when(way == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(way == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return hurt.drop("_copy")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns in order to one row a conversation."""
    fields = (("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()))

    def rows() -> Iterator[tuple]:
        audit, sha = [], hashlib.sha256()
        for conv, at, _, _, role, text, *counts, piece in _scalars(batches):
            if piece is not None:
                audit.append(piece)
            elif at is not None:
                sha.update(f"{chr(10) if at else ''}{role}:{text}".encode("utf-8", "replace"))
            elif counts[0] is not None:
                yield conv, *counts, "".join(audit), sha.hexdigest()
                audit, sha = [], hashlib.sha256()

    yield from _batched(rows(), fields)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Damage all conversations, repair them, and tell each one's faults, cost, audit and the hash of what it became."""
    mended = repair(damaged(conversations), also=conversations.select("conv_id"))
    return mended.mapInArrow(_digests, f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")


def oracle_sql() -> str:
    """The same program over whole audits: a layer of strings for each turn."""
    cells = [(p, initial, gone, cut, code, cost, to) for p in range(4) for initial in ("s", "u", "a", "") for gone in (False, True) for cut in (False, True) for code, cost, to in macros(p, initial, gone, cut)]
    table = ", ".join(f"({p}, '{i}', {g}, {c}, '{code}', {cost}, {to})" for p, i, g, c, code, cost, to in cells)
    ends = ", ".join(f"({p}, '{'I' * k}', {INSERT * k})" for p in range(4) for k in range(MOST_INSERTS + 1) if _after(p, k) in ENDS)
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ')"
    return f"""
WITH RECURSIVE macro(p, initial, gone, cut, code, cost, next) AS (VALUES {table}), ending(p, code, cost) AS (VALUES {ends}),
rows_ AS (
  SELECT {key} AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc32(key + " || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS way FROM conversations
), hurt AS (
  SELECT k, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE WHEN way = 1 THEN '' WHEN way = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, way FROM rows_ WHERE way <> 0
), placed AS (
  SELECT k, turn, role, text, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i
  FROM (SELECT k, turn, role, text FROM hurt UNION ALL SELECT k, turn, role, text FROM hurt WHERE way = 3)
), faulty AS (
  SELECT k, turn, role, text, i, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '' END AS initial,
    NOT regexp_matches(text, '{WORD}') AS blank, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open_end FROM placed
), turns AS (
  SELECT k, turn, role, text, i, initial, blank, NOT blank AND seen AS dup, NOT blank AND NOT seen AND open_end AS cut, lag(initial) OVER (PARTITION BY k ORDER BY i) || initial AS pair FROM faulty
), lengths AS (SELECT k, max(i) AS n FROM turns GROUP BY k
), layers(k, i, state, cost, audit) AS (
  SELECT k, CAST(0 AS BIGINT), 0, 0, '' FROM lengths
  UNION ALL
  SELECT k, i, state, cost, audit FROM (
    SELECT l.k, t.i, m.next AS state, l.cost + m.cost AS cost, l.audit || m.code AS audit,
      row_number() OVER (PARTITION BY l.k, t.i, m.next ORDER BY l.cost + m.cost, l.audit || m.code) AS nth
    FROM layers l JOIN turns t ON t.k = l.k AND t.i = l.i + 1 JOIN macro m ON m.p = l.state AND m.initial = t.initial AND m.gone = (t.blank OR t.dup) AND m.cut = t.cut
  ) WHERE nth = 1
), best AS (
  SELECT l.k, arg_min(struct_pack(cost := l.cost + e.cost, audit := l.audit || e.code), struct_pack(cost := l.cost + e.cost, audit := l.audit || e.code)) AS b
  FROM layers l JOIN lengths n ON n.k = l.k AND n.n = l.i JOIN ending e ON e.p = l.state GROUP BY l.k
), letters AS (
  SELECT k, generate_subscripts(string_split(b.audit, ''), 1) AS j, unnest(string_split(b.audit, '')) AS edit FROM best
), numbered AS (
  SELECT k, j, edit, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY k ORDER BY j) AS i, count(*) FILTER (WHERE edit <> 'D') OVER (PARTITION BY k ORDER BY j) AS place FROM letters
), kept AS (
  SELECT n.k, n.j, n.edit, n.place, t.role, t.text, max(CASE WHEN n.edit = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.k) AS s
  FROM numbered n LEFT JOIN turns t ON t.k = n.k AND t.i = n.i AND n.edit <> 'I' WHERE n.edit <> 'D'
), spoken AS (
  SELECT k, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS said FROM kept GROUP BY k
), counts AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS dup, count(*) FILTER (WHERE cut) AS cut,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY k
), ids AS (SELECT DISTINCT conv_id, {key} AS k FROM conversations)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.dup, 0) AS duplicate, coalesce(c.cut, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  CAST(coalesce(b.b.cost, 0) AS BIGINT) AS cost, coalesce(b.b.audit, '') AS audit, sha256(coalesce(s.said, '')) AS repaired_sha256
FROM ids o LEFT JOIN counts c ON c.k = o.k LEFT JOIN best b ON b.k = o.k LEFT JOIN spoken s ON s.k = o.k"""


def _after(state: int, inserts: int) -> int:
    for _ in range(inserts):
        state = STEPS[state, filler(state)]
    return state
