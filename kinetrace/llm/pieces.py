"""SentencePiece encoding and decoding as a max-plus scan, with the ids of the library.

The model file is a BPE model: the pair of neighbours whose joint piece has the greatest
score is merged first, the leftmost on ties. A sequence of pieces is what these merges
make of a text exactly if every two neighbours are what the merges make of the two
alone: as long as no merge has crossed the cuts, the merges between two cuts run as if
there were nothing else. So a text's encoding is the one path over its positions whose
edges are pieces and whose weights, 0 for neighbours that stay apart and -inf for
others, add up to 0: the best path in the max-plus algebra.

A giant document is split into chunks, which are rows of a table. The state at a cut
between two chunks is the piece that reaches it or goes over it. Each chunk yields its
matrix from states on entering to states on leaving; a document's matrices are combined
associatively, pair by pair and level by level, the states at all cuts follow from the
top down, and each chunk is traced back by itself from the two states it got.

No piece of the vocabulary goes on from another character to a space mark, so between
two such places the paths of a chunk are independent: words that a task has seen are
remembered, only what cuts go through takes part in a matrix, and a run without spaces
of more than ``LONG`` characters is solved by the path instead of by merges.

Normalising is that of the file, which must be the identity with a space mark in front
(:func:`load` refuses others, and files that are no BPE models). A character without a
piece is spelled in byte pieces. Decoding gives the text back; a space mark that stands
in the text itself comes back as a space, as in the library, and ``exact`` is false.

Defined cases: null and empty texts have no pieces and decode to "". Repeated rows are
encoded each. Bytes that are no UTF-8 count as U+FFFD. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.shingles import utf8
from kinetrace.storage import keep

#: Most characters of a segment that is solved by merges.
LONG = 64
#: Characters of a chunk, and most bytes of a document that is one.
CHUNK = 1 << 16
SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_EDGE = re.compile(f"(?<=[^{SPACE}]){SPACE}")
_REMEMBERED = 1 << 18
#: Bytes of text that a task works on at a time.
_GROUP = 1 << 20
#: The state before a document and after it.
NONE = 0
_WIDE = 64


class Vocabulary:
    """Pieces with scores and ids, and the bytes that each id stands for."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int]) -> None:
        """``pieces``: (piece, score, id) of the ordinary pieces; ``byte_ids``: the ids of the 256 byte pieces."""
        self.longest = max(len(p) for p, _, _ in pieces)
        self.score = {p: s for p, s, _ in pieces}
        self.id = {p: i for p, _, i in pieces}
        self.byte_ids = byte_ids
        self.spelled = [b""] * (1 + max([*self.id.values(), *byte_ids]))
        for p, i in self.id.items():
            self.spelled[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            self.spelled[i] = bytes([b])
        self.stays: dict[tuple[str, str], bool] = {}

    def merged(self, s: str) -> list[str]:
        """What the merges make of a short string."""
        parts, get, none = list(s), self.score.get, -np.inf
        scores = [get(a + b, none) for a, b in zip(s, s[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            parts[at : at + 2] = [both := parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = get(both + parts[at + 1], none)
            if at:
                scores[at - 1] = get(parts[at - 1] + both, none)
        return parts

    def apart(self, a: str, b: str) -> bool:
        """If ``a`` and ``b`` side by side stay the two pieces they are; with "" for one, if the other stays whole."""
        found = self.stays.get((a, b))
        if found is None:
            if len(self.stays) > _REMEMBERED:
                self.stays.clear()
            found = self.stays[a, b] = self.merged(a + b) == ([a, b] if a and b else [a or b])
        return found

    def ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.id.get(p)
            if i is None:
                out += [self.byte_ids[b] for b in p.encode()]
            else:
                out.append(i)
        return out

    def pieces_at(self, text: str, at: int, end: int) -> Iterator[int]:
        """Where the pieces (or the lone character) that start at ``at`` end, up to ``end``."""
        for stop in range(at + 1, min(at + self.longest, end) + 1):
            if stop == at + 1 or text[at:stop] in self.score:
                yield stop


class Merger:
    """The merges of many short strings at once, a string in each row of an array."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        names = list(v.score)
        number = {p: i for i, p in enumerate(names)}
        self.name_ids = np.array([v.id[p] for p in names], "<i4")
        self.scores = np.array([v.score[p] for p in names])
        pairs = [((number[p[:i]] << 20) | number[p[i:]], n) for n, p in enumerate(names) for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        key, joint = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []
        for step in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
            # keys that share a slot with one before them go to the next table
            slot, keys, values = self._slot(key, step), np.full(1 << 18, -1, np.int64), np.full(1 << 18, -1, np.int32)
            _, first = np.unique(slot, return_index=True)
            keys[slot[first]], values[slot[first]] = key[first], joint[first]
            self.tables.append((step, keys, values))
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, joint = key[rest], joint[rest]
        if len(key):
            raise ValueError("too many pairs of pieces")
        # characters as pieces; those without one are numbered -1 and never merge
        self.chars = np.full(0x110000, -1, np.int32)
        lone = [p for p in names if len(p) == 1]
        self.chars[[ord(p) for p in lone]] = [number[p] for p in lone]

    @staticmethod
    def _slot(key: np.ndarray, step: int) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(step)) >> np.uint64(46)).astype(np.int64)

    def joint(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, -1 for none."""
        key = (a.astype(np.int64) << 20) | b
        key[(a < 0) | (b < 0)] = -2
        out = np.full(key.shape, -1, np.int32)
        for step, keys, values in self.tables:
            slot = self._slot(key, step)
            np.copyto(out, values[slot], where=keys[slot] == key)
        return out

    def merged(self, strings: list[str]) -> list[np.ndarray]:
        """The pieces' ids of every string (bytes for what has no piece)."""
        n = np.array([len(s) for s in strings])
        codes = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4")
        width = int(n.max()) + 1
        at = np.arange(width)
        parts = np.full((len(strings), width), -1, np.int32)
        there = at < n[:, None]
        parts[there] = self.chars[codes]
        unknown = np.flatnonzero((there & (parts < 0)).any(axis=1)).tolist()
        both = np.full(parts.shape, -1, np.int32)
        both[:, :-1] = self.joint(parts[:, :-1], parts[:, 1:])
        score = np.where(both >= 0, self.scores[both], -np.inf)
        left = np.flatnonzero(both.max(axis=1) >= 0)
        while len(left):
            p, b, s = parts[left], both[left], score[left]
            row, m = np.arange(len(left)), s.argmax(axis=1)
            new = b[row, m]
            onward = np.minimum(at + (at > m[:, None]), width - 1)
            p, b, s = (np.take_along_axis(x, onward, axis=1) for x in (p, b, s))
            p[:, -1], b[:, -1], s[:, -1] = -1, -1, -np.inf
            p[row, m] = new
            for a in (m, np.maximum(m - 1, 0)):
                x = self.joint(p[row, a], p[row, np.minimum(a + 1, width - 1)])
                b[row, a], s[row, a] = x, np.where(x >= 0, self.scores[x], -np.inf)
            parts[left], both[left], score[left] = p, b, s
            n[left] -= 1
            left = left[b.max(axis=1) >= 0]
        out = [self.name_ids[x[:k]] for x, k in zip(parts, n.tolist(), strict=True)]
        for i in unknown:
            out[i] = np.array(self.v.ids(self.v.merged(strings[i])), "<i4")
        return out


class Paths:
    """The zero-weight paths over a stretch of text: for every position the pieces that end there, with the set (bits) of entering states they are reached from."""

    def __init__(self, v: Vocabulary, text: str, enter: list[tuple[int, int]], stop: int, end: int) -> None:
        """``enter``: pieces (start, end) that paths begin after, (i, i) for none; paths take pieces that start before ``stop`` and end by ``end``."""
        self.v, self.text, self.enter = v, text, enter
        self.at: dict[int, dict[int, int]] = {}
        for bit, (a, b) in enumerate(enter):
            self.at.setdefault(b, {})[a] = 1 << bit
        apart = v.apart
        for p in range(min((b for _, b in enter), default=stop), stop):
            nodes = self.at.get(p)
            if not nodes:
                continue
            for q in v.pieces_at(text, p, end):
                piece, reached = text[p:q], 0
                for a, mask in nodes.items():
                    if apart(text[a:p], piece):
                        reached |= mask
                if reached:
                    self.at.setdefault(q, {})[p] = reached

    def back(self, start: int, end: int, bit: int) -> list[str]:
        """The pieces of the path from entering state ``bit`` that ends with the piece (start, end), that one included."""
        out = []
        while True:
            piece = self.text[start:end]
            out.append(piece)
            before = [(a, m) for a, m in self.at[start].items() if m >> bit & 1 and self.v.apart(self.text[a:start], piece)]
            (a, _), end = before[0], start
            if (a, end) == self.enter[bit]:
                return out[::-1]
            start = a


class Segments(dict):
    """A text between two edges -> its packed ids; forgets all when it has grown."""

    def __init__(self, v: Vocabulary) -> None:
        super().__init__()
        self.v, self.merger = v, Merger(v)

    def learn(self, split: list[list[str]]) -> None:
        """Have all segments of some texts that can be kept, many at once."""
        if len(self) > _REMEMBERED:
            self.clear()
        by_width: dict[int, list[str]] = {}
        for s in set().union(*split).difference(self):
            if len(s) <= LONG:
                by_width.setdefault(-(-len(s) // 4), []).append(s)
        for strings in by_width.values():
            for i in range(0, len(strings), 4096):
                some = strings[i : i + 4096]
                self.update(zip(some, [x.tobytes() for x in self.merger.merged(some)], strict=True))

    def __missing__(self, s: str) -> bytes:
        """One over LONG characters, which isn't kept."""
        p = Paths(self.v, s, [(0, 0)], len(s), len(s))
        (start,) = p.at[len(s)]
        return np.array(self.v.ids(p.back(start, len(s), 0)), "<i4").tobytes()


class Encoder:
    """Encodes texts and chunks of texts."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.segments = vocabulary, Segments(vocabulary)

    def marked(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts whose spaces are marks already."""
        split = [_SEGMENT.findall(t) for t in texts]
        self.segments.learn(split)
        return [np.frombuffer(b"".join(map(self.segments.__getitem__, s)), "<i4") for s in split]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        return self.marked([SPACE + t.replace(" ", SPACE) if t else "" for t in texts])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text that was encoded: the pieces' bytes without the mark put before the text."""
        return b"".join(map(self.v.spelled.__getitem__, ids.tolist()))[1:].decode()

    def _edges(self, text: str, begin: int, stop: int) -> tuple[int, int] | None:
        """The first edge from ``begin`` on and the last before ``stop``; none in a run that goes through."""
        found = [m.start() for m in _EDGE.finditer(text, begin, stop)]
        return (found[0], found[-1]) if found else None

    def states(self, text: str, cut: int, end: int) -> list[tuple[int, int]]:
        """All pieces that start before a cut and reach it."""
        v = self.v
        return [(a, b) for a in range(max(0, cut - v.longest), cut) for b in v.pieces_at(text, a, end) if b >= cut and v.apart("", text[a:b])]

    def transfer(self, text: str, begin: int, stop: int) -> list[tuple[int, int]]:
        """The finite entries (state on entering, state on leaving) of the chunk text[begin:stop]; it is the first if begin is 0, the last if stop is the end."""
        end = len(text)
        enter = [(0, 0)] if begin == 0 else self.states(text, begin, end)
        leave = lambda a, b: (b == end if stop == end else b >= stop) and a < stop
        edges = self._edges(text, begin, stop)
        if edges is None:
            p = Paths(self.v, text, enter, stop, end)
            out = [((a, b), mask) for b, nodes in p.at.items() for a, mask in nodes.items() if leave(a, b)]
        else:
            first, last = edges
            p = Paths(self.v, text, enter, first, first)
            reached = 0
            for mask in p.at.get(first, {}).values():
                reached |= mask
            q = Paths(self.v, text, [(last, last)], stop, end)
            out = [((a, b), reached) for b, nodes in q.at.items() for a, _ in nodes.items() if leave(a, b) and a >= last and b > last]
        entered = [NONE if begin == 0 else self._code(x, begin) for x in enter]
        return [(entered[i], NONE if stop == end else self._code(x, stop)) for x, mask in out for i in range(len(enter)) if mask >> i & 1]

    @staticmethod
    def _code(piece: tuple[int, int], cut: int) -> int:
        return (cut - piece[0]) * _WIDE + piece[1] - cut

    def trace(self, text: str, begin: int, stop: int, entered: int, left: int) -> np.ndarray:
        """The ids of the pieces that start in the chunk text[begin:stop], given its states."""
        end = len(text)
        before = (0, 0) if begin == 0 else (begin - entered // _WIDE, begin + entered % _WIDE)
        if before[1] >= stop:
            return np.empty(0, "<i4")
        edges = self._edges(text, begin, stop)
        first, last = edges or (stop, before[1])
        out: list[np.ndarray] = []
        if edges is not None:
            if before[1] < first:
                p = Paths(self.v, text, [before], first, first)
                (start,) = p.at[first]
                out.append(np.array(self.v.ids(p.back(start, first, 0)), "<i4"))
            out += self.marked([text[first:last]])
            before = (last, last)
        p = Paths(self.v, text, [before], stop, end)
        if stop == end:
            (start,), to = p.at[end], end
        else:
            start, to = stop - left // _WIDE, stop + left % _WIDE
        out.append(np.array(self.v.ids(p.back(start, to, 0)), "<i4"))
        return np.concatenate(out)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states_at_cuts(entries: list[list[tuple[int, int]]]) -> list[int]:
    """The states at the cuts around and between the chunks of one document, whose matrices' finite entries these are."""
    cuts = [sorted({a for a, _ in entries[0]})]
    for i, m in enumerate(entries):
        cuts.append(sorted({b for _, b in m} | ({a for a, _ in entries[i + 1]} if i + 1 < len(entries) else set())))
    level = []
    for m, rows, columns in zip(entries, cuts[:-1], cuts[1:], strict=True):
        x = np.full((len(rows), len(columns)), -np.inf, np.float32)
        for a, b in m:
            x[rows.index(a), columns.index(b)] = 0
        level.append(x)
    levels = [level]
    while len(level) > 1:
        level = [times(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        levels.append(level)
    at = [0, int(np.argmax(levels[-1][0][0]))]
    for level in levels[-2::-1]:  # a cut in the middle of each pair, between those of the level above
        finer = [at[0]]
        for i in range(0, len(level), 2):
            if i + 1 < len(level):
                finer.append(int(np.argmax(level[i][finer[-1]] + level[i + 1][:, at[i // 2 + 1]])))
            finer.append(at[i // 2 + 1])
        at = finer
    return [states[i] for states, i in zip(cuts, at, strict=True)]


def load(model_file: str) -> tuple[list[tuple[str, float, int]], list[int]]:
    """Ordinary pieces and byte pieces of a SentencePiece BPE model file."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    model = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto())
    n = model.normalizer_spec
    if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback:
        raise ValueError("the model file must be a BPE model with byte pieces")
    if n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model file must normalise by the identity with a space mark in front")
    pieces, byte_ids = [], [0] * 256
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[1:-1], 16)] = i
        elif model.pieces[i].type == model.pieces[i].NORMAL:
            pieces.append((sp.id_to_piece(i), sp.get_score(i), i))
        elif not (sp.is_control(i) or sp.is_unknown(i)):
            raise ValueError("the model file has pieces of other kinds")
    if any(_EDGE.search(p) for p, _, _ in pieces):
        raise ValueError("a piece goes over a space mark")
    return pieces, byte_ids


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_KEY = "k1 long, k2 int"
Batches = Iterator[pa.RecordBatch]


def _cut(chunk: int, longest: int) -> Callable[[Batches], Batches]:
    """Texts to chunks, each with its neighbourhood as far as a piece can reach."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                marked = SPACE + text.decode("utf-8", "replace").replace(" ", SPACE)
                for number, at in enumerate(range(0, len(marked), chunk)):
                    begin = max(0, at - longest)
                    row = [[k1], [k2], [number], [marked[begin : at + chunk + longest]], [at - begin], [min(at + chunk, len(marked)) - begin]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["k1", "k2", "chunk", "piece", "begin", "stop"])

    return run


def _combined(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    found = states_at_cuts([list(zip(a, b, strict=True)) for a, b in zip(table.column("entered").to_pylist(), table.column("leaving").to_pylist(), strict=True)])
    n = len(table)
    columns = [pa.array([k.as_py()] * n, t) for k, t in zip(key, (pa.int64(), pa.int32()), strict=True)]
    return pa.table([*columns, table.column("chunk"), pa.array(found[:-1], pa.int32()), pa.array(found[1:], pa.int32())], ["k1", "k2", "chunk", "enter", "leave"])


def giant_ids(texts: DataFrame, model: tuple, chunk: int = CHUNK) -> DataFrame:
    """(k1, k2, ids) of every different text of (k1, k2, text); ids are packed 32-bit numbers."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    longest = max(len(p) for p, _, _ in model[0])
    row = F.first(F.struct("piece", "begin", "stop")).alias("x")
    # equal texts have equal chunks: one of each goes on, each to a task of its own
    cut = texts.mapInArrow(_cut(chunk, longest), f"{_KEY}, chunk int, piece string, begin int, stop int").groupBy("k1", "k2", "chunk").agg(row)
    chunks = keep(cut.select("k1", "k2", "chunk", "x.piece", "x.begin", "x.stop"), "giant-chunks")

    def transfers(batches: Batches) -> Batches:
        e = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            found = [e.transfer(text.decode(), begin, stop) for text, begin, stop in zip(utf8(batch.column(3)), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            lists = [pa.array([[x[i] for x in m] for m in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["k1", "k2", "chunk", "entered", "leaving"])

    def traced(batches: Batches) -> Batches:
        e = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            numbers = [batch.column(i).to_pylist() for i in (4, 5, 6, 7)]
            ids = [e.trace(text.decode(), *x).tobytes() for text, *x in zip(utf8(batch.column(3)), *numbers, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["k1", "k2", "chunk", "ids"])

    def put_together(key: tuple, table: pa.Table) -> pa.Table:
        ids = b"".join(x.as_py() for x in table.sort_by("chunk").column("ids"))
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([ids], pa.binary())], ["k1", "k2", "ids"])

    matrices = chunks.mapInArrow(transfers, f"{_KEY}, chunk int, entered array<int>, leaving array<int>")
    states = matrices.groupBy("k1", "k2").applyInArrow(_combined, f"{_KEY}, chunk int, enter int, leave int")
    both = chunks.join(states, ["k1", "k2", "chunk"]).select("k1", "k2", "chunk", "piece", "begin", "stop", "enter", "leave")
    return both.mapInArrow(traced, f"{_KEY}, chunk int, ids binary").groupBy("k1", "k2").applyInArrow(put_together, f"{_KEY}, ids binary")


def _groups(texts: Iterable[bytes]) -> Iterator[list[str]]:
    """Texts in lists of about _GROUP bytes."""
    some: list[str] = []
    held = 0
    for t in texts:
        some.append(t.decode("utf-8", "replace"))
        held += len(t)
        if held >= _GROUP:
            yield some
            some, held = [], 0
    if some:
        yield some


def encoded(docs: DataFrame, model_file: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_pieces, ids): the pieces of every whole text."""
    return _encoded(docs, model_file, chunk, digest=False)


def round_trip(docs: DataFrame, model_file: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Encode and decode every whole text: its pieces counted and hashed, and the decoded text's hash."""
    return _encoded(docs, model_file, chunk, digest=True)


def _encoded(docs: DataFrame, model_file: str | None, chunk: int, digest: bool) -> DataFrame:
    model = load(model_file or default_model())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    giant = F.octet_length("text") > chunk

    def told(ids: pa.Array, found: list[np.ndarray], texts: list[str] | None, e: Encoder) -> pa.RecordBatch:
        n = pa.array([len(x) for x in found], pa.int64())
        if not digest:
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([*found, np.empty(0, "<i4")]), pa.int32()))
            return pa.RecordBatch.from_arrays([ids, n, lists], ["doc_id", "n_pieces", "ids"])
        back = [e.decode(x) if len(x) else "" for x in found]
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in back]
        columns = [ids, pa.array([len(t) for t in texts or back], pa.int64()), n, pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()), pa.array(sha, pa.string())]
        exact = pa.array([a == b for a, b in zip(texts, back, strict=True)] if texts is not None else sha, pa.bool_() if texts is not None else pa.string())
        return pa.RecordBatch.from_arrays([*columns, exact], ["doc_id", "n_chars", "n_pieces", "ids_sha256", "decoded_sha256", "exact"])

    def whole(batches: Batches) -> Batches:
        e = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            at = 0
            for texts in _groups(utf8(batch.column(1))):
                yield told(batch.column(0).slice(at, len(texts)), e.encode_all(texts), texts, e)
                at += len(texts)

    def finished(batches: Batches) -> Batches:
        e = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            for i in range(len(batch)):
                part = told(batch.column(0).slice(i, 1), [np.frombuffer(batch.column(2)[i].as_py(), "<i4")], None, e)
                if digest:
                    part = part.set_column(5, "exact", pa.array([part.column(4)[0].as_py() == batch.column(1)[i].as_py()], pa.bool_()))
                yield part

    schema = "doc_id long, n_chars long, n_pieces long, ids_sha256 string, decoded_sha256 string, exact boolean" if digest else "doc_id long, n_pieces long, ids array<int>"
    keyed = rows.where(giant).select("doc_id", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), "text")
    ids = giant_ids(keyed.select("k1", "k2", "text"), model, chunk)
    of_giants = keyed.select("doc_id", F.sha2("text", 256).alias("sha"), "k1", "k2").join(ids, ["k1", "k2"]).select("doc_id", "sha", "ids")
    return rows.where(~giant).mapInArrow(whole, schema).union(of_giants.mapInArrow(finished, schema))
