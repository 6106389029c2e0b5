"""WARC archives written and read as streams, through a chunked record table.

Archives are .warc.gz: one gzip member per record, as the standard has it.

Writing: equal payloads are found by their digest, and the one with the largest page_id
is a response record, the others are revisits that refer to it. A payload goes to the
writer as rows of (page, chunk number, piece) in order, of at most ``CHUNK`` bytes, and is
compressed and digested piece by piece; at its end the running digest must be the one
in the header. Each task writes its records to archives of its own in the shared folder (a new one after ``ROLL`` bytes)
and returns their paths; what a lost or repeated attempt has written is in no list and
so is never read.

Reading: every archive is read as a stream. A record's payload becomes rows of
(archive, record number, chunk number, ...) of at most ``CHUNK`` bytes, each with the
payload's length and SHA-1 so far, so that no step holds a whole record and any prefix
can be verified. The last chunk of a record holds its digest, and if that is the one in
its header (``verified``, null where none is stated); a record of this writer that
differs is an error. Archives of others are read too: WARC 1.0 and 1.1, every record
type, folded header lines, blocks that are no HTTP messages (the payload is the block),
missing digests. Chunks carry the record's own id and its target.

Defined cases: a null html is an empty payload. A null url is left out of the header; a
null page_id gives a record without a number, and is the response for its payload only
if no page with a number has it. Rows that repeat a page_id and a payload are all
responses if that page_id is the largest, each with an id of its own; revisits of such
tell the page_id they refer to, but no record id. Extra columns are ignored. No pages: no archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.storage import keep, new_path

#: Most payload bytes in a row of the chunk table.
CHUNK = 1 << 18
#: An archive is closed when it has so many bytes.
ROLL = 64 << 20
#: How hard gzip tries.
LEVEL = 4
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
# Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def record_id(page_id: int | None, digest: str) -> str:
    """The id of the response for a payload, which its revisits can tell too."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def info_record(date: str) -> bytes:
    """The record at the beginning of an archive."""
    body = b"software: kinetrace\r\nformat: WARC File Format 1.1\r\n"
    head = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def record_head(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None, revisit: bool, date: str, single: bool = True) -> bytes:
    """Everything of a record before its payload; ``single``: no other row has the response's page_id and payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    own = f"<urn:uuid:{uuid.uuid4()}>" if revisit or not single else record_id(page_id, digest)
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(chr(c) for c in range(33, 127)))}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
        if single:
            lines.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def _chunked(rows: DataFrame) -> DataFrame:
    """Rows with a payload as rows of its pieces, one after another: a task holds a piece, not the record."""
    last = F.greatest(F.ceil(F.col("size") / CHUNK) - 1, F.lit(0)).cast("int")
    numbered = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    return numbered.withColumn("piece", F.substring("payload", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK))).drop("payload")


class _Writer:
    """Archives of one task, written a piece at a time."""

    def __init__(self, folder: str, date: str) -> None:
        self.folder, self.date = folder, date
        self.fs, self.base = _filesystem(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.out, self.records, self.done = None, 0, []

    def begin(self, head: bytes, sha: str, size: int) -> None:
        if self.out is None:
            self.name, self.records = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
            member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            self.out.write(member.compress(info_record(self.date)) + member.flush())
        self.member, self.running, self.left, self.sha = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), hashlib.sha1(), size, sha
        self.out.write(self.member.compress(head))

    def add(self, piece: pa.Buffer) -> None:
        self.running.update(piece)
        self.left -= piece.size
        self.out.write(self.member.compress(piece))

    def end(self) -> None:
        """The running digest over the pieces must be the one that the header has told."""
        if self.left or self.running.hexdigest() != self.sha:
            raise ValueError(f"the pieces of {self.sha} are not its payload")
        self.close_record()

    def close_record(self) -> None:
        self.out.write(self.member.compress(b"\r\n\r\n") + self.member.flush())
        self.records += 1
        if self.out.tell() >= ROLL:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.done.append((f"{self.folder}/{self.name}", self.records, self.out.tell()))
            self.out.close()
            self.out = None


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write every page to archives in ``folder``; the list (archive, records, bytes) of what was written.

    Which pages are responses is settled on digests alone. Payloads move only once, by
    (page_id, digest), so many equal ones don't meet in a task; those of revisits end there.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    known = known.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    each = known.groupBy("sha", "size", "page_id").agg(F.count("*").alias("c"))
    of_payload = each.groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.sum("c").alias("n"), F.max_by("c", "page_id").alias("copies"))
    shared = of_payload.where((F.col("n") > 1) & (F.col("size") >= least)).withColumn("copies", F.coalesce("copies", "n"))
    plain = known.drop("payload").alias("k").join(shared.alias("s"), (F.col("k.sha") == F.col("s.sha")) & (F.col("k.size") == F.col("s.size")))
    revisits = plain.where(~F.col("k.page_id").eqNullSafe(F.col("s.first"))).select("k.page_id", "k.url", "k.sha", "k.size", "s.first", F.col("s.copies") == 1, F.lit(True), F.lit(0), F.lit(b""))
    told = each.alias("k").join(shared.alias("s"), (F.col("k.sha") == F.col("s.sha")) & (F.col("k.size") == F.col("s.size")), "left")
    told = told.where(F.col("s.n").isNull() | F.col("k.page_id").eqNullSafe(F.col("s.first"))).select("k.page_id", "k.sha", "k.size", (F.col("k.c") == 1).alias("single"))
    k, r = known.alias("k"), told.alias("r")
    responses = k.join(r, F.col("k.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("k.sha") == F.col("r.sha")) & (F.col("k.size") == F.col("r.size")))
    responses = responses.select("k.page_id", "k.url", "k.sha", "k.size", F.lit(None).cast("long").alias("first"), "r.single", F.lit(False).alias("revisit"), "k.payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, expected = _Writer(folder, date), 0
        for batch in batches:
            for page, url, sha, size, first, single, revisit, number, piece in zip(*batch.columns, strict=True):
                if number.as_py() != expected:
                    raise ValueError(f"piece {number} stands where {expected} was expected")
                if not expected:
                    digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                    w.begin(record_head(page.as_py(), url.as_py(), size.as_py(), digest, first.as_py(), revisit.as_py(), date, single.as_py()), sha.as_py(), size.as_py())
                if revisit.as_py():
                    w.close_record()
                    continue
                w.add(piece.as_buffer())
                expected += 1
                if not w.left:
                    w.end()
                    expected = 0
        if expected:
            raise ValueError("a payload's pieces end before it does")
        w.close()
        a, n, size = zip(*w.done, strict=True) if w.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(n, pa.int64()), pa.array(size, pa.int64())], ["archive", "records", "bytes"])

    return keep(_chunked(responses).union(revisits).mapInArrow(run, "archive string, records long, bytes long"), "warc-list")


def _fields(lines: Iterator[bytes]) -> dict[str, str]:
    """Header lines up to the empty one; names in lower case, folded lines joined, the first of repeated names."""
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if not text.strip():
            break
        if text[0] in " \t" and name:
            fields[name] = f"{fields[name]} {text.strip()}".strip()
            continue
        key, _, value = text.partition(":")
        name = key.strip().lower()
        fields.setdefault(name, value.strip())
    return fields


def _http_fields(stream: _Lines, most: int) -> tuple[dict[str, str], int]:
    """The header of an HTTP message of at most ``most`` bytes, and the bytes it took."""
    used = 0

    def lines() -> Iterator[bytes]:
        nonlocal used
        first = True
        while used < most and (line := stream.readline(most - used)):
            used += len(line)
            if not first or not line.strip():
                yield line
            first = False

    return _fields(lines()), used


class _Inflated:
    """The bytes of the gzip members of a stream, one after another, a bounded piece at a time; a stream without gzip's mark is read as it is."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.member, self.held = stream, zlib.decompressobj(31), stream.read(1 << 16)
        self.plain = self.held[:2] != b"\x1f\x8b"

    def read(self, n: int) -> bytes:
        if self.plain:
            out, self.held = self.held[:n], self.held[n:]
            return out or self.stream.read(n)
        while True:
            if not self.held:
                self.held = self.stream.read(1 << 16)
                if not self.held:
                    return b""
            out = self.member.decompress(self.held, n)
            self.held = self.member.unconsumed_tail
            if self.member.eof:
                self.held, self.member = self.member.unused_data, zlib.decompressobj(31)
            if out:
                return out


class _Lines:
    """readline() and bounded read() over a stream, with one small buffer."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.rest = _Inflated(stream), b""

    def readline(self, most: int = 1 << 30) -> bytes:
        while (at := self.rest.find(b"\n")) < 0 and len(self.rest) < most:
            more = self.stream.read(1 << 16)
            if not more:
                line, self.rest = self.rest, b""
                return line
            self.rest += more
        at = min(at + 1 if at >= 0 else most, most)
        line, self.rest = self.rest[:at], self.rest[at:]
        return line

    def read(self, n: int) -> bytes:
        if self.rest:
            out, self.rest = self.rest[:n], self.rest[n:]
            return out
        return self.stream.read(n)


def chunk_rows(stream: pa.NativeFile, data: bool, chunk: int = CHUNK) -> Iterator[tuple]:
    """The rows of one archive, without its name (see ``CHUNKS``)."""
    lines, record = _Lines(stream), 0
    while first := lines.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"record {record} begins with {first[:40]!r}")
        head = _fields(iter(lines.readline, b""))
        kind, left = head.get("warc-type", "").lower(), int(head["content-length"])
        http: dict[str, str] = {}
        if head.get("content-type", "").lower().startswith("application/http"):
            http, used = _http_fields(lines, left)
            left -= used
        page, refers = (int(x) if (x := head.get(name)) else None for name in ("x-page-id", "x-refers-to-page-id"))
        algorithm, _, stated = head.get("warc-payload-digest", "").partition(":")
        stated = stated.upper() if algorithm.lower() == "sha1" else None
        named = record, head.get("warc-record-id"), head.get("warc-target-uri")
        sha, size, number = hashlib.sha1(), 0, 0
        while True:
            part = lines.read(min(chunk, left)) if left else b""
            if left and not part:
                raise ValueError("the archive ends within a record")
            left -= len(part)
            size += len(part)
            sha.update(part)
            if kind == "revisit":  # what it holds is no payload
                if left:
                    continue
                length = http.get("content-length", "")
                yield *named, 0, page, kind, refers, int(length) if length.isdigit() else None, stated, None, True, b""
                break
            digest = base64.b32encode(sha.copy().digest()).decode()
            verified = digest == stated if not left and stated else None
            if verified is False and "x-page-id" in head:
                raise ValueError(f"record {record}: payload is {digest}, header says {stated}")
            yield *named, number, page, kind, refers, size, digest, verified, not left, part if data else b""
            number += 1
            if not left:
                break
        record += 1


CHUNKS = (
    "archive string, record long, warc_id string, target string, chunk_no long, page_id long, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, verified boolean, is_last boolean, data binary"
)


def read_chunks(archives: DataFrame, data: bool = True) -> DataFrame:
    """The chunk table of the listed archives; without ``data`` the payloads are verified but not returned."""
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = CHUNKS.replace(",", "").split()[::2]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[x] for x in CHUNKS.replace(",", "").split()[1::2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, path = _filesystem(archive)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for row in chunk_rows(stream, data):
                        rows.append((archive, *row))
                        held += len(row[-1]) + 200
                        if held > 8 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return archives.select("archive").repartition(parts, "archive").mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk, which carries the whole payload's length and digest."""
    return chunks.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back: one row per record."""
    folder = new_path(pages.sparkSession, "warc")
    return records(read_chunks(write_archives(pages, folder), data=False)).where("record_type IN ('response', 'revisit')")


def oracle_sql() -> str:
    """DuckDB SQL for the rows of :func:`warc_round_trip` over ``pages`` (base32 spelled from the hexadecimal digest)."""
    bits = "array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(CAST('0x' || sha[i] AS INTEGER)), 4, '0')), '')"
    code = "array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(bits[5 * i + j] AS INTEGER) * (1 << (5 - j)))) AS INTEGER)]), '')"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT page_id, html, {bits} AS bits FROM p),
k AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {code} AS payload_digest, max(page_id) OVER (PARTITION BY html) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM k"""
