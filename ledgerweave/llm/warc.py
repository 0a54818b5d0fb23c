"""WARC files: a writer, and a reader that salvages what damaged files still hold.

The reader takes one file per task and streams it through a window, so that its memory is bounded by
the largest record or gzip member, not by the file. Two layouts are read, also mixed: gzip members of one or more records, and plain
records. A record is taken if all checks pass: the member inflates and its CRC and size agree; the
version line and header are well formed (header lines may be folded, and may be of any length); Content-Length fits; the record ends
as it must; and its block digest agrees, if it has one (of any algorithm of hashlib, in hex, Base32 or Base64, in any case; others aren't
checked). After a failed check the reader searches on from the next byte
for the next valid member (it starts with the gzip magic, inflates with the right CRC and holds a
record) or the next version line whose record passes, wherever it stands, as the record before
may lack its end, and goes on there. The bytes in between are
quarantined: they are logged as one gap with the reason of the failure.

Result of `salvage`: (file, kind, offset, length, reason, type, uri, headers, payload); kind is
"record" or "gap"; headers has the values of each name in their order. Defined results: an empty file has neither; a file without any
valid record is one gap; a truncated last record is a gap up to the end of the file. Records of one member have its offset and
length; what fails within a member of which other records pass is a gap with the member's offset and length, and its
place in the inflated bytes is in the reason. A null path, a path of no known kind, and one at which there is no file that may be read are
gaps with offset 0 and without length; other errors of reading fail the task, so that Spark tries again. Repeated
paths are read repeatedly. Other columns of `files` don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import shared_dir

VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.[0-9])\r\n")
FIELD = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+:[^\x00-\x08\x0a-\x1f\x7f]*")
FOLDED = re.compile(rb"[ \t][^\x00-\x08\x0a-\x1f\x7f]*")
BEGUN = re.compile(rb"[^\x00-\x08\x0a-\x0c\x0e-\x1f\x7f]*")
MAGIC = b"\x1f\x8b\x08"
WINDOW = 4 << 20
RESULT = "file string, kind string, offset long, length long, reason string, type string, uri string, headers map<string,array<string>>, payload binary"


class Bad(Exception):
    """A check that failed."""


def _sha1(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def record_bytes(kind: str, uri: str | None, body: bytes, extra: dict[str, str] | None = None) -> bytes:
    head = {"WARC-Type": kind, "Content-Length": str(len(body)), "WARC-Block-Digest": _sha1(body)}
    if uri is not None:
        head["WARC-Target-URI"] = uri
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in (head | (extra or {})).items()) + b"\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Source:
    """A file read forwards through a window of bytes that are still needed."""

    def __init__(self, handle, window: int = WINDOW, total: int | None = None):
        self.handle, self.window, self.total, self.base, self.buf, self.ended = handle, window, total, 0, b"", False

    def need(self, at: int, n: int) -> bool:
        """Has bytes at..at+n-1 in the window, as far as the file goes; whether all are there."""
        parts, have = [self.buf], self.base + len(self.buf)
        while have < at + n and not self.ended:
            more = self.handle.read(max(self.window, at + n - have))
            self.ended = not more
            parts.append(more)
            have += len(more)
        if len(parts) > 1:
            self.buf = b"".join(parts)
        return have >= at + n

    def drop(self, to: int) -> None:
        if to - self.base > self.window:
            self.buf, self.base = self.buf[to - self.base :], to

    def view(self, at: int, n: int) -> bytes:
        self.need(at, n)
        return self.buf[at - self.base : at - self.base + n]

    def find(self, pattern: re.Pattern, at: int, margin: int) -> int:
        """Place of the next match at or after `at`; -1 if there is none."""
        while True:
            whole = self.need(at, self.window)
            hit = pattern.search(self.buf, at - self.base)
            if hit and (hit.start() < len(self.buf) - margin or self.ended):
                return self.base + hit.start()
            if not whole:
                self.need(at, len(self.buf) + self.window)
                if self.ended:
                    hit = pattern.search(self.buf, at - self.base)
                    return self.base + hit.start() if hit else -1
            at = max(at, self.base + len(self.buf) - margin)
            self.drop(at)


Fields = dict[str, list[str]]


def first(fields: Fields, name: str) -> str | None:
    return next((v[0] for k, v in fields.items() if k.lower() == name), None)


def lines_of(head: bytes) -> list[bytes]:
    """Header lines after the version line, unfolded."""
    out: list[bytes] = []
    for line in head.split(b"\r\n")[1:]:
        if out and FOLDED.fullmatch(line):
            out[-1] += b" " + line.strip(b" \t")
        elif FIELD.fullmatch(line):
            out.append(line)
        else:
            raise Bad("malformed header line")
    return out


def header(data: bytes, at: int = 0) -> tuple[Fields, int]:
    """Header fields of the record at `at`, and where its block begins."""
    if not VERSION.match(data, at):
        raise Bad("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Bad("header without end")
    fields: Fields = {}
    for line in lines_of(data[at:end]):
        try:
            name, _, value = line.decode().partition(":")
        except UnicodeDecodeError:
            raise Bad("malformed header line") from None
        fields.setdefault(name, []).append(value.strip())
    if not re.fullmatch("[0-9]+", first(fields, "content-length") or "") or first(fields, "warc-type") is None:
        raise Bad("Content-Length or WARC-Type missing")
    return fields, end + 4


def checked(fields: Fields, body: bytes) -> bytes:
    name, _, want = (first(fields, "warc-block-digest") or "").partition(":")
    name, want = name.strip().lower(), want.strip()
    name = name if name in hashlib.algorithms_guaranteed else name.replace("-", "")
    if name in hashlib.algorithms_guaranteed and not name.startswith("shake") and want:
        have = hashlib.new(name, body).digest()
        plain = want.rstrip("=")
        if want.lower() != have.hex() and plain.upper() != base64.b32encode(have).decode().rstrip("=") and plain != base64.b64encode(have).decode().rstrip("="):
            raise Bad("digest differs")
    return body


def member(src: Source, at: int) -> tuple[bytes, int]:
    """What the gzip member at `at` holds, and its end."""
    if src.view(at, 3) != MAGIC:
        raise Bad("no gzip member")
    z, out, pos = zlib.decompressobj(31), [], at
    begun = b""
    while not z.eof:
        piece = src.view(pos, 1 << 16)
        if not piece:
            raise Bad("truncated member")
        try:
            got = z.decompress(piece)
        except zlib.error:
            raise Bad("member doesn't inflate or its CRC differs") from None
        pos += len(piece) - len(z.unused_data)
        if len(begun) < 5:
            begun += got[:5]
            if not b"WARC/".startswith(begun[:5]):
                raise Bad("no version line")
        out.append(got)
    return b"".join(out), pos


def plain_record(src: Source, at: int) -> tuple[Fields, bytes, int]:
    if not VERSION.match(src.view(at, 16)):
        raise Bad("no version line")
    n = 8192
    while (end := (head := src.view(at, n)).find(b"\r\n\r\n")) < 0:
        # read on only as long as all that is there could be a header
        whole = head.rfind(b"\r\n")
        lines_of(head[:whole])
        if len(head) < n or not BEGUN.fullmatch(head[whole + 2 :].removesuffix(b"\r")):
            raise Bad("header without end")
        n *= 2
    fields, begin = header(head[: end + 4])
    size = int(first(fields, "content-length"))
    if src.total is not None and at + begin + size + 4 > src.total or not src.need(at, begin + size + 4):
        raise Bad("truncated record")
    if src.view(at + begin + size, 4) != b"\r\n\r\n":
        raise Bad("Content-Length differs")
    return fields, checked(fields, src.view(at + begin, size)), at + begin + size + 4


EITHER = re.compile(rb"\x1f\x8b\x08|" + VERSION.pattern)


Found = tuple[str, int, int, str | None, Fields | None, bytes | None]


def within(data: bytes, at: int, length: int) -> list[Found]:
    """What the member at `at` holds, if any of it is a record."""
    found = list(read_records(io.BytesIO(data), WINDOW, len(data), zipped=False))
    if all(kind == "gap" for kind, *_ in found):
        raise Bad(found[0][3] if found else "empty member")
    return [(kind, at, length, reason and f"{reason} (bytes {a} to {a + n} of the inflated member)", fields, body) for kind, a, n, reason, fields, body in found]


def read_records(handle, window: int = WINDOW, total: int | None = None, zipped: bool = True) -> Iterator[Found]:
    """(kind, offset, length, reason, headers, block) for all bytes of a file, in order. total: its size, if known.
    zipped: whether gzip members are looked for."""
    src, at = Source(handle, window, total), 0
    gap, reason = -1, ""
    while src.need(at, 1):
        try:
            if zipped and src.view(at, 1) == MAGIC[:1]:
                data, end = member(src, at)
                found = within(data, at, end - at)
            else:
                fields, body, end = plain_record(src, at)
                found = [("record", at, end - at, None, fields, body)]
        except Bad as bad:
            if gap < 0:
                gap, reason = at, str(bad)
            at = src.find(EITHER if zipped else VERSION, at + 1, 16)
            if at < 0:
                break
            src.drop(at)
            continue
        if gap >= 0:
            yield "gap", gap, at - gap, reason, None, None
            gap = -1
        yield from found
        at = end
        src.drop(at)
    if gap >= 0:
        yield "gap", gap, src.base + len(src.buf) - gap, reason, None, None


def opened(path: str | None):
    """(stream, size, None), or (None, None, the reason why there is none)."""
    if path is None:
        return None, None, "no path"
    try:
        fs, own = pafs.FileSystem.from_uri(path)
        info = fs.get_file_info(own)
        if info.type != pafs.FileType.File:
            return None, None, "no such file"
        return fs.open_input_stream(own, compression=None), info.size, None
    except (pa.ArrowInvalid, FileNotFoundError, PermissionError) as e:
        return None, None, f"{type(e).__name__}: {e}"[:200]


def salvage(spark: SparkSession, files: DataFrame, window: int = WINDOW) -> DataFrame:
    """files has a column `path` of URIs, one task for a few files each; see the module for the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "kind", "offset", "length", "reason", "type", "uri", "headers", "payload"]
        schema = pa.schema(list(zip(names, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.list_(pa.string())), pa.binary()))))

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                handle, total, why = opened(path)
                if handle is None:
                    yield packed([(path, "gap", 0, None, why, None, None, None, None)])
                    continue
                rows, size = [], 0
                with handle:
                    for kind, offset, length, reason, fields, body in read_records(handle, window, total):
                        known = fields or {}
                        rows.append((path, kind, offset, length, reason, first(known, "warc-type"), first(known, "warc-target-uri"), list(fields.items()) if fields is not None else None, body))
                        size += len(body or b"")
                        if size > 8 << 20 or len(rows) >= 4096:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    return files.select(F.col("path").cast("string")).mapInArrow(run, RESULT)


def encoded(page: int | None, url: str | None, html: str | None, zipped: bool, damage: bool) -> bytes:
    """A page's record as it is written. With damage, records are hurt in three ways, chosen by page_id: a byte in the middle
    is changed; the last third is missing; the record is preceded by bytes that are no record."""
    body = (html or "").encode()
    data = record_bytes("resource", url, body, {"X-Page-Id": "" if page is None else str(page), "X-Null": str(int(html is None))})
    data = gzip_member(data) if zipped else data
    kind = page % 29 if damage and page is not None else 0
    if kind == 3:
        k = len(data) - 12 if not zipped else len(data) // 2
        return data[:k] + bytes([data[k] ^ 0x55]) + data[k + 1 :]
    return data[: 2 * len(data) // 3] if kind == 11 else b"\x00\x1f\x8b\x08WARC/1.0 no record\n" + data if kind == 19 else data


def write_pages(spark: SparkSession, pages: DataFrame, folder: str, damage: bool = False) -> DataFrame:
    """Writes pages as WARC files, alternately with gzip members and plain, and returns their paths (saved by the write). damage:
    see encoded()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, own = pafs.FileSystem.from_uri(folder)
        fs.create_dir(own)
        name, zipped, any_row = f"part-{number:05d}-{attempt}.warc", number % 2 == 0, False
        with fs.open_output_stream(f"{own}/{name}") as out:
            for batch in batches:
                for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    any_row = True
                    out.write(encoded(page, url, html, zipped, damage))
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

    thin = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    paths = f"{folder}-paths"
    thin.mapInArrow(run, "path string").write.parquet(paths)  # one execution: retried tasks write files of their own, and only the paths of those that succeed are listed
    return spark.read.schema("path string").parquet(paths)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written to damaged WARC files in the shared folder and read again: every record and gap with its place, and the page
    that the record holds."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex[:12]}"
    found = salvage(spark, write_pages(spark, pages, folder, damage=True))

    def field(name: str) -> Column:
        return F.get(F.col("headers")[name], F.lit(0))

    html = F.when(field("X-Null") == "1", F.lit(None)).otherwise(F.col("payload").cast("string"))
    page = F.when(field("X-Page-Id") != "", field("X-Page-Id").cast("long"))
    return found.select("kind", "file", "offset", "length", "reason", page.alias("page_id"), F.col("uri").alias("url"), html.alias("html"))


#: The rows of salvaged_pages, which leaves out the places.
SQL = """
SELECT 'record' AS kind, page_id, url, html FROM pages WHERE page_id IS NULL OR page_id % 29 NOT IN (3, 11)
UNION ALL SELECT 'gap', NULL, NULL, NULL FROM pages WHERE page_id % 29 IN (3, 11, 19)
"""
