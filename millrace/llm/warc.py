"""WARC archives: a writer, and a reader that salvages what follows a damaged place.

Each record is a gzip member of its own. The reader checks the member, the version line, the headers, the
length, the closing blank lines and the digests. Where a check fails it searches for the next gzip member or
version line from which a whole record can be read, goes on there and logs the bytes between as a gap. A member of several
records is unpacked as a stream and salvaged in the same way inside: its good records come out, whichever of them is damaged.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import narrow, pieces, raw, written
from millrace.session import scratch_folder

#: Bytes after which a task opens its next archive; least payload that a later copy refers to.
ARCHIVE_BYTES, REVISIT_BYTES = 32_000_000, 1_000
#: Bytes asked of a file at a time, and the most that one record may hold (a longer one is a gap).
CHUNK, RECORD_BYTES = 1 << 20, 1 << 30
#: Bytes behind the place at hand in which the next member is looked for when a long member turns out to be damaged, and bytes
#: of records that wait for their member's end, which tells its length.
BEHIND, WAITING = 16 << 20, 8 << 20

_PAGE = "urn:page:"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_NEXT = re.compile(re.escape(_MAGIC) + b"|" + re.escape(_VERSION))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder and the path in it. Takes ``file:/x`` as Hadoop writes it."""
    if folder.startswith("/"):
        return pa.fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(folder)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record(kind: str, page: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One uncompressed record. A revisit holds the response's head, with its length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_PAGE}{page}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{_PAGE}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: {sha1(payload)}", f"WARC-Block-Digest: {sha1(block)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``pages(id, html)`` -> ``(id, digest, refers_to)`` of the rows that another row stands for.

    Only digests are shuffled, and counted before that, so copies of one payload may be any share of the rows.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    prints = pages.select("id", F.sha1(body).alias("digest"), F.octet_length(body).alias("size")).where(F.col("size") >= least_bytes)
    groups = prints.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = prints.join(groups, "digest").where("refers_to is not null and (id is null or id < refers_to)")
    return found.select("id", "digest", "refers_to").distinct()


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = REVISIT_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row and return the archives ``(path, records)``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest id is the response
    and the others revisit it; a row with that same id is a response as well. A null html is an empty payload; a null url
    gives no target; a null id is written as ``none``. A task that runs again writes archives of new names;
    only those of its last run are returned. An empty table gives no archives.
    """
    rows = narrow(pages, id=id_col, url=url_col, html=html_col)
    copies = revisits(rows, least_bytes)
    held = rows.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    same = held.id.eqNullSafe(copies.id) & (held.digest == copies.digest)
    marked = held.join(copies, same, "left").select(
        held.id.cast("string").alias("id"), "url", F.col("html").alias("text"), F.col("refers_to").cast("string").alias("refers_to")
    )

    def run(batches):
        fs, root = opened(folder)
        stem, number, path, out, size, count = uuid.uuid4().hex, 0, "", None, 0, 0
        for batch in batches:
            for piece in pieces(batch):
                columns = [piece.column(c).to_pylist() for c in ("id", "url", "refers_to")]
                for page, url, first, payload in zip(*columns, raw(piece)):
                    if out is None:
                        path = f"{root}/{stem}-{number:05d}.warc.gz"
                        out, number, size, count = fs.open_output_stream(path, compression=None), number + 1, 0, 0
                    kind = "response" if first is None else "revisit"
                    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
                    member = packer.compress(record(kind, page or "none", url, payload, first, date)) + packer.flush()
                    out.write(member)
                    size, count = size + len(member), count + 1
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{stem}-{number - 1:05d}.warc.gz"], "records": [count]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{stem}-{number - 1:05d}.warc.gz"], "records": [count]})

    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    return written(marked.mapInArrow(run, "path string, records long"), "archives")


class Record(NamedTuple):
    offset: int
    length: int | None  # of its bytes or its member; None: the member is damaged or long
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    offset: int
    length: int | None
    reason: str


class Damage(ValueError):
    """A check that failed."""


def _headers(data: bytes, start: int) -> tuple[dict[str, str], int]:
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        raise Damage("headers do not end")
    lines = data[start:end].decode("utf-8", "replace").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Damage("no version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damage("bad header line")
        headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdecimal() or "warc-type" not in headers or "warc-record-id" not in headers:
        raise Damage("header missing")
    return headers, end + 4


def _checked(headers: dict[str, str], block: bytes) -> None:
    for name, data in (("warc-block-digest", block), ("warc-payload-digest", _payload(block))):
        want = headers.get(name, "")
        if name == "warc-payload-digest" and (headers["warc-type"] != "response" or not block.startswith(b"HTTP/")):
            continue
        if want.startswith("sha1:") and want != sha1(data):
            raise Damage("digest differs")


def _payload(block: bytes) -> bytes:
    return block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") and b"\r\n\r\n" in block else block


class _Unpacked:
    """What the gzip member at the start of a reader's bytes holds, as a stream; ends at the member's end or where it is damaged."""

    def __init__(self, reader: Salvage):
        self.reader, self.at = reader, reader.base
        self.unpack, self.out, self.failed = zlib.decompressobj(31), b"", None

    def read(self, n: int) -> bytes:
        reader = self.reader
        while not self.out and not self.unpack.eof and not self.failed:
            place = self.at - reader.base
            if place >= len(reader.data) and not reader._more():
                self.failed = "member is cut off"
                break
            step = reader.data[place : place + reader.chunk]
            before = self.unpack.copy()
            try:
                self.out = self.unpack.decompress(step, 4 * reader.chunk)
                self.at += len(step) - len(self.unpack.unconsumed_tail) - len(self.unpack.unused_data)
            except zlib.error:
                self.failed, self.out = "bad member", self._until_damage(before, step)
            reader._drop(self.at - BEHIND - reader.base)
        piece, self.out = self.out[:n], self.out[n:]
        return piece

    def _until_damage(self, unpack, step: bytes) -> bytes:
        out = []
        try:
            for k in range(len(step)):
                out.append(unpack.decompress(step[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(out)


class Salvage:
    """Records and gaps of one byte stream, in order; holds about one record at a time.

    ``packed``: gzip members are looked for, not only version lines. Records out of a damaged member are handed on if they state a
    block digest and have it; the member's bytes are a gap all the same.
    """

    def __init__(self, stream, chunk: int = CHUNK, most: int = RECORD_BYTES, packed: bool = True):
        self.stream, self.chunk, self.most = stream, chunk, most
        self.data, self.base, self.over = b"", 0, False
        self.packed, self.next = packed, _NEXT if packed else re.compile(re.escape(_VERSION))
        self.damage: tuple[int, str] | None = None
        self.read: set[str] = set()  # records out of the damaged member that is searched for more

    def _more(self) -> bool:
        if not self.over:
            # grow by at least what is held, so that a long record is not copied once per chunk
            got = self.stream.read(max(self.chunk, len(self.data)))
            self.over = not got
            self.data += got
        return not self.over

    def _drop(self, n: int) -> None:
        if n > 0:
            self.data, self.base = self.data[n:], self.base + n

    def _seek(self) -> None:
        """On to the next place that a record could start at, or to the end."""
        self._drop(1)
        while (found := self.next.search(self.data)) is None:
            if not self._more():
                self._drop(len(self.data))
                return
            self._drop(len(self.data) - len(_VERSION) - max(self.chunk, 1))
        self._drop(found.start())

    def _plain(self) -> Iterator[Record]:
        while self.data.find(b"\r\n\r\n") < 0:
            if len(self.data) > self.most or not self._more():
                raise Damage("headers do not end")
        headers, start = _headers(self.data, 0)
        end = start + int(headers["content-length"])
        if end + 4 > self.most:
            raise Damage("record too long")
        while len(self.data) < end + 4:
            if not self._more():
                raise Damage("record is cut off")
        if self.data[end : end + 4] != b"\r\n\r\n":
            raise Damage("record does not close")
        _checked(headers, self.data[start:end])
        if headers["warc-record-id"] in self.read:  # a member may hold its records as they are
            raise Damage("read before")
        found = Record(self.base, end + 4, headers, self.data[start:end])
        self._drop(end + 4)
        yield found

    def _member(self) -> Iterator[Record | Gap]:
        member = _Unpacked(self)
        inside = iter(Salvage(member, self.chunk, self.most, packed=False))
        start, held, size, first, reason = self.base, [], 0, True, ""
        for found in inside:
            if isinstance(found, Gap):
                reason = found.reason
                found = Gap(start, None, f"{reason}; bytes {found.offset} to {found.offset + found.length} of the unpacked member")
            elif member.failed and not found.headers.get("warc-block-digest", "").startswith("sha1:"):
                continue
            else:
                first, size = False, size + len(found.block)
                found = found._replace(offset=start, length=None)
            held.append(found)
            if size > WAITING and not first:
                yield from held
                held, size = [], 0
        if first:
            self._back(start)
            raise Damage(member.failed or reason or "empty member")
        if member.failed:
            for found in held:
                if isinstance(found, Record):
                    self.read.add(found.headers["warc-record-id"])
                    yield found
            self.damage = (start, member.failed)
            self._back(start)
            self._seek()
            return
        self.read.clear()
        for found in held:
            yield found._replace(length=member.at - start)
        self._drop(member.at - self.base)

    def _back(self, start: int) -> None:
        """The bytes that are held begin at ``start`` or, if a long member had them dropped, later."""
        if self.base < start:
            self._drop(start - self.base)

    def _here(self) -> Iterator[Record | Gap]:
        while len(self.data) < len(_VERSION) and self._more():
            pass
        if self.packed and self.data.startswith(_MAGIC):
            return self._member()
        if self.data.startswith(_VERSION):
            return self._plain()
        raise Damage("no record starts here")

    def __iter__(self) -> Iterator[Record | Gap]:
        while self.data or self._more():
            try:
                here = self._here()
                first = next(here)
            except Damage as e:
                self.damage = self.damage or (self.base, str(e))
                self._seek()
                continue
            if self.damage:
                yield Gap(self.damage[0], first.offset - self.damage[0], self.damage[1])
                self.damage = None
            yield first
            yield from here
        if self.damage:
            yield Gap(self.damage[0], self.base - self.damage[0], self.damage[1])


def read_warc(archives: DataFrame, path_col: str = "path", payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives in a column of paths.

    Columns: ``path, offset, length`` (compressed bytes; null for records out of a damaged or long member), ``gap`` (the
    failed check; null for a record),
    ``record_type, record_id, target, refers_to, payload_digest`` (lower-case hex SHA-1), ``payload_bytes`` (of the
    full payload, also for a revisit) and, if wanted, ``payload``. Null paths are skipped.
    """
    names = ["path", "offset", "length", "gap", "record_type", "record_id", "target", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 6 + [pa.int64(), pa.binary()]

    def rows(path: str) -> Iterator[tuple]:
        fs, inner = opened(path)
        with fs.open_input_stream(inner, compression=None) as stream:
            for found in Salvage(stream):
                if isinstance(found, Gap):
                    yield path, found.offset, found.length, found.reason, *[None] * 7
                    continue
                h, payload = found.headers, _payload(found.block)
                digest, size = hashlib.sha1(payload, usedforsecurity=False).hexdigest(), len(payload)
                if h["warc-type"] == "revisit":
                    stated = h.get("warc-payload-digest", "")
                    digest = base64.b32decode(stated.removeprefix("sha1:")).hex() if stated.startswith("sha1:") else None
                    length = re.search(rb"\r\ncontent-length:[ \t]*([0-9]+)", found.block, re.IGNORECASE)
                    size = int(length[1]) if length else None
                target = h.get("warc-target-uri")
                target = target and target.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                ids = [x and x.strip("<>") for x in (h["warc-record-id"], h.get("warc-refers-to"))]
                yield path, found.offset, found.length, None, h["warc-type"], ids[0], target, ids[1], digest, size, payload if payloads else None

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for row in rows(path) if path else ():
                    held.append(row)
                    size += len(row[-1] or b"")
                    if len(held) >= 2_000 or size >= 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    spread = narrow(archives, path=path_col).repartition(parts(archives.sparkSession), "path")
    kinds = "path string, offset long, length long, gap string, record_type string, record_id string, target string"
    return spread.mapInArrow(run, f"{kinds}, refers_to string, payload_digest string, payload_bytes long, payload binary")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages and read them back: ``(<id_col>, payload_bytes, payload_digest, record_type, refers_to)``.

    A page whose record cannot be read back whole (one of over ``RECORD_BYTES``) is an error.
    """
    archives = write_warc(pages, scratch_folder(pages.sparkSession, "warc"), id_col, url_col, html_col)
    found = read_warc(archives, payloads=False)
    # a gap in an archive just written would be a lost page
    lost = F.raise_error(F.concat_ws(" ", F.lit("gap in"), "path", F.lit("at"), F.col("offset").cast("string"), "gap")).cast("boolean")
    found = found.where(F.when(F.col("gap").isNotNull(), lost).otherwise(True))
    kind = narrow(pages, id=id_col).schema["id"].dataType.simpleString()

    def page(name: str):
        text = F.substr(F.col(name), F.lit(len(_PAGE) + 1))
        return F.when(text != "none", text).cast(kind)

    return found.select(
        page("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
