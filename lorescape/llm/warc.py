"""WARC archives: a deduplicating writer and a reader that salvages what it can from damaged files.

Writing. Each page becomes a record whose payload is its HTML in UTF-8. Of records with equal payloads of at least
least_bytes bytes the one with the smallest page_id is a response and the others are revisits of it; the rest are responses.
Each task writes archives of about ARCHIVE_BYTES, one gzip member per record, under names of its own; only those in the
manifest, which Spark commits, count, so a task that is run again leaves no doubles.

Reading. At each place the reader expects a gzip member or a version line, and checks headers, lengths, the end of the
record and its digests. After a failed check it searches for the next member or version line that passes, goes on there, and
reports the bytes between as a gap with the reason. What a member inflates to is searched in the same way while it is
inflated, so a damaged record costs itself alone, and an error of the member what lies behind the last record before it. Of a
member with an error a record is taken if its own block digest passes or a valid record follows it; only a last one without a
digest, for which nothing vouches, is left to the gap. It holds two records and some chunks in memory at a time; a record that claims more than RECORD_BYTES, more than a
row of any table can hold, is treated as damaged, since its length can't be trusted. round_trip() compares the number of records read
with that of the manifest and fails if they differ.

Places count bytes of the file. Records of a member start where it does, and stop where it does or at a place before that;
a gap within a member gives the inflated bytes in its reason.

Defined cases: null and empty HTML have an empty payload, and all of these equal each other; rows that repeat the smallest
page_id of their payload are all responses; an empty table gives no archive and an empty result; an archive without any valid
record is one gap; other columns aren't read, and a null url is written as an empty one; a row without a page_id has a record
whose id is empty, which is read as null, and never is what others refer to. Archives are opened by Arrow, for which s3a, s3n, wasb and
wasbs paths are spelled as it knows those stores; tables are read by Spark.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorescape.llm.shared import drop_path, new_path, saved, slices

ARCHIVE_BYTES = 32 << 20
#: No row of a table can hold more bytes, so no record of one is longer, but for its headers.
RECORD_BYTES = (1 << 31) + (1 << 20)
CHUNK = 1 << 18
PIECE = 1 << 14
FIRST_LINE = 32
#: A side of up to so many rows of about 70 bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000

MEMBER = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
READ = (
    "path string, start long, stop long, problem string, page_id long, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _named(page_id: int | None) -> str:
    return f"<urn:lorescape:page:{'' if page_id is None else page_id}>"


def record(page_id: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not compressed: an HTTP response, or the head of one if it refers to another page's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_named(page_id)}",
        f"WARC-Target-URI: {''.join(url.splitlines())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_named(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


class Found(NamedTuple):
    """A record, or a gap with the reason why its bytes hold none."""

    start: int
    stop: int
    record: Record | None
    problem: str | None

#: Hadoop's names of object stores, and Arrow's; fixed values.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


class Damaged(Exception):
    """A check failed at the current place."""


class Source:
    """Bytes of a stream from a moving place on, read as they are needed."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.data, self.base, self.over = stream, bytearray(), 0, False
        self.no_blank = (0, 0)  # no blank line begins between these places

    def have(self, start: int, n: int) -> bool:
        """Reads on until n bytes from start are there, or the stream ends."""
        while not self.over and len(self.data) < start - self.base + n:
            more = self.stream.read(max(CHUNK, start - self.base + n - len(self.data)) if n < RECORD_BYTES else CHUNK)
            self.over = not more
            self.data += more
        return len(self.data) >= start - self.base + n

    def get(self, start: int, n: int) -> bytes:
        self.have(start, n)
        return bytes(self.data[start - self.base : start - self.base + n])

    def forget(self, before: int) -> None:
        if before - self.base >= CHUNK or before - self.base == len(self.data):
            del self.data[: before - self.base]
            self.base = before

    def find_blank(self, start: int) -> int | None:
        """The next end of a header line that an empty one follows, if there is one within a record's bytes."""
        since, at = self.no_blank if self.no_blank[0] <= start <= self.no_blank[1] else (start, start)
        while True:
            found = self.data.find(b"\r\n\r\n", at - self.base)
            end = self.base + len(self.data)
            at = found + self.base if found >= 0 else max(at, end - 3)
            self.no_blank = (since, at)
            if found >= 0:
                return at
            if at - start > RECORD_BYTES or not self.have(end, 1):
                return None

    def find_start(self, start: int, marks: tuple[bytes, ...] = (MEMBER, VERSION)) -> int | None:
        """The next place from start on that may begin a member or a record; what lies before it is forgotten."""
        start = max(start, self.base)
        while True:
            self.forget(start)
            found = [x for x in (self.data.find(mark, start - self.base) for mark in marks) if x >= 0]
            if found:
                return min(found) + self.base
            end = self.base + len(self.data)
            if not self.have(end, 1):
                return None
            start = max(start, end - len(VERSION) + 1)


def parsed(source: Source, start: int) -> tuple[Record, int]:
    """The record at a version line, checked, and where it ends."""
    head = source.get(start, FIRST_LINE)
    if not head.startswith(VERSION) or b"\r\n" not in head:
        raise Damaged("no version line")
    blank = source.find_blank(start)
    if blank is None or blank - start > RECORD_BYTES:
        raise Damaged("headers don't end")
    end = blank - start
    head = source.get(start, end)
    try:
        lines = head[:end].decode().split("\r\n")[1:]
    except UnicodeDecodeError:
        raise Damaged("headers aren't UTF-8") from None
    headers = {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines) if colon}
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or len(size) > 18 or "warc-type" not in headers:
        raise Damaged("no usable Content-Length or WARC-Type")
    begin, n = start + end + 4, int(size)
    if n > RECORD_BYTES or not source.have(begin, n + 4):
        raise Damaged("record is cut short")
    block = source.get(begin, n)
    if source.get(begin + n, 4) != b"\r\n\r\n":
        raise Damaged("record doesn't end where it says")
    claimed = headers.get("warc-block-digest", "")
    if claimed.startswith("sha1:") and claimed[5:] != base32_sha1(block):
        raise Damaged("block digest differs")
    claimed = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response" and claimed.startswith("sha1:") and claimed[5:] != base32_sha1(payload_of(block)):
        raise Damaged("payload digest differs")
    return Record(headers, block), begin + n + 4


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


class Member:
    """A stream of what the gzip member at a place inflates to. An error ends it early and is kept as its problem."""

    def __init__(self, source: Source, start: int):
        self.source, self.at, self.size, self.problem = source, start, 0, None
        self.made = zlib.decompressobj(31)
        self.marks = [(start, 0, self.made.copy())]  # places, the inflated bytes up to there, and how to go on

    def read(self, n: int = -1) -> bytes:
        while self.problem is None and not self.made.eof:
            part, before = self.source.get(self.at, PIECE), self.made.copy()
            if self.at - self.marks[-1][0] >= CHUNK:
                self.marks.append((self.at, self.size, before))
            if self.at - self.source.base > RECORD_BYTES:
                self.source.forget(self.at - RECORD_BYTES)
            try:
                if not part:
                    self.problem = "member is cut short"
                data = self.made.decompress(part, CHUNK) if part else self.made.flush()
                self.at += len(part) - len(self.made.unconsumed_tail) - len(self.made.unused_data)
            except zlib.error:
                self.problem = "member can't be inflated"
                data = self._until_error(part, before.copy())
            self.size += len(data)
            if data:
                return data
        return b""

    def _until_error(self, part: bytes, made) -> bytes:
        out = []
        for i in range(len(part)):
            try:
                out.append(made.decompress(part[i : i + 1]))
            except zlib.error:
                break
            self.at += 1
        return b"".join(out)

    def _mark(self, size: int) -> int:
        return max(i for i, (_, out, _) in enumerate(self.marks) if out <= size)

    def passed(self, size: int) -> int:
        """A place up to which the member inflates to no more than that many bytes; what lies before it is forgotten."""
        del self.marks[: self._mark(size)]
        self.source.forget(self.marks[0][0])
        return self.marks[0][0]

    def behind(self, size: int) -> int:
        """The place at which the member has inflated to that many bytes."""
        at, out, made = self.marks[self._mark(size)]
        if at < self.source.base:
            return self.source.base
        made = made.copy()
        while out < size:
            out += len(made.decompress(self.source.get(at, 1)))
            at += 1
        return at


def salvage(stream: BinaryIO) -> Iterator[Found]:
    """All valid records of an archive in order, and between them the gaps of bytes that hold none."""
    return _salvaged(Source(stream), (MEMBER, VERSION))


def _salvaged(source: Source, marks: tuple[bytes, ...]) -> Iterator[Found]:
    at = 0
    bad: int | None = None
    why = ""
    while source.have(at, 1):
        following = at + 1
        try:
            start = source.get(at, len(VERSION))
            if MEMBER in marks and start.startswith(MEMBER):
                member = Member(source, at)
                for f in _of_member(member, at):
                    if bad is not None:
                        yield Found(bad, at, None, why)
                        bad = None
                    yield f
                if not member.problem:
                    at = member.at
                    source.forget(at)
                    continue
                if member.taken:
                    at = following = member.behind(member.taken)
                raise Damaged(member.problem)
            if start != VERSION:
                raise Damaged("neither a member nor a version line" if MEMBER in marks else "no version line")
            found, stop = parsed(source, at)
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            following = source.find_start(following, marks)
            if following is None:
                at = source.base + len(source.data)
                break
            at = following
            continue
        if bad is not None:
            yield Found(bad, at, None, why)
            bad = None
        yield Found(at, stop, found, None)
        at = stop
        source.forget(at)
    if bad is not None and bad < at:
        yield Found(bad, at, None, why)


def _of_member(member: Member, at: int) -> Iterator[Found]:
    """What a member holds; member.taken becomes the number of inflated bytes up to the last record that counts.

    If the member turns out to be damaged, a record counts if its own block digest has passed, or if a valid record follows it.
    """
    held: list[Found] = []
    count = member.taken = 0

    def placed(f: Found, stop: int | None = None) -> Found:
        passed = member.passed(f.stop) if stop is None else stop
        if f.record is None:
            return Found(at, passed, None, f"{f.problem} (bytes {f.start} to {f.stop} of what the member inflates to)")
        member.taken = f.stop
        return Found(at, passed, f.record, None)

    for f in _salvaged(Source(member), (VERSION,)):
        count += f.record is not None
        held.append(f)
        if count > 1:
            yield from map(placed, held[:-1])
            held = held[-1:]
    if not member.problem:
        yield from (placed(f, member.at) for f in held)
        return
    vouched = [i for i, f in enumerate(held) if f.record and f.record.headers.get("warc-block-digest", "").startswith("sha1:")]
    yield from map(placed, held[: vouched[-1] + 1] if vouched else [])


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri(path))


def uri(path: str) -> str:
    """A path as Arrow's file systems spell it: Hadoop's names of object stores are others'."""
    if "://" not in path and not path.startswith("/"):
        path = path.replace(":/", ":///", 1)
    scheme, mark, rest = path.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest.replace('.blob.', '.dfs.', 1) if scheme in ('wasb', 'wasbs') else rest}" if mark else path


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes the pages (page_id, url, html) to archives in a folder that all executors reach; returns the manifest."""
    # equal digests: payloads themselves are never shuffled for this
    keyed = pages.select("page_id", "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    groups = keyed.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = saved(groups.where("n > 1 and first is not null").select("digest", "first"), "warc-firsts")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    joined = keyed.join(firsts, "digest", "left")
    refers = F.when((F.col("size") >= least_bytes) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    rows = joined.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), refers.cast("long").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = _opened(folder)
        files.create_dir(where, recursive=True)
        own, k, out, count, size = uuid.uuid4().hex, 0, None, 0, 0
        done = []
        for part in slices(batches, "html"):
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if out is None:
                    name = f"{own}-{k}.warc.gz"
                    out, count, size = files.open_output_stream(f"{where}/{name}", compression=None), 0, 0
                data = member(record(page_id, url, html.encode(), refers_to))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", count, size))
                    out, k = None, k + 1
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return saved(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """Rows of all archives whose path is in a column: records (problem is null) and gaps (problem says why).

    payloads: whether the bytes of responses are returned, too. Large tables are then better read without a shuffle behind.
    """
    fields = pa.schema(
        [("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("problem", pa.string()), ("page_id", pa.int64()), ("url", pa.string())]
        + [("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def number(name: str | None) -> int | None:
        tail = (name or "").rstrip(">").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def row(path: str, f: Found) -> tuple:
        if f.record is None:
            return (path, f.start, f.stop, f.problem, *[None] * 7)
        h, block = f.record
        head, _, body = block.partition(b"\r\n\r\n")
        if h["warc-type"] == "revisit":  # the payload is the other record's
            sizes = [int(x.split(b":")[1]) for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")]
            size, digest, body = (sizes or [0])[0], h.get("warc-payload-digest", "").removeprefix("sha1:"), None
        else:
            body = payload_of(block)
            size, digest = len(body), base32_sha1(body)
        return (path, f.start, f.stop, None, number(h.get("warc-record-id")), h.get("warc-target-uri"), h["warc-type"], size, digest, number(h.get("warc-refers-to")), body if payloads else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                files, where = _opened(path)
                rows, held = [], 0
                with files.open_input_stream(where, compression=None) as stream:
                    for f in salvage(stream):
                        rows.append(row(path, f))
                        held += len(rows[-1][-1] or b"")
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield _batch(rows, fields)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, fields)

    return paths.select("path").mapInArrow(run, READ)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Writes pages to archives in the shared folder and reads them back: the records, and the log of gaps.

    An error is raised if any record that was written isn't read.
    """
    folder = new_path(spark, "warc")
    manifest = write_archives(pages, folder, least_bytes)
    n, written = manifest.agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0))).first()
    # an archive a task, however small the manifest's file is; what is read is a few numbers for each record
    rows = saved(read_archives(manifest.repartition(max(1, n), "path")).drop("url", "payload"), "warc-read")
    read = rows.where("problem is null").count()
    if read != written:
        raise RuntimeError(f"{written} records were written to {folder} and {read} read")
    drop_path(spark, folder)
    return rows.where("problem is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), rows.where("problem is not null").select("path", "start", "stop", "problem")
