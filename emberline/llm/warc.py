"""Operator 10: WARC archives written by Spark tasks, and a reader that salvages damaged ones.

Writing: each row becomes a gzip member of its own. Of rows with equal payloads (of at least ``min_bytes`` bytes) the one
with the largest id is a ``response`` record, the others are ``revisit`` records that refer to it. Tasks write archives
of about ``ARCHIVE_BYTES`` under names that no other attempt uses, and report them in a manifest; only archives of
attempts that Spark committed are in it, so a lost executor leaves files that nobody reads.

Reading: Spark lists the archives and deals them out; tasks read them by blocks and inflate members as they go, so a task
holds one record at a time, however large the archive or the member. Headers may have any length. A record is taken if its
length holds and its digest, where it has one. A gzip member that is damaged or cut gives the records before the damage. After a
failed check the reader looks for the next gzip member or plain ``WARC/1.`` version line from which a whole record can be
read, goes on there, and logs the bytes between as a gap. The archives of a manifest must give as many records as were written.

A null payload is written as an empty one; a page without id revisits the newest equal one that has an id, and its record
names no page; rows that share the largest id of a payload are all responses; repeated rows are written as often as they
occur; an empty table gives no archives and an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CLEANUP, new_path, setting, small_batches

ARCHIVE_BYTES = 16 << 20
GZIP_HEADER = 16 << 10  # a member from which nothing comes by then is none
WHOLE_BYTES = 8 << 20  # members that inflate to more are inflated twice, the second time record by record
SALTS = 16
RECORDS = "kind string, archive string, start bigint, stop bigint, record_type string, record_id string, target_uri string, payload_length bigint, payload_digest string, refers_to string, payload binary"
_VERSION = re.compile(rb"WARC/1\.\d\r\n")
_FIELD = re.compile(rb"[!-9;-~]+[ \t]*:")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(payload)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None) -> bytes:
    uri = re.sub(r"[\r\n]+", " ", url or "")
    headers = [
        ("WARC-Type", "response" if original is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if original is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{original}>")]
    return record_bytes(headers, payload if original is None else b"")


class Bytes:
    """Random access to bytes in memory, or in a file by blocks: nothing but the record at hand is read whole."""

    BLOCK = 1 << 20
    MAGIC = re.compile(rb"\x1f\x8b\x08|WARC/1\.")

    def __init__(self, data: bytes | None = None, file=None) -> None:
        self.data, self.file = data, file
        self.size = len(data) if file is None else file.size()
        self.at, self.block = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if self.file is None:
            return self.data[at : at + n]
        if n > self.BLOCK:
            return self.file.read_at(n, at)
        if not (self.at <= at and at + n <= self.at + len(self.block)):
            self.at, self.block = at, self.file.read_at(min(self.BLOCK, self.size - at), at) if at < self.size else b""
        return self.block[at - self.at : at - self.at + n]

    def has(self, at: int) -> bool:
        return at < self.size

    def forget(self, at: int) -> None:
        """Nothing before ``at`` will be read again."""

    def candidate(self, at: int, packed: bool) -> int:
        """Start of the next gzip member (if ``packed``) or version line from ``at`` on, else the end."""
        step = 256
        while self.has(at):
            part = self.read(at, step)
            step = min(8 * step, self.BLOCK)
            for m in self.MAGIC.finditer(part):
                if packed or m.group() != b"\x1f\x8b\x08":
                    return at + m.start()
            if not self.has(at + len(part)):
                break
            at += max(len(part) - 6, 1)  # a mark may lie across two blocks
        return self.size


class Inflated(Bytes):
    """The plain bytes of a gzip member, inflated as they are asked for and forgotten once they are read.

    Of a damaged member all that comes out before the damage is there. ``size`` is right once the end is reached.
    """

    def __init__(self, data: Bytes, at: int, step: int = 1 << 16) -> None:
        self.source, self.at, self.step, self.z = data, at, step, zlib.decompressobj(31)
        self.base, self.plain, self.ended, self.sound = 0, bytearray(), False, False
        self.marks = [(0, at)]  # plain bytes there once the packed ones up to a place were read

    @property
    def size(self) -> int:
        return self.base + len(self.plain)

    def _pull(self) -> None:
        part, before = self.source.read(self.at, self.step), self.z.copy()
        try:
            self.plain += self.z.decompress(part)
        except zlib.error:
            self.ended = True
            with contextlib.suppress(zlib.error):  # byte by byte up to the damage
                while out := before.decompress(part, 1):
                    self.plain += out
                    part = before.unconsumed_tail
            return
        self.at += len(part)
        self.sound = self.z.eof
        self.ended = self.z.eof or not part or not self.source.has(self.at)
        self.at -= len(self.z.unused_data)
        self.marks.append((self.size, self.at))

    def has(self, at: int) -> bool:
        while self.size <= at and not self.ended:
            self._pull()
        return at < self.size

    def read(self, at: int, n: int) -> bytes:
        self.has(at + n - 1)
        return bytes(self.plain[at - self.base : at - self.base + n])

    def forget(self, at: int) -> None:
        del self.plain[: at - self.base]
        self.base = at
        while len(self.marks) > 1 and self.marks[1][0] <= at:
            del self.marks[0]


def header(data: Bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Fields of the header that starts at ``at``, and where its payload starts; None at the first line that is no field.

    Only ``WARC-Concurrent-To`` may occur twice, as the format has it.
    """
    head = bytearray(data.read(at, 4096))
    found = _VERSION.match(head)
    if not found:
        return None
    headers, line, seen = {}, found.end(), found.end()
    while True:
        end = head.find(b"\r\n", seen)
        if end < 0:
            seen = max(line, len(head) - 1)
            more = data.read(at + len(head), min(max(4096, len(head)), data.BLOCK))
            if not more:
                return None
            head += more
            continue
        if end == line:
            return headers, at + end + 2
        name = _FIELD.match(head, line, end)
        if not name:
            return None
        field = head[line : name.end() - 1].decode().strip().lower()
        if field in headers and field != "warc-concurrent-to":
            return None
        headers[field] = head[name.end() : end].decode("utf-8", "replace").strip()
        line = seen = end + 2


def parse_record(data: Bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, payload and end of the whole, checked record that starts at ``at``; else None."""
    found = header(data, at)
    if not found or not found[0].get("content-length", "").isdigit():
        return None
    headers, start = found
    stop = start + int(headers["content-length"])
    if data.read(stop, 4) != b"\r\n\r\n":
        return None
    payload = data.read(start, stop - start)
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers.get("warc-type") == "response" and digest and base32_sha1(payload) != digest:
        return None
    return headers, payload, stop + 4


def inflate(data: Bytes, at: int) -> tuple[Bytes, int] | None:
    """What the gzip member that starts at ``at`` holds, and its end (-1: damaged or cut); None if nothing comes out.

    A member is read to its end first, to know that it is sound; its plain bytes are kept if they are few.
    """
    z, out, size, step, start = zlib.decompressobj(31), [], 0, 256, at
    while not z.eof and data.has(at):
        part = data.read(at, step)
        try:
            plain = z.decompress(part)
        except zlib.error:
            break
        size += len(plain)
        out = [*out, plain] if size <= WHOLE_BYTES else []
        at, step = at + len(part), 65536 if plain else 4096
        if at - start > GZIP_HEADER and not size:
            return None
    if z.eof:
        return (Bytes(b"".join(out)) if size <= WHOLE_BYTES else Inflated(data, start)), at - len(z.unused_data)
    return (Inflated(data, start, 1024), -1) if size else None


def salvage(data: Bytes, packed: bool = True) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """(start, stop, headers, payload) of each record in order; headers are None for a gap of unreadable bytes.

    Records of a gzip member, and unread stretches beside them, have the member's start and stop; those of a damaged one stop
    at most a kilobyte before their last packed byte, and the gap goes on from there. Members are looked for only if ``packed``.
    """
    at, bad = 0, None
    while data.has(at):
        stop, got = at, None
        if packed and data.read(at, 3) == b"\x1f\x8b\x08":
            if plain := inflate(data, at):
                inner, end = plain
                gaps = 0
                for _, last, headers, payload in salvage(inner, packed=False):
                    if headers is None and (stop == at or end < 0):  # gaps before the first record, or perhaps at the damage
                        gaps += 1
                        continue
                    if stop == at and bad is not None:
                        yield bad, at, None, b""
                        bad = None
                    stop = end if end >= 0 else max(at + 1, *(p for n, p in inner.marks if n < last))
                    for _ in range(gaps):
                        yield at, stop, None, b""
                    gaps = 0
                    yield at, stop, headers, payload
                if end < 0 and stop > at:
                    at = data.candidate(stop, packed)
                    bad = stop if at > stop else None
                    continue
        elif got := parse_record(data, at):
            stop = got[2]
            if bad is not None:
                yield bad, at, None, b""
                bad = None
            yield at, stop, got[0], got[1]
        if stop > at:
            at = stop
            data.forget(at)
            continue
        bad = at if bad is None else bad
        at = data.candidate(at + 1, packed)
    if bad is not None and bad < data.size:
        yield bad, data.size, None, b""


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id long, url, payload binary)`` as archives under ``path``; returns the manifest (archive, records, bytes)."""
    pages = pages.select("page_id", "url", "payload", F.sha1("payload").alias("sha"))
    digest = pages.select("page_id", "sha", F.octet_length("payload").alias("n"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt")).filter(F.col("n") >= min_bytes)
    newest = digest.groupBy("sha", "n").agg(F.max("page_id").alias("newest"), F.count("*").alias("copies")).filter("copies > 1")
    # each payload with copies is looked up under SALTS keys, so the copies of one spread over as many tasks
    newest = newest.select("sha", "n", "newest", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    plan = digest.join(newest, ["sha", "n", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("newest"))).select(F.col("page_id").alias("id"), F.col("sha").alias("of"), "newest").distinct()
    # payloads travel by id, and only where older copies are many
    tagged = pages.join(plan, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("of")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        from pyspark import TaskContext

        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        task, done, buffer, size, records = TaskContext.get(), [], [], 0, 0

        def flush():
            nonlocal buffer, size, records
            if buffer:
                name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                with fs.open_output_stream(f"{folder}/{name}", compression=None) as f:
                    f.write(b"".join(buffer))
                done.append({"archive": name, "records": records, "bytes": size})
                buffer, size, records = [], 0, 0

        for batch in batches:
            for row in batch.to_pylist():
                payload = row["payload"] or b""
                m = member(page_record(row["page_id"], row["url"], payload, base32_sha1(payload), row["newest"]))
                buffer.append(m)
                size, records = size + len(m), records + 1
                if size >= ARCHIVE_BYTES:
                    flush()
        flush()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return small_batches(tagged.select("page_id", "url", "payload", "newest")).mapInArrow(write, "archive string, records bigint, bytes bigint")


def read_archives(spark: SparkSession, path: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``, or of those in the manifest, with payloads or null in their place.

    An archive of the manifest with another number of records than were written raises an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "length", F.regexp_extract("path", r"([^/]+)$", 1).alias("archive"))
    if manifest is not None:
        files = files.join(manifest.groupBy("archive").agg(F.sum("records").alias("records")), "archive")
    else:
        files = files.withColumn("records", F.lit(None).cast("long"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = pa.schema([(n, pa.int64() if n in ("start", "stop", "payload_length") else pa.binary() if n == "payload" else pa.string()) for n in names])
        batch_of = lambda rows: pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=types)
        for batch in batches:
            for file in batch.to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(file["path"])
                rows, size, whole = [], 0, 0
                with fs.open_input_file(at) as opened:
                    for start, stop, h, payload in salvage(Bytes(file=opened)):
                        if h is None:
                            rows.append(("gap", file["archive"], start, stop, *[None] * 7))
                        else:
                            length = h.get("warc-payload-length", str(len(payload)))
                            rows.append(("record", file["archive"], start, stop, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), int(length) if length.isdigit() else None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h.get("warc-refers-to"), payload if payloads else None))
                            size += len(payload) if payloads else 200
                            whole += 1
                        if size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)
                if file["records"] not in (None, whole):
                    raise ValueError(f"{file['archive']} holds {whole} of {file['records']} records")

    return files.select("path", "archive", "records").mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path, manifest = new_path(spark, "warc"), new_path(spark, "manifest")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    _make_folder(spark, path)
    with setting(spark, CLEANUP, "true"):
        write_archives(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")), path).write.parquet(manifest)
    records = read_archives(spark, path, spark.read.parquet(manifest), payloads=False).filter("kind = 'record'")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) AS bigint)")
    return records.select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to"),
    )


def _make_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


#: The same result as DuckDB SQL; base 32 is spelled out from the hexadecimal digest, 20 bits at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT hex, max(page_id) AS newest FROM p GROUP BY hex),
b AS (SELECT page_id, html, hex, newest, list_transform(range(0, 8), lambda k: ('0x' || substr(hex, (5 * k + 1)::INT, 5))::INT) AS parts FROM p JOIN g USING (hex))
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(parts, lambda x:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32768) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 1024) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM b
"""
