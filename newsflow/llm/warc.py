"""WARC archives: a distributed writer, and a sequential reader that verifies what it reads.

Every task of the writer makes archives of its own in the shared folder, one gzip member per record,
under a temporary name until they are whole; a task that is repeated replaces its archive.
Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest id is written as
``response``, the others as ``revisit`` without the payload. The first ids are found by digest before any
page moves, with partial minima in every task, so a payload that many pages share is no hot spot.

The reader streams an archive: gzip members are decompressed piece by piece, a record ends where its
``Content-Length`` says, and the block and payload digests are verified, whether SHA or MD5, hexadecimal or base32. It holds one record at a time. A damaged member, a short
block, wrong framing or a wrong digest make a row with ``problem`` set, and reading goes on with the next member. A digest of an unknown kind is
named in ``problem`` too, beside the payload.

Archives are opened with ``pyarrow.fs``, so the folder may be any that it can open (local or mounted
folders, HDFS, S3, GCS).

Defined results: a null html is an empty payload; null ids come last among equal payloads, and the record refers to no page; rows
that share the smallest id of equal payloads are all responses; a null url gives a record without a target.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.common import Batches, prepare, query, stage, table
from newsflow.session import staging_path

MIN_REVISIT = 100
#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 1 << 30
#: Bytes read from a store, or decompressed, at once.
PIECE = 1 << 16
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"

# ---------------------------------------------------------------------------
# Fixed values of the format.
# ---------------------------------------------------------------------------
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
PAGE_URN = "urn:page:"
# ---------------------------------------------------------------------------

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")

RECORD_SCHEMA = (
    "file string, number long, offset long, record_id string, page_id string, record_type string, target string, date string, "
    "payload_bytes long, payload_digest string, refers_to string, payload binary, problem string"
)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record(page: str | None, number: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC record as a gzip member; ``payload`` None makes a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if payload is None else head + payload
    lines = [
        VERSION, f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <{PAGE_URN}{page}>" if page is not None else f"WARC-Record-ID: <urn:record:{number}>",
        f"WARC-Date: {date}", f"Content-Type: {HTTP_TYPE}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE_URN}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{sha256(block)}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    raw = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"
    return packer.compress(raw) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def first_pages(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """``(digest, first)`` of payloads that several pages share, stored."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    digests = pages.select(F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"), F.col(page_id).alias("page"))
    shared = digests.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    return stage(shared.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "first_pages")


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages; the archives written, stored: ``(file, records, bytes)``."""
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).join(first_pages(pages, page_id, html, least), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    rows = rows.select(
        F.col("page").cast("string").alias("page"), "url", F.when(~again, F.col("payload")).alias("payload"),
        F.octet_length("payload").cast("long").alias("size"), "digest", F.when(again, F.col("first").cast("string")).alias("refers_to"),
    )

    def write(batches: Batches) -> Batches:
        task = TaskContext.get()
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        names, counts, sizes = [], [], []
        out = None

        def close():
            out.close()
            store.move(*places)

        places = "", ""
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for page, target, body, size, digest, refers in zip(*columns):
                if out is None or sizes[-1] >= archive_bytes:
                    if out is not None:
                        close()
                    name = f"pages-{task.partitionId():06d}-{len(names):04d}.warc.gz"
                    places = f"{at}/.{name}.{task.taskAttemptId()}", f"{at}/{name}"
                    out = store.open_output_stream(places[0], compression=None)
                    names.append(name)
                    counts.append(0)
                    sizes.append(0)
                member = record(page, f"{names[-1]}:{counts[-1]}", target, body, size, digest, refers)
                out.write(member)
                counts[-1] += 1
                sizes[-1] += len(member)
        if out is not None:
            close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{n}" for n in names]), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
                names=["file", "records", "bytes"],
            )

    return stage(rows.mapInArrow(write, "file string, records long, bytes long"), "archives")


class Members:
    """Bytes of the gzip members of a stream, one member after the other, decompressed piece by piece."""

    def __init__(self, stream):
        self.stream, self.raw, self.offset = stream, b"", 0
        self.unpack, self.text, self.ended = None, bytearray(), True

    def _more_raw(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(PIECE)
        return bool(self.raw)

    def start(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        while self._more_raw():
            bare = self.raw.lstrip(b"\0")
            self.offset += len(self.raw) - len(bare)
            self.raw = bare
            if bare:
                self.unpack, self.text, self.ended = zlib.decompressobj(31), bytearray(), False
                return True
        return False

    def _fill(self) -> bool:
        """Decompress a further piece of the member."""
        while not self.ended:
            if not self._more_raw():
                raise ValueError("the archive ends inside a member")
            given = self.raw
            piece = self.unpack.decompress(given, PIECE)
            rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            self.offset += len(given) - len(rest)
            self.raw, self.ended = rest, self.unpack.eof
            if piece:
                self.text += piece
                return True
        return False

    def line(self) -> bytes:
        at = 0
        while (end := self.text.find(b"\r\n", at)) < 0:
            at = max(0, len(self.text) - 1)
            if not self._fill():
                raise ValueError("the member ends inside a header")
        found = bytes(self.text[:end])
        del self.text[:end + 2]
        return found

    def take(self, n: int) -> bytes:
        while len(self.text) < n:
            if not self._fill():
                raise ValueError("the block is shorter than its Content-Length")
        found = bytes(self.text[:n])
        del self.text[:n]
        return found

    def finish(self) -> bytes:
        while self._fill():
            pass
        return bytes(self.text)

    def skip_damage(self) -> None:
        """After a damaged member: on to the next place that looks like the start of one."""
        self.raw, self.offset = self.raw[1:], self.offset + min(1, len(self.raw))
        while self._more_raw():
            # A mark may lie across two pieces.
            if len(self.raw) < 3:
                more = self.stream.read(PIECE)
                if not more:
                    self.raw = b""
                    return
                self.raw += more
            at = self.raw.find(b"\x1f\x8b\x08")
            if at >= 0:
                self.raw, self.offset = self.raw[at:], self.offset + at
                return
            self.offset += len(self.raw) - 2
            rest, self.raw = self.raw[-2:], self.stream.read(PIECE)
            if not self.raw:
                return
            self.raw = rest + self.raw


def _headers(members: Members) -> dict[str, str]:
    found = {}
    while line := members.line():
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("a header line has no colon")
        found[name.strip().lower()] = value.strip()
    return found


def _page(urn: str | None) -> str | None:
    inner = (urn or "").strip("<>")
    return inner[len(PAGE_URN):] if inner.startswith(PAGE_URN) else None


#: Kinds of digests that are verified, in hexadecimal or base32.
DIGESTS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")


def _digest_problem(given: str | None, data: bytes, what: str) -> str | None:
    """Why a ``kind:value`` digest says nothing about the data, if its kind is unknown; an error if it is another one."""
    if not given:
        return None
    kind, _, value = given.partition(":")
    name = kind.strip().lower().replace("-", "")
    if name not in DIGESTS:
        return f"unknown kind of {what} digest: {kind}"
    found = hashlib.new(name, data).digest()
    written = value.strip().rstrip("=")
    right = written.lower() == found.hex() or written.upper() == base64.b32encode(found).decode().rstrip("=")
    if not right:
        raise ValueError(f"wrong {what} digest")
    return None


def read_archive(stream) -> Iterator[dict]:
    """All records of an archive, in order."""
    members, number = Members(stream), 0
    while members.start():
        row = {"number": number, "offset": members.offset, "problem": None}
        number += 1
        try:
            if not members.line().startswith(b"WARC/"):
                raise ValueError("no WARC version line")
            head = _headers(members)
            row |= {
                "record_id": head.get("warc-record-id"), "page_id": _page(head.get("warc-record-id")), "record_type": head.get("warc-type"),
                "target": head.get("warc-target-uri"), "date": head.get("warc-date"), "refers_to": _page(head.get("warc-refers-to")),
            }
            block = members.take(int(head["content-length"]))
            if members.finish() != b"\r\n\r\n":
                raise ValueError("the record doesn't end after its block")
            row["problem"] = _digest_problem(head.get("warc-block-digest"), block, "block")
            digest = head.get("warc-payload-digest")
            http, _, payload = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
            if row["record_type"] == "revisit":
                sizes = re.findall(rb"(?im)^content-length:\s*(\d+)", http)
                row |= {"payload_bytes": int(sizes[0]) if sizes else None, "payload_digest": (digest or "").partition(":")[2] or None}
            else:
                row["problem"] = row["problem"] or _digest_problem(digest, payload, "payload")
                row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": sha256(payload)}
        except zlib.error as error:
            row["problem"] = f"damaged member: {error}"
            members.skip_damage()
        except (ValueError, KeyError) as error:
            row["problem"] = str(error)
            try:
                members.finish()
            except (ValueError, zlib.error):
                members.skip_damage()
        yield row


def read_warc(archives: DataFrame, file: str = "file", with_payload: bool = True) -> DataFrame:
    """All records of the archives that ``file`` names; rows with ``problem`` are those that fail a check."""
    prepare(archives.sparkSession)
    names = RECORD_SCHEMA.replace(",", "").split()[::2]
    fields = pa.schema([(n, {"number": pa.int64(), "offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in names])

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for row in read_archive(stream):
                        held += len(row.get("payload") or b"")
                        if not with_payload:
                            row.pop("payload", None)
                        rows.append(row | {"file": path})
                        if held > 8 << 20 or len(rows) >= 512:
                            yield pa.RecordBatch.from_pylist(rows, schema=fields)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)

    files = archives.select(F.col(file).alias("file"))
    return files.repartition(max(1, files.count())).mapInArrow(read, RECORD_SCHEMA)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""


@query("op2_warc", SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(table(spark, sf_dir, "pages"), staging_path(spark, "warc"))
    found = read_warc(archives, with_payload=False)
    # A record that fails a check has no page to report; say so rather than leave it out.
    sound = F.when(F.col("problem").isNull(), F.col("page_id").cast("long")).otherwise(F.raise_error(F.concat(F.lit("bad record in "), "file", F.lit(": "), "problem")).cast("long"))
    return found.select(
        sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )
