"""WARC archives compressed with Zstandard, one frame per record.

An archive begins with a skippable frame that holds the dictionary (itself
compressed or plain); then each record is one frame that needs it. Archives
are written and read inside tasks through ``pyarrow.fs``; only their paths move
between stages.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.storage import materialize, shared_dir

#: Fixed values of the Zstandard format (RFC 8878) and of its use for WARC.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 16 << 10
#: An archive's dictionary is trained on its first records of so many bytes.
SAMPLE_BYTES = 1 << 20
#: A task begins a new archive after so many bytes of records.
ARCHIVE_BYTES = 256 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT_BYTES = 1000

#: Rows of records that a task passes on at once.
ROWS_AT_ONCE = 4096

MANIFEST = "path string, n_records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def _header_lines(headers: dict[str, str]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode()


def build_record(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None, date: str) -> bytes:
    """A response or revisit record. A revisit keeps the HTTP head, whose Content-Length is the payload's, and no payload."""
    block = b"HTTP/1.1 200 OK\r\n" + _header_lines({"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))}) + b"\r\n"
    digest = hashlib.sha1(payload).hexdigest()
    if record_type == "response":
        block += payload
    headers = {"WARC-Type": record_type, "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": date}
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe="%:/?#[]@!$&'()*+,;=~-._")
    if record_type == "revisit":
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    headers |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return VERSION + b"\r\n" + _header_lines(headers) + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def payload(self) -> tuple[bytes, int]:
        """What follows the HTTP head, and the length that the head gives."""
        head, found, body = self.block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        if not found or not length:
            raise WarcError("an HTTP block without a head or its Content-Length")
        return body, int(length[1])


def parse_record(data: bytes) -> Record:
    """Parse one record; check its version, headers, lengths and digests."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (VERSION, b"WARC/1.0"):
        raise WarcError("no WARC version line or no end of the headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise WarcError(f"a header line without a name: {line[:60]!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [k for k in REQUIRED if k not in headers]:
        raise WarcError(f"missing headers: {', '.join(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not fit the record")
    record = Record(headers, rest[:-4])
    _check_digest(headers.get("warc-block-digest"), record.block)
    if headers["warc-type"] == "response":
        payload, length = record.payload()
        if length != len(payload):
            raise WarcError("the HTTP Content-Length does not fit the payload")
        _check_digest(headers.get("warc-payload-digest"), payload)
    return record


def _check_digest(given: str | None, data: bytes) -> None:
    if given and given != f"sha1:{hashlib.sha1(data).hexdigest()}":
        raise WarcError("a digest does not fit its data")


#: Bytes of an archive that are read at a time.
READ_BYTES = 1 << 18
#: Magic numbers of skippable frames differ in their last four bits.
SKIPPABLE, SKIPPABLE_MASK = 0x184D2A50, 0xFFFFFFF0


class _Source:
    """Bytes of an archive, read as they are needed."""

    def __init__(self, file: BinaryIO):
        self.file, self.held = file, b""

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end."""
        parts = [self.held[:n]]
        left, self.held = n - len(parts[0]), self.held[n:]
        while left > 0 and (more := self.file.read(max(left, READ_BYTES))):
            parts.append(more[:left])
            left, self.held = left - len(parts[-1]), more[left:]
        return b"".join(parts)

    def give_back(self, data: bytes) -> None:
        self.held = data + self.held

    def frame(self, decompressor: zstandard.ZstdDecompressor) -> bytes:
        """The content of the frame that begins here, whether or not its header names a size."""
        stream, parts = decompressor.decompressobj(), []
        try:
            while not stream.eof:
                data = self.take(READ_BYTES)
                if not data:
                    raise WarcError("a frame's end is cut")
                parts.append(stream.decompress(data))
        except zstandard.ZstdError as error:
            raise WarcError(str(error)) from error
        self.give_back(stream.unused_data)
        return b"".join(parts)


def read_archive(data: bytes | BinaryIO) -> Iterator[Record]:
    """The records of an archive, one frame each; it is read in parts, and one record is held at a time.

    The dictionary is in a leading skippable frame, if there is one; other
    skippable frames, wherever they stand, are passed over.
    """
    source, decompressor, first = _Source(io.BytesIO(data) if isinstance(data, bytes) else data), zstandard.ZstdDecompressor(), True
    while head := source.take(4):
        if len(head) < 4:
            raise WarcError("a frame's magic number is cut")
        magic = struct.unpack("<I", head)[0]
        if magic & SKIPPABLE_MASK == SKIPPABLE:
            length = source.take(4)
            raw = source.take(struct.unpack("<I", length)[0]) if len(length) == 4 else b""
            if len(length) < 4 or len(raw) < struct.unpack("<I", length)[0]:
                raise WarcError("a skippable frame is cut")
            if first and magic == DICTIONARY_FRAME:
                if raw[:4] == struct.pack("<I", ZSTD_FRAME):
                    raw = _Source(io.BytesIO(raw)).frame(zstandard.ZstdDecompressor())
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == ZSTD_FRAME:
            source.give_back(head)
            yield parse_record(source.frame(decompressor))
        else:
            raise WarcError("neither a Zstandard nor a skippable frame")
        first = False


@dataclass
class ArchiveWriter:
    """Writes frames to a sink; keeps no more than the dictionary's sample in memory."""

    sink: pa.NativeFile
    sample: list[bytes] = field(default_factory=list)
    compressor: zstandard.ZstdCompressor | None = None
    n_records: int = 0
    n_bytes: int = 0

    def add(self, record: bytes) -> None:
        self.n_records += 1
        self.n_bytes += len(record)
        if self.compressor:
            self.sink.write(self.compressor.compress(record))
            return
        self.sample.append(record)
        if self.n_bytes >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, self.sample)
        except zstandard.ZstdError:  # too few records to train on: a plain archive
            dictionary = None
        if dictionary:
            raw = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
            self.sink.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        for record in self.sample:
            self.sink.write(self.compressor.compress(record))
        self.sample = []

    def close(self) -> None:
        if not self.compressor:
            self._begin()
        self.sink.close()


def plan_records(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, record_type, refers_to for every row of ``pages``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with
    the largest page_id is the response. Digests are counted before they are
    joined, so a group of copies of any size passes as a few rows per task.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    read = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = read.where(F.octet_length("payload") >= least_bytes)
    groups = materialize(large.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    revisit = F.col("response_id").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("response_id"), F.lit(False))
    return read.join(groups, "digest", "left").select(
        "page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response_id")).alias("refers_to")
    )


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives of ``records`` (see ``plan_records``) below ``folder``; return their manifest.

    A task names its archives anew each time it runs. The manifest holds the
    files of the attempts that counted, so what a lost attempt left is not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        writer, path = None, ""
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "record_type", "refers_to"))):
                if writer is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(files.open_output_stream(path))
                writer.add(build_record(*row, date=date))
                if writer.n_bytes >= archive_bytes:
                    writer.close()
                    done.append((path, writer.n_records))
                    writer = None
        if writer:
            writer.close()
            done.append((path, writer.n_records))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "n_records"])

    return materialize(records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(write, MANIFEST))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the archives in ``manifest``, from the records alone; a broken one fails the job.

    An archive is read in parts; a task holds one record and some thousand rows.
    """

    def page(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for batch in batches:
            for path, n_records in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist()):
                n, rows = 0, []
                with files.open_input_stream(path) as source:
                    for record in read_archive(source):
                        h = record.headers
                        rows.append((page(h["warc-record-id"]), h.get("warc-target-uri"), record.payload()[1], h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], page(h.get("warc-refers-to"))))
                        n += 1
                        if len(rows) == ROWS_AT_ONCE:
                            yield as_batch(rows)
                            rows = []
                if n != n_records:
                    raise WarcError(f"{path} holds {n} records, not {n_records}")
                if rows:
                    yield as_batch(rows)

    # The number is given, since Spark would join so few small rows in one task.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "n_records").repartition(tasks, "path").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder and read them back.

    Returns a row per row of ``pages``. A null html is an empty payload; empty
    or short payloads are never revisits; a null page_id stays null and revisits
    if its payload has a response; rows with the same page_id and payload are
    responses together. Other columns of ``pages`` are left out; an empty table
    gives no rows.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc/{uuid.uuid4().hex}"
    return read_archives(write_archives(plan_records(pages), folder), folder)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS response_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response_id THEN response_id END AS refers_to
FROM r"""
