"""WARC archives in seekable Zstandard bundles.

A record is written once, into a frame of many records; frames are independent, so one is enough to
read a record. A bundle is a `.warc.zst` file: its frames and, in a skippable frame at its end, the
seek table of the public seekable format: each frame's compressed and plain size. Beside the bundles
stands a table, `index`, with each bundle's record ids and their frame, offset in the plain frame and
length; where a frame lies in the file is in the footer alone, from which readers take it. `index_records`
adds a table sorted by page, so that a lookup reads a row group of it, a footer and a frame.

Bundles are written by the tasks that make them, under a name of the task's attempt, through the file
system of the folder's URI; the index names only those of attempts that ended well, and readers start
from it. So a lost task leaves a file that nobody reads, and no record twice.

Equal payloads are found by their SHA-256 with a partial aggregate; a payload that 1/10,000 of the
pages share or more is looked up by broadcast, so no task gets its pages.

Defined results: a null payload is empty; a null url is left out, line breaks in it are escaped.
Rows with a null id are never referred to and are responses. Of equal payloads, all rows with the
smallest id are responses; rows that share an id and a payload share a record id. A very long payload
is a frame of its own, held by one worker. An empty table gives no bundles. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterable

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import looked_up, stored

#: Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, record_ids array<string>, frames array<int>, offsets array<int>, lengths array<int>"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record with its payload, or a revisit record with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    digest = digest32(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names) of the record and of its HTTP part, and the payload that it holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    warc = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(warc["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return {"warc": warc, "http": fields, "payload": payload}


class BundleWriter:
    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.clear()

    def clear(self) -> None:
        self.body, self.sizes, self.open, self.open_size, self.size, self.index = [], [], [], 0, 0, []

    def add(self, rid: str, raw: bytes) -> None:
        self.index.append((rid, len(self.sizes), self.open_size, len(raw)))
        self.open.append(raw)
        self.open_size += len(raw)
        if self.open_size >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.compressor.compress(b"".join(self.open))
            self.body.append(frame)
            self.sizes.append((len(frame), self.open_size))
            self.size += len(frame)
            self.open, self.open_size = [], 0

    def finish(self) -> tuple[bytes, list]:
        """The file's bytes, and its index row: record ids, their frames, offsets in the frames, lengths."""
        self.close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        data = b"".join(self.body) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table
        row = [[x[i] for x in self.index] for i in range(4)]
        self.clear()
        return data, row


class BundleReader:
    """Reads single records of a bundle: its footer, then the frames that are asked for; keeps the last frame.

    read_at: (bytes, from) -> the file's bytes; size: the file's.
    """

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        n, _, magic = struct.unpack("<IBI", read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("the bundle has no seek table")
        table = read_at(8 * n + 8, size - 17 - 8 * n)
        if struct.unpack_from("<II", table) != (SKIPPABLE_MAGIC, 8 * n + 9):
            raise ValueError("the seek table's frame is damaged")
        sizes = [struct.unpack_from("<II", table, 8 + 8 * i) for i in range(n)]
        self.read_at, self.at, self.plain = read_at, [0], [x[1] for x in sizes]
        for c, _ in sizes:
            self.at.append(self.at[-1] + c)
        self.last, self.text = -1, b""

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if frame != self.last:
            packed = self.read_at(self.at[frame + 1] - self.at[frame], self.at[frame])
            self.text, self.last = zstandard.ZstdDecompressor().decompress(packed, max_output_size=self.plain[frame]), frame
        return self.text[offset : offset + length]


def folder_of(uri: str) -> tuple[FileSystem, str]:
    """The file system of a folder's URI, and its path there."""
    return FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, revisit_from: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 8 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes `folder`/*.warc.zst and `folder`/index; the index. Equal payloads of at least `revisit_from` bytes are kept once."""
    plain = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    digested = plain.withColumn("digest", F.unhex(F.sha2(F.encode("html", "UTF-8"), 256)))
    rows = plain.count()
    alike = stored(digested.where((F.octet_length("html") >= revisit_from) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = alike.where(F.col("n") >= max(1000, rows // 10_000))  # 10,000 payloads at most
    found = looked_up(digested, alike, "digest", "least", hot, F.coalesce(F.unhex(F.hex("id")), F.col("digest")))
    marked = found.select("id", "url", "html", F.when(F.col("id") > F.col("least"), F.col("least")).alias("refers_to"))
    names = [x.split()[0] for x in INDEX.split(", ")]
    types = [pa.string(), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 3]

    def write(batches):
        system, path = folder_of(folder)
        system.create_dir(path, recursive=True)
        task, bundle, n = TaskContext.get(), BundleWriter(frame_bytes, level), 0

        def put() -> pa.RecordBatch:
            data, row = bundle.finish()
            name = f"part-{task.partitionId():06d}-{n:04d}-{task.taskAttemptId()}.warc.zst"
            with system.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([name, *row], types)], names=names)

        for batch in batches:
            for page, url, html, ref in zip(*(batch.column(i) for i in range(4))):
                page, payload = page.as_py(), html.as_py().encode()
                bundle.add(record_id(page, digest32(payload)), make_record(page, url.as_py(), payload, ref.as_py(), date))
                if bundle.size + bundle.open_size >= bundle_bytes:
                    yield put()
                    n += 1
        if bundle.index:
            yield put()

    marked.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return read_index(pages.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, frame int, frame_offset int, record_length int"


def _page(urn: str | None) -> int | None:
    tail = (urn or "::").strip("<>").split(":")[2]
    return int(tail) if tail else None


def _records(system: FileSystem, path: str, file: str, places: Iterable[tuple[str, int, int, int]]) -> list[tuple]:
    """The records of a bundle at the given (record id, frame, offset, length), checked; only the footer and their frames are read."""
    out = []
    with system.open_input_file(f"{path}/{file}") as source:
        reader = BundleReader(source.read_at, source.size())
        for rid, frame, offset, length in places:
            r = parse_record(reader.read(frame, offset, length))
            warc, digest = r["warc"], r["warc"]["warc-payload-digest"].removeprefix("sha1:")
            if warc["warc-record-id"] != f"<{rid}>" or warc["warc-type"] == "response" and digest32(r["payload"]) != digest:
                raise ValueError(f"record {rid} is damaged")
            out.append((_page(rid), warc.get("warc-target-uri"), int(r["http"]["content-length"]), digest, warc["warc-type"], _page(warc.get("warc-refers-to")), frame, offset, length))
    return out


_READ_NAMES = [x.split()[0] for x in READ.split(", ")]
_READ_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the folder's bundles, each read from its frame, which the bundle's footer locates. Responses' digests are checked."""

    def read(batches):
        system, path = folder_of(folder)
        for batch in batches:
            for row in batch.to_pylist():
                out = _records(system, path, row["file"], zip(row["record_ids"], row["frames"], row["offsets"], row["lengths"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _READ_TYPES)], names=_READ_NAMES)

    return read_index(spark, folder).mapInArrow(read, READ)


def index_records(spark: SparkSession, folder: str) -> DataFrame:
    """Writes `folder`/records, a row per record sorted by page: what single lookups read a part of."""
    places = read_index(spark, folder).select("file", F.explode(F.arrays_zip("record_ids", "frames", "offsets", "lengths")).alias("r"))
    rows = places.select(F.split("r.record_ids", ":")[2].try_cast("long").alias("page_id"), "file", F.col("r.record_ids").alias("record_id"), F.col("r.frames").alias("frame"), F.col("r.offsets").alias("offset"), F.col("r.lengths").alias("length"))
    rows.repartitionByRange("page_id", "record_id").sortWithinPartitions("page_id").write.option("parquet.block.size", 4 << 20).parquet(f"{folder}/records")
    return spark.read.parquet(f"{folder}/records")


def look_up(spark: SparkSession, folder: str, pages: list[int]) -> DataFrame:
    """The records of the given pages: the pages are pushed into the scan of the sorted table, and of a bundle only the footer and the records' frames are read."""

    def read(key, table):
        system, path = folder_of(folder)
        out = _records(system, path, key[0].as_py(), sorted(zip(*(table.column(c).to_pylist() for c in ("record_id", "frame", "offset", "length"))), key=lambda r: r[1:]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), _READ_TYPES)], names=_READ_NAMES)

    return spark.read.parquet(f"{folder}/records").where(F.col("page_id").isin(*pages)).groupBy("file").applyInArrow(read, READ)
