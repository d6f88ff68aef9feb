"""WARC archives in seekable Zstandard bundles: independent frames, a footer seek table and an index of records."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import fresh_dir, table, written

#: Payloads from this size on are stored once and revisited.
MIN_REVISIT = 1000
#: Uncompressed bytes after which a frame is closed, and bytes of frames after which a bundle is.
FRAME, BUNDLE = 1 << 20, 64 << 20
LEVEL = 3
#: Fixed values of the Zstandard seekable format: the skippable frame that holds the seek table, and its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
CRLF = b"\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = "record_id string, page_id long, bundle string, frame int, record_offset long, record_bytes long"


def record_id(page_id: int | None, sha1: str) -> str:
    """The id of a page's record: the page and its payload's digest, so that a revisit can name its response."""
    return f"urn:page:{'none' if page_id is None else page_id}:{sha1}"


def page_of(record: str) -> int | None:
    page = record.split(":")[2]
    return None if page == "none" else int(page)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[str, bytes]:
    """Id and bytes of one WARC 1.1 record with its closing blank lines; a revisit holds the HTTP head only."""
    sha1 = hashlib.sha1(payload)
    own = record_id(page_id, sha1.hexdigest())
    digest = "sha1:" + base64.b32encode(sha1.digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{own}>"),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", digest),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{record_id(refers_to, sha1.hexdigest())}>")]
    head.append(("Content-Length", str(len(block))))
    return own, b"WARC/1.1\r\n" + b"".join(f"{k}: {v}".encode() + CRLF for k, v in head) + CRLF + block + CRLF + CRLF


def parse(data: memoryview | bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the one record in `data`; a revisit's payload is empty."""
    data = bytes(data)
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.decode().split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != CRLF + CRLF:
        raise ValueError("a record's length does not fit")
    return headers, block.partition(CRLF + CRLF)[2]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for (compressed, uncompressed) frame sizes."""
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle) -> list[tuple[int, int]]:
    """(compressed, uncompressed) sizes of the frames of an open bundle, from its footer."""
    bundle.seek(bundle.size() - 9)
    n, flags, magic = struct.unpack("<IBI", bundle.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    size = 12 if flags & 0x80 else 8
    bundle.seek(bundle.size() - 9 - n * size)
    rows = bundle.read(n * size)
    return [struct.unpack_from("<II", rows, i * size) for i in range(n)]


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Bundle:
    """Writes one bundle and returns the index rows when closed.

    The name is this attempt's own: what another attempt of the same task writes is another bundle, and only the index
    rows of the attempt that Spark commits say which bundles count.
    """

    def __init__(self, folder: str, name: str):
        import zstandard

        self.files, path = _file_system(folder)
        self.files.create_dir(path, recursive=True)
        self.name = f"{name}-{uuid.uuid4().hex}.warc.zst"
        self.out, self.zstd = self.files.open_output_stream(f"{path}/{self.name}", compression=None), zstandard.ZstdCompressor(level=LEVEL)
        self.at, self.frames, self.open, self.rows, self.waiting = 0, [], bytearray(), [], []

    def add(self, own: str, page_id: int | None, data: bytes) -> None:
        self.waiting.append((own, page_id, len(self.open), len(data)))
        self.open += data
        if len(self.open) >= FRAME:
            self.flush()

    def flush(self) -> None:
        if self.open:
            packed = self.zstd.compress(bytes(self.open))
            self.out.write(packed)
            self.rows += [(own, page, self.name, len(self.frames), offset, n) for own, page, offset, n in self.waiting]
            self.frames.append((len(packed), len(self.open)))
            self.at += len(packed)
            self.open, self.waiting = bytearray(), []

    def close(self) -> list[tuple]:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return self.rows


def mark_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, revisit, refers_to): of equal payloads of MIN_REVISIT bytes or more the largest page id responds.

    Only digests are shuffled for the groups. Rows that repeat the largest id all respond; a null id never is
    the largest, and where a payload has null ids only each responds. A null payload is empty.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("__n", F.octet_length("payload").cast("long")).withColumn("__d", F.when(F.col("__n") >= MIN_REVISIT, F.unhex(F.sha2("payload", 256))))
    groups = rows.where("__d IS NOT NULL").groupBy("__d").agg(F.max("page_id").alias("__last"), F.count(F.lit(1)).alias("__m"))
    repeated = written(groups.where("__m > 1 AND __last IS NOT NULL").select("__d", "__last"), "repeated")
    marked = rows.join(repeated, "__d", "left")
    revisit = F.col("__last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__last"))
    return marked.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("__last")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, index: str = "index") -> DataFrame:
    """Writes mark_revisits() rows to bundles in `folder` and returns their index, a table of INDEX rows in its folder `index`.

    Every attempt of a task writes bundles of its own. A record's id names its page and payload; pages that repeat both
    are copies of one record, each in a place of its own. The index maps ids to a frame and a place in it.
    """

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, bundle = TaskContext.get().partitionId(), 0, None
        names = [f.split()[0] for f in INDEX.split(", ")]

        def closed(done: _Bundle) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done.close()), kinds)], names=names)

        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        for part in parts:
            for page, url, payload, revisit, refers in zip(*[c.to_pylist() for c in part.columns]):
                if bundle is None:
                    bundle = _Bundle(folder, f"part-{task:06d}-{number:05d}")
                    number += 1
                own, data = record(page, url, payload, refers, revisit)
                bundle.add(own, page, data)
                if bundle.at >= BUNDLE:
                    yield closed(bundle)
                    bundle = None
        if bundle is not None:
            yield closed(bundle)

    spark = rows.sparkSession
    path = f"{folder}/{index}"
    rows.mapInArrow(write, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(record_id, page_id, type, payload, payload_bytes, payload_digest, refers_to) of the records in `index`, or some of them.

    A task reads a bundle's seek table, seeks to each frame that it needs, decompresses it alone and takes the records
    out of it, so what is read follows what is asked for. Frames are dealt evenly over the tasks. `refers_to` is the
    page of the record that a revisit names.
    """
    schema = "record_id string, page_id long, type string, payload binary, payload_bytes long, payload_digest string, refers_to long"

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, (files, path), names = zstandard.ZstdDecompressor(), _file_system(folder), [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        for part in parts:
            for bundle, frame, places in zip(*[c.to_pylist() for c in part.columns]):
                with files.open_input_file(f"{path}/{bundle}") as f:
                    frames = read_seek_table(f)
                    f.seek(sum(packed for packed, _ in frames[:frame]))
                    data = memoryview(unpack.decompress(f.read(frames[frame][0])))
                got = []
                for place in places:
                    at = place["record_offset"]
                    headers, payload = parse(data[at : at + place["record_bytes"]])
                    own, refers = headers["WARC-Record-ID"][1:-1], headers.get("WARC-Refers-To")
                    if own != place["record_id"]:
                        raise ValueError(f"{place['record_id']} is not where the index has it")
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    got.append((own, page_of(own), headers["WARC-Type"], payload, int(headers["WARC-Payload-Length"]), digest, refers and page_of(refers[1:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], names=names)

    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("record_offset", "record_id", "record_bytes")).alias("places"))
    return frames.mapInArrow(read, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    index = write_archives(mark_revisits(table(spark, sf_dir, "pages")), folder)
    found = read_records(index, folder)
    # a response's length and digest are taken from the payload itself, so that a damaged record shows
    own = F.col("type") == "response"
    return found.select(
        "page_id",
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
     g AS (SELECT html AS h, max(page_id) AS last_id FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN last_id IS NULL OR last_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last_id <> page_id THEN last_id END AS refers_to
FROM p LEFT JOIN g ON p.n >= 1000 AND p.html = g.h
"""
