"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about FRAME_BYTES; a bundle ends with a seek table in a
skippable frame (the public seekable format: sizes of each frame, then a footer), so one frame is read without the
others. An index maps each record's identifier to its frame and its offset within that frame.

Bundles are objects (`.warc.zst`) in shared storage, written frame by frame through Arrow's file systems by the path's
scheme. The index is a Parquet table beside them: record, object, where its frame lies in the object and the record in the
frame, so a lookup reads the bytes of one frame. A task attempt gives its objects names of their own, and only what the
index names counts: Spark's writer commits the index, so a lost executor leaves an object that nothing refers to, never half a
bundle. Of records with equal payloads of
LEAST_PAYLOAD bytes or more, the one with the largest id is a response, the others are revisits that refer to it.
Repeated payloads are found on (digest, size, id) alone, counted with map-side combining; the few groups go to the
pages and no page is shuffled.

Cases: null html is an empty payload; a null url is empty; line breaks in a url are percent-encoded; a row without an
id is a record without a number, never a group's response while another has one; rows that repeat an id get a record
each, and copies are told from the response by id, so all rows with its id are responses; ties are thus decided by id alone; a
very long page is a frame of its own; an empty table gives no bundles; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearscore.llm.common import cut, ensure_checkpoint_dir, map_batches, small, table

FRAME_BYTES, BUNDLE_BYTES, LEAST_PAYLOAD, LEVEL = 256 << 10, 4 << 20, 1000, 3
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, object string, frame_at long, frame_bytes long, frame_size long, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def id_of(name: str) -> int | None:
    number = name[len("<urn:page:") : -1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (refers_to given) has the payload's HTTP header and no payload."""
    revisit = refers_to is not None
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + record_id(page_id).encode(),
        b"WARC-Target-URI: " + uri, b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Payload-Digest: sha1:" + hashlib.sha1(payload).hexdigest().encode(),
        *([b"WARC-Refers-To: " + record_id(refers_to).encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block),
    ]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record that starts at `at`, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    block = data[end + 4 : (stop := end + 4 + int(headers["Content-Length"]))]
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return headers, block, stop + 4


class Bundle:
    """Collects records into frames and writes each frame to a stream when it is full; holds one frame. finish() writes the
    seek table."""

    def __init__(self, stream) -> None:
        import zstandard

        self._stream, self._zstd = stream, zstandard.ZstdCompressor(level=LEVEL)
        self.sizes: list[tuple[int, int]] = []
        self._open, self._places, self._length, self.bytes = [], [], 0, 0

    def add(self, page_id: int | None, data: bytes) -> Iterator[tuple]:
        """Index rows (page_id, frame_at, frame_bytes, frame_size, offset, length) of the frame that this fills, if it does."""
        self._places.append((page_id, self._length, len(data)))
        self._open.append(data)
        self._length += len(data)
        if self._length >= FRAME_BYTES:
            yield from self._close()

    def _close(self) -> Iterator[tuple]:
        if self._open:
            frame = self._zstd.compress(b"".join(self._open))
            self._stream.write(frame)
            at, size, places = self.bytes, self._length, self._places
            self.sizes.append((len(frame), size))
            self.bytes += len(frame)
            self._open, self._places, self._length = [], [], 0
            for page_id, offset, length in places:
                yield page_id, at, len(frame), size, offset, length

    def finish(self) -> Iterator[tuple]:
        yield from self._close()
        seek = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self._stream.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)


def seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of every frame of an object of `size` bytes, from its end."""
    n, descriptor, magic = struct.unpack("<IBI", read_at(f, size - 9, 9))
    entry = 12 if descriptor & 0x80 else 8
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    at = size - 9 - n * entry - 8
    table_ = read_at(f, at, 8 + n * entry)
    if struct.unpack_from("<II", table_) != (SKIPPABLE, n * entry + 9):
        raise ValueError("no seek table")
    out, offset = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", table_, 8 + k * entry)
        out.append((offset, packed, plain))
        offset += packed
    return out


def read_at(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def frame(f, at: int, packed: int, size: int) -> bytes:
    """One frame's records; nothing else of the object is read."""
    import zstandard

    return zstandard.ZstdDecompressor().decompress(read_at(f, at, packed), max_output_size=size)


def records(f, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    for place in seek_table(f, size):
        part, at = frame(f, *place), 0
        while at < len(part):
            headers, block, at = parse_record(part, at)
            yield headers, block


def storage(path: str):
    """The Arrow file system of a path or URI, and the path in it."""
    import os

    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = os.path.abspath(path)
    elif path.startswith("file:"):
        path = "file://" + path.removeprefix("file:").removeprefix("//")
    return fs.FileSystem.from_uri(path)


def with_revisits(df: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to (null for responses) of pages."""
    pages = df.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= LEAST_PAYLOAD, F.sha1(F.col("html").cast("binary")))
    groups = cut(pages.select("page_id", digest.alias("sha")).where("sha IS NOT NULL").groupBy("sha").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    repeats = small(groups.select("sha", "kept"), 64)
    of = pages.withColumn("sha", digest).join(repeats, "sha", "left")
    return of.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def write_bundles(df: DataFrame, path: str) -> None:
    """Pages (page_id, url, html) as objects under path/objects, each of about BUNDLE_BYTES, and their INDEX in path/index."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def rows(batches):
        files, root = storage(path)
        files.create_dir(f"{root}/objects", recursive=True)
        task, done, now, stream, out = uuid.uuid4().hex, 0, None, None, []

        def take(places):
            out.extend((p[0], f"{task}-{done}.warc.zst", *p[1:]) for p in places)

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(k) for k in range(4))):
                if now is None:
                    stream = files.open_output_stream(f"{root}/objects/{task}-{done}.warc.zst", compression=None)
                    now = Bundle(stream)
                take(now.add(page.as_py(), record(page.as_py(), url.as_py(), html.as_py().encode(), refers.as_py())))
                if now.bytes >= BUNDLE_BYTES:
                    take(now.finish())
                    stream.close()
                    now, done = None, done + 1
                    yield dict(zip(names, map(list, zip(*out))))
                    out = []
        if now is not None:
            take(now.finish())
            stream.close()
            yield dict(zip(names, map(list, zip(*out))))

    map_batches(with_revisits(df), rows, INDEX).write.parquet(f"{path}/index")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS of all bundles under path that the index names; payloads are checked against their digests."""

    def rows(batches):
        files, root = storage(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                at, out = f"{root}/objects/{name}", []
                with files.open_input_file(at) as f:
                    for headers, block in records(f, f.size()):
                        http, payload = block.split(b"\r\n\r\n", 1)
                        revisit = headers["WARC-Type"] == "revisit"
                        n = int(http.rsplit(b"Content-Length: ", 1)[1])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{headers['WARC-Record-ID']}: the payload is damaged")
                        out.append((id_of(headers["WARC-Record-ID"]), n, digest, headers["WARC-Type"], id_of(headers["WARC-Refers-To"]) if revisit else None))
                yield dict(zip(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), map(list, zip(*out))))

    objects = spark.read.parquet(f"{path}/index").select("object").distinct()
    return map_batches(objects, rows, RECORDS)


def lookup(spark: SparkSession, path: str, page_ids: list[int]) -> list[tuple[int, dict[str, str], bytes]]:
    """(page_id, headers, block) of some pages: a filter on the index, which reaches its scan, then one frame of an object
    for each record."""
    files, root = storage(path)
    out = []
    for r in spark.read.parquet(f"{path}/index").where(F.col("page_id").isin(page_ids)).toLocalIterator():
        with files.open_input_file(f"{root}/objects/{r.object}") as f:
            out.append((r.page_id, *parse_record(frame(f, r.frame_at, r.frame_bytes, r.frame_size), r.offset)[:2]))
    return out


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4().hex}"
    write_bundles(table(spark, sf_dir, "pages"), path)
    return read_bundles(spark, path)


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN g.kept IS NULL OR g.kept = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.kept <> d.page_id THEN g.kept END AS refers_to
FROM d LEFT JOIN g ON g.payload_digest = d.payload_digest AND d.payload_bytes >= 1000
"""
