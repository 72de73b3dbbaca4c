"""WARC archives: writer with revisit records, and a splittable reader (``op9_splittable_warc``).

Writing. Payload digests are aggregated first (one slim row per digest), which tells for every page whether it is
the response of its payload or a revisit of the page with the largest id. Every task then writes its pages as
gzip members, one per record, into files of its own below the shared folder, and returns (path, bytes); the
list of files is written out, so files of a lost task attempt are never read.

Reading. Files are cut into byte ranges, one row each, dealt out over tasks. A task looks for the gzip magic from
its range's start, takes a candidate only if the whole member decodes (checksum included), begins with a
WARC version line and is followed by another member or the file's end, and so finds its first record without
knowing where it begins. It owns the records whose member starts inside its range and reads past the range's
end to finish the last one. Memory is bounded by a range and a record.

Defined cases: null html is the empty payload, null or odd urls are left out or escaped; a null page_id
counts as smaller than all others; rows of one page_id and payload get the same kind of record each. Payloads
below ``LEAST_BYTES`` are always written in full. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlprism.llm.common import cut, map_arrow, shared_folder, table

LEAST_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit has the HTTP head but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
            b"WARC-Record-ID: <urn:page:%s>" % (b"null" if page_id is None else b"%d" % page_id),
            b"WARC-Payload-Digest: sha1:" + digest.encode()]
    if url:
        head.append(b"WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~").encode())
    if refers_to is not None:
        head += [b"WARC-Profile: " + REVISIT.encode(), b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes (page_id, url, html) rows as archives below ``folder``; (path, bytes) of the files."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    slim = rows.where(F.octet_length("payload") >= LEAST_BYTES).select("page_id", "digest")
    latest = slim.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1 AND latest IS NOT NULL")
    revisits = slim.join(latest, "digest").where("page_id IS NULL OR page_id < latest") \
        .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "latest").distinct()
    told = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left") \
        .select("page_id", "url", "payload", "digest", "latest")

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, path, done = None, "", []
        try:
            for batch in batches:
                columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "latest")]
                for row in zip(*columns, strict=True):
                    if out is None:
                        path = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(path, compression=None)
                    page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                    member = zlib.compressobj(4, zlib.DEFLATED, 31)
                    out.write(member.compress(record(page_id, url, payload, digest, refers_to)) + member.flush())
                    if out.tell() >= ARCHIVE_BYTES:
                        done.append((path.rsplit("/", 1)[1], out.tell()))
                        out.close()
                        out = None
            if out is not None:
                done.append((path.rsplit("/", 1)[1], out.tell()))
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p}" for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
                                         names=["path", "bytes"])

    return cut(told.mapInArrow(run, "path string, bytes long"))


class Source:
    """Bytes of a file by position, read ahead in pieces."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, position: int, least: int) -> bytes:
        """Bytes from ``position`` on, at least ``least`` of them unless the file ends."""
        end = min(position + least, self.size)
        if position < self.start or end > self.start + len(self.data):
            self.start, self.data = position, self.file.read_at(min(max(least, READ_BYTES), self.size - position), position) if position < self.size else b""
        return self.data[position - self.start:]


def member(source: Source, position: int) -> tuple[bytes, int] | None:
    """The decoded WARC record whose gzip member starts at ``position`` and the position behind it, or None."""
    decoder, parts, at = zlib.decompressobj(31), [], position
    try:
        while not decoder.eof:
            raw = source.at(at, 1 << 16)[:1 << 16]
            if not raw:
                return None
            parts.append(decoder.decompress(raw))
            at += len(raw) - len(decoder.unused_data)
            if len(parts) == 1 and not b"WARC/1.".startswith(parts[0][:7]):
                return None
    except zlib.error:
        return None
    if at < source.size and source.at(at, 3)[:3] != MAGIC:
        return None
    return b"".join(parts), at


def records(source: Source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, decoded record) of the records whose member starts in [start, end)."""
    at = start
    while at < end:
        ahead = source.at(at, READ_BYTES)
        found = ahead.find(MAGIC)
        if found < 0:  # the magic may lie across the end of what was read
            at += max(len(ahead) - 2, 1)
            continue
        at += found
        if at >= end:
            return
        got = member(source, at)
        if got is None:
            at += 1
            continue
        yield at, got[0]
        at = got[1]


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of a decoded record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().decode().lower()] = value.strip().decode()
    block = rest[:int(fields.get("content-length", 0))]
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return fields, block


_READ = "path string, position long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload binary"


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record of the archives (path, bytes): its header fields and payload."""
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    count = files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    # an explicit number: rows of ranges are so small that adaptive execution would put them all into one task
    tasks = min(int(count), 8 * files.sparkSession.sparkContext.defaultParallelism)

    def run(batch: pa.RecordBatch):
        for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
            fs, name = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as file:
                rows, held = [], 0
                for position, raw in records(Source(file, size), start, min(start + range_bytes, size)):
                    fields, payload = parse(raw)
                    rows.append((path, position, fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"),
                                 fields.get("warc-refers-to"), fields.get("warc-payload-digest"), payload))
                    held += len(payload)
                    if held >= 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    return map_arrow(ranges.repartition(tasks), run, _READ)


def _batch(rows) -> pa.RecordBatch:
    names = [f.split()[0] for f in _READ.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary()]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per row of ``pages``, read back from archives
    written below ``folder``; a revisit has the payload of the response that it refers to."""
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    read = read_archives(write_archives(pages, folder))
    back = cut(read.select(number("record_id").alias("page_id"), "record_type", number("refers_to").alias("refers_to"),
                           F.substring_index("payload_digest", ":", -1).alias("told"), F.octet_length("payload").cast("long").alias("bytes"),
                           F.sha1("payload").alias("found")))
    response = back.where("record_type = 'response'").select("page_id", "bytes", F.col("found").alias("payload_digest"), "record_type", "refers_to")
    full = response.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("bytes").alias("bytes"))
    revisit = back.where("record_type = 'revisit'").select("page_id", "refers_to", F.col("told").alias("payload_digest"), "record_type") \
        .join(full, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"]
    return response.select(*columns).unionByName(revisit.select(*columns))


def op9_splittable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from archives."""
    folder = shared_folder(spark, "warc")
    result = round_trip(table(spark, sf_dir, "pages"), folder)
    fs, base = pafs.FileSystem.from_uri(folder)  # what was read back lies in a table of its own by now
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        fs.delete_dir(base)
    return result


ORACLES = {"op9_splittable_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS latest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < latest THEN latest END AS refers_to
FROM m
"""}
