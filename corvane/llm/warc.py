"""WARC archives: write, normalise monolithic gzip files to a member per record, index, and read back."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import materialize, new_path

#: Payloads below this many bytes are never replaced by a revisit.
MIN_REVISIT_BYTES = 0
#: Target of uncompressed payload per archive, for archives of a bounded size.
ARCHIVE_BYTES = 32 << 20
LEVEL = 1
BLOCK = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head only; the head always gives the full payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, in blocks; each byte is inflated once. A stream that ends before its last member's checksum and length is an error."""
    z = zlib.decompressobj(31)
    data, begun = stream.read(BLOCK), False
    while data:
        begun = True
        out = z.decompress(data, 4 * BLOCK)
        if out:
            yield out
        if z.eof:
            data = z.unused_data or stream.read(BLOCK)
            if data:
                z = zlib.decompressobj(31)
        else:
            data = z.unconsumed_tail or stream.read(BLOCK)
    while begun and not z.eof and (out := z.decompress(b"", 4 * BLOCK)):
        yield out
    if begun and not z.eof:
        raise ValueError("gzip stream ends within a member")


_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)", re.I)


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """WARC records of a stream of blocks, cut by their Content-Length and with the separator after them."""
    buf, at = bytearray(), 0
    for block in blocks:
        if at:
            del buf[:at]
            at = 0
        buf += block
        while (end := buf.find(b"\r\n\r\n", at)) >= 0:
            m = _LENGTH.search(buf, at, end + 2)
            if not buf.startswith(b"WARC/", at) or m is None:
                raise ValueError("no WARC record at its place")
            stop = end + 4 + int(m[1]) + 4
            if stop > len(buf):
                break
            yield bytes(buf[at:stop])
            at = stop
    if at < len(buf):
        raise ValueError("the stream ends within a record")


def normalise(source: str, target: str) -> int:
    """Rewrite a gzip WARC as one member per record, with `target`.idx of (offset, length) per record; the number of records.

    Both files are written under a name of their own first and moved into
    place, so that a task that dies half-way leaves nothing that is read.
    """
    fs, path = _fs(source)
    out_fs, out = _fs(target)
    offset, n = 0, 0
    own = f"{out}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    with fs.open_input_stream(path, compression=None) as src, out_fs.open_output_stream(f"{own}.gz", compression=None) as dst, out_fs.open_output_stream(f"{own}.ix", compression=None) as idx:
        for rec in records(inflated(src)):
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = z.compress(rec) + z.flush()
            dst.write(member)
            idx.write(b"%s\n" % json.dumps([offset, len(member)]).encode())
            offset += len(member)
            n += 1
    for mine, final in ((f"{own}.gz", out), (f"{own}.ix", f"{out}.idx")):
        if out_fs.get_file_info(final).type != pafs.FileType.NotFound:
            out_fs.delete_file(final)  # of an earlier attempt, with the same bytes
        out_fs.move(mine, final)
    return n


_HEAD = re.compile(r"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)


def parse(rec: bytes) -> dict:
    """Fields of one record; the payload's length and digest are of the full payload, and a response's are taken from its bytes."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in _HEAD.findall(head.decode("utf-8"))}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(_LENGTH.search(b"\r\n" + http)[1])
    if not revisit and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    number = lambda x: int(x) if x else None
    own = fields["warc-record-id"].strip("<>").removeprefix(_ID)
    return {
        "page_id": number(own), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"],
        "refers_to": number(fields["warc-refers-to"].strip("<>").removeprefix(_ID)) if revisit else None,
    }


def read_archive(path: str) -> Iterator[dict]:
    """Records of a normalised archive, each read through its index entry."""
    fs, p = _fs(path)
    with fs.open_input_stream(f"{p}.idx") as idx:
        entries = [json.loads(x) for x in idx.read().splitlines()]
    with fs.open_input_file(p) as f:
        for offset, length in entries:
            yield parse(zlib.decompress(f.read_at(length, offset), 31))


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page into monolithic gzip archives under folder; one row (path, n) per archive.

    Digests are grouped first, so each task knows which of its payloads are
    revisits. A file's name holds the partition and the attempt; only names
    that a finished task returned are ever read.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    src = src.withColumn("sha1", F.sha1(F.encode("html", "utf-8")))
    first = materialize(src.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"), "repeats")
    planned = src.join(first, "sha1", "left").select("page_id", "url", "html", "sha1", "first_id")

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = TaskContext.get()
        fs, base = _fs(folder)
        out, done, size, z = None, [], 0, None
        for b in it:
            for page, url, html, sha1, first_id in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"{t.partitionId():06d}-{t.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, z, size = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                    done.append([f"{folder}/{name}", 0])
                payload = html.encode("utf-8")
                revisit = first_id is not None and page != first_id and len(payload) >= min_bytes
                digest = base64.b32encode(bytes.fromhex(sha1)).decode("ascii")
                out.write(z.compress(record(page, url, payload, digest, first_id if revisit else None, revisit)))
                size += len(payload)
                done[-1][1] += 1
                if size >= ARCHIVE_BYTES:
                    out.write(z.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "n"])

    make_folder(pages.sparkSession, folder)
    return materialize(planned.mapInArrow(put, "path string, n bigint"), "archives")


def make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as monolithic archives, normalise and index them, and read every record back.

    One row per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to, archive. Null html is an empty payload; null urls give records
    without a target. Of equal payloads the smallest page_id is the response
    (repeated rows with that page_id are responses too); rows with a null
    page_id revisit it, or are responses if all with that payload have none.
    Extra columns are ignored; an empty table gives no archives and no rows.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    archives = write(pages, f"{folder}/raw", min_bytes, id_col, url_col, html_col)
    make_folder(spark, f"{folder}/members")

    def rewrite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                target = f"{folder}/members/{path.rpartition('/')[2]}"
                if normalise(path, target) != n:
                    raise ValueError(f"{path} has lost records")
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], ["path", "n"])

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string())])
        for b in it:
            for path in b.column(0).to_pylist():
                rows = []
                for r in read_archive(path):
                    rows.append(r | {"archive": path.rpartition("/")[2]})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, archives.count())
    members = materialize(archives.repartition(n, "path").mapInArrow(rewrite, "path string, n bigint"), "members")
    return members.repartition(n, "path").mapInArrow(
        read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string"
    )


#: base32 of a SHA-1: 32 characters of 5 bits.
ORACLE_SQL = """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT page_id, payload_bytes, hex,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::UBIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest
  FROM d),
f AS (SELECT hex, min(page_id) AS first_id FROM d GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM b JOIN f USING (hex)
"""
