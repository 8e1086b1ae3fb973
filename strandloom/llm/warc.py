"""WARC archives: a writer with revisit records and a splittable reader.

Writer: each record is a gzip member of its own. Of records with equal payloads of ``least`` bytes or more, the
one with the largest id is a response, the others are revisits that name it and carry no payload. A task writes
its files under a fresh name in the shared folder and returns their names, so that only the files of tasks that
succeeded are listed, whatever was lost or tried twice.

Reader: files are cut into byte ranges. A task looks for the gzip magic in its range, takes a candidate as a
member if it decodes to a WARC header, and reads it to its end, past the range if need be; the next member starts
where that one ends. Records that start inside the range belong to it, so each is read once.

Defined cases: null html is an empty payload; a null url leaves the target out; rows that share the winning id
and payload are all responses; an empty table gives no file and no rows; a null id stays null; other columns are
ignored. Files are reached with pyarrow's file systems, by the scheme of the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_arrow_batches, materialise, new_path, read_table, slices, with_rest

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def id_of(urn: str) -> int | None:
    text = urn.strip("<>").removeprefix("urn:page:")
    return int(text) if text else None


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record as a gzip member."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_urn(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write WARC files into ``folder``; a row of path, bytes, records for each file."""
    with_rest(pages, id_col, url_col, html_col)
    bound_arrow_batches(pages.sparkSession, 1000)
    p = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    first = p.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    typed = p.join(first, "digest", "left").select("page_id", "url", "html", F.when(F.col("page_id") != F.col("winner"), F.col("winner")).alias("refers_to"), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_fs(folder)
        out, rows, name, size, n, k = None, [], "", 0, 0, 0
        tag = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        for part in slices(batches, column=2):
            for page_id, url, html, refers_to, digest in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if out is None:
                    files.create_dir(base, recursive=True)
                    name, size, n, k = f"part-{tag}-{k:04d}.warc.gz", 0, 0, k + 1
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                data = member(page_id, url, html, refers_to, digest)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    rows.append((f"{folder}/{name}", size, n))
        if out is not None:
            out.close()
            rows.append((f"{folder}/{name}", size, n))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return materialise(typed.mapInArrow(run, "path string, bytes long, records long"), "warc-files")


class Window:
    """A file from an offset on, read in blocks as far as needed."""

    def __init__(self, file: pa.NativeFile, start: int, block: int = 1 << 20):
        self.file, self.start, self.block, self.data = file, start, block, b""
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(self.block)
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data = self.data[n:]
        self.start += n


def members(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the members that start in [start, end)."""
    w = Window(file, start)
    while w.start < end:
        at = w.data.find(MAGIC)
        if at < 0:
            w.drop(max(0, len(w.data) - len(MAGIC) + 1))
            if not w.more():
                return
            continue
        w.drop(at)
        if w.start >= end:
            return
        while len(w.data) < 512 and w.more():
            pass
        z = zlib.decompressobj(31)
        try:
            head = z.decompress(w.data[:512], 16)
            if not head.startswith(b"WARC/1."):
                raise zlib.error("no record")
            z, content, used = zlib.decompressobj(31), [], 0
            while not z.eof:
                if used == len(w.data) and not w.more():
                    raise zlib.error("cut off")
                content.append(z.decompress(w.data[used:]))
                used = len(w.data)
            used -= len(z.unused_data)
        except zlib.error:
            w.drop(1)
            continue
        yield w.start, b"".join(content)
        w.drop(used)


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_record(content: bytes) -> tuple:
    fields, block = parse(content)
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).removeprefix("Content-Length: "))
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    refers_to = id_of(fields["WARC-Refers-To"]) if revisit else None
    return id_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], refers_to, size, digest, None if revisit else payload


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record of the files (columns path, bytes), by byte ranges of ``split_bytes``."""
    spark = files.sparkSession
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    ranges = files.where("bytes > 0").select("path", "bytes", cut).select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    n = ranges.count()
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, inner = open_fs(path)
                with store.open_input_file(inner) as f:
                    rows, held = [], 0
                    for _, content in members(f, start, end):
                        rows.append(read_record(content))
                        held += len(content)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    if not n:
        return spark.createDataFrame([], RECORDS)
    return ranges.repartition(min(n, 20_000)).mapInArrow(run, RECORDS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(read_table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
