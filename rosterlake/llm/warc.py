"""WARC archives: writing pages as records, and a splittable reader.

``write_pages`` writes gzip-compressed WARC files, one member for each record, into a folder that all
executors share. ``read_records`` scans byte ranges: a task looks for gzip magic in its range, takes a
candidate for a record if the bytes decode to a WARC header, owns the records that start inside its
range and reads each to its end, which may lie behind the range. Nothing but the range borders is
needed to split a file, however large.

A task names its file anew at each attempt and lists it only when it is complete; only listed files are
read, so a lost or repeated attempt leaves nothing behind that counts.

Defined results: a null html is an empty payload, a null url an empty one; of equal payloads of at least
``least_bytes`` bytes the smallest page id is the response, on repeated rows with that id each is a
response; a page without an id is a response, which none refers to, and its record's id has no number; an
empty table gives no files and no records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import file_system, keep, shared_dir

MAGIC = b"\x1f\x8b\x08"
LEAST_BYTES, SPLIT = 100, 4 << 20
#: A fixed date keeps repeated attempts equal.
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, digest: str, payload_bytes: int) -> bytes:
    """One gzip member with a response, or a revisit that holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join(url.split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + block + b"\r\n\r\n") + deflate.flush()


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, payload, digest, refers_to)``: which pages are responses and which revisit another."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload"))
    # digests travel without payloads: copies of one page, however many, are a few bytes each
    small = keep(rows.select("id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size")))
    first = small.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    revisits = small.where(F.col("size") >= least_bytes).join(first.hint("merge"), "digest").where("id > first").select("id", "digest", F.col("first").alias("refers_to")).distinct()
    named = rows.withColumn("digest", F.sha2("payload", 256))
    return named.join(revisits.hint("merge"), ["id", "digest"], "left").select("id", "url", "payload", "digest", "refers_to")


def write_pages(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one archive for each task into ``folder``; returns the files written: ``(path, bytes, records)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = file_system(folder)
        path = f"{place}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, size, records = None, 0, 0
        for batch in batches:
            for page, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    system.create_dir(place, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                raw = record(page, url, payload, refers_to, digest, len(payload))
                out.write(raw)
                size, records = size + len(raw), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([records])], names=["path", "bytes", "records"])

    return keep(plan_records(pages, least_bytes, id_col, url_col, html_col).mapInArrow(run, "path string, bytes long, records long"))


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (both by lower-case name) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")

    def fields(text: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in text.decode("utf-8", "replace").split("\r\n")[1:])}

    warc = fields(head)
    http, _, payload = rest[: int(warc.get("content-length", 0))].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def starts(data: bytes, first: int, last: int) -> Iterator[int]:
    at = data.find(MAGIC, first)
    while 0 <= at < last:
        yield at
        at = data.find(MAGIC, at + 1)


def scan(handle, size: int, begin: int, end: int, chunk: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """Records that start in [begin, end) of an open file: (offset, uncompressed bytes)."""
    handle.seek(begin)
    own = handle.read(min(size, end + chunk) - begin)  # enough behind the range to see a header that starts in it
    done = 0
    for at in starts(own, 0, end - begin):
        if at < done:
            continue
        inflate = zlib.decompressobj(31)
        try:
            parts = [inflate.decompress(own[at : at + chunk], 1 << 10)]
            if not parts[0].startswith(b"WARC/"):
                continue
            fed = at + chunk  # what lies behind it has not been given to the decoder
            parts.append(inflate.decompress(inflate.unconsumed_tail))
            while not inflate.eof and fed < len(own):
                parts.append(inflate.decompress(own[fed : fed + chunk]))
                fed += chunk
            fed, place = min(fed, len(own)), begin + len(own)
            while not inflate.eof and place < size:
                handle.seek(place)
                more = handle.read(chunk)
                parts.append(inflate.decompress(more))
                place += len(more)
            if not inflate.eof:
                continue
        except zlib.error:
            continue
        done = max(at + 1, fed - len(inflate.unused_data)) if place == begin + len(own) else len(own)
        yield begin + at, b"".join(parts)


RECORDS = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("path", T.StringType()), T.StructField("offset", T.LongType())])


def read_records(files: DataFrame, folder: str, split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """Records of the files ``(path, bytes)``. A revisit's length and digest are those of the payload it refers to."""
    spark = files.sparkSession
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("begin"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = ranges.repartition(tasks, F.xxhash64("path", "begin")).select("path", "bytes", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for path, size, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with system.open_input_file(path) as handle:
                    for offset, raw in scan(handle, size, begin, min(size, begin + split)):
                        warc, http, payload = parse(raw)
                        kind = warc.get("warc-type", "")
                        revisit = kind == "revisit"
                        digest = warc.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                        length = int(http.get("content-length", 0)) if revisit else len(payload)
                        rows.append((warc.get("warc-record-id"), kind, warc.get("warc-target-uri"), warc.get("warc-refers-to"), digest, length, payload if with_payload else None, path, offset))
                        held += len(payload) * with_payload
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=RECORDS.names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=RECORDS.names)

    return dealt.mapInArrow(run, RECORDS)


TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
