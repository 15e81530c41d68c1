"""WARC archives: written with an index first, read back by coalesced byte ranges.

Each page becomes one record, a gzip member of its own. Of pages with equal payloads (of at
least `revisit_from` bytes) the one with the smallest id is written as a response and the
others as revisits of it. The tasks that write the archives also give the index rows
(file, offset, length, URL, digest, ...); the index table names only the files of tasks that
succeeded, so a task that is repeated after the loss of an executor leaves at most a file
that nothing refers to. Reading selects index rows, sorts them by file and offset, merges
near ranges into one read, and checks every response against its digest.

Defined results: a null payload is empty; a null URL is left out of the record and comes
back null, and white space and control characters of a URL come back percent-encoded; an empty table
gives an index and a result without rows; a null id comes back null and is smaller than none (it is a response only if all
its copies have null ids). Rows that repeat the smallest id of their payload are all
responses. Other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, map_arrow, materialise, scratch_path, slices

#: A file is closed once it has this size, so one file is a task's worth of reading.
FILE_BYTES = 64 << 20
#: Ranges closer than this are read as one, up to RANGE_BYTES.
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
#: Digests with several pages are broadcast up to this many (some 80 bytes each).
BROADCAST_ROWS = 100_000
#: Compressed bytes that a task reads back, and pages of one payload that one task of a shuffle gets.
TASK_BYTES = 32 << 20
SALT_ROWS = 200_000
DATE = "2000-01-01T00:00:00Z"
INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _roles(pages: DataFrame, id_col: str, revisit_from: int) -> DataFrame:
    """pages with __first: the least id of equal payloads, null where there is no other copy."""
    own = pages.withColumn("__size", F.octet_length("__payload").cast("long")).withColumn("__sha", F.sha1("__payload"))
    groups = own.where(F.col("__size") >= revisit_from).groupBy("__sha").agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("__n"))
    groups = materialise(groups.where("__n > 1"), "warc-copies")
    count, most = groups.agg(F.count(F.lit(1)), F.max("__n")).first()
    groups = groups.drop("__n")
    if count <= BROADCAST_ROWS:
        return own.join(F.broadcast(groups), "__sha", "left")
    # Too many to broadcast: a shuffle, in which the pages of a hot digest go to as many tasks as they need.
    salts = -(-most // SALT_ROWS)
    salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = own.withColumn("__salt", F.pmod(F.xxhash64(id_col, "__url"), F.lit(salts)).cast("int"))
    return own.join(salted, ["__sha", "__salt"], "left").drop("__salt")


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id, url, payload: bytes, first, digest: str, date: str = DATE) -> tuple[bytes, str]:
    """(gzip member, record type) of one page."""
    kind = "response" if first is None or first == page_id else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush(), kind


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes one record for each row below folder; gives the index, written as a table there."""
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).alias("__url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("__payload"))
    rows = _roles(rows, "__id", revisit_from).select("__id", "__url", "__payload", "__first")
    schema = arrow_schema(INDEX)

    def write(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        out, name, at, n = None, "", 0, 0
        for b in slices(batches, 256):
            got = []
            for i, url, payload, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, at = f"part-{uuid.uuid4().hex}-{n:04d}.warc.gz", 0
                    out, n = store.open_output_stream(f"{path}/{name}", compression=None), n + 1
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                member, kind = record_bytes(i, url, payload, first, digest)
                out.write(member)
                got.append((i, url, digest, len(payload), kind, first if kind == "revisit" else None, name, at, len(member)))
                at += len(member)
                if at >= file_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)
        if out is not None:
            out.close()

    spark = pages.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(conf).mkdirs(at)
    index = map_arrow(rows, write, INDEX)
    index.write.option("compression", "zstd").parquet(f"{folder}/index")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def parse_record(member: bytes) -> dict:
    """Fields of one record; a response is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def number(urn):
        x = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def coalesce_ranges(rows: Iterator[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, [(offset, length)]) of merged ranges; rows are sorted by file and offset."""
    now: tuple | None = None
    for file, offset, length in rows:
        if now and now[0] == file and offset - now[2] <= gap and max(now[2], offset + length) - now[1] <= most:
            now[3].append((offset, length))
            now = (file, now[1], max(now[2], offset + length), now[3])
        else:
            if now:
                yield now
            now = (file, offset, offset + length, [(offset, length)])
    if now:
        yield now


def read_records(selected: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows."""
    ddl = RECORD if with_payload else RECORD.rpartition(", payload")[0]
    schema, spark = arrow_schema(ddl), selected.sparkSession

    def read(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        rows = ((f, o, n) for b in slices(batches, 4096) for f, o, n in zip(*(c.to_pylist() for c in b.columns), strict=True))
        name, source = None, None
        for file, start, end, parts in coalesce_ranges(rows):
            if file != name:
                name, source = file, store.open_input_file(f"{path}/{file}")
            chunk = source.read_at(end - start, start)
            got = [parse_record(chunk[o - start : o - start + n]) for o, n in parts]
            yield pa.RecordBatch.from_arrays([pa.array([g[f.name] for g in got], type=f.type) for f in schema], schema=schema)

    # Tasks by bytes of the records, not of the index rows, and several for a large file.
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    by_file = selected.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return map_arrow(by_file, read, ddl)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder, with_payload=False)


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, {1 + 5 * i}, 5))::BIGINT >> {s}) & 31)::INT, 1)" for i in range(8) for s in (15, 10, 5, 0))
QUERIES = {"op10_warc": op10_warc}
ORACLES = {
    "op10_warc": f"""
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first_id FROM p GROUP BY sha)
SELECT page_id, url, payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (sha)"""
}
