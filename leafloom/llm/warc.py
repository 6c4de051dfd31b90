"""WARC archives of pages: a writer with revisit records, and a splittable reader.

Writing: of pages with equal payloads of at least `min_revisit` bytes the one with the smallest page_id becomes a response
record, the others revisit it. Which is which follows from a table of (page_id, url, SHA-1, number of equal rows) alone, without
payloads, so that it does not depend on how rows fall to tasks; revisits are written from that table, and payloads move
only to join the responses. Each task writes one file of gzip members, a record each, under a temporary name, and renames it when
it is complete, so that a task which runs again leaves one file.

Reading: every file is cut into byte ranges. A task scans its range for the gzip magic, takes a place as a member only if
decompressing it there yields a WARC version line, and owns the records that start inside its range; it reads on past the
end of the range for the last one. Ranges need no index and no knowledge of each other.

Files are reached through Arrow's file systems, by the URI of the shared folder.

Edge cases: a null html is an empty payload; a null url is written as an empty target. Repeated rows give a record each: of
rows with the smallest page_id one is the response (ties by url), the others revisit it, however the rows are dealt. Rows whose
page_id is null come after all others when the response is chosen. An empty table gives no file and an empty result. Only the
named columns are read, so further ones cannot clash. A record that is cut short or damaged after its first bytes is an error.
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
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.common import cut, discard, table, text_of, work_path

#: Bytes of a range that one task scans.
SPLIT_BYTES = 8 << 20
#: Bytes that are read at once.
BLOCK_BYTES = 1 << 20
#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT_BYTES = 0
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def digest32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id: int | None, url: str, digest: str, payload: bytes | None, refers_to: int | None, size: int) -> bytes:
    """A WARC/1.1 record as one gzip member; without a payload it is a revisit. That holds the HTTP header alone, which still tells
    the payload's size."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    name = lambda x: f"urn:page:{'' if x is None else x}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name(page_id)}>", f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{name(refers_to)}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict:
    """The fields of RECORD from a decompressed record; ValueError if its lengths or digest do not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    number = lambda v: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", v or "")) else None
    revisit, digest = field["WARC-Type"] == "revisit", field["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {field['WARC-Record-ID']}: the payload is not what its header tells")
    return {"page_id": number(field["WARC-Record-ID"]), "record_type": field["WARC-Type"], "url": field.get("WARC-Target-URI", ""), "payload_digest": digest, "payload_bytes": n, "refers_to": number(field.get("WARC-Refers-To")), "payload": None if revisit else payload}


def members(read, size: int, start: int, end: int) -> Iterator[bytes]:
    """Decompressed WARC members that start in [start, end). read(at, n): up to n bytes from there; size: of the whole file."""
    at = start
    while at < end:
        found = read(at, min(BLOCK_BYTES, end - at) + len(MAGIC) - 1)
        k = found.find(MAGIC)
        if k < 0:
            at += max(1, len(found) - len(MAGIC) + 1)
            continue
        at += k
        if at >= end:
            return
        if (got := member(read, size, at)) is None:
            at += 1  # the bytes only look like a member
            continue
        data, used = got
        yield data
        at += used


def member(read, size: int, at: int) -> tuple[bytes, int] | None:
    """The member that starts at `at`, decompressed, and its length in the file; None if no WARC record starts there. ValueError if
    one does and does not end well."""
    z, raw = zlib.decompressobj(31), read(at, 4096)
    try:
        start = z.decompress(raw, len(VERSION))  # no more is decompressed before this shows what it is
    except zlib.error:
        return None
    if start != VERSION:
        return None
    out, place, raw = [start], at + len(raw), z.unconsumed_tail
    while not z.eof:
        if not raw:
            raw = read(place, BLOCK_BYTES // 8)
            place += len(raw)
        try:
            if not raw:
                raise zlib.error("the file ends inside a record")
            out.append(z.decompress(raw))
        except zlib.error as e:
            raise ValueError(f"damaged record at byte {at}: {e}") from None
        raw = b""
    return b"".join(out), place - at - len(z.unused_data)


def kinds(pages: DataFrame, min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """From (page_id, url, sha, bytes): different rows with `copies`, how many equal ones there are, `responses`, how many of them
    become response records, and `first`, the page_id that revisits refer to."""
    rows = cut(pages.groupBy("page_id", "url", "sha", "bytes").agg(F.count("*").alias("copies")))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    first = rows.groupBy(F.col("sha").alias("of")).agg(F.min(order).alias("first"))
    marked = rows.join(first, rows["sha"] == first["of"])
    chosen = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    responses = F.when(F.col("bytes") < min_revisit, F.col("copies")).otherwise(chosen.cast("long"))
    return marked.select("page_id", "url", "sha", "bytes", "copies", responses.alias("responses"), F.col("first.page_id").alias("first"))


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """A row for each record to write: page_id, url, sha, bytes, refers_to and payload, which is null for revisits."""
    url = text_of("url")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.encode(text_of("html"), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    all_kinds = cut(kinds(p.select("page_id", "url", "sha", F.octet_length("payload").cast("long").alias("bytes")), min_revisit))
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))
    again = all_kinds.withColumn("n", F.col("copies") - F.col("responses")).where("n > 0").withColumn("i", times("n"))
    revisits = again.select("page_id", "url", "sha", "bytes", F.col("first").alias("refers_to"), F.lit(None).cast("binary").alias("payload"))
    name = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "sha", "url")))
    # one payload for each different row: the limit of one also holds before the exchange
    one = p.select(name.alias("of"), "payload").withColumn("turn", F.row_number().over(Window.partitionBy("of").orderBy("of"))).where("turn = 1").drop("turn")
    chosen = all_kinds.where("responses > 0").withColumn("id", name)
    responses = chosen.join(one, F.col("id") == F.col("of")).withColumn("i", times("responses")).select("page_id", "url", "sha", "bytes", F.lit(None).cast("long").alias("refers_to"), "payload")
    return responses.union(revisits)


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes `pages` (page_id, url, html) to archives below `path`: a row (file, size) for each."""

    def run(batches):
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():06d}.warc.gz"
        part, size, stream = f"{root}/.{task.taskAttemptId()}.part", 0, None
        for b in batches:
            for r in b.to_pylist():
                stream = stream or store.open_output_stream(part)
                data = record(r["page_id"], r["url"], digest32(r["sha"]), r["payload"], r["refers_to"], r["bytes"])
                stream.write(data)
                size += len(data)
        if stream:
            stream.close()
            store.move(part, name)
            yield pa.RecordBatch.from_pydict({"file": [name], "size": [size]}, schema=pa.schema([("file", pa.string()), ("size", pa.int64())]))

    return cut(records(pages, min_revisit).mapInArrow(run, "file string, size long"))


def read(spark: SparkSession, path: str, files: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """The records (RECORD) of `files` (file, size), which lie on the file system of `path`."""
    ranges = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    tasks = ranges.repartition(spark.sparkContext.defaultParallelism * 4, "file", "start")

    def run(batches):
        store, _ = fs.FileSystem.from_uri(path)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for r in b.to_pylist():
                with store.open_input_file(r["file"]) as f:

                    def at(place: int, n: int, f=f, size=r["size"]) -> bytes:
                        return f.read_at(max(0, min(n, size - place)), place)

                    rows, held = [], 0
                    for data in members(at, r["size"], r["start"], min(r["start"] + split, r["size"])):
                        rows.append(parse(data))
                        held += len(data)
                        if held > BLOCK_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return tasks.mapInArrow(run, RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The archives are deleted when they have been read."""
    path = work_path(spark, "warc")
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    files = write(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    out = cut(read(spark, path, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    discard(spark, path)
    return out


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT h, h AS hex FROM f),
bits AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + v, 1), '' ORDER BY k) AS b32
  FROM (SELECT h, k, (('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (5 * (3 - k % 4))) & 31 AS v FROM f, range(32) AS r(k)) GROUP BY h)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h) JOIN bits USING (h)
"""
