"""WARC archives: written one gzip member a record, read back sequentially.

Writing: equal payloads are found by their SHA-1 (partial minimum of page_id before the shuffle); the smallest page_id
becomes a response record, the others revisit records with its HTTP head and no payload. Each task makes members and
Spark's text sink puts them into one file a task on whatever store Spark writes to: a member under 16 MB ends in a zero
byte, which the sink supplies as its line end; after a larger member that zero is padding, which readers of gzip skip. Small
shuffle partitions are written together, as long as all cores have one to write, so that archives aren't many and tiny.

Reading: a member is inflated in small steps, its record framed by Content-Length, and block and payload digests are
verified; a wrong frame or digest is an error. Files are rows of Spark's binary source, so lost tasks read them again.

Null html is an empty payload, a null url has no target header. A null page_id never is the smallest; repeated rows of the
smallest page_id all are responses. A payload of any length is one record, held whole by the task that writes or reads it; an archive's
size is bounded by its records' mean stored size. An empty table gives archives without records. Only page_id, url and html are read, so
other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fresh_path, plan_bytes, slices, stored

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Bytes given to the inflater at a time; stored bytes of a file's records (on average) and records in one file at most; stored
#: bytes that a task writes at least, where there are enough of them for all cores.
STEP, FILE_BYTES, FILE_RECORDS, TASK_BYTES = 1 << 16, 32_000_000, 20_000, 8_000_000
DATE = "1970-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    own = urn[len("<urn:page:") : -1] if urn else ""
    return int(own) if own else None


def record(page_id, url: str | None, payload: bytes, payload_digest: str, refers_to, revisit: bool) -> bytes:
    """One record with its head, block and closing lines."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as one gzip member, without the zero byte that the sink adds where the member ends in one."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out[:-1] if out[-1] == 0 else out


def members(data) -> Iterator[bytes]:
    """The records of an archive, one after another, each inflated step by step; zero padding is skipped."""
    view, at, n = memoryview(data), 0, len(data)
    while at < n:
        if view[at] == 0:
            at += 1
            continue
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= n:
                raise ValueError("the archive ends within a member")
            step = view[at : at + STEP]
            parts.append(inflate.decompress(step))
            at += len(step) - len(inflate.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Head fields (lower-case names) and block of one record, framed by Content-Length and verified."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC head")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    if fields.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        raise ValueError("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    if fields["warc-type"] == "response" and (fields["warc-payload-digest"] != "sha1:" + digest(payload) or int(told["content-length"]) != len(payload)):
        raise ValueError("payload digest")
    return fields | {"payload": payload, "payload_bytes": int(told["content-length"])}


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest_hex, refers_to (null for responses), revisit."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest_hex", F.sha1(F.col("html").cast("binary")))
    first = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest_hex").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # stored, so that the join is one of plain exchanges where it isn't a broadcast, and the pages of a frequent payload are split
    found = rows.join(stored(first.where("n > 1").drop("n"), "payloads"), "digest_hex", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= least_bytes)
    return found.select("page_id", "url", "html", "digest_hex", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> str:
    """Writes pages (page_id, url, html) as *.warc.gz files under path."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                out = []
                for page_id, url, html, hexed, refers_to, revisit in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    told = base64.b32encode(bytes.fromhex(hexed)).decode()
                    out.append(member(record(page_id, url, html.encode("utf-8", "surrogatepass"), told, refers_to, revisit)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    made = plan_records(pages, least_bytes).mapInArrow(run, "member binary")
    rows = made.select(F.col("member").cast("string").alias("value"))
    size = plan_bytes(pages.select("url", "html"))
    records = int(max(1, min(FILE_RECORDS, FILE_BYTES * max(1, pages.count()) / max(1, size))))
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, min(1_000_000, math.ceil(size / TASK_BYTES)))
    rows.coalesce(tasks).write.option("lineSep", "\0").option("maxRecordsPerFile", records).text(path)
    _name_archives(pages.sparkSession, path)
    return path


def _name_archives(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(at, name[:-4] + ".warc.gz"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of each record."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for data in members(content.as_buffer()):
                    f = parse(data)
                    revisit = f["warc-type"] == "revisit"
                    rows.append((_page(f["warc-record-id"]), f.get("warc-target-uri"), None if revisit else f["payload"], f["payload_bytes"], f["warc-payload-digest"][5:], f["warc-type"], _page(f.get("warc-refers-to"))))
                    held += len(data)
                    if held > 8_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
