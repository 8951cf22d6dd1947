"""Legacy archive converter: ARC files to WARC files, and both readers.

An ARC file starts with a version block that names its header layout (version
1: five fields, version 2: ten); every record is one header line, as many
bytes as its last field declares, and a line feed. The converter parses these
and synthesises what WARC wants and ARC lacks: a record id (UUID of address,
date, payload digest, archive and place in it, so that repeated rows have ids
of their own and a rerun task the same ones), an ISO time stamp, the record type and SHA-256
digests. Payloads that occur more than once become revisit records.

Archives are real files: one row holds one archive of bounded size and is
written as one gzip file by Spark's text writer (the archive's last line feed
is the writer's line end), and read back with ``binaryFile``, so only Spark
touches storage. A task holds one archive at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path, ship_package

ARCHIVE_BYTES = 8 << 20
MIN_REVISIT = 100
CAPTURED = "20240101000000"
# Header layouts of ARC versions 1 and 2.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD_SCHEMA = ("page_id long, url string, captured string, content_type string, record_id string, message binary, "
                 "payload_bytes long, payload_digest string, row_key string")


def arc_version_block(name: str, version: int, captured: str) -> bytes:
    body = f"{version} 0 Origin\n{ARC_FIELDS[version]}\n".encode()
    tail = {1: "", 2: " 200 - - 0 " + name}[version]
    return f"filedesc://{name} 0.0.0.0 {captured} text/plain{tail} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, message: bytes, version: int, captured: str, name: str, offset: int) -> bytes:
    fields = [url, "192.0.2.1", captured, "text/html"]
    if version == 2:
        fields += ["200", "-", "-", str(offset), name]
    return " ".join(fields + [str(len(message))]).encode("ascii") + b"\n" + message + b"\n"


def http_message(page_id, html: bytes) -> bytes:
    mark = b"" if page_id is None or page_id is pd.NA else b"X-Page-Id: %d\r\n" % int(page_id)
    return (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + mark
            + b"Content-Length: %d\r\n\r\n" % len(html) + html)


def read_arc(data: bytes) -> Iterator[tuple[dict, bytes, int]]:
    """``(header fields, content, offset)`` of every record after the version
    block. A line that is no header of the declared layout is skipped, so a
    damaged record does not lose those behind it; a record cut off at the end
    of the file is left out."""
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        parts = data[at:end].split(b" ")
        if parts[0].startswith(b"filedesc://") and parts[-1].isdigit():
            body = data[end + 1:end + 1 + int(parts[-1])]
            version = 2 if body.startswith(b"2 ") else 1
            at = end + 1 + int(parts[-1])
            continue
        names = ARC_FIELDS[version].split(" ")
        if len(parts) != len(names) or not parts[-1].isdigit():
            at = end + 1
            continue
        n = int(parts[-1])
        content = data[end + 1:end + 1 + n]
        if len(content) < n:
            return
        yield dict(zip(names, (p.decode("latin-1") for p in parts))), content, at
        at = end + 1 + n


def split_message(message: bytes) -> tuple[dict[str, str], bytes]:
    """Lower-cased HTTP headers and the body of an HTTP message (no blank
    line: everything is body)."""
    head, blank, body = message.partition(b"\r\n\r\n")
    if not blank:
        return {}, message
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8") + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """``(lower-cased headers, block)`` of every record, by declared length."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers["content-length"])
        yield headers, data[end + 4:end + 4 + n]
        at = end + 4 + n


def _archives(records: Iterator[bytes], begin) -> Iterator[pd.DataFrame]:
    """Gather records into archives of about ``ARCHIVE_BYTES``, one row each,
    without the last byte (the writer's line end)."""
    held, size, count = [], 0, 0
    for r in records:
        if not held:
            held, size, count = [begin(count)], 0, count + 1
        held.append(r(size) if callable(r) else r)
        size += len(held[-1])
        if size >= ARCHIVE_BYTES:
            yield pd.DataFrame({"archive": [b"".join(held)[:-1]]})
            held = []
    if held:
        yield pd.DataFrame({"archive": [b"".join(held)[:-1]]})


def _save(archives: DataFrame, path: str) -> None:
    """One gzip file per row. The cast keeps the bytes as they are."""
    (archives.select(F.col("archive").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").text(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, captured: str = CAPTURED) -> None:
    """Write ``pages`` (page_id, url, html) as ARC files, versions 1 and 2 in
    turn. NULL html is an empty payload, a NULL url ``unknown:``."""
    def build(frames):
        state = {"version": 1, "name": ""}

        def begin(count):
            state.update(version=1 + count % 2, name=f"part-{TaskContext.get().partitionId():05d}-{count}.arc")
            return arc_version_block(state["name"], state["version"], captured)

        def records():
            for f in frames:
                for page_id, url, html in zip(f["page_id"], f["url"], f["html"]):
                    body = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                    address = quote(url, safe="/:?#[]@!$&'()*+,;=%~-._") if isinstance(url, str) and url else "unknown:"
                    message = http_message(None if pd.isna(page_id) else page_id, body)
                    yield lambda at, a=address, m=message: arc_record(a, m, state["version"], captured, state["name"], at)
        yield from _archives(records(), begin)

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    _save(rows.mapInPandas(build, "archive binary"), path)


def read_arc_files(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """Records of the ARC files below ``path`` with the synthesised WARC
    fields (``RECORD_SCHEMA``). ``content=False`` leaves ``message`` NULL."""
    def parse(frames):
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                rows = []
                for head, message, at in read_arc(gzip.decompress(data)):
                    http, payload = split_message(message)
                    digest = hashlib.sha256(payload).hexdigest()
                    page = http.get("x-page-id")
                    row_key = f"{name.rsplit('/', 1)[-1]}:{at:012d}"
                    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{head['URL']} {head['Archive-date']} {digest} {page} {row_key}")
                    rows.append((int(page) if page else None, head["URL"], head["Archive-date"], head["Content-type"],
                                 f"<urn:uuid:{ident}>", message if content else None, len(payload), digest, row_key))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD_SCHEMA.split(", ")])
                out["page_id"] = out["page_id"].astype("Int64")
                yield out
    return _files(spark, path).mapInPandas(parse, RECORD_SCHEMA)


def convert_arc(spark: SparkSession, arc: str, warc: str, min_revisit: int = MIN_REVISIT) -> None:
    """Convert the ARC files below ``arc`` to WARC files below ``warc``. Of
    records with equal payloads of at least ``min_revisit`` bytes, the one
    with the smallest page id (then the first in the archives; NULL ids last)
    is the response, the others are revisits of it without a body. The first
    pass carries digests only; payloads are shuffled once, by digest."""
    keys = read_arc_files(spark, arc, content=False)
    order = F.struct(F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("rank"), "row_key", "page_id", "record_id")
    first = (keys.filter(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest")
             .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    rows = read_arc_files(spark, arc).join(first, "payload_digest", "left")
    rows = rows.withColumn("revisit", F.coalesce(F.col("row_key") != F.col("first.row_key"), F.lit(False))) \
        .select("*", F.col("first.page_id").alias("first_page"), F.col("first.record_id").alias("first_record")) \
        .drop("first", "copies")
    rows = rows.withColumn("message", F.when(~F.col("revisit"), F.col("message"))) \
        .withColumn("page_id", F.col("page_id").cast("string")).withColumn("first_page", F.col("first_page").cast("string"))

    def build(frames):
        def begin(count):
            body = b"software: tessera\r\nformat: WARC File Format 1.0\r\n"
            archive = f"info {warc} {TaskContext.get().partitionId()} {count}"
            return warc_record([("WARC-Type", "warcinfo"), ("WARC-Date", "2024-01-01T00:00:00Z"),
                                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, archive)}>"),
                                ("Content-Type", "application/warc-fields")], body)

        def records():
            for f in frames:
                for r in f.itertuples(index=False):
                    c = r.captured
                    headers = [("WARC-Type", "revisit" if r.revisit else "response"), ("WARC-Target-URI", r.url),
                               ("WARC-Date", f"{c[:4]}-{c[4:6]}-{c[6:8]}T{c[8:10]}:{c[10:12]}:{c[12:14]}Z"),
                               ("WARC-Record-ID", r.record_id), ("WARC-Payload-Digest", f"sha256:{r.payload_digest}"),
                               ("X-Payload-Length", str(r.payload_bytes)),
                               ("Content-Type", "application/http; msgtype=response")]
                    if isinstance(r.page_id, str):
                        headers.append(("X-Page-Id", r.page_id))
                    if r.revisit:
                        headers += [("WARC-Refers-To", r.first_record),
                                    ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
                        if isinstance(r.first_page, str):
                            headers.append(("X-Refers-To-Page-Id", r.first_page))
                    yield warc_record(headers, b"" if r.revisit else bytes(r.message))
        yield from _archives(records(), begin)

    _save(rows.mapInPandas(build, "archive binary"), warc)


def read_warc_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    record_id`` (and ``payload``) per response or revisit record. Size and
    digest of a response come from its payload as read."""
    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
              "url string, record_id string" + (", payload binary" if content else ""))

    def parse(frames):
        for f in frames:
            for data in f["content"]:
                rows = []
                for h, block in read_warc(gzip.decompress(data)):
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    number = lambda k: int(h[k]) if k in h else None
                    if h["warc-type"] == "response":
                        payload = split_message(block)[1]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    else:
                        payload, size = None, int(h["x-payload-length"])
                        digest = h["warc-payload-digest"].partition(":")[2]
                    row = (number("x-page-id"), size, digest, h["warc-type"], number("x-refers-to-page-id"),
                           h["warc-target-uri"], h["warc-record-id"])
                    rows.append(row + ((payload,) if content else ()))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                for c in ("page_id", "refers_to"):
                    out[c] = out[c].astype("Int64")
                yield out
    return _files(spark, path).mapInPandas(parse, schema)


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Pages -> ARC files -> WARC files -> records read back, one per page.
    Extra columns are ignored; NULL ids stay NULL; repeated rows are records
    of their own; an empty table writes no archive and gives no rows."""
    spark = pages.sparkSession
    ship_package(spark)
    write_arc(pages, f"{folder}/arc")
    convert_arc(spark, f"{folder}/arc", f"{folder}/warc")
    return read_warc_files(spark, f"{folder}/warc")


def archive_pages_scratch(pages: DataFrame, name: str) -> DataFrame:
    """As above, below the shared checkpoint folder."""
    return archive_pages(pages, scratch_path(pages.sparkSession, f"{name}-{uuid.uuid4().hex}"))
