"""WARC archives: writing with segmentation, chunked framing and revisits, and reading back by segment reassembly.

A page is an HTTP response with chunked transfer framing. A record whose block exceeds `segment` bytes is cut: the first part is the record itself,
the others are continuation records that name its identifier as their origin and carry a segment number; the last one
states the total length. Archives are gzip members, one per record, and are written by the tasks to the shared folder under names that no other
attempt of a task has. The manifest, whose rows are those of the attempts that counted, names the archives; only these are read.

Reading splits archives into records, groups the parts of cut records by origin identifier, orders them by segment number, verifies that
the numbers have no gap and the lengths add up to the total, and decodes the chunked framing.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches, looked_up

MIN_REVISIT = 100
_CRLF = b"\r\n"
_DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """Chunked transfer framing."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, _CRLF]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are skipped, and a cut or false frame raises ValueError."""
    out, at = [], 0
    while True:
        end = framed.index(_CRLF, at)
        n = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if framed[at + n : at + n + 2] != _CRLF:
            raise ValueError("a chunk has another length than it states")
        out.append(framed[at : at + n])
        at += n + 2


def record(kind: str, fields: list[tuple[str, str]], block: bytes, mime: str = "application/http;msgtype=response") -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Date", _DATE), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + _CRLF + block + _CRLF + _CRLF


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    block = data[end + 4 : end + 4 + n]
    if len(block) != n:
        raise ValueError("a record is shorter than it states")
    return fields, block


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, one after another."""
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data) + d.flush()
        data = d.unused_data


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, name: str, segment: int) -> list[bytes]:
    """The records of one page. name: unique text for the identifier."""
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "about:blank")
    fields = [("WARC-Target-URI", target), ("WARC-Page-ID", "" if page_id is None else str(page_id)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if original is not None:
        fields += [("WARC-Record-ID", own), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", str(original))]
        return [record("revisit", fields, http)]
    block = http + chunked(payload)
    if len(block) <= segment:
        return [record("response", [*fields, ("WARC-Record-ID", own)], block)]
    out = [record("response", [*fields, ("WARC-Record-ID", own), ("WARC-Segment-Number", "1")], block[:segment])]
    starts = range(segment, len(block), segment)
    for n, at in enumerate(starts, 2):
        more = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{n}')}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n))]
        if at + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record("continuation", more, block[at : at + segment]))
    return out


def write_archives(pages: DataFrame, folder: str, segment: int = 32_768, archive_bytes: int = 4 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes the archives and returns their manifest, (path, records) of each.

    Null payloads are empty. Of equal payloads of min_revisit bytes or more, rows with the smallest id are responses (repeated rows of that id all
    are), the others revisits; null ids come last. Payloads count as equal by length and SHA-256. Further columns are ignored.

    Digests are compared on slim rows. The pages meet the repeated digests by a broadcast; only where these exceed the bound are payloads
    shuffled, and then those of a digest that many pages have are dealt to several tasks.
    """
    spark = pages.sparkSession
    batches(spark)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    digests = pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    same = digests.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.min("id").alias("original"), F.count("*").alias("held"))
    same = Scratch(spark, "warc-digests").written(same.where("held > 1 AND original IS NOT NULL"), "same")
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    p = looked_up(p, same, ["digest"], same.count(), 160, per_task=1 << 14)
    p = p.select("id", "url", "payload", "digest", F.when(F.col("original").eqNullSafe(F.col("id")), None).otherwise(F.col("original")).alias("original"))

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        held, size, count, n, row = [], 0, 0, 0, 0

        def closed() -> pa.RecordBatch:
            name = f"part-{part:06d}-{n:05d}-{attempt}.warc.gz"
            with store.open_output_stream(f"{at}/{name}", compression=None) as f:
                for x in held:
                    f.write(x)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], names=["path", "records"])

        for b in rows:
            for page_id, url, data, digest, original in zip(*(c.to_pylist() for c in b.columns)):
                for r in records_of(page_id, url, data, digest, original, f"{folder}/{part}/{row}", segment):
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    held.append(z.compress(r) + z.flush())
                    size += len(held[-1])
                    count += 1
                row += 1
                if size >= archive_bytes:
                    yield closed()
                    held, size, count, n = [], 0, 0, n + 1
        if held:
            yield closed()

    return p.mapInArrow(write, "path string, records long")


_ROW = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _page(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, type, bytes, digest, refers_to); the digest is taken from the decoded payload, and must be the one stated."""
    number = lambda k: int(fields[k]) if fields.get(k) else None
    stated = fields["warc-payload-digest"].partition(":")[2]
    if fields["warc-type"] == "revisit":
        return number("warc-page-id"), "revisit", None, stated, number("warc-refers-to-page-id")
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if (digest := hashlib.sha256(payload).hexdigest()) != stated:
        raise ValueError("a payload does not have its stated digest")
    return number("warc-page-id"), "response", len(payload), digest, None


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of every archive in a folder that has no manifest."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")


def read_archives(archives: DataFrame, scratch: Scratch, per_task: int = 2) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to) per response and revisit. archives: path, of which a task reads per_task.

    Segments that are missing, repeated or of another total length, and payloads without their stated digest, raise a ValueError.
    """
    batches(archives.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("fields", pa.string()), ("block", pa.binary())])

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def sent(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for b in rows:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as f:
                    content = f.read()  # an archive is at most archive_bytes and one page long
                out: list[tuple] = []
                for data in members(content):
                    fields, block = parsed(data)
                    if "warc-segment-number" in fields:
                        total = fields.get("warc-segment-total-length")
                        page = {k: v for k, v in fields.items() if k.startswith(("warc-page", "warc-payload", "warc-type"))}
                        origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                        out.append((None, None, None, None, None, origin, int(fields["warc-segment-number"]), int(total) if total else None, "\n".join(f"{k}: {v}" for k, v in page.items()), block))
                    else:
                        out.append((*_page(fields, block), None, None, None, None, None))
                    if len(out) >= 512:
                        yield sent(out)
                        out = []
                if out:
                    yield sent(out)

    columns = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, origin string, number int, total long, fields string, block binary"
    # names are all that is shuffled; a number of partitions that is asked for is not put together again for their few bytes
    files = archives.select("path").repartition(max(1, -(-archives.count() // per_task)))
    parts = scratch.written(files.mapInArrow(split, columns), "records")

    def joined(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("number")
        block, total = b"".join(g["block"]), g["total"].iloc[-1]
        if g["number"].tolist() != list(range(1, len(g) + 1)) or pd.isna(total) or int(total) != len(block):
            raise ValueError(f"segments of {g['origin'].iloc[0]} are missing, repeated or of another length")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in g["fields"].iloc[0].split("\n"))
        row = dict(zip(("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"), _page(fields, block)))
        return pd.DataFrame([row]).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    whole = parts.where("origin IS NULL").select("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to")
    return whole.unionByName(parts.where("origin IS NOT NULL").select("origin", "number", "total", "fields", "block").groupBy("origin").applyInPandas(joined, _ROW))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives of all pages, reads them back, and resolves revisits by the payload of the response they refer to.

    One row per page: id, payload_bytes, payload_digest, record_type, refers_to. An empty table gives no rows; further columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    written = scratch.written(write_archives(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col), "manifest")
    if not written.limit(1).count():
        return spark.createDataFrame([], f"{id_col} long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    back = scratch.written(read_archives(written, scratch), "pages")
    keys = ["refers_to", "payload_digest"]
    asked = back.where("record_type = 'revisit'").groupBy(*keys).agg(F.count("*").alias("held"))
    found = back.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("own_bytes")).distinct()
    found = scratch.written(asked.join(found, keys), "found")
    revisits = looked_up(back.where("record_type = 'revisit'"), found, keys, found.count(), 160)
    out = back.where("record_type = 'response'").withColumn("own_bytes", F.lit(None).cast("long")).unionByName(revisits)
    return out.select(F.col("page_id").alias(id_col), F.coalesce("payload_bytes", "own_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = r"""
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""
