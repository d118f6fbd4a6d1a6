"""WARC archives: writing with revisits, segments and chunked framing; reading back by reassembly.

Pages become records: `response`, or `revisit` when the payload equals that of a page with a smaller id. A response's HTTP block uses
chunked transfer framing; a block longer than the segment size goes on in `continuation` records that name the origin record and their
segment number, the last with the total length. Records are rows of text whose line separator is the two empty lines that end a WARC
record, so that Spark's own writer makes the files, wherever the shared folder lies.

Reading parses whole files by Content-Length, gathers the segments of an origin wherever they are, orders them by number, checks that
they are complete and of the stated length, removes the chunk framing and digests the payload.

A row of text is a record of at most SEGMENT bytes and its head, and a file has `per_file` of them, so files are bounded in bytes (some 130 MB
before compression) whatever the size of pages. A revisit takes its length from the response whose payload has its digest.

Defined cases: a null page is empty; payloads under the least size are never revisits; ids may be null (smallest id ignores them); rows that
repeat keep a record each, those of the smallest id all as responses; an empty table gives empty archives and results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusgrid.llm import common as C

SEGMENT, CHUNK = 1 << 16, 1 << 13
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of about `size` bytes that end between UTF-8 characters."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def head(kind: str, ident: str, length: int, **more) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{ident}>", f"WARC-Date: {DATE}", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items() if v is not None), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + END).encode()


def records(ident: str, page, url: str, payload: bytes, digest: str, refers) -> list[bytes]:
    """The records of one page, without the two empty lines at their ends."""
    target = quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._")
    about = {"WARC_Target_URI": target, "WARC_Payload_Digest": f"sha256:{digest}", "X_Page": "" if page is None else page}
    if refers is not None:
        return [head("revisit", ident, 0, **about, WARC_Profile="http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", WARC_Refers_To=f"<urn:page:{refers}>")]
    body = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in cut(payload, CHUNK)) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + body
    parts = cut(block, SEGMENT)
    if len(parts) == 1:
        return [head("response", ident, len(block), **about, Content_Type="application/http; msgtype=response") + block]
    out = [head("response", ident, len(parts[0]), **about, Content_Type="application/http; msgtype=response", WARC_Segment_Number=1) + parts[0]]
    for i, p in enumerate(parts[1:], 2):
        total = len(block) if i == len(parts) else None
        out.append(head("continuation", f"{ident}-{i}", len(p), WARC_Segment_Origin_ID=f"<urn:record:{ident}>", WARC_Segment_Number=i, WARC_Segment_Total_Length=total) + p)
    return out


def write(pages: DataFrame, path: str, least: int = 100, per_file: int = 2000) -> None:
    """Archives of the pages (page_id, url, html) as gzip files in a folder."""
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    small = F.octet_length("html") < least
    first = p.where(~small).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").select("digest", "first")
    # only digests that repeat come back to the pages: a small table that Spark may broadcast after measuring it
    rows = p.join(first, "digest", "left").withColumn("refers", F.when(~small & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    rows = rows.select("page_id", "url", "html", "digest", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                for page, url, payload, digest, refers in zip(*[b.column(c).slice(at, 256).to_pylist() for c in range(5)], strict=True):
                    out += records(f"{me}-{k}", page, url, payload, digest, refers)
                    k += 1
                yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "surrogatepass") for x in out], pa.string())], names=["value"])

    out = rows.mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    out.option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should start")
        h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n = int(h["Content-Length"])
        yield h, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def dechunk(body: bytes) -> bytes:
    """The payload of chunked transfer framing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk has another length than stated")
        at = end + 4 + n


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    top, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if b"transfer-encoding: chunked" in top.lower() else body


COLUMNS = "kind string, ident string, page_id long, refers_to long, digest string, number int, total long, payload_bytes long, payload_digest string, block binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: page_id, record_type, refers_to, payload_bytes, payload_digest, as the archives have them."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for content in b.column(0):
            raw, rows = zlib.decompress(content.as_buffer(), 31), []
            for h, block in parse(raw):
                kind, number = h["WARC-Type"], h.get("WARC-Segment-Number")
                ident = h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])[12:-1]
                page = int(h["X-Page"]) if h.get("X-Page") else None
                refers = int(h["WARC-Refers-To"][10:-1]) if "WARC-Refers-To" in h else None
                size = digest = None
                if kind == "response" and number is None:
                    body = payload_of(block)
                    size, digest, block = len(body), hashlib.sha256(body).hexdigest(), None
                total = int(h["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in h else None
                rows.append((kind, ident, page, refers, h.get("WARC-Payload-Digest", "")[7:], int(number or 0), total, size, digest, block))
                if len(rows) == 512:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in COLUMNS.split(", ")])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from run(b)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    recs = C.stage(files.mapInArrow(flat, COLUMNS), "warc-records")

    # segmented blocks meet by origin; the pieces of one page at a time
    parts = recs.where("number > 0").groupBy("ident").agg(F.max("page_id").alias("page_id"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"))

    def join(b: pa.RecordBatch) -> pa.RecordBatch:
        size, digest = [], []
        for total, items in zip(b.column("total").to_pylist(), b.column("parts").to_pylist(), strict=True):
            block = b"".join(x["block"] for x in items)
            if [x["number"] for x in items] != list(range(1, len(items) + 1)) or len(block) != total:
                raise ValueError("segments are missing, or their total length is another")
            body = payload_of(block)
            size.append(len(body))
            digest.append(hashlib.sha256(body).hexdigest())
        return pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(size, pa.int64()), pa.array(digest, pa.string())], names=["page_id", "payload_bytes", "payload_digest"])

    whole = parts.select("page_id", "total", "parts").mapInArrow(C.by_batch(join), "page_id long, payload_bytes long, payload_digest string")
    null = F.lit(None).cast("long")
    plain = recs.where("kind = 'response' AND number = 0").select("page_id", "payload_bytes", "payload_digest")
    responses = plain.unionByName(whole).select("page_id", F.lit("response").alias("record_type"), null.alias("refers_to"), "payload_bytes", "payload_digest")
    # a revisit's length is its digest's: the archives hold one response of that digest and size
    sizes = responses.select("payload_digest", "payload_bytes").join(recs.where("kind = 'revisit'").select(F.col("digest").alias("payload_digest")).distinct(), "payload_digest", "left_semi").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = recs.where("kind = 'revisit'").select("page_id", F.col("digest").alias("payload_digest"), "refers_to").join(sizes, "payload_digest", "left")
    return responses.unionByName(again.select("page_id", F.lit("revisit").alias("record_type"), "refers_to", "payload_bytes", "payload_digest"))


def op6(spark, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex[:12]}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
