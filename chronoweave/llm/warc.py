"""WARC archives: writing captures with revisit records, and reading them back by transaction assembly.

Writing: each capture is a response record, or a revisit of the response with the same payload, and a request and a
metadata record that name it in WARC-Concurrent-To. Records go through Spark's text writer with the record separator
as line separator, so archives land in any store that Spark writes. Only responses carry a payload through a shuffle; the
rows of equal payloads are matched by length and SHA-1 on small rows, whose hot keys a skew join can split.

Reading: archives of at most FILE_RECORDS records are parsed by Content-Length as a stream, one task for each file; the
records of a transaction meet through the identifier that they are concurrent to and come out as one nested row a capture.

Defined cases: a null html is an empty payload. Every row is a capture of its own, also where page and payload repeat. Of
equal payloads of `revisit_from` bytes or more the smallest page is the response (null pages last), of rows that repeat
it one, and all others revisit that one. A null or broken url is written without its line breaks, or as urn:none. Extra
columns are not archived. An archive whose payload doesn't match its digest raises.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

DATE = "2024-01-01T00:00:00Z"
#: The Base32 alphabet of RFC 4648 and the revisit profile of the WARC 1.1 standard.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
FILE_RECORDS = 20_000
#: Bytes that a reader takes from an archive at a time.
READ_BYTES = 1 << 20


def base32_sha1(data: Column) -> Column:
    """Upper-case Base32 of the SHA-1 of a binary column: 20 bytes are 32 digits of 5 bits."""
    digits = []
    for five in range(4):
        bits = F.conv(F.substring(F.sha1(data), 1 + 10 * five, 10), 16, 10).cast("long")
        digits += [F.substring(F.lit(BASE32), F.shiftright(bits, 35 - 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*digits)


def _record_id(page: Column, digest: Column, nth: Column | None = None) -> Column:
    """The identifier of a page's capture of a payload; nth tells later rows that repeat both from the first."""
    again = [] if nth is None else [F.when(nth > 1, nth.cast("string"))]
    h = F.sha1(F.concat_ws("|", F.coalesce(F.concat(F.lit("p"), page.cast("string")), F.lit("n")), digest, *again).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its closing separator; headers that are null are left out."""
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write(pages: DataFrame, path: str, revisit_from: int = 0, page_col="page_id", url_col="url", html_col="html") -> None:
    """Write the archives of all pages to the folder path."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(page_col).alias("page"), F.col(url_col).alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    captures = rows.groupBy("page", "digest", "size").agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("n_rows"))
    firsts = captures.where(F.col("size") >= revisit_from).groupBy(F.col("digest").alias("_digest"), F.col("size").alias("_size")).agg(F.min("page").alias("first"))
    captures = captures.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("size") == F.col("_size")), "left").drop("_digest", "_size")
    url = F.coalesce(F.nullif(F.regexp_replace("url", r"[\r\n]+", ""), F.lit("")), F.lit("urn:none"))
    captures = captures.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    again = (F.col("size") >= revisit_from) & ~(F.col("page").eqNullSafe(F.col("first")) & (F.col("nth") == 1))
    ids = [_record_id(F.col("page"), F.col("digest"), F.col("nth")).alias("id"), _record_id(F.col("page"), F.col("digest")).alias("body_id"), _record_id(F.col("first"), F.col("digest")).alias("first_id")]
    captures = common.stage(captures.select("page", "digest", "size", url.alias("url"), again.alias("again"), *ids), "captures")

    date, no_text = F.lit(DATE), F.lit("")
    common_headers = [("WARC-Record-ID", F.col("id")), ("WARC-Target-URI", F.col("url")), ("WARC-Date", date), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    kind = [("Content-Type", F.lit("application/http; msgtype=response"))]
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    revisits = captures.where("again").select(_record(F.lit("revisit"), [*common_headers, ("WARC-Refers-To", F.col("first_id")), ("WARC-Profile", F.lit(PROFILE)), *kind], head).alias("value"))
    other_id = lambda what: _record_id(F.concat(F.lit(f"{what} "), F.col("id")), F.col("digest"))
    other = lambda what, type_: [("WARC-Record-ID", other_id(what)), ("WARC-Target-URI", F.col("url")), ("WARC-Date", date), ("WARC-Concurrent-To", F.col("id")), ("Content-Type", F.lit(type_))]
    place = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    ask = F.concat(F.lit("GET "), F.coalesce(F.nullif(place, no_text), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    requests = captures.select(_record(F.lit("request"), other("request", "application/http; msgtype=request"), ask).alias("value"))
    about = F.concat_ws("\r\n", F.concat(F.lit("page: "), F.col("page").cast("string")), F.concat(F.lit("payload-length: "), F.col("size").cast("string")))
    metadata = captures.select(_record(F.lit("metadata"), other("metadata", "application/warc-fields"), F.concat(about, F.lit("\r\n"))).alias("value"))

    bodies = rows.select(_record_id(F.col("page"), F.col("digest")).alias("body_id"), "html")  # one key, so that one shuffle serves both
    bodies = bodies.withColumn("_nth", F.row_number().over(Window.partitionBy("body_id").orderBy(F.lit(0)))).where("_nth = 1")
    full = captures.where("NOT again").join(bodies, "body_id")
    responses = full.select(_record(F.lit("response"), [*common_headers, *kind], F.concat(head, F.col("html"))).alias("value"))
    small = revisits.unionByName(requests).unionByName(metadata)
    for records, mode in ((responses, "errorifexists"), (small, "append")):
        records.write.mode(mode).option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_SCHEMA = pa.schema(
    [(c, pa.string()) for c in ("record_id", "type", "uri", "date", "concurrent_to", "refers_to", "payload_digest", "page")] + [("payload_bytes", pa.int64())] + [("payload", pa.binary())]
)
_DDL = "record_id string, type string, uri string, date string, concurrent_to string, refers_to string, payload_digest string, page string, payload_bytes long, payload binary"


def parse(stream):
    """(headers in lower case, block) of each record of an archive that is read as a binary stream."""
    end, held, at = END.encode(), b"", 0

    def more(stop):
        """Whether the archive goes on to byte stop of held."""
        nonlocal held
        parts, size = [held], len(held)
        while size < stop and (part := stream.read(max(READ_BYTES, stop - size))):
            parts.append(part)
            size += len(part)
        held = b"".join(parts)
        return size >= stop

    while more(1):
        while (stop := held.find(end)) < 0:
            if not more(len(held) + 1):
                raise ValueError(f"the record at byte {at} has no block")
        lines = held[:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        close = stop + 4 + int(headers["content-length"])
        if not more(close + 4) or held[close : close + 4] != end:
            raise ValueError(f"the record at byte {at} isn't closed")
        yield headers, held[stop + 4 : close]
        held, at = held[close + 4 :], at + close + 4


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives in the folder path."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                out, size = [], 0
                for headers, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    kind, payload, fields = headers["warc-type"], None, {}
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "response":
                        payload = block[block.index(END.encode()) + 4 :]
                        if (got := base64.b32encode(hashlib.sha1(payload).digest()).decode()) != digest:
                            raise ValueError(f"{headers['warc-record-id']}: payload {got}, header {digest}")
                    elif kind == "metadata":
                        fields = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if ": " in line)
                    n = len(payload) if kind == "response" else int(fields["payload-length"]) if "payload-length" in fields else None
                    out.append((headers["warc-record-id"], kind, headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), digest, fields.get("page"), n, payload if with_payload else None))
                    size += len(payload or b"") + 500
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, _DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture_id, response (or revisit), request and metadata as structs."""
    own = F.col("type").isin("response", "revisit")
    fields = {
        "response": (own, ("record_id", "type", "uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload")),
        "request": (F.col("type") == "request", ("record_id", "uri", "date")),
        "metadata": (F.col("type") == "metadata", ("record_id", "page", "payload_bytes")),
    }
    together = records.groupBy(F.when(own, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id"))
    return together.agg(*[F.first(F.when(is_kind, F.struct(*cols)), ignorenulls=True).alias(name) for name, (is_kind, cols) in fields.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read_table(spark, sf_dir, "pages")
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    got = assemble(read(spark, path, with_payload=False))
    got = got.select("capture_id", F.col("metadata.page").cast(pages.schema["page_id"].dataType).alias("page_id"), F.col("metadata.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("_to"))
    got = common.stage(got, "assembled")
    firsts = got.where("record_type = 'response'").select(F.col("capture_id").alias("_id"), F.col("page_id").alias("refers_to"))
    got = got.join(firsts, F.col("_to") == F.col("_id"), "left")
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', ((('0x' || substr(sha1(t), (i // 4 * 5 + 1)::BIGINT, 5))::INTEGER >> (15 - i % 4 * 5)::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN least_id END AS refers_to
FROM (SELECT page_id, t, row_number() OVER (PARTITION BY t ORDER BY page_id NULLS LAST) AS nth, min(page_id) OVER (PARTITION BY t) AS least_id
      FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))
"""
