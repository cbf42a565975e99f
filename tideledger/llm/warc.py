"""WARC archives: a native writer with revisit records, a streaming reader, and the assembly of transactions.

A capture is three records: the request, the response (or a revisit, when another capture holds the same payload) and
metadata. Request and metadata name their response in ``WARC-Concurrent-To``. ``assemble`` joins them through that
identifier and gives one nested row per capture.

Records end with two line breaks, so Spark's text writer with that separator writes valid archives and its text reader
streams them back from any file system; no file is opened by Python code.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BREAK = "\r\n\r\n"
#: Records per archive file at most, so a file stays a moderate piece of work.
RECORDS_PER_FILE = 60_000

RECORD_SCHEMA = """record_id string, record_type string, concurrent_to string, refers_to string, target_uri string,
    headers map<string,string>, http_status int, payload binary, payload_bytes bigint, payload_digest string"""


def base32_sha1(content: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: eight groups of 20 bits, four base-32 digits each."""
    digest = F.sha1(content)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines, an empty line and the block; a null field leaves its line out. The separator ends the record."""
    lines = [F.concat(F.lit(f"\r\n{name}: "), value) for name, value in fields]
    length = F.concat(F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.lit("WARC/1.1"), *[F.coalesce(line, F.lit("")) for line in lines], length, F.lit(BREAK), block)


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0,
) -> None:
    """Write three records per page below ``path`` as gzip archives.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response, the
    others revisit it; smaller payloads are all responses. Equal rows with the largest id are all responses. A null
    payload is empty; a null id counts as the smallest; a null URL leaves its line out; line breaks in a URL are
    escaped. Other columns are ignored. An empty table writes no record.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    base = pages.select(
        F.col(page_id).alias("page"),
        F.replace(F.replace(F.col(url).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("uri"),
        body.alias("body"),
        base32_sha1(body.cast("binary")).alias("digest"),
        F.monotonically_increasing_id().alias("row"),  # files and splits decide it, so a repeated task gives the same
    )
    # Partial sums collapse a popular payload to one row per task. Its pages then spread: AQE splits the large side.
    keepers = base.groupBy("digest").agg(F.max("page").alias("keeper"), F.max_by("row", F.coalesce("page", F.lit(-(2**63)))).alias("keeper_row"))
    joined = base.join(keepers, "digest")
    name = lambda page, row: F.concat(F.lit("<urn:capture:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"))
    own, size = name(F.col("page"), F.col("row")), F.octet_length("body")
    again = (size >= min_bytes) & ~F.col("page").eqNullSafe(F.col("keeper"))
    head_id = F.concat(own, F.lit(":response>"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(BREAK))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("uri"))]
    host = F.regexp_extract("uri", "^[a-z]+://([^/?#]*)", 1)
    target = F.regexp_extract("uri", "^[a-z]+://[^/?#]*([^#]*)", 1)
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", F.concat(own, F.lit(":request>"))), ("WARC-Concurrent-To", head_id),
         *common, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), F.coalesce(target, F.lit("")))),
                 F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(BREAK)),
    )
    head = _record(
        [("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", head_id), *common,
         ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
         ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
         ("WARC-Refers-To", F.when(again, F.concat(name(F.col("keeper"), F.col("keeper_row")), F.lit(":response>")))),
         ("X-Page-Id", F.col("page").cast("string")), ("X-Payload-Length", size.cast("string")),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.when(again, "").otherwise(F.col("body"))),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", F.concat(own, F.lit(":metadata>"))), ("WARC-Concurrent-To", head_id),
         *common, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("payloadLength: "), size.cast("string"), F.lit("\r\n")),
    )
    records = joined.select(F.explode(F.array(request, head, metadata)).alias("value"))
    records.write.option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_stream(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record. Holds one record at a time.

    ``pieces`` are the bytes between separators, in file order; joined again they are the file.
    """
    sep, held, need, headers = BREAK.encode(), bytearray(), None, {}
    for piece in pieces:
        held += piece
        held += sep
        while True:
            if need is None:
                start = len(held) - len(held.lstrip(b"\r\n"))
                end = held.find(sep, start)
                if end < 0:
                    break
                lines = bytes(held[start:end]).decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"Not a WARC record: {lines[0][:80]!r}")
                headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
                need = int(headers.get("content-length", 0))
                del held[: end + 4]
            if len(held) < need + 4:
                break
            yield headers, bytes(held[:need])
            del held[: need + 4]
            need = None
    if need is not None:
        raise ValueError("An archive ends inside a record")


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def files():
        """(file, its pieces) one after the other; the pieces come lazily."""
        feed = ((r.file, r.value) for b in batches for r in b.itertuples(index=False))
        held = next(feed, None)
        while held is not None:
            name = held[0]

            def pieces():
                nonlocal held
                while held is not None and held[0] == name:
                    yield held[1]
                    held = next(feed, None)

            yield pieces()

    out, size = [], 0
    for pieces in files():
        for headers, block in parse_stream(pieces):
            status, payload = None, block
            if headers.get("content-type", "").startswith("application/http"):
                http, _, payload = block.partition(b"\r\n\r\n")
                first = http.split(b"\r\n", 1)[0].split(b" ")
                status = int(first[1]) if first[0].startswith(b"HTTP/") and len(first) > 1 and first[1].isdigit() else None
            kind = headers.get("warc-type")
            digest, length = headers.get("warc-payload-digest", "").removeprefix("sha1:"), len(payload)
            if kind == "revisit":
                length = int(headers["x-payload-length"]) if headers.get("x-payload-length", "").isdigit() else None
            elif kind == "response":
                actual = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if digest and digest != actual:
                    raise ValueError(f"Payload of {headers.get('warc-record-id')} does not match its digest")
                digest = actual
            out.append((headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
                        headers.get("warc-target-uri"), headers, status, payload, length, digest or None))
            size += len(payload)
            if len(out) >= 5000 or size > 8_000_000:
                yield _frame(out)
                out, size = [], 0
    if out:
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "headers", "http_status", "payload", "payload_bytes", "payload_digest"]
    return pd.DataFrame(rows, columns=names).astype({"http_status": "Int32", "payload_bytes": "Int64"})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzip archives below ``path``, block parsed as its content type says.

    Gzip files aren't split, so a task streams whole files. A response whose payload doesn't match its digest, or an
    archive that ends inside a record, is an error, not a lost row. The length of a revisited payload is known only if
    the archive states it.
    """
    pieces = spark.read.option("lineSep", BREAK).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInPandas(_rows, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, head, requests, metadata``.

    ``head`` is the response or revisit; it is null where an archive holds only a request or metadata. Requests and
    metadata are joined through their concurrent-to identifier and sorted by record id; a capture without them has
    empty lists. The key of every join is a record id, which one capture's few records share.
    """
    parts = F.struct(*[c for c in records.columns])
    heads = records.filter(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), parts.alias("head"))

    def side(kind: str, name: str) -> DataFrame:
        own = records.filter(F.col("record_type") == kind)
        # A map has no order; what is sorted is the id and its text.
        slim = F.struct("record_id", "target_uri", F.col("payload").cast("string").alias("content"))
        return own.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(F.array_sort(F.collect_list(slim)).alias(name))

    whole = heads.join(side("request", "requests"), "capture_id", "full_outer").join(side("metadata", "metadata"), "capture_id", "full_outer")
    empty = F.array().cast("array<struct<record_id:string,target_uri:string,content:string>>")
    return whole.select("capture_id", "head", F.coalesce("requests", empty).alias("requests"), F.coalesce("metadata", empty).alias("metadata"))
