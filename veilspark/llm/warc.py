"""Write pages as deduplicated WARC archives, and read archives back.

Only headers (id, url, digest, length) are shuffled by payload digest.  Of equal
payloads one record keeps the payload, the others become revisit records that
name it.  Archives are gzip-compressed WARC 1.1 files written by Spark itself:
one text row is one record, and the blank lines that end a record are the row
separator.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def resolve_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to``.

    A null ``html`` is an empty payload.  Of records with equal payloads of at
    least *least_bytes* bytes the one with the largest ``page_id`` is the
    response; rows that repeat that id are responses too.  If all ids of a group
    are null, all its records are responses; a null id beside others revisits.
    Other columns are dropped; an empty table gives no rows.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    body = payload.cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
        F.sha1(body).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    # a payload that can't be shared never meets the others: its own id spreads it
    shared = F.col("payload_bytes") >= least_bytes
    originals = (
        rows.where(shared).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("payload_digest", "payload_bytes", "original")
    )
    revisits = (
        rows.where(shared).select("page_id", "payload_digest", "payload_bytes")
        .join(originals, ["payload_digest", "payload_bytes"])
        .where(F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")))
        .groupBy("page_id", "payload_digest", "payload_bytes").agg(F.max("original").alias("refers_to"))
        .withColumnsRenamed({"page_id": "_id", "payload_digest": "_digest", "payload_bytes": "_bytes"})
    )
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")) & (
        F.col("payload_bytes") == F.col("_bytes"))
    joined = rows.join(revisits, same, "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return joined.select(*rows.columns, kind.alias("record_type"), "refers_to")


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(name + ": "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def records(resolved: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One WARC record as text in each row, without the blank lines that end it."""
    revisit = F.col("record_type") == "revisit"
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", "text/html; charset=utf-8"),
        _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"),
    )
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", date), _line("WARC-Target-URI", url),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(
            _line("WARC-Profile", PROFILE), _line("WARC-Refers-To", _urn(F.col("refers_to"))),
        )).otherwise(""),
        _line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"),
    )
    return resolved.select(F.concat(head, body).alias("value"))


def write_archives(resolved: DataFrame, path: str, *, records_per_file: int = 2000) -> None:
    """Write *resolved* as ``.gz`` archives under *path*, in the tasks that hold the rows."""
    (records(resolved).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def _headers(stream: io.BufferedReader) -> dict[str, str]:
    out = {}
    while line := stream.readline().strip(b"\r\n"):
        name, _, value = line.partition(b":")
        out[name.decode().lower()] = value.strip().decode()
    return out


def _page(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def parse_archive(stream) -> Iterator[dict]:
    """Records of one archive; digest and length of a response come from its payload."""
    reader = io.BufferedReader(stream)
    while first := reader.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = _headers(reader)
        block = io.BytesIO(reader.read(int(head["content-length"])))
        block.readline()
        http = _headers(block)
        payload = block.read()
        response = head["warc-type"] == "response"
        yield {
            "page_id": _page(head["warc-record-id"]), "url": head["warc-target-uri"],
            "record_type": head["warc-type"],
            "payload_digest": hashlib.sha1(payload).hexdigest() if response
            else head["warc-payload-digest"].removeprefix("sha1:"),
            "payload_bytes": len(payload) if response else int(http["content-length"]),
            "refers_to": _page(head.get("warc-refers-to")),
        }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under *path*; payloads themselves are not kept."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                found, stream = [], gzip.GzipFile(fileobj=io.BytesIO(memoryview(content.as_buffer())))
                for record in parse_archive(stream):
                    found.append(record)
                    if len(found) == 5000:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found = []
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, RECORD)
