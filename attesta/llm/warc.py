"""WARC archives: write records, resolve revisits, read archives back.

Headers (id, URL, digest, length) are shuffled by payload digest: the smallest
id of a digest keeps its payload and the others become revisit records that
refer to it. Which rows those are goes back to the payloads as a broadcast
table while it is small, so that payloads are not shuffled; a larger one is
joined by a shuffle. Archives are written by Spark's own writer, so they go to
any store that Spark knows; a record ends with two CRLFs, which is the writer's
line separator. Reading parses by Content-Length, a record at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import discard, materialize, salted_join

CRLF = "\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below so many bytes are always written in full.
LEAST_BYTES = 100
#: Payload bytes of an archive file, by the mean of all, and its records at most.
FILE_BYTES, FILE_RECORDS = 32 << 20, 2_000
#: Revisits up to which their table is broadcast: an id, a digest and an original take some 150 bytes each.
BROADCAST_ROWS = 400_000
#: Bytes inflated at once and records of a batch that is handed on.
CHUNK, BATCH = 1 << 20, 200


def _record_id(id_: Column, digest: Column) -> Column:
    """A urn:uuid that depends on the id, which may be null, and the payload's digest only."""
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def resolve_revisits(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Add `original` and `original_url` to (id, url, digest, bytes) rows: those of the response that a revisit refers to, else null.

    Of records with one digest and least_bytes or more, the smallest id is the
    response. Smaller payloads are never revisits. Rows that repeat the
    smallest id are all responses, and so are rows with a null id. Digests are
    pre-aggregated before the shuffle and a hot digest's rows are dealt to
    several tasks.
    """
    large = headers.where(F.col("bytes") >= least_bytes)
    first = large.groupBy("digest").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    joined = salted_join(headers, first, ["digest"], F.col("id"), how="left")
    again = (F.col("bytes") >= least_bytes) & (F.col("first.id") < F.col("id"))
    return joined.withColumn("original", F.when(again, F.col("first.id"))).withColumn("original_url", F.when(again, F.col("first.url"))).drop("first")


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = LEAST_BYTES, date: str | None = None, broadcast_rows: int = BROADCAST_ROWS,
) -> None:
    """Write deduplicated archives, one record per row, as gzip files under path.

    A response's block is an HTTP response whose body is the payload; a revisit
    has its headers only. `date` is that of the records (now, if not given). A
    null payload is written as an empty one and a null URL as an empty URI. A
    row with a null id is a response of its own, with an empty X-Page-Id. Line
    breaks in a URL are percent-encoded. Repeated rows give repeated records.
    An empty table gives archives without records; other columns are ignored.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "utf-8")
    url = F.replace(F.replace(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), url.alias("url"), payload.alias("payload"))
    digest = F.sha2("payload", 256).alias("digest")
    headers, kept = materialize(rows.select("id", "url", digest, F.octet_length("payload").cast("long").alias("bytes")), "warc-headers")
    again = resolve_revisits(headers, least_bytes).where(F.col("original").isNotNull()).select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "original", "original_url").distinct()
    revisits, decided = materialize(again, "warc-revisits")
    some = F.broadcast(revisits) if revisits.count() <= broadcast_rows else revisits
    mean = headers.agg(F.avg("bytes")).first()[0] or 1
    # an id may repeat with another payload: the digest is part of the key
    known = rows.select("*", digest).join(some, (F.col("id") == F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
    revisit = F.col("original").isNotNull()
    size = F.octet_length("payload").cast("string")

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF))

    block = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF), line("Content-Type", "text/html; charset=utf-8"), line("Content-Length", size), F.lit(CRLF), F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    head = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"))), line("WARC-Date", date), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("X-Page-Id", F.coalesce(F.col("id").cast("string"), F.lit(""))),
        F.when(revisit, F.concat(
            line("WARC-Profile", PROFILE), line("WARC-Refers-To", _record_id(F.col("original"), F.col("digest"))), line("WARC-Refers-To-Target-URI", F.col("original_url")),
            line("WARC-Refers-To-Date", date), line("X-Refers-To-Page-Id", F.col("original").cast("string")),
        )).otherwise(F.lit("")),
        line("Content-Type", "application/http; msgtype=response"), line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF), F.col("block"),
    )
    most = max(1, min(FILE_RECORDS, int(FILE_BYTES // max(mean, 1))))
    known.withColumn("block", block).select(head.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    discard(pages.sparkSession, kept, decided)


def _inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive, gzip members or plain, a chunk at a time."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[i : i + CHUNK] for i in range(0, len(content), CHUNK))
        return
    one = zlib.decompressobj(31)
    while content:
        yield one.decompress(content, CHUNK)
        content = one.unconsumed_tail or one.unused_data
        if one.eof:
            one = zlib.decompressobj(31)


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive; holds one record and a chunk."""
    held, more = bytearray(), _inflated(content)

    def fill(need: int) -> bool:
        while len(held) < need:
            part = next(more, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while (at := held.find(b"WARC/")) < 0:
            if not fill(len(held) + 1):
                return
        del held[:at]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                return
        lines = held[:end].decode("utf-8").split(CRLF)[1:]
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(headers["content-length"])
        fill(stop)
        yield headers, bytes(held[end + 4 : stop])
        del held[:stop]


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records under path: page_id, record_id, record_type, url, digest, refers_to_record, refers_to_page, payload_bytes, payload_digest, payload.

    payload_bytes and payload_digest are those of the body that stands in the
    record; without `payloads` the body itself is left out. An archive file is
    read by one task, a record at a time.
    """
    schema = (
        "page_id long, record_id string, record_type string, url string, digest string, refers_to_record string, refers_to_page long, "
        "payload_bytes long, payload_digest string, payload binary"
    )
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*((x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")))

    def number(x: str | None) -> int | None:
        return int(x) if x else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(names))

        for b in batches:
            for k in range(b.num_rows):
                rows: list[tuple] = []
                for h, block in records_of(b.column(0)[k].as_py()):
                    body = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
                    rows.append((
                        number(h.get("x-page-id")), h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), digest, h.get("warc-refers-to"), number(h.get("x-refers-to-page-id")),
                        len(body), hashlib.sha256(body).hexdigest(), body if payloads else None,
                    ))
                    if len(rows) == BATCH:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, schema)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): each record with its full payload's size and digest.

    Revisit records are joined to the original responses that they refer to;
    the digest of a response is taken from its payload, not from its header. A
    revisit whose response is not there has neither size nor digest. records
    are read several times: write them first. Repeated records give repeated
    rows; no records give none.
    """
    size = ["payload_bytes", "payload_digest"]
    full = records.where(F.col("record_type") == "response").select("page_id", "record_id", *size)
    again = records.where(F.col("record_type") == "revisit").select("page_id", F.col("refers_to_record").alias("record_id"), F.col("digest").alias("payload_digest"), F.col("refers_to_page").alias("refers_to"))
    found = salted_join(again, full.select("record_id", *size).distinct(), ["record_id", "payload_digest"], F.col("page_id"), how="left")
    return full.select("page_id", *size, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        found.select("page_id", *size, F.lit("revisit").alias("record_type"), "refers_to")
    )
