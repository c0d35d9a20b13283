r"""WARC archives with revisit records.

Headers alone (id, digest, length) are shuffled by payload digest; of equal payloads that with the largest id stays a
response, the others become revisit records that refer to it. Archives are then written with fresh headers, one record
for each row, through Spark's text writer: a record ends in two line breaks, which are the writer's line separator, so
that files need no writer of their own and go to any store (a file is one gzip member: that writer can't end one at each record).
The reader gets the files' bytes through Spark's text reader, piece by piece, takes records apart by their Content-Length and
joins revisits to the responses they refer to; it holds one record at a time, however large a file.

Cases: a null payload is empty, a null url is written as none; line breaks in urls are percent-encoded; a null id is less
than all others; rows that repeat the largest id are responses all; payloads of any bytes survive; an empty table gives
an empty archive. Columns other than id, url and payload are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import join_salted, new_path, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records that a file has at most, and what ends a record.
FILE_RECORDS, END = 10_000, b"\r\n\r\n"
RECORDS = "record_id string, record_type string, uri string, date string, page_id string, digest string, refers_to_id string, payload_bytes long, payload_sha1 string, payload binary"


def record_id(page_id: Column, digest: Column) -> Column:
    """A UUID made from the id and the digest: the same record gets the same one in every run."""
    return F.regexp_replace(F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("-")), digest)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def header(name: str, value: Column) -> Column:
    """The header line, or nothing for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """page_id, uri, payload (binary), digest, payload_bytes, record_type and refers_to, refers_to_uri (null for responses)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    uri = F.replace(F.replace(F.col(url_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(id_col).alias("page_id"), uri.alias("uri"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    heads = rows.select("page_id", "uri", "digest", "payload_bytes", F.xxhash64("payload").alias("also")).where(F.col("payload_bytes") >= min_bytes)
    same = ["digest", "payload_bytes", "also"]
    originals = stored(heads.groupBy(*same).agg(F.max(F.struct("page_id", "uri")).alias("original"), F.count("*").alias("__n")).where("__n > 1"), "originals")
    revisits = (
        join_salted(heads, originals, same, ["page_id"])
        .where(~F.col("page_id").eqNullSafe(F.col("original.page_id")))
        .select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "original")
        .distinct()
    )
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    kind = F.when(F.col("original").isNull(), "response").otherwise("revisit")
    return joined.withColumns({"record_type": kind, "refers_to": F.col("original.page_id"), "refers_to_uri": F.col("original.uri")}).drop("__id", "__digest", "original")


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """records as with_revisits returns them, in gzipped WARC 1.1 files."""
    line, revisit = "\r\n", F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(line * 2))
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    named = lambda rid: F.concat(F.lit("<urn:uuid:"), rid, F.lit(">"))
    text = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.col("record_type"), F.lit(line),
        header("WARC-Record-ID", named(record_id(F.col("page_id"), F.col("digest")))),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", F.col("uri")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        header("WARC-Refers-To", F.when(revisit, named(record_id(F.col("refers_to"), F.col("digest"))))),
        header("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
        header("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        header("Page-ID", F.col("page_id").cast("string")),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit(line), http,
    )
    whole = F.concat(text.cast("binary"), body).cast("string")  # the bytes stay as they are
    records.select(whole.alias("value")).write.option("lineSep", line * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def record(head: bytes, block: bytes) -> tuple:
    """A record as RECORDS has it."""
    heads = {k.lower(): v for k, v in (x.split(": ", 1) for x in head.decode().split("\r\n")[1:])}
    payload = block[block.index(END) + 4 :]
    full = heads["warc-type"] == "response"
    bare = lambda name: (heads.get(name) or "")[len("<urn:uuid:") : -1] or None
    return (
        bare("warc-record-id"), heads["warc-type"], heads.get("warc-target-uri"), heads["warc-date"], heads.get("page-id"), re.sub("^sha1:", "", heads["warc-payload-digest"]),
        bare("warc-refers-to"), len(payload) if full else None, hashlib.sha1(payload).hexdigest() if full else None, payload if full else None,
    )


def parse(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple]:
    """The records of archive files, given as (file, bytes) with the END after each piece left out; a file that ends within a record fails."""
    held, name, head, size = bytearray(), None, None, 0
    for file, piece in pieces:
        if file != name and held:
            raise ValueError(f"{name} ends within a record")
        name = file
        held += piece
        held += END
        while True:
            if head is None:
                at = held.find(END)
                if at < 0:
                    break
                head = bytes(held[:at])
                size = int(re.search(rb"(?mi)^content-length: (\d+)\r?$", head)[1])
                del held[: at + 4]
            if len(held) < size + 4:
                break
            yield record(head, bytes(held[:size]))
            del held[: size + 4]
            head = None
    if held or head is not None:
        raise ValueError(f"{name} ends within a record")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One RECORDS row for each record; the payload's length, SHA-1 and bytes are taken from the block, and null for revisits."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f.as_py(), x.as_py()) for batch in batches for f, x in zip(batch.column(0), batch.column(1), strict=True))
        rows, held = [], 0
        for row in parse(pieces):
            rows.append(row if with_payload else (*row[:-1], None))
            held += len(rows[-1][-1] or b"")
            if len(rows) == 500 or held > 16_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # Files are compressed, hence not split, and read in order.
    pieces = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "part-*").text(path)
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """records with every revisit given its response's payload_bytes, payload_sha1 and payload, and refers_to: the response's page_id.

    Only revisits are joined, and dealt to parts: many may refer to one response.
    """
    full, revisits = records.where("record_type = 'response'"), records.where("record_type <> 'response'")
    referred = revisits.groupBy(F.col("refers_to_id").alias("record_id")).agg(F.count("*").alias("__n"))
    values = ("payload_bytes", "payload_sha1", "payload")
    originals = (
        full.join(referred, "record_id")
        .select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), *(F.col(c).alias(f"__{c}") for c in values), "__n")
        .dropDuplicates(["refers_to_id"])
    )
    found = join_salted(revisits, stored(originals, "referred"), ["refers_to_id"], ["record_id"], "left")
    found = found.withColumns({c: F.coalesce(c, f"__{c}") for c in values}).drop(*(f"__{c}" for c in values))
    return full.withColumn("refers_to", F.lit(None).cast("string")).unionByName(found)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, as read back from its archives."""
    path = new_path(pages.sparkSession, "archives")
    write_archives(with_revisits(pages), path)
    out = resolved(stored(read_archives(pages.sparkSession, path, with_payload=False), "records"))
    return out.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"), "uri")
