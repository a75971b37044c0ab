"""WARC archives with revisits instead of repeated payloads.

Records are WARC/1.1, one after the other in gzip files that Spark's text writer
makes: a record ends with CRLF CRLF, which is the writer's line separator. A file
holds as many records as fit ``FILE_BYTES`` at the greatest size of their class, so
that files stay small whatever the pages' sizes; a greater record is alone in its
file. Reading goes by Content-Length, so payloads may hold anything, and takes a file
record by record.

Defined results: NULL html is an empty payload; NULL page_id and url are kept (a
record without them); payloads below ``least`` bytes are always stored; rows that
repeat the page_id of a payload's response are responses too; an empty table gives
an empty archive; columns beyond those named are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tsengine.llm.common import join_checked, settle

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = "\r\n"
HTTP = END.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "", ""])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of a file of several records, and up to which a record is of a class (the last class has no end).
FILE_BYTES = 64 << 20
CLASSES = (64 << 10, 4 << 20)
SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def headers(pages: DataFrame) -> DataFrame:
    """Payload, its size and digest."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))}
    )


def resolve_revisits(records: DataFrame, least: int = 1_000) -> DataFrame:
    """Adds ``record_type`` and ``refers_to``.

    Only headers are shuffled, by digest. The payload classes with a repeat come back
    to the records by a join of checked size, salted beyond it.
    """
    long = records.where(F.col("payload_bytes") >= least).select("payload_digest", "payload_bytes", "page_id")
    classes = long.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n"))
    repeated = settle(classes.where("_n > 1").drop("_n"), "warc-classes")
    joined = join_checked(records, repeated, ["payload_digest", "payload_bytes"])
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("refers_to"))
    )


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _record_id(page: Column, digest: Column) -> Column:
    digits = F.md5(F.concat_ws(":", page.cast("string"), digest))
    parts = [F.substring(digits, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(records: DataFrame, path: str, date: str | None = None) -> None:
    """Write records with fresh headers; a revisit has no block and names its response."""
    when = F.lit(date) if date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stored = F.col("record_type") == "response"
    url = F.regexp_replace("url", r"[\x00-\x20]+", "")
    block = F.when(stored, F.concat(F.lit(HTTP), F.col("payload"))).otherwise(F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Date", when),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(~stored, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(~stored, _record_id(F.col("refers_to"), F.col("payload_digest")))),
        _line("X-Page-Id", F.col("page_id").cast("string")),
        _line("X-Refers-To-Page-Id", F.when(~stored, F.col("refers_to").cast("string"))),
        _line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        _line("Content-Type", F.when(stored, F.lit("application/http;msgtype=response"))),
        _line("Content-Length", F.octet_length("_block").cast("string")),
        F.lit(END),
    )
    largest = records.agg(F.max("payload_bytes")).first()[0] or 0
    for low, high in zip((-1, *CLASSES), (*CLASSES, None)):
        if low >= largest:
            break
        of_class = (F.col("payload_bytes") > low) & (F.lit(high is None) | (F.col("payload_bytes") <= (high or 0)))
        values = records.where(of_class).withColumn("_block", block).select(F.concat(head, F.col("_block")).alias("value"))
        writer = values.write.mode("errorifexists" if low < 0 else "append").option("lineSep", END * 2).option("compression", "gzip")
        writer.option("maxRecordsPerFile", FILE_BYTES // high if high else 1).text(path)


def parse_records(data: bytes | io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, of bytes or of a stream."""
    stream, gap = io.BytesIO(data) if isinstance(data, bytes) else data, (END * 2).encode()
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {stream.tell() - len(line)}")
        fields = {}
        while (line := stream.readline().decode()) != END:
            if not line.endswith(END):
                raise ValueError("a record's header doesn't end")
            name, value = line.removesuffix(END).split(": ", 1)
            fields[name] = value
        size = int(fields["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(len(gap)) != gap:
            raise ValueError(f"record before {stream.tell()} doesn't end after its length")
        yield fields, block


def _read_file(data: bytes, with_payload: bool) -> Iterator[tuple]:
    for fields, block in parse_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)))):
        page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
        size, digest, payload = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
        if fields["WARC-Type"] == "response":
            payload = block.split((END * 2).encode(), 1)[1]
            if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                raise ValueError(f"payload of page {page} differs from its header")
        kept = payload if with_payload else None
        yield page and int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"], refers and int(refers), size, digest, kept


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives below ``path``; payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = [field.split()[0] for field in SCHEMA.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                frame = pd.DataFrame(_read_file(bytes(data), with_payload), columns=names, dtype=object)
                if len(frame):
                    yield frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return files.mapInPandas(read, SCHEMA)
