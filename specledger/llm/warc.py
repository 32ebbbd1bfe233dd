"""WARC archives with revisit records (operator 1).

Records are written by Spark's text writer: a record's value is its header, payload and closing blank lines but for the last line feed, which
the writer adds as the line separator, so a part file is a valid archive. Archives are read as binary files and parsed by
their Content-Length, so payloads may hold anything, also what looks like a header. Both ends work on any file system that Spark can reach, and no
task holds more than the part files of one input split (``FILE_RECORDS`` records each).

Revisit resolution: headers are shuffled by payload digest, the smallest id among equal payloads of at least ``least`` bytes is the response, and the others
get fresh revisit headers that refer to it and no payload. Only digests that occur twice are kept for the join, and a digest that a third of
all records have is pre-aggregated before it is shuffled.

Defined results: a null payload is empty; a null or repeated id is allowed (of equal payloads those with the smallest id are all responses; if
no id is known all are); an empty table gives an empty archive; line breaks in a URL are written as percent escapes.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from specledger.session import stage_dir

VERSION = "WARC/1.1"
FILE_RECORDS = 2000
END = b"\r\n\r\n"


def with_digest(records: DataFrame) -> DataFrame:
    """``payload_bytes`` and ``payload_digest`` (bare lower-case hex SHA-256) of the text column ``payload``."""
    payload = F.coalesce("payload", F.lit(""))
    return records.select("record_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
                          F.sha2(payload, 256).alias("payload_digest"))


def resolve(headers: DataFrame, least: int = 100) -> DataFrame:
    """Add ``refers_to``: the response that a revisit refers to, null for responses."""
    first = headers.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min("record_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    joined = headers.join(first, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("record_id").isNull() | (F.col("record_id") != F.col("_first")), F.col("_first"))).drop("_first")


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def record_text(date: str) -> Column:
    """The whole record, short of its last line feed."""
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    digest = F.concat(F.lit("sha256:"), F.col("payload_digest"))
    return F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:record:"), F.coalesce(F.col("record_id").cast("string"), F.lit("none")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", url), _line("WARC-Payload-Digest", digest),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:record:"), F.col("refers_to").cast("string"), F.lit(">")))),
        _line("X-Payload-Length", F.col("payload_bytes").cast("string")), F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body, F.lit("\r\n\r"))


def write_archives(resolved: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    resolved.select(record_text(date).alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and payload of each record, one after the other by their lengths."""
    at, view = 0, memoryview(data)
    while at < len(data):
        stop = data.index(END, at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        header = dict(line.split(": ", 1) for line in lines[1:])
        start = stop + len(END)
        length = int(header["Content-Length"])
        yield header, view[start:start + length]
        at = start + length + len(END)


def _number(urn: str | None) -> int | None:
    name = urn.removeprefix("<urn:record:").rstrip(">") if urn else "none"
    return None if name == "none" else int(name)


def _records(keep_payload: bool):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out = []
                for header, payload in parse_archive(gzip.decompress(content)):
                    out.append((_number(header["WARC-Record-ID"]), header.get("WARC-Target-URI"), header["WARC-Type"],
                                header["WARC-Payload-Digest"].removeprefix("sha256:"), int(header["X-Payload-Length"]),
                                _number(header.get("WARC-Refers-To")), len(payload), str(payload, "utf-8") if keep_payload else None))
                got = pd.DataFrame(out, columns=[f.split()[0] for f in RECORD.split(", ")])
                yield got.astype({"record_id": "Int64", "refers_to": "Int64"}).astype({"url": object, "payload": object})

    return rows


RECORD = ("record_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, stored_bytes long,"
          " payload string")


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``; a revisit has no payload of its own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(_records(keep_payload), RECORD)


def deduplicate_archives(spark: SparkSession, source: str, target: str, least: int = 100) -> None:
    """Write the archives under ``source`` anew, with revisits for payloads that occur again. Revisits in the source are expanded first."""
    records = read_archives(spark, source)
    full = records.filter("record_type = 'response'")
    bodies = full.select(F.col("record_id").alias("refers_to"), F.col("payload").alias("_body")).dropDuplicates(["refers_to"])
    revisits = records.filter("record_type = 'revisit'").join(bodies, "refers_to", "left").withColumn("payload", F.col("_body"))
    whole = full.select("record_id", "url", "payload").unionByName(revisits.select("record_id", "url", "payload"))
    write_archives(resolve(with_digest(whole), least), target)


def archive_pages(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write a record per row of ``record_id``, ``url``, ``payload`` and read the archives back (without the payloads)."""
    spark = pages.sparkSession
    path = f"{stage_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(resolve(with_digest(pages), least), path)
    return read_archives(spark, path, keep_payload=False)
