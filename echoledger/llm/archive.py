"""Content-addressed WARC archive: each payload once, exact record headers apart, records by join.

An archive is two tables in one folder: `payloads` (digest, payload), keyed by the SHA-256 of the
bytes, and `records` (page_id, digest, exact header block, trailing bytes). A record is its header
block, then its payload unless it is a revisit. Reading joins both, recomputes every digest, and
fails where the bytes are not those that their key names.

Defined cases: a null html is an empty payload; payloads under `least_bytes` are never revisits;
rows of one page_id and equal payloads are all records of the same kind; a null page_id orders
last and has no number to be referred to; a null url is empty, line breaks in it are escaped.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echoledger.llm.shared import Tables, documents_of

_LAST = (1 << 63) - 1
_END = "\r\n"
#: Fixed value: the profile of revisits whose payload digest is identical.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _urn(number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.when(number == _LAST, F.lit("none")).otherwise(number.cast("string")), F.lit(">"))


def write(pages: DataFrame, folder: str, least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one record for each page; of equal payloads the smallest page_id is the response."""
    spark = pages.sparkSession
    rows = documents_of(pages, "page_id", "url", "html").select(
        F.coalesce("page_id", F.lit(_LAST)).alias("number"), F.coalesce("url", F.lit("")).alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = keyed.select("number", "url", "digest", F.octet_length("payload").cast("bigint").alias("size"))
    first = narrow.groupBy("digest").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = Tables(spark, "archive-first").keep(first, "first")

    # Keyed by number and digest, not by digest alone: copies of one payload spread over all tasks.
    winners = firsts.select(F.col("first").alias("number"), "digest")
    payloads = keyed.select("number", "digest", "payload").join(winners, ["number", "digest"], "left_semi")
    payloads.dropDuplicates(["number", "digest"]).select("digest", "payload").write.parquet(f"{folder}/payloads")

    named = narrow.join(firsts.where("copies > 1"), "digest", "left")
    again = F.coalesce((F.col("size") >= least_bytes) & (F.col("number") > F.col("first")), F.lit(False))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(_END))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{_END}"), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("number"))), line("WARC-Target-URI", url), line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("first"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.when(again, 0).otherwise(F.col("size")) + len(HTTP)).cast("string")), F.lit(_END), F.lit(HTTP))
    named.select("digest", F.encode(header, "utf-8").alias("header")).write.parquet(f"{folder}/records")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The original record bytes: header, and the payload where the record is not a revisit."""
    heads = spark.read.schema("digest string, header binary").parquet(f"{folder}/records")
    stored = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    revisit = F.decode("header", "utf-8").startswith(f"WARC/1.1{_END}WARC-Type: revisit{_END}")
    # The payload of a response is joined by digest; small payloads of a hot digest are few bytes, larger ones come once.
    whole = heads.where(~revisit).join(stored, "digest").select(F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record"))
    return whole.unionByName(heads.where(revisit).select(F.concat("header", F.lit(b"\r\n\r\n")).alias("record")))


def parsed(found: DataFrame) -> DataFrame:
    """Fields of record bytes: page_id, url, record_type, digest, refers_to, and the payload that stands in the record."""
    text = F.col("text")
    number = lambda key: F.regexp_extract(text, f"{key}: <urn:page:(-?[0-9]+)>", 1)
    # Latin-1 keeps one character for each byte, so that places in the text are places in the record.
    split = found.withColumn("text", F.decode("record", "iso-8859-1")).withColumn("head", F.locate("\r\n\r\n", text))
    body = F.col("head") + 4 + len(HTTP)
    head = split.select(
        F.decode(F.substring("record", F.lit(1), F.col("head")), "utf-8").alias("text"),
        F.substring("record", body, F.octet_length("record") - body - 3).alias("payload"))
    return head.select(
        F.nullif(number("WARC-Record-ID"), F.lit("")).cast("bigint").alias("page_id"),
        F.regexp_extract(text, "WARC-Target-URI: ([^\r\n]*)", 1).alias("url"),
        F.regexp_extract(text, "WARC-Type: ([a-z]+)", 1).alias("record_type"),
        F.regexp_extract(text, "WARC-Payload-Digest: sha256:([0-9a-f]+)", 1).alias("digest"),
        F.nullif(number("WARC-Refers-To"), F.lit("")).cast("bigint").alias("refers_to"), "payload")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; all digests recomputed."""
    tables = Tables(spark, "archive-read")
    own = F.sha2("payload", 256)
    checked = F.when(
        (F.col("record_type") == "revisit") | (own == F.col("digest")), F.col("digest")
    ).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), "digest")))
    found = tables.keep(parsed(records(spark, folder)).select(
        "page_id", "record_type", "refers_to", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        checked.alias("payload_digest")), "found")
    response, revisit = found.where("record_type = 'response'"), found.where("record_type = 'revisit'")
    sizes = response.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    resolved = revisit.drop("payload_bytes").join(sizes, ["refers_to", "payload_digest"], "left")
    lost = F.when(F.col("payload_bytes").isNull(), F.raise_error(F.lit("a revisit refers to no response"))).otherwise(F.col("payload_bytes"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return response.select(*columns).unionByName(resolved.withColumn("payload_bytes", lost).select(*columns))


def export(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Writes the records as WARC files of one task each; one row (file, records, bytes) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, uri, count, size = None, f"{target}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc", 0, 0
        for b in batches:
            for record in b.column(0):
                if sink is None:
                    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
                    if isinstance(fs, pyarrow.fs.LocalFileSystem):
                        fs.create_dir(os.path.dirname(path), recursive=True)
                    sink = fs.open_output_stream(path)
                raw = record.as_py()
                sink.write(raw)
                count, size = count + 1, size + len(raw)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([count]), pa.array([size])], ["file", "records", "bytes"])

    return Tables(spark, "archive-files").keep(records(spark, folder).mapInArrow(run, "file string, records bigint, bytes bigint"), "files")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes an archive of all pages to the shared folder and reads it back."""
    spark = pages.sparkSession
    folder = Tables(spark, "archive").root
    write(pages, folder)
    return read(spark, folder)
