"""A content-addressed web archive.

Two tables make an archive: `payloads` holds every distinct payload once, under its SHA-256, written after the digest
has been taken from the very bytes; `records` holds each record's exact header block and the digest that it is found
under. Records with equal payloads of `LEAST_BYTES` bytes or more become one response (the largest page_id) and
revisits that refer to it; smaller ones are all responses. Reading joins the two tables again and rebuilds each
original record (header block, payload) byte by byte: digests and lengths are taken anew from what was rebuilt and
compared with what the header says.

A payload that a third of all pages share is reduced on the map side before any shuffle (first is a partial
aggregate); joins are of two plain shuffles, which adaptive execution splits. Null html is an empty payload; a null
url gives an empty WARC-Target-URI; rows that repeat a page_id are records of their own (of equal payloads one row of
the largest page_id is the response, the rest revisit it); a null page_id is written as "null" and counts as smaller
than all others. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored

LEAST_BYTES = 1000
CRLF = "\r\n"


def _header(kind: Column, page: Column, url: Column, sha1: Column, length: Column, refers: Column) -> Column:
    """A record's header block, to its blank line; the time is fixed so that equal pages make equal bytes."""
    name = lambda p: F.concat(F.lit("<urn:page:"), F.coalesce(p.cast("string"), F.lit("null")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), name(page)),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.regexp_replace(url, r"[\r\n]", "%0A"), F.lit(""))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("WARC-Payload-Length: "), length.cast("string")),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit("0")).otherwise(length.cast("string"))),
    ]
    revisit = F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), name(refers))
    return F.concat(F.concat_ws(CRLF, *lines), F.when(kind == "revisit", revisit).otherwise(F.lit("")), F.lit(CRLF * 2))


def write_archive(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """pages(page_id, url, html) as an archive below path."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sha256 = F.unhex(F.sha2(F.col("payload"), 256))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    once = rows.select(sha256.alias("sha256"), "payload").groupBy("sha256").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")
    light = stored(rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", sha256.alias("sha256"), F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("bigint").alias("bytes")), "warc-rows")
    firsts = stored(light.where(F.col("bytes") >= least).groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("sha256", "first"), "warc-firsts")
    placed = light.join(firsts, "sha256", "left")
    revisit = F.col("first").isNotNull() & (F.col("row") != F.col("first.row"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    records = placed.select("sha256", _header(kind, F.col("page_id"), F.col("url"), F.lower(F.hex("sha1")), F.col("bytes"), F.col("first.page_id")).cast("binary").alias("header"))
    records.write.parquet(f"{path}/records")
    discard(light, firsts)


def _field(header: Column, name: str) -> Column:
    """A header's value; null where the block has no such line."""
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: ?([^\r\n]*)", 1), F.lit(""))


def original_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the record's bytes: its header block, its payload unless it is a revisit, and two line ends; header and full payload beside it.

    Fails if a stored payload is not the one that its digest names.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    same = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    whole = payloads.select("sha256", F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.hex("sha256"))).cast("binary")).alias("payload"))
    records = spark.read.parquet(f"{path}/records").select("sha256", F.col("header").cast("string").alias("header"))
    body = F.when(_field(F.col("header"), "WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    page = F.nullif(F.regexp_extract(_field(F.col("header"), "WARC-Record-ID"), r"<urn:page:(-?[0-9]+)>", 1), F.lit("")).cast("bigint")
    return records.join(whole, "sha256").select(page.alias("page_id"), F.concat(F.col("header").cast("binary"), body, F.lit(CRLF * 2).cast("binary")).alias("record"), "header", "payload")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest and payload_bytes of each rebuilt record.

    Fails if a rebuilt record's lengths or digest differ from what its header says.
    """
    header, bytes_of, digest = F.col("header"), F.octet_length("payload").cast("bigint"), F.sha1("payload")
    said = F.regexp_extract(header, r"(?m)^WARC-Payload-Digest: sha1:([0-9a-f]{40})", 1)
    body = F.octet_length("record") - F.octet_length(header) - len(CRLF * 2)
    right = (said == F.col("digest")) & (_field(header, "WARC-Payload-Length").cast("bigint") == F.col("bytes")) & (_field(header, "Content-Length").cast("bigint") == F.col("body"))
    refers = F.nullif(F.regexp_extract(F.coalesce(_field(header, "WARC-Refers-To"), F.lit("")), r"<urn:page:(-?[0-9]+)>", 1), F.lit("")).cast("bigint")
    taken = original_records(spark, path).select("page_id", "header", bytes_of.alias("bytes"), digest.alias("digest"), body.alias("body"))
    checked = F.when(right, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("record does not fit its payload "), F.col("digest"))).cast("string"))
    return taken.select("page_id", F.col("bytes").alias("payload_bytes"), checked.alias("payload_digest"), _field(header, "WARC-Type").alias("record_type"), refers.alias("refers_to"), _field(header, "WARC-Target-URI").alias("url"))
