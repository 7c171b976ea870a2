"""A content-addressed web archive: payload bytes once, exact record headers apart.

An archive is a folder with two tables. ``payloads`` holds each different
payload once, under its SHA-256. ``records`` holds one exact WARC/1.0 header
block per record, with the digest of its payload. Reading joins the two on the
digest and checks stored bytes against it. Everything is built-in expressions;
payloads are moved once, to find the copies, and records carry digests only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.session import cut_lineage

# A shorter payload is stored in full by every record that has it.
LEAST_SHARED = 1000
BREAK = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line; none if the value is null. Line breaks inside a value are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(BREAK)), F.lit(""))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def header_block(date: str) -> Column:
    """The header of a record, up to and with its blank line, from page_id, url, type, refers_to, sha1 and bytes."""
    body = F.when(F.col("type") == "response", F.col("bytes")).otherwise(F.lit(0))
    return F.concat(
        F.lit(f"WARC/1.0{BREAK}"),
        _line("WARC-Type", F.col("type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Profile", F.when(F.col("type") == "revisit", F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(F.col("type") == "revisit", _record_id(F.col("refers_to")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", body),
        F.lit(BREAK),
    )


def write_archive(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", least_shared: int = LEAST_SHARED) -> None:
    """One record per row of ``pages`` (page_id, url, html); the payload is the html in UTF-8, a null one empty.

    Of records with equal payloads of at least ``least_shared`` bytes, that with
    the largest page_id is the response and the others revisit it. Rows that
    repeat the largest id are responses too; a null id is smaller than any.
    Other columns are not stored.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")

    facts = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    facts = cut_lineage(facts, "page-digests")
    owners = facts.where(F.col("bytes") >= least_shared).groupBy("digest").agg(F.max("page_id").alias("owner"))
    told = facts.join(owners, "digest", "left").withColumn(
        "type", F.when(F.col("owner").isNull() | F.col("owner").eqNullSafe(F.col("page_id")), "response").otherwise("revisit")
    )
    told = told.withColumn("refers_to", F.when(F.col("type") == "revisit", F.col("owner")))
    told.select("digest", header_block(date).alias("header")).write.parquet(f"{path}/records")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload) of an archive. A payload that its digest does not describe is an error."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("stored payload does not match digest "), "digest")).cast("binary")
    return stored.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong).alias("payload"))


def read_archive(spark: SparkSession, path: str, facts: dict[str, Column] | None = None) -> DataFrame:
    """(header, digest, payload) of every record, revisits with the payload they refer to.

    With ``facts``, these expressions of the payload come instead of it: they are
    computed once for each stored payload, and the bytes are not moved.
    """
    records = spark.read.schema("digest string, header string").parquet(f"{path}/records")
    payloads = read_payloads(spark, path)
    if facts is not None:
        payloads = payloads.select("digest", *(c.alias(name) for name, c in facts.items()))
    return records.join(payloads, "digest")


def header_value(header: str | Column, name: str) -> Column:
    """The value of a header line, null if there is none."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def record_text(header: str = "header", payload: str = "payload") -> Column:
    """A record as it stands in a file, without the two line breaks that end it. A revisit has no body."""
    body = F.when(header_value(header, "WARC-Type") == "response", F.decode(payload, "UTF-8")).otherwise(F.lit(""))
    return F.concat(header, body)


def export_files(records: DataFrame, path: str) -> None:
    """Reconstructed records as WARC files, one per partition."""
    records.select(record_text()).write.option("lineSep", BREAK + BREAK).text(path)


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """(header, body) of the records in WARC files, cut by their stated lengths. A file is read as a whole by one task."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found, at = [], 0
                while at < len(content):
                    end = content.index(b"\r\n\r\n", at) + 4
                    header = content[at:end].decode()
                    length = int(header.split("\r\nContent-Length: ")[1].split("\r\n")[0])
                    found.append((header, content[end : end + length]))
                    at = end + length + 4
                yield pd.DataFrame(found, columns=["header", "body"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(cut, "header string, body binary")
