"""WARC: the query's SQL, exact records through files, damage, odd rows."""

import glob
import hashlib

import oracle
import pytest
from pyspark.sql import functions as F

from admitflow.llm import queries, warc
from admitflow.sources.tables import new_path

LONG = "<p>é</p>" * 200
ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, "http://a/9", LONG), (9, "http://a/9", LONG), (3, None, "short"), (4, "u\r\nX: y", "short"),
    (5, "http://a/5", None), (6, "http://a/6", ""), (None, "http://n", LONG), (7, "http://a/7", "x" * 2_000_000), (8, "http://a/8", "WARC/1.0\r\n\r\nWARC-Type: x\r\n\r\n" * 50),
]


def test_query_matches_sql(spark, folder):
    assert oracle.compare(queries.QUERIES["op7_warc"](spark, folder), oracle.connect(folder), queries.ORACLES["op7_warc"]) is None


@pytest.fixture(scope="module")
def archive(spark):
    path = new_path(spark, "warc-test")
    pages = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "page_id long, url string, html string, digest string, payload string")
    warc.write_archive(pages, path)
    return path


def test_records(spark, archive):
    records = warc.read_archive(spark, archive).withColumn("page_id", warc.page_of(warc.header_value("header", "WARC-Record-ID")))
    rows = records.select("page_id", "header", "payload", warc.header_value("header", "WARC-Type").alias("kind"), warc.page_of(warc.header_value("header", "WARC-Refers-To")).alias("to")).collect()
    got = sorted((r.page_id or 0, r.kind, r.to, bytes(r.payload)) for r in rows)
    want = sorted((k or 0, "revisit" if h == LONG and k != 9 else "response", 9 if h == LONG and k != 9 else None, (h or "").encode()) for k, _, h in ROWS)
    assert got == want
    assert spark.read.parquet(f"{archive}/payloads").count() == len({h or "" for _, _, h in ROWS})
    assert all(r.header.endswith("\r\n\r\n") and r.header.count("\r\n\r\n") == 1 for r in rows)


def test_files_hold_the_same_records(spark, archive):
    path = new_path(spark, "warc-files")
    records = warc.read_archive(spark, archive)
    warc.export_files(records, path)
    got = sorted((r.header, bytes(r.body)) for r in warc.import_files(spark, path).collect())
    want = sorted((r.header, b"" if "WARC-Type: revisit" in r.header else bytes(r.payload)) for r in records.collect())
    assert got == want and glob.glob(f"{path.removeprefix('file:')}/part-*")


def test_facts_come_without_payload(spark, archive):
    facts = warc.read_archive(spark, archive, {"sha1": F.sha1("payload")})
    assert facts.columns == ["digest", "header", "sha1"]
    assert {r.sha1 for r in facts.collect()} == {hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in ROWS}


def test_damage_is_an_error(spark, archive):
    path = new_path(spark, "warc-damaged")
    spark.read.parquet(f"{archive}/records").write.parquet(f"{path}/records")
    spark.read.parquet(f"{archive}/payloads").withColumn("payload", F.encode(F.lit("changed"), "UTF-8")).write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, path).collect()


def test_empty_table(spark):
    path = new_path(spark, "warc-empty")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0
