"""Reading archives as streams, and revisits against the responses that were read."""

import gzip

import pytest
from pyspark.sql import functions as F

from matforge.llm import warc

ID = "00000000-0000-0000-0000-00000000000{}"
DIGEST = "a9993e364706816aba3e25717850c26c9cd0d89d"  # of abc


def test_inflated_members():
    data = b"".join(gzip.compress(bytes([65 + i]) * n) for i, n in enumerate((0, 1, 300_000, 5)))
    for size in (7, 1000, 1 << 20):
        assert b"".join(warc.inflated(data, size)) == b"B" + b"C" * 300_000 + b"DDDDD"
    assert list(warc.inflated(b"plain")) == [b"plain"]
    with pytest.raises(ValueError):
        list(warc.inflated(data[:-20], 64))


def archive(path, *records):
    path.mkdir(exist_ok=True)
    (path / "a.warc.gz").write_bytes(b"".join(gzip.compress((r + warc.END).encode()) for r in records))
    return str(path)


def test_lost_response(spark, tmp_path):
    response, = warc.page_records(1, "u", "abc", None, DIGEST, ID.format(1), 1000, 100)
    revisit, = warc.page_records(2, "u", "abc", 1, DIGEST, ID.format(2), 1000, 100)
    got = {r["page_id"]: r for r in warc.read_archives(spark, archive(tmp_path / "whole", revisit, response)).collect()}
    assert got[2]["payload_bytes"] == 3 and got[2]["payload_digest"] == DIGEST and got[2]["refers_to"] == 1 and got[1]["payload"] == b"abc"
    for broken in ((revisit,), (revisit, response.replace("X-Page-ID: 1", "X-Page-ID: 7"))):
        with pytest.raises(Exception, match="response of a revisit is missing"):
            warc.read_archives(spark, archive(tmp_path / "broken", *broken)).collect()


def test_common_and_long_pages(spark):
    """One page is a third of all rows; one is long; ids repeat and are null; extra columns bear clashing names."""
    common, long = "<p>common</p>" * 200, "ü" * 400_000
    rows = [(i, "u", common if i % 3 == 0 else f"{i}" * 400) for i in range(300)] + [(None, None, common), (298, "u", common), (299, "v", common), (299, "v", common), (500, "u", long), (501, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("k", F.lit(2)).repartition(7)
    got = warc.round_trip(df, records_per_file=50).collect()
    assert len(got) == len(rows)
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == len(common) and r["page_id"] is not None)
    assert kinds == sorted([(i, "revisit", 299) for i in range(0, 300, 3)] + [(298, "revisit", 299), (299, "response", None), (299, "response", None)])
    null = [r for r in got if r["page_id"] is None]
    assert [(r["record_type"], r["refers_to"]) for r in null] == [("revisit", 299)]
    assert next(r for r in got if r["page_id"] == 500)["payload"] == long.encode()
