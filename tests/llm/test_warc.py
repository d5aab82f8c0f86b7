"""WARC archives: an exact round trip."""

import pytest
from pyspark.sql import functions as F

from landgraph.llm.warc import base32_sha1, chunked, dechunked, parse_archive, read_archives, write_archives


def test_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "x" * 300_000), (2, "http://b", "x" * 300_000), (3, None, None), (4, "u\r\nv", ""), (5, "http://c", "WARC/1.1\r\n\r\n0\r\n\r\né"), (0, "http://d", "same"), (9, "http://e", "same"), (None, "http://f", "same"), (0, "http://g", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = "file://" + str(tmp_path / "w")
    write_archives(df, path, payload=F.col("html"), segment_bytes=1000)
    got = [(None if r.key is None else int(r.key), r.warc_type, r.refers, r.payload_bytes, r.digest, None if r.payload is None else bytes(r.payload)) for r in read_archives(spark, path).collect()]
    assert len(got) == len(pages)
    by_id = {}
    for row in got:
        by_id.setdefault(row[0], []).append(row[1:])
    digest = lambda s: "sha1:" + base32_sha1(s.encode())
    assert by_id[1] == [("response", None, 300_000, digest("x" * 300_000), b"x" * 300_000)]
    assert by_id[2] == [("revisit", "1", 300_000, digest("x" * 300_000), None)]
    assert by_id[3][0][:3] == ("response", None, 0) and by_id[4][0][:3] == ("revisit", "3", 0)
    assert by_id[5][0][4] == pages[4][2].encode()
    assert [r[0] for r in by_id[0]] == ["response"] * 2 and by_id[9][0][:2] == ("revisit", "0") and by_id[None][0][0] == "revisit"


def test_small_payloads_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = "file://" + str(tmp_path / "w")
    write_archives(df, path, payload=F.col("html"), min_bytes=3)
    assert {r.key: r.warc_type for r in read_archives(spark, path).collect()} == {"1": "response", "2": "response", "3": "response", "4": "revisit"}
    path = "file://" + str(tmp_path / "e")
    write_archives(df.limit(0), path, payload=F.col("html"))
    assert read_archives(spark, path).count() == 0


def test_framing():
    for n in (0, 1, 8191, 8192, 8193, 100_000):
        assert dechunked(chunked(b"z" * n)) == b"z" * n
    with pytest.raises(ValueError):
        dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(parse_archive(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
