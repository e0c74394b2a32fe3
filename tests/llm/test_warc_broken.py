"""Archives that are cut off, damaged or hostile."""

import gzip

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc


@pytest.mark.parametrize("body", [b"1\r\nX\r\n-6\r\n", b"1\r\nX\r\n+0\r\n\r\n", b"0x1\r\nX\r\n0\r\n\r\n", b"\r\n0\r\n\r\n", b"5\r\nab\r\n0\r\n\r\n", b"1_0\r\n0\r\n\r\n", b"1\r\nX", b""])
def test_broken_framing_ends(body):
    with pytest.raises(ValueError):
        warc.dechunked(body)


def _file(tmp_path, name, content):
    (tmp_path / name).write_bytes(content)


def _record(k, block=b"HTTP/1.1 200 OK\r\n\r\nhello", **more):
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<r{k}>"), *[(n.replace("_", "-"), v) for n, v in more.items()], ("Content-Length", len(block))]
    return warc._head(fields) + block + b"\r\n\r\n"


def test_damaged_files_keep_what_is_whole(spark, tmp_path):
    whole = b"".join(_record(k) for k in range(50))
    _file(tmp_path, "a.gz", gzip.compress(whole))
    _file(tmp_path, "b.gz", gzip.compress(whole[: len(whole) - 40]))
    _file(tmp_path, "c.gz", gzip.compress(whole)[:-60])
    _file(tmp_path, "d.gz", b"no archive at all")
    _file(tmp_path, "e.gz", gzip.compress(_record(1) + b"GARBAGE\r\n\r\n" + _record(2)))
    _file(tmp_path, "f.gz", b"")
    _file(tmp_path, "g.gz", gzip.compress(_record(1)) + gzip.compress(_record(2)))
    _file(tmp_path, "h.gz", gzip.compress(_record(1).replace(b"Content-Length: 24", b"Content-Length: -4")))
    got = {}
    for name in "abcdefgh":
        rows = warc.read_archives(spark, str(tmp_path / f"{name}.gz")).collect()
        got[name] = sum(r.fault is None for r in rows), [r.fault for r in rows if r.fault]
        assert all(bytes(r.payload) == b"hello" for r in rows if r.fault is None)
    assert got["a"] == (50, []) and got["b"] == (49, ["cut off"]) and got["d"] == (0, ["not gzip"])
    assert got["c"][0] < 50 and got["c"][1] == ["cut off"]
    assert got["e"] == (1, ["header"]) and got["f"] == (0, []) and got["g"] == (2, []) and got["h"] == (0, ["header"])


def test_missing_segments_keep_a_row(spark, tmp_path):
    block = warc._HTTP + warc.chunked(b"some payload", 4)
    more = lambda k, **x: {"WARC_Segment_Origin_ID": "<r9>", "WARC_Segment_Number": k, **x}
    parts = [_record(10, block[50:80], **more(2)), _record(11, block[80:], **more(3, WARC_Segment_Total_Length=len(block)))]
    _file(tmp_path, "a.gz", gzip.compress(b"".join(parts)))
    (row,) = warc.read_archives(spark, str(tmp_path / "a.gz")).collect()
    assert (row.record_id, row.record_type, row.n_segments, row.payload, row.fault) == ("r9", None, 2, None, "segment missing")
    first = _record(9, block[:50], WARC_Segment_Number=1)
    _file(tmp_path, "b.gz", gzip.compress(parts[1] + first + parts[0]))
    (row,) = warc.read_archives(spark, str(tmp_path / "b.gz")).collect()
    assert (row.record_id, row.n_segments, bytes(row.payload), row.fault) == ("r9", 3, b"some payload", None)


def test_one_payload_at_very_many_pages(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("own "), "id")).otherwise(F.lit("shared")).alias("html"))
    rows = warc.archived_pages(pages).collect()
    assert len(rows) == 3000 and all(r.payload_bytes for r in rows)
    assert {r.refers_to for r in rows if r.page_id % 100} == {2999, None} and sum(r.record_type == "response" for r in rows) == 31
