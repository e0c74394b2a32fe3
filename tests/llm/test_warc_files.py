"""Archives of other writers: one gzip member a record, plain files, other record kinds, clashing segments; time in proportion."""

import gzip
import time

from millrace.llm.warc import BrokenArchive, _parse, chunked, read_archives


def record(kind, name, block, **fields):
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), *[(k.replace("_", "-"), v) for k, v in fields.items()], ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def http(payload):
    return b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, 7)


def segmented(name, payload, cut):
    whole = http(payload)
    first = record("response", name, whole[:cut], WARC_Segment_Number=1)
    last = record("continuation", f"{name}:2", whole[cut:], WARC_Segment_Number=2, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Total_Length=len(whole))
    return first, last


def test_kinds_and_compression(spark, tmp_path):
    records = [record("warcinfo", "i", b"software: x"), record("request", "q", b"GET / HTTP/1.1\r\n\r\n"), record("response", "a", http(b"payload a")), record("revisit", "b", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To="<a>"), *segmented("c", b"a longer payload", 60)]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "plain.warc").write_bytes(b"".join(records).replace(b"<", b"<p-"))
    (tmp_path / "other.bin").write_bytes(b"neither")
    got = {r.record_id: r for r in read_archives(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b", "c", "p-a", "p-b", "p-c", None} and got[None].fault == "not gzip"
    assert got["a"].payload == got["p-a"].payload == b"payload a" and got["b"].payload is None and got["b"].refers_to == "a"
    assert got["c"].payload == got["p-c"].payload == b"a longer payload" and got["c"].n_segments == 2


def test_clashing_segments(spark, tmp_path):
    first, last = segmented("c", b"some payload", 60)
    other, _ = segmented("c", b"some PAYLOAD", 62)
    twice, rest = segmented("d", b"told twice", 61)
    (tmp_path / "a.warc").write_bytes(first + last + twice + rest)
    (tmp_path / "b.warc").write_bytes(other + twice + rest)
    got = sorted(((r.record_id, r.payload, r.fault) for r in read_archives(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([("c", None, "segments differ")] * 2 + [("d", b"told twice", None)] * 2, key=repr)


def test_time_in_proportion():
    def seconds(n):
        content = b"".join(gzip.compress(record("response", f"r{k}", http(b"x" * 700 + str(k).encode())), 1) for k in range(n))
        began = time.process_time()
        assert sum(1 for _ in _parse(content)) == n
        return time.process_time() - began

    seconds(500)
    small = min(seconds(4000) for _ in range(3))
    assert seconds(32_000) < 16 * small  # eight times as many records; the square would be 64


def test_a_header_without_end():
    try:
        list(_parse(b"WARC/1.1\r\n" + b"x" * (3 << 20)))
    except BrokenArchive as e:
        assert str(e) == "header"
    else:
        raise AssertionError
