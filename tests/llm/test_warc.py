import gzip
import hashlib
import io

import pytest

from veilsift.llm.warc import MAGIC, headers, member, payload_of, read_archives, record_bytes, records, resolved, write_archives

SCHEMA = "page_id bigint, url string, html string, payload string, same string, bytes string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", "s", "b") for i, u, h in rows], SCHEMA)


BIG, OTHER = "<p>" + "same text " * 200, "<p>" + "été " * 400
ROWS = [(1, "http://a/1", BIG), (5, "http://a/5", BIG), (3, None, BIG), (2, "http://a/2", "small"), (4, "http://a/4", "small"), (6, "u\r\nv", None), (7, "http://a/7", ""), (8, "http://é/8", OTHER), (9, "http://a/9", "x\r\n\r\nWARC/1.1\r\n" * 300), (None, "http://n", OTHER), (10, "http://a/10", OTHER), (10, "http://a/10", OTHER)]


def test_round_trip_with_revisits(spark):
    out = sorted((tuple(r) for r in resolved(read_archives(write_archives(pages(spark, ROWS)))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()), key=str)
    last, want = {BIG: 5, OTHER: 10}, []
    for i, _, h in ROWS:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and h in last and i != last[h]
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h] if again else None, True))
    assert out == sorted(want, key=str)


@pytest.mark.parametrize("size", [97, 1000, 1 << 20])
def test_every_record_is_read_once_whatever_the_splits(spark, size):
    rows = [(i, f"http://x/{i}", f"page {i} " * (i * 37 % 500)) for i in range(60)]
    got = read_archives(write_archives(pages(spark, rows)), size=size).select("page_id", "url").collect()
    assert sorted(map(tuple, got)) == [(i, u) for i, u, _ in rows]


def archive():
    parts = [b"".join(member(record_bytes(i, f"http://x/{i}", bytes([i % 251]) * (900 * i % 7000), b"\1" * 20, None, False))) for i in range(40)]
    junk = b"".join(member(iter([b"not a record " * 50])))
    return b"".join([*parts[:20], junk, *parts[20:]]), parts


def test_ranges_own_the_records_that_start_in_them():
    data, parts = archive()
    starts = [at for at, _, _ in records(io.BytesIO(data), 0, len(data))]
    assert len(starts) == len(parts)
    for step in (1, 333, 5000):
        found = [at for lo in range(0, len(data), step) for at, _, _ in records(io.BytesIO(data), lo, min(len(data), lo + step))] if step > 1 else starts
        assert found == starts


def test_magic_inside_a_member_is_no_record():
    inner = b"".join(member(record_bytes(1, "http://inner", b"x", b"\1" * 20, None, False)))
    squeeze = __import__("zlib").compressobj(0, 8, 31)  # stored, so that the inner member's bytes are there as they are
    outer = squeeze.compress(b"".join(record_bytes(2, "http://outer", inner * 3, b"\1" * 20, None, False))) + squeeze.flush()
    assert outer.count(MAGIC) > 1
    found = [f["warc-target-uri"] for _, f, _ in records(io.BytesIO(outer), 0, len(outer))]
    assert found == ["http://outer"]


def test_other_readers_can_read_the_members():
    data = b"".join(member(record_bytes(1, "http://x", b"body", hashlib.sha1(b"body").digest(), None, False)))
    text = gzip.decompress(data)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = headers(head)
    assert int(fields["content-length"]) + 4 == len(rest)
    _, fields, body = next(records(io.BytesIO(data), 0, len(data)))
    assert payload_of(fields, body) == (4, hashlib.sha1(b"body").hexdigest())


def test_long_urls_and_payloads_come_back_whole(spark):
    rows = [(1, "http://x/" + "u" * 1_500_000, "short"), (2, "http://y", "".join(chr(97 + i * i % 26) for i in range(700_000))), (3, "http://z", "after")]
    out = {r["page_id"]: r for r in resolved(read_archives(write_archives(pages(spark, rows)), size=50_000)).collect()}
    assert {i: (out[i]["url"], out[i]["payload_digest"], out[i]["intact"]) for i in out} == {i: (u, hashlib.sha1(h.encode()).hexdigest(), True) for i, u, h in rows}


def test_records_of_other_writers(spark, tmp_path):
    head = "WARC/1.0\r\nWARC-Type: {}\r\nContent-Type: {}\r\nContent-Length: {}\r\n\r\n"
    info, page = b"software: x", b"HTTP/1.0 200 OK\r\n\r\nhello"
    data = b"".join(b"".join(member(iter([head.format(kind, content, len(block)).encode(), block, b"\r\n\r\n"]))) for kind, content, block in [("warcinfo", "application/warc-fields", info), ("response", "application/http; msgtype=response", page)])
    (tmp_path / "other.warc.gz").write_bytes(data)
    listed = spark.createDataFrame([(f"file://{tmp_path}/other.warc.gz", len(data))], "path string, bytes bigint")
    out = {r["record_type"]: (r["payload_bytes"], r["payload_digest"], r["intact"], r["record_id"]) for r in read_archives(listed).collect()}
    assert out == {"warcinfo": (len(info), hashlib.sha1(info).hexdigest(), None, None), "response": (5, hashlib.sha1(b"hello").hexdigest(), None, None)}


def test_empty_table(spark):
    assert resolved(read_archives(write_archives(pages(spark, [])))).count() == 0
