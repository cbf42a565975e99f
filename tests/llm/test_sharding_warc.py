import base64
import gzip
import hashlib
import zlib

import pytest

from tideledger.llm import sharding, warc
from tideledger.session import scratch

TEXTS = [(1, "a"), (2, None), (3, ""), (3, ""), (None, "b é"), (None, "c"), (4, "word " * 5000), (-5, "a")]


def test_shards_are_gapless_and_grow_into_the_new_one_only(spark, documents):
    rows = sharding.assign(documents(TEXTS + [(i, f"t{i}") for i in range(100, 2000)]), "doc_id", "text").collect()
    assert len(rows) == len(TEXTS) + 1900
    for shard in range(8):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
        assert 150 < len(slots) < 340
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert all(r.grown_shard == 8 for r in moved) and 120 < len(moved) < 310
    assert {r.law for r in rows} == {"key"}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(s) == 1 for s in by.values())  # repeated and null keys too
    long = next(r for r in rows if r.doc_id == 4)
    assert (long.size, long.text_crc32) == (25001, zlib.crc32(b"word " * 5000))
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 2} == {(1, 0)}


def test_weights_and_split_do_not_matter_to_a_key(spark, documents):
    docs = documents([(i, f"t{i}") for i in range(3000)])
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs.repartition(1), "doc_id", "text", (1, 1, 2)).collect()}
    two = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs.repartition(7), "doc_id", "text", (1, 1, 2)).collect()}
    assert one == two
    assert 1300 < sum(s == 2 for s, _ in one.values()) < 1700
    with pytest.raises(ValueError):
        sharding.assign(docs, "doc_id", "text", (1, 0))


def test_sharding_of_an_empty_table(documents):
    assert sharding.assign(documents([]), "doc_id", "text").count() == 0


PAGES = [
    (1, "http://a.example/x?y=1#z", "<p>one</p>"), (2, None, "<p>one</p>"), (7, "http://b.example", "<p>one</p>"), (3, "http://c.example/\r\nq", None),
    (4, "http://d.example/", ""), (5, "http://e.example/", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nend\r\n"), (6, "http://f.example/", "\r\n\r\n"),
    (8, "http://g.example/", "ünï\n" * 30000), (9, "http://h.example/", "twice"), (9, "http://h.example/", "twice"), (None, "http://i.example/", "<p>one</p>"),
    (None, "http://j.example/", "alone"),
]


def expected(rows, least=0):
    best = {}
    for page, _, html in rows:
        key = (html or "").encode()
        best[key] = max(best.get(key, -(2**63)), -(2**63) if page is None else page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        own = -(2**63) if page is None else page
        again = len(data) >= least and own != best[data]
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best[data] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_come_back_whole(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'x' AS digest", "1 AS row", "2 AS page")
    path = scratch(spark, "warc")
    warc.write_archives(pages.repartition(3), path, min_bytes=least)
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    got = []
    for c in captures:
        refers = c.head.refers_to
        page = c.head.headers.get("x-page-id")
        got.append((int(page) if page else None, c.head.payload_bytes, c.head.payload_digest, c.head.record_type, int(refers.split(":")[2]) if refers else None))
        assert len(c.requests) == len(c.metadata) == 1
        assert c.head.record_id == c.capture_id
    assert sorted(got, key=str) == expected(PAGES, least)
    payloads = {bytes(c.head.payload) for c in captures if c.head.record_type == "response"}
    assert payloads == {(html or "").encode() for _, _, html in PAGES}


def test_orphans_and_foreign_archives(spark, tmp_path):
    record = lambda kind, name, block, extra=b"": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: " + name + b"\r\n" + extra + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    data = [
        record(b"warcinfo", b"<i>", b"software: x\r\n"),
        record(b"request", b"<q>", b"GET / HTTP/1.1\r\n\r\n", b"WARC-Concurrent-To: <gone>\r\n"),
        record(b"metadata", b"<m>", b"", b"WARC-Concurrent-To: <r>\r\n"),
        record(b"metadata", b"<m2>", b"k: v", b"WARC-Concurrent-To: <r>\r\n"),
        record(b"response", b"<r>", b"HTTP/1.1 404 Not Found\r\n\r\nbody\r\n", b"Content-Type: application/http; msgtype=response\r\n"),
    ]
    for n, part in enumerate((data[:3], data[3:])):
        (tmp_path / f"{n}.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in part))  # a member per record, as crawlers write
    rows = {c.capture_id: c for c in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert set(rows) == {"<gone>", "<r>"}
    assert rows["<gone>"].head is None and len(rows["<gone>"].requests) == 1
    assert rows["<r>"].head.http_status == 404 and bytes(rows["<r>"].head.payload) == b"body\r\n"
    assert [m.record_id for m in rows["<r>"].metadata] == ["<m2>", "<m>"] or [m.record_id for m in rows["<r>"].metadata] == ["<m>", "<m2>"]


def test_a_cut_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.parse_stream(iter([b"WARC/1.1\r\nContent-Length: 50", b"short"])))


def test_no_pages_write_nothing(spark):
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0
