import hashlib
import io
import os
import zlib

from boxwright.llm import warc


def archive(records):
    return b"".join(warc.record(*r) for r in records)


def made(n=40):
    out = []
    for k in range(n):
        payload = os.urandom(50 * k) if k % 3 else (b"text %d " % k) * (10 * k)
        out.append((k, None if k % 5 == 0 else f"http://x/{k}", payload, hashlib.sha1(payload).hexdigest(), None if k % 7 else k + 1))
    return out


def test_every_split_size_reads_each_record_once():
    records = made()
    data = archive(records)
    for split in (1, 7, 100, 1000, 5000, len(data), 2 * len(data)):
        found = []
        for start in range(0, len(data), split):
            found += [warc.parse(r) for r in warc.records_in(io.BytesIO(data), len(data), start, min(start + split, len(data)))]
        assert [f["page_id"] for f in found] == [r[0] for r in records]
        for f, r in zip(found, records, strict=True):
            assert f["payload_digest"] == r[3] and f["payload_bytes"] == len(r[2]) and f["refers_to"] == r[4]
            assert f["payload"] == (r[2] if r[4] is None else b"")


def test_magic_inside_data_and_other_members_are_no_records():
    noise = b"\x1f\x8b\x08" * 50 + b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + os.urandom(200)
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = squeeze.compress(b"not a record") + squeeze.flush()
    records = [(k, "u", noise * 3, hashlib.sha1(noise * 3).hexdigest(), None) for k in range(5)]
    data = other + archive(records[:2]) + b"\0\0\0" + other + archive(records[2:]) + b"\x1f\x8b"
    for split in (11, 333, len(data)):
        found = [warc.parse(r)["page_id"] for s in range(0, len(data), split) for r in warc.records_in(io.BytesIO(data), len(data), s, min(s + split, len(data)))]
        assert found == list(range(5))


def brute(rows):
    best = {}
    for page_id, html in rows:
        raw = (html or "").encode()
        if len(raw) >= warc.LEAST_REVISIT:
            best[raw] = max(best.get(raw, page_id), page_id)
    out = []
    for page_id, html in rows:
        raw = (html or "").encode()
        target = best.get(raw, page_id)
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if target == page_id else "revisit", None if target == page_id else target))
    return out


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "SPLIT_BYTES", 500)
    big, limit = "é<p>x</p>" * 200, "a" * warc.LEAST_REVISIT
    rows = [(1, big), (9, big), (4, big), (2, None), (3, ""), (5, limit), (6, limit), (7, limit[:-1]), (8, limit[:-1]), (30, "p" * 5000)] + [(100 + k, f"page {k} " * k) for k in range(60)]
    pages = spark.createDataFrame([(p, None if p % 2 else "http://a\r\nb", h, "clash") for p, h in rows], "page_id long, url string, html string, digest string").repartition(4)
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_repeated_rows_and_empty_table(spark):
    big = "x" * 2000
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (2, "u", big)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == [(1, "revisit", 2), (2, "response", None), (2, "response", None)]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_one_page_id_with_two_payloads_and_rows_without_an_id(spark):
    rows = [(5, "a" * 2000), (5, "b" * 2000), (9, "a" * 2000), (None, "a" * 2000), (None, "c" * 2000), (None, None)]
    pages = spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    assert got == sorted([(5, sha("a" * 2000), "revisit", 9), (5, sha("b" * 2000), "response", None), (9, sha("a" * 2000), "response", None), (None, sha("a" * 2000), "response", None), (None, sha("c" * 2000), "response", None), (None, sha(""), "response", None)], key=str)


def test_reading_is_split_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 2000)
    pages = spark.createDataFrame([(k, "u", os.urandom(600).hex()) for k in range(200)], "page_id long, url string, html string").repartition(2)
    found = warc.round_trip(pages)
    assert found.rdd.getNumPartitions() > 8 and found.count() == 200
