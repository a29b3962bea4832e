"""WARC archives: exact round trips, true gzip files and an index that finds each record."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import os
import zlib

import pytest

from tributary.llm.warc import EMPTY_MEMBER, archive_round_trip, deflate, fetch, inflate, normalise, parse, read_index, read_records, record, split_records, with_origins, write_monolithic


def want(rows):
    out = []
    for p, h in rows:
        b = (h or "").encode()
        same = [q for q, g in rows if (g or "") == (h or "") and q is not None]
        origin = max(same, default=None)
        refers = origin if len([1 for _, g in rows if (g or "") == (h or "")]) > 1 and origin is not None and p != origin else None
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


def test_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = sorted((tuple(r) for r in archive_round_trip(pages).collect()), key=repr)
    assert got == want([(r.page_id, r.html) for r in pages.collect()])


def test_nulls_copies_and_odd_texts(spark):
    rows = [(1, "<p>"), (2, "<p>"), (2, "<p>"), (3, None), (4, ""), (None, "<p>"), (None, "z"), (5, "é\x00\r\n\r\n" * 9), (6, "x" * 300_000), (7, "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(p, None if p == 3 else f"http://a b/{p}", h) for p, h in rows], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "1 payload", "2 digest", "3 origin", "4 shard")
    assert sorted((tuple(r) for r in archive_round_trip(pages).collect()), key=repr) == want(rows)
    assert archive_round_trip(pages.limit(0)).count() == 0


def test_files_are_gzip_and_the_index_finds_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<b>{i}</b>" * i) for i in range(300)], "page_id long, url string, html string")
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    write_monolithic(with_origins(pages), raw, roll=50_000)
    files = [f for f in glob.glob(raw + "/part-*") if os.path.getsize(f)]
    assert len(files) > 3
    for f in files:
        data = open(f, "rb").read()
        z = zlib.decompressobj(31)
        z.decompress(data)
        assert z.eof and not z.unused_data  # one stream
    normalise(spark, raw, out)
    shards = {int(os.path.basename(f).split("-")[1]): open(f, "rb").read() for f in glob.glob(out + "/sidecar=0/part-*")}
    seen = set()
    for r in read_index(spark, out).collect():
        rec = gzip.decompress(shards[r.shard][r.offset : r.offset + r.length])
        seen.add(parse(rec)[0])
        assert r.record_id == f"<urn:page:{parse(rec)[0]}>"
    assert seen == set(range(300)) and read_records(spark, out).count() == 300
    wanted = spark.createDataFrame([("<urn:page:7>",), ("<urn:page:250>",), ("<urn:page:250>",), ("<urn:page:999>",)], "record_id string")
    assert sorted(r.page_id for r in fetch(spark, out, wanted).collect()) == [7, 250]
    os.remove(sorted(glob.glob(out + "/sidecar=1/part-*"))[0])
    with pytest.raises(Exception, match="don't agree"):
        read_records(spark, out).collect()


def test_files_of_few_records_lose_nothing(spark):
    """However the session splits files, a shard's members stay in one."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<b>{i % 40}</b>") for i in range(50)], "page_id long, url string, html string")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "10")
    try:
        got = archive_round_trip(pages).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted((tuple(r) for r in got), key=repr) == want([(r.page_id, r.html) for r in pages.collect()])


def test_large_members_and_pieces():
    big = record(1, "u", b"a" * (17 << 20), None)
    assert deflate(big).endswith(EMPTY_MEMBER) and gzip.decompress(deflate(big)) == big
    stream = b"".join(record(i, "u", b"\r\n\r\n" * i, None) for i in range(50))
    assert [parse(r)[0] for r in split_records(inflate(gzip.compress(stream)))] == list(range(50))
    assert [parse(r)[0] for r in split_records((0, stream[k : k + 7]) for k in range(0, len(stream), 7))] == list(range(50))
