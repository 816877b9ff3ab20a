"""Web archives: round trips, segments, chunks, revisits and broken records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pytest

pytest.importorskip("turnwise.llm.entry")

from pyspark.sql import functions as F  # noqa: E402

from turnwise.llm import web_archive as W  # noqa: E402

LONG = "<p>" + "äx" * 90_000


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2 x\r\ny", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", LONG), (6, "http://a/6", LONG), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n0\r\n\r\n" * 50)]
    rows += [(None, "n", "only here"), (None, "n", "only here"), (None, "n", "same"), (8, "u", "漢字😀\x00\r\n\r\n"), (9, "u", LONG[:-1]), (9, "u", LONG[:-1])]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("payload", "key", "first", "part", "number", "complete")})


def facts(pages, least=0):
    """What comes back, page by page."""
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    out = []
    for i, payload in rows:
        same = [j for j, p in rows if p == payload and j is not None]
        first = min(same) if same and len(payload) >= least else None
        revisit = first is not None and i != first
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_pages_come_back(spark, pages, tmp_path):
    assert sorted(map(tuple, W.archive_digest(pages.repartition(3)).collect()), key=str) == facts(pages)
    assert W.archive_digest(pages.limit(0)).count() == 0
    folder = str(tmp_path / "archives")
    W.write_archives(pages, folder, segment_bytes=50_000, chunk_bytes=999, least_bytes=10, records_per_file=3)
    back = W.read_archives(spark, folder, keep_payload=True)
    assert back.filter("not complete").count() == 0
    html = sorted((r.page_id is None, r.page_id or 0, (r.html or "").encode()) for r in pages.collect())
    assert sorted((r.item_id is None, r.item_id or 0, bytes(r.payload)) for r in back.collect()) == html
    got = back.select("item_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == facts(pages, 10)
    assert {r.url for r in back.filter("item_id = 2").collect()} == {"http://a/2", "http://a/2%20x%0D%0Ay"}


def test_chunks_and_records():
    rng = random.Random(2)
    for _ in range(200):
        body = bytes(rng.randrange(256) for _ in range(rng.randrange(60))) + rng.choice([b"", b"\r\n0\r\n\r\n"])
        assert W.unchunked(W.chunked(body, rng.randint(1, 20))) == body
    assert W.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"zz\r\nabc\r\n0\r\n\r\n", b""):
        with pytest.raises(ValueError):
            W.unchunked(broken)
    assert W.http_payload(b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc") == b"abc"
    records = [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX-Folded: a\r\n b\r\nContent-Length: 4\r\n\r\nWARC", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n"]
    for content in (b"\r\n\r\n".join([*records, b""]), b"".join(gzip.compress(r + b"\r\n\r\n") for r in records)):
        got = list(W.parse_records(content))
        assert [b for _, b in got] == [b"WARC", b""] and got[0][0]["x-folded"] == "a b"
    with pytest.raises(ValueError):
        list(W.parse_records(b"no archive"))


def archive(folder, *records):
    folder.mkdir()
    (folder / "x.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in records))
    return str(folder)


def test_broken_segments_are_told(spark, tmp_path):
    payload = b"some words " * 40
    first, *more = list(W.page_records(1, "u", payload, None, "2000-01-01T00:00:00Z", 200, 64))
    revisit = next(W.page_records(2, "u", payload, 1, "2000-01-01T00:00:00Z", 10_000, 64))
    assert len(more) >= 2
    longer = more[-1].replace(b"Total-Length: ", b"Total-Length: 1")
    broken = {"gap": [first, *more[1:]], "no end": [first, *more[:-1]], "length": [first, *more[:-1], longer], "no head": more}
    for name, records in broken.items():
        got = {r.item_id: r for r in W.read_archives(spark, archive(tmp_path / name, *records, revisit)).collect()}
        assert (name == "no head") == (1 not in got)
        assert all(not r.complete and r.payload_bytes is None for r in got.values()), name
        assert got[2].payload_digest == W.payload_digest(payload)
    mixed = [*reversed(more), revisit, more[0], first, revisit]
    got = W.read_archives(spark, archive(tmp_path / "mixed", *mixed)).collect()
    assert sorted((r.item_id, r.complete, r.payload_bytes, r.refers_to) for r in got) == [(1, True, len(payload), None), (2, True, len(payload), 1), (2, True, len(payload), 1)]
    cut = archive(tmp_path / "cut", revisit, next(W.page_records(3, "u", b"abc", None, "2000-01-01T00:00:00Z", 10_000, 64))[:-12])
    assert {(r.item_id, r.complete) for r in W.read_archives(spark, cut).collect()} == {(2, False), (3, False)}
