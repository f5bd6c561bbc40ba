"""Operator 7: exact round trip."""

import base64
import gzip
import hashlib
from collections import Counter

import pytest

from posekeel.llm import warc as module
from posekeel.llm.warc import parse_records, read_archives, warc_roundtrip


def brute(rows, min_bytes):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    first, out = {}, []
    for i in order:
        page, url, html = rows[i]
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = len(payload) >= min_bytes and payload in first
        out.append((page, len(payload), digest, "revisit" if revisit else "response", first[payload] if revisit else None))
        first.setdefault(payload, page)
    return out


@pytest.mark.parametrize("min_bytes", [0, 6])
def test_round_trip(spark, tmp_path, min_bytes):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\nb\x00é"
    rows = [(5, "http://x/", "<p>é</p>"), (2, "http://y/", "<p>é</p>"), (9, None, None), (7, "u\r\nX: y", ""), (1, "z", tricky), (3, "z", tricky), (None, "q", tricky), (None, "q", "same"), (None, "q", "same")]
    rows += [(2, "http://y/", "<p>é</p>"), (11, "big", "<p>" + "x" * 300000)] + [(100 + i, "h", "copy" + str(i % 3) * 5) for i in range(40)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    got = warc_roundtrip(frame, min_bytes=min_bytes, raw_path=raw, path=out)
    assert Counter(tuple(r)[:1] + tuple(r)[2:] for r in got.collect()) == Counter(brute(rows, min_bytes))
    back = read_archives(spark, raw, payload=True).collect()
    assert Counter(bytes(r.payload).decode() for r in back) == Counter(r[2] or "" for r in rows)
    ids = [r.record_id for r in read_archives(spark, out).collect()]
    assert len(set(ids)) == len(rows) and not set(ids) & {r.record_id for r in back}


def test_large_payloads_go_to_files_of_few_records(spark, tmp_path):
    pages = spark.range(40).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), CASE WHEN id % 2 = 0 THEN 200000 ELSE 5 END) AS html").repartition(1)
    warc_roundtrip(pages, raw_path=str(tmp_path / "raw"), path=str(tmp_path / "out"))
    for folder in ("raw", "out"):
        sizes = [len(list(parse_records(p.read_bytes()))) for p in (tmp_path / folder).glob("*.gz")]
        assert sum(sizes) == 40 and sorted(n for n in sizes if n)[-1] == 25 and max(sorted(sizes)[:-1]) <= module.LARGE_FILE_RECORDS


def test_archives_of_many_members_in_small_pieces(monkeypatch):
    records = [f"WARC/1.1\r\nX: {i}\r\nContent-Length: {3 * i}\r\n\r\n{'a\r\n' * i}\r\n\r\n".encode() for i in range(20)]
    monkeypatch.setattr(module, "PIECE", 7)
    for data in (b"".join(records), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records))):
        got = list(parse_records(data))
        assert [(f["x"], b) for f, b in got] == [(str(i), b"a\r\n" * i) for i in range(20)]


def test_cut_archive_is_refused():
    with pytest.raises(ValueError):
        list(parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_empty(spark):
    assert warc_roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
