import base64
import hashlib
import heapq
import random

import pytest

from quarry.llm import registry, warc

SF = "/root/testdata/sf0.001"


def check(rows, pages, least=0):
    assert len(rows) == len(pages)
    payload = lambda h: (h or "").encode()
    want = []
    for i, _, h in pages:
        raw = payload(h)
        same = [j for j, _, g in pages if payload(g) == raw and j is not None] if len(raw) >= least else []
        to = min(same) if same and i != min(same) else None
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if to is not None else "response", to))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows)
    assert all(r.intact for r in rows)
    keys = [(r.url_key, r.timestamp) for r in sorted(rows, key=lambda r: (r.range, r.position))]
    assert keys == sorted(keys)


def test_query(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    check(registry.QUERIES["op3_warc"](spark, SF).collect(), pages)


PAGES = [(1, "http://www.A.com/x#f", "<p>é</p>"), (2, "https://a.com/x", "<p>é</p>"), (None, None, None), (4, "http://b.org:8080/?q=1", ""), (5, "http://[bad", "y" * 500_000), (2, "https://a.com/x", "<p>é</p>"), (7, "http://a.com/é \r\n", "a\r\n\r\nWARC/1.1\r\n\r\n"), (8, "", None)]


@pytest.mark.parametrize("least", [0, 5])
def test_edge_rows(spark, least):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, file string").repartition(3)
    check(warc.capture_histories(df, dedup_from_bytes=least).collect(), PAGES, least)


def test_empty(spark):
    assert warc.capture_histories(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_many_runs_and_ranges(spark, monkeypatch):
    df = spark.range(400).selectExpr("id AS page_id", "concat('http://h', id % 7, '.org/', id % 31) AS url", "concat('p', id % 150) AS html").repartition(6)
    index = warc.write_archives(df)
    rows = warc.merge_index(index, rows_each=90).collect()
    keys = [(r.url_key, r.timestamp, r.record_id) for r in sorted(rows, key=lambda r: (r.range, r.position))]
    assert keys == sorted(keys) and len(keys) == 400 and len({r.range for r in rows}) > 2 and len({r.file for r in rows}) == 6


def test_captures_follow_over_ranges(spark):
    df = spark.range(300).selectExpr("id AS page_id", "concat('http://h.org/', CASE WHEN id % 3 = 0 THEN id % 5 ELSE 9 END) AS url", "concat('p', id) AS html").repartition(3)
    rows = sorted(warc.merge_index(warc.write_archives(df), rows_each=40).collect(), key=lambda r: (r.range, r.position))
    want = [a.timestamp if a is not None and a.url_key == b.url_key else None for a, b in zip([None, *rows], rows)]
    assert [r.capture_after for r in rows] == want and len({r.range for r in rows}) > 4
    assert any(r.position == 0 and r.capture_after for r in rows)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(9), r, i) for i in range(rng.randrange(6))) for r in range(k)]
    assert list(warc.loser_tree(runs)) == list(heapq.merge(*runs))


def test_url_key():
    assert [warc.url_key(x) for x in ("http://www.Ex.com/A?b=1#c", "https://m.ex.com", None)] == ["com,ex)/a?b=1", "com,ex,m)/", ""]
