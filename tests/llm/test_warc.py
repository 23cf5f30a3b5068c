import gzip
import hashlib
import random

import pytest

from ruleloom.llm.queries import op9_warc_index_merge, table
from ruleloom.llm.shared import written
from ruleloom.llm.warc import archive_pages, capture_order, index_archives, loser_tree, merge_runs, parse_record, read_member, read_records, url_key, write_archives

PAGES = "page_id long, url string, html string, offset string, run int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


def brute(rows):
    largest = {}
    for i, _, html in rows:
        largest[html or ""] = max(i, largest.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and largest[html or ""] != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", largest[html or ""] if again else None))
    return sorted(out)


def found(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_whole_table(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in table(spark, sf, "pages").collect()]
    assert found(op9_warc_index_merge(spark, sf)) == brute(rows)


def test_copies_nulls_terminators_and_order(spark):
    long = "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>" * 60
    rows = [(1, "http://b.example.com/x", long), (2, "https://a.example.com:80/", long), (3, None, None), (4, "http://a.example.com/\nq", ""), (2**55 + 1, "http://b.example.com/x", long), (6, "http://[bad", "x" * 999), (7, "http://b.example.com/x", "x" * 999)]
    df = archive_pages(pages(spark, rows))
    assert found(df) == brute(rows)
    got = df.orderBy("history_rank").collect()
    assert [(r.url_key, r.captured, r.page_id) for r in got] == sorted((r.url_key, r.captured, r.page_id) for r in got)
    assert [r.history_rank for r in got] == list(range(1, len(rows) + 1))
    # the index's offsets lead to the records themselves
    for r in got:
        with open(r.archive.removeprefix("file:"), "rb") as f:
            headers, block = parse_record(read_member(memoryview(f.read()), r.offset)[0])
        assert headers["warc-record-id"] == f"<urn:page:{r.page_id}>" and headers["warc-type"] == r.record_type
        payload = dict((i, h) for i, _, h in rows)[r.page_id] or ""
        assert block.partition(b"\r\n\r\n")[2] == (b"" if r.record_type == "revisit" else payload.encode())


def test_archives_are_plain_gzip_and_ranges_are_bounded(spark, tmp_path):
    rows = [(k, f"http://h{k % 3}.example.com/{k % 7}", f"page {k} " * (k % 50)) for k in range(300)]
    df = pages(spark, rows).repartition(5)
    write_archives(df, str(tmp_path / "w"), per_file=40)
    runs = written(index_archives(spark, str(tmp_path / "w")), "runs")
    files = sorted(tmp_path.glob("w/part-*"))
    assert len(files) >= 8
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Type: ") for f in files) == 300
    want = sorted((url_key(u), i) for i, u, _ in rows)
    for range_rows in (30, 10**6):
        got = merge_runs(runs, range_rows).orderBy("history_rank").collect()
        assert [r.history_rank for r in got] == list(range(1, 301))
        assert [r.url_key for r in got] == [k for k, _ in want]
        assert [(r.url_key, r.captured) for r in got] == sorted((r.url_key, r.captured) for r in got)


def test_repeated_rows_null_id_and_empty_table(spark):
    long = "y" * 1500
    got = found(archive_pages(pages(spark, [(5, "http://a.com/", long), (5, "http://a.com/", long), (4, "http://a.com/", long)])))
    assert [g[3:] for g in got] == [("revisit", 5), ("response", None), ("response", None)]
    assert archive_pages(pages(spark, [])).collect() == []
    assert [r.page_id for r in archive_pages(pages(spark, [(None, "http://a.com/", "short")])).collect()] == [None]


@pytest.mark.parametrize("seed", range(40))
def test_loser_tree(seed):
    rng = random.Random(seed)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(12))]
    assert list(loser_tree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_keys_and_bad_archives():
    assert url_key("https://M.Example.net:443/en/2?b=1#top") == "net,example,m)/en/2?b=1"
    assert url_key("urn:page:3") == "urn:page:3"
    with pytest.raises(ValueError):
        list(read_records(b"no archive\r\n\r\n"))
    with pytest.raises(ValueError):
        list(read_records(gzip.compress(b"no archive\r\n\r\n")))
    with pytest.raises(ValueError):
        list(read_records(gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")[:-9]))
    with pytest.raises(ValueError):
        list(read_records(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")))
    assert capture_order(("r", 0, "k", "", "t", None)) > capture_order(("r", 0, "k", "", "t", 5))
