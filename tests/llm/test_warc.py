"""WARC archives: the contract by brute force, an exact round trip, byte ranges, odd input."""

import gzip
import hashlib

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from kembar import runtime
from kembar.llm import warc

LONG = "ä" * 600
ROWS = [
    (1, "http://a/1", LONG, "x"), (2, "http://a/2", LONG, "x"), (3, None, LONG, "y"), (4, "http://a/4", "short", "y"),
    (5, "http://a/5", "short", "y"), (6, "http://a/\r\n6", None, "y"), (None, "http://a/n", LONG, "z"),
    (None, None, None, None), (7, "http://a/7", "b" * 1000, "z"), (8, "http://a/8", "b" * 999, "z"),
    (9, "http://a/9", "b" * 999, "z"), (10, "http://a/10", "\r\n\r\n" * 400 + "WARC/1.1\r\n", "z"),
    (10, "http://a/10b", "\r\n\r\n" * 400 + "WARC/1.1\r\n", "z"), (11, "http://a/11", "c" * 300_000, "z"),
] + [(100 + i, f"http://h/{i}", "hot " * 300, "h") for i in range(40)]
SCHEMA = "page_id bigint, url string, html string, payload_digest string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def plain(rows):
    """What the contract asks for, row by row."""
    best = {}
    for page, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page is not None:
            best[data] = max(best.get(data, page), page)
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        original = best.get(data)
        again = original is not None and page != original
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", original if again else None))
    return sorted(out, key=str)


def result(frame):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=str)


@pytest.mark.parametrize("limit", [runtime.BROADCAST_BYTES, 0])
def test_round_trip(spark, pages, limit):
    folder = warc.archive_folder(spark)
    index = warc.write_archives(warc.with_originals(pages, limit=limit), folder, archive_bytes=2000)
    read = warc.read_records(index, folder).cache()
    assert result(read) == plain(ROWS)
    stored = {r.page_id: r.payload for r in read.where("record_type = 'response' and page_id is not null").collect()}
    assert stored[3].decode() == LONG and stored[6] == b"" and stored[11] == b"c" * 300_000 and 1 not in stored
    assert index.select("archive").distinct().count() > 3
    read.unpersist()


def test_selected_records_only(spark, pages):
    folder = warc.archive_folder(spark)
    index = warc.write_archives(warc.with_originals(pages), folder)
    some = warc.read_records(index.where("page_id in (4, 7, 11)"), folder)
    assert sorted(r.page_id for r in some.collect()) == [4, 7, 11]
    assert warc.read_records(index.where("false"), folder).count() == 0


def test_archives_are_warc_files(spark, pages):
    """Every member by itself, and the file as a whole, is what the standard asks for."""
    folder = warc.archive_folder(spark)
    index = warc.write_archives(warc.with_originals(pages.coalesce(1)), folder).collect()
    store, base = warc._filesystem(folder)
    data = store.open_input_file(f"{base}/{index[0].archive}").read()
    whole = gzip.decompress(data)
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    rest, kinds = whole, []
    while rest:
        head, rest = rest.split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert rest[size:size + 4] == b"\r\n\r\n"
        kinds.append(fields["WARC-Type"])
        rest = rest[size + 4:]
    assert len(kinds) == len(ROWS) + 1 and kinds.count("revisit") == 2 + 1 + 39
    places = sorted((r.offset, r.length) for r in index)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    assert sum(places[-1]) == len(data)


def test_ranges_are_read_together():
    places = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 500, 10), ("b", 510, 10), ("b", 520, 90), ("b", 610, 50)]
    assert warc.requests(places, 5, 100) == [(0, 3), (3, 4), (4, 6), (6, 7)]
    assert warc.requests(places, 1000, 10_000) == [(0, 4), (4, 7)]
    assert warc.requests([("a", 0, 10_000)], 5, 100) == [(0, 1)]
    assert warc.requests([], 5, 100) == []


def test_damage_is_an_error(spark, pages):
    folder = warc.archive_folder(spark)
    index = warc.write_archives(warc.with_originals(pages.where("page_id = 4")), folder)
    with pytest.raises(Exception, match="another payload"):
        warc.read_records(index.withColumn("payload_digest", F.sha1(F.lit("x"))), folder).collect()
    with pytest.raises(ValueError, match="does not end"):
        warc.parse_record(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    folder = warc.archive_folder(spark)
    index = warc.write_archives(warc.with_originals(empty), folder)
    assert index.count() == 0 and warc.read_records(index, folder).count() == 0


def test_stores_by_path():
    assert isinstance(warc._filesystem("file:///tmp/x")[0], pyarrow.fs.LocalFileSystem)
    assert warc._filesystem("file:/tmp/x")[1] == warc._filesystem("file:///tmp/x")[1] == warc._filesystem("/tmp/x")[1] == "/tmp/x"
