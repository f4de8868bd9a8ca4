import gzip
import hashlib
import io
import json
import zlib

import pandas as pd
import pytest

from framesift.llm import warc

SCHEMA = "page_id long, url string, html string, payload string"
BIG = "<p>ü</p>" * 300


def brute(rows):
    payloads = {i: (h or "").encode() for i, _, h, *_ in rows}
    out = {}
    for i, p in payloads.items():
        latest = max(j for j, q in payloads.items() if q == p)
        again = len(p) >= 1000 and latest != i
        out[i] = (len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", latest if again else None)
    return out


ROWS = [
    (1, "http://a/%0A", BIG, None),
    (2, "http://b\r\nX-Page-Id: 9", BIG, "x"),
    (3, None, BIG + "!", None),
    (4, "http://d", None, None),
    (5, "http://e", "", None),
    (6, "http://f", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3\r\n\r\n", None),
    (7, "http://g", "short", None),
    (8, "http://h", "short", None),
    (9, "http://i", "a" * 999, None),
    (10, "http://j", "a" * 999, None),
    (11, "http://k", "z" * 3_000_000, None),
    *((i, f"http://copies/{i}", "copy " * 400, None) for i in range(20, 60)),
]


def test_round_trip(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = warc.archived_pages(frame, folder=f"file://{tmp_path}/w").collect()
    assert len(got) == len(ROWS)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute(ROWS)
    html = {i: (h or "").encode() for i, _, h, _ in ROWS}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response")
    assert {r.page_id: r.url for r in got} == {i: u for i, u, *_ in ROWS}
    for r in got[:20]:
        fields, block = warc.read_member(r.path, r.offset, r.length)
        assert fields["x-page-id"] == str(r.page_id) and fields["warc-type"] == r.record_type
    files = sorted(tmp_path.glob("w/records/*.warc.gz"))
    assert files and not (tmp_path / "w/whole").exists()
    for file in files:  # members end to end, as the index says, and a valid file as a whole
        data, index = file.read_bytes(), [json.loads(x) for x in open(f"{file}.idx")]
        assert sum(e["length"] for e in index) == len(data)
        whole = gzip.decompress(data)
        assert whole == b"".join(zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31) for e in index)


def test_whole_file_stream_is_one_member(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    made = warc.write_archives(warc.page_records(frame), f"file://{tmp_path}/w", archive_bytes=4000).collect()
    assert len(made) > 3 and sum(r.n_records for r in made) == len(ROWS)
    for r in made:
        unpacker = zlib.decompressobj(31)
        data = unpacker.decompress(open(r.path.removeprefix("file://"), "rb").read())
        assert unpacker.eof and not unpacker.unused_data and len(data) == r.n_bytes


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_streams(chunk):
    records = [warc.build_record(i, str(i), None, b"x" * i, None, None) for i in range(5)]
    packed = gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:]))
    assert [r for _, r in warc.split_records(warc.inflate(io.BytesIO(packed), chunk))] == records
    with pytest.raises(ValueError):
        list(warc.split_records(warc.inflate(io.BytesIO(packed[:-30]), chunk)))
    with pytest.raises(ValueError):
        list(warc.split_records(iter([b"not a record\r\n\r\n"])))


def test_odd_ids_and_empty_table(spark):
    rows = [(None, None, BIG, None), (None, "u", BIG, None), (4, "u", BIG, None), (4, "v", "s", None)]
    got = warc.archived_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [
        ("4", "response", None), ("4", "response", None), ("None", "revisit", 4), ("None", "revisit", 4),
    ]
    assert warc.archived_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark, sf):
    from framesift.llm.queries import op2_warc

    pages = pd.read_parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op2_warc(spark, sf).collect()}
    assert got == brute(list(zip(pages.page_id, pages.url, pages.html)))
