import hashlib
import struct

import zstandard

from tilespan.llm import warc

BIG = "<p>ñ " + "text " * 400


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a", BIG), (2, "http://b", BIG), (9, "http://c\r\nX", BIG), (3, None, None), (4, "u", "small"), (5, "u", "small"), (6, "u", ""), (7, "x", "\r\n\r\nWARC/1.1" + BIG * 200), (9, "http://c", BIG), (2, "http://b", BIG), (None, "n", BIG), (8, "m", BIG + "!")]
    pages = spark.createDataFrame([(*r, "response", 0) for r in rows], "page_id long, url string, html string, record_type string, first int")
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == body and r[0] is not None]
        first = max(same)
        again = len(body) >= 1000 and page != first
        want.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(repr, (tuple(r) for r in warc.round_trip(pages).collect()))) == sorted(map(repr, want))
    at = str(tmp_path / "w")
    warc.write(pages, at, archive_bytes=3000)
    full = warc.read(spark, at).where("record_type = 'response'").collect()
    assert sorted(bytes(r.payload) for r in full) == sorted((r[2] or "").encode() for r, w in zip(rows, want, strict=True) if w[3] == "response")


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0


def test_frames():
    records = [warc.record(i, "http://x", (f"page {i} " * 300).encode(), "d", "response", None) for i in range(50)]
    data = warc.archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and size > 0
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert alone.decompress(data[8 + size :]) == records[0] and alone.unused_data
    assert [b for _, b in warc.records(data)] == [r.partition(b"\r\n\r\n")[2][:-4] for r in records]
