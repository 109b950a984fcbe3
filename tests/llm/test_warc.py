import base64
import hashlib

import pytest
import zstandard

from docweft.llm import warc as A

SCHEMA = "page_id long, url string, html string, record_type string, sha int, size int, first int"


def rows(spark, data):
    return spark.createDataFrame([(*x, "z", 1, 2, 3) for x in data], SCHEMA)


def test_round_trip(spark):
    data = [
        (5, "http://a/", "<p>one</p>"), (2, None, "<p>one</p>"), (9, "http://b/\nc", None), (3, "u", ""), (7, "é", "日本" * 90_000), (8, "u", "<p>two</p>"),
        (None, "u", "<p>one</p>"), (4, "u", "line\r\n\r\nWARC/1.1\r\n\r\n"), (11, "u", "<p>same id</p>"), (11, "u", "<p>same id</p>"),
    ]
    listed = A.write_archives(rows(spark, data).repartition(3), file_bytes=2000)
    assert listed.count() > 3
    got = A.read_archives(listed).collect()
    assert len(got) == len(data) and all(r["problem"] is None for r in got)
    smallest = {}
    for p, _, h in data:
        if p is not None:
            smallest[h or ""] = min(p, smallest.get(h or "", p))
    seen = {}
    for r in got:
        seen.setdefault(r["record_id"], []).append(r)
    for p, u, h in data:
        body = (h or "").encode()
        for r in seen[A.page_urn(p)]:
            assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
            first = smallest.get(h or "") if p is None or smallest[h or ""] != p else None
            assert (r["record_type"], r["refers_to"]) == (("response", None) if first is None else ("revisit", A.page_urn(first)))
            assert r["payload"] == (body if first is None else None)
            assert r["target_uri"] == (" ".join(u.split()) if u else A.page_urn(p))


def test_least(spark):
    listed = A.write_archives(rows(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), least=3)
    got = {r["record_id"]: r["record_type"] for r in A.read_archives(listed, content=False).collect()}
    assert got == {"urn:page:1": "response", "urn:page:2": "response", "urn:page:3": "response", "urn:page:4": "revisit"}


def test_dictionary_frame(spark, tmp_path):
    data = [(n, f"http://host/{n}", f"<html><head><title>Page {n}</title></head><body>" + f"<p>Paragraph {n * 7919 % 1000}</p>" * 8) for n in range(400)]
    listed = A.write_archives(rows(spark, data).coalesce(1), folder=f"file://{tmp_path}/out")
    (path,) = [r["path"] for r in listed.collect()]
    raw = open(path.removeprefix("file://"), "rb").read()
    assert int.from_bytes(raw[:4], "little") == A.SKIPPABLE
    assert len(list(A.frames(path))) == len(data)
    # one frame, from its offset alone, with the dictionary
    size = int.from_bytes(raw[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
    at, content = list(A.frames(path))[200]
    one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    assert one.decompress(raw[at:]) == content


@pytest.mark.parametrize(
    ("old", "new", "said"),
    [
        (b"WARC/1.1", b"WARC/9.9", "no WARC"), (b"WARC-Date", b"WARC-Dote", "missing WARC-Date"), (b"<p>one", b"<p>oneX", "Content-Length"),
        (b"<p>one", b"<p>onf", "block digest"), (b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: 9", "Content-Length"),
    ],
)
def test_faults(spark, tmp_path, old, new, said):
    data = A.record(1, "u", "<p>one</p>", None)
    assert A.parsed(data)["payload"] == b"<p>one</p>"
    path = str(tmp_path / "bad.warc.zst")
    pack = zstandard.ZstdCompressor()
    open(path, "wb").write(pack.compress(data) + pack.compress(data.replace(old, new, 1)))
    listed = spark.createDataFrame([(path,)], "path string")
    told = [r["problem"] for r in A.read_archives(listed, strict=False).collect()]
    assert told[0] is None and said in told[1]
    with pytest.raises(Exception, match="frame at"):
        A.read_archives(listed).collect()
    open(path, "wb").write(pack.compress(data)[:-3])
    with pytest.raises(Exception, match="cut off"):
        A.read_archives(listed).collect()


def test_empty(spark):
    listed = A.write_archives(rows(spark, []))
    assert listed.count() == 0 and A.read_archives(listed).collect() == []


def test_raw_bytes(spark, tmp_path):
    """What lies on disk, read with the Zstandard library alone: the dictionary first, then one frame for each record."""
    data = [(n, f"http://host/{n}", f"<html><head><title>Page {n}</title></head><body>" + f"<p>Paragraph {n * 7919 % 1000}</p>" * 8) for n in range(400)]
    listed = A.write_archives(rows(spark, data).coalesce(1), folder=f"file://{tmp_path}/out").collect()
    raw = open(listed[0]["path"].removeprefix("file://"), "rb").read()
    assert len(listed) == 1 and listed[0]["bytes"] == len(raw)
    assert raw[:4] == bytes.fromhex("5d2a4d18")
    at = 8 + int.from_bytes(raw[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8:at]))
    offsets, seen = [], []
    while at < len(raw):
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        offsets.append(at)
        seen.append(one.decompress(raw[at:]))
        assert one.eof
        at = len(raw) - len(one.unused_data)
    assert sorted(seen) == sorted(A.record(*x, None) for x in data)
    read = A.read_archives(spark.createDataFrame(listed)).collect()
    assert sorted(r["frame_offset"] for r in read) == offsets


def test_reading_is_dealt(spark):
    """As many reading tasks as files, however small the list is."""
    data = [(n, f"http://host/{n}", f"<p>{n}</p>" * 50) for n in range(60)]
    listed = A.write_archives(rows(spark, data).repartition(6), file_bytes=600)
    assert listed.count() >= 10
    assert A.read_archives(listed).rdd.getNumPartitions() == listed.count()


def test_all_broken(spark, tmp_path):
    """A file of broken records only: each is told, with its place."""
    path = str(tmp_path / "bad.warc.zst")
    frame = zstandard.ZstdCompressor().compress(b"nothing")
    open(path, "wb").write(frame * 3)
    got = A.read_archives(spark.createDataFrame([(path,)], "path string"), strict=False).collect()
    assert [r["frame_offset"] for r in got] == [0, len(frame), 2 * len(frame)]
    assert all(r["problem"] == "no WARC/1.1 record" and r["refers_to"] is None and r["payload_bytes"] is None for r in got)
