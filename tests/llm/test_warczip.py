import io
import zipfile

import pytest

from siltstone.llm.warczip import ZipReader, ZipWriter, digest32, parse_record, read_packages, record, write_packages


def reader(raw):
    return ZipReader(lambda n, at: raw[at : at + n], len(raw))


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_against_the_standard_library(zip64):
    out = io.BytesIO()
    w = ZipWriter(out, zip64)
    data = {f"archive/{k}": bytes([k]) * k for k in range(20)}
    for name, x in data.items():
        w.member(name, x)
    w.close()
    raw = out.getvalue()
    assert len(raw) == w.at
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == data
    r = reader(raw)
    assert {n: r.read(n) for n in r.members} == data


def test_reads_other_writers_packages():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("indexes/a", "x" * 100)
        z.writestr("packed", "y" * 1000, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"comment PK\x05\x06 inside"
    r = reader(out.getvalue())
    assert r.read("indexes/a") == b"x" * 100
    with pytest.raises(ValueError):
        r.read("packed")
    with pytest.raises(ValueError):
        reader(b"no zip at all")


def test_records():
    x = parse_record(record(5, "http://a/\r\nb", b"pay\r\n\r\nload", digest32(b"pay\r\n\r\nload"), None))
    assert x["payload"] == b"pay\r\n\r\nload" and x["record_type"] == "response" and x["url"] == "http://a/%0D%0Ab"
    y = parse_record(record(None, None, b"abc", digest32(b"abc"), 9))
    assert (y["page_id"], y["url"], y["payload"], y["refers_to"], y["payload_bytes"]) == (None, None, None, 9, 3)
    with pytest.raises(ValueError):
        parse_record(record(1, None, b"abc", digest32(b"abd"), None))


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(spark, tmp_path, least):
    rows = [(1, "u1", "aaa"), (2, "u2", "aaa"), (2, "u2", "aaa"), (3, None, None), (4, "u4", ""), (5, "u5", "é" * 5000), (6, "u6", "b"), (7, "u7", "b"), (None, "n", "aaa"), (None, "n", "only"), (None, "n", "only")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    uri = f"file://{tmp_path}/w"
    packages = write_packages(df, uri, min_revisit_bytes=least, member_bytes=200, zip64=least == 3)
    got = read_packages(spark, packages, uri).collect()
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least:
            last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, u, h in rows:
        p = (h or "").encode()
        top = last.get(h or "", -1)
        revisit = len(p) >= least and top >= 0 and top != i
        want.append((-1 if i is None else i, u or "", "revisit" if revisit else "response", len(p), digest32(p), top if revisit else -1, b"" if revisit else p))
    assert sorted((-1 if r.page_id is None else r.page_id, r.url or "", r.record_type, r.payload_bytes, r.payload_digest, -1 if r.refers_to is None else r.refers_to, bytes(r.payload or b"")) for r in got) == sorted(want)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    uri = f"file://{tmp_path}/w"
    assert read_packages(spark, write_packages(df, uri), uri).collect() == []


def test_hot_and_very_long_payloads(spark, tmp_path, monkeypatch):
    """One payload on most rows, one of several megabytes: one response for each payload, all bytes back."""
    from siltstone.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 7)
    long = "<p>" + "é x" * 2_000_000 + "</p>"
    rows = [(k, f"http://x/{k}", "same" if k % 4 else None if k % 8 else "") for k in range(200)] + [(500, "http://l", long), (501, "http://m", long), (502, None, "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    packages = write_packages(pages, f"file://{tmp_path}/w")
    got = {r.page_id: r for r in read_packages(spark, packages, f"file://{tmp_path}/w").collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), i)
    for i, _, html in rows:
        text = html or ""
        first = last[text] == i
        assert got[i].record_type == ("response" if first else "revisit") and got[i].refers_to == (None if first else last[text])
        assert got[i].payload_bytes == len(text.encode()) and (bytes(got[i].payload) == text.encode() if first else got[i].payload is None)
