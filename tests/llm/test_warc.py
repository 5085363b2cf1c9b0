import io
import random
import zipfile

import pytest

from rasterloom.llm import warc as W


def test_zip_forms(tmp_path):
    """ZIP64, a comment, bytes before the archive, and a file read by ranges."""
    for zip64 in (False, True):
        sink = io.BytesIO()
        out = W.ArchiveWriter(sink, zip64)
        for i in range(5):
            out.add(W.record(i, f"http://x/{i}", b"p\r\n\r\n" * i, W.digest_of(b"p\r\n\r\n" * i), 5 * i, None), "n")
        out.close()
        data = sink.getvalue()
        for form in (data, b"stub" * 9 + data):
            got = list(W.read_archive(W.BytesSource(form)))
            assert [p for _, p in got] == [b"p\r\n\r\n" * i for i in range(5)]
        (tmp_path / "a.zip").write_bytes(data)
        assert len(list(W.read_archive(W.FileSource(f"file://{tmp_path}/a.zip")))) == 5
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for i in range(66_000):  # more entries than 16 bits hold
            z.writestr(str(i), b"")
        z.writestr("é", b"stored text")
        z.comment = b"PK\5\6 comment"
    r = W.ZipReader(W.BytesSource(many.getvalue()))
    assert len(r.members) == 66_001 and r.read("é", 7, 4) == b"text"


def test_refusals():
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 1000)
    r = W.ZipReader(W.BytesSource(packed.getvalue()))
    with pytest.raises(W.ArchiveError):
        r.read("a")
    with pytest.raises(W.ArchiveError):
        W.ZipReader(W.BytesSource(b"no archive"))


def test_round_trip(spark, tmp_path):
    r = random.Random(1)
    html = [f"<p>é{i}\r\n\r\n{'x' * r.randint(0, 3000)}" for i in range(40)] + [None, ""]
    rows = [(i, f"http://h/{i}", r.choice(html), "z") for i in range(300)] + [(None, None, "<p>none", "z"), (None, None, "<p>none", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, REFERS_TO string").repartition(7)
    archives = W.write_archives(df, size=3000)
    assert archives.count() > 7 and archives.agg({"records": "sum"}).first()[0] == len(rows)
    files = [r["archive"] for r in archives.collect()]
    with zipfile.ZipFile(files[0].removeprefix("file://")) as z:
        assert z.namelist() == [W.DATA, W.INDEX] and z.testzip() is None
    assert W.read_archives(W.archives_in(spark, files[0].rpartition("/")[0])).count() == len(rows)
    got = W.read_archives(archives).collect()
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        other = i is not None and first[h or ""] != i
        want.append((i, len(p), W.digest_of(p), "revisit" if other else "response", first[h or ""] if other else None))
    key = lambda x: tuple(str(y) for y in x)
    assert sorted(map(key, want)) == sorted(key(x[:5]) for x in got)
    assert all(x["url"] == (f"http://h/{x['page_id']}" if x["page_id"] is not None else None) for x in got)
    small = W.with_references(df, least=1).filter("coalesce(html, '') = '' and refers_to is not null")
    assert small.count() == 0
    assert W.read_archives(W.write_archives(df.limit(0))).count() == 0


def test_hot_and_long_payloads(spark):
    """A third of all pages with one payload, and a payload of 3 MB."""
    rows = [(i, "u", f"<p>{i}") for i in range(200)] + [(1000 + i, "u", "<p>same") for i in range(100)] + [(5000, "u", "long é" * 500_000), (5001, "u", "long é" * 500_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = {r["page_id"]: r for r in W.read_archives(W.write_archives(df)).collect()}
    assert len(got) == len(rows) and all(got[i]["refers_to"] is None for i in range(200))
    assert [got[1000 + i]["refers_to"] for i in range(100)] == [None] + [1000] * 99
    assert got[5000]["payload_bytes"] == 3_500_000 and got[5001]["refers_to"] == 5000
