"""Archives with long headers, damaged members of many records, and members larger than a task may hold."""

import pytest
from pyspark.sql import functions as F

from emberline.llm import warc

PAGES = "page_id long, url string, html string"


def record(i, size=800):
    payload = bytes((i * 7919 + k * k * 31) % 251 for k in range(size))
    return warc.page_record(i, f"http://host/{i}", payload, warc.base32_sha1(payload), None)


def ids(found):
    return [h["warc-record-id"] for *_, h, _ in found if h]


def test_a_page_with_a_very_long_url_comes_back(spark):
    rows = [(1, "http://a/" + "é" * (1 << 21), "text"), (2, "http://b/", "other"), (3, "x" * 70_000, None), (4, None, "text")]
    out = warc.archive_pages(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out) == [(1, 4, "revisit", 4), (2, 5, "response", None), (3, 0, "response", None), (4, 4, "response", None)]


@pytest.mark.parametrize("whole", [8 << 20, 1000])
@pytest.mark.parametrize("block", [1 << 20, 900])
def test_records_before_the_damage_of_a_member_come_out(monkeypatch, tmp_path, whole, block):
    import pyarrow as pa

    monkeypatch.setattr(warc, "WHOLE_BYTES", whole)
    monkeypatch.setattr(warc.Bytes, "BLOCK", block)
    recs = [record(i) for i in range(50)]
    packed, after = warc.member(b"".join(recs)), warc.member(record(99))
    names = [f"<urn:page:{i}>" for i in range(50)]

    def read(data):
        (tmp_path / "a.warc.gz").write_bytes(data)
        return list(warc.salvage(warc.Bytes(file=pa.OSFile(str(tmp_path / "a.warc.gz")))))

    got = read(packed + after)
    assert ids(got) == [*names, "<urn:page:99>"] and {(s, e) for s, e, *_ in got} == {(0, len(packed)), (len(packed), len(packed) + len(after))}
    at = len(packed) * 9 // 10
    flipped = bytearray(packed)
    flipped[at] ^= 0x55
    for data, rest in ((packed[:at], b""), (packed[:at], after), (bytes(flipped), b""), (bytes(flipped), after)):
        got = read(data + rest)
        own = [x for x in ids(got) if x != "<urn:page:99>"]
        # all that lie before the damage; after a changed byte also later ones whose digests hold
        assert own[:43] == names[:43] and own == sorted(set(own), key=names.index) and 43 <= len(own) < 50
        assert data != packed[:at] or own == names[: len(own)]
        assert ("<urn:page:99>" in ids(got)) == bool(rest)
        gaps = [(s, e) for s, e, h, _ in got if h is None]
        assert gaps and gaps[-1][1] == len(data) and (data != packed[:at] or len(gaps) == 1)
        assert all(0 <= s < e <= len(data + rest) for s, e, *_ in got)


def test_a_large_member_is_read_record_by_record(monkeypatch):
    monkeypatch.setattr(warc, "WHOLE_BYTES", 10_000)
    recs = [record(i, 3000) for i in range(60)]
    packed, held = warc.member(b"".join(recs)), []
    pull = warc.Inflated._pull

    def watched(self):
        pull(self)
        held.append(len(self.plain))

    monkeypatch.setattr(warc.Inflated, "_pull", watched)
    monkeypatch.setattr(warc.Inflated, "step", 512, raising=False)
    got = list(warc.salvage(warc.Bytes(packed)))
    assert ids(got) == [f"<urn:page:{i}>" for i in range(60)] and [p for *_, p in got] == [r.split(b"\r\n\r\n", 1)[1][:-4] for r in recs]


def test_many_records_that_do_not_end_take_linear_time():
    import time

    began = time.time()
    junk = (b"WARC/1.1\r\nName: " + b"x" * 40) * 20_000
    assert ids(warc.salvage(warc.Bytes(junk + b"\r\n\r\n" + record(1)))) == ["<urn:page:1>"]
    assert time.time() - began < 20


def test_a_lost_record_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}" * 50) for i in range(20)], PAGES).select("page_id", "url", F.encode("html", "UTF-8").alias("payload")).coalesce(1)
    manifest = spark.createDataFrame(warc.write_archives(pages, f"file://{tmp_path}").collect())
    assert warc.read_archives(spark, f"file://{tmp_path}", manifest).filter("kind = 'record'").count() == 20
    (archive,) = tmp_path.glob("*.warc.gz")
    archive.write_bytes(archive.read_bytes()[:-60])
    with pytest.raises(Exception, match="19 of 20 records"):
        warc.read_archives(spark, f"file://{tmp_path}", manifest).collect()
    assert warc.read_archives(spark, f"file://{tmp_path}").filter("kind = 'record'").count() == 19
