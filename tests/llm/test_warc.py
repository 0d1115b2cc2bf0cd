import gzip
import hashlib
import io

import pytest

from meterlake.llm import warc

BIG = "<p>" + "é text " * 400
ROWS = [(1, "http://a/1", BIG), (7, "http://a/7", BIG), (3, None, BIG), (4, "http://b/\r\nX: y", "short"), (5, "u", "short"), (6, "u", None), (8, "u", ""), (None, "n", BIG), (9, "c", BIG + "x"), (9, "c", BIG + "x"), (10, "d", BIG + "x")]


def brute(rows):
    of = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for p, b in of:
        same = [q for q, c in of if c == b and q is not None]
        first = max(same) if len(b) >= 1000 and sum(c == b for _, c in of) > 1 else None
        revisit = first is not None and p != first
        out.append((repr(p), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture()
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")


def test_round_trip(pages, tmp_path):
    got = warc.archived_pages(pages(ROWS), str(tmp_path / "a")).collect()
    assert sorted(((repr(g.page_id), *g[1:]) for g in got), key=repr) == brute(ROWS)
    assert warc.archived_pages(pages([]), str(tmp_path / "b")).collect() == []


def test_files_are_standard_gzip(spark, pages, tmp_path):
    warc.archived_pages(pages(ROWS[:6]), str(tmp_path))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in tmp_path.glob("*.warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == 6 and BIG.encode() in text
    assert b"WARC-Target-URI: http://b/%0D%0AX: y\r\n" in text


def test_filters_are_taken_over(spark, pages, tmp_path, monkeypatch):
    warc.register(spark)
    warc.archived_pages(pages(ROWS), str(tmp_path))
    read = spark.read.format("warc").option("taskBytes", 1).load(str(tmp_path))
    one = read.where("record_type = 'revisit' and page_id = 3")
    assert [(r.page_id, r.refers_to, r.payload) for r in one.collect()] == [(3, 7, None)]
    assert {r.page_id for r in read.where("page_id in (4, 5) and payload_bytes > 1").collect()} == {4, 5}
    reader = warc.WarcReader(str(tmp_path), {})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "response")])) == []


def record(i, payload=b"x" * 9000, kind="response"):
    return warc.record_bytes({"record_type": kind, "record_id": f"<r{i}>", "target_uri": None, "page_id": i, "refers_to": None, "payload_digest": "ab" * 20, "payload_bytes": len(payload), "payload": payload})


def test_unwanted_payloads_are_passed_over():
    import os

    data = b"".join(warc.gzip_member(record(i, os.urandom(50_000))) for i in range(20))

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.taken += len(out)
            return out

    got = list(warc.read_members(Counting(data), lambda f: f["page_id"] == 11))
    assert [g["page_id"] for g in got] == [11] and got[0]["payload_bytes"] == 50_000
    assert Counting.taken < len(data) / 4


def test_foreign_and_broken_members():
    plain = gzip.compress(record(1)) + gzip.compress(record(2))
    assert [r["page_id"] for r in warc.read_members(io.BytesIO(plain), lambda f: True)] == [1, 2]
    assert [r["page_id"] for r in warc.read_members(io.BytesIO(plain), lambda f: f["page_id"] == 2)] == [2]
    for broken in (plain[:-40], b"not gzip at all, but long enough for it", gzip.compress(b"no header")):
        with pytest.raises(ValueError):
            list(warc.read_members(io.BytesIO(broken), lambda f: True))


def test_uncommitted_files_are_not_read(spark, pages, tmp_path):
    first = warc.archived_pages(pages(ROWS[:2]), str(tmp_path))
    (tmp_path / "part-lost.warc.gz").write_bytes(warc.gzip_member(record(99)))
    assert {r.page_id for r in first.collect()} == {1, 7}
