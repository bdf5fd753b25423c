"""WARC: round trips against plain Python, transactions in both directions, archives of other writers."""

import gzip
import hashlib
import io
from collections import Counter

import pytest
from pyspark.sql import functions as F

from semblance.llm import warc

PAGES = "page_id long, url string, html string, content string, digest string, first long"
LONG = "<p>" + "copied text " * 30 + "</p>"
ROWS = [
    (7, "http://a.org/x?y#z", LONG), (3, "http://a.org/2", LONG), (9, "https://b.net/", LONG), (None, None, LONG), (1, "http://c.org/", "short"), (2, "http://c.org/", "short"), (4, None, None),
    (5, "", ""), (6, "no scheme\r\nWARC-Type: evil", "<p>naïve \U0001f600\x00\r\n\r\nWARC/1.1</p>" * 20), (8, "http://d.org/é", "x" * 99), (10, "http://d.org/", "x" * 99), (11, "u", "y" * 100), (12, "u", "y" * 100),
    (20, "u", "z" * 400), (20, "u", "z" * 400), (21, "u", "z" * 400), (None, "u", "q" * 200), (None, "u", "q" * 200), ((1 << 53) + 1, "u", "w" * 300_000),
]


def expected(rows):
    least = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            least[h] = min(i, least.get(h, i))
    out = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = h in least and i != least[h]
        out[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least[h] if again else None] += 1
    return out


@pytest.mark.parametrize("small", [100, 0])
def test_round_trip(spark, small, tmp_path):
    pages = spark.createDataFrame([(*r, "c", "d", 1) for r in ROWS], PAGES).repartition(3)
    archives = warc.archived(pages, archive_bytes=2000, small=small)
    assert archives.count() > 3
    made = warc.captures(warc.records(archives, payload=True))
    fields = F.col("metadata")[0]["fields"]
    got = made.select(fields["page-id"].cast("long"), "payload_bytes", "payload_digest", "type", fields["refers-to-page"].cast("long"), "payload", F.size("requests"), F.size("metadata")).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected(ROWS)
    for r in got:
        assert (r["payload"] is None) == (r["type"] == "revisit") and tuple(r)[6:] == (1, 1)
        assert r["type"] == "revisit" or hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]
    assert warc.unmatched(warc.records(archives)).count() == 0
    ids = warc.records(archives).where("type <> 'warcinfo'").select("record_id")
    assert ids.distinct().count() == ids.count() == 3 * len(ROWS)


def record(kind, name, block, *headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 2020-01-01T00:00:00Z", *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    http = "Content-Type: application/http; msgtype=response"
    plain = b"".join([
        record("warcinfo", "i", b"software: x\r\n"), record("response", "r1", b"HTTP/1.1 200 OK\r\n\r\nbody", http, "WARC-Concurrent-To: <q1>", "WARC-Concurrent-To: <m1>"), record("request", "q1", b"GET / HTTP/1.1\r\n\r\n"),
        record("metadata", "m1", b"a: 1\r\nb: 2\r\n"), record("metadata", "m2", b"c: 3\r\n", "WARC-Concurrent-To: <q1>"), record("request", "alone", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <gone>"),
        record("resource", "s1", b"file bytes", "Content-Type: text/plain", "WARC-Target-URI: file:///a")])
    (tmp_path / "a.warc").write_bytes(plain)
    whole = io.BytesIO()
    with gzip.GzipFile(fileobj=whole, mode="wb") as f:  # all records in one member, though they should be one each
        f.write(record("response", "r2", b"HTTP/1.1 200 OK\r\n\r\nsecond", http) + record("metadata", "m3", b"d: 4", "WARC-Concurrent-To:\r\n <r2>"))
    (tmp_path / "b.warc.gz").write_bytes(whole.getvalue())
    found = warc.records(warc.archive_files(spark, f"file://{tmp_path}"), payload=True)
    rows = {r["record_id"]: r for r in warc.captures(found).collect()}
    assert set(rows) == {"r1", "r2", "s1"}
    assert bytes(rows["r1"]["payload"]) == b"body" and bytes(rows["s1"]["payload"]) == b"file bytes" and rows["s1"]["requests"] is None
    assert [q["record_id"] for q in rows["r1"]["requests"]] == ["q1"] and sorted(m["record_id"] for m in rows["r1"]["metadata"]) == ["m1", "m2"]
    assert rows["r2"]["metadata"][0]["fields"] == {"d": "4"}
    assert [r["record_id"] for r in warc.unmatched(found).collect()] == ["alone"]


@pytest.mark.parametrize("content", [gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")[:-9], b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"junk without an end"])
def test_broken_archives_are_errors(content):
    with pytest.raises(ValueError):
        for _, data in warc.members(content):
            list(warc._parsed(data))


def test_no_pages(spark):
    none = warc.archived(spark.createDataFrame([], PAGES))
    assert none.count() == 0 and warc.captures(warc.records(none)).count() == 0
