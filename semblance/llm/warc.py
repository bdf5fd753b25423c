"""WARC archives of pages: writing them, reading them back, and assembling the records of each capture.

`archived` writes each page as three records (request, response or revisit, metadata) that name each other by WARC-Concurrent-To.
Records are gzip members of their own, packed into archives of about ARCHIVE_BYTES, one row each of a written table. Of pages
with equal payloads of SHORT bytes or more the one with the least page_id is the response and the others revisit it, without the
payload. Which payloads repeat is known from digests alone, so pages are not shuffled: the repeated digests (one row each) are
broadcast while there are at most SMALL of them. Beyond that the digests of over a thousandth of all pages, at most a thousand, are
broadcast and the others joined by digest, where no key is large.

`records` parses archives, of this module or others, gzipped or not: a row for each record, with its headers and, where it is
asked for, its payload. `captures` assembles transactions: requests and metadata meet the response, revisit or resource that they
are concurrent to, whichever of the two names the other, or through one record between (metadata that names the request only), and
give one nested row for each capture. Only narrow columns are shuffled unless payloads are asked for.

Defined cases: a null html has an empty payload; a null url has no target URI; characters of a url that a header line cannot hold
are percent-encoded; a null page_id is kept as a record without one, and comes after all others among equal payloads; rows that
repeat the least page_id with an equal payload are all responses (the page was captured as often as it is given), as are all
rows of a payload that has no page_id at all; a record that is cut off or has no length is an error that names its place; requests
and metadata that belong to no capture are given by `unmatched`; an empty table gives no archives and an empty result; only page_id,
url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import table, written

#: Payloads under this many bytes are stored each time.
SHORT = 100
ARCHIVE_BYTES = 8 << 20
#: Repeated digests that are broadcast at once: about 60 bytes each.
SMALL = 200_000
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS, PARTS = ("response", "revisit", "resource"), ("request", "metadata")
DATE = "2000-01-01T00:00:00Z"

ARCHIVE = "archive string, content binary"
RECORD = {
    "archive": "string", "at": "long", "type": "string", "record_id": "string", "concurrent_to": "array<string>", "target_uri": "string", "date": "string",
    "payload_bytes": "long", "payload_digest": "string", "fields": "map<string, string>", "payload": "binary",
}


def _line_safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + squeeze.flush()


def _capture(page: tuple, name: str, date: str) -> list[bytes]:
    """The records of a page; name: what tells its records from all others."""
    page_id, url, html, digest, refers_to, revisit = page
    ids = {kind: uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{kind}").urn for kind in ("request", "response", "metadata")}
    uri = [("WARC-Target-URI", _line_safe(url))] if url is not None else []
    common = [("WARC-Date", date), *uri]
    with_it = ("WARC-Concurrent-To", f"<{ids['response']}>")
    host, _, path = (url or "").partition("://")[2].partition("/")
    asked = f"GET /{_line_safe(path)} HTTP/1.1\r\nHost: {_line_safe(host)}\r\n\r\n".encode()
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    digests = [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    known = {"page-id": page_id, "refers-to-page": refers_to if revisit else None}
    fields = "".join(f"{k}: {int(v)}\r\n" for k, v in known.items() if v is not None)
    return [
        _record("request", ids["request"], [*common, with_it, ("Content-Type", "application/http;msgtype=request")], asked),
        _record("revisit", ids["response"], [*common, ("WARC-Profile", PROFILE), *digests], answer) if revisit else _record("response", ids["response"], [*common, *digests], answer + html),
        _record("metadata", ids["metadata"], [*common, with_it, ("Content-Type", "application/warc-fields")], fields.encode()),
    ]


def repeated(pages: DataFrame) -> DataFrame:
    """digest, first (least page_id) and n of the payloads that more than one page has."""
    long = pages.where(F.octet_length("html") >= SHORT)
    return long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")


def with_firsts(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """pages with `first` of their payload, null where no other page has it."""
    found = written(repeated(pages), "repeated")
    if found.count() <= small:
        return pages.join(F.broadcast(found.drop("n")), "digest", "left")
    total = pages.count()
    hot = F.broadcast(found.where(F.col("n") * 1000 > total).drop("n"))
    rest = found.where(F.col("n") * 1000 <= total).drop("n")
    return pages.join(hot, "digest").unionByName(pages.join(hot, "digest", "left_anti").join(rest, "digest", "left"))


def archived(pages: DataFrame, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES, small: int = SMALL) -> DataFrame:
    """archive, content: the archives of all rows of pages (page_id, url, html), written."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("digest", F.unhex(F.sha2("html", 256)))
    known = with_firsts(rows, small)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    sent = known.select(F.col("page_id").cast("string"), "url", "html", F.lower(F.hex("digest")), F.col("first").cast("string"), revisit)
    run = uuid.uuid4().hex

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, pages, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        for b in batches:
            for page in b.itertuples(index=False, name=None):
                if not held:
                    about = f"software: semblance\r\nformat: {VERSION}\r\n".encode()
                    held = [_record("warcinfo", uuid.uuid5(uuid.NAMESPACE_URL, f"{run}/{part}/{number}/info").urn, [("WARC-Date", date), ("Content-Type", "application/warc-fields")], about)]
                own = _capture(page, f"{run}/{part}/{pages}", date)
                held += own
                pages, size = pages + 1, size + sum(map(len, own))
                if size >= archive_bytes:
                    yield pd.DataFrame({"archive": [f"{run}-{part:06d}-{number:06d}.warc.gz"], "content": [b"".join(held)]})
                    number, held, size = number + 1, [], 0
        if held:
            yield pd.DataFrame({"archive": [f"{run}-{part:06d}-{number:06d}.warc.gz"], "content": [b"".join(held)]})

    return written(sent.mapInPandas(write, ARCHIVE), "archives")


def archive_files(spark, path: str) -> DataFrame:
    """archive, content of the archive files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc*").load(path)
    return files.select(F.col("path").alias("archive"), "content")


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Places and data of the gzip members of an archive; one that is not compressed is one piece."""
    if content[:2] != b"\x1f\x8b":
        yield 0, content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        begin, parts, inflate = at, [], zlib.decompressobj(31)
        while not inflate.eof:
            if at >= len(view):
                raise ValueError(f"cut off in the member at {begin}")
            parts.append(inflate.decompress(view[at : at + 65536]))
            at = min(at + 65536, len(view))
        at -= len(inflate.unused_data)
        yield begin, b"".join(parts)


def _fields(lines: str) -> dict[str, list[str]]:
    """Values of each name, in lower case; a line that begins with white space goes on with the one before."""
    found: dict[str, list[str]] = {}
    for line in re.sub(r"\r?\n[ \t]+", " ", lines).splitlines():
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), []).append(value.strip())
    return found


def _parsed(data: bytes) -> Iterator[tuple[str, dict[str, list[str]], bytes]]:
    """Type, headers and block of the records in a piece of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            if data[at:].strip():
                raise ValueError(f"no end of headers after {at}")
            return
        headers = _fields(data[at:end].decode("utf-8", "replace").lstrip())
        length = int(headers["content-length"][0]) if "content-length" in headers else -1
        begin = end + 4
        if not 0 <= length <= len(data) - begin:
            raise ValueError(f"a record of {length} bytes at {at}")
        yield headers.get("warc-type", [""])[0].lower(), headers, data[begin : begin + length]
        at = begin + length
        while data[at : at + 2] == b"\r\n":
            at += 2


def _row(archive: str, at: int, kind: str, headers: dict[str, list[str]], block: bytes, payload: bool) -> tuple:
    one = lambda name: headers.get(name, [None])[0]
    bare = lambda x: x.strip("<>") if x else x
    body, size, digest, fields = None, None, None, None
    if kind in ANCHORS:
        http = (one("content-type") or "").startswith("application/http")
        head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        if kind == "revisit":  # the payload is not here: its length and digest are as they were stated
            stated = _fields(head.decode("utf-8", "replace")).get("content-length")
            body, size, digest = None, int(stated[0]) if stated else None, (one("warc-payload-digest") or "").rpartition(":")[2] or None
        else:
            size, digest = len(body), hashlib.sha256(body).hexdigest()
    elif kind == "metadata":
        fields = {k: v[0] for k, v in _fields(block.decode("utf-8", "replace")).items()}
    return archive, at, kind, bare(one("warc-record-id")), [bare(x) for x in headers.get("warc-concurrent-to", [])], one("warc-target-uri"), one("warc-date"), size, digest, fields, body if payload else None


def records(archives: DataFrame, payload: bool = False, batch_bytes: int = 16 << 20) -> DataFrame:
    """The records of archives (archive, content); sizes and digests of payloads are of what was read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size = [], 0
            for archive, content in zip(b["archive"], b["content"], strict=True):
                for at, data in members(bytes(content)):
                    for kind, headers, block in _parsed(data):
                        rows.append(_row(archive, at, kind, headers, block, payload))
                        size += len(block) if payload else 200
                    if size > batch_bytes:
                        yield pd.DataFrame(rows, columns=[*RECORD]).astype({"payload_bytes": "Int64"})
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=[*RECORD]).astype({"payload_bytes": "Int64"})

    return archives.select("archive", "content").mapInPandas(read, ", ".join(f"{k} {v}" for k, v in RECORD.items()))


def _linked(found: DataFrame) -> DataFrame:
    """part, anchor: requests and metadata and the capture that each belongs to."""
    parts = found.where(F.col("type").isin(*PARTS))
    anchors = found.where(F.col("type").isin(*ANCHORS)).select(F.col("record_id").alias("anchor"))
    names = found.select("type", "record_id", F.explode("concurrent_to").alias("other"))
    either = names.where(F.col("type").isin(*PARTS)).select(F.col("record_id").alias("part"), F.col("other").alias("to"))
    back = names.where(F.col("type").isin(*ANCHORS)).select(F.col("other").alias("part"), F.col("record_id").alias("to"))
    direct = either.unionByName(back).join(anchors, F.col("to") == F.col("anchor")).groupBy("part").agg(F.min("anchor").alias("anchor"))
    # by way of another part that has its capture
    between = either.unionByName(either.select(F.col("to").alias("part"), F.col("part").alias("to")))
    step = between.join(direct.select(F.col("part").alias("to"), F.col("anchor")), "to").groupBy("part").agg(F.min("anchor").alias("by_way"))
    return parts.select(F.col("record_id").alias("part")).join(direct, "part", "left").join(step, "part", "left").select("part", F.coalesce("anchor", "by_way").alias("anchor"))


def captures(found: DataFrame) -> DataFrame:
    """One nested row for each response, revisit or resource: itself, its requests and its metadata."""
    of = _linked(found).where("anchor IS NOT NULL").select(F.col("part").alias("record_id"), "anchor")
    own = F.struct("record_id", "archive", "at", "date", "fields")
    parts = found.where(F.col("type").isin(*PARTS)).join(of, "record_id").groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "request", F.struct("record_id", "archive", "at", "date")))).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", own)).alias("metadata"))
    anchors = found.where(F.col("type").isin(*ANCHORS))
    return anchors.select(F.col("record_id").alias("anchor"), "type", "target_uri", "archive", "at", "date", "payload_bytes", "payload_digest", "payload").join(parts, "anchor", "left").withColumnRenamed("anchor", "record_id")


def unmatched(found: DataFrame) -> DataFrame:
    """Requests and metadata that belong to no capture."""
    return found.join(_linked(found).where("anchor IS NULL").select(F.col("part").alias("record_id")), "record_id", "left_semi")


def op12_warc(spark, sf_dir: str) -> DataFrame:
    # assembling reads the records several times, so they are parsed once
    made = captures(written(records(archived(table(spark, sf_dir, "pages"))), "records"))
    fields = F.col("metadata")[0]["fields"]
    return made.select(fields["page-id"].cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), fields["refers-to-page"].cast("long").alias("refers_to"))


OP12_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
), r AS (
  SELECT *, first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
"""
