"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

Writing: every page becomes one record in a gzip member of its own.  Payloads of
at least ``least`` bytes that occur more than once are stored with the largest
page id (``response``); the others ``revisit`` it.  Only digests are grouped, so
a page that makes up a third of all pages is one counted key.  Spark's text
writer puts the members into files of bounded size on any file system: a row is
a member without its last byte, and the line separator is that byte (the high
byte of the member's length, zero below 16 MiB; larger records are followed by an empty member).

Reading: whatever fails its checks (gzip header, checksum, length, WARC
version line, record length, payload digest) is quarantined; the reader looks for the next
place where a valid member, or in plain files and inside a member's content a version line,
begins, goes on from there and logs the gap in bytes (of a sound member, its
bytes in the file and the range in its content).  Of a member that is cut off
the whole records before the cut are kept; of one that is corrupt those whose
payload digest proves them.

Defined results: null html is an empty payload; a null page id is kept as null
and never referred to; pages that share the largest id and the payload are all
responses; repeated rows give repeated records; an empty table gives an empty
archive; extra columns are ignored.
"""
from __future__ import annotations

import contextlib
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleo.llm.common import shared_path, utf8

LEAST = 1000
RECORDS_PER_FILE = 2000
VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
_EMPTY = gzip.compress(b"", mtime=0)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, headers and block."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", DATE),
            ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%")),
            ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(payload).hexdigest()), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """Gzip member that ends in a zero byte."""
    out = gzip.compress(raw, 6, mtime=0)
    return out if out[-1] == 0 else out + _EMPTY


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [member(record(int(p) if p else None, u, h, int(r) if r else None, bool(v)))[:-1] for p, u, h, r, v in zip(b["page_id"], b["url"], b["html"], b["refers_to"], b["revisit"])]
        yield pd.DataFrame({"member": rows}, dtype="object")


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html (bytes), refers_to, revisit."""
    p = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), utf8(pages["html"]).alias("html"))
    p = p.withColumn("digest", F.when((F.length("html") >= least) & F.col("page_id").isNotNull(), F.unhex(F.sha1("html"))))
    first = p.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("digest", "first")
    p = p.join(first, "digest", "left")
    revisit = F.coalesce(F.col("page_id") < F.col("first"), F.lit(False))
    return p.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, path: str, least: int = LEAST, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archive files of at most ``records_per_file`` records under ``path``."""
    p = plan(pages, least)
    # ids travel as text: a nullable integer would turn into a float
    rows = p.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"), "revisit")
    made = rows.mapInPandas(_members, "member binary").select(F.col("member").cast("string").alias("value"))
    made.write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


class Damage(Exception):
    """A member or record that fails a check."""


STEP = 1 << 18
FINE = 1 << 10


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at ``at`` and where the next begins."""
    d = zlib.decompressobj(31)
    out, view = [], memoryview(data)
    try:
        while not d.eof and at < len(data):
            out.append(d.decompress(view[at:at + STEP]))
            at += STEP
    except zlib.error as e:
        raise Damage(str(e)) from e
    if not d.eof:
        raise Damage("member is cut off")
    return b"".join(out), min(at, len(data)) - len(d.unused_data)


def _remains(data: bytes, at: int) -> tuple[bytes, int, bool, list[tuple[int, int]]]:
    """Of a damaged member: content before the error, where the error shows, whether it is only cut off, and (byte, content so far) marks."""
    d = zlib.decompressobj(31)
    out, size, step, marks, view = [], 0, FINE, [(at, 0)], memoryview(data)
    while at < len(data):
        last = d.copy()
        try:
            out.append(d.decompress(view[at:at + step]))
        except zlib.error:
            d = last
            if step > 1:
                step = max(1, step // 32)
                continue
            with contextlib.suppress(zlib.error):  # the byte that shows the error: what comes out before it, one at a time
                rest = bytes(view[at:at + 1])
                while x := d.decompress(rest, 1):
                    out.append(x)
                    rest = d.unconsumed_tail
            return b"".join(out), at, False, marks
        size += len(out[-1])
        at = min(at + step, len(data))
        marks.append((at, size))
    return b"".join(out), at, True, marks


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``."""
    if not raw.startswith(b"WARC/1.", at):
        raise Damage("no version line")
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damage("headers do not end")
    head = {}
    for line in raw[at:stop].split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            raise Damage("header without a colon")
        head[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    size = head.get("content-length", "")
    if not size.isdigit():
        raise Damage("no length")
    first = stop + 4
    last = first + int(size)
    if raw[last:last + 4] != b"\r\n\r\n":
        raise Damage("record has another length")
    return head, raw[first:last], last + 4


def checked(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """``parse`` and the digest of a stored payload; the block is returned without HTTP headers."""
    head, block, end = parse(raw, at)
    payload = block.partition(b"\r\n\r\n")[2]
    digest = head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and digest.startswith("sha1:") and hashlib.sha1(payload).hexdigest() != digest[5:].lower():
        raise Damage("payload has another digest")
    return head, block, end


def _proven(head: dict[str, str]) -> bool:
    """Did ``checked`` compare a digest?"""
    return head.get("warc-type") == "response" and head.get("warc-payload-digest", "").startswith("sha1:")


def _records(raw: bytes, sure: bool) -> tuple[list[tuple[dict[str, str], bytes]], int, list[tuple[int, int, str]]]:
    """Intact records of a member's content, where the last of them ends, and the ranges between them.  If not ``sure``, a digest has to prove a record."""
    kept, lost, i, end = [], [], 0, 0
    while i < len(raw):
        why = "not proven by a digest"
        try:
            head, block, j = checked(raw, i)
            if sure or _proven(head):
                kept.append((head, block))
                i = end = j
                continue
        except Damage as e:
            why = str(e)
            with contextlib.suppress(Damage):  # a record of the right length ends where the next begins
                j = parse(raw, i)[2]
            if why != "payload has another digest" or not (j == len(raw) or raw.startswith(b"WARC/1.", j)):
                j = raw.find(b"WARC/1.", i + 1)
                j = len(raw) if j < 0 else j
        if lost and lost[-1][1] == i:
            lost[-1] = (lost[-1][0], j, lost[-1][2])
        else:
            lost.append((i, j, why))
        i = j
    return kept, end, lost


Found = tuple[str, int, int, dict[str, str] | None, bytes, str]


def salvage(data: bytes) -> Iterator[Found]:
    """(what, first byte, end, headers, block, reason) for every record and every quarantined gap of one file."""
    at, gap, why, n = 0, None, "", len(data)
    seen, until = set(), 0  # records kept of the damaged member, which reaches to ``until``: stored blocks hold them once more
    while at < n:
        lost: list[tuple[int, int, str]] = []
        try:
            if data.startswith(MAGIC, at):
                raw, end = _inflate(data, at)
                got, _, lost = _records(raw, True)
            else:
                head, block, end = checked(data, at)
                got = [(head, block)]
        except Damage as e:
            if data.startswith(MAGIC, at):
                raw, stop, cut, marks = _remains(data, at)
                got, whole, _ = _records(raw, cut)
                if got:
                    if gap is not None:
                        yield "gap", gap, at, None, b"", why
                    for head, block in got:
                        yield "record", at, stop, head, block, ""
                    gap, why = max(a for a, size in marks if size <= whole), str(e)
                    seen, until = {hashlib.sha1(repr(x).encode()).digest() for x in got}, stop
            if gap is None:
                gap, why = at, str(e)
            at += 1
            places = [x for x in (data.find(MAGIC, at), data.find(b"WARC/1.", at)) if x >= 0]
            at = min(places, default=n)
            continue
        if at < until:
            got = [x for x in got if hashlib.sha1(repr(x).encode()).digest() not in seen]
            if not got:
                at = end
                continue
        if lost and not got:  # nothing of this member can be read
            if gap is None:
                gap, why = at, lost[0][2]
            at = end
            continue
        if gap is not None:
            if gap < at:
                yield "gap", gap, at, None, b"", why
            gap = None
        for head, block in got:
            yield "record", at, end, head, block, ""
        for a, b, reason in lost:
            yield "gap", at, end, None, b"", f"{reason} (bytes {a} to {b} of the member's content)"
        at = end
    if gap is not None and gap < n:
        yield "gap", gap, n, None, b"", why


def _page(value: str | None) -> str | None:
    v = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return v or None


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["file", "what", "first_byte", "end_byte", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "reason"]
    for b in batches:
        for path, data in zip(b["path"], b["content"]):
            out, size = [], 0
            for what, a, e, head, block, why in salvage(data):
                if what == "gap":
                    out.append((path, what, a, e, None, None, None, None, None, None, why))
                else:
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stored = head.get("warc-type") != "revisit"
                    length = next((x.split(b":")[1].strip().decode() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    out.append((path, what, a, e, _page(head.get("warc-record-id")), head.get("warc-type"), _page(head.get("warc-refers-to")),
                                str(len(payload)) if stored else length, head.get("warc-payload-digest", "").removeprefix("sha1:"), payload if stored else None, None))
                    size += len(payload)
                if size > 4 << 20:
                    yield pd.DataFrame(out, columns=names, dtype="object")
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names, dtype="object")


_READ = ("file string, what string, first_byte bigint, end_byte bigint, page_id string, record_type string, refers_to string, payload_bytes string, "
         "payload_digest string, payload binary, reason string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps of all archive files under a path, one file a row of work."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = files.mapInPandas(_rows, _READ)
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("page_id", "refers_to", "payload_bytes")})


def records(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")


def quarantine(rows: DataFrame) -> DataFrame:
    """Log of the byte ranges that could not be read."""
    return rows.where("what = 'gap'").select("file", "first_byte", "end_byte", "reason")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder and read the archives back."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path)
    return records(read(pages.sparkSession, path))
