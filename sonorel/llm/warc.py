"""WARC archives: a writer of columns and a reader that salvages damaged files.

Writing: records are built by column functions and written by Spark's text sink with the
record separator as line separator, so any file system that Spark knows will do. Of records
with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is the
response; the others are revisits of it, without a block.

Reading: each archive is parsed record by record. A record whose version line, headers, length,
separator or digest does not check out is not trusted: the reader looks for the next gzip
member or version line from which a record does check out, goes on there, and logs the bytes
between as a quarantined gap. In a gzip member the same search goes over the bytes that can be
decompressed, if the member is torn up to the damage; a member without records is stepped over.

Defined results: a null html is an empty payload; a null page_id is written as one and is
always a response; repeated rows are written and read as often as they stand, and rows that share their
smallest page_id are all responses; extra columns are not carried. One archive is read in one task; ``write`` bounds archives by bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sonorel.llm.work import drop_path, scratch_path, stored
from sonorel.shipping import ship

END = "\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def base32(hex40: Column) -> Column:
    """Upper-case base32 of a SHA-1 given in hex: five hex digits make four characters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def char(i: Column) -> Column:
        group = F.conv(F.substring(hex40, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("int")
        return F.substring(alphabet, F.call_function("shiftright", group, (15 - 5 * (i % 4)).cast("int")).bitwiseAND(31) + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), char), "")


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One text per row of ``pages(page_id, url, html)``: its WARC record without the closing separator."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit("")) if "url" in pages.columns else F.lit("")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload").cast("long")})
    firsts = rows.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = stored(firsts.where("n > 1").select("sha", "first"), "firsts")
    rows = rows.join(firsts, "sha", "left")
    revisit = F.coalesce((F.col("size") >= min_bytes) & (F.col("first") != F.col("page_id")), F.lit(False))
    identity = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), identity, F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " "),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha")), F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string")), F.lit(END),
    )
    return rows.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))


#: Records below these sizes in bytes share archives by so many; larger ones have an archive each.
SHARED = ((1 << 14, 4000), (1 << 20, 64))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archives of at most 64 MB, but for those of a single larger record."""
    rows = records(pages, min_bytes)
    kind = sum((F.octet_length("value") >= limit).cast("int") for limit, _ in SHARED)
    there = sorted(r.kind for r in rows.select(kind.alias("kind")).distinct().collect())  # at most three
    for k in there or [0]:
        most = SHARED[k][1] if k < len(SHARED) else 1
        some = rows.where(kind == k) if len(there) > 1 else rows
        some.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", most).text(path)


@dataclass
class Record:
    offset: int
    end: int
    headers: dict[str, str]
    block: bytes


class Damage(Exception):
    pass


def _plain_record(data: bytes, at: int, strict: bool = False) -> Record:
    """The record at ``at`` if it checks out; its end is that of its separator. ``strict``: control characters in headers do not check out."""
    m = _VERSION.match(data, at)
    if not m:
        raise Damage("no version line")
    stop = data.find(b"\r\n\r\n", m.end() - 2)
    if stop < 0:
        raise Damage("no end of headers")
    if strict and _CONTROL.search(data, m.end(), stop):
        raise Damage("a control character in the headers")
    headers = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("a header without colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damage("no content length")
    end = stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damage("no separator after the block")
    block = data[stop + 4 : end]
    digest = headers.get("warc-payload-digest") or headers.get("warc-block-digest")
    if digest and headers.get("warc-type") != "revisit" and digest.lower().startswith("sha1:"):
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != digest[5:].upper():
            raise Damage("digest")
    return Record(at, end + 4, headers, block)


CHUNK = 1 << 16


def _unzip(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` holds as far as it can be read, the end of what was read, and what was wrong, if anything."""
    unzip, out, p, view = zlib.decompressobj(31), [], at, memoryview(data)
    while p < len(data) and not unzip.eof:
        before = unzip.copy()
        try:
            out.append(unzip.decompress(view[p : p + CHUNK]))
        except zlib.error as e:
            for k in range(p, min(p + CHUNK, len(data))):  # byte by byte, for all that comes before the damage
                try:
                    out.append(before.decompress(view[k : k + 1]))
                except zlib.error:
                    break
            return b"".join(out), k, str(e)
        p = min(p + CHUNK, len(data))
    plain = b"".join(out) + (b"" if unzip.eof else unzip.flush())
    return plain, p - len(unzip.unused_data), "" if unzip.eof else "the member is cut short"


def _parse(data: bytes, torn: bool) -> tuple[list[Record], list[str]]:
    """The records in a member's bytes that check out, and what was wrong between them.

    A torn member counts up to the first damage: behind it, copies of earlier bytes may be shifted, so
    that headers are wrong in what no digest covers. The record just before the damage counts only where
    another one begins behind it, or nothing is left.
    """
    out, wrong, p = [], [], 0
    while p < len(data):
        try:
            out.append(_plain_record(data, p))
            p = out[-1].end
            continue
        except Damage as e:
            wrong.append(str(e))
        if torn:
            break
        while line := _VERSION.search(data, p + 1):
            p = line.start()
            try:
                _plain_record(data, p)
                break
            except Damage:
                continue
        else:
            break
    if torn and out and not data.startswith(b"WARC/1."[: len(data) - p], p) and not _VERSION.search(data, p):
        out.pop()
    return out, wrong


def _member(data: bytes, at: int) -> tuple[list[Record], list[str], int, bool]:
    """Of the gzip member at ``at``: its records, what was wrong between them, the end of what was read, whether it is torn."""
    plain, end, why = _unzip(data, at)
    out, wrong = _parse(plain, bool(why))
    return [Record(at, end, r.headers, r.block) for r in out], [why] if why else wrong, end, bool(why)


def salvage(data: bytes) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """All records of an archive that check out, and the byte gaps with what was wrong.

    What is wrong inside a member makes a gap of the member's bytes; its other records stand.
    """
    found: list[Record] = []
    gaps: list[tuple[int, int, str]] = []
    at, strict = 0, False  # strict: the bytes may be of a torn member, which stores records with marks of its own between
    while at < len(data):
        part: list[Record] = []
        try:
            if data.startswith(MAGIC, at):
                part, wrong, end, strict = _member(data, at)
                if not strict:
                    found += part
                    gaps += [(at, end, why) for why in wrong]
                    at = end
                    continue
                reason = wrong[0]
            else:
                found.append(_plain_record(data, at, strict))
                at = found[-1].end
                continue
        except Damage as e:
            reason, end = str(e), at
        begin, p = at, at
        next_member = next_line = -1
        while True:
            if next_member <= p:  # each search goes on where it last ended
                next_member = data.find(MAGIC, p + 1)
                next_member = len(data) if next_member < 0 else next_member
            if next_line <= p:
                line = _VERSION.search(data, p + 1)
                next_line = line.start() if line else len(data)
            p = min(next_member, next_line)
            if p >= len(data):
                break
            if data.startswith(MAGIC, p):
                more, _, _, torn = _member(data, p)
                if more or not torn:
                    break
                continue
            try:
                r = _plain_record(data, p, strict)
            except Damage:
                continue
            if not (r.end <= end and any((x.headers, x.block) == (r.headers, r.block) for x in part)):  # a torn member may store its records as they are
                break
        found += [Record(begin, p, r.headers, r.block) for r in part]
        gaps.append((begin, p, reason))
        at = p
    return found, gaps


READ = "path string, at long, until long, record_type string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes long, block binary, gap string"


def read(archives: DataFrame, blocks: bool = True) -> DataFrame:
    """Rows of all records and gaps of ``archives(path, content)``; a gap's row has only path, at, until and gap."""

    def run(batches):
        names = [c.split()[0] for c in READ.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                found, gaps = salvage(content.as_py() or b"")
                rows = []
                for r in found:
                    h = r.headers
                    size = h.get("x-payload-length", "")
                    digest = h.get("warc-payload-digest", "")
                    rows.append((path, r.offset, r.end, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest[5:] if digest.lower().startswith("sha1:") else None, int(size) if size.isdigit() else len(r.block), r.block if blocks else None, None))
                rows += [(path, a, b, None, None, None, None, None, None, None, why) for a, b, why in gaps]
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
                cols = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    ship(archives.sparkSession)
    return archives.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, READ)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, read the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, min_bytes)
    archives = spark.read.format("binaryFile").load(path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    found = stored(read(archives, blocks=False).where("gap is null"), "records", rows=1)
    drop_path(path)
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
