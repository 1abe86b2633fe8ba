"""Conversion of legacy ARC archives to WARC records.

An ARC file is a run of records, each a header line, a body of the length the
line declares, and a newline. The first record, ``filedesc:``, names the
version: version 1 lines are ``URL IP date type length``, version 2 lines
``URL IP date type status checksum location offset filename length``. Lines
are read from the right by the version's own pattern, so a URL may hold
spaces. If what follows a declared length is neither the end nor a newline and
a header line, the length is wrong: the body then runs to the next header line
(status ``resynced``), or to the end (``truncated``). Whole files that are
gzipped, in one or many members, are unpacked first; where a member is damaged,
what it still gives is kept, the record that it cuts has status ``damaged``,
and reading goes on at the next member that can be read.

Each ARC record becomes one WARC/1.0 record:

* WARC-Type: ``warcinfo`` for filedesc, ``response`` for http(s) bodies that
  begin with an HTTP status line, else ``resource``;
* WARC-Date: the 14 digit date in ISO form; shorter dates are filled up, and
  an impossible one falls back to the file's own date, then to 1970;
* WARC-Record-ID: a UUID from the MD5 of URI, date and block digest, hence the
  same however often and wherever the file is converted;
* WARC-Block-Digest of the body, WARC-Payload-Digest of what follows the HTTP
  headers, both ``sha1:`` in base 32.

Files are spread over tasks, each converted by one pass over its bytes.

Defined results: null or empty files give no record, a file without any header
line neither; an empty body is a record of length 0; repeated files give
repeated records with equal identifiers; columns other than path and content
are ignored; ``archives`` writes null URLs as ``about:blank``, takes null
bodies as empty, and leaves out rows without page_id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "path string, arc_offset long, arc_version int, status string, warc_type string, record_id string, warc_date string, target_uri string, ip_address string, "
    "content_type string, http_status int, content_length long, block_digest string, payload_digest string, payload_type string, warc_header string, block binary"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in SCHEMA.split(", ")]

_V1 = rb"([a-zA-Z][\w+.-]*:[^\n\r]*?) (\S+) (\d{4,17}) ([^\n\r]*?) (\d{1,15})"
_V2 = rb"([a-zA-Z][\w+.-]*:[^\n\r]*?) (\S+) (\d{4,17}) ([^\n\r]*?) (\d{1,3}|-) (\S+) (\S+) (\d+|-) (\S+) (\d{1,15})"
LINE = {1: re.compile(_V1 + rb"\r?\n"), 2: re.compile(_V2 + rb"\r?\n")}
_NEXT = {v: re.compile(rb"\n(?=" + p + rb"\r?\n)") for v, p in ((1, _V1), (2, _V2))}
_STATUS = re.compile(rb"HTTP/\d(?:\.\d)? +(\d{3})")
_TYPE = re.compile(rb"(?im)^content-type:[ \t]*([^\r\n;]*)")


def unpacked(content: bytes) -> list[bytes]:
    """The archive without gzip, in pieces between damages; of a broken member, what can be read."""
    if content[:2] != b"\x1f\x8b":
        return [content]
    try:
        return [gzip.decompress(content)]
    except (OSError, EOFError, zlib.error):
        pass
    pieces, out, at = [], [], 0
    while at >= 0:
        d, left, got = zlib.decompressobj(31), content[at:], 0
        try:
            while not d.eof and left:
                part = d.decompress(left, 1 << 12)
                left, got = d.unconsumed_tail, got + len(part)
                out.append(part)
            whole = d.eof
        except zlib.error:
            whole = False
        if whole:
            at = len(content) - len(d.unused_data)
            if content[at : at + 2] == b"\x1f\x8b":
                continue
        if out and (got or not whole):
            pieces.append(b"".join(out))
            out = []
        at = content.find(b"\x1f\x8b\x08", at + (not whole))
    return pieces


def records(content: bytes, version: int = 1) -> Iterator[tuple[int, int, re.Match, bytes, str]]:
    """(offset, version, header line, body, status) of each record of an ARC file, which begins in ``version``."""
    at = 0
    while at < len(content):
        while content[at : at + 1] in (b"\n", b"\r"):
            at += 1
        m = LINE[version].match(content, at) or LINE[3 - version].match(content, at)
        if not m:
            # not a record: look for the next line that is one
            nxt = min((x for x in (p.search(content, at) for p in _NEXT.values()) if x), key=lambda x: x.start(), default=None)
            if nxt is None:
                return
            at = nxt.end()
            continue
        if m[1].startswith(b"filedesc:"):
            m = LINE[2].match(content, at) or m
        start, length = m.end(), int(m[m.re.groups])
        stop, status = start + length, "ok"
        if m[1].startswith(b"filedesc:"):
            first = content[start : start + 16].split(b" ", 1)[0].strip()
            version = 2 if first == b"2" else 1
        if not _fits(content, stop, LINE[version]):
            nxt = _NEXT[version].search(content, start - 1)
            stop = nxt.start() if nxt else len(content)
            stop = max(stop, start)
            status = "resynced" if nxt else "truncated"
        yield m.start(), 2 if m.re is LINE[2] else 1, m, content[start:stop], status
        at = stop


def _all_records(pieces: list[bytes]) -> Iterator[tuple[int, int, re.Match, bytes, str]]:
    """The records of all pieces; what a damage cuts is ``damaged``."""
    base, version = 0, 1
    for k, piece in enumerate(pieces):
        for offset, own, m, body, status in records(piece, version):
            version = own
            if status != "ok" and k < len(pieces) - 1 and m.end() + len(body) == len(piece):
                status = "damaged"
            yield base + offset, own, m, body, status
        base += len(piece)


def _fits(content: bytes, stop: int, line: re.Pattern) -> bool:
    """Whether a record can end at ``stop``: there the file ends, or a newline and a header line follow."""
    if stop > len(content):
        return False
    at = _skip(content, stop)
    return at == len(content) or at > stop and line.match(content, at) is not None


def _skip(content: bytes, at: int) -> int:
    while content[at : at + 1] in (b"\n", b"\r"):
        at += 1
    return at


def iso_date(digits: str, fallback: str = "1970-01-01T00:00:00Z") -> str:
    """The WARC date of an ARC date of 4 to 17 digits, filled up from the right."""
    d = (digits + "00000101000000"[len(digits) :] if len(digits) < 14 else digits)[:14]
    try:
        return datetime.strptime(d, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return fallback


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(uri: str, date: str, block_digest: str) -> str:
    h = hashlib.md5(f"{uri}|{date}|{block_digest}".encode()).hexdigest()
    h = h[:12] + "5" + h[13:16] + "a" + h[17:]
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def header(fields: list[tuple[str, str]]) -> str:
    return "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"


def convert_file(path: str | None, content: bytes) -> Iterator[tuple]:
    """One tuple of SCHEMA for each record of the file."""
    own_date = "1970-01-01T00:00:00Z"
    for offset, version, m, body, status in _all_records(unpacked(content)):
        text = [g.decode("utf-8", "replace") for g in m.groups()]
        uri, ip, kind = text[0], text[1], text[3].strip() or "application/octet-stream"
        date = iso_date(text[2], own_date)
        code, payload, payload_type = None, body, kind
        if uri.startswith("filedesc:"):
            warc_type, own_date, content_type = "warcinfo", date, "text/plain"
        elif uri.lower().startswith(("http:", "https:")) and (s := _STATUS.match(body)):
            warc_type, content_type, code = "response", "application/http; msgtype=response", int(s[1])
            ends = [e for e in (body.find(b"\r\n\r\n"), body.find(b"\n\n")) if e >= 0]
            cut = min(ends) if ends else len(body)
            payload = body[cut + (4 if body[cut : cut + 4] == b"\r\n\r\n" else 2) :]
            if t := _TYPE.search(body, 0, cut):
                payload_type = t[1].decode("utf-8", "replace").strip() or kind
        else:
            warc_type, content_type = "resource", kind
        block_digest, payload_digest = digest(body), digest(payload)
        rid = record_id(uri, date, block_digest)
        fields = [("WARC-Type", warc_type), ("WARC-Record-ID", rid), ("WARC-Date", date)]
        fields += [("WARC-Filename", uri[len("filedesc:") :].lstrip("/"))] if warc_type == "warcinfo" else [("WARC-Target-URI", uri), ("WARC-IP-Address", ip)]
        fields += [("WARC-Block-Digest", block_digest)] + ([("WARC-Payload-Digest", payload_digest)] if warc_type == "response" else [])
        fields += [("Content-Type", content_type), ("Content-Length", str(len(body)))]
        yield path, offset, version, status, warc_type, rid, date, uri, ip, content_type, code, len(body), block_digest, payload_digest, payload_type, header(fields), body


def warc_bytes(warc_header: str, block: bytes) -> bytes:
    """The record as it stands in a WARC file."""
    return warc_header.encode() + block + b"\r\n\r\n"


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows, size = [], 0
            for r in convert_file(path.as_py(), content.as_py() or b""):
                rows.append(r)
                size += len(r[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def convert(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """WARC records of ARC files, as ``spark.read.format("binaryFile")`` gives them."""
    return files.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).cast("binary").alias("content")).mapInArrow(_convert, SCHEMA)


_EPOCH = datetime(2008, 1, 1, tzinfo=timezone.utc)


def arc_file(name: str, version: int, pages: list[tuple[int, str, str]]) -> bytes:
    """An ARC file of that version with pages as HTTP responses; a page's id sets its date and address."""
    fields = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    intro = f"{version} 0 graingrid\n{fields}\n".encode()
    tail = "" if version == 1 else "200 - - 0 " + name + " "
    out = [f"filedesc://{name} 0.0.0.0 20080101000000 text/plain {tail}{len(intro)}\n".encode(), intro, b"\n"]
    for page, url, html in pages:
        body = html.encode()
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
        when = (_EPOCH + timedelta(seconds=page % 3_000_000_000)).strftime("%Y%m%d%H%M%S")
        ip = f"10.{page // 65536 % 256}.{page // 256 % 256}.{page % 256}"
        out += [f"{url} {ip} {when} text/html {tail}{len(body)}\n".encode(), body, b"\n"]
    return b"".join(out)


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = [(p, (u or "about:blank").replace("\n", " ").replace("\r", " "), h or "") for p, u, h in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))]
            names, files = [], []
            for version in (1, 2):
                if own := [r for r in rows if r[0] % 2 == version - 1]:
                    names.append(f"pages-{own[0][0]}-v{version}.arc")
                    files.append(arc_file(names[-1], version, own))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(files, pa.binary())], ["path", "content"])


def archives(pages: DataFrame) -> DataFrame:
    """ARC files (path, content) of the pages, even page ids in version 1 and odd ones in version 2."""
    return pages.where("page_id is not null").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_archives, "path string, content binary")


#: What converting the archives of all pages must give, from the pages alone.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, replace(replace(coalesce(url, 'about:blank'), chr(10), ' '), chr(13), ' ') AS target_uri, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL
), b AS (
  SELECT *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html AS block,
    strftime(TIMESTAMP '2008-01-01' + to_seconds(page_id % 3000000000), '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
    '10.' || (page_id // 65536 % 256) || '.' || (page_id // 256 % 256) || '.' || (page_id % 256) AS ip_address FROM p
), s AS (
  SELECT *, sha1(block) AS hb, sha1(html) AS hp FROM b
), d AS (
  SELECT *, 'sha1:' || array_to_string(list_transform(range(8), lambda j: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hb, CAST(1 + 5 * j AS INT), 5) AS INT) >> k) & 31 AS INT), 1)), '')), '') AS block_digest,
    'sha1:' || array_to_string(list_transform(range(8), lambda j: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hp, CAST(1 + 5 * j AS INT), 5) AS INT) >> k) & 31 AS INT), 1)), '')), '') AS payload_digest FROM s
), r AS (
  SELECT *, md5(target_uri || '|' || warc_date || '|' || block_digest) AS h FROM d
), i AS (
  SELECT *, '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21) || '>' AS record_id FROM r
)
SELECT CAST(1 + page_id % 2 AS INT) AS arc_version, 'ok' AS status, 'response' AS warc_type, record_id, warc_date, target_uri, ip_address, 'application/http; msgtype=response' AS content_type, 200 AS http_status,
  CAST(octet_length(encode(block)) AS BIGINT) AS content_length, block_digest, payload_digest, 'text/html' AS payload_type,
  array_to_string(['WARC/1.0', 'WARC-Type: response', 'WARC-Record-ID: ' || record_id, 'WARC-Date: ' || warc_date, 'WARC-Target-URI: ' || target_uri, 'WARC-IP-Address: ' || ip_address, 'WARC-Block-Digest: ' || block_digest, 'WARC-Payload-Digest: ' || payload_digest, 'Content-Type: application/http; msgtype=response', 'Content-Length: ' || octet_length(encode(block)), '', ''], chr(13) || chr(10)) AS warc_header, block
FROM i
"""


def query(pages: DataFrame) -> DataFrame:
    """The pages' ARC files, converted: every record but the files' own descriptions, block as text."""
    out = convert(archives(pages)).where("warc_type <> 'warcinfo'")
    return out.drop("path", "arc_offset").withColumn("block", F.decode("block", "UTF-8"))
