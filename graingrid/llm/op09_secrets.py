"""Secret scan with multipart credential linking.

Parts of three roles are found in each text: access identifiers (key ids,
user names, e-mail addresses), secrets (private keys, provider tokens, and
assigned passwords and tokens) and endpoints (URLs, addresses, hosts). A part
is strong if its own form gives it away (a provider's prefix, or an assigned
value of at least 16 characters with letters, digits and at least 2.5 bits of entropy a character), else
weak. Identifiers and endpoints complement secrets, and the reverse.

Parts are joined as intervals: a part's span widened by ``reach`` characters
on both sides must touch the other's span, in the same scope. Scopes are the
paragraphs of one row's text (blank lines part them), so the join is local to
the row: both sides sorted, each part looks up its range by binary search, and
no text or part is shuffled. Strong parts are reported always, weak ones only
when linked, with the nearest partner of each complementary role and the
number of all partners. Texts without anything secret-like are skipped by one
linear-time pattern; the rest are scanned whole.

Defined results: null and empty texts have no parts; spans are in characters;
where spans of the same role overlap, the earlier, then the longer one counts;
nearest partners tie to the earlier one; repeated rows are each reported;
placeholder values (``<token>``, ``xxxx``, ``your_password``) are no secrets;
``scan`` reads two columns, ``redact`` carries all others. ``redact`` puts
``[kind]`` for every reported span and sets ``n_chars``, where there is such
an integer column, to the new length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 200
SCHEMA = "doc_id long, start long, end long, role string, kind string, strong boolean, id_start long, secret_start long, endpoint_start long, partners int"

_ASSIGNED = r"(?:pass(?:word|wd)?|pwd|secret(?:[_-]?(?:access)?[_-]?key)?|client[_-]?secret|(?:auth|access|api|bearer|refresh)?[_-]?token|api[_-]?key|private[_-]?key|credential)"
_GIVEN = r"[\"'`]?\s{0,3}(?:=|:|=>|:=)"
_VALUE = _GIVEN + r"\s{0,3}[\"'`]?([^\s\"'`,;]{6,})"
_NAME = _VALUE.replace("{6,}", "{3,}")
#: role, kind, strong by form, pattern; a group is the part's span
PATTERNS = [
    (r, k, s, re.compile(p.encode()))
    for r, k, s, p in [
        ("id", "aws_key_id", True, r"(?<![A-Za-z0-9])((?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{16})(?![A-Za-z0-9])"),
        ("id", "user_name", False, r"(?i)(?<![a-z0-9])(?:user(?:[_-]?name)?|login|account|client[_-]?id|access[_-]?key[_-]?id)" + _NAME),
        ("id", "email", False, r"(?<![\w.+-])([A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]{0,253}\.[A-Za-z]{2,24})(?![\w-])"),
        ("secret", "private_key", True, r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)"),
        ("secret", "provider_token", True, r"(?<![A-Za-z0-9_-])(gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
        ("secret", "assigned", False, r"(?i)(?<![a-z0-9])" + _ASSIGNED + _VALUE),
        ("secret", "bare_key", False, r"(?<![A-Za-z0-9/+=_-])([A-Za-z0-9/+]{40})(?![A-Za-z0-9/+=_-])"),
        ("endpoint", "url", False, r"(?i)((?:https?|ftp|jdbc:[a-z]{2,16}|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{3,})"),
        ("endpoint", "address", False, r"(?<![\d.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?::\d{2,5})?)(?![\d.])"),
        ("endpoint", "host", False, r"(?i)(?<![a-z0-9])(?:host(?:name)?|endpoint|server|region)" + _NAME),
    ]
]
#: Whatever can be a strong part or a secret, a superset of their patterns: without a strong part or a secret nothing is
#: reported. Linear time, over whole batches; without ``\s``, whose bytes differ between the two pattern engines.
_HINT = r"(?i:" + _ASSIGNED + _GIVEN.replace(r"\s", r"[\s\x0b]") + r")|AKIA|ASIA|AIDA|AROA|-----BEGIN |gh[pousr]_|xox[abprs]-|sk-|AIza|glpat-|eyJ|[A-Za-z0-9/+]{40}"
#: A private key goes on to the next of these lines, whatever stands between; without one its first line counts.
_KEY_END = re.compile(rb"-----END [A-Z ]{0,20}PRIVATE KEY-----")
_PLACEHOLDER = re.compile(rb"(?i)^(?:<.*>?|\$?\{.*\}?|\*+|x+|\.+|(?:your|my|the|some|example|changeme|dummy|placeholder|none|null|true|false|undefined)[\w-]*)$")
_COMPLEMENT = {"id": ("secret",), "endpoint": ("secret",), "secret": ("id", "endpoint")}


def entropy(v: bytes) -> float:
    n = len(v)
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values()) if n else 0.0


def _mixed(v: bytes) -> bool:
    return any(48 <= c < 58 for c in v) and any(c > 64 for c in v)


def parts_of(text: bytes) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, role, kind, strong) in bytes, of each role not overlapping, by start."""
    out = []
    for role, kind, strong, pattern in PATTERNS:
        closes, past = [m.end() for m in _KEY_END.finditer(text)] if kind == "private_key" else [], 0
        for m in pattern.finditer(text):
            if kind == "private_key":
                k = bisect_right(closes, m.end())
                if m.start() >= past:
                    past = closes[k] if k < len(closes) else m.end()
                    out.append((m.start(), past, role, kind, strong))
                continue
            v = m[1].rstrip(b".)]}>") if kind in ("assigned", "user_name", "host", "url") else m[1]
            if kind in ("assigned", "user_name", "host") and (len(v) < 3 or _PLACEHOLDER.match(v)):
                continue
            if kind == "assigned" and len(v) < 6 or kind == "bare_key" and not (_mixed(v) and entropy(v) >= 3.5):
                continue
            out.append((m.start(1), m.start(1) + len(v), role, kind, strong or kind == "assigned" and len(v) >= 16 and _mixed(v) and entropy(v) >= 2.5))
    # the earlier, then the longer one; a named kind before a bare one at the same span
    out.sort(key=lambda p: (p[0], -p[1], not p[4]))
    kept, last = [], {}
    for p in out:
        if p[0] >= last.get(p[2], 0):
            kept.append(p)
            last[p[2]] = p[1]
    return kept


def characters(text: bytes):
    """From places in bytes to places in characters; what isn't ASCII is counted once, however many places are asked for."""
    if text.isascii():
        return lambda b: b
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return lambda b: None if b is None else int(before[b])


def linked(text: bytes, reach: int = REACH) -> list[tuple]:
    """The reported parts of a text: (start, end, role, kind, strong, id_start, secret_start, endpoint_start, partners), starts and ends in characters."""
    parts = parts_of(text)
    if not parts:
        return []
    at = characters(text)
    breaks = [at(m.end()) for m in re.finditer(rb"\n[ \t\r]*\n", text)]
    parts = [(at(p[0]), at(p[1]), *p[2:]) for p in parts]
    by = {}
    for p in parts:
        by.setdefault((bisect_right(breaks, p[0]), p[2]), []).append(p)
    # in a scope and role the spans don't overlap, so starts and ends are both ascending
    sides = {k: ([p[0] for p in v], [p[1] for p in v]) for k, v in by.items()}
    found = []
    for p in parts:
        scope, near, partners = bisect_right(breaks, p[0]), {"id": None, "secret": None, "endpoint": None}, 0
        for role in _COMPLEMENT[p[2]]:
            starts, ends = sides.get((scope, role), ((), ()))
            lo, hi = bisect_left(ends, p[0] - reach), bisect_right(starts, p[1] + reach)
            if lo >= hi:
                continue
            partners += hi - lo
            k = bisect_left(starts, p[0], lo, hi)
            near[role] = min((max(0, starts[x] - p[1], p[0] - ends[x]), starts[x]) for x in (k - 1, k) if lo <= x < hi)[1]
        if p[4] or partners:
            found.append((*p, near["id"], near["secret"], near["endpoint"], partners))
    return found


def _hinted(col: pa.Array) -> list[int]:
    if pa.types.is_null(col.type):
        return []
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(col, _HINT), False)).to_pylist()


def _bytes(col: pa.Array, k: int) -> bytes:
    return col[k].as_buffer().to_pybytes()


def _scan(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows, at = [], []
            for k in _hinted(batch.column(1)):
                found = linked(_bytes(batch.column(1), k), reach)
                rows += found
                at += [k] * len(found)
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """A row for each reported part, with its nearest partners' starts."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan(reach), SCHEMA)


def redacted(text: bytes, reach: int = REACH) -> bytes:
    """The text with ``[kind]`` for its reported parts."""
    found = linked(text, reach)
    if not found:
        return text
    whole, out, at = text.decode("utf-8", "replace"), [], 0
    for s, e, _, kind, *_ in sorted(found, key=lambda p: (p[0], -p[1])):
        if s >= at:
            out += [whole[at:s], f"[{kind}]"]
        at = max(at, e)
    return ("".join(out) + whole[at:]).encode()


def redact(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """The rows of ``docs``, with its columns, reported parts of the text replaced."""
    place = docs.columns.index(text_col)
    sized = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(place)
            new = {}
            for k in _hinted(col):
                text = _bytes(col, k)
                if (clean := redacted(text, reach)) != text:
                    new[k] = clean
            if new:
                cols = list(batch.columns)
                mask = pa.array([k in new for k in range(batch.num_rows)])
                cols[place] = pc.replace_with_mask(col, mask, pa.array([new[k].decode("utf-8", "replace") for k in sorted(new)], col.type))
                if sized is not None:
                    cols[sized] = pc.replace_with_mask(cols[sized], mask, pa.array([len(new[k].decode("utf-8", "replace")) for k in sorted(new)], cols[sized].type))
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
