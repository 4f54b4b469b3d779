"""Secret scans with structural confirmation.

Patterns give the base spans.  The method adds spans whose content is confirmed by its
structure: base64 or hex candidates are decoded, and a span is reported only where the bytes
parse as a key encoding (nested DER lengths that add up, private key layouts), as an OpenSSH
key or as a signed token (a JSON header with ``alg``, a JSON payload, a signature).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents, small

#: Kinds in the order that spans with one start are listed in: base kinds, then the method's.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "openssh", "derhex")

_ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ASSIGN_HINT = re.compile(r"(?ai:password|passwd|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9a-fA-F]{2}){32,}(?![0-9A-Fa-f])")
#: Runs in which signed tokens lie, and the marks around armoured keys.  Each pattern here takes time in proportion to the text.
_TOKEN_RUN = re.compile(r"[A-Za-z0-9_.-]+")
_ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_BODY = re.compile(r"[A-Za-z0-9+/=\s:,.\\-]*")
#: Keys are no longer than this: RSA keys of 16,384 bits take 10 KB.
KEY_BYTES = 1 << 16
#: Line ends, also as the escapes of a quoted string.
_LINE_END = re.compile(r"(?:\\+r)?\\+n|\r\n?|\\+r")
#: A DER sequence in base64, either alphabet, and the first letters of an OpenSSH key.
_DER_START = re.compile(r"M[A-P][A-Za-z0-9+/_-]{6,}")
_OPENSSH_START = "b3BlbnNzaC1rZXktdjE"
#: Base64 without a break, and what may stand between two pieces of it: white space, escaped or not, and the escape of a slash.
_PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
_BREAK = re.compile(r"(?:\s|\\+[nrt]|\\+(?=[\s/]))+")
_PADDING = re.compile(r"={0,2}")
_INNER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_OPENSSH = b"openssh-key-v1\x00"


def decoded(text: str, url: bool = False) -> bytes | None:
    """The bytes of a base64 text, padding optional; None where it isn't one."""
    text = re.sub(r"\s+", "", text).rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> list | None:
    """The elements of DER bytes, [tag, content or nested elements]; None where lengths don't add up."""
    end, out = len(data) if end is None else end, []
    while start < end:
        if end - start < 2 or depth > 16:
            return None
        tag, length, start = data[start], data[start + 1], start + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or start + n > end or data[start] == 0:
                return None
            length, start = int.from_bytes(data[start : start + n], "big"), start + n
            if length < 0x80:
                return None
        if start + length > end:
            return None
        if tag & 0x20:
            inner = der(data, start, start + length, depth + 1)
            if inner is None:
                return None
            out.append([tag, inner])
        else:
            out.append([tag, data[start : start + length]])
        start += length
    return out


def is_key(data: bytes) -> bool:
    """Whether bytes are one DER sequence laid out as a key: RSA, DSA or EC private keys, PKCS#8, or a public key.

    What lies in the octet string of PKCS#8 or the bit string of a public key has to parse as well.
    """
    if len(data) < 24 or data[0] != 0x30 or not (tree := der(data)) or len(tree) != 1:
        return False
    parts = tree[0][1]
    tags = [x[0] for x in parts]
    if tags[:2] == [0x02, 0x04] or (len(tags) >= 6 and set(tags) == {0x02}):
        return True
    if tags[:3] == [0x02, 0x30, 0x04]:
        return bool(der(parts[2][1]))
    if tags == [0x30, 0x03] and parts[0][1] and parts[0][1][0][0] == 0x06:
        held = parts[1][1]
        return held[:1] == b"\0" and (held[1:2] != b"\x30" or bool(der(held[1:])))
    return False


def may_be_key(head: bytes) -> bool:
    """Whether a sequence may be a key by its first bytes: a version of 0 to 3, or an algorithm's sequence."""
    at = 2 + (head[1] & 0x7F if head[1] & 0x80 else 0)
    return (head[at : at + 2] == b"\x02\x01" and head[at + 2] <= 3) or (head[at] == 0x30 and head[at + 2] == 0x06) or (head[at] == 0x02)


def is_openssh(data: bytes) -> bool:
    """An OpenSSH key file: its magic, then three length-prefixed strings and a count within the data."""
    if not data.startswith(_OPENSSH):
        return False
    at = len(_OPENSSH)
    for _ in range(3):
        if at + 4 > len(data) or at + 4 + (n := int.from_bytes(data[at : at + 4], "big")) > len(data):
            return False
        at += 4 + n
    return at + 4 <= len(data)


def openssh_length(data: bytes) -> int | None:
    """The length of an OpenSSH key file at the start of data, from its own counts; None where it doesn't end there."""
    at, left = len(_OPENSSH), 3
    while left:
        if at + 4 > len(data):
            return None
        at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
    if at + 4 > len(data) or (left := int.from_bytes(data[at : at + 4], "big") + 1) > len(data):
        return None
    at += 4
    while left:
        if at + 4 > len(data):
            return None
        at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
    return at if at <= len(data) else None


def begins(text: str, start: int) -> bool:
    """Whether base64 may begin there: not within a run, but for the letter of an escape."""
    return start == 0 or text[start - 1] not in _INNER or (text[start - 2 : start - 1] == "\\" and text[start - 1] in "nrt")


class Chain:
    """The base64 letters from a place on, joined over breaks, in the standard alphabet; taken apart once for all keys within."""

    def __init__(self, text: str, start: int):
        self.starts, self.offsets, found, at, n = [], [], [], start, 0
        while m := _PIECE.match(text, at):
            self.starts.append(at)
            self.offsets.append(n)
            found.append(m[0])
            n, self.end = n + len(m[0]), m.end()
            gap = _BREAK.match(text, self.end)
            if not gap:
                break
            at = gap.end()
        self.letters = "".join(found).replace("-", "+").replace("_", "/")

    def offset(self, start: int) -> int:
        """The number of letters before a place in the text."""
        k = bisect_right(self.starts, start) - 1
        return self.offsets[k] + start - self.starts[k]

    def take(self, start: int, n: int) -> tuple[bytes | None, int]:
        """The bytes of n letters from a place in the text, and where the last ends; None where there are fewer."""
        at = self.offset(start)
        found = self.letters[at : at + n]
        if len(found) < n or n % 4 == 1:
            return None, start
        k = bisect_left(self.offsets, at + n) - 1
        return base64.b64decode(found + "=" * (-n % 4)), self.starts[k] + at + n - self.offsets[k]


def n_letters(size: int) -> int:
    return -(-4 * size // 3)


def base64_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of keys in base64, wrapped or not, in either alphabet; how far one goes is read from its own lengths."""
    out, done, chain, padded = [], 0, None, lambda end: _PADDING.match(text, end).end()
    for m in _DER_START.finditer(text):
        if m.start() < done or not begins(text, m.start()):
            continue
        head = decoded(m[0][:8].replace("-", "+").replace("_", "/"))
        wide = head[1] & 0x7F if head[1] & 0x80 else 0
        if wide > 4:
            continue
        size = 2 + wide + (int.from_bytes(head[2 : 2 + wide], "big") if wide else head[1])
        if not 24 <= size <= KEY_BYTES or n_letters(size) > len(text) - m.start():
            continue
        if chain is None or m.start() >= chain.end:
            chain = Chain(text, m.start())
        head, _ = chain.take(m.start(), 16)
        if not head or not may_be_key(head):
            continue
        data, end = chain.take(m.start(), n_letters(size))
        if data and is_key(data):
            out.append((m.start(), padded(end), "der"))
            done = end
    at, chain = text.find(_OPENSSH_START), None
    while at >= 0:
        if begins(text, at):
            if chain is None or at >= chain.end:
                chain = Chain(text, at)
            head, _ = chain.take(at, 28)
            if head and int.from_bytes(head[15:19], "big") <= 64:  # the length of a cipher's name
                held = len(chain.letters) - chain.offset(at)
                data, _ = chain.take(at, min(held, n_letters(KEY_BYTES)) // 4 * 4)
            else:
                data = None
            size, end = data and openssh_length(data), at
            if size:
                data, end = chain.take(at, n_letters(size))
            if data and end == at:  # cut short, or its last letters fill no four
                data, end = chain.take(at, len(_PIECE.match(text, at, at + n_letters(KEY_BYTES))[0]))
            if data and is_openssh(data):
                out.append((at, padded(end), "openssh"))
        at = text.find(_OPENSSH_START, at + 1)
    return out


def is_signed_token(text: str) -> bool:
    """Header and payload of a compact signed token are JSON objects, the header names an algorithm."""
    parts = text.split(".")
    try:
        head = json.loads(decoded(parts[0], url=True) or b"")
        if len(parts) != 3 or not isinstance(head, dict) or not isinstance(head.get("alg"), str):
            return False
        return isinstance(json.loads(decoded(parts[1], url=True) or b""), dict) and bool(decoded(parts[2], url=True))
    except (ValueError, RecursionError):
        return False


def token_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of signed tokens: three parts between dots, the header from the first or the last ``eyJ`` of its part on."""
    out = []
    for m in _TOKEN_RUN.finditer(text):
        if "eyJ" not in m[0]:
            continue
        parts, at, done = m[0].split("."), m.start(), 0
        for k, part in enumerate(parts):
            if k >= done and k + 2 < len(parts) and "eyJ" in part and parts[k + 1] and parts[k + 2]:
                rest = f".{parts[k + 1]}.{parts[k + 2]}"
                for begin in dict.fromkeys((part.find("eyJ"), part.rfind("eyJ"))):
                    if is_signed_token(part[begin:] + rest):
                        out.append((at + begin, at + len(part) + len(rest), "jwt"))
                        done = k + 3
                        break
            at += len(part) + 1
    return out


def armoured_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of keys between a BEGIN mark and the END mark next to it."""
    out, marks = [], list(_ARMOUR.finditer(text))
    for m, end in zip(marks, marks[1:]):
        if (m[1], end[1]) != ("BEGIN", "END") or m[2] != end[2] or not _BODY.fullmatch(text, m.end(), end.start()):
            continue
        body = _LINE_END.sub("\n", text[m.end() : end.start()]).replace("\\", "")
        data = decoded(re.split(r"\n[ \t]*\n", body)[-1] if ":" in body else body)
        if data and (is_key(data) or is_openssh(data) or "ENCRYPTED" in text[m.start() : end.start()] and der(data)):
            out.append((m.start(), end.end(), "pem"))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns; leftmost, without overlap within a kind; failing matches are dropped."""
    out = []
    if _ASSIGN_HINT.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what its structure confirms."""
    out = []
    if "eyJ" in text:
        out += token_spans(text)
    if "-----BEGIN" in text:
        out += armoured_spans(text)
    out += base64_spans(text)
    for m in _ANY_HEX.finditer(text):
        if m[0][:2] == "30" and is_key(bytes.fromhex(m[0])):
            out.append((m.start(), m.end(), "derhex"))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs (doc_id, text, ...).

    Spans are kind:start:end in code points, the end exclusive, by start, then kind in the
    order of KINDS.  A null or empty text has none.  Rows that repeat, or have no doc_id, are
    each returned; other columns are ignored; an empty table gives no rows.
    """

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base = base_spans(text or "")
            kinds = [s[2] for s in base]
            rows.append((doc_id, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + confirmed_spans(text or ""))))
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(columns)], [x.split()[0] for x in _SCHEMA.split(", ")])

    return arrow_map(documents(docs), f, _SCHEMA)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span replaced by a mark, overlapping spans by one."""
    out, at = [], 0
    for start, end, _ in sorted(base_spans(text) + confirmed_spans(text)):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs, its texts without secrets and n_chars, where there is one, set anew.

    Null texts stay null, with the n_chars that they had; empty ones stay empty.  Every row
    stays, also one that repeats or has no doc_id, with its other columns; an empty table
    gives no rows.
    """

    def run(batches):
        for batch in small(batches):
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([t and redacted(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
