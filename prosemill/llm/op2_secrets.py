"""Secret scans with structural confirmation: patterns first, then what decodes and parses as a key or a signed token."""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import table

#: Base kinds, then those that the structure confirms; also the order of spans that start together.
BASE = ("assign", "access", "hex")
CONFIRMED = ("pem", "jwt", "der", "ssh")
ORDER = {k: i for i, k in enumerate(BASE + CONFIRMED)}

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_ESCAPED = re.compile(r"(?:\\+r)?\\+n|\\+r")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{32,}+={0,2}[ \t]*[\r\n]+[ \t]*)++(?:[A-Za-z0-9+/_-]++={0,2})?")
_SSH_LINE = "b3BlbnNzaC1rZXktdjEA"  #: how an OpenSSH key's mark begins in Base64
KEY_MOST = 24_576  #: bytes of a key at most: those of 32,768 bits in the longest of the forms
_LONG = 32  #: hex, Base64 and tokens have a run of so many characters without a blank


def _der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list[tuple[int, bytes, list]] | None:
    """Elements (tag, content, children) that fill ``data[at:end]`` exactly, or None: every nested length must fit."""
    end = len(data) if end is None else end
    out = []
    while at < end:
        if at + 2 > end or depth > 12:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 0x80:
                return None
        if at + n > end:
            return None
        children = _der(data, at, at + n, depth + 1) if tag & 0x20 else []
        if children is None:
            return None
        out.append((tag, data[at : at + n], children))
        at += n
    return out


def is_private_der(data: bytes) -> bool:
    """A whole DER private key: PKCS #1, SEC 1, PKCS #8, or PKCS #8 encrypted."""
    if len(data) < 24 or data[0] != 0x30 or not (top := _der(data)) or len(top) != 1:
        return False
    parts = top[0][2]
    tags = [t for t, _, _ in parts]
    if len(parts) >= 9 and tags[:9] == [2] * 9 and parts[0][1] in (b"\0", b"\1"):
        return True
    if len(parts) >= 2 and tags[:2] == [2, 4] and parts[0][1] == b"\1":
        return True
    named = lambda x: x[0] == 0x30 and bool(x[2]) and x[2][0][0] == 6
    if len(parts) >= 3 and tags[0] == 2 and parts[0][1] in (b"\0", b"\1") and named(parts[1]) and tags[2] == 4:
        return True
    return len(parts) == 2 and named(parts[0]) and tags[1] == 4 and len(parts[1][1]) >= 16


def is_openssh(data: bytes) -> bool:
    """An OpenSSH private key: its mark, three length-prefixed strings, a count, that many public keys and the private part."""
    mark = b"openssh-key-v1\0"
    if not data.startswith(mark):
        return False
    at = len(mark)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= count <= 16 and all(field() is not None for _ in range(count)) and bool(field())


def decoded(text: str) -> bytes | None:
    """Base64 in either alphabet, with or without padding."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """A JSON Web Token: header and payload are JSON objects, the header names its algorithm."""
    head, body, _ = text.split(".")
    try:
        h, b = json.loads(decoded(head) or b""), json.loads(decoded(body) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(b, dict)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind; a match that is too short is dropped, and what it took stays taken."""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _has_long(text):
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def _has_long(text: str) -> bool:
    return max(map(len, text.split()), default=0) >= _LONG


def _unescaped(text: str) -> str:
    """Line breaks for the literal ``\\n`` and ``\\r`` of JSON and shell strings, at the same length."""
    return _ESCAPED.sub(lambda m: " " * (len(m[0]) - 1) + "\n", text) if "\\" in text else text


def _kind(data: bytes | None, depth: int) -> str | None:
    """What decoded bytes are, if a key: DER, an OpenSSH key, or text with a confirmed PEM, which may be encoded once more."""
    if not data:
        return None
    if data[0] == 0x30 and is_private_der(data):
        return "der"
    if is_openssh(data):
        return "ssh"
    if depth < 2 and any(k == "pem" for k, _, _ in confirmed_spans(data.decode("latin-1"), depth + 1)):
        return "pem"
    return None


def _wrapped(text: str, depth: int) -> Iterator[tuple[str, int, int]]:
    """Keys in Base64 over several lines. A DER key ends where its own length says, an OpenSSH key with the lines of one width; other lines of one
    width are decoded once, as a text that may hold a PEM. A key is looked for within ``KEY_MOST`` bytes, so work is linear in the lines."""
    for m in _WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end(), x[0]) for x in _RUN.finditer(m[0])]
        flat = "".join(x[2].rstrip("=") for x in lines)
        upto = [0]
        for _, _, line in lines:
            upto.append(upto[-1] + len(line.rstrip("=")))
        where = {n: i for i, n in enumerate(upto)}
        last = list(range(len(lines)))  # the last line of the same width, for each line
        for i in range(len(lines) - 2, -1, -1):
            if len(lines[i][2]) == len(lines[i + 1][2]) and "=" not in lines[i][2]:
                last[i] = last[i + 1]

        def ends(i: int) -> tuple[int, ...]:
            """Behind a shorter line that follows the lines of one width, and before it."""
            to = last[i] + 1
            short = to < len(lines) and len(lines[to][2]) < len(lines[to - 1][2]) and "=" not in lines[to - 1][2]
            return (to + 1, to) if short else (to,)

        done = searched = 0  # lines that are taken, and lines that were decoded as text
        for i in range(len(lines) - 1):
            if i < done:
                continue
            line, found = lines[i][2], None
            if line[0] == "M":
                head = decoded(line[:8]) or b""
                k = head[1] & 0x7F if head[1] & 0x80 else 0
                total = 2 + k + int.from_bytes(head[2 : 2 + k], "big") if k else 2 + head[1]
                end = where.get(upto[i] + total // 3 * 4 + (0, 2, 3)[total % 3]) if total <= KEY_MOST else None
                if end is not None and end > i + 1 and is_private_der(decoded(flat[upto[i] : upto[end]]) or b""):
                    found = ("der", end)
            elif line.startswith(_SSH_LINE):
                found = next((("ssh", end) for end in ends(i) if is_openssh(decoded(flat[upto[i] : min(upto[end], upto[i] + KEY_MOST // 3 * 4)]) or b"")), None)
            if not found and i >= searched and "=" not in line:
                searched = last[i] + 1
                found = next((("pem", end) for end in ends(i) if end > i + 1 and _kind(decoded(flat[upto[i] : upto[end]]), depth) == "pem"), None)
            if found:
                yield found[0], lines[i][0], lines[found[1] - 1][1]
                done = found[1]


def confirmed_spans(text: str, depth: int = 0) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    text = _unescaped(text)
    if "-----BEGIN" in text:
        begin = None
        for m in _MARK.finditer(text):
            # A key ends at the next mark: one that begins another key leaves it without an end.
            if m[1] == "BEGIN" or begin is None or begin[2] != m[2]:
                begin = m if m[1] == "BEGIN" else None
                continue
            start, at, end, begin = begin.start(), begin.end(), m, None
            # Headers of old encrypted keys end with an empty line.
            body = text[at : end.start()].replace("\r\n", "\n").replace("\\/", "/")
            key = decoded("".join(re.split(r"\n[ \t]*\n", body.rstrip())[-1].split()))
            if key and (is_private_der(key) or is_openssh(key) or "Proc-Type:" in body and len(key) % 8 == 0):
                out.append(("pem", start, end.end()))
    if _has_long(text):
        out += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
        pems = [x for x in out if x[0] == "pem"]
        for m in _BASE64.finditer(text):
            if kind := _kind(decoded(m[0]), depth):
                out.append((kind, *m.span()))
        # The lines of a PEM are that PEM.
        starts = [a for _, a, _ in pems]
        for x in _wrapped(text, depth):
            k = bisect.bisect_right(starts, x[1]) - 1
            if k < 0 or x[2] > pems[k][2]:
                out.append(x)
        for m in _ANY_HEX.finditer(text):
            if kind := _kind(bytes.fromhex(m[0]), depth):
                out.append((kind, *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2])))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) for every row: spans of (kind, start, end) in code points, end exclusive, by start and then kind.

    A null text is an empty one and has no spans. Rows that repeat an id or have none stay rows of their own; other columns are
    ignored; an empty table gives no rows. Work on a text is linear in its length: patterns run only where a cheap test finds what they need, and keys
    are looked for within ``KEY_MOST`` bytes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = []
            for value in batch.column(1):
                t = value.as_py() or ""
                spans = sorted(base_spans(t) + confirmed_spans(t), key=lambda s: (s[1], ORDER[s[0]], s[2]))
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents, counted and digested."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
