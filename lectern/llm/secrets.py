"""Secret scan: patterns propose, and decoding of their structure confirms what it can."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import batch, blocks, map_arrow, texts

#: In the order in which spans with the same start are listed. The first three are patterns alone;
#: the others are reported only when their content decodes and parses.
KINDS = ("assign", "access", "hex", "pem", "jwt", "key64", "keyhex", "ssh")
BLOCK_BYTES = 8 << 20

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Armour whose body is base64 with white space, line ends as escapes (``\n`` inside a JSON string), and header lines.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}?PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nrt]|(?:Proc-Type|DEK-Info|Comment):[^\n\\]*+)+?)-----END \1-----")
_HEADER = re.compile(r"(?:Proc-Type|DEK-Info|Comment):[^\n\\]*")
_ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED[\s\S]*DEK-Info:\s*[A-Z0-9-]+,\s*([0-9A-Fa-f]{16,32})\b")
#: Three parts; the first is base64 of a JSON object, so of "{" and white space or a quotation mark.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[w-y][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: Shortest base64 and hexadecimal runs that are decoded: of the smallest key the parsers accept, 23 bytes of SEC1 with 16 of key.
LEAST_BYTES = 23
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-Za-z0-9+/_-]{%d,}={0,2}|(?<![A-Za-z0-9+/_-])b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/_-]{44,}={0,2}" % (-(-LEAST_BYTES * 4 // 3) - 1))
_ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:30|6[fF]70656[eE]737368)[0-9A-Fa-f]{%d,}(?![0-9A-Za-z])" % (2 * LEAST_BYTES - 2))
#: Base64 wrapped over lines without armour: full lines of one width from 60 to 76, then a shorter one.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?=M|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/]{60,76}(?:\r?\n[A-Za-z0-9+/]{1,76}={0,2})+(?![A-Za-z0-9+/=])")
_OPENSSH = b"openssh-key-v1\x00"
#: DER of the algorithm identifiers that a PKCS#8 key can name: RSA, EC, Ed25519, Ed448, X25519, X448, DSA.
_ALGORITHMS = tuple(bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2b6570", "2b6571", "2b656e", "2b656f", "2a8648ce380401"))


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the element at ``at``; None unless its length is well-formed and fits."""
    if at + 2 > end:
        return None
    tag, first = data[at], data[at + 1]
    at += 2
    if first < 0x80:
        size = first
    else:
        k = first & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + k], "big"), at + k
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        if (x := _der(data, at, end)) is None:
            return None
        out.append(x)
        at = x[2]
    return out


def private_key_der(data: bytes) -> str | None:
    """Which private-key structure the bytes are: nested lengths must fill each other exactly."""
    top = _der(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return None
    inner = _children(data, top[1], top[2])
    if not inner or len(inner) < 2:
        return None
    tags = [x[0] for x in inner]
    part = [data[a:b] for _, a, b in inner]
    if tags[0] == 2 and part[0] in (b"\0", b"\1"):
        if len(tags) >= 9 and all(t == 2 for t in tags[:9]) and len(part[1]) >= 33:
            return "rsa"
        if tags[:3] == [2, 0x30, 4]:
            named = _children(data, inner[1][1], inner[1][2])
            if named and named[0][0] == 6 and data[named[0][1] : named[0][2]] in _ALGORITHMS:
                return "pkcs8"
        if tags[:2] == [2, 4] and part[0] == b"\1" and 16 <= len(part[1]) <= 72:
            return "ec"
        if len(tags) == 6 and all(t == 2 for t in tags) and len(part[1]) >= 33:
            return "dsa"
    if tags == [0x30, 4] and len(part[1]) >= 32:
        named = _children(data, inner[0][1], inner[0][2])
        if named and named[0][0] == 6 and data[named[0][1] : named[0][2]].startswith((bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))):
            return "encrypted"
    return None


def private_key_openssh(data: bytes) -> bool:
    """Magic, then length-prefixed cipher, kdf and options, the number of keys, public and private parts that fill the rest."""
    if not data.startswith(_OPENSSH):
        return False
    at = len(_OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    cipher, kdf, options = field(), field(), field()
    if cipher is None or kdf is None or options is None or not cipher.isascii():
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 16:
        return False
    for _ in range(count):
        if not (blob := field()) or int.from_bytes(blob[:4], "big") + 4 > len(blob):
            return False
    return bool(field()) and at == len(data)


def _decode64(text: str) -> bytes | None:
    text = "".join(text.split()).rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text.translate({45: 43, 95: 47}) + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(header: str, payload: str) -> bool:
    """Whether the header is a JSON object that names an algorithm and the payload a JSON object."""
    try:
        head, body = (json.loads(_decode64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _is_key(data: bytes | None) -> bool:
    return bool(data) and (private_key_der(data) is not None or private_key_openssh(data))


def pem_body(body: str) -> bool:
    """Whether the text between the armour lines decodes to a key; with headers that say so, to whole cipher blocks."""
    plain = re.sub(r"\\[nrt]", "\n", body)
    data = _decode64(_HEADER.sub("", plain))
    if _is_key(data):
        return True
    named = _ENCRYPTED.search(plain)
    block = len(named[1]) // 2 if named else 0
    return bool(data) and block in (8, 16) and len(data) % block == 0


def _structured(text: str) -> Iterator[tuple[int, int, str]]:
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            if pem_body(m[2]):
                yield m.start(), m.end(), "pem"
    if "." in text:
        for m in _JWT.finditer(text):
            if signed_token(m[1], m[2]):
                yield m.start(), m.end(), "jwt"
    for m in _WRAPPED.finditer(text):
        lines = m[0].split()
        # A key ends where its own length says, which may be some lines before the run does.
        for k in range(len(lines), 1, -1):
            if len({len(x) for x in lines[: k - 1]}) == 1 and len(lines[k - 1]) <= len(lines[0]) and _is_key(data := _decode64("".join(lines[:k]))):
                end = m.start() + re.match(r"(?:\S+\s+){%d}\S+" % (k - 1), m[0]).end()
                yield m.start(), end, "ssh" if private_key_openssh(data) else "key64"
                break
    for m in _BASE64.finditer(text):
        data = _decode64(m[0])
        if data and private_key_der(data):
            yield m.start(), m.end(), "key64"
        elif data and private_key_openssh(data):
            yield m.start(), m.end(), "ssh"
    for m in _ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and _is_key(bytes.fromhex(m[0])):
            yield m.start(), m.end(), "keyhex"


def secret_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and base with confirmed spans: (start, end, kind) in code points, by start and kind."""
    base = []
    if ":" in text or "=" in text:
        base += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    order = lambda x: (x[0], KINDS.index(x[2]))
    base.sort(key=order)
    return base, sorted([*base, *_structured(text)], key=order)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    The three base kinds are found by pattern alone. Structural confirmation adds spans: PEM blocks,
    base64 and hexadecimal runs (base64 also wrapped over lines) count only if they decode to a
    private key whose nested lengths fill each other, encrypted PEM only if its headers name a cipher
    whose blocks the body fills, three-part tokens only if their header names an algorithm. Spans of several kinds
    may overlap. ``spans`` lists all as kind:start:end, ``base_sha256`` hashes the list of base
    spans. A null or empty text has no spans (an empty list is hashed); repeated rows give repeated
    rows, an empty input gives none, and other columns are ignored. Nothing is shuffled.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        for b in blocks(batches, "text", BLOCK_BYTES):
            found = [secret_spans(t) for t in b.column(1).to_pylist()]
            counts = {f"n_{k}": pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:3]}
            yield batch(doc_id=b.column(0), **counts, base_sha256=pa.array([hashlib.sha256(said(base).encode()).hexdigest() for base, _ in found], pa.string()), spans=pa.array([said(every) for _, every in found], pa.string()))

    return map_arrow(texts(docs, id_col, text_col), scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
