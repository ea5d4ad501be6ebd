"""Secret scans with structural confirmation.

Patterns give the base findings. Beyond them, runs of base64 (in either alphabet, also over
several lines) or hex (in either case) are decoded and reported only where their structure confirms a secret: a token
whose header and claims are JSON with an algorithm and whose signature decodes, a private key whose nested DER lengths
add up, or an OpenSSH private key. What base findings decode to is told too.

Every pattern reads a run of characters once, or as far as a key can reach (LONGEST characters of base64, more than
16384-bit RSA takes), so that time grows with the text.

Edge cases: null and empty texts have no findings; findings are in code points; long texts are scanned whole; rows of
one id are scanned each; an empty table gives an empty table; columns of any name may stand beside, and are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
_WORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_JWT = re.compile(r"(?:(?<![A-Za-z0-9_-])|(?<=%[0-9A-Fa-f]{2}))(?=(eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++))eyJ")
_ANY_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{64,}+")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_URL_SAFE = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
#: White space, also as strings write it: backslashes and a letter.
_BREAK = r"(?:\s|\\+[nrt])+"
_BREAKS = re.compile(_BREAK)
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]++|\\+[nrt])++)-----END \1-----")
#: Where keys in base64 can begin: a DER sequence, or the magic of OpenSSH; and their lines, in either alphabet.
_MAGIC = "b3BlbnNzaC1r"
LONGEST = 1 << 15
_START = re.compile(rf"M(?=[A-Za-z0-9+/_-]{{15}})|{_MAGIC}")
_LINES = tuple(re.compile(rf"([{a}]+)(={{0,2}})({_BREAK})?") for a in ("A-Za-z0-9+/", "A-Za-z0-9+/_-"))

#: Object identifiers of key algorithms in DER: RSA, elliptic curve, Ed25519, X25519.
KEY_IDS = tuple(bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2b6570", "2b656e"))


def decode64(text: str) -> bytes | None:
    bare = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER values that fill data exactly; constructed ones must nest alike."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 0 < n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > len(data):
            return None
        body = data[at : at + size]
        if tag & 0x20 and (depth > 12 or der(body, depth + 1) is None):
            return None
        out.append((tag, body))
        at += size
    return out


def is_private_key(data: bytes) -> bool:
    """PKCS#8, PKCS#1 or SEC 1: a sequence that fills data, with the integers and identifiers of such keys."""
    top = der(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der(top[0][1]) or []
    tags = [t for t, _ in parts]
    if len(parts) >= 3 and tags[:3] == [2, 0x30, 4]:  # version, algorithm, key
        inner = der(parts[1][1]) or []
        return bool(inner) and inner[0][0] == 6 and inner[0][1] in KEY_IDS
    if len(parts) >= 9 and tags[:9] == [2] * 9:  # version, modulus, exponents, primes
        return len(parts[1][1]) >= 32
    return len(parts) >= 2 and tags[:2] == [2, 4] and parts[0][1] == b"\x01" and 16 <= len(parts[1][1]) <= 66


def is_ssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):  # cipher, key derivation, its options: lengths must nest
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and int.from_bytes(data[at : at + 4], "big") >= 1


def is_signed_token(text: str) -> bool:
    head, claims, signature = (decode64(x) for x in text.split("."))
    if not (head and claims and signature):
        return False
    try:
        h, c = json.loads(head), json.loads(claims)
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(c, dict) and isinstance(h.get("alg"), str)


def structure(text: str) -> str:
    """What a candidate decodes to: jwt, der, ssh, key (hex of a usual key size) or nothing."""
    if text.count(".") == 2 and text.startswith("eyJ") and is_signed_token(text):
        return "jwt"
    data = None
    if len(text) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", text):
        data = bytes.fromhex(text)
        if len(data) in (16, 20, 24, 32, 48, 64) and len(set(data)) > len(data) // 2:
            return "key"
    else:
        data = decode64(text)
    if data:
        if is_private_key(data):
            return "der"
        if is_ssh_key(data):
            return "ssh"
    return ""


def der_chars(head: bytes) -> int:
    """How many base64 characters a DER sequence takes that begins so, if it holds an integer first; else 0."""
    n, at = head[1], 2
    if n & 0x80:
        at += n & 0x7F
        if not 2 < at <= 6:
            return 0
        n = int.from_bytes(head[2:at], "big")
    return -(-(at + n) * 4 // 3) if head[at] == 2 else 0


def wrapped(text: str, at: int) -> tuple[int, int] | None:
    """(kind, end) of a key that begins here and may run over several lines. DER says its length; lines of OpenSSH keys
    have one width but for the first, which can follow something, and the last."""
    ssh = text.startswith(_MAGIC, at)
    want = LONGEST if ssh else der_chars(decode64(text[at : at + 16]))
    for line in _LINES if 0 < want <= LONGEST else ():
        parts, ends, pos, total = [], [], at, 0
        while total < want and (m := line.match(text, pos, min(len(text), pos + want - total + 64))):
            n, width = len(m[1]), len(parts[1]) if len(parts) > 1 else 0
            if ssh and parts and (width and n > width or m[1].startswith(_MAGIC)):
                break
            parts.append(m[1])
            ends.append(m.end(2))
            pos, total = m.end(), total + n
            if m[2] or m[3] is None or ssh and n < (width or len(parts[0])):
                break
        for k in (len(parts), len(parts) - 1) if ssh else (len(parts),) if total == want else ():
            data = decode64("".join(parts[:k]))
            if data and (is_ssh_key(data) if ssh else is_private_key(data)):
                return KINDS.index("ssh" if ssh else "der"), ends[k - 1]
    return None


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(base spans, further spans, how many base spans have a key's structure); a span is (start, kind, end)."""
    base, more, firm = [], [], 0
    if _WORD.search(text):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                base.append((m.start(), 0, m.end()))
                firm += bool(structure(m[2]))
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    for m in _HEX.finditer(text):
        base.append((m.start(), 2, m.end()))
        firm += bool(structure(m[0]))
    if "eyJ" in text:
        end = 0
        for m in _JWT.finditer(text):
            if m.start() >= end and is_signed_token(m[1]):
                more.append((m.start(), 3, end := m.end(1)))
    blocks = []
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            data = decode64(_BREAKS.sub("", m[2]))
            if data and (is_private_key(data) or is_ssh_key(data) or m[1].startswith("ENCRYPTED") and der(data)):
                more.append((m.start(), 4, m.end()))
                blocks.append((m.start(), m.end()))
    for m in _START.finditer(text):
        at = m.start()
        if at and (text[at - 1].isalnum() or text[at] == "b" and text[at - 1] in "+/") and text[max(0, at - 2) : at] not in ("\\n", "\\r", "\\t"):
            continue
        if not any(s <= at < e for s, e in blocks) and (found := wrapped(text, at)):
            more.append((at, *found))
            blocks.append((at, found[1]))
    for pattern in (_BASE64, _URL_SAFE) if "-" in text or "_" in text else (_BASE64,):
        for m in pattern.finditer(text):
            if pattern is _URL_SAFE and not ("-" in m[0] or "_" in m[0]) or any(s < m.end() and m.start() < e for s, e in blocks):
                continue
            found = structure(m[0])
            if found in ("der", "ssh"):
                more.append((m.start(), KINDS.index(found), m.end()))
                blocks.append(m.span())
    for m in _ANY_HEX.finditer(text):
        data = bytes.fromhex(m[0][: len(m[0]) // 2 * 2])
        if is_private_key(data) or is_ssh_key(data):
            more.append((m.start(), KINDS.index("ssh" if data[0] == 0x6F else "der"), m.end()))
    return sorted(base), sorted(more), firm


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: counts and digest of the base findings, and all spans."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for t in part[1].to_pylist():
                    base, more, firm = scan(t or "")
                    count = [sum(k == i for _, k, _ in base) for i in range(3)]
                    rows.append((*count, hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)), len(more), firm))
                columns = [pa.array(c) for c in zip(*rows)]
                yield pa.record_batch([part[0], *columns], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_structured", "n_confirmed"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_structured long, n_confirmed long")
