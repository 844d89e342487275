"""Secret scan of whole texts: pattern kinds, and keys and tokens that are confirmed by their structure.

Base kinds are plain patterns. The method then decodes base64, base64url and hex candidates and
reports those only whose bytes parse: nested DER lengths of a private key, length-prefixed fields
of an OpenSSH key, or a signed token whose header and payload are JSON and whose signature has the
size that the header's algorithm asks for. A key says its own length, so it is found at every place
of a run, whatever letters it is glued to on either side; of nested keys the outer one is reported.
Spans count code points; the end is exclusive.

Defined results: null and empty texts have no spans; a base span is never dropped because a
structural span covers it; repeated rows are scanned alike.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, utf8

BASE_KINDS = ("assign", "access", "hex")
#: Kinds that are confirmed by structure, in report order after the base ones.
PROVEN_KINDS = ("pem_key", "der_key", "der_hex", "ssh_key", "signed_token")
KINDS = BASE_KINDS + PROVEN_KINDS
SPANS_TYPE = "array<struct<kind:string,start:int,end:int>>"
MASK = "[SECRET]"

_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(rb"[0-9a-f]{16,}")
#: The least key that is accepted has 23 bytes: 31 letters without padding.
_LONG_RUN = re.compile(rb"([A-Za-z0-9+/_-]{31,})={0,2}")
_HEX_RUN = re.compile(rb"[0-9A-Fa-f]{46,}")
#: Places where a DER SEQUENCE may begin: 0x30 is M and a letter with two leading zero bits.
_DER_BEGIN = re.compile(rb"M(?=[A-P])")
_DER_HEX_BEGIN = re.compile(rb"(?=30(?:[0-7].|81..|82.{4}|83.{6}|84.{8})(?:02010[01]|30))30")
_SSH_BEGIN = re.compile(rb"b3BlbnNzaC1rZXktdjEA")
_PEM = re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----([A-Za-z0-9+/=\s\\n]*?)-----END \1PRIVATE KEY-----")
_TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")

#: Signature bytes by algorithm of a signed token (RS and PS: at least).
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
_SIGNATURE_LEAST = {"RS": 128, "PS": 128}
_SEQUENCE, _INTEGER, _OCTETS, _OBJECT_ID = 0x30, 0x02, 0x04, 0x06


def _unbase64(raw: bytes) -> bytes | None:
    raw = raw.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    try:
        return base64.b64decode(raw + b"=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _letters(run: bytes) -> bytes:
    """Bytes of base64 or base64url letters; a last letter alone holds no byte."""
    return _unbase64(run[: len(run) - (len(run) % 4 == 1)]) or b""


def _nibbles(run: bytes) -> bytes:
    return binascii.unhexlify(run[: len(run) // 2 * 2])


def _element(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, begin, end) of the DER element at `at`, if its length is minimal and fits."""
    if at + 2 > len(data):
        return None
    tag, n, begin = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or begin + size > len(data) or data[begin] == 0:
            return None
        n, begin = int.from_bytes(data[begin : begin + size], "big"), begin + size
        if n < 128:
            return None
    return (tag, begin, begin + n) if begin + n <= len(data) else None


def _children(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while begin < end:
        child = _element(data, begin)
        if child is None or child[2] > end:
            return None
        out.append(child)
        begin = child[2]
    return out


def _der_end(data: bytes, at: int) -> int | None:
    """End of the private key that begins at `at`, if all its nested lengths fit."""
    top = _element(data, at)
    if top is None or top[0] != _SEQUENCE or data[top[1] : top[1] + 1] not in (b"\x02", b"\x30"):
        return None
    parts = _children(data, top[1], top[2])
    if not parts:
        return None
    tags = [t for t, _, _ in parts]
    if tags[0] == _SEQUENCE and tags == [_SEQUENCE, _OCTETS]:
        inner = _children(data, *parts[0][1:])
        return top[2] if inner and inner[0][0] == _OBJECT_ID and parts[1][2] - parts[1][1] >= 16 else None
    if tags[0] != _INTEGER or parts[0][2] - parts[0][1] != 1:
        return None
    version = data[parts[0][1]]
    if version in (0, 1) and len(tags) >= 9 and set(tags[:9]) == {_INTEGER}:
        return top[2] if parts[1][2] - parts[1][1] >= 32 else None
    if version in (0, 1) and tags[1:3] == [_SEQUENCE, _OCTETS]:
        inner = _children(data, *parts[1][1:])
        return top[2] if inner and inner[0][0] == _OBJECT_ID else None
    if version == 1 and len(tags) >= 2 and tags[1] == _OCTETS and 16 <= parts[1][2] - parts[1][1] <= 66:
        return top[2]
    return None


def is_der_key(data: bytes) -> bool:
    """Is this a PKCS#1, PKCS#8, encrypted PKCS#8 or SEC 1 private key, all nested lengths fitting?"""
    return _der_end(data, 0) == len(data)


def _ssh_end(data: bytes, at: int) -> int | None:
    """End of the OpenSSH private key container that begins at `at`, if its length-prefixed fields fit."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic, at):
        return None
    at, fields = at + len(magic), []
    for _ in range(3):
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    if at + 4 > len(data) or not fields[0].isascii() or not fields[0]:
        return None
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return None
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else None


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key container whose length-prefixed fields fill it."""
    return _ssh_end(data, 0) == len(data)


def _keys_in(run: bytes, begin: re.Pattern, end_of: Callable[[bytes, int], int | None], letters: int, size: int, decode: Callable[[bytes], bytes]) -> Iterator[tuple[int, int]]:
    """Spans of keys at any place of a run, leftmost first; `size` bytes take `letters` letters.

    The run is decoded once for each way in which places can lie to groups of letters.
    """
    decoded: dict[int, bytes] = {}
    done = 0
    for m in begin.finditer(run):
        a = m.start()
        if a < done:
            continue
        phase = a % letters
        if phase not in decoded:
            decoded[phase] = decode(run[phase:])
        at = a // letters * size
        end = end_of(decoded[phase], at)
        if end is not None:
            done = a - (at - end) * letters // size  # rounded up
            yield a, done


def is_signed_token(header: bytes, payload: bytes, signature: bytes) -> bool:
    head, body, sign = _unbase64(header), _unbase64(payload), _unbase64(signature)
    try:
        head, body = json.loads(head or b""), json.loads(body or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str) or sign is None:
        return False
    name = head["alg"]
    if name in _SIGNATURE:
        return len(sign) == _SIGNATURE[name]
    return len(sign) >= _SIGNATURE_LEAST.get(name[:2], 1) and name != "none"


def _proven(text: bytes) -> Iterator[tuple[str, int, int]]:
    if b"-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = _unbase64(re.sub(rb"\s|\\n", b"", m[2]))
            if data and (is_der_key(data) or is_ssh_key(data)):
                yield "pem_key", *m.span()
    if b"eyJ" in text:
        for m in _TOKEN.finditer(text):
            if is_signed_token(*m.groups()):
                yield "signed_token", *m.span()
    for m in _LONG_RUN.finditer(text):
        for kind, begin, end_of in (("der_key", _DER_BEGIN, _der_end), ("ssh_key", _SSH_BEGIN, _ssh_end)):
            for a, b in _keys_in(m[1], begin, end_of, 4, 3, _letters):
                # Padding belongs to the key that it follows.
                yield kind, m.start() + a, m.end() if m.start() + b == m.end(1) else m.start() + b
    for m in _HEX_RUN.finditer(text):
        for a, b in _keys_in(m[0].lower(), _DER_HEX_BEGIN, _der_end, 2, 1, _nibbles):
            yield "der_hex", m.start() + a, m.start() + b


def find(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one UTF-8 text in code points, by start, then kind as in KINDS."""
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found += _proven(text)
    if found and not text.isascii():
        ends = sorted({x for _, a, b in found for x in (a, b)})
        place, done, points = {}, 0, 0
        for x in ends:
            points += len(text[done:x].decode())
            place[x] = points
            done = x
        found = [(k, place[a], place[b]) for k, a, b in found]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def _span_array(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found],
                    pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, spans): every span of every whole text, by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            spans = _span_array([find(t) for t in utf8(part.column("text"))])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), spans], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {SPANS_TYPE}")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by MASK."""
    out, at, open_end = [], 0, -1
    for _, a, b in spans:
        if a >= open_end:
            out += [text[at:a] if at <= a else "", MASK]
        open_end = max(open_end, b)
        at = open_end
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns; spans of `text` are masked, and `n_chars`, if there, is counted anew.

    Rows without spans are returned untouched, null texts too.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = utf8(part.column("text"))
            columns = {n: part.column(n) for n in names}
            spans = [find(t) for t in texts]
            if any(spans):
                old = part.column("text").to_pylist()
                new = [masked(t, s) if s else t for t, s in zip(old, spans, strict=True)]
                columns["text"] = pa.array(new, pa.string())
                if "n_chars" in columns:
                    kind = columns["n_chars"].type
                    counts = zip(columns["n_chars"].to_pylist(), new, spans, strict=True)
                    columns["n_chars"] = pa.array([len(t) if s else n for n, t, s in counts], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return docs.mapInArrow(run, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and digests of the spans that scan() gave."""
    spans = F.col("spans")

    def of(*kinds: str) -> Column:
        return F.filter(spans, lambda s: s["kind"].isin(*kinds))

    return scanned.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(of(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )
