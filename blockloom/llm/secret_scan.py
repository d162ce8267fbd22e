"""Secret scans: patterns first, then proof by structure.

Three patterns find assignments, access keys and long hex runs. What only looks like random letters is
reported when its bytes prove it: base64 and hex candidates are decoded, and a span is added where the
bytes parse as a key (DER with nested lengths that fill each other exactly, or the length-prefixed fields of
an OpenSSH key), or where a dotted token's first part is a JSON header that names its algorithm. An encoded
text is decoded again, and searched like the outer one. The declared lengths say where a key ends, so
line breaks, blanks and escaped line breaks inside it do no harm, and random text of the right alphabet is
not reported.

Null text counts as empty and has no spans. Texts are scanned whole, one by one: repeated rows and null ids
pass through unchanged, an empty table gives an empty result, and columns other than the two named are not
read, whatever their names. Spans are in code points with the end exclusive; of equal starts the
kind listed first in KINDS comes first, then the shorter span.
"""

from __future__ import annotations

import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import quoted, slices

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "private_key", "ssh_key", "signed_token")
LEAST_VALUE = 6  # characters of an assigned value

ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

# Where structure may begin. A DER sequence is byte 0x30 and a length; `openssh-key-v1` names itself.
DER_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-I][A-Za-z0-9+/_-]{14,}")
DER_HEX = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-7][0-9A-Fa-f]|8[1-3])[0-9A-Fa-f]{44,}")
SSH_MAGIC, SSH_START = b"openssh-key-v1\0", "b3BlbnNzaC1rZXktdjE"
SSH_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-]){SSH_START}[A-Za-z0-9+/_-]+")
ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )?PRIVATE KEY)-----")
PASSPHRASE = re.compile(r"\s*Proc-Type: 4,ENCRYPTED\s+DEK-Info: [A-Z0-9-]+,[0-9A-F]+\s+([A-Za-z0-9+/\s]+=*)\s*")
SIGNED = re.compile(
    r"(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]{7,})\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(?:\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+))?"
)
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{64,}={0,2}")
ENCODED_HEX = re.compile(r"[0-9A-Fa-f]{96,}")
RUN = re.compile(r"([A-Za-z0-9+/_-]+)|(?:\\r|\\n|[\r\n\t ])+")
BREAKS = re.compile(r"(?:\\r|\\n|\s)*")
FOLLOWS = re.compile(r"[A-Za-z0-9+/_-]")

SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06
#: Object identifiers of password-based encryption and of a key store's content.
PBE_OIDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
STORE_OID = bytes.fromhex("2a864886f70d0107")

Span = tuple[int, int, str]


def base64_bytes(chars: str) -> bytes | None:
    """Decoded characters of either base64 alphabet, unpadded; None where they are no encoding."""
    if len(chars) % 4 == 1:
        return None
    plain = chars.replace("-", "+").replace("_", "/")
    try:
        return binascii.a2b_base64(plain + "=" * (-len(plain) % 4))
    except binascii.Error:
        return None


class Base64At:
    """Bytes of the base64 text that starts at a place, decoded only as far as they are asked for."""

    def __init__(self, text: str, at: int):
        self._text, self._next, self._chars, self._have = text, at, [], 0
        self._ends: list[int] = []  # text position after the pieces so far

    def take(self, n: int) -> bytes | None:
        """The first n bytes, or None when the text ends before."""
        wanted = (4 * n + 2) // 3
        while self._have < wanted:
            run = RUN.match(self._text, self._next)
            if run is None:
                return None
            self._next = run.end()
            if run[1]:
                self._chars.append(run[1])
                self._have += len(run[1])
                self._ends.append(self._next)
        data = base64_bytes("".join(self._chars)[: wanted + -wanted % 4])
        return None if data is None else data[:n]

    def end(self, n: int) -> int | None:
        """Where the text of exactly n bytes ends, padding included; None when the last run goes on."""
        left = self._have - (4 * n + 2) // 3
        if left:
            return None
        at = self._ends[-1]
        padding = -n % 3
        while padding and self._text.startswith("=", at):
            at, padding = at + 1, padding - 1
        return None if FOLLOWS.match(self._text, at) else at


class HexAt:
    """The same for hex digits in one run."""

    def __init__(self, run: str, at: int):
        self._run, self._at = run, at

    def take(self, n: int) -> bytes | None:
        return bytes.fromhex(self._run[: 2 * n]) if 2 * n <= len(self._run) else None

    def end(self, n: int) -> int | None:
        return self._at + 2 * n if 2 * n == len(self._run) else None


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the DER element at a place, if it ends by `end`."""
    if at + 2 > end:
        return None
    tag, length, start = data[at], data[at + 1], at + 2
    if length >= 0x80:
        width = length & 0x7F
        if not 1 <= width <= 4 or start + width > end:
            return None
        length, start = int.from_bytes(data[start : start + width], "big"), start + width
    return (tag, start, start + length) if start + length <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a range exactly; None when lengths do not add up."""
    found = []
    while at < end:
        one = element(data, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def is_key(data: bytes) -> bool:
    """Whether DER bytes are a private key or a key store, all nested lengths agreeing."""
    top = element(data, 0, len(data))
    if top is None or top[0] != SEQUENCE or top[2] != len(data):
        return False
    parts = elements(data, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags = [tag for tag, _, _ in parts]
    body = [data[start:end] for _, start, end in parts]

    def names(at: int) -> bytes | None:
        """The identifier at the start of a nested sequence."""
        if tags[at] != SEQUENCE:
            return None
        inner = elements(data, *parts[at][1:])
        return data[inner[0][1] : inner[0][2]] if inner and inner[0][0] == OID else None

    if tags[0] == SEQUENCE:  # an encrypted key names how it was encrypted
        return len(parts) == 2 and tags[1] == OCTETS and bool(body[1]) and (names(0) or b"").startswith(PBE_OIDS)
    if tags[0] != INTEGER or len(body[0]) != 1:
        return False
    version = body[0][0]
    if version == 0 and len(parts) in (6, 9) and set(tags) == {INTEGER}:  # numbers of a key, modulus first
        return len(body[1]) >= 32
    if version in (0, 1) and len(parts) >= 3 and tags[2] == OCTETS and names(1):  # algorithm and wrapped key
        return len(body[2]) >= 16
    if version == 1 and tags[1] == OCTETS and 16 <= len(body[1]) <= 66:  # a number on a curve
        return set(tags[2:]) <= {0xA0, 0xA1}
    return version == 3 and (names(1) or b"").startswith(STORE_OID)


def der_end(source: Base64At | HexAt) -> int | None:
    """Text position after the key that starts here, as long as its header says; None if it is none."""
    head = source.take(6)
    if head is None or head[0] != SEQUENCE:
        return None
    width = head[1] & 0x7F if head[1] >= 0x80 else 0
    if width > 3:
        return None
    inner = head[2 + width] if 2 + width < 6 else None
    if inner not in (INTEGER, SEQUENCE):
        return None
    total = 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])
    data = source.take(total)
    return source.end(total) if data is not None and is_key(data) else None


def ssh_end(source: Base64At) -> int | None:
    """The same for an OpenSSH key: cipher, key derivation, its options, public keys, private part."""
    at = len(SSH_MAGIC)
    if source.take(at) != SSH_MAGIC:
        return None

    def number() -> int | None:
        data = source.take(at + 4)
        return None if data is None else int.from_bytes(data[at:], "big")

    fields, keys = 3, 0
    while fields:
        length = number()
        if length is None or source.take(at + 4 + length) is None:
            return None
        at, fields = at + 4 + length, fields - 1
        if not fields and not keys:
            keys = number() or 0
            if not 1 <= keys <= 64:
                return None
            at, fields = at + 4, keys + 1
    return source.end(at)


def is_signed(header: str, parts: list[str]) -> bool:
    """Whether a token's header is JSON that names an algorithm and its parts are what that needs."""
    raw = base64_bytes(header)
    try:
        told = json.loads(raw.decode()) if raw else None
    except (ValueError, RecursionError):
        return False
    if not isinstance(told, dict) or not isinstance(told.get("alg"), str):
        return False
    if len(parts) == 4:
        return isinstance(told.get("enc"), str) and all(base64_bytes(p) is not None for p in parts)
    payload, signature = parts
    signed = bool(signature) or told["alg"].lower() == "none"
    return bool(payload) and signed and base64_bytes(payload) is not None and base64_bytes(signature) is not None


def armoured(text: str) -> Iterator[Span]:
    """Keys between BEGIN and END lines, confirmed by what lies between them."""
    for begin in ARMOUR.finditer(text):
        locked = PASSPHRASE.match(text, begin.end())
        kind = "private_key"
        if locked:
            data = base64_bytes("".join(locked[1].split()).rstrip("="))
            end = locked.end() if data and len(data) % 8 == 0 else None
        else:
            at = BREAKS.match(text, begin.end()).end()
            if text.startswith(SSH_START, at):
                kind, end = "ssh_key", ssh_end(Base64At(text, at))
            else:
                end = der_end(Base64At(text, at))
        if end is not None:
            tail, close = BREAKS.match(text, end).end(), f"-----END {begin[1]}-----"
            if text.startswith(close, tail):
                yield begin.start(), tail + len(close), kind


def confirmed(text: str) -> list[Span]:
    """Spans of `text` that decoding and parsing prove to be secrets, without those inside another's."""
    found: list[Span] = list(armoured(text)) if "-----BEGIN " in text else []

    def add(start: int, end: int | None, kind: str) -> None:
        if end is not None:
            found.append((start, end, kind))

    for m in SSH_BASE64.finditer(text):
        add(m.start(), ssh_end(Base64At(text, m.start())), "ssh_key")
    for m in DER_BASE64.finditer(text):
        add(m.start(), der_end(Base64At(text, m.start())), "private_key")
    for m in DER_HEX.finditer(text):
        add(m.start(), der_end(HexAt(m[0], m.start())), "private_key")
    for m in SIGNED.finditer(text):
        header, *parts = [p for p in m.groups() if p is not None]
        if is_signed(header, parts):
            add(m.start(), m.end(), "signed_token")
        elif len(parts) == 4 and is_signed(header, parts[:2]):
            add(m.start(), m.end(3), "signed_token")
    for pattern, decode in ((ENCODED, _base64_text), (ENCODED_HEX, _hex_text)):
        for m in pattern.finditer(text):
            if inner := confirmed(decode(m[0])):
                add(m.start(), m.end(), inner[0][2])
    outer, reach = [], -1
    for span in sorted(found, key=lambda s: (s[0], -s[1])):
        if span[1] > reach:
            outer.append(span)
            reach = span[1]
    return outer


def _base64_text(run: str) -> str:
    return (base64_bytes(run.rstrip("=")) or b"").decode("latin-1")


def _hex_text(digits: str) -> str:
    return "" if len(digits) % 2 else bytes.fromhex(digits).decode("latin-1")


def find_secrets(text: str | None) -> list[Span]:
    """(start, end, kind) of every secret, by start and then by kind as listed."""
    if not text:
        return []
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found += confirmed(text)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): the secrets of every row as an array of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [
                [{"kind": k, "start": a, "end": b} for a, b, k in find_secrets(text)]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    narrow = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    out = narrow.mapInArrow(run, f"id {id_type}, spans array<struct<kind: string, start: bigint, end: bigint>>")
    return out.select(F.col("id").alias(id_col), "spans")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
