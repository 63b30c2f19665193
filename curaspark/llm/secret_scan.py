"""Secret scans with structural confirmation.

Plain patterns give the base spans: assignments, access key ids and hexadecimal runs. What looks like base64 or hex is
then decoded, and reported as a key only if its bytes parse: nested DER lengths that fill their parents exactly and the
field order of a private key, the length-prefixed fields of an OpenSSH key file, or the JSON header and payload of a
signed token. Kinds that the decoded bytes confirm:

- ``pkcs1``, ``pkcs8``, ``pkcs8_encrypted``, ``sec1``: private keys in DER, in base64 or hex (also after 0x), bare or in a PEM block
- ``openssh``: an OpenSSH private key file, bare or in a PEM block

Bare keys may be wrapped over consecutive lines, and line breaks may be escapes, as in JSON.
- ``signed_token``: three base64url parts, of which the first names an algorithm and the second is an object

Null and empty texts have no span. Very long texts are scanned whole, in time proportional to their length: every
pattern is a run of one character class with a fixed start. Rows are scanned where they lie; repeated rows repeat.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame

from curaspark.llm.common import per_row

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pkcs1", "pkcs8", "pkcs8_encrypted", "sec1", "openssh", "signed_token")
_RANK = {k: i for i, k in enumerate(KINDS)}

# re.ASCII keeps "either case" to ASCII letters
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# runs are maximal, so asking for the length in the pattern finds the same runs as dropping short ones afterwards
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

MIN_ENCODED = 40
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_ENCODED)
# a line break as it is or as an escape, and runs on consecutive lines
_BREAK = re.compile(r"(?:[\r\n]|\\+[nrt])[ \t]*")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}(?:(?:(?:[\r\n]|\\+[nrt])[ \t]*)+[A-Za-z0-9+/_-]+)+={0,2}" % MIN_ENCODED)
# base64 of a brace begins with e, and a quote, a space or a line break after it gives y or w
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])e[wy][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{8,}(?![A-Za-z0-9_-])")
_ESCAPED = re.compile(r"\\+[nrt]")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})-----")
_MAC_BYTES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}


# ---------------------------------------------------------------- structure of decoded bytes


def der_items(data: bytes, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, content start, content end) of the DER values that fill data[start:end] exactly; None if they do not."""
    end = len(data) if end is None else end
    items = []
    while start < end:
        if end - start < 2:
            return None
        tag, size, body = data[start], data[start + 1], start + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or body + width > end:
                return None
            size = int.from_bytes(data[body : body + width], "big")
            body += width
            if size < 0x80 or size >> (8 * (width - 1)) == 0:  # DER takes the shortest form
                return None
        if body + size > end:
            return None
        items.append((tag, body, body + size))
        start = body + size
    return items


_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def der_key(data: bytes) -> str | None:
    """Which private-key encoding the bytes are, by the order and the nested lengths of their fields."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != _SEQUENCE:
        return None
    fields = der_items(data, *top[0][1:])
    if not fields:
        return None
    tags = [t for t, _, _ in fields]
    number = [int.from_bytes(data[a:b], "big") if t == _INTEGER and b > a else None for t, a, b in fields]
    if len(tags) >= 9 and tags[:9] == [_INTEGER] * 9 and number[0] in (0, 1) and (number[1] or 0).bit_length() >= 256:
        n, p, q = number[1], number[4], number[5]
        return "pkcs1" if number[0] == 1 or n == p * q or n.bit_length() >= 512 else None
    if len(tags) >= 3 and tags[0] == _INTEGER and number[0] in (0, 1) and tags[1] == _SEQUENCE and tags[2] == _OCTETS:
        return "pkcs8" if _names_algorithm(data, fields[1]) and fields[2][2] > fields[2][1] else None
    if len(tags) >= 2 and tags[0] == _INTEGER and number[0] == 1 and tags[1] == _OCTETS:
        return "sec1" if 20 <= fields[1][2] - fields[1][1] <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:]) else None
    if len(tags) == 2 and tags == [_SEQUENCE, _OCTETS]:
        return "pkcs8_encrypted" if _names_algorithm(data, fields[0]) and fields[1][2] - fields[1][1] >= 16 else None
    return None


def _names_algorithm(data: bytes, sequence: tuple[int, int, int]) -> bool:
    inner = der_items(data, *sequence[1:])
    return bool(inner) and inner[0][0] == _OID and inner[0][2] - inner[0][1] >= 3


_SSH_MAGIC = b"openssh-key-v1\x00"
_SSH_BASE64 = base64.b64encode(_SSH_MAGIC).decode()


def openssh_key(data: bytes) -> int:
    """Size of an OpenSSH private key file: magic, cipher, kdf, options, count, public keys and private part, by their lengths; 0 if it is none."""
    if not data.startswith(_SSH_MAGIC):
        return 0
    at = len(_SSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    cipher, kdf, options = field(), field(), field()
    if not cipher or not kdf or options is None or at + 4 > len(data):
        return 0
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 64 or any(not field() for _ in range(count)):
        return 0
    return at if field() else 0


def decoded(run: str) -> list[bytes]:
    """The readings of a run as bytes: hex if all of it is hex, and base64 in either alphabet."""
    out = []
    body = run.rstrip("=")
    if len(body) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", body):
        out.append(bytes.fromhex(body))
    if len(body) % 4 != 1:
        plain = body.replace("-", "+").replace("_", "/")
        try:
            out.append(base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True))
        except (binascii.Error, ValueError):
            pass
    return out


def key_kind(data: bytes) -> str | None:
    if data[:1] == b"\x30":
        return der_key(data)
    return "openssh" if openssh_key(data) else None


def key_size(data: bytes) -> int:
    """How many bytes a DER value takes, by its header; 0 if it is no sequence."""
    if len(data) < 6 or data[0] != _SEQUENCE:
        return 0
    if data[1] < 0x80:
        return 2 + data[1]
    width = data[1] & 0x7F
    return 2 + width + int.from_bytes(data[2 : 2 + width], "big") if 1 <= width <= 4 else 0


def wrapped_keys(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """Keys that are spelled over several of the lines of text[start:end], each of which is a run."""
    lines, at = [], start
    for m in [*_BREAK.finditer(text, start, end), None]:
        stop = m.start() if m else end
        if stop > at:
            lines.append((at, text[at:stop].rstrip("=")))
        at = m.end() if m else end
    if lines and start and text[start - 1] == "\\" and lines[0][1][0] in "nrt":  # the letter of an escaped break
        lines[0] = (start + 1, lines[0][1][1:])
    after = [0]  # characters from the end of the lines
    for _, line in reversed(lines):
        after.append(after[-1] + len(line))
    out, i = [], 0
    while i < len(lines):
        first, prefix = lines[i][1], 2 if lines[i][1][:2] in ("0x", "0X") else 0
        have, found = after[len(lines) - i] - prefix, None
        head = first[prefix:]
        for digits, base in ((2, decoded(head[:40]) if re.match(r"[0-9a-fA-F]{40}", head) else []), (4 / 3, decoded(head[:40].ljust(40, "A")))):
            data = base[0 if digits == 2 else -1] if base else b""
            size = key_size(data)
            if digits != 2 and data.startswith(_SSH_MAGIC):
                for most in (256, len(lines)):  # most keys end within the first of these lines
                    whole = "".join(x for _, x in lines[i : i + most])
                    read = decoded(whole[: len(whole) // 4 * 4] if len(whole) % 4 == 1 else whole)
                    if size := openssh_key(read[-1]) if read else 0:
                        break
            need = -(-size * 4 // 3) if digits != 2 else 2 * size
            if not size or not len(head) < need <= have:
                continue
            parts, held, j = [head], len(head), i + 1
            while held < need:
                parts.append(lines[j][1])
                held += len(parts[-1])
                j += 1
            if held == need:
                for read in decoded("".join(parts)):
                    if kind := key_kind(read):
                        stop = lines[j - 1][0] + len(lines[j - 1][1])
                        while stop < end and text[stop] == "=":
                            stop += 1
                        found = (kind, lines[i][0] + prefix, stop)
            if found:
                break
        if found:
            out.append(found)
        i = j if found else i + 1
    return out


MOST_KEY = 65_536  # bytes of a key within a run; the largest RSA keys in use take a seventh of that


def inner_keys(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """(kind, start, end) of base64 keys inside a longer run: after a path or a word, with more behind them.

    A DER sequence begins with M in base64 and says how long it is, so it is cut there. A look at a place takes a bounded time.
    """
    out, at = [], start
    while 0 <= (at := text.find("M", at, end)):
        head = decoded(text[at : at + 8])
        size = key_size(head[-1]) if head else 0
        need = -(-size * 4 // 3)
        at += 1
        if not MIN_ENCODED <= need or size > MOST_KEY or at - 1 + need > end:
            continue
        for data in decoded(text[at - 1 : at - 1 + need])[-1:]:
            if kind := key_kind(data[:size]):
                stop = at - 1 + need
                while stop < end and text[stop] == "=":
                    stop += 1
                out.append((kind, at - 1, stop))
                at = stop
    at = start
    while 0 <= (at := text.find(_SSH_BASE64, at, end)):
        read = decoded(text[at : at + min(end - at, 2 * MOST_KEY) // 4 * 4])
        if size := openssh_key(read[-1]) if read else 0:
            out.append(("openssh", at, at + -(-size * 4 // 3)))
            at += size
        at += len(_SSH_BASE64)
    return out


def signed_token(token: str) -> bool:
    """header.payload.signature with a JSON header that names a signing algorithm and a signature of its length."""
    parts = token.split(".")
    if len(parts) != 3 or any(len(p) % 4 == 1 for p in parts):
        return False
    try:
        head, load, mac = (base64.urlsafe_b64decode(p + "=" * (-len(p) % 4)) for p in parts)
        header, payload = json.loads(head), json.loads(load)
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict):
        return False
    algorithm = header.get("alg")
    if not isinstance(algorithm, str) or algorithm.lower() == "none":
        return False
    return len(mac) in _MAC_BYTES[algorithm] if algorithm in _MAC_BYTES else len(mac) >= 8


# ---------------------------------------------------------------- spans of a text


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns, leftmost and non-overlapping per kind, too short ones dropped."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


class _Blocks:
    """Spans by start, and how far the first so many of them reach."""

    def __init__(self, found: set[tuple[str, int, int]]) -> None:
        spans = sorted((a, b) for _, a, b in found)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def reach(self, first: int) -> int:
        """The furthest end of the first ``first`` spans."""
        return self.ends[first - 1] if first else -1


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of encoded keys and signed tokens whose decoded bytes parse."""
    found = set()
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            stop, tail = text.find("-----", m.end()), f"-----END {m[1]}-----"
            if stop < 0 or not text.startswith(tail, stop):
                continue
            lines = _ESCAPED.sub("\n", text[m.end() : stop]).replace("\\/", "/").splitlines()
            body = "".join("".join(x.split()) for x in lines if ":" not in x and "," not in x)  # without header lines
            for data in decoded(body):
                if kind := key_kind(data):
                    found.add((kind, m.start(), stop + len(tail)))
    blocks = _Blocks(found)
    for m in _LINES.finditer(text):
        if not blocks.reach(bisect_left(blocks.starts, m.start())) > m.start():
            found.update(wrapped_keys(text, *m.span()))
    blocks = _Blocks(found)
    for m in _RUN.finditer(text):
        first = bisect_right(blocks.starts, m.start())
        if blocks.reach(first) > m.start() or first < bisect_left(blocks.starts, m.end()):
            continue  # the body of a block that is reported as a whole
        starts = [m.start()]
        if m[0][:2] in ("0x", "0X"):
            starts.append(m.start() + 2)
        if m.start() and text[m.start() - 1] == "\\" and m[0][0] in "nrt":
            starts.append(m.start() + 1)  # after an escaped line break
        whole = {(kind, start, m.end()) for start in starts for data in decoded(text[start : m.end()]) if (kind := key_kind(data))}
        found.update(whole or inner_keys(text, *m.span()))
    found |= {("signed_token", *m.span()) for m in _TOKEN.finditer(text) if signed_token(m[0])}
    return list(found)


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind in the order of KINDS, then end; ends are exclusive, in code points."""
    if not text:
        return []
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], _RANK[s[0]], s[2]))


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, start, end, value): one row per secret of every text; value is the text of the span."""

    def run(k, t):
        return [{key: k, "kind": kind, "start": a, "end": b, "value": t[a:b]} for kind, a, b in secret_spans(t)]

    return per_row(df, [key, text], run, f"{key} {df.schema[key].dataType.simpleString()}, kind string, start bigint, end bigint, value string")


def secret_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: (key, spans array<struct<kind,start,end>>) in the order of ``secret_spans``."""

    def run(k, t):
        return {key: k, "found": [{"kind": kind, "start": a, "end": b} for kind, a, b in secret_spans(t)]}

    return per_row(df, [key, text], run, f"{key} {df.schema[key].dataType.simpleString()}, found array<struct<kind:string,start:bigint,end:bigint>>")
