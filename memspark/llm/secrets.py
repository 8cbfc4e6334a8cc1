"""Secret scan with structural confirmation.

Three base kinds are found by pattern (`assign`, `access`, `hex`). The method adds
spans only after decoding: PEM blocks, base64 and hex runs that hold a DER key
(nested ASN.1 lengths must add up), OpenSSH key blobs (length-prefixed fields) and
signed tokens whose header is a JSON object with an `alg`.

A key may stand anywhere in a run, as runs are glued to paths or names, and a run may be
wrapped over lines: every place where a key's first bytes would be coded as they must be
is decoded, as far as the outermost length says. A span ends with its key.

Nulls and empty texts have no spans. Repeated rows are scanned one by one, equal starts are
listed in the order of KINDS, very long texts are scanned whole, an empty table gives no
rows, and only the id and the text are read and returned (`redact` keeps all columns).
Spans are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memspark.llm.common import slices, text_bytes

#: Order of kinds where spans start at the same place.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
BASE_KINDS = KINDS[:3]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?:\s|\\[rn])*[A-Z][A-Za-z-]*: [^\n\\]*(?:\n|\\[rn]))*+)((?:[A-Za-z0-9+/=\s]|\\[rn])++)-----END \1-----")
_CODE = "[A-Za-z0-9+/_-]"
#: A line break inside a wrapped run, as such or in its escaped form.
_BREAK = r"(?:[ \t\r]*\n[ \t]*|(?:\\r)?\\n)"
_BASE64 = re.compile(rf"(?<!{_CODE}){_CODE}{{14,}}+(?:{_BREAK}{_CODE}++)*+={{0,2}}")
_HEXRUN = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{14,}}+(?:{_BREAK}[0-9A-Fa-f]++)*+")
_JOINED = re.compile(_BREAK)
#: How a DER sequence (30, then a length of one, two or three octets) and the OpenSSH magic begin in either code.
_BASE64_START = re.compile("(?=M[A-I])|(?=b3BlbnNzaC1rZXktdjEA)")
_HEX_START = re.compile("(?=30)|(?=6f70656e7373682d6b65792d763100)", re.I)
_HEAD = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{14,}+)\.(?=([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*))")
#: A brace and what may follow it: a quote, a blank or a line end.
_HEAD_START = re.compile("(?=e[yw])")
#: Least characters of a run's first line or a token's header, and of a key.
LEAST_RUN, LEAST_KEY = 14, 40
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


_LOWER = _lower_table()
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_IS_CODE = np.zeros(256, bool)
_IS_CODE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.=")] = True


def _der_length(b: bytes, at: int) -> tuple[int, int] | None:
    """Length of the element whose length octets begin at `at`, and where its content begins."""
    if at >= len(b):
        return None
    first = b[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(b):
        return None
    return int.from_bytes(b[at + 1 : at + 1 + n], "big"), at + 1 + n


def der_elements(b: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the elements that fill b exactly, or None."""
    out, at = [], 0
    while at < len(b):
        size = _der_length(b, at + 1)
        if size is None or size[1] + size[0] > len(b):
            return None
        out.append((b[at], b[size[1] : size[1] + size[0]]))
        at = size[1] + size[0]
    return out


def is_der_key(b: bytes) -> bool:
    """PKCS#1, PKCS#8, encrypted PKCS#8 or SEC1 private key: one SEQUENCE whose nested lengths fit."""
    top = der_elements(b)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_elements(top[0][1])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _ in parts]
    if tags[0] == 0x02 and len(parts) >= 9 and all(t == 0x02 for t in tags[:9]):
        return True  # PKCS#1: version and eight numbers
    if tags[:3] == [0x02, 0x30, 0x04]:
        inner = der_elements(parts[1][1])
        return bool(inner) and inner[0][0] == 0x06  # PKCS#8: algorithm identifier, then the key
    if tags[:2] == [0x02, 0x04] and parts[0][1] == b"\x01" and len(parts[1][1]) in (28, 32, 48, 66):
        return True  # SEC1
    if tags == [0x30, 0x04]:
        inner = der_elements(parts[0][1])
        return bool(inner) and inner[0][0] == 0x06 and inner[0][1].startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01")  # encrypted PKCS#8
    return False


def _fields(b: bytes, at: int, n: int) -> int | None:
    """Where n length-prefixed fields that begin at `at` end."""
    for _ in range(n):
        if at + 4 > len(b):
            return None
        at += 4 + int.from_bytes(b[at : at + 4], "big")
        if at > len(b):
            return None
    return at


_MAGIC = b"openssh-key-v1\0"


def is_openssh_key(b: bytes) -> bool:
    """The magic, then cipher, kdf and options as length-prefixed strings, then the number of keys."""
    at = _fields(b, len(_MAGIC), 3) if b.startswith(_MAGIC) else None
    return at is not None and at + 4 <= len(b) and 1 <= int.from_bytes(b[at : at + 4], "big") <= 64


def openssh_size(b: bytes) -> int:
    """Bytes of the blob, all of b where its last fields don't fit."""
    at = _fields(b, len(_MAGIC), 3)
    return _fields(b, at + 4, int.from_bytes(b[at : at + 4], "big") + 1) or len(b)


def _unbase64(s: str) -> bytes | None:
    s = re.sub(r"\s+|\\[rn]", "", s).rstrip("=")
    try:
        return base64.b64decode(s.replace("-", "+").replace("_", "/") + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _base64_bytes(code: str) -> bytes:
    """The whole bytes of a run of base64 characters."""
    return _unbase64(code[:-1] if len(code) % 4 == 1 else code) or b""


def _hex_bytes(code: str) -> bytes:
    return bytes.fromhex(code[: len(code) // 2 * 2])


def is_token_header(s: str) -> bool:
    raw = _unbase64(s)
    if raw is None:
        return False
    try:
        head = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _key_kind(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    return "der" if is_der_key(raw) else "openssh" if is_openssh_key(raw) else None


def key_at(code: str, at: int, decode: Callable, width: float) -> tuple[str, int] | None:
    """Kind and length in bytes of the key that begins at a place of a run of code characters."""
    head = decode(code[at : at + 24])
    if head.startswith(_MAGIC[:9]):
        raw = decode(code[at:])
        return ("openssh", openssh_size(raw)) if is_openssh_key(raw) else None
    size = _der_length(head, 1) if head[:1] == b"\x30" else None
    if size is None or head[size[1] : size[1] + 1] not in (b"\x02", b"\x30"):
        return None
    n = size[0] + size[1]
    raw = decode(code[at : at + math.ceil(n * width)])[:n]
    return ("der", n) if len(raw) == n and is_der_key(raw) else None


def _keys(text: str, runs: re.Pattern, starts: re.Pattern, decode: Callable, width: float, inside: Callable) -> Iterator[tuple[int, int, str]]:
    """Spans of keys in the runs of a text; `width` is code characters a byte."""
    for m in runs.finditer(text):
        if m.end() - m.start() < LEAST_KEY:
            continue
        parts, at = [], m.start()  # unbroken parts of the run and where they begin
        for gap in [*_JOINED.finditer(text, m.start(), m.end()), None]:
            end = gap.start() if gap else m.end()
            parts.append((at, text[at:end]))
            at = gap.end() if gap else end
        code = "".join(p for _, p in parts).rstrip("=")
        begins = list(accumulate((len(p) for _, p in parts), initial=0))[:-1]
        place = lambda k: (j := bisect_right(begins, k) - 1, parts[j][0] + k - begins[j])[1]
        after = 0
        for s in starts.finditer(code):
            k = s.start()
            if k < after or (found := key_at(code, k, decode, width)) is None:
                continue
            after = k + min(len(code) - k, math.ceil(found[1] * width))
            start, end = place(k), place(after - 1) + 1
            if width < 2:  # the padding of base64
                pad = -(after - k) % 4
                end += len(text[end : end + pad]) - len(text[end : end + pad].lstrip("="))
            if not inside(start, end):
                yield start, end, found[0]


def _tokens(text: str) -> Iterator[tuple[int, int, str]]:
    at = 0
    for m in _HEAD.finditer(text):
        if _unbase64(m[2]) is None:
            continue
        for s in sorted({0, *(x.start() for x in _HEAD_START.finditer(m[1]))}):
            if m.start() + s >= at and m[1][s] in "eICD" and is_token_header(m[1][s:]):  # a brace, or white space before it
                at = m.end(3)
                yield m.start() + s, at, "jwt"
                break


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The three base kinds: leftmost matches per kind, short ones dropped."""
    low = text.lower()
    found = []
    if any(k.decode() in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that decode to a key or a signed token's header."""
    found = []
    for m in _PEM.finditer(text):
        # Under a legacy encryption header the body is cipher text without structure.
        if _key_kind(_unbase64(m[3])) or "ENCRYPTED" in m[1] or "ENCRYPTED" in m[2]:
            found.append((m.start(), m.end(), "pem"))
    blocks = found[:]  # in order and apart

    def inside(a: int, b: int) -> bool:
        k = bisect_right(blocks, a, key=lambda x: x[0]) - 1
        return k >= 0 and b <= blocks[k][1]

    found += _tokens(text)
    found += _keys(text, _BASE64, _BASE64_START, _base64_bytes, 4 / 3, inside)
    found += _keys(text, _HEXRUN, _HEX_START, _hex_bytes, 2, inside)
    return found


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def _rows_with_runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Rows that may hold a run of `least` marked bytes; a run can only be missed by none, since it covers a multiple of `least`."""
    at = np.arange(0, len(mask), least)
    at = at[mask[at]]
    if not len(at):
        return at
    padded = np.concatenate([mask, np.zeros(least, bool)])
    left = np.zeros(len(at), np.int64)
    alive = np.ones(len(at), bool)
    right = np.zeros(len(at), np.int64)
    forward = np.ones(len(at), bool)
    for k in range(1, least):
        alive &= (at - k >= 0) & padded[at - k]
        forward &= padded[at + k]
        left += alive
        right += forward
        if not (alive | forward).any():
            break
    at = at[left + right + 1 >= least]
    return np.unique(np.searchsorted(offsets, at, side="right") - 1)


def _rows_with(data: bytes, needle: bytes, offsets: np.ndarray) -> set[int]:
    rows, at = set(), data.find(needle)
    while at >= 0:
        row = int(np.searchsorted(offsets, at, side="right")) - 1
        rows.add(row)
        at = data.find(needle, int(offsets[row + 1]))
    return rows


def candidate_rows(column: pa.Array) -> set[int]:
    """Rows that can hold any span; all others are skipped unread by the exact patterns."""
    raw, offsets = text_bytes(column)
    lower = _LOWER[raw].tobytes()
    rows = {int(r) for r in _rows_with_runs(_IS_HEX[raw], offsets, 16)}
    rows |= {int(r) for r in _rows_with_runs(_IS_CODE[raw], offsets, LEAST_RUN)}
    rows |= _rows_with(raw.tobytes(), b"AKIA", offsets) | _rows_with(raw.tobytes(), b"-----BEGIN ", offsets)
    for k in _KEYWORDS:
        rows |= _rows_with(lower, k, offsets)
    return rows


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, list of (start, end, kind), all spans and the base ones apart."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, base array<struct<start:int,end:int,kind:string>>, confirmed array<struct<start:int,end:int,kind:string>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1)
            base: list[list] = [[] for _ in range(len(texts))]
            more: list[list] = [[] for _ in range(len(texts))]
            for i in candidate_rows(texts):
                text = texts[i].as_py() or ""
                base[i] = [{"start": s, "end": e, "kind": k} for s, e, k in base_spans(text)]
                more[i] = [{"start": s, "end": e, "kind": k} for s, e, k in confirmed_spans(text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(more, span)], [id_col, "base", "confirmed"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def digests(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text."""
    names = scanned.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = [(x["start"], x["end"], x["kind"]) for x in base]
                for c, kind in zip(cols, BASE_KINDS, strict=False):
                    c.append(sum(k == kind for _, _, k in own))
                cols[3].append(hashlib.sha256(listed(own).encode()).hexdigest())
                cols[4].append(listed(own + [(x["start"], x["end"], x["kind"]) for x in more]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], [names, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = scanned.schema[names].dataType.simpleString()
    return scanned.mapInArrow(run, f"{names} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns; assigned values, access keys and confirmed spans are replaced in the text.

    A bare hex run is no proof of a secret (it may be a number or a checksum), so it is
    redacted only where another kind covers it. Rows without such spans stay as they are.
    """
    fields = docs.schema
    at = docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def clean(text: str) -> str:
        spans = sorted(s for s in base_spans(text) + confirmed_spans(text) if s[2] != "hex")
        out, last = [], 0
        for s, e, _ in spans:
            if s >= last:
                out += [text[last:s], mark]
            last = max(last, e)
        return "".join(out) + text[last:] if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = candidate_rows(batch.column(at))
            if rows:
                cols = list(batch.columns)
                texts = cols[at].to_pylist()
                chars = cols[chars_at].to_pylist() if chars_at is not None else []
                for i in rows:
                    if texts[i]:
                        new = clean(texts[i])
                        if new != texts[i] and chars_at is not None:
                            chars[i] = len(new)
                        texts[i] = new
                cols[at] = pa.array(texts, cols[at].type)
                if chars_at is not None:
                    cols[chars_at] = pa.array(chars, cols[chars_at].type)
                batch = pa.RecordBatch.from_arrays(cols, batch.schema.names)
            yield batch

    return docs.mapInArrow(run, fields)
