"""Secrets: patterns, and structural confirmation of encoded keys and signed tokens.

Three kinds are found by pattern (assign, access, hex). Beyond them, runs that look like base64 or hex are decoded, and
reported only if what they hold parses:

    der     an ASN.1 SEQUENCE whose nested lengths fill it exactly, and which starts with an INTEGER or a SEQUENCE
    openssh the marker of the OpenSSH key format, then length-prefixed fields within the data
    jwt     three segments joined by dots, the first a JSON object with "alg", the second a JSON object
    pem     a run between BEGIN and END lines of a key whose base64 body is der or openssh; under RFC 1421 headers that say
            it is encrypted, a body of whole cipher blocks for the vector that DEK-Info names

A der or openssh key without BEGIN and END may be wrapped: lines are joined as far as the length it states, which has to
fall on the end of a line.

Null text counts as empty and gives no spans. Every input row gives a row, repeated ones too; extra columns are not read, and no
rows give no rows. Of spans that begin at one place the kinds come in the order of KINDS; where structures overlap each is
reported. A very long text is searched as a whole, in a slice of its own.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from ._jobs import texts
from .bpe import slices
from .pii import SPAN

KINDS = ("assign", "access", "hex")
CONFIRMED = ("jwt", "pem", "openssh", "der")

#: ASCII letters in either case only; other letters that fold to them don't count.
ASSIGN = re.compile(
    "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
#: A run of 24 or more is found whole: what starts earlier in a shorter run can't reach 24.
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]*+")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*KEY[A-Z0-9 ]*)-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s]*+")
DEK = re.compile(r"([A-Z0-9-]+),((?:[0-9A-Fa-f]{2}){8,16})")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
#: Runs that follow each other line by line; the header of a key fits in the first 8 characters.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++")
RUN = re.compile(r"[A-Za-z0-9+/_-]++")
PADDING = re.compile(r"={0,2}")
STARTS = ("M", "b3BlbnNzaC1")  # a SEQUENCE (0x30) or the marker, once decoded
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}+(?![0-9A-Fa-f])")

Span = tuple[int, int, str]


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Length and first byte of the content of the element whose length starts at ``at``."""
    if at >= len(data):
        return None
    n = data[at]
    if n < 0x80:
        return n, at + 1
    size = n & 0x7F
    if not 1 <= size <= 4 or at + 1 + size > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + size]), at + 1 + size


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE of at least two elements that fill it to the byte, the first an INTEGER or a SEQUENCE."""
    if len(data) < 24 or data[0] != 0x30 or not (outer := der_length(data, 1)) or sum(outer) != len(data):
        return False
    at, elements = outer[1], 0
    if data[at] not in (0x02, 0x30):
        return False
    while at < len(data):
        inner = der_length(data, at + 1)
        if not inner or sum(inner) > len(data):
            return False
        at, elements = sum(inner), elements + 1
    return elements >= 2


def is_openssh(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):  # cipher, key derivation, its options
        size = int.from_bytes(data[at : at + 4])
        at += 4 + size
        if at > len(data):
            return False
    return True


def openssh_length(data: bytes) -> int:
    """Bytes of the OpenSSH key that starts here: cipher, derivation, options, public keys and the private part; 0 if cut."""
    at = len(b"openssh-key-v1\0")

    def field(at: int) -> int:
        return at + 4 + int.from_bytes(data[at : at + 4])

    for _ in range(3):
        at = field(at)
    keys, at = int.from_bytes(data[at : at + 4]), at + 4
    while keys and at < len(data):
        keys, at = keys - 1, field(at)
    at = field(at)
    return at if not keys and at <= len(data) else 0


def decoded(run: str) -> bytes:
    body = re.sub(r"\s+", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_object(segment: str, key: str = "") -> bool:
    try:
        value = json.loads(decoded(segment))
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and (not key or key in value)


def key_kind(data: bytes) -> str:
    return "der" if is_der_key(data) else "openssh" if is_openssh(data) else ""


def is_pem(body: str) -> bool:
    """What stands between BEGIN and END: RFC 1421 headers up to a blank line, if any, then base64."""
    lines = [x.strip() for x in body.strip().split("\n")]
    headers: dict[str, str] = {}
    if ":" in lines[0]:
        end = lines.index("") if "" in lines else next((i for i, x in enumerate(lines) if ":" not in x), len(lines))
        name = ""
        for line in lines[:end]:
            if ":" in line:
                name, line = (x.strip() for x in line.split(":", 1))
            headers[name.lower()] = headers.get(name.lower(), "") + line
        lines = lines[end:]
    run = "".join(lines)
    data = decoded(run) if PEM_BODY.fullmatch(run) else b""
    if "ENCRYPTED" not in headers.get("proc-type", ""):
        return bool(key_kind(data))
    dek = DEK.fullmatch(headers.get("dek-info", ""))
    return bool(dek and data) and (not dek[1].endswith("CBC") or len(data) % (len(dek[2]) // 2) == 0)


def wrapped_keys(text: str) -> Iterator[tuple[int, int, str]]:
    """Keys over several lines, as far as the length that their first bytes state."""
    for block in WRAPPED.finditer(text):
        runs = [m.span() for m in RUN.finditer(text, *block.span())]
        if not any(text.startswith(STARTS, a) for a, _ in runs):
            continue
        body = "".join(text[a:b] for a, b in runs)
        starts = list(accumulate((b - a for a, b in runs), initial=0))
        ends = {n: b for n, (_, b) in zip(starts[1:], runs, strict=True)}
        free = 0
        for at, (a, b) in zip(starts, runs, strict=False):
            if at < free or not text.startswith(STARTS, a):
                continue
            if text[a] == "M":
                outer = der_length(decoded(body[at : at + 8]), 1)
                size = sum(outer) if outer else 0
            else:
                size = openssh_length(decoded(body[at : len(body) - ((len(body) - at) % 4 == 1)]))
            stop = at + -(-4 * size // 3)
            if size and stop in ends and ends[stop] > b and (kind := key_kind(decoded(body[at:stop]))):
                free, end = stop, ends[stop]
                yield a, end + len(PADDING.match(text, end)[0]), kind


def base_spans(text: str) -> list[Span]:
    low = text.lower()
    spans: list[Span] = []
    if any(h in low for h in HINTS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def confirmed(text: str) -> list[Span]:
    """Spans that parse; a run inside a reported one is not reported again."""
    spans: list[Span] = []

    def add(a: int, b: int, kind: str) -> None:
        if kind and not any(s[0] <= a and b <= s[1] for s in spans):
            spans.append((a, b, kind))

    if "eyJ" in text:
        for m in JWT.finditer(text):
            head, body, _ = m.group().split(".")
            add(*m.span(), "jwt" if is_object(head, "alg") and is_object(body) else "")
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            stop, end = text.find("-----", m.end()), f"-----END {m.group(1)}-----"
            if stop >= 0 and text.startswith(end, stop):
                add(m.start(), stop + len(end), "pem" if is_pem(text[m.end() : stop]) else "")
    if "\n" in text:
        for a, b, kind in wrapped_keys(text):
            add(a, b, kind)
    for m in BASE64.finditer(text):
        run = m.group()
        if run.startswith(STARTS):
            add(*m.span(), key_kind(decoded(run)))
    for m in HEX_ANY.finditer(text):
        if m.group()[:2] == "30" or m.group()[:8].lower() == "6f70656e":
            add(*m.span(), key_kind(bytes.fromhex(m.group())))
    return spans


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of start, stop, kind); spans holds base and what was confirmed, by start."""
    order = {k: i for i, k in enumerate((*KINDS, *CONFIRMED))}

    def rows(spans: list[Span]) -> list[dict]:
        return [{"start": a, "stop": b, "kind": k} for a, b, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                base = [base_spans(x) if x else [] for x in part.column("text").to_pylist()]
                every = [sorted([*b, *confirmed(x)], key=lambda s: (s[0], order[s[2]])) if x else [] for x, b in zip(part.column("text").to_pylist(), base, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(rows, base), SPAN), pa.array(map(rows, every), SPAN)], names=["doc_id", "base", "spans"])

    span = "array<struct<start:int,stop:int,kind:string>>"
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base {span}, spans {span}")
