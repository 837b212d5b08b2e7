"""Secret scans: patterns, and structural confirmation of encoded keys and signed tokens.

Base kinds are plain patterns (assign, access, hex). The method adds spans whose content decodes to what it claims:
  pem    a PRIVATE KEY block whose base64 body is a key encoding; line ends may be written out as \\n
  key    a base64 run, over several lines too, or a hex run that decodes to a private key: DER (PKCS#1, PKCS#8, encrypted
         PKCS#8, SEC 1) with every nested length adding up to any depth, or the OpenSSH container with its fields
  signed a compact signed token: a base64url JSON header with "alg", a JSON object as payload, and a signature
Positions are code points, the end is exclusive.

Defined results: null is the empty text and has no spans; equal starts are ordered by kind as listed; repeated rows
give repeated rows; texts are taken whole, in time linear in their length; a column named secrets is replaced, other
columns stay.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.shared import slices, text_of, with_results

KINDS = ("assign", "access", "hex", "pem", "key", "signed")
BASE = KINDS[:3]

_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_NAMES = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")  # a run is taken whole, so the length can stand here
_ARMOUR = re.compile(rb"-----(BEGIN|END) ((?:[A-Z0-9]++ )*+KEY)-----")
#: Lines of base64, the first of 40 characters or more; one line as a rule.
_BASE64 = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:\r?\n[A-Za-z0-9+/_-]++)*+={0,2}")
_ANY_HEX = re.compile(rb"(?:[0-9A-Fa-f]{2}){32,}+")
_RUN = re.compile(rb"[A-Za-z0-9_-]*+")
_OPENSSH = b"openssh-key-v1\0"


def der(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The (tag, start, end) of the elements that fill data[at:end] exactly, or None; nested ones must fill theirs, too, to any depth."""
    out, ends = [], []
    while True:
        while ends and at == ends[-1]:
            ends.pop()
        limit = ends[-1] if ends else end
        if at == limit:
            return out
        if at + 2 > limit:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > limit:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
        if at + n > limit:
            return None
        if not ends:
            out.append((tag, at, at + n))
        if tag & 0x20:
            ends.append(at + n)
        else:
            at += n


def is_private_key(data: bytes) -> bool:
    if data.startswith(_OPENSSH):
        at = len(_OPENSSH)
        for _ in range(3):  # cipher, key derivation, its options
            n = int.from_bytes(data[at : at + 4], "big")
            at += 4 + n
            if at + 4 > len(data):
                return False
        return int.from_bytes(data[at : at + 4], "big") >= 1
    if len(data) < 16 or data[0] != 0x30:
        return False
    outer = der(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    parts = der(data, outer[0][1], outer[0][2]) or []
    tags = [t for t, _, _ in parts]
    value = lambda i: int.from_bytes(data[parts[i][1] : parts[i][2]], "big")
    if tags[:1] == [2] and len(tags) >= 9 and set(tags[:9]) == {2} and value(0) in (0, 1):
        return True  # PKCS#1
    if tags[:3] == [2, 0x30, 4] and value(0) in (0, 1):
        return True  # PKCS#8
    if tags[:2] == [2, 4] and value(0) == 1 and 16 <= parts[1][2] - parts[1][1] <= 66:
        return True  # SEC 1
    if tags == [0x30, 4]:
        inner = der(data, parts[0][1], parts[0][2]) or []
        return bool(inner) and inner[0][0] == 6  # encrypted PKCS#8
    return False


def _decoded(run: bytes) -> bytes | None:
    run = run.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    try:
        return base64.b64decode(run + b"=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(run: bytes) -> bool:
    header, payload, signature = run.split(b".")
    try:
        head, body = (json.loads(_decoded(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str) and bool(signature or head["alg"] == "none")


def _encoded_key(run: bytes) -> int:
    """How many bytes of a base64 run, line ends included, hold a private key: as many as its outermost length says; 0 for none."""
    lines = run.split(b"\n")
    head = _decoded(lines[0].rstrip(b"\r=")[:24]) or b""
    if head[:1] == b"\x30" and len(head) > 5:
        k = head[1] & 0x7F if head[1] & 0x80 else 0
        n = 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])
    elif head.startswith(_OPENSSH):
        n = None  # no length of its own: all lines
    else:
        return 0
    need, text, size = None if n is None else -(-n * 4 // 3), [], 0
    at = 0
    for line in lines:
        body = line.rstrip(b"\r=")
        if need is not None and size + len(body) >= need:
            text.append(body[: need - size])
            at += need - size
            break
        text.append(body)
        size += len(body)
        at += len(line) + 1
    else:
        if need is not None:
            return 0
        at -= 1
    if not is_private_key(_decoded(b"".join(text)) or b""):
        return 0
    while run[at : at + 1] == b"=":
        at += 1
    return at


def _armoured(text: bytes) -> list[tuple[int, int]]:
    """Blocks of private keys whose body is a key encoding. A head belongs to the end that follows it next; line ends may be written out."""
    out, head = [], None
    for m in _ARMOUR.finditer(text):
        if m[1] == b"END" and head and head[2] == m[2] and m[2].endswith(b"PRIVATE KEY"):
            body = text[head[1] : m.start()].replace(b"\\r", b"").replace(b"\\n", b"\n")
            lines = b"".join(line for line in body.split(b"\n") if b":" not in line)
            if is_private_key(_decoded(b"".join(lines.split())) or b""):
                out.append((head[0], m.end()))
        head = (m.start(), m.end(), m[2]) if m[1] == b"BEGIN" else None
    return out


def _signed(text: bytes) -> list[tuple[int, int]]:
    """Signed tokens: three runs with dots between them, from the first eyJ of the first run. Every run is looked at a few times at most."""
    out, upto = [], 0
    while (at := text.find(b"eyJ", upto)) >= 0:
        ends = [_RUN.match(text, at).end()]
        while len(ends) < 3 and text[ends[-1] : ends[-1] + 1] == b".":
            ends.append(_RUN.match(text, ends[-1] + 1).end())
        if len(ends) == 3 and ends[1] > ends[0] + 1 and is_signed_token(text[at : ends[2]]):
            out.append((at, ends[2]))
            upto = ends[2]
        else:
            upto = ends[0]
    return out


def spans_of(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, in order."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if b"PRIVATE KEY-----" in text:
        out += [(a, 3, b) for a, b in _armoured(text)]
    out += [(m.start(), 4, m.start() + n) for m in _BASE64.finditer(text) if (n := _encoded_key(m[0]))]
    for m in _ANY_HEX.finditer(text):
        if is_private_key(bytes.fromhex(m[0].decode())):
            out.append((m.start(), 4, m.end()))
    if b"eyJ" in text:
        out += [(a, 5, b) for a, b in _signed(text)]
    return sorted(set(out))


def find_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with secrets (array of kind, start, end) and ``text_col`` with every span replaced by ``mask``."""
    docs, schema = with_results(docs, "secrets array<struct<kind:string,start:bigint,end:bigint>>")
    names = schema.names
    at_text = names.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            raw, found, masked = text_of(batch, text_col).cast(pa.binary()), [], None
            for i, text in enumerate(raw):
                text = text.as_py()
                spans = spans_of(text)
                if not spans:
                    found.append([])
                    continue
                point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                found.append([{"kind": KINDS[k], "start": int(point[a]), "end": int(point[b])} for a, k, b in spans])
                pieces, upto = [], 0
                for a, _, b in spans:
                    if a >= upto:
                        pieces += [text[upto:a], mask.encode()]
                    upto = max(upto, b)
                masked = masked or {}
                masked[i] = b"".join([*pieces, text[upto:]])
            texts = batch.column(at_text)
            if masked:
                texts = pa.array([masked[i].decode() if i in masked else t.as_py() for i, t in enumerate(texts)], pa.string())
            columns = [texts if i == at_text else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names)

    return docs.mapInArrow(scan, schema)


def listed(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
