"""Secrets in text: pattern matches, and candidates confirmed by their structure.

Base matches are three patterns, kept as they are. Candidates in base64 or hex
are reported only if their decoded bytes have the structure of a secret: a
signed token whose header names an algorithm, a DER key whose nested lengths add up
down to the inner key (RSA, DSA, EC, PKCS8 plain or encrypted), or an OpenSSH
private key whose length-prefixed fields fit. Base64 may be wrapped over lines,
and a key may be glued to other base64 letters: its own length tells its end.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.storage import TEXT_ROWS, Workspace

#: In the order in which spans of equal start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der", "ssh")

SPANS = "array<struct<kind:string,start:long,end:long>>"
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----\s*((?:[A-Za-z0-9-]{1,40}:[^\n]*\n)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}(?:\r?\n[A-Za-z0-9+/]{4,})*={0,2}")
#: How the base64 of a DER sequence, or of an OpenSSH key, begins.
_BEGINS = re.compile("M[C-I]|b3BlbnNzaC1rZXktdjE")
_WIDE_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){32,}")


def _from_base64(text: str, url: bool = False) -> bytes:
    text = text.rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return b""


def _object(raw: bytes) -> dict:
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def is_signed_token(text: str) -> bool:
    """Whether dot-separated base64url parts are a JSON header with an algorithm and a JSON body."""
    header, body, _ = text.split(".", 2)
    return isinstance(_object(_from_base64(header, True)).get("alg"), str) and bool(_object(_from_base64(body, True)))


def _der(raw: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of the DER element at ``at``, if it fits."""
    if at + 2 > end:
        return None
    size, start = raw[at + 1], at + 2
    if size & 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or start + more > end:
            return None
        size, start = int.from_bytes(raw[start : start + more], "big"), start + more
    return (raw[at], start, start + size) if start + size <= end else None


def _elements(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """The DER elements that fill a range exactly; none if their lengths don't add up."""
    found = []
    while at < end:
        part = _der(raw, at, end)
        if not part:
            return []
        found.append(part)
        at = part[2]
    return found


def _is_algorithm(raw: bytes, part: tuple[int, int, int]) -> bool:
    inner = _elements(raw, part[1], part[2])
    return part[0] == 0x30 and bool(inner) and inner[0][0] == 0x06


def is_der_key(raw: bytes) -> bool:
    """Whether bytes are one DER private key, with the lengths of all nested elements right."""
    top = _elements(raw, 0, len(raw))
    if len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = _elements(raw, top[0][1], top[0][2])
    tags = [p[0] for p in parts]
    if tags == [0x30, 0x04]:  # encrypted PKCS8
        return _is_algorithm(raw, parts[0]) and parts[1][2] - parts[1][1] >= 16
    if not parts or tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    if tags[1:3] == [0x30, 0x04]:  # PKCS8: the algorithm, then the key of that algorithm
        inner = _elements(raw, parts[2][1], parts[2][2])
        if not _is_algorithm(raw, parts[1]) or len(inner) != 1:
            return False
        return inner[0][0] in (0x02, 0x04) or is_der_key(raw[parts[2][1] : parts[2][2]])
    if tags[1:2] == [0x04]:  # EC: the key, then tagged parameters and public key
        return parts[1][2] - parts[1][1] >= 16 and all(t in (0xA0, 0xA1) and _elements(raw, a, b) for t, a, b in parts[2:])
    return tags[:9] == [0x02] * 9 or tags == [0x02] * 6


def is_ssh_key(raw: bytes) -> bool:
    """Whether bytes are an OpenSSH private key: its magic, then length-prefixed fields that fit."""
    magic = b"openssh-key-v1\0"
    if not raw.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(raw):
            return False
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
    return at + 4 <= len(raw)


def _is_encrypted_pem(headers: str, raw: bytes) -> bool:
    """Whether header lines name a cipher and the body is whole blocks of it."""
    return "ENCRYPTED" in headers and "DEK-Info:" in headers and len(raw) >= 64 and len(raw) % 8 == 0


def _keys_in(run: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the keys in a run of base64 that may be wrapped over lines."""
    place = [i for i, c in enumerate(run) if c not in "\r\n="]
    text = "".join(run[i] for i in place)
    at = 0
    while m := _BEGINS.search(text, at):
        at, start = m.start() + 1, m.start()
        if m[0][0] == "M":
            head = _from_base64(text[start : start + 8])
            more = head[1] & 0x7F if len(head) == 6 and head[1] & 0x80 else 0
            if len(head) < 6 or more > 4:
                continue
            size = 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])
            end = start + -(-4 * size // 3)
            if size < 30 or end > len(text) or not is_der_key(_from_base64(text[start:end])):
                continue
            kind = "der"
        else:
            kind, end = "ssh", len(text) - ((len(text) - start) % 4 == 1)
            if not is_ssh_key(_from_base64(text[start:end])):
                continue
        at, last = end, place[end - 1] + 1
        while last < len(run) and run[last] == "=":
            last += 1
        yield kind, place[start], last


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every base match and confirmed candidate, in code points, by start then kind."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            raw = _from_base64("".join(m[3].split()))
            if is_der_key(raw) or is_ssh_key(raw) or _is_encrypted_pem(m[2], raw):
                found.append(("pem", *m.span()))
    for m in _BASE64.finditer(text):
        found += [(kind, m.start() + a, m.start() + b) for kind, a, b in _keys_in(m[0])]
    for m in _WIDE_HEX.finditer(text):
        raw = bytes.fromhex(m[0]) if m[0][:2] == "30" or m[0][:4].lower() == "6f70" else b""
        if is_der_key(raw):
            found.append(("der", *m.span()))
        elif is_ssh_key(raw):
            found.append(("ssh", *m.span()))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return found


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced; overlapping spans become one replacement."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``text`` with secrets masked, and ``spans``.

    A null text is empty and has no spans. Ids may be null or repeated; other
    columns are not read. Positions are code points of the original text.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [scan(t) for t in texts]
            masked = [mask(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
            shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masked, pa.string()), pa.array(rows, shape)], names=["id", "text", "spans"])

    found = docs.mapInArrow(look, f"id {kind}, text string, spans {SPANS}")
    return found.select(F.col("id").alias(id_col), "text", "spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, and the base and all spans as text."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS LONG) AS n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def mask_documents(docs: DataFrame) -> DataFrame:
    """All documents, with their secrets masked and ``n_chars`` counted again; other columns stay. A null text stays null.

    The result is written and read again, so that the texts go to Python in batches of ``TEXT_ROWS``.
    """

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else mask(t, scan(t)) for t in texts.to_pylist()], pa.string())

    out = docs.withColumn("text", masked("text"))
    out = out.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))
    return Workspace(docs.sparkSession, "secrets").save(out, "masked", TEXT_ROWS)
