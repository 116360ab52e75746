"""Operator 5: secret scans with multipart credential linking.

Base spans are strong findings and always stay. Besides, weak parts are collected: an access identifier
(`id`: a name such as user, login, client_id with a value, or a bare access id too short for the
base rule), a weak secret (`key`: a
mixed run of letters and digits of 16 or more that no base span covers) and an endpoint (`host`: a URL or a host
with a port). Parts lie in scopes, which are intervals of text without an empty line; the interval join of parts and
scopes is one sweep over both in order of start, as no part crosses a line. A weak part is reported only when its scope
holds a complementary part (an identifier or endpoint for a secret and the other way round, base spans counting as
theirs), however far apart they are; alone it is dropped. A run that is both an access id and a weak secret is no pair
with itself. Weak parts that overlap a base span are dropped. Every step is linear in the text.

Null texts are empty and have no spans. Texts of any length are scanned whole. Repeated rows give repeated rows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import clean, lean

# Fixed values of the contract.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "id", "key", "host")

IDENT = re.compile(r"(?i:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})|(?<![A-Za-z0-9+/_-])AKIA[A-Z0-9]{1,15}(?![A-Za-z0-9+/_-])", re.ASCII)
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}", re.ASCII)
LETTER = re.compile(r"[A-Za-z]")
HOST = re.compile(r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|(?<![A-Za-z0-9.-])(?:[a-z0-9-]+\.)+[a-z]{2,}:[0-9]{2,5}(?![0-9])", re.ASCII)
DIGIT = re.compile(r"[0-9]")
BLANK = re.compile(r"\n[ \t]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if DIGIT.search(text) or len(text) >= 24:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def weak_parts(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Identifiers, weak secrets and endpoints that overlap no base span, by start."""
    weak = []
    if ":" in text:
        weak += [(m.start(), m.end(), "host") for m in HOST.finditer(text)]
    if ":" in text or "=" in text or "AKIA" in text:
        weak += [(m.start(), m.end(), "id") for m in IDENT.finditer(text)]
    if not weak and not base:
        return []
    weak += [(m.start(), m.end(), "key") for m in RUN.finditer(text) if DIGIT.search(m[0]) and LETTER.search(m[0])]
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, e, _ in base), max))

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return not k or ends[k - 1] <= start

    return sorted((p for p in weak if free(p[0], p[1])), key=lambda p: (p[0], KINDS.index(p[2])))


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts whose scope holds a complementary part at another place."""
    weak = weak_parts(text, base)
    if not weak:
        return []
    breaks = [m.start() for m in BLANK.finditer(text)]
    parts = sorted([(bisect_left(breaks, s), s, e, kind, kind == "key", False) for s, e, kind in weak] + [(bisect_left(breaks, s), s, e, kind, kind != "access", True) for s, e, kind in base])
    out = []
    for _, scope in groupby(parts, key=lambda p: p[0]):
        held = list(scope)
        places: dict[bool, set] = {True: set(), False: set()}
        for _, s, e, _, secret, _ in held:
            places[secret].add((s, e))
        for _, s, e, kind, secret, strong in held:
            if not strong and len(places[not secret]) > ((s, e) in places[not secret]):
                out.append((s, e, kind))
    return out


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of each document: an array of (start, end, kind) in code points, end exclusive."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def scan(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                rows.append([{"start": s, "end": e, "kind": k} for s, e, k in sorted(base + linked_spans(text or "", base), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, kind)], names=["doc_id", "spans"])

    return clean(docs, "doc_id", "text").mapInArrow(scan, "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def redact_secrets(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """All documents with their columns; every reported span of the text is replaced by `mask`, overlaps by one."""
    at = docs.columns.index("text")

    def redact(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = sorted(base + linked_spans(text, base))
        if not spans:
            return text
        out, end = [], 0
        for s, e, _ in spans:
            if s >= end:
                out += [text[end:s], mask]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def run(batches):
        for batch in batches:
            new = [redact(t) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)
