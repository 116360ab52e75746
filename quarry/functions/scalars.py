"""Driver-side scalars: dates, cursors, the query parser and model replies (DT1, TK5, QP1-QP9, JS1, JS2)."""

from __future__ import annotations

import base64
import json
import re
import struct
from dataclasses import dataclass, field, replace
from datetime import UTC, date, datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

MEDIA_WORDS = ("pdf", "docx", "xlsx", "csv", "txt", "md", "png", "jpg", "jpeg")  # fixed values
MODES = ("hybrid", "keyword", "semantic")


def date_to_unix(text: str) -> int | None:
    """Midnight UTC of year-month-day; days run over into later months, months are clamped to 1-12; else None."""
    parts = text.split("-")
    if len(parts) != 3:
        return None
    try:
        year, month, day = (int(p) if re.fullmatch(r"[+-]?\d+", p) else int("x") for p in parts)
        first = date(year, min(12, max(1, month)), 1)
    except ValueError:
        return None
    return (first - date(1970, 1, 1)).days * 86400 + (day - 1) * 86400


def date_bounds(start: str | None, end: str | None) -> tuple[int | None, int | None]:
    """FI5-FI7: bounds in nanoseconds; the last second of the end day counts only at its first nanosecond."""
    a, b = (date_to_unix(x) if x else None for x in (start, end))
    return (None if a is None else a * 10**9, None if b is None else (b + 86399) * 10**9)


def encode_cursor(score: float, path: str) -> str:
    return base64.b64encode(f"{struct.unpack('>Q', struct.pack('>d', score))[0]:016x}|{path}".encode()).decode()


def decode_cursor(cursor: str) -> tuple[float, str] | None:
    try:
        bits, _, path = base64.b64decode(cursor, validate=True).decode().partition("|")
        return struct.unpack(">d", struct.pack(">Q", int(bits, 16)))[0], path
    except (ValueError, struct.error):
        return None


@dataclass(frozen=True)
class ParsedQuery:
    query_text: str
    media_types: tuple[str, ...] = ()
    root_scope: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    min_confidence: float = 0.0
    mode: str = "hybrid"
    unresolved: int = field(default=0, compare=False)


def parse_query(text: str, mode: str = "hybrid", today: str | None = None, llm=None) -> ParsedQuery:
    """QP1-QP8: each pass takes the tokens it understands; what is left is the query's text."""
    words = text.strip().split()
    low = [w.lower() for w in words]
    free = [True] * len(words)
    out = ParsedQuery("", mode=mode)

    def take(*at: int) -> None:
        for k in at:
            free[k] = False

    media = [k for k, w in enumerate(low) if w in MEDIA_WORDS]
    take(*media)
    out = replace(out, media_types=tuple(low[k] for k in media))
    year = re.compile(r"\d{4}", re.ASCII)
    said = next((k for k in range(len(low) - 1) if low[k] == "from" and free[k] and free[k + 1] and year.fullmatch(low[k + 1])), None)
    alone = next((k for k, w in enumerate(low) if free[k] and year.fullmatch(w)), None)
    if said is not None or alone is not None:
        k = alone if said is None else said + 1
        take(k, *([] if said is None else [said]))
        out = replace(out, date_from=f"{low[k]}-01-01", date_to=f"{low[k]}-12-31")
    elif "today" in low:
        take(low.index("today"))
        day = today or datetime.now(UTC).date().isoformat()
        out = replace(out, date_from=day, date_to=day)
    scope = []
    for k in range(len(low) - 1):
        if low[k] == "in" and free[k] and free[k + 1] and low[k + 1] not in MEDIA_WORDS:
            take(k, k + 1)
            scope.append(low[k + 1])
    least = 0.0
    for k in range(len(low) - 2):
        if low[k : k + 2] == ["min", "confidence"] and all(free[k : k + 3]) and (m := re.match(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", low[k + 2])):
            take(k, k + 1, k + 2)
            least = float(m[0])
    rest = [w for w, f in zip(words, free, strict=True) if f]
    out = replace(out, root_scope=tuple(scope), min_confidence=least, query_text=" ".join(rest) or text.strip(), unresolved=len(rest))
    if llm and mode != "keyword" and len(words) > 5 and len(rest) > 3:
        try:
            return replace(parse_reply(llm(text)), mode=mode)
        except Exception:  # noqa: BLE001  a model that fails leaves the plain parse
            return out
    return out


PARSED = "query_text string, media_types array<string>, root_scope array<string>, date_from string, date_to string, min_confidence double, unresolved int"


def parse_column(queries, mode: str = "hybrid", today: str | None = None):
    """The deterministic passes over a column of queries, as a struct: Arrow batches, one call of the parser a row."""
    fields = [x.split()[0] for x in PARSED.split(", ")]

    @F.pandas_udf(PARSED)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [parse_query(t or "", mode, today) for t in texts]
        return pd.DataFrame({f: [list(v) if isinstance(v := getattr(p, f), tuple) else v for p in found] for f in fields})

    return run(queries)


def parse_reply(reply: str) -> ParsedQuery:
    """JS1, JS2: the reply's JSON, else its first balanced object, else the query text alone; values are checked."""
    data = _object(reply) or _object(_balanced(reply))
    if data is None:
        m = re.search(r'"queryText"\s*:\s*"((?:[^"\\]|\\.)*)"', reply)
        if not m:
            raise ValueError("no query in the reply")
        data = {"queryText": json.loads(f'"{m[1]}"')}
    texts = lambda k: tuple(x for x in data.get(k) or () if isinstance(x, str))
    least = data.get("minConfidence")
    return ParsedQuery(
        str(data.get("queryText") or ""), tuple(m for m in texts("mediaTypes") if m in MEDIA_WORDS), texts("rootScope"), data.get("dateFrom"), data.get("dateTo"),
        min(1.0, max(0.0, float(least))) if isinstance(least, int | float) else 0.0,
    )


def _object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _balanced(text: str) -> str:
    start, depth, quoted, skip = text.find("{"), 0, False, False
    for k in range(max(start, 0), len(text)) if start >= 0 else ():
        c = text[k]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : k + 1]
    return ""


def today_utc(now: datetime | None = None) -> str:
    return ((now or datetime.now(UTC)).astimezone(UTC)).date().isoformat()


def days_after(day: str, n: int) -> str:
    return (date.fromisoformat(day) + timedelta(days=n)).isoformat()
