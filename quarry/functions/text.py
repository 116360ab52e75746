"""Column expressions over text: tokens, chunks, snippets, names (ST1-ST14, SC2, SC8, WN5)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and what is left without them, by the decomposition of each code point.
_PAIRS = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.combining(unicodedata.normalize("NFD", chr(c))[-1])]
FOLD_FROM, FOLD_TO = ("".join(p) for p in zip(*_PAIRS, strict=True))
SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"
MEDIA = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "xlsm": "xlsx", "csv": "csv", "txt": "txt", "md": "md", "png": "png", "jpg": "jpg", "jpeg": "jpg", "webp": "webp"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(F.translate(_col(c), FOLD_FROM, FOLD_TO)), FOLD_FROM, FOLD_TO), r"\p{Mn}", "")


def tokens(c: Column | str) -> Column:
    """ST2: runs of letters, digits and private-use characters of the folded text."""
    return F.filter(F.split(fold(c), SEPARATORS), lambda x: x != "")


def spaced(c: Column | str) -> Column:
    """Tokens, each between two blanks, as one string: what phrase counts look into."""
    return F.concat(F.lit(" "), F.array_join(tokens(c), "  "), F.lit(" "))


def phrase_count(spaced_text: Column, phrase: list[str]) -> Column:
    """ST1: how often the phrase's tokens occur in a row. An empty phrase never does."""
    if not phrase:
        return F.lit(0).cast("long")
    m = len(phrase)
    if any(phrase[k:] == phrase[: m - k] for k in range(1, m)):  # occurrences may overlap
        words = F.filter(F.split(spaced_text, " "), lambda x: x != "")
        places = F.when(F.size(words) >= m, F.sequence(F.lit(1), F.size(words) - (m - 1))).otherwise(F.array().cast("array<int>"))
        want = F.array(*map(F.lit, phrase))
        return F.size(F.filter(places, lambda i: F.slice(words, i, m) == want)).cast("long")
    text = " " + "  ".join(phrase) + " "
    return ((F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(text), F.lit("")))) / F.lit(len(text))).cast("long")


def fold_text(text: str) -> str:
    """The driver's twin of fold, for queries."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return unicodedata.normalize("NFC", plain).lower()


def query_tokens(query: str) -> list[str]:
    out, word = [], ""
    for c in fold_text(query) + " ":
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def words(c: Column | str) -> Column:
    """ST3: runs of anything but Unicode white space."""
    return F.filter(F.split(_col(c), r"(?U)\s+"), lambda x: x != "")


def chunks(c: Column | str, size: int = 256, overlap: int = 32) -> Column:
    """WN5: windows of `size` words that advance by size - overlap, until one reaches the end."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    step = size - overlap

    def cut(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - size) / step).cast("int"))
        at = F.when(F.size(w) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.struct((k * step).alias("start_token"), F.least(k * step + size, F.size(w)).alias("end_token"), F.array_join(F.slice(w, k * step + 1, size), " ").alias("text")))

    return F.get(F.transform(F.array(words(c)), cut), F.lit(0))  # words are split once, not for every chunk


def first_sentences(c: Column | str, most: int = 200) -> Column:
    """ST4: up to the last sentence end within `most` bytes, trimmed; else the first `most` characters."""
    head = F.substring(_col(c), 1, 2 * most)
    # the longest prefix that ends a sentence; shorter ones follow by cutting, until its bytes fit
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(head), F.lit(most)))), lambda i: F.substr(head, i, F.lit(1)).isin(".", "!", "?") & (F.octet_length(F.substr(head, F.lit(1), i)) <= most))
    end = F.array_max(ends)
    return F.when(end.isNotNull(), F.trim(F.regexp_replace(F.regexp_replace(F.substr(head, F.lit(1), end), r"(?U)^\s+", ""), r"(?U)\s+$", ""))).otherwise(F.substring(_col(c), 1, most))


def format_snippet(c: Column | str) -> Column:
    """ST5: escapes for markup, then the match delimiters become mark tags."""
    out = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\x01", "<mark>"), ("\x02", "</mark>")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def highlighted(c: Column | str) -> Column:
    """ST9: the pieces between mark tags; odd ones are highlighted."""
    return F.split(_col(c), "</?mark>")


def match_window(body: str, phrase: list[str], width: int = 30) -> str:
    """ST6: a window of `width` words that starts a little before the first match, matches between \\x01 and \\x02.

    A word matches where its folded form holds the phrase's token; the window is cut with `...`.
    """
    w, m = body.split(), len(phrase)
    plain = [" ".join(query_tokens(x)) for x in w] if m else []
    hits = [i for i in range(len(plain) - m + 1) if plain[i : i + m] == phrase] if m else []
    start = max(0, min((hits[0] if hits else 0) - 5, len(w) - width))
    opens, closes = set(hits), {i + m - 1 for i in hits}
    shown = [("\x01" if i in opens else "") + w[i] + ("\x02" if i in closes else "") for i in range(start, min(len(w), start + width))]
    return ("..." if start else "") + " ".join(shown) + ("..." if start + width < len(w) else "")


def match_snippet(c: Column | str, phrase: list[str], width: int = 30) -> Column:
    """match_window for the rows of a page: word positions are beyond column expressions at a fair cost."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: match_window(t or "", phrase, width))

    return run(_col(c))


def basename(c: Column | str) -> Column:
    return F.substring_index(F.translate(_col(c), "\\", "/"), "/", -1)


def dirname(c: Column | str) -> Column:
    return F.regexp_replace(F.translate(_col(c), "\\", "/"), r"/?[^/]*$", "")


def extension(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(c), r"\.([^./\\]*)$", 1))


def media_type(filename: Column | str) -> Column:
    """SC2: by the lower-cased extension; null if it is not indexed."""
    return F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])[extension(filename)]


LABELS = {"pdf": "PDF", "docx": "Word", "xlsx": "Excel", "csv": "CSV", "txt": "Text", "md": "Markdown", "png": "PNG", "jpg": "JPEG", "jpeg": "JPEG", "webp": "WebP"}


def media_label(c: Column | str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.lower(_col(c))], F.upper(_col(c)))


UNITS = ("B", "KB", "MB", "GB")


def format_bytes(c: Column | str, top: str = "GB", half_even: bool = False) -> Column:
    """ST13: whole bytes, 1024-based, one decimal unless whole, up to `top`; null stays null. Half a tenth goes up, or to the even tenth as in C's printf."""
    n, last = _col(c).cast("long"), UNITS.index(top)

    def shown(i: int) -> Column:
        if not i:
            return F.concat(n, F.lit(" B"))
        value = n.cast("double") / 1024.0**i  # a power of two: this, the part behind the point and ten times that are exact
        whole = F.floor(value)
        tenths = (value - whole) * 10
        tenths = (F.rint(tenths) if half_even else F.floor(tenths + 0.5)).cast("long")
        digits = F.when(n % 1024**i == 0, whole.cast("string")).otherwise(F.concat(F.when(tenths == 10, whole + 1).otherwise(whole), F.lit("."), tenths % 10))
        return F.concat(digits, F.lit(f" {UNITS[i]}"))

    out = shown(last)
    for i in reversed(range(last)):
        out = F.when(n < 1024 ** (i + 1), shown(i)).otherwise(out)
    return out


def relative_time(seconds: Column | str, now: Column | int) -> Column:
    """DT2: just now, minutes, hours, days below 30, else the date as in `Jan 5, 2026`."""
    age = (F.lit(now) if isinstance(now, int) else now) - _col(seconds)
    return (
        F.when(age < 60, "just now").when(age < 3600, F.concat(F.floor(age / 60), F.lit("m ago"))).when(age < 86400, F.concat(F.floor(age / 3600), F.lit("h ago")))
        .when(age < 30 * 86400, F.concat(F.floor(age / 86400), F.lit("d ago"))).otherwise(F.date_format(F.timestamp_seconds(_col(seconds)), "MMM d, yyyy"))
    )


def progress_percent(complete: Column, phase: Column, total: Column, done: Column, extract_total: Column, extract_done: Column) -> Column:
    """MA8."""
    t, d = (F.when(phase == "extracting", a).otherwise(b) for a, b in ((extract_total, total), (extract_done, done)))
    return F.when(complete, 100).otherwise(F.when(t > 0, F.floor(d * 100.0 / t + 0.5)).otherwise(0)).cast("long")


def csv_pairs(c: Column | str) -> Column:
    """SC8: each row as `header: value` pairs of non-blank values, rows by line; no quoting, by design."""
    lines = F.split(F.regexp_replace(_col(c), r"\r(\n|$)", "$1"), "\n")
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    heads = F.transform(F.split(F.get(lines, F.lit(0)), ","), trim)

    def row(line: Column) -> Column:
        cells = F.transform(F.split(line, ","), lambda v, i: F.struct(F.get(heads, i).alias("h"), trim(v).alias("v")))
        return F.array_join(F.transform(F.filter(cells, lambda x: (x["v"] != "") & x["h"].isNotNull()), lambda x: F.concat(x["h"], F.lit(": "), x["v"])), ", ")

    body = F.when(F.size(lines) > 1, F.slice(lines, 2, F.greatest(F.lit(1), F.size(lines) - 1))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.filter(F.transform(body, row), lambda r: r != ""), "\n")


def remove_first_token(c: Column | str, token: str) -> Column:
    """ST12: without the first `token` in either case that no letter, digit or underscore adjoins; runs of blanks folded."""
    import re

    out = F.regexp_replace(_col(c), rf"(?is)^(.*?)(?<![a-z0-9_]){re.escape(token)}(?![a-z0-9_])", "$1") if token else _col(c)
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s{2,}", " "), r"(?U)^\s+|\s+$", "")


def format_delta(now: Column | str, base: Column | str) -> Column:
    """MA9: the difference with its sign and three decimals."""
    return F.format_string("%+.3f", _col(now) - _col(base))
