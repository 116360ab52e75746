"""Directory scans and text extraction (SC1-SC16). Models, OCR and PDF text come in through callables."""

from __future__ import annotations

import hashlib
import io
import math
import os
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import Protocol
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions import text
from quarry.operators.index import MARKERS

MAX_BYTES = 100 * 1024 * 1024
#: Directories that hold no documents.
JUNK = frozenset((
    "node_modules", ".git", ".svn", ".hg", "dist", "build", "out", "target", "coverage", "vendor", ".cache", "__pycache__",
    ".next", ".nuxt", ".svelte-kit", "venv", ".venv", "env", "site-packages", ".eggs", ".pytest_cache", ".mypy_cache",
))
MIN_PARTS = 256
SCAN_SCHEMA = "root_id long, rel_path string, filename string, media_type string, size_bytes long, mtime_ns long, fingerprint string"


def media_type(filename: str) -> str | None:
    return text.MEDIA.get(filename.rpartition(".")[2].lower()) if "." in filename else None


def _folders(folder: str, names: list[str]) -> list[str]:
    return sorted(d for d in names if not d.startswith(".") and d not in JUNK and not os.path.islink(os.path.join(folder, d)))


def folders(root: str, deep: bool = True) -> Iterator[tuple[str, list[str], list[str]]]:
    """(folder, all its folders, all its files) from root on; hidden and junk folders are not entered, links not followed."""
    for folder, dirs, names in os.walk(root, onerror=lambda e: None):
        held = list(dirs)
        dirs[:] = _folders(folder, dirs) if deep else []
        yield folder, held, names


def walk(root: str, deep: bool = True) -> Iterator[tuple[str, os.stat_result]]:
    """Regular files that are indexed, below root or, not deep, in it."""
    for folder, _, names in folders(root, deep):
        for name in sorted(names):
            path = os.path.join(folder, name)
            if name.startswith(".") or media_type(name) is None or os.path.islink(path):
                continue
            try:
                stat = os.stat(path)
            except OSError:
                continue
            if stat.st_size <= MAX_BYTES and os.path.isfile(path):
                yield path, stat


@dataclass
class _Part(InputPartition):
    folder: str
    deep: bool


class _TreeReader(DataSourceReader):
    """Deals a tree to tasks: levels are listed until there are MIN_PARTS folders; each becomes a task with all below it."""

    def __init__(self, root: str, root_id: int):
        self.root, self.root_id = root.rstrip("/") or "/", root_id

    def partitions(self) -> list[InputPartition]:
        flat: list[str] = []
        deep = [self.root]
        while deep and len(deep) < MIN_PARTS:
            flat += deep
            deep = [os.path.join(f, d) for f in deep for d in _folders(f, [e.name for e in _entries(f) if e.is_dir(follow_symlinks=False)])]
        return [*(_Part(f, False) for f in flat), *(_Part(f, True) for f in deep)]

    def rel(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace("\\", "/")


def _entries(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            return list(found)
    except OSError:
        return []


class _ScanReader(_TreeReader):
    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, stat in walk(partition.folder, partition.deep):
            try:
                with open(path, "rb") as f:
                    digest = hashlib.file_digest(f, "sha256").hexdigest()
            except OSError:
                continue
            name = os.path.basename(path)
            yield self.root_id, self.rel(path), name, media_type(name), stat.st_size, max(0, stat.st_mtime_ns), digest


class _MarkerReader(_TreeReader):
    def read(self, partition: _Part) -> Iterator[tuple]:
        for folder, dirs, names in folders(partition.folder, partition.deep):
            for name in {*dirs, *names}.intersection(MARKERS):
                yield self.root_id, self.rel(os.path.join(folder, name))


class DirectorySource(DataSource):
    """spark.read.format("quarry_directory").option("root_id", 1).load(path): one row per indexed file."""

    @classmethod
    def name(cls) -> str:
        return "quarry_directory"

    def schema(self) -> str:
        return SCAN_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ScanReader(self.options["path"], int(self.options.get("root_id", "1")))


class MarkerSource(DataSource):
    """spark.read.format("quarry_markers"): one row per project marker in a folder that is walked."""

    @classmethod
    def name(cls) -> str:
        return "quarry_markers"

    def schema(self) -> str:
        return "root_id long, rel_path string"

    def reader(self, schema) -> DataSourceReader:
        return _MarkerReader(self.options["path"], int(self.options.get("root_id", "1")))


def scan_directory(spark: SparkSession, path: str, root_id: int) -> DataFrame:
    spark.dataSource.register(DirectorySource)
    return spark.read.format("quarry_directory").option("root_id", str(root_id)).load(path)


def directory_markers(spark: SparkSession, path: str, root_id: int) -> DataFrame:
    """(root_id, rel_path) of project markers, hidden ones too, found by the tasks that walk the tree."""
    spark.dataSource.register(MarkerSource)
    return spark.read.format("quarry_markers").option("root_id", str(root_id)).load(path)


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class HashingEmbedder:
    """A stand-in for a model: words hashed to signed dimensions, unit length. Deterministic, no semantics."""

    dim: int = 768

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, t in zip(out, texts, strict=True):
            for w in text.query_tokens(t):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
            row /= np.sqrt((row * row).sum()) or 1
        return out.tolist()


def embed(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Adds embedding; a batch whose call fails keeps null vectors, wrong dimensions are an error of the batch too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                found = embedder(pdf["text"].tolist())
                if any(len(v) != embedder.dim for v in found):
                    raise ValueError("dimension")
            except Exception:  # noqa: BLE001  chunks are kept without vectors
                found = [None] * len(pdf)
            yield pdf.assign(embedding=found)

    schema = ", ".join(f"{c} {k}" for c, k in chunks.dtypes)
    return chunks.mapInPandas(run, f"{schema}, embedding array<float>")


#: A link or image, emphasis or code with its end, or a mark that has none.
INLINE = re.compile(r"!?\[([^\]]*)\]\([^)]*\)|\*\*(.*?)\*\*|\*\*|\*([^*]*)\*|\*|`([^`]*)`|`", re.DOTALL)


def text_lines(body: str) -> list[str]:
    """Lines by line feeds only; a carriage return before one belongs to it."""
    return [x.removesuffix("\r") for x in body.removesuffix("\n").split("\n")] if body else []


def strip_markdown(body: str) -> str:
    """SC7: no heading marks, quotes, emphasis stars or backticks; links and images keep their text, unmatched marks go."""

    def plain(m: re.Match) -> str:
        return m[1] if m[1] is not None else next((x.strip() for x in m.groups()[1:] if x is not None), "")

    out = []
    for line in text_lines(body):
        line = line.strip()
        line = line.lstrip("#").strip()
        line = line.lstrip(">").strip()
        out.append(INLINE.sub(plain, line))
    return "\n".join(out).strip()


def docx_text(raw: bytes) -> str:
    """SC10: top-level paragraphs, their own runs."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    lines = ["".join(t.text or "" for r in p.findall(f"{w}r") for t in r.findall(f"{w}t")) for p in (body.findall(f"{w}p") if body is not None else [])]
    return "\n".join(lines).strip()


#: Number formats of the file format that show dates and times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format is a date: by number, or by its letters outside quotes and brackets."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId", "0")): f.get("formatCode", "") for f in root.iter(f"{_SHEET}numFmt")}
    dated = {i for i, code in own.items() if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[(?![hms]+\])[^\]]*\]|\\.|_.', "", code), re.IGNORECASE)}
    styles = root.find(f"{_SHEET}cellXfs")
    used = [int(x.get("numFmtId", "0")) for x in (styles if styles is not None else [])]
    return {k for k, f in enumerate(used) if (f in dated if f in own else f in DATE_FORMATS)}


def _sheets(z: zipfile.ZipFile) -> list[str]:
    """Paths of the sheets in the workbook's order; by number where the workbook does not say."""
    names = z.namelist()
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        to = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = [to.get(s.get(_LINK), "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")]
        found = [t.lstrip("/") if t.startswith("/") else f"xl/{t}" for t in found if t]
        return [t for t in found if t in names]
    return sorted((x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: int(re.findall(r"\d+", x)[0]))


def plain_number(value: float) -> str:
    """The shortest digits that name the number, never with an exponent; no point for whole ones."""
    if not math.isfinite(value):
        return "NaN" if math.isnan(value) else "inf" if value > 0 else "-inf"
    out = format(Decimal(repr(value)), "f")
    return out.removesuffix(".0")


def xlsx_text(raw: bytes) -> str:
    """SC9: strings, numbers and booleans of all sheets, a blank behind each and a line feed behind each row.

    Dates, times, errors and empty cells are left out. Rows between the first and the last with cells are lines, too.
    """
    n, out = _SHEET, []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{n}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{n}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        dated = _date_styles(z)

        def shown(c) -> str:
            kind, v, inline = c.get("t", "n"), c.findtext(f"{n}v") or "", c.find(f"{n}is")
            if kind == "inlineStr":
                return "".join(t.text or "" for t in inline.iter(f"{n}t")) if inline is not None else ""
            if not v or kind in ("e", "d"):
                return ""
            if kind == "s":
                return shared[int(v)]
            if kind == "b":
                return "true" if v == "1" else "false"
            return v if kind == "str" else "" if int(c.get("s", "0")) in dated else plain_number(float(v))

        for sheet in _sheets(z):
            last = None
            for k, row in enumerate(ElementTree.fromstring(z.read(sheet)).iter(f"{n}row"), 1):
                cells, at = row.findall(f"{n}c"), int(row.get("r", k))
                if cells:
                    out.append("\n" * (at - last - 1 if last else 0) + "".join(f"{x} " for x in map(shown, cells) if x) + "\n")
                    last = at
    return "".join(out).strip()


@dataclass(frozen=True)
class Extracted:
    text: str
    confidence: float = 1.0


@dataclass(frozen=True)
class Extractor:
    """SC15: by media type, models and renderers coming in as callables.

    pdf_pages: bytes to (text layer, OCR text, OCR confidence) per page; pdf_vision: bytes and page numbers to one
    description a page, blank where it failed; describe: image to text.
    """

    pdf_pages: Callable[[bytes], list[tuple[str, str, float]]] | None = None
    describe: Callable[[bytes], str] | None = None
    pdf_vision: Callable[[bytes, list[int]], list[str]] | None = None

    def __call__(self, kind: str, raw: bytes) -> Extracted:
        if kind in ("txt", "md", "csv"):
            body = raw.decode("utf-8")
            return Extracted(strip_markdown(body) if kind == "md" else csv_text(body) if kind == "csv" else body.strip())
        if kind in ("xlsx", "xls", "xlsm"):
            return Extracted(xlsx_text(raw))
        if kind == "docx":
            return Extracted(docx_text(raw))
        if kind == "pdf" and self.pdf_pages:
            return pdf_text(self.pdf_pages(raw), (lambda pages: self.pdf_vision(raw, pages)) if self.pdf_vision else None)
        if kind in ("png", "jpg", "jpeg", "webp") and self.describe:
            return Extracted(self.describe(raw), VISION_CONFIDENCE)
        raise ValueError(f"no extractor for {kind}")


def csv_text(body: str) -> str:
    """SC8: `header: value` pairs of each row's non-blank values; no quoting, by design."""
    lines = text_lines(body)
    heads = [h.strip() for h in lines[0].split(",")] if lines else []
    rows = [", ".join(f"{h}: {v.strip()}" for h, v in zip(heads, line.split(","), strict=False) if v.strip()) for line in lines[1:]]
    return "\n".join(r for r in rows if r).strip()


LEAST_CONFIDENCE = VISION_CONFIDENCE = 0.75  # fixed values


def pdf_text(pages: list[tuple[str, str, float]], vision: Callable[[list[int]], list[str]] | None = None, least: float = LEAST_CONFIDENCE) -> Extracted:
    """SC11-SC13, AG6: text layers; else OCR pages of enough confidence, with their mean, and behind them what vision says
    of the pages that fell short; else what vision says of all pages."""
    layers = [t for t, _, _ in pages if t and t.strip()]
    if layers:
        return Extracted("\n".join(layers).strip())

    def seen(which: list[int]) -> list[str]:
        return [d for d in vision(which) if d and d.strip()] if vision and which else []

    good = [k for k, (_, t, c) in enumerate(pages) if c >= least and t and t.strip()]
    if not good:
        return Extracted("\n\n".join(seen(list(range(len(pages))))).strip(), VISION_CONFIDENCE)
    low = sorted(set(range(len(pages))).difference(good))
    body = "\n\n".join([pages[k][1] for k in good] + seen(low)).strip()
    return Extracted(body, sum(pages[k][2] for k in good) / len(good))


def ocr_files(pages: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """SC12, AG6 over tables: (file_id, page, text, confidence) to (file_id, text, confidence, pages) of the kept pages."""
    kept = pages.where((F.col("confidence") >= least) & (F.trim("text") != ""))
    both = kept.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("t"), F.avg("confidence").alias("confidence"), F.count("*").alias("pages"))
    return both.select("file_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"), "confidence", "pages")


STOPS = {"eng": "the and of to in is that for with", "por": "o que de não uma para com os", "spa": "el que de los una para con las", "fra": "le la les des et une que dans", "deu": "der die das und nicht ein zu den"}


def detect_language(body: str) -> str:
    """ST15: by how often the commonest words of five languages occur in the whole text; `unknown` where none stands out."""
    seen = Counter(text.query_tokens(body))
    score = {k: sum(seen[w] for w in v.split()) for k, v in STOPS.items()}
    best = max(score, key=score.get)
    return best if score[best] and list(score.values()).count(score[best]) == 1 else "unknown"


def extract_files(files: DataFrame, root: str, extractor: Extractor | None = None) -> DataFrame:
    """(id, extracted_text, confidence, lang_hint, model_version, error) of files (id, rel_path, media_type)."""
    extractor = extractor or Extractor()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, rel, kind in pdf.itertuples(index=False):
                try:
                    with open(os.path.join(root, rel), "rb") as f:
                        e = extractor(kind, f.read())
                    rows.append((i, e.text, e.confidence, detect_language(e.text), "ext-v1", None if e.text.strip() else "no text"))
                except Exception as problem:  # noqa: BLE001  a bad file is counted, not fatal
                    rows.append((i, "", 0.0, "unknown", "", str(problem)[:200]))
            yield pd.DataFrame(rows, columns=["id", "extracted_text", "confidence", "lang_hint", "model_version", "error"])

    return files.select("id", "rel_path", "media_type").mapInPandas(run, "id long, extracted_text string, confidence float, lang_hint string, model_version string, error string")


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """SC20: labelled queries from a JSON file, an array or an object with `queries`."""
    raw = spark.read.json(path, multiLine=True)
    rows = raw.select(F.explode("queries").alias("q")).select("q.*") if "queries" in raw.columns else raw
    group = F.col("group") if "group" in rows.columns else F.lit(None).cast("string")
    return rows.select("query", F.col("expectedFiles").alias("relevant"), group.alias("group"))
