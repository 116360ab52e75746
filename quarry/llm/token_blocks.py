"""Operator 2: token ids in patched frame-of-reference blocks.

A segment is one binary value: header, document table, block table (start, minimum, width, exceptions of each
block) and payload. A block holds 128 ids: its minimum is subtracted, residuals are packed at the width that
holds `share` of them, and the others are kept as (position, residual) exceptions behind the packed bits.
Segments are rows of a Parquet table, so Spark's commit protocol and any store that Spark reaches serve them.

Null texts are empty; an empty text has no ids but the end id. Rows with equal or null doc_id keep one entry each
(null first; ties: null texts first, then by a hash of the text). Strings that name special tokens become those tokens,
as the tokenizers library does by default; `plain_specials` takes them as text. An empty table gives no segments and no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CachedTokenizer, Stage, clean, shuffle_partitions

BLOCK = 128
PART_ROWS = 200_000
HEAD = struct.Struct("<4sIQIB")
MAGIC = b"PFR1"
BITS = np.frexp(np.arange(65_536.0))[1].astype(np.uint8)


def _spans(w: int):
    """(value, byte, bits that the value lies left of the byte's end) of 8 values of w bits each in w bytes."""
    return [(j, b, (b + 1) * 8 - (j + 1) * w) for j in range(8) for b in range(j * w // 8, ((j + 1) * w - 1) // 8 + 1)]


def _to_bits(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of values below 2^w as rows of bytes, the high bit first."""
    wide = np.ascontiguousarray(values.reshape(-1, 8).T)
    out = np.zeros((w, wide.shape[1]), np.uint8)
    for j, b, left in _spans(w):
        out[b] |= (wide[j] << left if left >= 0 else wide[j] >> -left).astype(np.uint8)
    return np.ascontiguousarray(out.T).reshape(len(values), -1)


def _from_bits(raw: np.ndarray, w: int) -> np.ndarray:
    wide = np.ascontiguousarray(raw.reshape(-1, w).T)
    out = np.zeros((8, wide.shape[1]), np.uint32)
    for j, b, left in _spans(w):
        part = wide[b].astype(np.uint32)
        out[j] |= part >> left if left >= 0 else part << -left
    out &= np.uint32((1 << w) - 1)
    return np.ascontiguousarray(out.T).reshape(len(raw), -1)


def pack_blocks(ids: np.ndarray, share: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Block starts, minima, widths and exception counts, and the payload."""
    ids = np.asarray(ids, np.uint32)
    n = -(-len(ids) // BLOCK)
    if not n:
        return (*(np.empty(0, t) for t in (np.uint32, np.uint32, np.uint8, np.uint8)), b"")
    full = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1], np.uint32)]).reshape(n, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    need = BITS[rest] if rest.max() < len(BITS) else np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    at = min(BLOCK - 1, max(0, int(np.ceil(share * BLOCK)) - 1))
    width = np.partition(need, at, axis=1)[:, at]
    out_of = need > width[:, None]
    n_exc = out_of.sum(axis=1)
    size = BLOCK // 8 * width.astype(np.int64) + 5 * n_exc
    start = np.concatenate([[0], np.cumsum(size)])
    payload = np.zeros(start[-1], np.uint8)
    packed = np.where(out_of, 0, rest)
    for w in np.unique(width):
        if w:
            rows, w = np.flatnonzero(width == w), int(w)
            payload[start[rows][:, None] + np.arange(16 * w)] = _to_bits(packed[rows], w)
    row, col = np.nonzero(out_of)
    if len(row):
        rank = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n_exc)])[row]
        base = start[row] + 16 * width[row].astype(np.int64)
        payload[base + rank] = col
        payload[(base + n_exc[row] + 4 * rank)[:, None] + np.arange(4)] = rest[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    return start[:-1].astype(np.uint32), low, width, n_exc.astype(np.uint8), payload.tobytes()


def unpack_blocks(start, low, width, n_exc, payload: np.ndarray) -> np.ndarray:
    n = len(start)
    out = np.zeros((n, BLOCK), np.uint32)
    start, n_exc = start.astype(np.int64), n_exc.astype(np.int64)
    for w in np.unique(width):
        if w:
            rows, w = np.flatnonzero(width == w), int(w)
            out[rows] = _from_bits(payload[start[rows][:, None] + np.arange(16 * w)], w)
    row = np.repeat(np.arange(n), n_exc)
    if len(row):
        rank = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n_exc)])[row]
        base = start[row] + 16 * width[row].astype(np.int64)
        out[row, payload[base + rank]] = payload[(base + n_exc[row] + 4 * rank)[:, None] + np.arange(4)].reshape(-1, 4).view("<u4")[:, 0]
    return out + low[:, None]


def write_segment(doc_ids: list, lengths: list[int], ids: np.ndarray, share: float = 0.9) -> bytes:
    start, low, width, n_exc, payload = pack_blocks(ids, share)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([
        HEAD.pack(MAGIC, len(doc_ids), len(ids), len(start), 1), known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes(),
        start.astype("<u4").tobytes(), low.astype("<u4").tobytes(), width.tobytes(), n_exc.tobytes(), payload,
    ])


class Segment:
    """Reader of one segment; ids(a, b) decodes only the blocks that hold ids a to b."""

    def __init__(self, raw: bytes):
        magic, docs, self.n, blocks, _ = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        known = take("u1", docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(take("<i8", docs), known, strict=True)]
        self.lengths = take("<u4", docs).astype(np.int64)
        self.blocks = [take(k, blocks) for k in ("<u4", "<u4", "u1", "u1")]
        self.payload = np.frombuffer(raw, np.uint8, offset=at)

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.n if b is None else b
        if a >= b:
            return np.empty(0, np.uint32)
        first, last = a // BLOCK, -(-b // BLOCK)
        return unpack_blocks(*(x[first:last] for x in self.blocks), self.payload).ravel()[a - first * BLOCK : b - first * BLOCK]


SEGMENT_SCHEMA = "part long, seg long, n_docs long, n_tokens long, payload binary"


def write_tokens(docs: DataFrame, tokenizer: str, mode: str, end_id: int, segment_tokens: int = 1_000_000, share: float = 0.9, plain_specials: bool = False) -> DataFrame:
    """Segments (part, seg, n_docs, n_tokens, payload) that hold all documents' ids in ascending doc_id order."""

    def encode(batches):
        from pyspark import TaskContext

        part, seg, tok = TaskContext.get().partitionId(), 0, CachedTokenizer.get(tokenizer, mode, plain_specials=plain_specials)
        keys: list = []
        parts: list[np.ndarray] = []
        lengths: list[int] = []
        n, end = 0, np.array([end_id], np.uint32)

        def flush():
            nonlocal seg
            raw = write_segment(keys, lengths, np.concatenate(parts), share)
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int64()), (seg, pa.int64()), (len(keys), pa.int64()), (n, pa.int64()), (raw, pa.binary()))], names=["part", "seg", "n_docs", "n_tokens", "payload"])
            seg += 1
            return out

        for ids, encoded in tok.batches(batches):
            for key, found in zip(ids, encoded, strict=True):
                keys.append(key)
                parts += [found, end]
                lengths.append(len(found) + 1)
                n += len(found) + 1
                if n >= segment_tokens:
                    yield flush()
                    keys, parts, lengths, n = [], [], [], 0
        if keys:
            yield flush()

    rows = clean(docs, "doc_id", "text")
    n = max(shuffle_partitions(docs.sparkSession), -(-rows.count() // PART_ROWS))
    tie = [F.col("text").isNotNull(), F.xxhash64("text")]  # ranges split rows of equal or null doc_id, too
    ordered = rows.repartitionByRange(n, "doc_id", *tie).sortWithinPartitions("doc_id", *tie, "text")
    return ordered.mapInArrow(encode, SEGMENT_SCHEMA)


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the segments."""

    def decode(batches):
        for batch in batches:
            for part, seg, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = Segment(raw)
                ids, ends = s.ids().astype("<u4"), np.cumsum(s.lengths)
                begins = ends - s.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(np.full(n, part)), pa.array(np.full(n, seg)), pa.array(begins), pa.array(s.lengths), pa.array(crc, pa.int64())], names=["doc_id", "part", "seg", "begin", "n_tokens", "ids_crc32"])

    rows = segments.select("part", "seg", "payload").mapInArrow(decode, "doc_id long, part long, seg long, begin long, n_tokens long, ids_crc32 long")
    by_part = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    in_part = segments.select("part", "seg", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_tokens")).alias("seg_start"))
    at = in_part.join(by_part, "part").select("part", "seg", (F.col("seg_start") + F.col("part_start")).alias("base"))
    return rows.join(at, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def token_blocks(docs: DataFrame, tokenizer: str, mode: str, end_id: int, **options) -> DataFrame:
    stage = Stage(docs.sparkSession)
    return read_tokens(stage.write(write_tokens(docs, tokenizer, mode, end_id, **options)))
