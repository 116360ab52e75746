"""Operator 9: substring dedup by repeated-phrase automata.

Words are coded in an alphabet of 16-bit code points. Of every run of `window` words the smallest phrase of
`PHRASE` words is its anchor, so equal windows share their anchor. Phrases are counted over the corpus by their hashes;
those that recur are sent to the document shards that hold them, where one Aho-Corasick automaton is compiled per shard
and all documents of the shard are streamed through it. Windows whose anchor it locates are candidates. Codes and phrases
only find candidates; these are confirmed by 128 bits over their whole words, each word by its own 128-bit hash, aggregated
over the corpus, and a shard learns which of its windows start earlier in another shard. So every row that crosses a
shuffle is one phrase or window per shard, not per occurrence: a passage that a third of the documents share costs each
shard one row.

Whole copies are folded first: of equal word sequences (by 128 bits of SHA-256) all but the first lose every word if
they have a window.

Rows are told apart by doc_id and the hash of their text, never by doc_id alone: of equal doc_ids the one with the
lesser hash counts as earlier, of equal rows one keeps its words, and every row of the input is one row of the result.
Null texts have no words. Texts with fewer words than the window lose nothing. Overlapping repeats inside one text count
by start. Null doc_id counts as before all others. An empty table gives no rows. Other columns are ignored, or
carried along by `drop_repeats`.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Stage, claim, join_groups, lean, rolling, shuffle_partitions, trim

WINDOW, PHRASE = 20, 6
CODES, FIRST_CODE = 0xD7FF - 0x0800, 0x0800  # code points of one 16-bit unit that are no surrogates
SHARD_WORDS = 600_000
NONE = -(2**63)
BYTES = 1 << 20


_seed = np.random.default_rng(20)
BYTE = _seed.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x2545F4914F6CDD1D
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept for the worker."""
    claim("powers", lambda: _powers.__setitem__(slice(None), [np.ones(1, np.uint64)] * 2))
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            factors = np.full(n + n // 4, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers


def byte_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all words of `raw` (start, end, start, ...) and a quick 64-bit hash of each, which equal words share.

    Blocks of some BYTES are hashed at once, so memory beyond the words themselves does not follow the text.
    """
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(BLANKS[data], prepend=True, append=True)) if raw else np.empty(0, np.int64)
    start, end = edge[::2], edge[1::2]
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        low = start[i]
        j = max(i + 1, int(np.searchsorted(end, low + BYTES, "right")))
        total = BYTE[data[low : end[j - 1]]]
        up, down = powers(len(total))
        total *= up[: len(total)]
        np.cumsum(total, out=total)
        s, e = start[i:j] - low, end[i:j] - low
        h = (total[e - 1] - np.where(s > 0, total[s - 1], np.uint64(0))) * down[s]
        h ^= (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, m in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(m)
        out[i:j] = h ^ (h >> np.uint64(32))
        i = j
    return edge, out


def code_points(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(CODES)).astype(np.uint16) + np.uint16(FIRST_CODE)


def letters(codes: np.ndarray) -> str:
    """Two letters of 256 for each code, from alphabets of their own: a node of an automaton has few children."""
    out = np.empty((len(codes), 2), np.uint16)
    out[:, 0] = (codes >> 8) + np.uint16(0x100)
    out[:, 1] = (codes & 0xFF) + np.uint16(0x300)
    return out.tobytes().decode("utf-16-le")


def anchors(codes: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> np.ndarray:
    """For every window, where its anchor phrase starts: the smallest phrase hash, the leftmost of equal ones."""
    h = rolling(codes.astype(np.uint64), phrase)
    span = window - phrase + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = h[:n].copy(), np.arange(n)
    for k in range(1, span):
        less = h[k : k + n] < best
        np.copyto(best, h[k : k + n], where=less)
        np.copyto(at, np.arange(k, k + n), where=less)
    return at


def later(a: np.ndarray, b: np.ndarray, known_a: np.ndarray, known_b: np.ndarray) -> np.ndarray:
    """Which windows (a, b) equal an earlier one or a known one."""
    a, b = np.concatenate([known_a, a]), np.concatenate([known_b, b])
    order = np.lexsort((b, a))  # stable: known ones come first among equals, then by place
    new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
    out = np.empty(len(a), bool)
    out[order] = ~new
    return out[len(known_a) :]


class Shard:
    """All texts of a shard in one run of words, so that every step is one array operation."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts)
        self.edge, hashes = byte_words(self.raw)
        begins = np.cumsum([0, *(len(r) + 1 for r in texts)])
        self.doc = np.searchsorted(begins, self.edge[::2], "right") - 1
        self.starts = np.searchsorted(self.edge[::2], begins)
        self.codes = code_points(hashes)
        n = len(hashes) - WINDOW + 1
        self.inside = self.doc[: max(n, 0)] == self.doc[WINDOW - 1 :] if n > 0 else np.empty(0, bool)
        self.anchor = anchors(self.codes)
        self.places = np.unique(self.anchor[self.inside]) if n > 0 else np.empty(0, np.int64)
        self.hashes = rolling(self.codes.astype(np.uint64), PHRASE).view(np.int64)[self.places]

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct anchors of the shard's windows, and at how many places each is."""
        return np.unique(self.hashes, return_counts=True)

    def located(self, wanted: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor the automaton of the wanted phrases finds."""
        found = np.isin(self.hashes, wanted)
        if not found.any():
            return np.empty(0, np.int64)
        first = np.unique(self.hashes[found], return_index=True)[1]
        automaton, size = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), 2 * PHRASE
        patterns = letters(self.codes[(self.places[found][first][:, None] + np.arange(PHRASE)).ravel()])
        for i in range(0, len(patterns), size):
            automaton.add_word(patterns[i : i + size])
        automaton.make_automaton()
        hit = np.zeros(len(self.codes), bool)
        ends = np.fromiter((end for end, _ in automaton.iter(letters(self.codes))), np.int64)
        hit[(ends + 1) // 2 - PHRASE] = True
        return np.flatnonzero(self.inside & hit[self.anchor])

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits over the words of the windows that start at `at`, from 128 bits of each of their words."""
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        covered = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
        words = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
        # words and the blanks between them are one run of values; only covered words are taken
        kind = pa.large_binary() if len(self.raw) >= 2**31 else pa.binary()
        ends = self.edge.astype(np.int64 if kind == pa.large_binary() else np.int32)
        run = pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(self.raw)])
        coded = run.take(pa.array(2 * words)).dictionary_encode()
        strong = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist())), np.uint64).reshape(-1, 2)
        each = np.zeros((len(self.codes), 2), np.uint64)
        each[words] = strong[coded.indices.to_numpy()]
        return tuple(rolling(np.ascontiguousarray(each[:, k]), WINDOW, m).view(np.int64)[at] for k, m in enumerate((0x9E3779B97F4A7C15, 0xD1342543DE82EF95)))


def _pass(docs: DataFrame, stats: bool) -> DataFrame:
    """All rows and columns of docs with texts of what is kept, and columns _n_words, _n_removed, _kept_sha256.

    Texts that lose nothing stay as they are. Without `stats` no digest is taken.
    """
    spark, names, schema = docs.sparkSession, docs.columns, docs.schema
    stage = Stage(spark)
    cols = [f"c{i}" for i in range(len(names))]
    key, body = cols[names.index("doc_id")], cols[names.index("text")]
    rows = docs.toDF(*cols).withColumns({"k": F.coalesce(F.col(key).cast("long"), F.lit(NONE)), "o": F.xxhash64(body)})

    def measure(batches):
        for batch in batches:
            words, digests = [], []
            for t in pc.fill_null(batch.column(2).cast(pa.binary()), b"").to_pylist():
                w = t.split()
                words.append(len(w))
                digests.append(hashlib.sha256(b" ".join(w)).digest()[:16] if len(w) >= WINDOW else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.int64()), pa.array(digests, pa.binary())], names=["k", "o", "n_words", "digest"])

    base = stage.write(rows.select("k", "o", body).mapInArrow(lean(measure), "k long, o long, n_words long, digest binary"))
    total = base.agg(F.count("*"), F.sum("n_words")).first()
    n = max(shuffle_partitions(spark), -(-(total[1] or 0) // SHARD_WORDS))
    # all but the first of equal word sequences
    long = base.where("digest is not null").select("k", "o", "digest")
    heads = stage.write(long.groupBy("digest").agg(F.min(F.struct("k", "o")).alias("head"), F.count("*").alias("n")).where("n > 1"))
    copies = stage.write(join_groups(long, heads, "digest", total[0]).where(F.struct("k", "o") > F.col("head")).select("k", "o").distinct())
    # a copy's shard needs its text; both sides carry what the shard is made of
    shard = F.pmod(F.xxhash64("k", "o"), F.lit(n)).cast("int").alias("shard")
    by = rows.select(*cols, "k", "o", shard).groupBy("shard")  # one exchange, which all three passes below read
    as_copy = copies.select(shard, F.lit(0).alias("kind"), F.col("k").alias("a"), F.col("o").alias("b"))

    def told(notes: pa.Table) -> tuple[set, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        kind, a, b = (notes.column(c).to_numpy() for c in ("kind", "a", "b"))
        return set(zip(a[kind == 0].tolist(), b[kind == 0].tolist(), strict=True)), a[kind == 1], (a[kind == 2], b[kind == 2])

    def ordered(table: pa.Table, copy: set) -> tuple[pa.Table, pa.Table, list[bytes]]:
        """The rows that are no copies by (k, o, text), the copies, and the texts of the former."""
        table = table.take(pc.sort_indices(table, [("k", "ascending"), ("o", "ascending"), (body, "ascending")]))
        if copy:
            mask = np.fromiter(((x in copy) for x in zip(table.column("k").to_pylist(), table.column("o").to_pylist(), strict=True)), bool, table.num_rows)
            table, gone = table.filter(pa.array(~mask)), table.filter(pa.array(mask))
        else:
            gone = table.slice(0, 0)
        return table, gone, pc.fill_null(table.column(body).cast(pa.binary()), b"").to_pylist()

    def count(key: tuple, table: pa.Table, notes: pa.Table) -> pa.Table:
        p, many = Shard(ordered(table, told(notes)[0])[2]).phrases()
        return pa.table({"p": p, "n": many, "shard": pa.array(np.full(len(p), key[0].as_py()), pa.int32())})

    def candidates(key: tuple, table: pa.Table, notes: pa.Table) -> pa.Table:
        copy, wanted, _ = told(notes)
        table, _, texts = ordered(table, copy)
        s = Shard(texts)
        at = s.located(wanted)
        a, b = s.windows(at)
        order = np.lexsort((b, a))
        new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]) if len(order) else np.empty(0, bool)
        order = order[new]  # the first of equal windows
        k, o = (table.column(c).to_numpy()[s.doc[at[order]]] if len(order) else np.empty(0, np.int64) for c in ("k", "o"))
        return pa.table({"a": a[order], "b": b[order], "k": k, "o": o, "shard": pa.array(np.full(len(order), key[0].as_py()), pa.int32())})

    def remove(key: tuple, table: pa.Table, notes: pa.Table) -> pa.Table:
        copy, wanted, elsewhere = told(notes)
        table, copied, texts = ordered(table, copy)
        s = Shard(texts)
        at = s.located(wanted)
        gone = np.zeros(len(s.codes) + 1, np.int64)
        if len(at):
            late = at[later(*s.windows(at), *elsewhere)]
            np.add.at(gone, late, 1)
            np.add.at(gone, late + WINDOW, -1)
        off = np.cumsum(gone)[:-1] > 0
        out = []
        for i, (text, was) in enumerate(zip(texts, table.column(body).to_pylist(), strict=True)):
            mine = off[s.starts[i] : s.starts[i + 1]]
            lost = int(mine.sum())
            left = b" ".join([w for w, x in zip(text.split(), mine.tolist(), strict=True) if not x]) if lost else None
            digest = hashlib.sha256(b" ".join(text.split()) if left is None else left).hexdigest() if stats else None
            out.append((was if left is None else left.decode("utf-8", "surrogatepass"), len(mine), lost, digest))
        for text in copied.column(body).to_pylist():
            many = len(text.encode("utf-8", "surrogatepass").split())
            out.append(("", many, many, EMPTY if stats else None))
        whole = pa.concat_tables([table, copied])
        del s, gone, off
        trim()
        new = [pa.array([r[i] for r in out], t) for i, t in enumerate((whole.schema.field(body).type, pa.int64(), pa.int64(), pa.string()))]
        return pa.table({**{c: new[0] if c == body else whole.column(c) for c in cols}, "_n_words": new[1], "_n_removed": new[2], "_kept_sha256": new[3]})

    counted = by.cogroup(as_copy.groupBy("shard")).applyInArrow(count, "p long, n long, shard int")
    recurring = counted.withColumn("n", F.sum("n").over(Window.partitionBy("p"))).where("n > 1")
    two = as_copy.unionByName(recurring.select("shard", F.lit(1).alias("kind"), F.col("p").alias("a"), F.lit(0).cast("long").alias("b")))
    found = by.cogroup(two.groupBy("shard")).applyInArrow(candidates, "a long, b long, k long, o long, shard int")
    same = Window.partitionBy("a", "b")
    shared = found.select("shard", "a", "b", F.min(F.struct("k", "o", "shard")).over(same).alias("head")).where("shard != head.shard")
    three = two.unionByName(shared.select("shard", F.lit(2).alias("kind"), "a", "b"))
    fields = StructType([StructField(c, f.dataType) for c, f in zip(cols, schema.fields, strict=True)]).add("_n_words", "long").add("_n_removed", "long").add("_kept_sha256", "string")
    return by.cogroup(three.groupBy("shard")).applyInArrow(remove, fields).toDF(*names, "_n_words", "_n_removed", "_kept_sha256")


EMPTY = hashlib.sha256(b"").hexdigest()


def repeated_words(docs: DataFrame) -> DataFrame:
    """Of every row doc_id, n_words, n_removed and kept_sha256, the digest of the kept words joined by one space."""
    out = _pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), True)
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_words", "n_removed", "kept_sha256")))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Every row with its columns; where words are removed, text is the kept words joined by one space and n_chars its length."""
    out = _pass(docs, False)
    chars = F.when(F.col("_n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*(chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))
