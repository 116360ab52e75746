"""Shared plumbing of the corpus operators: shared-folder staging, word splitting, cached tokenizers, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from array import array
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_CACHE_LIMIT = 1_000_000
HOT = 1_000
BLANK_THEN_SPACE = r" [\s\v\x1c-\x1f\x{85}\p{Z}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The session names it; a local one is made only where the master is local."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        option = sc._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_holder: list = [None, None]


def claim(name: str, release) -> None:
    """One operator at a time keeps caches in a worker: those of the one before are released."""
    if _holder[0] != name:
        if _holder[1]:
            _holder[1]()
            trim()
        _holder[:] = [name, release]


class Stage:
    """Tables written to the shared folder, so that a lost executor costs a re-read and no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        """Write once, return the table as read back."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing still to be run reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def clean(df: DataFrame, key: str, *more: Column) -> DataFrame:
    """The key as long plus the named columns, whatever else the table holds."""
    return df.select(F.col(key).cast("long").alias(key), *more)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group, whose column n is the group's size among `total` rows.

    Groups of more than a HOT-th of all rows are fewer than HOT, so they are broadcast; no other key is large.
    """
    hot, rest = F.broadcast(groups.where(F.col("n") * HOT > total)), groups.where(F.col("n") * HOT <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def rolling(hashes: np.ndarray, width: int, mult: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A mixed 64-bit hash of every run of `width` items."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    m, out = np.uint64(mult), np.zeros(n, np.uint64)
    for k in range(width):
        out = out * m + hashes[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def trim() -> None:
    """Hands freed memory back to the system; a worker lives on through the stages that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run, rows: int = 1_000):
    """A function over Arrow batches that sees at most `rows` rows at a time, and trims what its task leaves behind."""

    def sliced(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield batch.slice(i, rows)

    def task(batches):
        try:
            yield from run(sliced(batches))
        finally:
            trim()

    return task


def strings(values: pa.Array, lead: str = "") -> list[str]:
    """The strings of an array without nulls, each behind `lead`: joined by Arrow and cut at once, which is many times quicker than one by one."""
    if not len(values):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    out = (lead + pc.binary_join(whole, "\0" + lead)[0].as_py()).split("\0")
    return out if len(out) == len(values) else [lead + x for x in values.to_pylist()]


class CachedTokenizer:
    """Whole texts to ids by the tokenizers library, each distinct word encoded once for a worker.

    mode "words": the tokenizer drops white space and never joins across it, so words at blanks and
    line feeds are encoded alone. mode "bytes": a blank opens a token and nothing joins across a blank
    that has no white space behind it; texts with a blank before white space are encoded whole.
    In both a run of letters and the punctuation behind it are tokens apart, so `word,` reuses `word`.
    Strings that name special tokens become those tokens, as the library does by default; texts that hold one are
    encoded whole. With `plain_specials` they are ordinary text (the library's encode_special_tokens). The cache keeps two generations of `limit` words at most, some
    250 bytes each.
    """

    _made: dict[tuple[str, str, bool], CachedTokenizer] = {}
    MARK = "\x01"

    @classmethod
    def get(cls, path: str, mode: str, limit: int = TOKEN_CACHE_LIMIT, plain_specials: bool = False) -> CachedTokenizer:
        claim("tokens", cls._made.clear)
        key = path, mode, plain_specials
        if key not in cls._made:
            cls._made[key] = cls(path, mode, plain_specials)
        cls._made[key].limit = limit
        return cls._made[key]

    def __init__(self, path: str, mode: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # for words; texts that hold a special token are encoded whole
        self.specials = [] if plain_specials else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.mode, self.limit = mode, TOKEN_CACHE_LIMIT
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.kind = np.dtype("<u2") if self.tok.get_vocab_size() < 65536 else np.dtype("<u4")
        self.prefix, self.between = ("", f" {self.MARK} ") if mode == "words" else (" ", f"\n{self.MARK}\n")
        self.mark = self.tok.encode(self.MARK, add_special_tokens=False).ids
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level merges print other bytes from U+0100 on
        self.alphabet = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in printed)}
        self.feed = np.array(self.tok.encode("\n", add_special_tokens=False).ids, self.kind).tobytes()
        self.stops = {c: np.array(self.tok.encode(c, add_special_tokens=False).ids, self.kind).tobytes() for c in ".,"}

    def _whole(self, texts: list[str]) -> list[bytes]:
        self.tok.encode_special_tokens = not self.specials
        try:
            return self._alone(texts)
        finally:
            self.tok.encode_special_tokens = True

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _text(self, word: str) -> str:
        return word[1:] if word[:1] == "\n" else self.prefix + word

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Many words in one call, a mark that is a token of its own between them."""
        out, merges, code = {}, self.tok.model.tokenize, "H" if self.kind.itemsize == 2 else "I"
        for w in words:
            bare = w[1:] if w[:1] == "\n" else w
            if self._plain(bare) and (self.mode == "bytes" or bare == bare.lower()):
                # a run of letters is one unit of the merges, whose alphabet stands for bytes
                raw = (bare if w is not bare else self.prefix + bare).encode().decode("latin-1").translate(self.alphabet)
                out[w] = array(code, [t.id for t in merges(raw)]).tobytes()
        words = [w for w in words if w not in out]
        odd = [w for w in words if not w or self.MARK in w or len(self.mark) != 1 or w[-1].isspace()]
        out.update(zip(odd, self._alone([self._text(w) for w in odd]), strict=True))
        rest = [w for w in words if w not in out]
        gap = 0 if self.mode == "words" else 1
        for i in range(0, len(rest), 256):
            some = rest[i : i + 256]
            ids = np.array(self.tok.encode_batch_fast([self.between.join([self._text(w) for w in some])], add_special_tokens=False)[0].ids, self.kind)
            at = np.flatnonzero(ids == self.mark[0]).tolist()
            if len(at) != len(some) - 1:
                out.update(zip(some, self._alone([self._text(w) for w in some]), strict=True))
                continue
            raw, size = ids.tobytes(), self.kind.itemsize
            for w, a, b in zip(some, [0, *[x + 1 + gap for x in at]], [*[x - gap for x in at], len(ids)], strict=True):
                out[w] = raw[a * size : b * size]
        return out

    def _parts(self, word: str) -> list[tuple[str, str]]:
        """(stem, stop) of each line of a word; the stem of a later line has its line feed in front and no blank."""
        lines = [word]
        if self.mode == "bytes" and "\n" in word:
            split = word.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in split):
                lines = [split[0], *["\n" + x for x in split[1:]]]
        out = []
        for w in lines:
            stop = w[-1] if len(w) > 1 and w[-1] in ".," and self._plain(w[1:-1] if w[0] == "\n" else w[:-1]) else ""
            stem = w[:-1] if stop else w
            if self.mode == "words":
                stem = stem.lower() if stem.isascii() else normalize("NFC", stem).lower() if self._plain(stem) else stem
            out.append((stem, stop))
        return out

    @staticmethod
    def _plain(word: str) -> bool:
        """Letters only, of scripts that no version of Unicode treats otherwise."""
        return word.isalpha() and (word.isascii() or max(word) < "\u0250")

    def _learn(self, seen: set[str]) -> None:
        if len(self.now) + len(seen) > self.limit:
            self.now, self.old = {}, self.now
        now, old = self.now, self.old
        fresh = seen.difference(now)
        split, stops, lower = [], self.stops, self.mode == "words"
        merges, code, lead = self.tok.model.tokenize, "H" if self.kind.itemsize == 2 else "I", "" if lower else chr(self.alphabet[32])
        for w in fresh:
            if w in old:
                now[w] = old[w]
                continue
            stop = stops.get(w[-1:])
            stem = w[:-1] if stop else w
            ascii = stem.isascii()
            if not stem.isalpha() or not ascii and max(stem) >= "\u0250":
                split.append((w, self._parts(w)))
                continue
            if lower:
                stem = stem.lower() if ascii else normalize("NFC", stem).lower()
                if not ascii and not self._plain(stem):
                    split.append((w, self._parts(w)))
                    continue
            ids = now.get(stem) or old.get(stem)
            if ids is None:  # a run of plain letters: the merges' alphabet stands for its bytes, ASCII letters for themselves
                raw = stem if ascii else stem.encode().decode("latin-1").translate(self.alphabet)
                ids = array(code, [t.id for t in merges(lead + raw)]).tobytes()
            now[stem] = ids
            now[w] = ids + stop if stop else ids
        stems = {stem for _, parts in split for stem, _ in parts}.difference(now)
        made = {w: (self.feed + ids if w[:1] == "\n" and self.mode == "bytes" else ids) for w, ids in self._words(list(stems)).items()}
        now.update(made)
        for w, parts in split:
            if len(parts) == 1:
                stem, stop = parts[0]
                now[w] = now[stem] + self.stops[stop] if stop else now[stem]
            else:
                now[w] = b"".join([now[stem] + self.stops[stop] if stop else now[stem] for stem, stop in parts])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's end. A null text is empty.

        Words are split and numbered by Arrow; Python sees each distinct word of the batch once.
        """
        texts = pc.fill_null(texts, "")
        whole = pa.array(np.zeros(len(texts), bool)) if self.mode == "words" else pc.match_substring_regex(texts, BLANK_THEN_SPACE)
        for name in self.specials:
            whole = pc.or_(whole, pc.match_substring(texts, name))
        apart = pc.any(whole).as_py()
        split = pc.if_else(whole, "", texts) if apart else texts
        lists = pc.split_pattern(pc.replace_substring(split, "\n", " ") if self.mode == "words" else split, " ")
        words, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        coded = words.dictionary_encode()
        distinct, row = strings(coded.dictionary), coded.indices.to_numpy()
        self._learn(set(distinct))
        ids = list(map(self.now.__getitem__, distinct))
        if self.mode == "bytes" or apart:  # the first word has no blank before it; texts to be encoded whole stand in its place
            heads = strings(words.take(pa.array(at[:-1])))
            first = [t if w else h for h, w, t in zip(heads, whole.to_pylist(), pc.if_else(whole, texts, "").to_pylist(), strict=True)]
            row = row.copy()
            row[at[:-1]] = len(ids) + np.arange(len(first))
            for i in range(0, len(first), 1024):
                ids += self._whole(first[i : i + 1024])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        held, start, n = np.frombuffer(b"".join(ids), self.kind), np.cumsum(size) - size, size[row]
        ends = np.concatenate([[0], np.cumsum(n)])
        kind = np.int32 if max(len(held), ends[-1]) < 2**31 else np.int64
        place = np.repeat((start[row] - ends[:-1]).astype(kind), n)
        place += np.arange(len(place), dtype=kind)
        return held[place], ends[at[1:]]

    def batches(self, batches, size: int = 4_000_000):
        """(keys, ids of each text) of Arrow batches of (key, text), up to about `size` bytes of text at a time."""
        for batch in batches:
            keys, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
                ids, at = self.encode(texts.slice(a, b - a))
                yield keys.slice(a, b - a).to_pylist(), np.split(ids, at[:-1])
                a = b


def text_batches(batches, size: int = 2_000_000):
    """(ids, texts) lists of up to about `size` characters from Arrow batches of (key, text); null texts are empty."""
    keys, texts, n = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text or "")
            n += len(texts[-1])
            if n >= size:
                yield keys, texts
                keys, texts, n = [], [], 0
    if keys:
        yield keys, texts


def components(stage: Stage, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b), for all nodes that have an edge.

    Alternating large and small stars; every round is an aggregation with map-side minima and a join that
    adaptive execution may split, written to the shared folder. Only a checksum of each round reaches the driver.
    """
    e = stage.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        new = stage.write(small)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        stage.drop(e)
        e = new
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
