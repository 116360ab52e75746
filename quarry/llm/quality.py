"""Operator 7: quality rules as a short-circuit cascade.

Each rule has a predicate over a document's measures and names the measures it needs. Every task takes a sample of its
own rows, drawn over all of them by a hash of a text's last bytes: of one text in SAMPLE_EVERY all measures are taken and timed and
all rules tried. From them the cascade is put in order greedily: next comes the rule that rejects most of the sampled
texts that no rule before it rejects, per second of those of its measures that no rule before it takes; the words, which
all rules share, cost nothing extra. A document that a rule rejects is not tried on later ones, nor are the measures
only those need taken. The order is renewed as the sample doubles; it changes cost, never verdicts: `kept` is true if no
rule rejects, and `rejected_by` of `quality_measures`, which takes all measures anyway, is the first rule as declared.

A task keeps SAMPLE_ROWS rows of rejections and seconds, no texts; nothing is sent to the driver and the table is read
once.

Null texts have no words. Empty texts and texts without a word fail `base`. Very long texts are measured whole.
Repeated rows are judged one by one. Empty tables and empty tasks give no rows. Other columns pass through.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import claim, clean, lean

SYMBOLS = re.compile(rb"[#*$%&|<>]")
SAMPLE_EVERY, SAMPLE_ROWS = 32, 4_096


class Measures:
    """Measures of one text, each taken when first asked for."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        self.n_words = len(self.words)

    def __getattr__(self, name: str):
        value = getattr(self, f"_{name}")()
        setattr(self, name, value)
        return value

    def _word_chars(self) -> int:
        return sum(len(w) for w in self.words) if self.raw.isascii() else len(b"".join(self.words).decode("utf-8", "surrogatepass"))

    def _n_symbols(self) -> int:
        return len(SYMBOLS.findall(self.raw))

    def _lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(b" \t\n\r\v\f")]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, n)
        if len(seen) == n:
            return 0
        m = len(seen)
        pair = ids[:-1] * m + ids[1:]
        if m > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        three = pair[:-1] * m + ids[2:]
        _, inverse, count = np.unique(three, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[inverse] > 1)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[at + k] = True
        return int(covered.sum())

    def _n_marks(self) -> int:
        return sum(w.endswith(b"!!") for w in self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Measures], bool]


#: `base` is the contract's; the others are wide margins around prose, so that clean text stays.
RULES = (
    Rule("base", ("n_repeat_words",), lambda m: m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words),
    Rule("symbols", ("n_symbols",), lambda m: 10 * m.n_symbols > 3 * max(m.n_words, 1)),
    Rule("word_length", ("word_chars",), lambda m: m.n_words > 0 and not 2 * m.n_words <= m.word_chars <= 20 * m.n_words),
    Rule("dup_lines", ("lines", "n_dup_lines"), lambda m: 100 * m.n_dup_lines > 50 * max(len(m.lines), 1)),
    Rule("shouting", ("n_marks",), lambda m: 100 * m.n_marks > 30 * max(m.n_words, 1)),
)


def greedy_order(rejects: np.ndarray, seconds: dict[str, float], rules: tuple[Rule, ...]) -> list[int]:
    """Rules by rejections among texts that are left, per second of measures not yet taken; ties as given.

    rejects: a row per sampled text, a column per rule; seconds: of each measure over the sample.
    """
    left, taken, rest, out = np.ones(len(rejects), bool), set(), list(range(len(rules))), []
    while rest:
        def worth(k: int) -> float:
            return rejects[left, k].sum() / max(sum(seconds.get(x, 0.0) for x in rules[k].needs if x not in taken), 1e-9)

        best = max(rest, key=lambda k: (worth(k), -k))
        rest.remove(best)
        out.append(best)
        left &= ~rejects[:, best]
        taken.update(rules[best].needs)
    return out


class Cascade:
    """The rules in the order that the texts seen so far suggest."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules, self.order = rules, list(range(len(rules)))
        self.names = list(dict.fromkeys(x for r in rules for x in r.needs))
        self.rejects = np.zeros((SAMPLE_ROWS, len(rules)), bool)
        self.seconds = np.zeros((SAMPLE_ROWS, len(self.names)))
        self.n = 0

    def _sample(self, m: Measures) -> None:
        for k, name in enumerate(self.names):
            began = time.perf_counter()
            getattr(m, name)
            self.seconds[self.n, k] = time.perf_counter() - began
        self.rejects[self.n] = [bool(r.rejects(m)) for r in self.rules]
        self.n += 1
        if self.n >= 16 and not self.n & (self.n - 1):
            self.order = greedy_order(self.rejects[: self.n], dict(zip(self.names, self.seconds[: self.n].sum(axis=0).tolist(), strict=True)), self.rules)

    def keeps(self, m: Measures) -> bool:
        if self.n < SAMPLE_ROWS and not crc32(m.raw[-64:]) % SAMPLE_EVERY:
            self._sample(m)
        return not any(self.rules[k].rejects(m) for k in self.order)


def first_failure(m: Measures, rules: tuple[Rule, ...] | list[Rule] = RULES) -> str | None:
    return next((r.name for r in rules if r.rejects(m)), None)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def quality_measures(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Verdict, the first rule as declared that rejects, and the base measures of every document."""
    base = next(r for r in rules if r.name == "base")

    def judge(batches):
        cascade = Cascade(rules)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                m = Measures(text)
                kept = cascade.keeps(m)
                rows.append((*(getattr(m, k) for k in MEASURES), bool(base.rejects(m)), kept, None if kept else first_failure(m, rules)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64())] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", *MEASURES, "base_failed", "kept", "rejected_by"])

    return clean(docs, "doc_id", "text").mapInArrow(judge, SCHEMA)


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns; later rules see only what earlier ones left."""
    at = docs.columns.index("text")

    def keep(batches):
        claim("rules", None)
        cascade = Cascade(rules)
        for batch in batches:
            yield batch.filter(pa.array([cascade.keeps(Measures(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
