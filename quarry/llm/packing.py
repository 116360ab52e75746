"""Operator 8: hierarchical packing into several window lengths.

Each document's ids plus an end id are cut at the longest window; whole windows become sequences of their own and
the tail goes to the shortest tier that holds it. Within a pack group windows are filled from the longest tail
down: the gap of a window takes the longest shorter tail that fits, and when none fits, the head of the shortest
tail that is left, whose rest returns to the pool. So only the last window of a group is short; it is cut into
powers of two.

Sequences of all tiers are dealt to steps from the longest down, each to the step with the fewest tokens. Windows are
powers of two, so the steps of a group differ by one window at most and none exceeds `step_tokens`. A group holds
`group_tokens` or more (the rest of a partition joins its last group), which is many steps, so steps of different groups
and partitions differ little, too: by a share of step_tokens / group_tokens, 3.3 % as set. Only a partition that holds less
than one group makes steps by its own total.

Groups hold less than twice `group_tokens`, so a task's memory does not follow its partition. No shuffle: a group is a
run of rows of one input partition, and a lost task packs the same rows again.

Null texts are empty; an empty text is the end id alone. Strings that name special tokens become those tokens, as the
tokenizers library does by default; `plain_specials` takes them as text. Equal or null doc_id are packed row by row. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CachedTokenizer, clean

TIERS = (1024, 512, 256, 128)


def plan_group(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """Sequences (window, tokens, [(item, start, length), ...]) that hold every item's tokens exactly once."""
    top, out, pool = tiers[0], [], []
    for i, n in enumerate(lengths):
        whole = n - n % top
        out += [(top, top, [(i, a, top)]) for a in range(0, whole, top)]
        if n > whole:
            pool.append((n - whole, i, whole))
    pool.sort()
    while pool:
        n, i, a = pool.pop()
        window = min(t for t in tiers if t >= n)
        pieces, gap = [(i, a, n)], window - n
        while gap and pool:
            k = bisect_right(pool, (gap, len(lengths), 0)) - 1
            if k >= 0:
                n, i, a = pool.pop(k)
                pieces.append((i, a, n))
                gap -= n
            else:
                n, i, a = pool.pop(0)
                pieces.append((i, a, gap))
                insort(pool, (n - gap, i, a + gap))
                gap = 0
        if not gap:
            out.append((window, window, pieces))
            continue
        while pieces:  # the last window of the group
            left = sum(p[2] for p in pieces)
            size = 1 << (left.bit_length() - 1)
            now, room = [], size
            while room:
                i, a, n = pieces.pop(0)
                take = min(n, room)
                now.append((i, a, take))
                room -= take
                if take < n:
                    pieces.insert(0, (i, a + take, n - take))
            out.append((size, size, now))
    return out


def deal_steps(windows: list[int], step_tokens: int) -> list[int]:
    """The step of each sequence: as few steps as hold all tokens, filled evenly from the longest window down."""
    steps = [(0, k) for k in range(-(-sum(windows) // step_tokens))]
    out = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -windows[i]):
        held, out[i] = heapq.heappop(steps)
        heapq.heappush(steps, (held + windows[i], out[i]))
    return out


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, window long, step long, ids binary"


def pack_documents(docs: DataFrame, tokenizer: str, mode: str, end_id: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = 65_536, group_tokens: int = 2_000_000, cached_words: int = 1_000_000, plain_specials: bool = False) -> DataFrame:
    """One row per piece: ids (little-endian unsigned 32-bit), its place in document and sequence, window and step."""

    def pack(batches):
        from pyspark import TaskContext

        base, tok, end = TaskContext.get().partitionId() << 36, CachedTokenizer.get(tokenizer, mode, cached_words, plain_specials), np.array([end_id], np.uint32)
        n_seq = n_step = 0

        def packed(group: list[tuple]):
            nonlocal n_seq, n_step
            cols: list[list] = [[] for _ in range(9)]
            found = plan_group([len(ids) for _, ids in group], tiers)
            steps = deal_steps([window for window, *_ in found], step_tokens)
            for (window, _, pieces), step in zip(found, steps, strict=True):
                offset = 0
                for i, a, k in pieces:
                    key, ids = group[i]
                    for c, v in zip(cols, (key, a, k, len(ids), base + n_seq, offset, window, base + n_step + step, ids[a : a + k].tobytes()), strict=True):
                        c.append(v)
                    offset += k
                n_seq += 1
            n_step += max(steps, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:8]] + [pa.array(cols[8], pa.binary())], names=[f.split()[0] for f in SCHEMA.split(", ")])

        full: list[tuple] = []
        group: list[tuple] = []
        n = 0
        for ids, encoded in tok.batches(batches):
            for key, found in zip(ids, encoded, strict=True):
                group.append((key, np.concatenate([found.astype("<u4"), end])))
                n += len(group[-1][1])
                if n >= group_tokens:
                    if full:
                        yield packed(full)
                    full, group, n = group, [], 0
        if full or group:
            yield packed(full + group)

    return clean(docs, "doc_id", "text").mapInArrow(pack, SCHEMA)
