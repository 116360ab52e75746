"""Operator 6: embedding near-duplicates by epsilon grid order join.

Unit vectors within cosine c are within eps = sqrt(2 - 2c). Vectors are projected on leading principal axes (fitted
to a bounded sample; the axes are orthonormal, so a projection never lengthens a distance), sorted by their grid cells
of side eps and cut into blocks, which are intervals of that order. Two blocks whose bounding boxes are over eps
apart are provably distant and skipped; the others are joined by halving the longer interval and skipping distant
halves again, until small ones are compared exactly in double precision over all dimensions. Pairs of blocks are
gathered in tiles of 2**TILE by 2**TILE blocks that follow each other in the order; a tile is a task's unit of work and is
sent each of its blocks once, however many pairs the block is in. A pair of blocks returns link counts per vector and
one edge per vector that has links, never its pairs.

Equal vectors of a label are folded first and counted, so a crowd of copies is one vector with a weight. Labels and
dimensions are joined apart. Vectors that are null, empty, zero or hold null or non-finite components, and rows with
a null label or vec_id, have no links and are their own component. Repeated rows count as vectors of their own. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, components

SAMPLE, AXES, BLOCK, SMALL, TILE = 10_000, 8, 1_024, 128, 3


def read_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, digest, vec): vec holds the components as doubles, null where the row links with nothing."""

    def run(batches):
        for batch in batches:
            dims, digests, raws = [], [], []
            ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, label, v in zip(ids, labels, batch.column(2), strict=True):
                x = None
                if i is not None and label is not None and v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                dims.append(None if x is None else len(x))
                raws.append(None if x is None else x.tobytes())
                digests.append(None if x is None else xxhash.xxh3_128_digest(raws[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "label", "dim", "digest", "vec"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, label long, dim int, digest binary, vec binary")


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(sample: np.ndarray, n: int = AXES) -> np.ndarray:
    _, axes = np.linalg.eigh(np.cov(sample.T) if len(sample) > 1 else np.eye(sample.shape[1]))
    return np.atleast_2d(axes)[:, ::-1][:, :n]


class Interval:
    """Rows lo to hi of a block in grid order, with their bounding box on the leading axes."""

    def __init__(self, places: np.ndarray, lo: int, hi: int):
        self.places, self.lo, self.hi = places, lo, hi
        self.low, self.high = places[lo:hi].min(axis=0), places[lo:hi].max(axis=0)

    def halves(self) -> tuple[Interval, Interval]:
        mid = (self.lo + self.hi) // 2
        return Interval(self.places, self.lo, mid), Interval(self.places, mid, self.hi)

    def distant(self, other: Interval, eps: float) -> bool:
        gap = np.maximum(0, np.maximum(self.low - other.high, other.low - self.high))
        return float((gap * gap).sum()) > eps * eps


def ego_join(a: Interval, b: Interval, eps: float, same: bool, visit) -> None:
    """visit(a, b, same) for pairs of small intervals that may hold vectors within eps; same: a and b are one."""
    if not same and a.distant(b, eps):
        return
    if a.hi - a.lo <= SMALL and b.hi - b.lo <= SMALL:
        visit(a, b, same)
    elif same:
        x, y = a.halves()
        for p, q, one in ((x, x, True), (x, y, False), (y, y, True)):
            ego_join(p, q, eps, one, visit)
    elif a.hi - a.lo >= b.hi - b.lo:
        for p in a.halves():
            ego_join(p, b, eps, False, visit)
    else:
        for q in b.halves():
            ego_join(a, q, eps, False, visit)


def join_blocks(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray, axes: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights linked to each row of x, and of y, and the smallest row (x first, then y) reachable by each."""
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    count_x, count_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    found: list[tuple[int, int, np.ndarray]] = []

    def visit(a: Interval, b: Interval, one: bool) -> None:
        near = x[a.lo : a.hi] @ y[b.lo : b.hi].T >= cosine
        if one:
            np.fill_diagonal(near, False)
        if near.any():
            count_x[a.lo : a.hi] += near @ wy[b.lo : b.hi]
            if not one:
                (count_x if same else count_y)[b.lo : b.hi] += near.T @ wx[a.lo : a.hi]
            found.append((a.lo, b.lo, near))

    px, py = x @ axes, y @ axes
    ego_join(Interval(px, 0, len(x)), Interval(py, 0, len(y)), eps, same, visit)
    label = np.arange(len(x) if same else len(x) + len(y))
    moved = bool(found)
    while moved:
        moved = False
        for i, j, near in found:
            p = label[i : i + near.shape[0]]
            q = label[j : j + near.shape[1]] if same else label[len(x) + j : len(x) + j + near.shape[1]]
            low_p = np.minimum(p, np.where(near, q[None, :], len(label)).min(axis=1))
            low_q = np.minimum(q, np.where(near, low_p[:, None], len(label)).min(axis=0))
            moved = moved or bool((low_p < p).any() or (low_q < q).any())
            p[:], q[:] = np.minimum(p, low_p), np.minimum(q, low_q)
    return count_x, count_y, label


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    stage = Stage(vectors.sparkSession)
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    rows = stage.write(read_vectors(vectors))
    key = ["label", "dim", "digest"]
    reps = stage.write(rows.where("dim is not null").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")))
    axes: dict[int, np.ndarray] = {}
    total = reps.count()
    for (dim,) in reps.select("dim").distinct().collect():
        part = reps.where(F.col("dim") == dim)
        some = part.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < max(1, 2_000_000 * SAMPLE // max(total, 1))).select("vec").limit(SAMPLE).collect()
        some = some or part.select("vec").limit(1).collect()
        axes[dim] = principal_axes(unit([r.vec for r in some], dim))

    def place(batches):
        for batch in batches:
            dims, raws = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            cells = []
            for d, raw in zip(dims, raws, strict=True):
                c = np.floor(unit([raw], d) @ axes[d] / eps)[0].astype(int).tolist()
                cells.append(c + [0] * (AXES - len(c)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=["label", "dim", "rep", "n", "vec", "cells"])

    def cut(batches):
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def block():
            nonlocal k
            dim = held[0][1]
            at = unit([h[4] for h in held], dim) @ axes[dim]
            out = pa.RecordBatch.from_pydict({"block": [base + k], "label": [held[0][0]], "dim": [dim], "low": [at.min(axis=0).tolist()], "high": [at.max(axis=0).tolist()], "reps": [[h[2] for h in held]], "ns": [[h[3] for h in held]], "vecs": [b"".join(h[4] for h in held)]},
                                             pa.schema([("block", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("reps", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())), ("vecs", pa.binary())]))
            k += 1
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if held and (len(held) >= BLOCK or held[0][:2] != row[:2]):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    order = ["label", "dim", "cells", "rep"]
    placed = stage.write(reps.select("label", "dim", "rep", "n", "vec").mapInArrow(place, "label long, dim int, rep long, n long, vec binary, cells array<int>"))
    blocks = stage.write(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "block long, label long, dim int, low array<double>, high array<double>, reps array<long>, ns array<long>, vecs binary"))
    # candidate pairs of blocks meet in a cell of the first axis; boxes over eps apart are skipped
    boxes = blocks.select("block", "label", "dim", "low", "high")
    left = boxes.select(*(F.col(c).alias(f"{c}_a") for c in ("block", "low", "high")), "label", "dim", F.explode(F.sequence(F.floor(F.col("low")[0] / eps), F.floor(F.col("high")[0] / eps) + 1)).alias("cell"))
    right = boxes.select(*(F.col(c).alias(f"{c}_b") for c in ("block", "low", "high")), "label", "dim", F.explode(F.sequence(F.floor(F.col("low")[0] / eps), F.floor(F.col("high")[0] / eps) + 1)).alias("cell"))
    gaps = F.zip_with(F.zip_with("low_a", "high_b", lambda p, q: p - q), F.zip_with("low_b", "high_a", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    distance = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    pairs = left.join(right, ["label", "dim", "cell"]).where("block_a <= block_b").where(distance <= eps * eps).select("block_a", "block_b").distinct()
    tiles = stage.write(pairs.select(*(F.shiftright(f"block_{x}", TILE).alias(f"t{x}") for x in "ab"), "block_a", "block_b"))

    def side(x: str) -> DataFrame:
        """The blocks of the tiles' rows (a) or columns (b): one that takes part in a tile is sent to it once."""
        sent = tiles.select("ta", "tb", F.col(f"block_{x}").alias("block")).distinct().join(blocks, "block")
        return sent.toDF(*(f"{c}_{x}" for c in sent.columns))

    def solve(key: tuple, rows: pa.Table, cols: pa.Table) -> pa.Table:
        """All pairs of a tile's blocks whose boxes are near, by the test that made the pairs."""
        out: list[tuple[np.ndarray, ...]] = []
        left, right = ([{c[:-2]: v for c, v in r.items()} for r in t.to_pylist()] for t in (rows, cols))
        right = [(r, unit([r["vecs"]], r["dim"])) for r in right]
        for p in left:
            x = unit([p["vecs"]], p["dim"])
            for q, y in right:
                if p["block"] > q["block"] or (p["label"], p["dim"]) != (q["label"], q["dim"]):
                    continue
                gap = np.maximum(0, np.maximum(np.subtract(p["low"], q["high"]), np.subtract(q["low"], p["high"])))
                if (gap * gap).sum() > eps * eps:
                    continue
                same = p["block"] == q["block"]
                cx, cy, label = join_blocks(x, y, np.array(p["ns"], np.int64), np.array(q["ns"], np.int64), axes[p["dim"]], cosine, same)
                ids = np.array(p["reps"] if same else p["reps"] + q["reps"], np.int64)
                counts = cx if same else np.concatenate([cx, cy])
                hit = np.flatnonzero(counts)
                out.append((ids[hit], ids[label[hit]], counts[hit]))
        cells = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3)]
        return pa.table({"a": cells[0], "b": cells[1], "n": cells[2]})

    found = stage.write(side("a").groupBy("ta_a", "tb_a").cogroup(side("b").groupBy("ta_b", "tb_b")).applyInArrow(solve, "a long, b long, n long"))
    links = found.groupBy("a").agg(F.sum("n").alias("far"))
    group = components(stage, found.where("a != b").select("a", "b"))
    named = stage.write(reps.select(*key, "rep", "n").join(links.withColumnRenamed("a", "rep"), "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left").select(*key, (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = rows.select("vec_id", *key).join(named, key, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
