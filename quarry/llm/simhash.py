"""Operator 3: SimHash near-duplicates through vantage-point trees.

Distinct fingerprints are partitioned by two vantage-point trees. Each tree measures Hamming distance on one half
of the bits (a metric of its own, never more than the whole distance), because of `radius` differing bits at most
radius // 2 lie in one of the halves. A node sends a fingerprint to the near side if its distance to the vantage
point is at most mu + r and to the far side if it is over mu - r; by the triangle inequality no pair within r is
lost. Every fingerprint has one home leaf and visits later leaves whose region its ball overlaps; each leaf compares
members with members and visitors exactly on all 64 bits. Where halves cannot part a crowd (one half shared by
many), nodes measure all bits with the whole radius. Trees are fitted to a bounded sample of fingerprints; every
fingerprint is routed. A leaf returns a spanning forest of its links, not its pairs, and components follow from
all forests. Leaves that are crowded beyond the sample's estimate are split by local trees of the same kind.

Null, empty or wordless texts have fingerprint zero and are linked like any other. Texts shorter than the shingle
are one shingle. Repeated rows and ties share a fingerprint and so a component; null doc_id are dropped from
components' names but keep their row. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, claim, clean, components, join_groups, lean, trim

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SAMPLE = 131_072
LEAF = 2_048
LOW, HIGH, ALL = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(g, 42) for g in grams]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(raw), 65_536):
        ones += np.unpackbits(raw[i : i + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return clean(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Node:
    """Inner: a vantage point, the bits it measures, mu, the triangle's radius, and both sides. Leaf: its number."""

    point: np.uint64 = np.uint64(0)
    bits: np.uint64 = ALL
    mu: int = 0
    radius: int = 0
    near: Node | None = None
    far: Node | None = None
    leaf: int = -1


def _split(fps: np.ndarray, options: list[tuple[np.uint64, int]], rng) -> tuple | None:
    """The cheapest of some vantage points: few visitors and even sides."""
    best = None
    for bits, radius in options:
        for point in rng.choice(fps, min(4, len(fps)), replace=False):
            d = np.bitwise_count((fps ^ point) & bits)
            hist = np.bincount(d, minlength=65)
            below = np.cumsum(hist)
            for mu in {int(np.searchsorted(below, len(fps) * q)) for q in (0.35, 0.5, 0.65)}:
                near = below[mu]
                if not 0 < near < len(fps):
                    continue
                twice = hist[max(0, mu - radius + 1) : mu + radius + 1].sum()
                cost = twice + abs(2 * int(near) - len(fps)) * 0.5
                if best is None or cost < best[0]:
                    best = (cost, point, bits, mu, radius, d)
        if best is not None and best[0] < 0.8 * len(fps):
            break
    return best


def build_tree(sample: np.ndarray, bits: np.uint64, near_radius: int, radius: int, leaf_rows: int, seed: int = 7) -> tuple[Node, int]:
    rng, leaves = np.random.default_rng(seed), 0
    options = [(bits, near_radius), (ALL, radius)] if bits != ALL else [(ALL, radius)]

    def make(fps: np.ndarray, depth: int) -> Node:
        nonlocal leaves
        best = _split(fps, options, rng) if len(fps) > leaf_rows and depth < 48 else None
        if best is None:
            leaves += 1
            return Node(leaf=leaves - 1)
        _, point, b, mu, r, d = best
        return Node(point, b, mu, r, make(fps[d <= mu], depth + 1), make(fps[d > mu], depth + 1))

    return make(sample, 0), leaves


def route(tree: Node, fps: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows, whether home) for each leaf; a visitor goes only to leaves behind its home."""
    out: list[tuple[int, np.ndarray, np.ndarray]] = []

    def walk(node: Node, rows: np.ndarray, home: np.ndarray) -> None:
        if not len(rows):
            return
        if node.leaf >= 0:
            out.append((node.leaf, rows, home))
            return
        d = np.bitwise_count((fps[rows] ^ node.point) & node.bits).astype(np.int64)
        inside = d <= node.mu
        # what lives on the far side has no business on the near side: the pair is found the other way round
        near = np.where(home, inside, d <= node.mu + node.radius)
        far = np.where(home, d > node.mu - node.radius, d > node.mu - node.radius)
        walk(node.near, rows[near], home[near])
        walk(node.far, rows[far], (home & ~inside)[far])

    walk(tree, np.arange(len(fps)), np.ones(len(fps), bool))
    return out


def _forest(fps: np.ndarray, home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members and members or visitors."""
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    members, edges = np.flatnonzero(home), []
    for i in range(0, len(fps), 256):
        rows = fps[i : i + 256]
        for k in range(0, len(members), 16_384):
            cols = members[k : k + 16_384]
            a, b = np.nonzero(np.bitwise_count(rows[:, None] ^ fps[cols][None, :]) <= radius)
            for x, y in zip((a + i).tolist(), cols[b].tolist(), strict=True):
                if x != y and (x < y or not home[x]):
                    p, q = root(x), root(y)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        edges.append((x, y))
    return edges


def leaf_links(fps: np.ndarray, home: np.ndarray, radius: int, limit: int = 4 * LEAF) -> list[tuple[int, int]]:
    """Links of one leaf; beyond `limit` rows a local tree on all bits parts it first."""
    if len(fps) > limit:
        tree, leaves = build_tree(np.random.default_rng(3).choice(fps, min(len(fps), 8 * LEAF), replace=False), ALL, radius, radius, LEAF)
        if leaves > 1:
            out = []
            for _, rows, own in route(tree, fps):
                # every row is routed as a member; the outer home flags only matter for pairs of two visitors
                out += [(int(rows[x]), int(rows[y])) for x, y in _forest(fps[rows], own, radius)]
            return out
    return _forest(fps, home, radius)


def near_links(stage: Stage, distinct: DataFrame, radius: int = 3, leaf_rows: int = LEAF) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all that lie within `radius` bits."""
    n = distinct.count()
    sampled = distinct if n <= SAMPLE else distinct.where(F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n))
    sample = np.array([r.fp for r in sampled.limit(2 * SAMPLE).collect()], np.int64).view(np.uint64)
    sample.sort()
    scale = max(1.0, n / max(len(sample), 1))
    forest = [build_tree(sample, bits, radius // 2, radius, max(8, int(leaf_rows / scale)), seed) for seed, bits in ((7, LOW), (8, HIGH))] if len(sample) else []
    first = [0, forest[0][1]] if forest else []

    def send(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start, (tree, _) in zip(first, forest, strict=True):
                for leaf, rows, home in route(tree, fps):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), start + leaf, np.int64)), pa.array(fps[rows].view(np.int64)), pa.array(home)], names=["leaf", "fp", "home"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(np.int64)
        links = leaf_links(fps.view(np.uint64), pdf["home"].to_numpy(bool), radius)
        trim()
        a, b = (fps[[x[k] for x in links]] for k in (0, 1))
        return pd.DataFrame({"a": a, "b": b})

    routed = distinct.select("fp").mapInArrow(lean(send, 100_000), "leaf long, fp long, home boolean")
    return stage.write(routed.groupBy("leaf").applyInPandas(solve, "a long, b long"))


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most `radius` bits."""
    stage = Stage(docs.sparkSession)
    prints = stage.write(fingerprints(docs, shingle))
    first = stage.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = near_links(stage, first, radius)
    nodes = components(stage, links)
    named = first.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    table = stage.write(named.join(least, "c").select("fp", "component_id"))
    return prints.join(table, "fp").select("doc_id", "fp", "component_id")


VIEWS, VIEW_SHINGLES, SKETCH, BAND, CELL = 16, 4, 256, 0.15, 400_000
MULTS = np.random.default_rng(16).integers(0, 2**64, (VIEWS, 2), np.uint64) | np.uint64(1)  # multiples of one number would order alike
NONE = -(2**63)


def shingles(text: str | None, shingle: int) -> tuple[bytes, np.ndarray]:
    """The normalised words and the sorted distinct hashes of their shingles; texts shorter than one are one."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return b" ".join(words), np.unique(np.fromiter((digest(g, 42) for g in grams), np.uint64))


def views(text: str | None, shingle: int) -> tuple[bytes, list[int], bytes, int]:
    """Digest of the normalised words; SimHash fingerprints of VIEWS samples of the shingle set; its sketch and size.

    A view samples the VIEW_SHINGLES shingles that come first in an order of its own, so texts of similarity s
    have a view in common with probability 1 - (1 - s**4)**16, 0.9998 at 0.8. The sketch holds the SKETCH smallest
    hashes (32 bits), the whole set of texts of fewer shingles.
    """
    words, h = shingles(text, shingle)
    fps, n = [], min(VIEW_SHINGLES, len(h))
    for m, k in MULTS:
        order = h * m
        order ^= order >> np.uint64(32)
        order *= k
        some = h[np.argpartition(order, n - 1)[:n]] if n < len(h) else h
        ones = np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
        fps.append(int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True))
    small = (h >> np.uint64(32)).astype(np.uint32)  # sorted, as h is
    return xxhash.xxh3_128_digest(words), fps, np.unique(small[:SKETCH]).tobytes(), len(h)


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two shingle sets from their sketches; exact up to SKETCH shingles."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.union1d(x, y)
    if max(len(x), len(y)) >= SKETCH - 1:
        both = both[: min(len(x), len(y))]
    return len(np.intersect1d(np.intersect1d(x, y), both)) / max(len(both), 1)


def block_links(ids: np.ndarray, comp: np.ndarray, home: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of home rows with all rows of a block that join what `comp` leaves apart, judged on whole shingle sets."""
    size = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    label, edges = np.unique(comp, return_inverse=True)[1], []
    for x in np.flatnonzero(home):
        if (label == label[x]).all():
            break
        lo = np.searchsorted(flat, sets[x], "left")
        n = np.searchsorted(flat, sets[x], "right") - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for y in np.flatnonzero((both / (size[x] + size - both) >= least) & (label != label[x])):
            if label[y] != label[x]:
                edges.append((int(ids[x]), int(ids[y])))
                label[label == label[y]] = label[x]
    return edges


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with columns c0, c1, ..., their key (k, o), doc_id and the hash of the text, and where text is."""
    names = docs.columns
    cols = [f"c{i}" for i in range(len(names))]
    key, body = cols[names.index("doc_id")], cols[names.index("text")]
    return docs.toDF(*cols).withColumns({"k": F.coalesce(F.col(key).cast("long"), F.lit(NONE)), "o": F.xxhash64(body)}), [body, *cols]


def near_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(gone, twins): keys (k, o) of all rows behind the first of their near-duplicate group, and of firsts that several rows equal.

    A row's key is its doc_id (null: least) and the hash of its text; the least key of a group is its first.

    Exact copies (same normalised words) are folded first. Fingerprints of all views within one bit are linked by the
    vantage-point trees; documents of equal or linked fingerprints are a crowd. Each document is compared with one leader
    of its crowd, then, in crowds of which two components or more are left, with the document of the most links. What
    is still apart is compared in full: all that is outside a crowd's largest component with the whole crowd, in blocks
    of some CELL by CELL shingles, so that crowds of any size are spread and a block fits a task. A link needs shingle
    similarity of `least`: sketches decide where they hold the whole sets; of longer texts they only sift out what is BAND
    (six deviations) below, and the rest is judged on the whole sets.
    """
    stage = Stage(docs.sparkSession)
    rows, (body, *_) = _keyed(docs)

    def run(batches):
        claim("views", None)
        kinds = (pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64())
        for batch in batches:
            found = [views(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in found], t) for i, t in enumerate(kinds))], names=["k", "o", "digest", "fps", "sketch", "size"])

    seen = stage.write(rows.select("k", "o", body).mapInArrow(lean(run), "k long, o long, digest binary, fps array<long>, sketch binary, size long"))
    # one node for each distinct text; its number is fixed by the write
    folded = seen.groupBy("digest").agg(F.min(F.struct("k", "o")).alias("head"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("fps", "sketch", "size")))
    nodes = stage.write(folded.withColumn("id", F.monotonically_increasing_id()))
    held = stage.write(nodes.select("id", F.explode(F.array_distinct("fps")).alias("fp")))
    links = near_links(stage, held.select("fp").distinct(), radius=1)
    crowd = components(stage, links).withColumnRenamed("node", "fp")
    keyed = stage.write(held.join(crowd, "fp", "left").select("id", F.coalesce("component", "fp").alias("key")).distinct())
    sketch = nodes.select("id", "sketch")

    def sift(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            sure = [max(len(p), len(q)) < 4 * (SKETCH - 1) for p, q in zip(x, y, strict=True)]
            ok = [similarity(p, q) >= (least if k else least - BAND) for p, q, k in zip(x, y, sure, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t).filter(pa.array(ok, pa.bool_())) for v, t in ((a, pa.int64()), (b, pa.int64()), (sure, pa.bool_()))], names=["a", "b", "sure"])

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
        both = pairs.join(sketch.withColumnsRenamed({"id": "a", "sketch": "x"}), "a").join(sketch.withColumnsRenamed({"id": "b", "sketch": "y"}), "b").select("a", "b", "x", "y")
        sifted = stage.write(both.mapInArrow(lean(sift), "a long, b long, sure boolean"))
        long = sifted.where("not sure").select("a", "b")
        sets = whole(long.select(F.explode(F.array("a", "b")).alias("id")))
        full = long.join(sets.withColumnsRenamed({"id": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "shingles": "y"}), "b")
        common = F.size(F.array_intersect("x", "y"))  # row by row, so that no batch holds many whole sets
        out = stage.write(sifted.where("sure").select("a", "b").unionByName(full.where(common / (F.size("x") + F.size("y") - common) >= least).select("a", "b")))
        stage.drop(sets)
        return out

    def whole(ids: DataFrame) -> DataFrame:
        """(id, shingles) of nodes, from the text of one of their rows."""

        def run(batches):
            done: set[int] = set()  # equal rows meet in a task and give one set
            for batch in batches:
                ids = batch.column(0).to_pylist()
                first = [k for k, i in enumerate(ids) if not (i in done or done.add(i))]
                batch = batch.take(pa.array(first, pa.int64()))
                sets = [shingles(t, shingle)[1].view(np.int64) for t in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.array(np.concatenate(sets)) if sets else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["id", "shingles"])

        heads = nodes.join(ids.distinct(), "id", "left_semi").select("id", F.col("head.k").alias("k"), F.col("head.o").alias("o"))
        return stage.write(rows.select("k", "o", body).join(heads, ["k", "o"]).select("id", body).mapInArrow(lean(run), "id long, shingles array<long>"))

    def apart(near: DataFrame) -> DataFrame:
        """Crowds of two components or more, with each document's component, that of most, and the shingles in and beside it."""
        full = keyed.join(near.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")).join(nodes.select("id", "size"), "id")
        parts = full.groupBy("key", "c").agg(F.count("*").alias("k"), F.sum("size").alias("w"))
        keys = parts.groupBy("key").agg(F.max(F.struct("k", "c", "w")).alias("m"), F.sum("k").alias("n"), F.sum("w").alias("w"), F.count("*").alias("parts")).where("parts > 1 and n > 2")
        return stage.write(full.join(keys.select("key", F.col("w").alias("all"), F.col("m.c").alias("major"), (F.col("w") - F.col("m.w")).alias("minor")), "key"))

    def solve(table: pa.Table) -> pa.Table:
        sets = [x.values.to_numpy().view(np.uint64) for x in table.column("shingles")]
        trim()
        links = block_links(*(table.column(c).to_numpy() for c in ("id", "c", "home")), sets, least)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    leader = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id")).alias("m"), F.count("*").alias("n")).where("n > 1").select("key", F.col("m.id").alias("b"))
    found = verified(keyed.join(leader, "key").where("id != b"))
    rest = apart(components(stage, found))
    degree = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    hub = rest.join(degree, "id", "left").groupBy("key").agg(F.max(F.struct(F.coalesce("d", F.lit(0)).alias("d"), "id", "c")).alias("m")).select("key", F.col("m.id").alias("b"), F.col("m.c").alias("of"))
    found = found.unionByName(verified(rest.join(hub, "key").where("c != of")))
    rest = apart(components(stage, found))
    high, wide = (F.ceil(F.col(c) / CELL).cast("int") for c in ("minor", "all"))
    row, col = F.pmod(F.xxhash64("id", F.lit(1)), high).cast("int"), F.pmod(F.xxhash64("id", F.lit(2)), wide).cast("int")
    mine = rest.where("c != major").select("key", "id", "c", F.lit(True).alias("home"), row.alias("i"), F.explode(F.sequence(F.lit(0), wide - 1)).alias("j"))
    others = rest.select("key", "id", "c", F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), high - 1)).alias("i"), col.alias("j"))
    cells = mine.unionByName(others).join(whole(rest.select("id")), "id")
    links = stage.write(cells.groupBy("key", "i", "j").applyInArrow(solve, "a long, b long"))
    near = components(stage, found.unionByName(links)).withColumnRenamed("node", "id")
    named = nodes.select("id", "digest", "head", "n").join(near, "id", "left")
    best = named.where("component is not null").groupBy("component").agg(F.min("head").alias("first"))
    more = stage.write(named.join(best, "component", "left").select("digest", "n", F.coalesce("first", "head").alias("first")).where("n > 1 or first != head"))
    total = seen.count()
    mine = stage.write(join_groups(seen.select("k", "o", "digest"), more.select("digest", "n", "first"), "digest", total).select("k", "o", (F.struct("k", "o") == F.col("first")).alias("kept")))
    twins = mine.where("kept").groupBy("k", "o").count().where("count > 1").select("k", "o")
    return mine.where("not kept").select("k", "o").distinct(), stage.write(twins)


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows, with all columns, but for those that near_groups finds behind another; of equal rows one stays."""
    gone, twins = near_groups(docs, shingle, least)
    rows, (_, *cols) = _keyed(docs)
    rest = rows.join(gone.unionByName(twins), ["k", "o"], "left_anti").select(cols)
    if not twins.isEmpty():
        one = rows.join(twins, ["k", "o"], "left_semi").groupBy("k", "o").agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("one"))
        rest = rest.unionByName(one.select("one.*"))
    return rest.toDF(*docs.columns)
