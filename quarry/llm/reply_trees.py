"""Operator 4: reply trees to conversations.

Nodes (tree, node, parent, score, role, text) form trees. Self-joins that double climb them: every node keeps its
ancestor 2**r steps up and the sum of scores on the way, so a chain of n turns takes log2(n) rounds of as many rows as
there are nodes. That gives the leaves' scores, by which the branches of a tree are ranked (ties by leaf) before any path
is written; only the best `branches` are then expanded, from the joins' own tables, and become one conversation each.

A turn is `<|turn|>`, its role as a JSON string, a line feed, its text and `<|end|>`. Inside roles and texts a control
string is broken by a backslash behind its first character and backslashes are doubled, so nothing but the
template holds a marker and unescaping restores the text. The loss mask covers assistants' texts.

Null text is empty, a null role reads as empty, null scores count 0. A parent that is missing makes its node a
root. Cycles have no root, so nodes on one or below one give no path. A node id must be unique. Repeated (conv_id, turn)
rows stay, by role and text; null turns come first; all rows of a null conv_id are one conversation. An empty table gives
none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, shuffle_partitions

# The strings that steer chat models and this template.
CONTROL = re.compile(r"\\|<(?=\|)|<(?=/?s>)|\[(?=/?INST\])|<(?=</?SYS>>)")
TURN, END = "<|turn|>", "<|end|>"
PART_ROWS = 1_000_000


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the start and length in code points of each assistant text."""
    out, spans, n = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(json.dumps(role, ensure_ascii=False))}\n", escape(text)
        if role == "assistant":
            spans.append((n + len(head), len(body)))
        out += [head, body, END]
        n += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    out = []
    for part in formatted.split(TURN)[1:]:
        head, body = part.removesuffix(END).split("\n", 1)
        out.append((json.loads(unescape(head)), unescape(body)))
    return out


def climb(stage: Stage, nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, total): the sum of scores from each node to its root, and tables (node, up) of ancestors 1, 2, 4, ... steps up.

    A round in which no node reaches its root leaves only nodes on cycles or below them, which have none.
    """
    known = nodes.select(F.col("node").alias("parent"))
    own = nodes.select("node", "parent", "score").join(known, "parent", "left_semi").select("node", F.col("parent").alias("up"), F.col("score").alias("total"))
    roots = nodes.join(own.select("node"), "node", "left_anti").select("node", F.col("score").alias("total"))
    jump, done = stage.write(own), stage.write(roots)
    tables, left = [], jump.count()
    while left:
        tables.append(jump.select("node", "up"))
        far = jump.select(F.col("node").alias("via"), F.col("up").alias("top"), F.col("total").alias("more"))
        ended = done.select(F.col("node").alias("up"), F.col("total").alias("more"))
        reached = jump.join(ended, "up").select("node", (F.col("total") + F.col("more")).alias("total"))
        done = stage.write(done.unionByName(reached))
        jump = stage.write(jump.join(far, F.col("up") == F.col("via")).select("node", F.col("top").alias("up"), (F.col("total") + F.col("more")).alias("total")))
        before, left = left, jump.count()
        if left == before:
            break
    return done, tables


def branch_paths(stage: Stage, leaves: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(leaf, node, up): every node on the way from the given leaves to their roots, `up` steps above the leaf."""
    paths = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for r, jump in enumerate(tables):
        far = paths.join(jump.withColumnRenamed("up", "to"), "node").select("leaf", F.col("to").alias("node"), (F.col("up") + 2**r).alias("up"))
        paths = stage.write(paths.unionByName(far))
    return paths


def reply_conversations(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, score, formatted, spans) of the chosen branches, written to the shared folder."""
    stage = Stage(nodes.sparkSession)
    nodes = stage.write(nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    totals, tables = climb(stage, nodes)
    leaves = nodes.select("tree", "node").join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    weights = leaves.join(totals, "node").select("tree", F.col("node").alias("leaf"), "total")
    if branches is not None:
        weights = weights.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))).where(F.col("r") <= branches).drop("r")
    weights = stage.write(weights)
    turns = branch_paths(stage, weights.select("leaf"), tables).join(nodes.select("node", "role", "text"), "node")
    gathered = turns.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    whole = gathered.join(weights, "leaf").withColumnRenamed("total", "score")

    def run(batches):
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column(3).to_pylist()]
            spans = [[{"start": s, "length": n} for s, n in m[1]] for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(2), pa.array([m[0] for m in made], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))], names=["tree", "leaf", "score", "formatted", "spans"])

    kind = dict(nodes.dtypes)["tree"]
    return stage.write(whole.select("leaf", "tree", "score", "turns").mapInArrow(run, f"tree {kind}, leaf long, score double, formatted string, spans array<struct<start:long,length:long>>"))


def chain_nodes(rows: DataFrame) -> DataFrame:
    """Turns of linear conversations as trees without a fork: each turn replies to the one before.

    Rows are sorted by ranges of (conv_id, turn), so that a long conversation is spread; a node is a row's place in that
    order, fixed by a write. Only the first row of each range looks for its parent in the range before.
    """
    stage = Stage(rows.sparkSession)
    rows = rows.select("conv_id", "turn", "role", "text")
    n = max(shuffle_partitions(rows.sparkSession), -(-rows.count() // PART_ROWS))
    ordered = rows.repartitionByRange(n, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    placed = stage.write(ordered.select(F.monotonically_increasing_id().alias("node"), F.spark_partition_id().alias("part"), "conv_id", "role", "text"))
    ends = placed.groupBy("part").agg(F.min(F.struct("node", "conv_id")).alias("low"), F.max(F.struct("node", "conv_id")).alias("high"))
    before = F.lag("high").over(Window.orderBy("part"))  # one row a range
    joins = ends.select("low", before.alias("last")).where(F.col("low.conv_id").eqNullSafe(F.col("last.conv_id")) & F.col("last").isNotNull())
    joins = joins.select(F.col("low.node").alias("node"), F.col("last.node").alias("joined"))
    first = placed.groupBy("conv_id", "part").agg(F.min("node").alias("node")).select("node", F.lit(True).alias("first"))
    linked = placed.join(first, "node", "left").join(joins, "node", "left")
    parent = F.when(F.col("first"), F.col("joined")).otherwise(F.col("node") - 1)
    return linked.select(F.col("conv_id").cast("long").alias("tree"), "node", parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of each formatted conversation, parsed from its text and mask."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse_turns(text)
                learned = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
                sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), learned)]
                rows.append((len(turns), sha[0], len(learned), sha[1], len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return conversations.select("tree", "formatted", "spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
