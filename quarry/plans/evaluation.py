"""Retrieval evaluation: runs, result files, a promoted baseline, differences, page timings (SK16, MA9, AG8)."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import metrics
from quarry.functions.text import format_delta

METRICS = (("Recall@10", "recallAt10", "recall"), ("MRR", "mrr", "mrr"), ("NDCG@10", "ndcgAt10", "ndcg"))
BASELINE, HISTORY = "baseline.json", "HISTORY.md"


def run_queries(queries: DataFrame, search: Callable[[str], list[str]]) -> DataFrame:
    """Labelled queries (query, relevant, group) with what `search` retrieves, and their metrics; a labelled set is small."""
    spark = queries.sparkSession
    rows = [(r.query, list(r.relevant or []), r.group, list(search(r.query))) for r in queries.select("query", "relevant", "group").collect()]
    return metrics.evaluate(spark.createDataFrame(rows, "query string, relevant array<string>, group string, retrieved array<string>"))


def _aggregate(row) -> dict:
    return {**{name: getattr(row, c) for _, name, c in METRICS}, "numQueries": row.n}


def write_result(folder: str, scored: DataFrame, sha: str, date: str, **meta) -> str:
    """One file `date-sha.json` of the run: its metadata, each query's metrics, means over all and by group."""
    means = {r.group: _aggregate(r) for r in metrics.by_group(scored).collect()}
    each = [{"query": r.query, "group": r.group, "expectedFiles": r.relevant, "retrieved": r.retrieved, **{name: getattr(r, c) for _, name, c in METRICS}} for r in scored.collect()]
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{date}-{sha}.json")
    with open(path, "w") as f:
        json.dump({"runMeta": {"sha": sha, "date": date, **meta}, "perQuery": each, "aggregate": means.pop("all"), "byGroup": means}, f, indent=2)
    return path


def latest_result(folder: str) -> str | None:
    names = sorted(n for n in os.listdir(folder) if n.endswith(".json") and n != BASELINE) if os.path.isdir(folder) else []
    return os.path.join(folder, names[-1]) if names else None


def promote(folder: str, note: str = "") -> str:
    """The latest result becomes the baseline; one line of history says so."""
    path = latest_result(folder)
    if not path:
        raise FileNotFoundError("there is no result to promote")
    shutil.copyfile(path, os.path.join(folder, BASELINE))
    with open(path) as f:
        r = json.load(f)
    a, meta = r["aggregate"], r["runMeta"]
    line = f"{meta['date']} {meta['sha']}: Recall@10={a['recallAt10']:.3f} MRR={a['mrr']:.3f} NDCG={a['ndcgAt10']:.3f} (n={a['numQueries']})" + (f". {note}" if note else "")
    history = os.path.join(folder, HISTORY)
    new = not os.path.exists(history)
    with open(history, "a") as f:
        f.write(("# Eval History\n\n" if new else "") + line + "\n")
    return line


def difference(spark, folder: str, group: str | None = None) -> DataFrame | None:
    """(metric, baseline, current, delta) of the latest result against the baseline, as text; None without a baseline."""
    base, now = os.path.join(folder, BASELINE), latest_result(folder)
    if not os.path.exists(base) or not now:
        return None
    with open(base) as f, open(now) as g:
        old, new = json.load(f), json.load(g)
    if old.get("placeholder") is True:
        return None
    pick = lambda r: (r["byGroup"].get(group) or {}) if group else r["aggregate"]
    rows = [(label, float(pick(old).get(name, 0.0)), float(pick(new).get(name, 0.0))) for label, name, _ in METRICS]
    df = spark.createDataFrame(rows, "metric string, old double, new double")
    return df.select("metric", *(F.format_string("%.3f", c).alias(a) for c, a in (("old", "baseline"), ("new", "current"))), format_delta("new", "old").alias("delta"))


def page_times(pages: DataFrame, *keys: str) -> DataFrame:
    """AG8: least, mean (whole milliseconds, cut) and greatest time of pages that succeeded, zeros without any, and how many failed."""
    ok = F.col("error").isNull()
    ms = F.when(ok, F.col("ms"))
    n = F.count(ms)
    return pages.groupBy(*keys).agg(n.alias("ok"), F.count_if(~ok).alias("errors"), F.coalesce(F.min(ms), F.lit(0)).alias("min_ms"), F.when(n > 0, F.floor(F.sum(ms) / n)).otherwise(0).cast("long").alias("mean_ms"), F.coalesce(F.max(ms), F.lit(0)).alias("max_ms"))
