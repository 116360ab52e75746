"""Retrieval metrics as column expressions over arrays (MA4-MA6, AG7, WN3, WN4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at_k(relevant: Column, retrieved: Column, k: int) -> Column:
    hits = F.size(F.filter(F.slice(retrieved, 1, k), lambda x: F.array_contains(relevant, x))) if k > 0 else F.lit(0)
    return F.when((F.size(relevant) > 0) & F.lit(k > 0), hits / F.greatest(F.size(relevant), F.lit(1))).otherwise(0.0)


def reciprocal_rank(relevant: Column, retrieved: Column) -> Column:
    at = F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1))
    return F.coalesce(1.0 / F.array_min(F.filter(at, lambda x: x.isNotNull())), F.lit(0.0))


def ndcg_at_k(relevant: Column, retrieved: Column, k: int, grade: float = 3.0) -> Column:
    """All relevant items have one grade; gains are linear."""
    if k <= 0:
        return F.lit(0.0)
    gain = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), F.lit(grade)).otherwise(0.0) / F.log2(i + 2.0))
    ideal = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(F.size(relevant) - 1, F.lit(0))), 1, k), lambda i: F.lit(grade) / F.log2(i + 2.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(relevant) > 0, total(gain) / total(ideal)).otherwise(0.0)


def evaluate(results: DataFrame, k: int = 10) -> DataFrame:
    """Rows with relevant and retrieved get their three metrics."""
    rel, ret = F.col("relevant"), F.col("retrieved")
    return results.withColumns({"recall": recall_at_k(rel, ret, k), "mrr": reciprocal_rank(rel, ret), "ndcg": ndcg_at_k(rel, ret, k)})


def by_group(scored: DataFrame, groups: tuple[str, ...] = ("A", "B", "C")) -> DataFrame:
    """AG7: means over rows that have relevant items, overall and by group; an empty group is zeros."""
    some = scored.where(F.size("relevant") > 0)
    each = some.select(F.explode(F.array(F.lit("all"), F.col("group"))).alias("group"), "recall", "mrr", "ndcg")
    means = each.groupBy("group").agg(*(F.avg(c).alias(c) for c in ("recall", "mrr", "ndcg")), F.count("*").alias("n"))
    names = scored.sparkSession.createDataFrame([(g,) for g in ("all", *groups)], "group string")
    return names.join(means, "group", "left").na.fill(0.0, ["recall", "mrr", "ndcg"]).na.fill(0, ["n"])
