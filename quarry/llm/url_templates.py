"""Operator 10 [native]: a path-template tree over urls, in DataFrame operations only.

Per host, a level at a time, a path segment stays literal if it is no number, date or long hexadecimal id, has enough
labelled pages, and its labelled share of bad pages differs from its siblings' pooled share (a two-sided test of two
proportions, the siblings being all labelled pages of its parent's further segments but its own); all others are merged
into the wildcard `*`. A template is the path of such segments, one for each segment of the path. Its purity is the
labelled share of good pages smoothed towards the corpus; templates below the limit are blocked.

Levels go on until no path has a further segment. Only parents with good and bad labels enough to part a segment stay
in the frontier: below all others no segment can stay literal, so their paths are completed with wildcards at once and a
path of very many segments costs no rounds.

Fixed rules come first: a rule fits its host and subdomains where the path starts with the rule's, the longest wins.
Urls are folded to distinct (host, path) with counts before anything is joined, and every count is a map-side sum, so
one host with a third of all pages costs no task more than its distinct segments.

Null urls and urls without `://` have empty host and path. A label row with null values counts as good in them;
several for one page: the worst holds. Repeated rows each keep a row. Empty tables give no rows; without labels
nothing is blocked by a template. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage

# Fixed values of the contract: rule, verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SUPPORT, Z2, WEIGHT, LIMIT = 5, 3.84, 8.0, 0.5
VARIABLE = r"^([0-9][0-9._-]*|[0-9a-fA-F]{8}[0-9a-fA-F-]{8,})$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse_urls(pages: DataFrame) -> DataFrame:
    rest = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))


def rule_columns() -> tuple:
    """The longest rule that fits, and its verdict."""
    rule = verdict = None
    for name, what in sorted(RULES, key=lambda r: len(r[0])):
        h, _, p = name.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(f"/{p}")
        rule = F.when(fits, F.lit(name)).otherwise(F.lit(None).cast("string") if rule is None else rule)
        verdict = F.when(fits, F.lit(what)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    return rule, verdict


def path_templates(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, path, n, labelled, bad, template): one row per distinct url path; urls have page_id, host, path."""
    stage = Stage(urls.sparkSession)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    known = urls.join(marks, "page_id", "left")
    part = F.split(F.expr("substr(path, 2)"), "/")
    folded = known.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = stage.write(folded.withColumn("parts", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(part)).withColumn("template", F.lit("")))
    more = lambda k: F.array_join(F.transform(F.slice("parts", k + 1, F.greatest(F.size("parts") - k, F.lit(0))), lambda _: F.lit("/*")), "")
    out, level = [], 0
    while True:
        seg = F.get("parts", F.lit(level))
        branch = tree.select("host", "template", seg.alias("seg"), "labelled", "bad").where("seg is not null").groupBy("host", "template", "seg").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        whole = branch.groupBy("host", "template").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        open_ = stage.write(whole.where((F.col("all_labelled") > SUPPORT) & (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_labelled"))))
        shut = tree.join(open_.select("host", "template"), ["host", "template"], "left_anti").unionByName(tree.where(seg.isNull()).join(open_.select("host", "template"), ["host", "template"], "left_semi"))
        out.append(shut.withColumn("template", F.concat("template", more(level))).drop("parts"))
        if open_.isEmpty():
            break
        here = tree.where(seg.isNotNull()).join(open_.select("host", "template"), ["host", "template"], "left_semi").withColumn("seg", seg)
        names = stage.write(branch.join(open_, ["host", "template"]).where(~F.col("seg").rlike(VARIABLE) & (F.col("labelled") >= SUPPORT) & apart()).select("host", "template", "seg", F.col("seg").alias("name")))
        tree = stage.write(here.join(names, ["host", "template", "seg"], "left").withColumn("template", F.concat_ws("/", "template", F.coalesce("name", F.lit("*")))).drop("seg", "name"))
        level += 1
    return reduce(DataFrame.unionByName, out)


def apart() -> Column:
    """z squared of the branch's share of bad pages against its siblings' is over Z2; the branch is no sibling of itself."""
    n, b, all_n, all_b = (F.col(c).cast("double") for c in ("labelled", "bad", "all_labelled", "all_bad"))
    off = b * all_n - n * all_b
    return off * off * all_n > F.lit(Z2) * (n * (all_n - n) * (all_b * (all_n - all_b)))


def judge_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every page."""
    urls = parse_urls(pages)
    tree = Stage(pages.sparkSession).write(path_templates(urls, labels))
    seen = tree.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad")).first()
    rate = (seen.n - seen.bad) / seen.n if seen.n else 1.0
    counted = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    purity = (F.col("labelled") - F.col("bad") + F.lit(WEIGHT * rate)) / (F.col("labelled") + F.lit(WEIGHT))
    blocked = counted.where(purity < LIMIT).select("host", "template", F.lit(True).alias("blocked"))
    per_path = tree.select("host", "path", "template").join(blocked, ["host", "template"], "left")
    rule, verdict = rule_columns()
    return urls.join(per_path, ["host", "path"], "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "template")
