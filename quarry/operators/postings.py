"""Stored postings: the inverted index behind text search, and its upkeep (SK7, AG10).

A posting is (term, file_id, size, places): the places of a term in a file, those of column k (name, path, text) counted
from k * COLUMN, so that neighbours lie in one column; size is the file's number of tokens. Postings are written in
ranges of (term, file_id), sorted, so that a query's filter on its terms reads few row groups and a term that all
files hold is spread over many. Besides there is one row (file_id, size) per file, whose sums BM25 needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators.staged import staged

COLUMNS = ("filename", "rel_path", "extracted_text")  # fixed values
COLUMN = 1 << 40
POSTINGS = "term string, file_id long, size long, places array<long>"
SIZES = "file_id long, size long"


def make_postings(files: DataFrame) -> DataFrame:
    """The postings of files, one row per term and file. Null columns hold no token; a file without tokens has no posting."""
    each = files.select(F.col("id").alias("file_id"), *(text.tokens(F.coalesce(c, F.lit(""))).alias(f"t{k}") for k, c in enumerate(COLUMNS)))
    sized = each.withColumn("size", reduce(lambda a, b: a + b, (F.size(f"t{k}") for k in range(len(COLUMNS)))).cast("long"))

    def placed(k: int) -> Column:
        return F.transform(f"t{k}", lambda t, i: F.struct(t.alias("term"), (F.lit(k * COLUMN) + i).alias("place")))

    every = F.flatten(F.array(*map(placed, range(len(COLUMNS)))))
    rows = sized.select("file_id", "size", F.explode(every).alias("x")).select("file_id", "size", "x.term", "x.place")
    return rows.groupBy("file_id", "term").agg(F.first("size").alias("size"), F.sort_array(F.collect_list("place")).alias("places")).select("term", "file_id", "size", "places")


def make_sizes(files: DataFrame) -> DataFrame:
    return files.select(F.col("id").alias("file_id"), reduce(lambda a, b: a + b, (F.size(text.tokens(F.coalesce(c, F.lit("")))) for c in COLUMNS)).cast("long").alias("size"))


def ordered(postings: DataFrame) -> DataFrame:
    """Postings as they are to be written: ranges of (term, file_id), sorted."""
    return postings.repartitionByRange("term", "file_id").sortWithinPartitions("term", "file_id")


def store(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, sizes) of files, written."""
    return staged(ordered(make_postings(files))), staged(make_sizes(files))


def upkeep(postings: DataFrame, sizes: DataFrame, files: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SK7: postings and sizes in which the files of `changed` (id) are those of `files`, or gone with them."""
    ids = changed.select(F.col("id").alias("file_id")).distinct()
    now = files.join(changed.select("id").distinct(), "id", "left_semi")
    return postings.join(ids, "file_id", "left_anti").select("term", "file_id", "size", "places").unionByName(make_postings(now)), sizes.join(ids, "file_id", "left_anti").unionByName(make_sizes(now))


def starts(lists: list[Column]) -> Column:
    """The places at which all of a phrase's terms stand one behind the other."""

    def behind(k: int) -> Column:
        return F.transform(lists[k], lambda p: p - k)

    return reduce(F.array_intersect, map(behind, range(len(lists))))


def phrase_hits(postings: DataFrame, phrase: list[str]) -> DataFrame:
    """(file_id, tf, size) of the files that hold the phrase; its terms are joined from the rarest part of the table only."""
    if not phrase:
        return postings.where("false").select("file_id", F.lit(0).cast("long").alias("tf"), "size")
    if len(phrase) == 1:
        return postings.where(F.col("term") == phrase[0]).select("file_id", F.size("places").cast("long").alias("tf"), "size")
    held = postings.where(F.col("term").isin(*dict.fromkeys(phrase))).groupBy("file_id").agg(F.first("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("of"))
    found = held.where(F.size("of") == len(set(phrase)))
    return found.select("file_id", F.size(starts([F.col("of")[t] for t in phrase])).cast("long").alias("tf"), "size").where("tf > 0")
