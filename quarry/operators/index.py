"""Index maintenance as functions from tables to tables (SK1-SK14, JN4-JN6, JN11, FI9-FI14, AG5, PR3).

Parquet tables take no updates, so each function returns the whole new snapshot of a table; who calls writes it
beside the old one and swaps. Ids of new files follow the largest id by rank within ordered partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.staged import staged

#: Entries that mark a project's folder.
MARKERS = (".git", "package.json", "Cargo.toml", "go.mod", "pyproject.toml", "setup.py", "composer.json", "pom.xml", "build.gradle", "build.gradle.kts", "Makefile", "CMakeLists.txt")
FILE_FIELDS = "id long, root_id long, rel_path string, filename string, media_type string, size_bytes long, mtime_ns long, fingerprint string, model_version string, confidence float, extracted_text string, lang_hint string, index_marker long, indexed_at long, deleted_at long"


def reconcile(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """JN11: (root_id, rel_path, file_id, action, size_bytes, mtime_ns, fingerprint) of every path on either side.

    unchanged: same time and size; touched: same content; updated: other content at a live path; moved: a new path with
    the content of a live file that has vanished (pairs by rank, so duplicates stay apart); added: any other new
    path; deleted: a live file that is neither seen nor moved. Files are joined on (root_id, rel_path), and what is
    left on (root_id, fingerprint).
    """
    live = files.where("deleted_at is null").select("root_id", "rel_path", F.col("id").alias("file_id"), *(F.col(c).alias(f"old_{c}") for c in ("size_bytes", "mtime_ns", "fingerprint")))
    both = snapshot.select("root_id", "rel_path", "size_bytes", "mtime_ns", "fingerprint", F.lit(True).alias("seen")).join(live, ["root_id", "rel_path"], "full")
    same = (F.col("old_mtime_ns") == F.col("mtime_ns")) & (F.col("old_size_bytes") == F.col("size_bytes"))
    state = F.when(F.col("seen").isNull(), "gone").when(F.col("file_id").isNull(), "new").when(same, "unchanged").when(F.col("old_fingerprint") == F.col("fingerprint"), "touched").otherwise("updated")
    both = both.withColumn("state", state)
    turn = Window.partitionBy("root_id", "content").orderBy("rel_path")
    new = both.where("state = 'new'").withColumn("content", F.col("fingerprint")).withColumn("turn", F.row_number().over(turn))
    gone = both.where("state = 'gone'").withColumn("content", F.col("old_fingerprint")).withColumn("turn", F.row_number().over(turn))
    pairs = new.select("root_id", "content", "turn", "rel_path", "size_bytes", "mtime_ns", "fingerprint").join(gone.select("root_id", "content", "turn", F.col("file_id").alias("from_id"), F.col("rel_path").alias("from_path")), ["root_id", "content", "turn"], "full")
    cols = ["root_id", F.coalesce("rel_path", "from_path").alias("rel_path"), F.col("from_id").alias("file_id")]
    what = F.when(F.col("from_id").isNull(), "added").when(F.col("rel_path").isNull(), "deleted").otherwise("moved")
    stay = both.where("state in ('unchanged', 'touched', 'updated')").select("root_id", "rel_path", "file_id", F.col("state").alias("action"), "size_bytes", "mtime_ns", "fingerprint")
    return stay.unionByName(pairs.select(*cols, what.alias("action"), "size_bytes", "mtime_ns", "fingerprint"))


def collapse_duplicates(snapshot: DataFrame) -> DataFrame:
    """Compatibility: of the files of one root with equal content only the last path is kept."""
    cols = [F.col(c) for c in snapshot.columns]
    return snapshot.groupBy("root_id", "fingerprint").agg(F.max_by(F.struct(*cols), "rel_path").alias("one")).select("one.*")


def without_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks whose embedding failed: what a repair has to embed again."""
    return chunks.join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def job_counts(actions: DataFrame) -> DataFrame:
    """AG5: seven counters; a file is done when it needs nothing more."""
    n = lambda *names: F.count_if(F.col("action").isin(*names))
    return actions.agg(n("unchanged", "touched", "updated", "moved", "added").alias("files_total"), n("unchanged", "touched", "moved").alias("files_done"), n("added").alias("files_added"), n("updated").alias("files_updated"), n("moved").alias("files_moved"), n("deleted").alias("files_deleted"), F.lit(0).cast("long").alias("error_count"))


def numbered(rows: DataFrame, first: int, *order: str) -> DataFrame:
    """Adds id = first, first + 1, ... by `order`: ranks within range partitions plus the rows of partitions before.

    The placed rows are written once, so that both readers below see the same partitions.
    """
    placed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)}))
    sizes = placed.groupBy("_p").count().withColumn("_before", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).select("_p", "_before")
    return placed.join(sizes, "_p").withColumn("id", (F.col("_before") + F.col("_k") + first).cast("long")).drop("_p", "_k", "_before")


def upsert_files(files: DataFrame, rows: DataFrame) -> DataFrame:
    """SK1: rows replace metadata at (root_id, rel_path) and revive it; id, text, confidence and language stay."""
    taken = ["filename", "media_type", "size_bytes", "mtime_ns", "fingerprint", "model_version", "index_marker", "indexed_at"]
    key = ["root_id", "rel_path"]
    new = rows.groupBy(*key).agg(F.max_by(F.struct(*taken), "indexed_at").alias("new"))
    old = files.join(new, key, "left")
    hit = F.col("new").isNotNull()
    kept = old.select(*(F.when(hit, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in taken else F.when(hit, F.lit(None)).otherwise(F.col(c)).cast("long").alias(c) if c == "deleted_at" else F.col(c) for c in files.columns))
    top = files.agg(F.max("id")).first()[0] or 0
    fresh = numbered(new.join(files.select(*key), key, "left_anti").select(*key, "new.*"), top + 1, *key)
    fresh = fresh.withColumns({"confidence": F.lit(1.0).cast("float"), "extracted_text": F.lit(""), "lang_hint": F.lit("unknown"), "deleted_at": F.lit(None).cast("long")})
    return kept.unionByName(fresh.select(files.columns))


def _set(files: DataFrame, where: Column, **values: Column) -> DataFrame:
    return files.select(*(F.when(where, values[c]).otherwise(F.col(c)).cast(files.schema[c].dataType).alias(c) if c in values else F.col(c) for c in files.columns))


def touch_files(files: DataFrame, ids: DataFrame, marker: int, now: int) -> DataFrame:
    """SK2, and the new mtime where `ids` brings one."""
    extra = [F.col("mtime_ns").alias("_mtime")] if "mtime_ns" in ids.columns else [F.lit(None).cast("long").alias("_mtime")]
    joined = files.join(ids.select("id", F.lit(True).alias("_hit"), *extra), "id", "left")
    return _set(joined, F.col("_hit").isNotNull(), index_marker=F.lit(marker), indexed_at=F.lit(now), mtime_ns=F.coalesce("_mtime", "mtime_ns")).select(files.columns)


def move_files(files: DataFrame, moves: DataFrame, marker: int, now: int) -> DataFrame:
    """SK3: (id, rel_path, mtime_ns) get new places; a row that holds the place already is retired first."""
    to = moves.select("id", F.col("rel_path").alias("_path"), F.col("mtime_ns").alias("_mtime"))
    places = files.select("id", "root_id").join(to, "id").select("root_id", F.col("_path").alias("rel_path"), F.col("id").alias("_by"))
    free = files.join(places, ["root_id", "rel_path"], "left").where(F.col("_by").isNull() | (F.col("_by") == F.col("id"))).drop("_by")
    joined = free.join(to, "id", "left")
    name = F.substring_index("_path", "/", -1)
    return _set(joined, F.col("_path").isNotNull(), rel_path=F.col("_path"), filename=name, mtime_ns=F.col("_mtime"), index_marker=F.lit(marker), indexed_at=F.lit(now), deleted_at=F.lit(None)).select(files.columns)


def swept(files: DataFrame, root_id: int, marker: int) -> Column:
    return (F.col("root_id") == root_id) & (F.col("index_marker") != marker) & F.col("deleted_at").isNull()


def sweep_deleted(files: DataFrame, root_id: int, marker: int, now: int) -> DataFrame:
    """SK4."""
    return _set(files, swept(files, root_id, marker), deleted_at=F.lit(now))


def update_content(files: DataFrame, content: DataFrame, now: int) -> DataFrame:
    """SK5: (id, extracted_text, confidence, lang_hint, model_version) replace."""
    new = content.select("id", F.struct("extracted_text", "confidence", "lang_hint", "model_version").alias("_new"))
    joined = files.join(new, "id", "left")
    return _set(joined, F.col("_new").isNotNull(), **{c: F.col(f"_new.{c}") for c in ("extracted_text", "confidence", "lang_hint", "model_version")}, indexed_at=F.lit(now)).select(files.columns)


def replace_chunks(chunks: DataFrame, vectors: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SK6: new holds (id, file_id, chunk_index, text, embedding or null); its files' old chunks and vectors go."""
    changed = new.select("file_id").distinct()
    old = chunks.join(changed, "file_id", "left_semi").select(F.col("id").alias("chunk_id"))
    kept = chunks.join(changed, "file_id", "left_anti").select("id", "file_id", "chunk_index", "text")
    vecs = vectors.join(old, "chunk_id", "left_anti").select("chunk_id", "embedding")
    return kept.unionByName(new.select(kept.columns)), vecs.unionByName(new.where("embedding is not null").select(F.col("id").alias("chunk_id"), "embedding"))


def clear_root(tables: dict[str, DataFrame], root_id: int) -> dict[str, DataFrame]:
    """SK10: files, chunks, chunks_vec, index_jobs and activity_log without what belongs to the root."""
    files = tables["files"].where(F.col("root_id") == root_id).select(F.col("id").alias("file_id"))
    jobs = tables["index_jobs"].where(F.col("root_id") == root_id).select(F.col("id").alias("job_id"))
    gone = tables["chunks"].join(files, "file_id", "left_semi").select(F.col("id").alias("chunk_id"))
    log = tables["activity_log"].where(~F.col("root_id").eqNullSafe(root_id)).join(files, "file_id", "left_anti").join(jobs, "job_id", "left_anti")
    return {
        "files": tables["files"].where(F.col("root_id") != root_id), "chunks": tables["chunks"].join(files, "file_id", "left_anti"), "chunks_vec": tables["chunks_vec"].join(gone, "chunk_id", "left_anti"),
        "index_jobs": tables["index_jobs"].where(~F.col("root_id").eqNullSafe(root_id)), "activity_log": log.select(tables["activity_log"].columns),
    }


def clear_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """SK11: all but roots emptied; roots lose their time of indexing."""
    return {k: (v.withColumn("last_indexed_at", F.lit(None).cast("long")) if k == "roots" else v.limit(0)) for k, v in tables.items()}


def pending(files: DataFrame) -> DataFrame:
    """FI11."""
    return files.where((F.col("model_version") == "") & F.col("deleted_at").isNull())


def repo_confidence(files: DataFrame, entries: DataFrame, penalty: float = 0.5) -> DataFrame:
    """FI12, PR3: files below a directory that holds a project marker count half.

    files: root_id, rel_path, confidence; entries: root_id, rel_path of all directory entries, hidden ones included.
    """
    parent = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    homes = entries.where(F.substring_index("rel_path", "/", -1).isin(*MARKERS)).select("root_id", parent(F.col("rel_path")).alias("dir")).distinct()
    parts = F.split(parent(F.col("rel_path")), "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    inside = files.select("root_id", "rel_path", F.explode(F.array_distinct(up)).alias("dir")).join(homes, ["root_id", "dir"], "left_semi").select("root_id", "rel_path", F.lit(True).alias("_repo")).distinct()
    joined = files.join(inside, ["root_id", "rel_path"], "left")
    return joined.withColumn("in_repo", F.col("_repo").isNotNull()).withColumn("confidence", F.when(F.col("_repo"), F.col("confidence") * penalty).otherwise(F.col("confidence")).cast("float")).drop("_repo")


def latest_jobs(events: DataFrame) -> DataFrame:
    """SK12: the last state of each job by seq."""
    cols = [c for c in events.columns if c not in ("job_id", "seq")]
    return events.groupBy("job_id").agg(F.max_by(F.struct(*cols), "seq").alias("s")).select("job_id", "s.*")


def completed_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """FI13, TK8."""
    return jobs.where((F.col("status") == "completed") & F.col("completed_at").isNotNull()).orderBy(F.desc("completed_at"), F.desc("id")).limit(limit)


def recover_jobs(jobs: DataFrame, now: int) -> DataFrame:
    """FI14: what still runs was interrupted."""
    return _set(jobs, F.col("status") == "running", status=F.lit("interrupted"), updated_at=F.lit(now))


def active_roots(roots: DataFrame) -> DataFrame:
    return roots.where("active").orderBy("created_at", "id")
