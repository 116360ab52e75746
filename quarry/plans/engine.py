"""The command surface: roots, indexing, search, activity. State is Parquet snapshots behind one pointer file.

A table is a list of Parquet folders: an appended row is one more folder, any other change a new snapshot written beside
the old. Folders that a change replaces are removed at the change after it, so a frame taken just before stays readable.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalars, text
from quarry.operators import index, postings
from quarry.operators import search as find
from quarry.sources import files as source
from quarry.streaming.incremental import Progress, Snapshot

SCHEMAS = {
    "roots": "id long, path string, label string, active boolean, created_at long, last_indexed_at long",
    "files": index.FILE_FIELDS,
    "chunks": "id long, file_id long, chunk_index int, text string",
    "chunks_vec": "chunk_id long, embedding array<float>",
    "index_jobs": "id long, root_id long, status string, phase string, index_marker long, files_total long, files_done long, files_added long, files_updated long, files_moved long, files_deleted long, error_count long, started_at long, updated_at long, completed_at long",
    "postings": postings.POSTINGS,
    "sizes": postings.SIZES,
    "activity_log": "id long, event_type string, root_id long, file_id long, job_id long, detail string, created_at long",
}
VERSION = 4


class Engine:
    def __init__(self, spark: SparkSession, home: str, embedder: source.Embedder | None = None, extractor: source.Extractor | None = None, llm: Callable[[str], str] | None = None, runtime=None, collapse_duplicates: bool = False):
        """runtime: a ModelServer or what answers like one; collapse_duplicates: equal files of one root are one row."""
        self.spark, self.home, self.embedder, self.extractor, self.llm = spark, home, embedder or source.HashingEmbedder(64), extractor, llm
        self.runtime, self.collapse_duplicates = runtime, collapse_duplicates
        self._progress: Progress | None = None
        os.makedirs(home, exist_ok=True)
        if not os.path.exists(self._pointer):
            self._swap({k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()})
        self._migrate()
        self._swap({"index_jobs": index.recover_jobs(self.table("index_jobs"), int(time.time()))})

    @property
    def _pointer(self) -> str:
        return os.path.join(self.home, "current.json")

    def _state(self) -> dict:
        with open(self._pointer) as f:
            state = json.load(f)
        state["tables"] = {k: [v] if isinstance(v, str) else v for k, v in state["tables"].items()}
        return state

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        return self.spark.read.schema(schema or SCHEMAS[name]).parquet(*self._state()["tables"][name])

    def _point(self, state: dict) -> None:
        with open(self._pointer + ".new", "w") as f:
            json.dump(state, f)
        os.replace(self._pointer + ".new", self._pointer)

    def _write(self, name: str, df: DataFrame) -> str:
        path = os.path.join(self.home, name, uuid.uuid4().hex)
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema
        df.select(*(F.col(x.name).cast(x.dataType).alias(x.name) for x in fields)).write.parquet(path)
        return path

    def _swap(self, new: dict[str, DataFrame], version: int = VERSION) -> None:
        """Write the new snapshots beside the old, then replace the pointer in one step."""
        state = self._state() if os.path.exists(self._pointer) else {"version": version, "tables": {}}
        made = {name: [self._write(name, df)] for name, df in new.items()}
        gone, state["retired"] = state.get("retired", []), [p for name in new for p in state["tables"].get(name, [])]
        state["tables"].update(made)
        self._point(state)
        for path in gone:
            shutil.rmtree(path, ignore_errors=True)

    def _append(self, name: str, row: dict) -> int:
        """One more row, in a folder of its own; the rows before stay where they are."""
        i = (self.table(name).agg(F.max("id")).first()[0] or 0) + 1
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema
        path = self._write(name, self.spark.createDataFrame([tuple({**row, "id": i}.get(f.name) for f in fields)], fields))
        state = self._state()
        state["tables"][name].append(path)
        self._point(state)
        return i

    def _migrate(self) -> None:
        """SK15: states of older versions. 1: no vectors. 2: vectors in a column of chunks. 3: vectors apart, no postings."""
        version = self._state().get("version", VERSION)
        if version >= VERSION:
            return
        new: dict[str, DataFrame] = {}
        if version < 3:
            old = "id long, file_id long, chunk_index int, text string" + (", embedding array<float>" if version == 2 else "")
            chunks = self.table("chunks", old)
            found = chunks.where("embedding is not null").select(F.col("id").alias("chunk_id"), "embedding") if version == 2 else self.spark.createDataFrame([], SCHEMAS["chunks_vec"])
            new |= {"chunks": chunks.select("id", "file_id", "chunk_index", "text"), "chunks_vec": found}
        files = self.table("files")
        new |= {"postings": postings.ordered(postings.make_postings(files)), "sizes": postings.make_sizes(files)}
        self._swap(new)
        state = self._state()
        self._point(state | {"version": VERSION})

    def _index_text(self, files: DataFrame, changed: DataFrame) -> dict[str, DataFrame]:
        """SK7: postings and sizes for the new state of the files in `changed` (id)."""
        p, sizes = postings.upkeep(self.table("postings"), self.table("sizes"), files, changed)
        return {"postings": postings.ordered(p), "sizes": sizes}

    def add_root(self, path: str) -> int:
        path = os.path.realpath(path)
        if not os.path.isdir(path):
            raise ValueError("a root must be a directory")
        label = os.path.basename(path)
        if not label:
            raise ValueError("a root needs a name")
        known = self.table("roots").where(F.col("path") == path).first()
        if known:
            self._swap({"roots": self.table("roots").withColumn("active", F.col("active") | (F.col("id") == known.id))})
            return known.id
        return self._append("roots", {"path": path, "label": label, "active": True, "created_at": int(time.time())})

    def list_roots(self) -> DataFrame:
        return index.active_roots(self.table("roots"))

    def remove_root(self, root_id: int) -> None:
        gone = self.table("files").where(F.col("root_id") == root_id).select("id")
        kept = index.clear_root({k: v for k, v in self._all().items() if k not in ("postings", "sizes")}, root_id)
        self._swap({**kept, **self._index_text(kept["files"], gone), "roots": self.table("roots").withColumn("active", F.col("active") & (F.col("id") != root_id))})

    def clear_index(self) -> None:
        self._swap(index.clear_all(self._all()))

    def _all(self) -> dict[str, DataFrame]:
        return {k: self.table(k) for k in SCHEMAS}

    def progress(self) -> Snapshot | None:
        return self._progress.read() if self._progress else None

    def cancel(self) -> None:
        if self._progress:
            self._progress.cancelled.set()

    def index_root(self, root_id: int) -> dict[str, int]:
        """One incremental scan: reconcile, extract what changed, chunk, embed, write."""
        root = self.table("roots").where(F.col("id") == root_id).first()
        marker, now = time.time_ns(), int(time.time())
        job = self._append("index_jobs", {"root_id": root_id, "status": "running", "phase": "discovering", "index_marker": marker, "started_at": now, "updated_at": now})
        self._append("activity_log", {"event_type": "job_started", "root_id": root_id, "job_id": job, "created_at": now})
        self._progress = progress = Progress(job, root_id)
        held: list[DataFrame] = []
        try:
            scan = source.scan_directory(self.spark, root.path, root_id).persist()
            held.append(scan)
            if self.collapse_duplicates:
                scan = index.collapse_duplicates(scan)
            actions = index.reconcile(self.table("files").where(F.col("root_id") == root_id), scan).persist()
            held.append(actions)
            counts = index.job_counts(actions).first().asDict()
            progress.write(phase="fingerprinting", counts=counts)
            self._stop_if_cancelled(progress)
            self._apply(actions, scan, root_id, marker, now)
            self._stop_if_cancelled(progress)
            errors = self._extract(root, root_id, now, progress)
            counts |= {"error_count": errors, "files_done": counts["files_total"]}
            done = int(time.time())
            jobs = self.table("index_jobs")
            mine = F.col("id") == job
            self._swap({"index_jobs": index._set(jobs, mine, status=F.lit("completed"), phase=F.lit(None), updated_at=F.lit(done), completed_at=F.lit(done), **{k: F.lit(v) for k, v in counts.items()}), "roots": index._set(self.table("roots"), F.col("id") == root_id, last_indexed_at=F.lit(done))})
            self._append("activity_log", {"event_type": "job_completed", "root_id": root_id, "job_id": job, "created_at": done})
            progress.write(is_complete=True, counts=counts)
            return counts
        except Exception:
            state = "cancelled" if progress.cancelled.is_set() else "interrupted"
            self._swap({"index_jobs": index._set(self.table("index_jobs"), F.col("id") == job, status=F.lit(state), phase=F.lit(state), updated_at=F.lit(int(time.time())))})
            raise
        finally:
            for df in held:
                df.unpersist()

    @staticmethod
    def _stop_if_cancelled(progress: Progress) -> None:
        if progress.cancelled.is_set():
            raise InterruptedError("indexing was cancelled")

    def _apply(self, actions: DataFrame, scan: DataFrame, root_id: int, marker: int, now: int) -> None:
        files = self.table("files")
        moves = actions.where("action = 'moved'").select(F.col("file_id").alias("id"), "rel_path", "mtime_ns")
        files = index.move_files(files, moves, marker, now)
        same = actions.where("action in ('unchanged', 'touched')").select(F.col("file_id").alias("id"), "mtime_ns")
        files = index.touch_files(files, same, marker, now)
        fresh = scan.join(actions.where("action in ('added', 'updated')").select("root_id", "rel_path"), ["root_id", "rel_path"], "left_semi")
        self._swap({"files": files})
        rows = fresh.withColumns({"model_version": F.lit(""), "index_marker": F.lit(marker), "indexed_at": F.lit(now)})
        files = index.sweep_deleted(index.upsert_files(self.table("files"), rows), root_id, marker, now)
        self._swap({"files": files})
        # names and paths are searched as well: what is new, moved or retired has other postings
        changed = self.table("files").where((F.col("root_id") == root_id) & (F.col("index_marker") == marker)).select("id")
        gone = self.table("sizes").select(F.col("file_id").alias("id")).join(self.table("files").select("id"), "id", "left_anti")
        moved = changed.join(actions.where("action in ('unchanged', 'touched')").select(F.col("file_id").alias("id")), "id", "left_anti")
        self._swap(self._index_text(self.table("files"), moved.unionByName(gone)))

    def _extract(self, root, root_id: int, now: int, progress: Progress) -> int:
        todo = index.pending(self.table("files")).where(F.col("root_id") == root_id)
        total = todo.count()
        progress.write(phase="extracting", extraction_total=total)
        if not total:
            return 0
        out = source.extract_files(todo, root.path, self.extractor).persist()
        good = out.where("error is null")
        weigh = index.repo_confidence(todo.select("id", "root_id", "rel_path").join(good.select("id", "confidence"), "id"), source.directory_markers(self.spark, root.path, root_id)).select("id", "confidence")
        content = good.drop("confidence").join(weigh, "id")
        parts = good.select(F.col("id").alias("file_id"), F.posexplode(text.chunks("extracted_text")).alias("chunk_index", "c")).select("file_id", "chunk_index", F.col("c.text").alias("text"))
        top = self.table("chunks").agg(F.max("id")).first()[0] or 0
        embedded = source.embed(index.numbered(parts, top + 1, "file_id", "chunk_index").select("id", "file_id", "chunk_index", "text"), self.embedder).persist()
        chunks, vecs = index.replace_chunks(self.table("chunks"), self.table("chunks_vec"), embedded)
        self._swap({"files": index.update_content(self.table("files"), content, now), "chunks": chunks, "chunks_vec": vecs})
        self._swap(self._index_text(self.table("files"), content.select("id")))
        progress.write(phase="extracting", extraction_total=total, extraction_done=total)
        errors = out.where("error is not null").count()
        self.unembedded = embedded.where("embedding is null").count()
        for df in (out, embedded):
            df.unpersist()
        return errors

    def repair_embeddings(self) -> int:
        """Embeds again what has no vector since its call failed; how many chunks got one."""
        todo = index.without_vectors(self.table("chunks"), self.table("chunks_vec"))
        made = source.embed(todo, self.embedder).where("embedding is not null").select(F.col("id").alias("chunk_id"), "embedding").persist()
        n = made.count()
        if n:
            self._swap({"chunks_vec": self.table("chunks_vec").unionByName(made)})
        made.unpersist()
        return n

    def _tables(self) -> find.Tables:
        return find.Tables(self.table("roots"), self.table("files"), self.table("chunks"), self.table("chunks_vec"), self.table("postings"), self.table("sizes"))

    def search(self, query: find.SearchQuery, prefilter: bool = False) -> dict:
        """results, total, limit, offset, nextCursor."""
        vector = None if query.mode == "keyword" else self.embedder([query.query_text])[0]
        found = find.candidates(self._tables(), query, vector, prefilter).persist()
        rows = find.project(find.snippets(find.page(found, query), self.table("chunks"), query.query_text)).orderBy(F.desc("score"), "path").collect()
        total, limit = found.count(), min(200, max(1, query.limit))
        after = scalars.decode_cursor(query.cursor) if query.cursor else None
        offset = query.offset if not after else total - find.page(found, find.SearchQuery(cursor=query.cursor, limit=200)).count()
        found.unpersist()
        more = rows and offset + len(rows) < total
        return {"results": [r.asDict() for r in rows], "total": total, "limit": limit, "offset": query.offset, "nextCursor": scalars.encode_cursor(rows[-1].score, rows[-1].path) if more else None}

    def recent_files(self, limit: int = 4) -> DataFrame:
        return find.recent_files(self._tables(), limit)

    def completed_jobs(self, limit: int = 50) -> DataFrame:
        return index.completed_jobs(self.table("index_jobs"), limit)

    def parse_query_llm(self, words: str) -> scalars.ParsedQuery:
        if not self.llm:
            raise ValueError("no language model is set")
        return scalars.parse_reply(self.llm(words))

    def suggestions(self) -> list[str]:
        """TK12: names of the four latest files, for a search without results."""
        return [r.filename for r in self.recent_files(4).select("filename").collect()]

    def runtime_status(self) -> dict:
        """SC18: whether the model server answers, and the models it holds."""
        up = bool(self.runtime and self.runtime.reachable())
        return {"reachable": up, "modelsLoaded": self.runtime.loaded() if up else []}
