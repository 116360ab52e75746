import os
import shutil

import pytest
from pyspark.sql import functions as F

from quarry.operators import index
from quarry.operators.search import SearchQuery
from quarry.plans.engine import Engine
from quarry.streaming.incremental import Progress, reconcile_stream


def put(root, path, body):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(body)


@pytest.fixture
def home(spark, tmp_path):
    root = str(tmp_path / "docs")
    for path, body in {"a.txt": "quarterly finance report", "sub/b.md": "# Recipe\nsoup & bread", "sub/c.txt": "finance plan", ".hidden/d.txt": "x", "node_modules/e.txt": "x", "f.exe": "x", ".g.txt": "x", "repo/package.json": "{}", "repo/src/h.txt": "code notes"}.items():
        put(root, path, body)
    return root, Engine(spark, str(tmp_path / "state"))


def test_index_search_and_rescan(home):
    root, engine = home
    i = engine.add_root(root)
    assert engine.add_root(root) == i
    counts = engine.index_root(i)
    assert (counts["files_total"], counts["files_added"], counts["error_count"]) == (4, 4, 0)
    live = {r.rel_path: r for r in engine.table("files").collect()}
    assert live["repo/src/h.txt"].confidence == 0.5 and live["a.txt"].confidence == 1.0
    assert engine.progress().is_complete and engine.progress().seq > 1

    found = engine.search(SearchQuery("finance", mode="keyword"))
    assert found["total"] == 2 and {r["filename"] for r in found["results"]} == {"a.txt", "c.txt"}
    assert all("<mark>finance</mark>" in r["snippet"] for r in found["results"])
    first = engine.search(SearchQuery("finance", mode="keyword", limit=1))
    second = engine.search(SearchQuery("finance", mode="keyword", limit=1, cursor=first["nextCursor"]))
    assert {r["filename"] for r in first["results"] + second["results"]} == {"a.txt", "c.txt"} and second["nextCursor"] is None
    assert engine.search(SearchQuery("quarterly report", mode="keyword"))["total"] == 0
    assert engine.search(SearchQuery("soup", media_types=("MD",), mode="keyword"))["total"] == 1
    assert engine.search(SearchQuery("finance plan"))["results"][0]["filename"] == "c.txt"
    assert engine.search(SearchQuery("finance", root_scope=("DOCS",), mode="keyword"))["total"] == 2
    assert engine.search(SearchQuery("finance", root_scope=("other",), mode="keyword"))["total"] == 0

    os.rename(os.path.join(root, "a.txt"), os.path.join(root, "moved.txt"))
    put(root, "sub/c.txt", "finance plan, longer")
    os.remove(os.path.join(root, "sub/b.md"))
    counts = engine.index_root(i)
    assert (counts["files_moved"], counts["files_updated"], counts["files_deleted"], counts["files_added"]) == (1, 1, 1, 0)
    assert engine.search(SearchQuery("soup", mode="keyword"))["total"] == 0
    assert {r["filename"] for r in engine.search(SearchQuery("finance", mode="keyword"))["results"]} == {"moved.txt", "c.txt"}
    assert engine.index_root(i)["files_done"] == 3
    assert engine.completed_jobs().count() == 3
    assert engine.recent_files(1).count() == 1
    engine.remove_root(i)
    assert engine.table("files").count() == 0 and engine.list_roots().count() == 0 and engine.table("chunks_vec").count() == 0


def test_cancelled_job_is_recorded(home, monkeypatch):
    root, engine = home
    i = engine.add_root(root)
    monkeypatch.setattr(engine, "_apply", lambda *a: engine.cancel())
    with pytest.raises(InterruptedError):
        engine.index_root(i)
    assert [r.status for r in engine.table("index_jobs").collect()] == ["cancelled"]


def test_reconcile_keeps_copies_apart(spark):
    files = spark.createDataFrame([(1, 1, "a", 5, 1, "x", None), (2, 1, "b", 5, 1, "x", None), (3, 2, "a", 5, 1, "x", None), (4, 1, "old", 5, 1, "y", 9)], "id long, root_id long, rel_path string, size_bytes long, mtime_ns long, fingerprint string, deleted_at long")
    scan = spark.createDataFrame([(1, "a", 5, 2, "x"), (1, "c", 5, 1, "x"), (1, "d", 5, 1, "x"), (2, "a", 6, 2, "z")], "root_id long, rel_path string, size_bytes long, mtime_ns long, fingerprint string")
    got = {(r.root_id, r.rel_path): (r.action, r.file_id) for r in index.reconcile(files, scan).collect()}
    assert got == {(1, "a"): ("touched", 1), (1, "c"): ("moved", 2), (1, "d"): ("added", None), (2, "a"): ("updated", 3)}


def test_move_onto_a_retired_place(spark):
    cols = index.FILE_FIELDS
    row = lambda i, path, gone: (i, 1, path, path, "txt", 1, 1, "f", "ext-v1", 1.0, "t", "en", 0, 0, gone)
    files = spark.createDataFrame([row(1, "a", None), row(2, "b", 5)], cols)
    out = index.move_files(files, spark.createDataFrame([(1, "b", 7)], "id long, rel_path string, mtime_ns long"), 3, 4).collect()
    assert [(r.id, r.rel_path, r.mtime_ns, r.index_marker) for r in out] == [(1, "b", 7, 3)]


def test_stream_reconciles_each_batch(spark, tmp_path):
    schema = "root_id long, rel_path string, size_bytes long, mtime_ns long, fingerprint string"
    spark.createDataFrame([(1, "a", 1, 1, "x")], schema).write.parquet(str(tmp_path / "in"))
    files = spark.createDataFrame([(1, 1, "b", 1, 1, "x", None)], "id long, root_id long, rel_path string, size_bytes long, mtime_ns long, fingerprint string, deleted_at long")
    seen = []
    q = reconcile_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda: files, lambda actions, n: seen.extend(r.action for r in actions.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == ["moved"]


def test_progress_throttles_but_not_phases():
    now = [0.0]
    p = Progress(1, 1, clock=lambda: now[0])
    assert p.write(counts={"a": 1}) and not p.write(counts={"a": 2}) and p.write(phase="extracting")
    now[0] = 1.0
    assert p.write(counts={"a": 3}) and p.write(is_complete=True) and p.read().seq == 4


def test_catalog_matches_sql(spark):
    import duckdb

    from quarry.plans import catalog

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")
    for name in ("keyword_search", "mode_hybrid", "chunk_text", "reconcile_actions", "upsert_files", "eval_by_group", "completed_jobs"):
        got = catalog.queries()[name](spark, d)
        cols = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, want)), name


def test_relative_time_takes_every_branch(spark, tmp_path):
    from quarry.plans import catalog

    spark.createDataFrame([(1,), (3,), (22,), (23,), (111,), (112,), (608,), (609,), (3779,)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.age for r in catalog.queries()["relative_time"](spark, str(tmp_path)).collect()}
    assert got == {1: "just now", 3: "1m ago", 22: "56m ago", 23: "1h ago", 111: "23h ago", 112: "1d ago", 608: "29d ago", 609: "Dec 16, 2026", 3779: "Nov 15, 2023"}


def test_format_bytes_matches_sql_at_odd_sizes(spark, tmp_path):
    """Halves of a tenth, sizes about each unit and beyond the largest, beyond doubles, none, negative and null."""
    import duckdb

    from quarry.plans import catalog

    top = (2**63 - 1) // 7
    sizes = {u * k // 1024 + e for u in (1024, 1024**2, 1024**3, 1024**4, 2**53) for k in range(64, 4200, 64) for e in (-1, 0, 1)}
    sizes |= {64 * k for k in range(600)} | {0, 1, -1, -5000, -top, top, top - 1, top - 2**20} | {top // 3 + 131_071 * k for k in range(200)}
    rows = list(enumerate([*sorted(sizes), None]))
    spark.createDataFrame(rows, "doc_id long, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(f"SELECT doc_id, size FROM ({catalog.oracle_sql()['format_bytes']})").fetchall())
    got = {r.doc_id: r["size"] for r in catalog.queries()["format_bytes"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and {(dict(rows)[i], x, want[i]) for i, x in got.items() if x != want[i]} == set()


def test_basename_dirname_labels_all_types(spark, sf):
    from quarry.plans import catalog, model

    names = ("PDF", "Word", "Excel", "CSV", "Text", "Markdown", "PNG", "JPEG")
    want = {(r.doc_id, f"{r.doc_id}.{model.TYPES[r.doc_id % 8]}", r.lang, names[r.doc_id % 8]) for r in model.read(spark, sf, "documents").collect()}
    got = [tuple(r) for r in catalog.queries()["basename_dirname"](spark, sf).select("id", "base", "dir", "label").collect()]
    assert set(got) == want and len(got) == len(want) > 0


@pytest.fixture(autouse=True)
def _tidy(tmp_path):
    yield
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_markers_cover_hidden_directories(spark):
    files = spark.createDataFrame([(1, "p/x/a.txt", 1.0), (1, "q/b.txt", 1.0)], "root_id long, rel_path string, confidence float")
    entries = spark.createDataFrame([(1, "p/.git"), (1, "q/readme.md")], "root_id long, rel_path string")
    got = {r.rel_path: r.confidence for r in index.repo_confidence(files, entries).select("rel_path", F.col("confidence")).collect()}
    assert got == {"p/x/a.txt": 0.5, "q/b.txt": 1.0}


def test_scan_prunes_junk_and_nothing_else(spark, tmp_path):
    from quarry.sources import files as source

    root = str(tmp_path / "r")
    kept = ["bin/a.txt", "obj/a.txt", "tmp/a.txt", "temp/a.txt", "cache/a.txt", "logs/a.txt", "Pods/a.txt", "DerivedData/a.txt", "bower_components/a.txt", "jspm_packages/a.txt", "egg-info/a.txt", "_under/a.txt", "deep/er/and/er/a.txt", "top.md", "x.JPEG", "build.txt"]
    gone = ["node_modules/a.txt", "dist/a.txt", "build/a.txt", "out/a.txt", "target/a.txt", "coverage/a.txt", "vendor/a.txt", "__pycache__/a.txt", "venv/a.txt", "env/a.txt", "site-packages/a.txt", "sub/node_modules/a.txt", ".hidden/a.txt", ".git/a.txt", "sub/.dot.txt", "a.exe"]
    for p in kept + gone:
        put(root, p, "x")
    put(root, "deep/go.mod", "")
    put(root, "bin/.git/x", "")
    assert sorted(r.rel_path for r in source.scan_directory(spark, root, 1).collect()) == sorted(kept)
    assert sorted(r.rel_path for r in source.directory_markers(spark, root, 1).collect()) == [".git", "bin/.git", "deep/go.mod"]


def test_postings_answer_phrases_as_scans_do(spark, tmp_path):
    from quarry.operators import postings
    from quarry.operators import search as find

    rows = [(1, "a.txt", "en/a.txt", "to be or not to be"), (2, "to.txt", "en/be.txt", "Not TO, be"), (3, "b.md", "x/b.md", None), (4, "na na na.txt", "na/na", "na na na na"), (5, "c.txt", "c.txt", "")]
    files = spark.createDataFrame(rows, "id long, filename string, rel_path string, extracted_text string")
    p, s = postings.store(files)
    for phrase in (["to"], ["to", "be"], ["na", "na"], ["na", "na", "na"], ["be", "or", "not"], ["txt", "en"], ["missing"], []):
        want = {(r.file_id, r.tf, r.size) for r in find.phrase_features(files, phrase).where("tf > 0").collect()}
        assert {tuple(r) for r in postings.phrase_hits(p, phrase).select("file_id", "tf", "size").collect()} == want, phrase
    assert {tuple(r) for r in s.collect()} == {(r.file_id, r.size) for r in find.phrase_features(files, ["x"]).collect()}
    new = spark.createDataFrame([(2, "to.txt", "en/be.txt", "changed"), (6, "n.txt", "n.txt", "to be")], files.schema)
    now = files.where("id not in (2, 4)").unionByName(new)
    p2, s2 = postings.upkeep(p, s, now, spark.createDataFrame([(2,), (4,), (6,)], "id long"))
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(p2) == key(postings.make_postings(now)) and key(s2) == key(postings.make_sizes(now))


def test_engine_keeps_postings_and_repairs_vectors(spark, tmp_path):
    from quarry.sources import files as source

    class Flaky(source.HashingEmbedder):
        def __call__(self, texts):
            if os.path.exists(str(tmp_path / "down")):
                raise OSError("down")
            return super().__call__(texts)

    root = str(tmp_path / "docs")
    put(root, "a.txt", "one two three")
    put(root, "b.txt", "two three four")
    put(root, "c.txt", "two three four")
    put(str(tmp_path), "down", "")
    engine = Engine(spark, str(tmp_path / "state"), embedder=Flaky(16))
    i = engine.add_root(root)
    engine.index_root(i)
    assert engine.unembedded == 3 and engine.table("chunks_vec").count() == 0
    os.remove(str(tmp_path / "down"))
    assert engine.repair_embeddings() == 3 and engine.repair_embeddings() == 0 and engine.table("chunks_vec").count() == 3

    def consistent():
        from quarry.operators import postings

        key = lambda df: sorted(map(repr, df.collect()))
        return key(engine.table("postings")) == key(postings.make_postings(engine.table("files"))) and key(engine.table("sizes")) == key(postings.make_sizes(engine.table("files")))

    assert consistent()
    put(root, "a.txt", "one changed")
    os.rename(os.path.join(root, "b.txt"), os.path.join(root, "moved.txt"))
    os.remove(os.path.join(root, "c.txt"))
    put(root, "d.txt", "new")
    engine.index_root(i)
    assert consistent()
    assert engine.search(SearchQuery("moved", mode="keyword"))["total"] == 1 and engine.search(SearchQuery("three", mode="keyword"))["total"] == 1
    assert set(engine.suggestions()) <= {"a.txt", "moved.txt", "d.txt"}
    assert engine.runtime_status() == {"reachable": False, "modelsLoaded": []}
    folders = [len(os.listdir(str(tmp_path / "state" / name))) for name in ("files", "postings", "chunks")]
    assert max(folders) <= 3
    engine.remove_root(i)
    assert engine.table("postings").count() == 0 and engine.table("sizes").count() == 0 and engine.table("activity_log").count() == 0


def test_duplicates_collapse_on_request(spark, tmp_path):
    root = str(tmp_path / "docs")
    for name in ("a.txt", "b.txt", "z/c.txt"):
        put(root, name, "same words")
    put(root, "d.txt", "other")
    engine = Engine(spark, str(tmp_path / "state"), collapse_duplicates=True)
    i = engine.add_root(root)
    assert engine.index_root(i)["files_added"] == 2
    assert sorted(r.rel_path for r in engine.table("files").collect()) == ["d.txt", "z/c.txt"]
    assert engine.index_root(i)["files_done"] == 2


@pytest.mark.parametrize("version", [1, 2, 3])
def test_older_states_are_migrated(spark, tmp_path, version):
    import json

    from quarry.plans import engine as module

    home = str(tmp_path / "state")
    os.makedirs(home)
    tables = {}
    for name, schema in module.SCHEMAS.items():
        if name in ("postings", "sizes") or (name == "chunks_vec" and version < 3):
            continue
        rows = [(1, 1, "a.txt", "a.txt", "txt", 3, 1, "f", "ext-v1", 1.0, "old words", "eng", 0, 0, None)] if name == "files" else []
        if name == "chunks":
            schema = "id long, file_id long, chunk_index int, text string" + (", embedding array<float>" if version == 2 else "")
            rows = [(7, 1, 0, "old words", [0.5, 0.5])] if version == 2 else [(7, 1, 0, "old words")]
        tables[name] = os.path.join(home, name, "old")
        spark.createDataFrame(rows, schema).write.parquet(tables[name])
    with open(os.path.join(home, "current.json"), "w") as f:
        json.dump({"version": version, "tables": tables}, f)
    e = Engine(spark, home)
    assert e.table("chunks").columns == ["id", "file_id", "chunk_index", "text"] and e.table("chunks").count() == 1
    assert [(r.chunk_id, r.embedding) for r in e.table("chunks_vec").collect()] == ([(7, [0.5, 0.5])] if version == 2 else [])
    assert {r.term for r in e.table("postings").collect()} == {"a", "txt", "old", "words"} and e._state()["version"] == module.VERSION
