"""The model connectors against a stub server, the search session, and evaluation files."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quarry.functions.scalars import parse_query, parse_reply
from quarry.plans import evaluation
from quarry.plans.session import PAUSE, SearchSession, View
from quarry.sources import files as source
from quarry.sources.models import ModelError, ModelServer, ServerEmbedder, page_vision


class Stub(BaseHTTPRequestHandler):
    answers: dict = {}
    calls: list = []

    def _go(self, body):
        self.calls.append((self.path, body))
        code, answer, wait = self.answers[self.path](body) if callable(self.answers.get(self.path)) else (200, self.answers.get(self.path, {}), 0)
        time.sleep(wait)
        try:
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())
        except OSError:
            pass

    def do_GET(self):
        self._go(None)

    def do_POST(self):
        self._go(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    Stub.answers, Stub.calls = {}, []
    http = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield ModelServer(f"http://127.0.0.1:{http.server_port}", {"embed": 1, "vision": 1, "parse": 1, "health": 1, "admin": 1, "pull": 1})
    http.shutdown()


def test_embeddings(server, spark):
    Stub.answers["/api/embed"] = lambda b: (200, {"embeddings": [[len(t), 1, None] for t in b["input"]]}, 0)
    assert server.embed(["a", "bb"], 3) == [[1.0, 1.0, 0.0], [2.0, 1.0, 0.0]] and server.embed([]) == []
    with pytest.raises(ModelError, match="768"):
        server.embed(["a"])
    df = spark.createDataFrame([(1, 1, 0, "abc")], "id long, file_id long, chunk_index int, text string")
    assert source.embed(df, ServerEmbedder(server, 3)).first().embedding == [3.0, 1.0, 0.0]
    assert source.embed(df, ServerEmbedder(server, 4)).first().embedding is None
    Stub.answers["/api/embed"] = {"embeddings": []}
    with pytest.raises(ModelError):
        server.embed(["a"], 3)


def test_time_limit_and_cancel(server):
    Stub.answers["/api/embed"] = lambda b: (200, {}, 3)
    began = time.monotonic()
    with pytest.raises(ModelError):
        server.embed(["a"])
    assert time.monotonic() - began < 2.5
    threading.Timer(0.2, server.cancelled.set).start()
    with pytest.raises(InterruptedError):
        server.embed(["a"])


def test_vision_falls_back(server):
    Stub.answers["/api/generate"] = lambda b: (404, {"error": "model 'x' not found"}, 0) if b["model"].startswith("moondream") else (200, {"response": f"{len(b['images'])} image"}, 0)
    assert server.describe(b"png") == "1 image" and [b["model"] for _, b in Stub.calls] == ["moondream:1.8b", "qwen2.5vl:7b"]
    Stub.answers["/api/generate"] = lambda b: (500, {"error": "broken"}, 0)
    with pytest.raises(ModelError, match="500"):
        server.describe(b"png")
    Stub.answers["/api/generate"] = lambda b: (200, {"other": 1}, 0)
    with pytest.raises(ModelError, match="response"):
        server.describe(b"png")


def test_pages_are_described(server):
    Stub.answers["/api/generate"] = lambda b: (500, {}, 0) if b["images"] == ["cDE="] else (200, {"response": "page " + b["images"][0]}, 0)
    run = page_vision(server, lambda raw, page: f"p{page}".encode())
    assert run(b"", [0, 1]) == ["page cDA=", ""]
    assert source.Extractor(pdf_pages=lambda raw: [("", "", 0.0), ("", "", 0.0)], pdf_vision=run)("pdf", b"").text == "page cDA="


def test_query_parsing(server):
    Stub.answers["/api/generate"] = lambda b: (200, {"response": '{"queryText": "notes", "mediaTypes": ["pdf"]}'}, 0)
    got = parse_reply(server.parse("find my notes"))
    assert (got.query_text, got.media_types) == ("notes", ("pdf",))
    body = Stub.calls[0][1]
    assert body["options"] == {"temperature": 0} and body["format"] == "json" and "find my notes" in body["prompt"]
    Stub.answers["/api/generate"] = lambda b: (200, {}, 3)
    long = "please find all the quarterly finance reports"
    assert parse_query(long, llm=server.parse).query_text == long


def test_administration(server):
    Stub.answers |= {"/api/tags": {"models": [{"name": "a:1"}]}, "/api/ps": {"models": [{"name": "llava:7b"}, {"name": "foreign"}, {}]}}
    assert server.reachable() and server.loaded() == ["llava:7b", "foreign"]
    assert not server.ensure("a") and server.ensure("b") and Stub.calls[-1] == ("/api/pull", {"name": "b", "stream": False})
    assert server.release() == ["llava:7b"] and Stub.calls[-1][1]["keep_alive"] == "0m"
    off = ModelServer("http://127.0.0.1:9", {"health": 1, "admin": 1})
    assert not off.reachable() and off.release() == []


class Clock:
    """Pauses that pass when told."""

    def __init__(self):
        self.waiting = []

    def __call__(self, seconds, f):
        assert seconds == PAUSE
        self.waiting.append(f)
        return lambda: self.waiting.remove(f) if f in self.waiting else None

    def tick(self):
        now, self.waiting = self.waiting, []
        for f in now:
            f()


def test_session_pauses_keeps_the_parse_and_drops_stale_answers():
    clock, parsed, searched = Clock(), [], []

    def parse(q, mode):
        parsed.append(q)
        return parse_query(q, mode)

    hook = []

    def search(p, offset):
        searched.append((p.query_text, offset))
        for f in hook:
            f()
        return {"results": [f"{p.query_text}{offset}", "x"], "total": 5}

    s = SearchSession(parse, search, clock)
    s.type("a")
    assert not clock.waiting and s.view == View()
    s.type("re")
    s.type("report")
    clock.tick()
    assert parsed == ["report"] and s.view.results == ("report0", "x") and s.view.total == 5 and not s.view.loading
    s.more()
    assert searched[-1] == ("report", 2) and s.view.results == ("report0", "x", "report2", "x")
    s.index_changed()
    assert parsed == ["report"] and s.view.results == ("report0", "x")
    s.type("report", "keyword")
    s.index_changed()
    assert parsed == ["report", "report"]
    hook.append(lambda: (hook.clear(), s.type("z")))  # a shorter query comes while the search runs
    s.type("stale one")
    clock.tick()
    assert s.view == View()
    s.search = lambda p, offset: 1 / 0
    s.type("broken")
    clock.tick()
    assert "division" in s.view.error and not s.view.loading


def test_evaluation_files(spark, tmp_path):
    folder = str(tmp_path / "results")
    queries = spark.createDataFrame([("q1", ["a"], "A"), ("q2", ["b"], "B"), ("q3", [], "B")], "query string, relevant array<string>, group string")
    first = evaluation.run_queries(queries, lambda q: ["x", "a"])
    assert evaluation.latest_result(folder) is None and evaluation.difference(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        evaluation.promote(folder)
    evaluation.write_result(folder, first, "abc", "2026-01-01")
    line = evaluation.promote(folder, "first")
    assert line.startswith("2026-01-01 abc: Recall@10=0.500 MRR=0.250 NDCG=0.315 (n=2). first")
    evaluation.promote(folder)
    with open(os.path.join(folder, "HISTORY.md")) as f:
        assert f.read().count("Eval History") == 1
    evaluation.write_result(folder, evaluation.run_queries(queries, lambda q: ["a", "b"]), "def", "2026-01-02")
    rows = {r.metric: (r.baseline, r.current, r.delta) for r in evaluation.difference(spark, folder).collect()}
    assert rows["Recall@10"] == ("0.500", "1.000", "+0.500") and rows["MRR"] == ("0.250", "0.750", "+0.500")
    assert {r.metric: r.delta for r in evaluation.difference(spark, folder, "A").collect()}["MRR"] == "+0.500"
    with open(os.path.join(folder, "2026-01-02-def.json")) as f:
        made = json.load(f)
    assert made["aggregate"]["numQueries"] == 2 and made["byGroup"]["C"] == {"recallAt10": 0.0, "mrr": 0.0, "ndcgAt10": 0.0, "numQueries": 0}


def test_page_times(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 8, None), (1, 90, "late"), (2, 3, "late")], "file_id long, ms long, error string")
    got = {r.file_id: tuple(r)[1:] for r in evaluation.page_times(df, "file_id").collect()}
    assert got == {1: (2, 1, 5, 6, 8), 2: (0, 1, 0, 0, 0)}
