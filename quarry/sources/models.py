"""Connectors to a local model server: embeddings, image descriptions, query parsing, administration (SC16-SC18, QP9).

The server speaks JSON over HTTP. Nothing here runs unless a server is named; tests use a stub of this machine.
"""

from __future__ import annotations

import base64
import json
import threading
import urllib.error
import urllib.request
from dataclasses import dataclass, field

# Model names, the image prompt and time limits in seconds.
EMBED_MODEL, EMBED_DIM, EMBED_SECONDS = "nomic-embed-text-v2-moe", 768, 180
VISION_MODEL, VISION_FALLBACK, VISION_SECONDS = "moondream:1.8b", "qwen2.5vl:7b", 180
VISION_PROMPT = "Describe this image in detail, focusing on any text, objects, and context visible."
PARSE_MODEL, PARSE_SECONDS = "qwen2.5vl:7b", 30
HEALTH_SECONDS, ADMIN_SECONDS, PULL_SECONDS = 5, 120, 300
KNOWN_MODELS = ("nomic-embed-text-v2-moe", "qwen2.5vl:7b", "llava:7b")
MEDIA = "pdf, docx, xlsx, csv, txt, md, png, jpg, jpeg"


class ModelError(RuntimeError):
    """The server cannot be reached, is late or gives an answer that is no use."""


def parse_prompt(words: str) -> str:
    """QP9: asks for the fields that parse_reply reads."""
    return (
        "Read the search request below and answer with one JSON object and nothing else.\n"
        'Its fields: "queryText" (string: the words to search for, without words that only filter), '
        f'"mediaTypes" (array of strings out of: {MEDIA}), "rootScope" (array of lower-case folder names that follow the word in), '
        '"dateFrom" and "dateTo" (strings as YYYY-MM-DD, empty if not said), "minConfidence" (number from 0 to 1, 0 if not said).\n'
        f"Request: {words}"
    )


@dataclass
class ModelServer:
    """One server by its address; `cancelled` ends waiting calls. Instances are sent to tasks without their event."""

    url: str
    limits: dict = field(default_factory=dict)

    def __post_init__(self):
        self.cancelled = threading.Event()

    def __getstate__(self) -> dict:
        return {"url": self.url, "limits": self.limits}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.cancelled = threading.Event()

    def _call(self, path: str, body: dict | None, seconds: float) -> dict:
        """The answer, or ModelError within `seconds`, or at once when cancelled."""
        done: dict = {}

        def run() -> None:
            try:
                data = None if body is None else json.dumps(body).encode()
                request = urllib.request.Request(self.url.rstrip("/") + path, data, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=seconds) as answer:
                    done["value"] = json.load(answer)
            except urllib.error.HTTPError as problem:
                done["error"] = f"{problem.code}: {problem.read(500).decode(errors='replace')}"
            except (OSError, ValueError) as problem:
                done["error"] = str(problem)

        worker = threading.Thread(target=run, daemon=True)
        worker.start()
        waited, step = 0.0, 0.05
        while worker.is_alive() and waited < seconds:
            worker.join(step)
            waited += step
            if self.cancelled.is_set():
                raise InterruptedError("the call was cancelled")
        if "value" in done:
            return done["value"]
        raise ModelError(done.get("error", f"no answer within {seconds} s"))

    def _limit(self, name: str, usual: float) -> float:
        return self.limits.get(name, usual)

    def embed(self, texts: list[str], dim: int = EMBED_DIM) -> list[list[float]]:
        if not texts:
            return []
        answer = self._call("/api/embed", {"model": EMBED_MODEL, "input": texts, "keep_alive": "5m"}, self._limit("embed", EMBED_SECONDS))
        found = answer.get("embeddings")
        if not isinstance(found, list) or len(found) != len(texts):
            raise ModelError("the answer holds no vector for each text")
        if any(not isinstance(v, list) or len(v) != dim for v in found):
            raise ModelError(f"a vector has not {dim} dimensions")
        return [[float(x) if isinstance(x, int | float) else 0.0 for x in v] for v in found]

    def describe(self, image: bytes) -> str:
        """A description by the first model, or by the fallback where the server does not hold the first."""
        try:
            return self._describe(VISION_MODEL, image)
        except ModelError as problem:
            if "model" in str(problem) and "not found" in str(problem):
                return self._describe(VISION_FALLBACK, image)
            raise

    def _describe(self, model: str, image: bytes) -> str:
        body = {"model": model, "prompt": VISION_PROMPT, "images": [base64.b64encode(image).decode()], "stream": False, "keep_alive": "10m"}
        return self._text(self._call("/api/generate", body, self._limit("vision", VISION_SECONDS)))

    def parse(self, words: str) -> str:
        """The model's reply to a search request, for parse_reply."""
        body = {"model": PARSE_MODEL, "prompt": parse_prompt(words), "stream": False, "format": "json", "options": {"temperature": 0}}
        return self._text(self._call("/api/generate", body, self._limit("parse", PARSE_SECONDS)))

    @staticmethod
    def _text(answer: dict) -> str:
        if not isinstance(answer.get("response"), str):
            raise ModelError("the answer holds no response")
        return answer["response"]

    def reachable(self) -> bool:
        try:
            self._call("/api/tags", None, self._limit("health", HEALTH_SECONDS))
        except ModelError:
            return False
        return True

    def _names(self, path: str) -> list[str]:
        return [m["name"] for m in self._call(path, None, self._limit("admin", ADMIN_SECONDS)).get("models") or [] if isinstance(m.get("name"), str)]

    def loaded(self) -> list[str]:
        return self._names("/api/ps")

    def ensure(self, model: str) -> bool:
        """Pulls the model unless the server holds it; whether it had to."""
        if any(n.startswith(model) for n in self._names("/api/tags")):
            return False
        self._call("/api/pull", {"name": model, "stream": False}, self._limit("pull", PULL_SECONDS))
        return True

    def unload(self, model: str) -> None:
        self._call("/api/generate", {"model": model, "keep_alive": "0m", "prompt": ""}, self._limit("admin", ADMIN_SECONDS))

    def release(self) -> list[str]:
        """Unloads those running models that this engine uses; a server that does not answer has none."""
        out = []
        try:
            for name in self.loaded():
                if name.startswith(KNOWN_MODELS):
                    self.unload(name)
                    out.append(name)
        except ModelError:
            pass
        return out


@dataclass
class ServerEmbedder:
    """An Embedder over a server; each task's batches are its calls."""

    server: ModelServer
    dim: int = EMBED_DIM

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return self.server.embed(texts, self.dim)


def page_vision(server: ModelServer, render):
    """SC13: pages of a PDF as descriptions; render(raw, page) gives an image of one page. What fails is blank."""

    def run(raw: bytes, pages: list[int]) -> list[str]:
        out = []
        for page in pages:
            if server.cancelled.is_set():
                break
            try:
                out.append(server.describe(render(raw, page)))
            except ModelError:
                out.append("")
        return out

    return run
