"""Search as one types (QP10): a pause before each search, stale answers dropped, the parse kept for index changes."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from quarry.functions.scalars import ParsedQuery

LEAST, PAUSE = 2, 0.3  # fixed values: characters of a query, seconds without a further key


@dataclass(frozen=True)
class View:
    """What a searcher sees."""

    results: tuple = ()
    total: int = 0
    offset: int = 0
    loading: bool = False
    error: str | None = None
    parsed: ParsedQuery | None = None


@dataclass
class SearchSession:
    """parse(query, mode) and search(parsed, offset) may be slow; search returns a dict with results and total.

    `later(seconds, f)` calls f after a pause and returns a function that calls it off.
    """

    parse: Callable[[str, str], ParsedQuery]
    search: Callable[[ParsedQuery, int], dict]
    later: Callable[[float, Callable[[], None]], Callable[[], None]] | None = None
    view: View = field(default_factory=View)

    def __post_init__(self):
        self._lock = threading.RLock()
        self._turn, self._query, self._mode = 0, "", "hybrid"
        self._kept: tuple[tuple[str, str], ParsedQuery] | None = None
        self._call_off: Callable[[], None] = lambda: None
        self.later = self.later or _timer

    def type(self, query: str, mode: str = "hybrid") -> None:
        """A new query: it is searched after the pause, unless another one comes before."""
        with self._lock:
            self._call_off()
            self._query, self._mode = query, mode
            if len(query) < LEAST:
                self._turn += 1
                self.view, self._kept, self._call_off = View(), None, lambda: None
                return
            self._call_off = self.later(PAUSE, lambda: self._fresh(query, mode, 0, False))

    def more(self) -> None:
        """The next page behind what is shown."""
        with self._lock:
            query, mode, offset = self._query, self._mode, len(self.view.results)
        if len(query) >= LEAST:
            self._again(query, mode, offset, True)

    def index_changed(self) -> None:
        """The current query once more; its parse is kept."""
        with self._lock:
            query, mode = self._query, self._mode
        if len(query) >= LEAST:
            self._again(query, mode, 0, False)

    def _again(self, query: str, mode: str, offset: int, append: bool) -> None:
        with self._lock:
            kept = self._kept
        if kept and kept[0] == (mode, query):
            self._run(kept[1], offset, append, self._begin())
        else:
            self._fresh(query, mode, offset, append)

    def _begin(self) -> int:
        with self._lock:
            self._turn += 1
            self.view = View(self.view.results, self.view.total, self.view.offset, True, None, self.view.parsed)
            return self._turn

    def _fresh(self, query: str, mode: str, offset: int, append: bool) -> None:
        turn = self._begin()
        parsed = self.parse(query, mode)
        with self._lock:
            if turn != self._turn:
                return
            self._kept = (mode, query), parsed
        self._run(parsed, offset, append, turn)

    def _run(self, parsed: ParsedQuery, offset: int, append: bool, turn: int) -> None:
        found, problem = None, None
        try:
            found = self.search(parsed, offset)
        except Exception as e:  # noqa: BLE001  shown to the searcher
            problem = str(e) or "An unexpected error occurred"
        with self._lock:
            if turn != self._turn:  # a later query is under way
                return
            if found is None:
                self.view = View(self.view.results, self.view.total, self.view.offset, False, problem, parsed)
            else:
                rows = (*self.view.results, *found["results"]) if append else tuple(found["results"])
                self.view = View(rows, found["total"], offset, False, None, parsed)


def _timer(seconds: float, f: Callable[[], None]) -> Callable[[], None]:
    t = threading.Timer(seconds, f)
    t.daemon = True
    t.start()
    return t.cancel
