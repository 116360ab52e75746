"""Scans as a stream: each micro-batch of snapshot rows is reconciled against the index; progress for pollers."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import index


def reconcile_stream(snapshots: DataFrame, load_files: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """snapshots: a stream of scan rows, a whole scan per batch; apply(actions, batch_id) writes, and may be retried."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        apply(index.reconcile(load_files(), rows), batch_id)

    return snapshots.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class Snapshot:
    job_id: int
    root_id: int
    seq: int = 0
    phase: str = "discovering"
    counts: dict = field(default_factory=dict)
    current_file: str | None = None
    extraction_total: int = 0
    extraction_done: int = 0
    is_complete: bool = False


class Progress:
    """The latest snapshot: writes are dropped within `throttle` seconds but for phase changes; seq always grows."""

    def __init__(self, job_id: int, root_id: int, throttle: float = 0.15, clock: Callable[[], float] = time.monotonic):
        self._lock, self._clock, self._throttle, self._last = threading.Lock(), clock, throttle, -1e9
        self._now = Snapshot(job_id, root_id)
        self.cancelled = threading.Event()

    def write(self, **changes) -> bool:
        with self._lock:
            force = changes.get("phase", self._now.phase) != self._now.phase or changes.get("is_complete", False)
            if not force and self._clock() - self._last < self._throttle:
                return False
            self._now, self._last = replace(self._now, seq=self._now.seq + 1, **changes), self._clock()
            return True

    def read(self) -> Snapshot:
        with self._lock:
            return self._now
