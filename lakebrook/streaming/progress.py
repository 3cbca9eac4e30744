"""A heartbeat of running streams: one row of plain numbers for each batch, handed to whoever shows or keeps it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql.streaming import StreamingQueryListener


class Heartbeat(StreamingQueryListener):
    """spark.streams.addListener(Heartbeat(tell)): tell gets {event, run_id, ...}. What tell raises doesn't stop a stream."""

    def __init__(self, tell: Callable[[dict[str, Any]], None]):
        self.tell, self.failed = tell, 0

    def _say(self, **row: Any) -> None:
        try:
            self.tell(row)
        except Exception:
            self.failed += 1

    def onQueryStarted(self, event) -> None:
        self._say(event="STARTED", run_id=str(event.runId), name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._say(
            event="PROGRESS", run_id=str(p.runId), name=p.name, batch=p.batchId, rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond,
            took_ms=p.batchDuration, late_rows=sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
        )

    def onQueryIdle(self, event) -> None:
        self._say(event="IDLE", run_id=str(event.runId))

    def onQueryTerminated(self, event) -> None:
        self._say(event="FAILED" if event.exception else "ENDED", run_id=str(event.runId), error=event.exception)
