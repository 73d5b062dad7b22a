"""The status of each document as a state machine with state and timers, one sequence of numbers for all that happens to it."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.progress import COMPLETED, PENDING, PROCESSING

#: What a document meets: it is delivered, asked for once more, or its work ends (then the event is the status).
DELIVERED, RETRY = "delivered", "retry"
EVENT = "document_id string, event string, version timestamp, error_message string, attempt bigint, flagged boolean, payload string, at timestamp"
TRANSITION = "document_id string, status string, error_message string, seq bigint, attempt bigint, requires_reprocessing boolean, at timestamp, payload string"
#: Groups that documents are dealt to by their id. Each has one state, so a batch asks the state store once a group and not once a document; a stream's state lies by
#: them, so the number stays as it is. A task holds the events of one group at a time.
PLACES = 4096
#: Of each document of a group: due is when its attempt has taken too long, in milliseconds.
_STATE = "documents array<string>, statuses array<string>, seqs array<bigint>, attempts array<bigint>, dues array<bigint>"
_NEW = (None, -1, 0, 0)


class StatusMachine(StatefulProcessor):
    """Events of a group of documents in, transitions out; that to processing carries the payload to work on.

    A delivery or request starts an attempt: pending, then processing. Only the outcome of the last attempt counts. Of several deliveries at a
    time the latest version counts; one of a completed document changes nothing, a request always starts an attempt. An attempt without an
    outcome is pending again after `timeout` seconds of event time.
    """

    def __init__(self, timeout: float):
        self.timeout_ms = int(timeout * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("statuses", _STATE)

    def _known(self) -> dict[str | None, tuple]:
        """(status, seq, attempt, due) of each document of the group."""
        return {document: now for document, *now in zip(*(self.state.get() or ()))}

    def _keep(self, known: dict[str | None, tuple]) -> None:
        self.state.update((list(known), *map(list, zip(*known.values()))))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:
        self._keep(self._known() | {d["document_id"]: (d["status"], d["seq"], d["attempt"] or 0, 0) for d in initialState["documents"]})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        known, met = self._known(), {}
        for row in rows:
            asked, ended = met.setdefault(row["document_id"], ([], []))
            (asked if row["event"] in (DELIVERED, RETRY) else ended).append(row)
        dues = set()
        for document, (asked, ended) in met.items():
            before = known.get(document, _NEW)
            out, after = self._moved(document, before, asked, ended)
            if out:
                known[document] = after
                if after[2] != before[2]:
                    dues.add(after[3])
                yield from out
        for due in dues:
            self.handle.registerTimer(due)
        if known:
            self._keep(known)

    def _moved(self, document: str | None, before: tuple, asked: list[Row], ended: list[Row]) -> tuple[list[Row], tuple]:
        """The transitions of one document, and where it is after them."""
        status, seq, attempt, due = before
        out = []

        def to(new: str, row: Row, error: str | None = None, flag: bool | None = None, payload: str | None = None) -> None:
            nonlocal status, seq
            status, seq = new, seq + 1
            out.append(Row(document_id=document, status=new, error_message=error, seq=seq, attempt=attempt, requires_reprocessing=flag, at=row["at"], payload=payload))

        for row in sorted(ended, key=lambda r: r["attempt"]):
            if row["attempt"] == attempt and status in (PENDING, PROCESSING):
                to(row["event"], row, row["error_message"], bool(row["flagged"]))
        asked = [r for r in asked if r["event"] == RETRY or status != COMPLETED]
        if asked:
            row = max(asked, key=lambda r: (r["version"] is not None, r["version"], r["payload"]))
            attempt += 1
            to(PENDING, row)
            to(PROCESSING, row, payload=row["payload"])
            due = int(row["at"].timestamp() * 1000) + self.timeout_ms
        return out, (status, seq, attempt, due)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        known, at = self._known(), expiredTimerInfo.getExpiryTimeInMs()
        late = {d: (PENDING, seq + 1, attempt, due) for d, (status, seq, attempt, due) in known.items() if status == PROCESSING and at >= due}
        if late:
            self._keep(known | late)
        for document, (status, seq, attempt, _) in late.items():
            yield Row(document_id=document, status=status, error_message=None, seq=seq, attempt=attempt, requires_reprocessing=None, at=datetime.fromtimestamp(at / 1000), payload=None)

    def close(self) -> None:
        pass


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("place", F.pmod(F.xxhash64("document_id"), F.lit(PLACES)))


def transitions(events: DataFrame, known: DataFrame, timeout: float, skew: str) -> DataFrame:
    """TRANSITION rows of a stream of EVENT rows. known: the last states (document_id, status, seq, attempt) that a new stream starts from.

    skew: how far the clocks of those that give `at` may differ; an event that is older would be lost.
    """
    first = _placed(known).groupBy("place").agg(F.collect_list(F.struct("document_id", "status", "seq", "attempt")).alias("documents"))
    keyed = _placed(events).withWatermark("at", skew).groupBy("place")
    return keyed.transformWithState(StatusMachine(timeout), TRANSITION, "append", "eventTime", first.groupBy("place"))
