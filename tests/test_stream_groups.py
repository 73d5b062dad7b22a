"""The state machine keeps one state for a group of documents: calls of the state store do not grow with the documents."""

from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexspark.operators import progress
from lexspark.streaming import ingest, status


class Handle:
    """A state of one group and its timers; calls are counted."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_a_group_of_documents_asks_the_state_store_once():
    handle, machine = Handle(), status.StatusMachine(10.0)
    machine.init(handle)
    at = datetime(2024, 1, 1)
    event = lambda i, event, attempt=None: Row(document_id=f"d{i}", event=event, version=at, error_message=None, attempt=attempt, flagged=False, payload="p", at=at)
    out = list(machine.handleInputRows((0,), iter([event(i, status.DELIVERED) for i in range(500)]), None))
    assert len(out) == 1000 and handle.calls == 3 and len(handle.timers) == 1
    out = list(machine.handleInputRows((0,), iter([event(i, progress.COMPLETED, 1) for i in range(499)] + [event(7, status.DELIVERED)]), None))
    assert len(out) == 499 and {(r["status"], r["seq"]) for r in out} == {("completed", 2)} and handle.calls == 5
    late = list(machine.handleExpiredTimer((0,), None, type("Info", (), {"getExpiryTimeInMs": lambda _: handle.timers[0]})()))
    assert [(r["document_id"], r["status"], r["seq"]) for r in late] == [("d499", "pending", 2)]
    assert list(machine.handleExpiredTimer((0,), None, type("Info", (), {"getExpiryTimeInMs": lambda _: handle.timers[0]})())) == []


@pytest.mark.parametrize("places", [1, 3])
def test_documents_of_one_group_keep_states_of_their_own(spark, tmp_path, monkeypatch, places):
    monkeypatch.setattr(status, "PLACES", places)
    source, log = str(tmp_path / "in"), f"g{places}_log"
    deliver = lambda rows: spark.createDataFrame(rows, ingest.DOCUMENTS).coalesce(1).write.mode("append").parquet(source)
    stream = ingest.Ingestion(spark, source, str(tmp_path / "cp"), f"g{places}_points", log, work=ingest.Work(dim=8))
    deliver([(f"d{i}", "" if i % 3 == 0 else f"text of {i}") for i in range(12)] + [(None, "no name")])
    stream.run()
    deliver([(f"d{i}", f"later text of {i}") for i in range(0, 14, 2)])
    stream.run()
    last = {r["document_id"]: (r["status"], r["seq"]) for r in progress.current(stream.states()).collect() if r["document_id"]}
    assert last == {f"d{i}": ("failed", 2) if i in (3, 9) else ("completed", 5) if i in (0, 6) else ("completed", 2) for i in range(13)}
    assert stream.states().where("document_id IS NULL").count() == 3
    other = ingest.Ingestion(spark, source, str(tmp_path / "other"), f"g{places}_points", log, work=ingest.Work(dim=8))
    other.run()  # known states go in by groups: what is completed stays so
    new = other.states().where(F.col("stream") == other.stream)
    assert {r["document_id"] for r in new.where("document_id IS NOT NULL").collect()} == {"d3", "d9"} and new.where("document_id = 'd3'").agg(F.min("seq")).first()[0] == 3
