"""Sessions of a stream: passages that a session has had are not sent again.

Two stateful operators in a row. A registry, keyed by project, knows when each session was last active: a session that
is silent for some hours is forgotten, and of more than `most` the one silent longest. It numbers the lives of a session
(epochs), so a session that comes back begins anew. It holds a row a session, `most` at most. The memory, keyed by
session, holds the passages of the present epoch, one state entry each; a timer clears it when the session has gone.

Rows are taken in order of arrival: by micro-batch, and within one by `ts`, then passage. A row that is late by its `ts`
is neither dropped nor does it make a session younger than it is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_HOUR = 3_600_000


class Registry(StatefulProcessor):
    """(project, session, chunk_id, ts) to the same rows with the epoch of their session."""

    def __init__(self, hours: float, most: int):
        self.span, self.most = int(hours * _HOUR), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alive = handle.getMapState("alive", "session string", "last long, epoch long")
        self.next = handle.getValueState("next", "epoch long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        alive = {k[0]: [v[0], v[1]] for k, v in self.alive.iterator()}  # `most` sessions at most
        before = {k: tuple(v) for k, v in alive.items()}
        epoch = self.next.get()[0] if self.next.exists() else 0
        given = pd.concat(list(rows)).sort_values(["ts", "chunk_id"], kind="stable")
        out = []
        for session, ms in zip(given["session"], given["ts"].map(lambda t: int(t.timestamp() * 1000)), strict=True):
            now = max([ms, *(v[0] for v in alive.values())])
            for gone in [s for s, v in alive.items() if v[0] + self.span <= now]:
                del alive[gone]
            if session not in alive:
                if len(alive) >= self.most:
                    del alive[min(alive, key=lambda s: (alive[s][0], s))]
                epoch += 1
                alive[session] = [ms, epoch]
            alive[session][0] = max(alive[session][0], ms)
            out.append(alive[session][1])
        for gone in before.keys() - alive.keys():
            self.alive.removeKey((gone,))
        for session, v in alive.items():
            if before.get(session) != tuple(v):
                self.alive.updateValue((session,), tuple(v))
        self.next.update((epoch,))
        yield pd.DataFrame({"project": given["project"], "session": given["session"], "chunk_id": given["chunk_id"], "ts": given["ts"], "epoch": out})

    def close(self) -> None:
        pass


class Memory(StatefulProcessor):
    """Rows of a session with their epochs to those that it has not had in its present life."""

    def __init__(self, hours: float):
        self.span = int(hours * _HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.had = handle.getMapState("had", "chunk_id string", "epoch long")
        self.now = handle.getValueState("now", "epoch long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        epoch = self.now.get()[0] if self.now.exists() else -1
        given = pd.concat(list(rows), ignore_index=True).sort_values(["epoch", "ts", "chunk_id"], kind="stable")  # one session's part of a micro-batch
        fresh = []
        for chunk, life in zip(given["chunk_id"], given["epoch"], strict=True):
            if life > epoch:
                epoch = life
                self.had.clear()
            new = not self.had.containsKey((chunk,))
            if new:
                self.had.updateValue((chunk,), (epoch,))
            fresh.append(new)
        yield given.loc[fresh, ["project", "session", "chunk_id"]]
        self.now.update((epoch,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.span)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.had.clear()
        yield pd.DataFrame({"project": [], "session": [], "chunk_id": []}, dtype=str)

    def close(self) -> None:
        pass


def not_yet_sent(sent: DataFrame, hours: float = 4, most: int = 500) -> DataFrame:
    """(project, session, chunk_id) of a stream (project, session, chunk_id, ts) without what sessions have had.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass) and append mode. Timers run by the clock,
    so a query that is to end by itself (available now) sets spark.sql.streaming.noDataMicroBatches.enabled to false."""
    known = sent.groupBy("project").transformWithStateInPandas(
        Registry(hours, most), "project string, session string, chunk_id string, ts timestamp, epoch long", "Append", "ProcessingTime")
    return known.groupBy("project", "session").transformWithStateInPandas(
        Memory(hours), "project string, session string, chunk_id string", "Append", "ProcessingTime")
