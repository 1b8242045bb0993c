"""State machines over streams: the rows of their batch twins, whatever the order in which events arrive within the delay.

A key's rows are held in state until the watermark has passed them, then taken in order of (time, id); so late rows fall into place, and what a restart reads again was not told before.
Machines are plain: a state that is JSON, a step for a row, and a time at which the state wants to be looked at without one; state that no row can need any more is dropped then. Needs
the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import SEVERITIES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine:
    """Columns that it reads and makes, the first state, and what changes it."""

    reads: list[str] = []
    out = ""

    def first(self):
        return None

    def step(self, state, ts: int, event_id: int, row: dict) -> tuple[object, list[tuple]]:
        raise NotImplementedError

    def due(self, state) -> int | None:
        """The time after which wake() is called, if no row came before."""
        return None

    def wake(self, state, at: int) -> tuple[object, list[tuple]]:
        """The state at that time (None: forget it), and rows to tell."""
        return None, []


class SlidingCount(Machine):
    """event_id, n: rows in [ts - width, ts] that have arrived."""

    out = "event_id long, n long"

    def __init__(self, width: int):
        self.width = width

    def first(self):
        return []

    def step(self, state, ts, event_id, row):
        state = [t for t in state if t >= ts - self.width] + [ts]
        return state, [(event_id, len(state))]

    def due(self, state):
        return state[-1] + self.width if state else None


class SlidingDistinct(Machine):
    """event_id, n: distinct values of the window; a repeat does not extend its value's stay."""

    out = "event_id long, n long"

    def __init__(self, value: str, width: int):
        self.value, self.width, self.reads = value, width, [value]

    def first(self):
        return {"since": [], "opened": []}  # (value, start of its stay); starts in the window

    def step(self, state, ts, event_id, row):
        since = [(v, t) for v, t in state["since"] if ts - t <= self.width]
        opened = [t for t in state["opened"] if t >= ts - self.width]
        value = row.get(self.value)
        if all(v != value for v, _ in since):
            since, opened = [*since, (value, ts)], [*opened, ts]
        return {"since": since, "opened": opened}, [(event_id, len(opened))]

    def due(self, state):
        return max((t for _, t in state["since"]), default=0) + self.width


class Anchored(Machine):
    """event_id, ts_us: rows that open a window; what follows within width of one is dropped."""

    out = "event_id long, ts_us long"

    def __init__(self, width: int):
        self.width = width

    def step(self, state, ts, event_id, row):
        if state is not None and ts - state <= self.width:
            return state, []
        return ts, [(event_id, ts)]

    def due(self, state):
        return None if state is None else state + self.width


class Fusion(Machine):
    """The verdicts of cases.fuse(): event_id, max_rank, max_score, techniques, sources, evidence.

    forget: an entity that raised nothing for so long starts anew, so that state is bounded by the entities of that time (None: never).
    """

    out = "event_id long, max_rank int, max_score double, techniques array<string>, sources array<string>, evidence array<long>"

    def __init__(self, width: int, generation: str = "parent_process_generation", evidence: int = 16, forget: int | None = None):
        self.width, self.generation, self.evidence, self.forget = width, generation, evidence, forget
        self.reads = ["technique", "severity", "score", "source", generation]

    def first(self):
        return {"stamp": None, "rank": 0, "score": None, "opened": [], "sources": [], "evidence": [], "last": 0}

    def step(self, state, ts, event_id, row):
        stamp, technique, score, source = (row.get(c) for c in (self.generation, "technique", "score", "source"))
        s = self.first() if None not in (stamp, state["stamp"]) and stamp != state["stamp"] else dict(state)
        s["stamp"] = stamp if s["stamp"] is None else s["stamp"]
        opened = dict(map(tuple, s["opened"]))
        again = technique in opened and ts - opened[technique] <= self.width
        if not again:
            opened[technique] = ts
        rank = SEVERITIES.index(row["severity"]) if row.get("severity") in SEVERITIES else -1
        raised = rank > s["rank"] or (score is not None and (s["score"] is None or score > s["score"]))
        s |= {"rank": max(rank, s["rank"]), "score": max((x for x in (score, s["score"]) if x is not None), default=None), "opened": list(opened.items()), "last": ts}
        s["sources"] = s["sources"] if source is None or source in s["sources"] else [*s["sources"], source]
        s["evidence"] = [*s["evidence"], event_id][-self.evidence :]
        return s, [] if again and not raised else [(event_id, s["rank"], s["score"], list(opened), s["sources"], s["evidence"])]

    def due(self, state):
        return None if self.forget is None else state["last"] + self.forget


class Silence(Machine):
    """since, told_at: a counter has not moved for longer than the deadline; told when time has passed it, without any row."""

    out = "since long, told_at long"

    def __init__(self, counter: str, deadline: int):
        self.counter, self.deadline, self.reads = counter, deadline, [counter]

    def step(self, state, ts, event_id, row):
        value = row.get(self.counter)
        return (state if state is not None and state["value"] == value else {"value": value, "since": ts, "told": False}), []

    def due(self, state):
        return None if state is None or state["told"] else state["since"] + self.deadline

    def wake(self, state, at):
        return state | {"told": True}, [(state["since"], at)]


class _Processor(StatefulProcessor):
    def __init__(self, machine: Machine, names: list[str]):
        self.machine, self.names = machine, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ts long, event_id long, body string")
        self.state = handle.getValueState("state", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in zip(pdf["ts_us"].tolist(), pdf["event_id"].tolist(), pdf["body"].tolist(), strict=True)]
        self.held.appendList(new)
        self.wait({r[0] for r in new})
        yield pd.DataFrame(columns=self.names)

    def wait(self, times) -> None:
        for at in {-(-t // 1000) for t in times}:
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.held.get()) if self.held.exists() else []
        ready, later = [r for r in held if r[0] <= past], [r for r in held if r[0] > past]
        known = self.state.exists()
        state, out = (json.loads(self.state.get()[0]) if known else self.machine.first()), []

        def look(until: int, last: bool) -> None:
            """Wake the machine as often as it wants before a time (at it, too, if no row comes)."""
            nonlocal state, known
            while known and (at := self.machine.due(state)) is not None and (at <= until if last else at < until):
                state, rows = self.machine.wake(state, at)
                out.extend(rows)
                if state is None:
                    state, known = self.machine.first(), False

        for ts, event_id, body in ready:
            look(ts, False)
            state, rows = self.machine.step(state, ts, event_id, json.loads(body))
            known = True
            out.extend(rows)
        look(past, True)
        if ready:
            (self.held.put(later) if later else self.held.clear())
        if known:
            self.state.update((json.dumps(state),))
            at = self.machine.due(state)
            if at is not None:
                self.wait({at})
        elif self.state.exists():
            self.state.clear()
        yield pd.DataFrame([(*key, *r) for r in out], columns=self.names)

    def close(self) -> None:
        pass


def keyed_stream(ev: DataFrame, keys: list[str], machine: Machine, delay: str = "1 minute") -> DataFrame:
    """The rows that a machine tells of each key, in append mode; events later than the delay are dropped. ev: a stream with ts_us and event_id."""
    rows = ev.select(*keys, "ts_us", "event_id", F.to_json(F.struct(*(machine.reads or ["event_id"]))).alias("body"), F.timestamp_micros("ts_us").alias("at")).withWatermark("at", delay)
    schema = T.StructType([*(ev.schema[k] for k in keys), *T.StructType.fromDDL(machine.out).fields])
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_Processor(machine, schema.names), outputStructType=schema, outputMode="Append", timeMode="EventTime")
