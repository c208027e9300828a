"""Streams with state: events of a key are taken in the order of their times, however micro-batches bring them.

An event waits in the state until the watermark has passed it, and timers on event time end what is open. The
state is kept in RocksDB (``prepare``), so it is bounded by disk and survives a restart with the checkpoint."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import coalesce, pairing
from ..session import let_workers_import

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """These operators need the RocksDB state store."""
    let_workers_import(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _plain(v: object) -> object:
    """A value as the state takes it: pandas makes floats of whole numbers beside nulls."""
    if v is None or v != v:
        return None
    return bool(v) if isinstance(v, (bool, np.bool_)) else int(v) if isinstance(v, (float, np.floating, np.integer)) else v


class InOrder(StatefulProcessor):
    """Takes a key's events in their order. A subclass says what an event does (``fold``), when the state next ends (``due``) and
    what it then gives (``end``)."""

    #: Columns of an event, ts_ms and seq first, and their types.
    waits = ""
    columns: list[str] = []
    out: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.open = handle.getValueState("open", "state string")

    def fold(self, key: tuple, state: dict, event: tuple) -> list[tuple]:
        raise NotImplementedError

    def due(self, state: dict) -> int | None:
        raise NotImplementedError

    def end(self, key: tuple, state: dict) -> list[tuple]:
        raise NotImplementedError

    def _advance(self, key: tuple, waiting: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        state = json.loads(self.open.get()[0]) if self.open.exists() else {}
        out, later = [], []
        for event in sorted(waiting, key=lambda e: e[:2]):
            if event[0] >= watermark:
                later.append(event)
                continue
            if (at := self.due(state)) is not None and at <= event[0]:
                out += self.end(key, state)
            out += self.fold(key, state, event)
        if (at := self.due(state)) is not None and at <= watermark:
            out += self.end(key, state)
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        self.open.clear()
        if state:
            self.open.update((json.dumps(state),))
        # Timers that are set already stay: one that fires early finds nothing to do.
        times = [t for t in (later[0][0] + 1 if later else None, self.due(state)) if t is not None]
        if times:
            self.handle.registerTimer(max(min(times), watermark + 1))
        if out:
            yield pairing.frame(out, self.out)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        waiting = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        for batch in rows:
            waiting += (tuple(map(_plain, row)) for row in batch[self.columns].itertuples(index=False, name=None))
        yield from self._advance(key, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        waiting = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        yield from self._advance(key, waiting, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class Coalesce(InOrder):
    """``operators.coalesce`` for one place: an entry is its first time, how many events it took, and those it kept."""

    waits = "ts_ms long, seq long, kind string, from_path string"
    columns = ["ts_ms", "seq", "kind", "from_path"]
    out = [c.split()[0] for c in coalesce.OUTPUT.split(", ")]

    def __init__(self, window_ms: int) -> None:
        self.window_ms = window_ms

    def fold(self, key: tuple, state: dict, event: tuple) -> list[tuple]:
        ts, seq, kind, source = event
        if not state:
            state.update(first=int(ts), n=0, kept=[])
        state["n"] += 1
        coalesce.take(state["kept"], [kind, source, int(seq)])
        return []

    def due(self, state: dict) -> int | None:
        return state["first"] + self.window_ms if state else None

    def end(self, key: tuple, state: dict) -> list[tuple]:
        lost = state["n"] - len(state["kept"])
        out = [(*key, state["first"], k, *event, lost) for k, event in enumerate(state["kept"], 1)]
        state.clear()
        return out


class Pair(InOrder):
    """``operators.pairing`` for one tracker."""

    waits = "ts_ms long, seq long, mode string, root_id long, path string, to_root_id long, to_path string, folder boolean"
    columns = pairing.HALF[1:]
    out = [c.split()[0] for c in pairing.EVENT.split(", ")]

    def __init__(self, window_ms: int) -> None:
        self.window_ms = window_ms

    def fold(self, key: tuple, state: dict, event: tuple) -> list[tuple]:
        return pairing.pair(state, event, self.window_ms)

    def due(self, state: dict) -> int | None:
        times = [state["wait"][0] if "wait" in state else None, state.get("paired")]
        times = [t + self.window_ms + 1 for t in times if t is not None]
        return min(times) if times else None

    def end(self, key: tuple, state: dict) -> list[tuple]:
        now = self.due(state)
        if "paired" in state and now - state["paired"] > self.window_ms:
            del state["paired"]
        return [pairing.lone(state)] if pairing.overdue(state, now, self.window_ms) else []


def coalesce_stream(events: DataFrame, window_ms: int = 1000, late: str = "5 seconds") -> DataFrame:
    """``coalesce`` of a stream (ts timestamp, root_id, path, seq, kind, from_path): an entry comes out when the watermark has passed its
    window. Events without a path come out at once. Events later than ``late`` behind the latest are dropped."""
    prepare(events.sparkSession)
    e = events.withColumn("ts_ms", F.unix_millis("ts"))
    lost = F.col("path").isNull() | F.col("root_id").isNull()
    none = F.lit(0).cast("long")
    straight = e.where(lost).select("root_id", "path", F.col("ts_ms").alias("first_ms"), F.lit(1).alias("place"), "kind", "from_path", "seq", none.alias("absorbed"))
    rows = e.where(~lost).withWatermark("ts", late).groupBy("root_id", "path")
    return rows.transformWithStateInPandas(Coalesce(window_ms), coalesce.OUTPUT, "Append", "EventTime").union(straight)


def pair_stream(halves: DataFrame, window_ms: int = 2000, late: str = "5 seconds") -> DataFrame:
    """``pair_halves`` of a stream of halves with their time ``ts``; a lone first half comes out once the watermark has passed its wait."""
    prepare(halves.sparkSession)
    rows = halves.where("tracker is not null").withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", late)
    return rows.groupBy("tracker").transformWithStateInPandas(Pair(window_ms), pairing.EVENT, "Append", "EventTime")
